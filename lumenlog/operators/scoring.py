"""Scoring of messages and intervals by trained models, as a chain of DataFrame functions."""

from __future__ import annotations

import math
from graphlib import TopologicalSorter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlog.operators.context import context_status
from lumenlog.operators.training import bernoulli_full, log_normal, log_normal_log_prob, n_intervals, percentile_table, poisson_log_prob, rarity_bucket

HUGE = 1001.0


def rarity_scores(summaries: DataFrame, model: DataFrame, intervals: Column) -> DataFrame:
    """``summaries`` with probability, rarity (its -ln), raw_anomaly, frequency and rarity_main by the model of ``training.bernoulli_full``.

    Probabilities are odds p / (1 - p). Where ``summaries`` has a column status, an id out of context has the probability of the intervals out of
    context. An id that training never saw has 0.5 / N and main 1."""
    got = summaries.join(model.select("message_id", F.col("probability").alias("known"), F.col("out_probability").alias("known_out")), "message_id", "left")
    seen = F.when(F.col("status") == "OUT_OF_CONTEXT", F.col("known_out")).otherwise(F.col("known")) if "status" in summaries.columns else F.col("known")
    p = F.coalesce(seen, F.lit(0.5) / intervals)
    odds = p / (1 - p)
    main = F.when(F.col("known").isNull(), 1.0).otherwise(1 - odds)
    return got.select("*", odds.alias("probability"), (-F.log(odds)).alias("rarity"), (1 - p).alias("raw_anomaly"), (1 / p).alias("frequency"), main.alias("rarity_main")).drop("known", "known_out")


def bucket_rarity_scores(summaries: DataFrame, model: DataFrame, intervals: Column, most: int = 16) -> DataFrame:
    """``summaries`` with prob, normalised, bernoulli, full and main from the histogram of ``training.rarity`` with the same ``most``.

    prob is that of the bucket of n, normalised by the id's likeliest bucket; main is 1 - normalised * bernoulli. An id that training never saw has only main."""
    per = model.groupBy("message_id").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "prob"))).alias("probs"), F.max("prob").alias("likeliest"), F.sum("count").alias("seen"))
    got = summaries.join(per, "message_id", "left").withColumn("prob", F.element_at("probs", rarity_bucket(F.col("n"), most)))
    got = got.withColumn("normalised", F.col("prob") / F.col("likeliest")).withColumn("bernoulli", (F.col("seen") + 0.5) / (intervals + 1))
    main = F.when(F.col("seen").isNull(), 1 - 0.5 / (intervals + 1)).otherwise(1 - F.col("normalised") * F.col("bernoulli"))
    return got.withColumn("full", 1 - F.col("prob") * F.col("bernoulli")).withColumn("main", main).drop("probs", "likeliest", "seen")


def _explained(df: DataFrame) -> Column:
    """Whether an id is explained by its cluster here; never without a column status."""
    return F.coalesce(F.col("status") == "IN_CONTEXT", F.lit(False)) if "status" in df.columns else F.lit(False)


def count_scores(df: DataFrame, model: DataFrame) -> DataFrame:
    """``df`` with count_score, count_main, count_mean and is_new by the log-normal model: -ln of the density relative to the mean's.

    0 for ids in context, unseen ids and bad fits; an unseen id has the mean of the least mu of all ids."""
    got = df.join(model.select("message_id", "mu", "bad_fit"), "message_id", "left")
    score = F.when(F.coalesce("bad_fit", F.lit(True)) | _explained(df), 0.0).otherwise(-log_normal_log_prob(F.col("n"), F.col("mu")))
    least = model.where("mu > 0").agg(F.least(F.lit(1.0), F.min("mu")).alias("m")).scalar()
    got = got.withColumn("count_score", score).withColumn("is_new", F.col("mu").isNull()).withColumn("count_mean", F.exp(F.coalesce("mu", least, F.lit(1.0))))
    return got.withColumn("count_main", 1 - F.exp(-F.col("count_score"))).drop("mu", "bad_fit")


def poisson_scores(df: DataFrame, model: DataFrame, most: int = 1000) -> DataFrame:
    """``df`` with poisson_score, poisson_score_capped (counts beyond ``most`` as that many), poisson_most (by the least rate) and poisson_main.

    Ids without a rate are scored by the least rate and have main 1, others 0.999 (1 - p); ids in context have 0."""
    got = df.join(model.select("message_id", "rate"), "message_id", "left").withColumn("least", F.coalesce(model.agg(F.min("least_rate").alias("m")).scalar(), F.lit(1.0)))
    none = F.coalesce(F.col("rate"), F.lit(0.0)) <= 0
    rate = F.when(none, F.col("least")).otherwise(F.col("rate"))
    lp = poisson_log_prob(F.col("n"), rate)
    zero = _explained(df)
    main = F.when(zero, 0.0).when(none, 1.0).otherwise(0.999 * (1 - F.exp(lp)))
    return got.select(*df.columns, F.when(zero, 0.0).otherwise(-lp).alias("poisson_score"), F.when(zero, 0.0).otherwise(-poisson_log_prob(F.col("n"), rate, most)).alias("poisson_score_capped"), (-poisson_log_prob(F.col("n"), F.col("least"))).alias("poisson_most"), main.alias("poisson_main"))


def severity_weight(severity: Column, weights: dict[int, float] | None = None) -> Column:
    """Weight of a severity (0 to 4), 1 where none is given."""
    pairs = [F.lit(x) for k, w in (weights or {}).items() for x in (k, float(w))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), severity), F.lit(1.0)) if pairs else F.lit(1.0)


def weighted(count: Column, rarity: Column, severity: Column, explained: Column | None = None) -> Column:
    """Score of a message: 0.2 of the count's and 0.8 of the rarity's, times the severity's weight; infinite becomes HUGE; 0 where a cluster explains it."""
    x = (count * 0.2 + rarity * 0.8) * severity
    x = F.when(explained, 0.0).otherwise(x) if explained is not None else x
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), HUGE).otherwise(x)


def message_scores(summaries: DataFrame, length: int, labels: DataFrame | None = None, weights: dict[int, float] | None = None) -> DataFrame:
    """``summaries`` (source_id, frame, message_id, n, and severity where there is one) with rarity, count_score and anomaly, the models trained on the same summaries.

    With ``labels`` (message_id, cluster) the statistics in context are left out of training, an id out of context has its own probability, and
    what a cluster explains has score 0."""
    marked = context_status(summaries, labels, summaries).withColumn("inside", F.col("status") == "IN_CONTEXT") if labels is not None else summaries
    inside = "inside" if labels is not None else None
    return scored(marked, bernoulli_full(marked, length, inside), log_normal(marked, inside), n_intervals(summaries, length).scalar(), weights)


def scored(marked: DataFrame, rare: DataFrame, counts: DataFrame, intervals: Column, weights: dict[int, float] | None = None) -> DataFrame:
    """The chain of message scorers by models trained before; ``marked`` may have status (from ``context.context_status``) and severity."""
    both = count_scores(rarity_scores(marked.withColumn("all_n", intervals), rare, F.col("all_n")).drop("all_n"), counts)
    weight = severity_weight(F.col("severity"), weights) if "severity" in marked.columns else F.lit(1.0)
    return both.withColumn("anomaly", weighted(F.col("count_score"), F.col("rarity"), weight, _explained(marked))).withColumn("main", 1 - F.exp(-F.col("anomaly")))


def most_abnormal(scores: dict[str, Column]) -> tuple[Column, Column]:
    """(largest, name of the first scorer that has it) of scores above 0; 0 and null where none is."""
    worse, name = F.lit(0.0), F.lit(None).cast("string")
    for scorer, score in scores.items():
        more = F.coalesce(score > worse, F.lit(False))
        worse, name = F.when(more, score).otherwise(worse), F.when(more, F.lit(scorer)).otherwise(name)
    return worse, name


def final_interval_scores(ranked: DataFrame, least: float = 0.0) -> DataFrame:
    """``ranked`` (rank, score) with anomaly and log_prob of the interval: the rank, at least ``least``; where that raised it, log_prob is -ln(1 - anomaly), HUGE from 1."""
    anomaly = F.greatest(F.col("rank"), F.lit(least))
    raised = F.when(anomaly >= 1.0, HUGE).otherwise(-F.log(1 - anomaly))
    return ranked.withColumn("anomaly", anomaly).withColumn("log_prob", F.when(anomaly != F.col("rank"), raised).otherwise(F.col("score")))


def output_fields(df: DataFrame, intervals_per_day: float) -> DataFrame:
    """The fields of a written result: bernoulli_value (101 for NEW, else 100 raw_anomaly, at least 1), bernoulli_frequency a day, and the
    periodicity status from the last-seen scorers (given_last, last_seen): in step above 0.7."""
    value = F.when(F.col("status") == "NEW", 101.0).otherwise(F.greatest(F.lit(1.0), 100 * F.col("raw_anomaly")))
    per_day = F.when(F.col("frequency") == 0, 0.0).otherwise(F.lit(float(intervals_per_day)) / F.col("frequency"))
    period = F.when(F.col("given_last") > 0.7, "IN_SYNC").when(F.col("given_last").isNotNull(), "NOT_IN_SYNC").when(F.col("last_seen").isin("new", "neverSeenBefore"), "NEW").otherwise("NON_PERIODIC")
    return df.withColumn("bernoulli_value", value).withColumn("bernoulli_frequency", per_day).withColumn("periodicity", period).withColumn("anomaly", F.greatest(F.col("anomaly"), F.lit(0.0)))


def limited_model(table: DataFrame) -> DataFrame:
    """One row: whether the percentile table of interval scores says that the model is limited (its values at 996 and 999 are equal)."""
    at = lambda k: F.max(F.when(F.col("bucket") == k, F.col("value")))
    return table.agg((at(996) == at(999)).alias("limited"))


def interval_scores(messages: DataFrame) -> DataFrame:
    return messages.groupBy("source_id", "frame").agg(F.sum("anomaly").alias("score"), F.count(F.lit(1)).alias("n_ids"))


def percentile_rank(scores: DataFrame, buckets: int = 1000, table: DataFrame | None = None) -> DataFrame:
    """Scores as their place in the percentile table: the first bucket whose value is not below, over ``buckets``; 1.01 beyond 1.5 times the largest.

    The table (bucket, value) is that of the scores themselves unless given; it has ``buckets`` numbers, so it goes to the tasks as one array."""
    table = (percentile_table(scores, "score", buckets) if table is None else table).agg(F.array_sort(F.collect_list("value")).alias("t"))
    # Two steps: how many of every 32nd value are below, then how many of the 32 after those.
    step = 32
    both = table.select(F.struct("t", F.filter("t", lambda x, i: i % step == step - 1).alias("coarse")).alias("t")).scalar()
    ranked = scores.withColumn("both", both).withColumn("t", F.col("both.t"))
    lower = F.size(F.filter(F.col("both.coarse"), lambda x: x < F.col("score"))) * step
    below = lower + F.size(F.filter(F.slice("t", lower + 1, F.lit(step)), lambda x: x < F.col("score")))
    return ranked.select("source_id", "frame", "score", F.when(F.col("score") > F.array_max("t") * 1.5, 1.01).when(below >= buckets, 1.0).otherwise(below / buckets).alias("rank"))


def best_of_two_stats(first: tuple[str, Column], second: tuple[str, Column]) -> tuple[Column, Column, Column]:
    """(used, log_prob, probability): the smaller of two named -ln probabilities, whichever is there, 0 and 'none' where neither is."""
    (a, x), (b, y) = first, second
    other = x.isNull() | F.coalesce(y < x, F.lit(False))
    best = F.when(other, y).otherwise(x)
    used = F.when(best.isNull(), "none").when(other, b).otherwise(a)
    return used, F.coalesce(best, F.lit(0.0)), F.when(F.coalesce(best, F.lit(0.0)) > 0, F.exp(-best)).otherwise(1.0)


def best_of_two(a: Column, b: Column) -> Column:
    """The smaller of two scores, whichever is there."""
    return F.least(a, b)


def ordered(scorers: dict[str, set[str]]) -> list[str]:
    """Names of scorers so that each comes after those it depends on; a cycle is an error."""
    return list(TopologicalSorter(scorers).static_order())


def count_thresholds(model: DataFrame, anomalies: tuple[float, ...] = (0.9, 0.99)) -> DataFrame:
    """The number of messages from which an id's count is that anomalous, per anomaly: 1 - e^logProb = a where ln n lies sqrt(-2 ln(1 - a)) sigmas above the mean."""
    sigma = F.greatest(F.lit(0.5), F.sqrt(F.greatest(F.col("mu"), F.lit(0.0))))
    return model.select("message_id", *[F.ceil(F.exp(F.col("mu") + sigma * math.sqrt(-2 * math.log(1 - a)))).cast("long").alias(f"n_{round(a * 100)}") for a in anomalies])
