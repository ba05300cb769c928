"""Statistics trained per message id over (source, frame, message_id, n) interval summaries."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlog.functions.text import critical_score
from lumenlog.operators.framing import frame_start, previous
from lumenlog.operators.ordering import running_sum

TICKS = 120


def interval_summaries(df: DataFrame, length: int) -> DataFrame:
    """(source_id, frame, message_id, n, first_ms, ticks): messages per source, frame and id; ticks are the sorted distinct 120ths of the frame."""
    frame = frame_start(F.col("ms"), length)
    tick = F.floor((F.col("ms") - frame) * TICKS / length).cast("int")
    return df.groupBy("source_id", frame.alias("frame"), "message_id").agg(F.count(F.lit(1)).alias("n"), F.min("ms").alias("first_ms"), F.array_sort(F.collect_set(tick)).alias("ticks"))


def message_summaries(df: DataFrame, length: int) -> DataFrame:
    """Whole summaries per source, frame and id of (source_id, message_id, ms, instance_id, text, severity, cnt, cnt_failed): n and failed (sums), first_ms,
    ticks, severity (that of the first message), critical and sample as ``text_samples`` gives them. A null cnt counts 1, a null cnt_failed 0."""
    frame = frame_start(F.col("ms"), length)
    tick = F.floor((F.col("ms") - frame) * TICKS / length).cast("int")
    score = F.when(F.col("text").isNotNull(), critical_score(F.col("text")).cast("long"))
    place = F.when(score.isNotNull(), F.struct(score, -F.col("ms"), -F.col("instance_id")))
    return df.groupBy("source_id", frame.alias("frame"), "message_id").agg(
        F.sum(F.coalesce("cnt", F.lit(1)).cast("long")).alias("n"), F.sum(F.coalesce("cnt_failed", F.lit(0)).cast("long")).alias("failed"), F.min("ms").alias("first_ms"), F.array_sort(F.collect_set(tick)).alias("ticks"),
        F.min_by("severity", F.struct("ms", "instance_id")).alias("severity"), F.max(score).alias("critical"), F.max_by("text", place).alias("sample"),
    )


def merged_summaries(df: DataFrame, keys: list[str], *time_vectors: str) -> DataFrame:
    """Finer summaries of ``message_summaries`` merged by ``keys``: counts add up, the severity is the largest, the sample that of the highest
    critical score (of equal ones the first), ticks in the columns ``time_vectors`` are united."""
    place = F.when(F.col("critical").isNotNull(), F.struct("critical", -F.col("first_ms")))
    united = [F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in time_vectors]
    return df.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("failed").alias("failed"), F.min("first_ms").alias("first_ms"), F.max("severity").alias("severity"), F.max("critical").alias("critical"), F.max_by("sample", place).alias("sample"), *united)


def text_samples(df: DataFrame, length: int) -> DataFrame:
    """(source_id, frame, message_id, sample, score): the first text, replaced by any later one of a strictly higher critical-word score.

    Order is by ms, then instance_id; null texts are passed over, and a group of none but those has a null sample and score."""
    score = F.when(F.col("text").isNotNull(), critical_score(F.col("text")).cast("long"))
    place = F.when(score.isNotNull(), F.struct(score, -F.col("ms"), -F.col("instance_id")))
    return df.groupBy("source_id", frame_start(F.col("ms"), length).alias("frame"), "message_id").agg(F.max_by("text", place).alias("sample"), F.max(score).alias("score"))


def n_intervals(summaries: DataFrame, length: int) -> DataFrame:
    """One row: intervals of the dense grid, empty ones included."""
    return summaries.groupBy("source_id").agg(((F.max("frame") - F.min("frame")) / length + 1).cast("long").alias("k")).agg(F.sum("k").alias("n_intervals"))


def _with_n(per_id: DataFrame, summaries: DataFrame, length: int) -> DataFrame:
    return per_id.withColumn("n_intervals", n_intervals(summaries, length).scalar())


def bernoulli(summaries: DataFrame, length: int) -> DataFrame:
    """Base model: share of intervals with the id, and its score -ln p, at least 1, over 101."""
    per = _with_n(summaries.groupBy("message_id").agg(F.count(F.lit(1)).alias("seen")), summaries, length)
    p = F.col("seen") / F.col("n_intervals")
    return per.select("message_id", "seen", "n_intervals", p.alias("probability"), (F.greatest(F.lit(1.0), -F.log(p)) / 101).alias("score"))


def bernoulli_full(summaries: DataFrame, length: int, context: str | None = None) -> DataFrame:
    """Smoothed model: (c + 0.5) / (N + 1) and its odds; with ``context`` (a boolean column) also over the intervals out of context."""
    out = F.sum(F.when(F.col(context), 0).otherwise(1)) if context else F.count(F.lit(1))
    per = _with_n(summaries.groupBy("message_id").agg(F.count(F.lit(1)).alias("seen"), out.alias("seen_out")), summaries, length)
    p, q = ((F.col(c) + 0.5) / (F.col("n_intervals") + 1) for c in ("seen", "seen_out"))
    odds = lambda x: F.least(F.lit(1.0), x / (1 - x))
    return per.select("message_id", "seen", "n_intervals", p.alias("probability"), q.alias("out_probability"), odds(p).alias("odds"), (-F.log(p / (1 - p))).alias("log_prob"))


def log_normal(summaries: DataFrame, context: str | None = None) -> DataFrame:
    """(message_id, mu, max_n, bad_fit): mu, the mean of ln n; the largest n, and whether its score says that the fit is bad (at least 15).

    With ``context`` (a boolean column: the id is explained by its cluster here) mu is that of the other intervals only, 1 at most and the least
    of all ids where there are none; the largest n is that of all intervals."""
    inside = F.coalesce(F.col(context), F.lit(False)) if context else F.lit(False)
    per = summaries.groupBy("message_id").agg(F.avg(F.when(~inside, F.log("n"))).alias("mu"), F.max("n").alias("max_n"))
    if context:
        least = per.where("mu > 0").agg(F.least(F.lit(1.0), F.min("mu")).alias("m"))
        per = per.withColumn("least", least.scalar()).withColumn("fitted", F.col("mu") > 0).withColumn("mu", F.coalesce("mu", "least", F.lit(1.0)))
    bad = -log_normal_log_prob(F.col("max_n"), F.col("mu")) >= 15
    return per.withColumn("bad_fit", bad & F.coalesce("fitted", F.lit(False)) if context else bad).drop("least", "fitted")


def log_normal_log_prob(n: Column, mu: Column) -> Column:
    """ln of the density at ln n relative to that at the mean; 0 up to the mean (one-sided)."""
    sigma = F.greatest(F.lit(0.5), F.sqrt(F.greatest(mu, F.lit(0.0))))
    z = (F.log(n) - mu) / sigma
    return F.when(z <= 0, 0.0).otherwise(-z * z / 2)


def poisson(summaries: DataFrame, length: int, context: str | None = None) -> DataFrame:
    """(message_id, total, rate, least_rate): rate = occurrences over all intervals; with ``context`` only occurrences outside of it count.

    ``least_rate`` is the least rate above 0 of all ids, 1 at most: what an id without a rate is scored by."""
    counted = F.sum(F.when(F.coalesce(F.col(context), F.lit(False)), 0).otherwise(F.col("n"))) if context else F.sum("n")
    per = _with_n(summaries.groupBy("message_id").agg(counted.alias("total")), summaries, length).withColumn("rate", F.col("total") / F.col("n_intervals"))
    least = per.where("total > 0").agg(F.least(F.lit(1.0), F.min("rate")).alias("m"))
    return per.select("message_id", "total", "rate", F.coalesce(least.scalar(), F.lit(1.0)).alias("least_rate"))


def log_factorial(n: Column) -> Column:
    """ln n!: a table up to 20, beyond it Stirling's series (exact to the last digits there)."""
    x = n.cast("double")
    series = (x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    table = F.array(*[F.lit(math.lgamma(k + 1)) for k in range(21)])
    return F.when(n <= 20, F.get(table, F.greatest(n.cast("int"), F.lit(0)))).otherwise(series)


def poisson_log_prob(n: Column, rate: Column, most: int | None = None) -> Column:
    """ln of the probability of n events; counts beyond ``most`` count as that many."""
    k = F.least(n, F.lit(most)) if most else n
    return k * F.log(rate) - rate - log_factorial(k)


def rarity_bucket(n: Column, most: int = 16) -> Column:
    return F.least(F.lit(most), F.floor(F.log2(n) + 1e-12)).cast("int")


def rarity(summaries: DataFrame, length: int, most: int = 16) -> DataFrame:
    """Histogram of log2 n in 17 buckets with 0.5 added: (message_id, bucket, count, prob)."""
    have = summaries.groupBy("message_id", rarity_bucket(F.col("n"), most).alias("bucket")).agg(F.count(F.lit(1)).alias("count"))
    ids = have.groupBy("message_id").agg(F.sum("count").alias("total"))
    grid = ids.select("message_id", "total", F.explode(F.sequence(F.lit(0), F.lit(most))).alias("bucket"))
    full = grid.join(have, ["message_id", "bucket"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    return full.select("message_id", "bucket", "count", ((F.col("count") + 0.5) / (F.col("total") + (most + 1) / 2)).alias("prob"))


def cooccurrence(summaries: DataFrame, span: int = 1024 * 3_600_000) -> DataFrame:
    """(a, b, joint), a < b: intervals with both ids.

    Intervals of a source are taken together by ``span`` milliseconds: a table of which ids are in which of them, multiplied with itself, counts all
    pairs at once, so what leaves a task is one row per pair and span, not per pair and interval. Rows that come twice count once; those with a null in
    a key column are left out."""
    s = summaries.select("source_id", "frame", "message_id").where("source_id is not null and frame is not null and message_id is not null")
    block = 2048

    def counted(t: pa.Table) -> pa.Table:
        codes = pc.dictionary_encode(t["message_id"]).combine_chunks()
        order = pc.array_sort_indices(codes.dictionary).to_numpy()
        names, place = codes.dictionary.take(pa.array(order)), np.argsort(order)
        frames, row = np.unique(t["frame"].to_numpy(), return_inverse=True)
        here = np.zeros((len(frames), len(names)), np.float32)
        here[row, place[codes.indices.to_numpy()]] = 1
        left, right, joint = [], [], []
        for i in range(0, len(names), block):
            for j in range(i, len(names), block):
                both = here[:, i : i + block].T @ here[:, j : j + block]
                x, y = np.nonzero(np.triu(both, 1) if i == j else both)
                left.append(x + i)
                right.append(y + j)
                joint.append(both[x, y].astype(np.int64))
        x, y, n = (np.concatenate(c) for c in (left, right, joint))
        return pa.table({"a": names.take(pa.array(x)), "b": names.take(pa.array(y)), "joint": n})

    parts = s.groupBy("source_id", F.floor(F.col("frame") / span).alias("part")).applyInArrow(counted, "a string, b string, joint long")
    return parts.groupBy("a", "b").agg(F.sum("joint").alias("joint"))


def smoothed_cooccurrence(summaries: DataFrame, length: int, legal: DataFrame | None = None) -> DataFrame:
    """(a, b, joint, total), a <= b: co-occurrence in 120ths of a frame, over each pair of frames that follow each other in a source.

    An id is away from its last tick in one frame to its first in the next (from the first frame's beginning where it is new, to the next one's end
    where it ends). Two ids are together for the ticks in which neither is away. The first frame of a run adds 120 to its own pairs, and 1 to
    ``total``; each later frame adds 120. With ``legal`` (message_id) only pairs of those ids are kept."""
    s = summaries.select("source_id", "frame", "message_id", F.coalesce(F.get("ticks", F.lit(0)), (TICKS * 0.5 / F.sqrt("n")).cast("int")).alias("first"), F.coalesce(F.element_at(F.when(F.size("ticks") > 0, F.col("ticks")), -1), (TICKS * (1 - 0.5 / F.sqrt("n"))).cast("int")).alias("last"))
    if legal is not None:
        s = s.join(legal.select("message_id").distinct(), "message_id", "left_semi")
    # Frames are dense between a source's ends, so the frame before is there (perhaps empty) but for the first.
    begin = summaries.groupBy("source_id").agg(F.min("frame").alias("begin"), F.max("frame").alias("end"))
    before = s.select("source_id", (F.col("frame") + length).alias("frame"), "message_id", "last")
    both = s.select("source_id", "frame", "message_id", "first").join(before, ["source_id", "frame", "message_id"], "full").join(begin, "source_id")
    pair = both.where((F.col("frame") > F.col("begin")) & (F.col("frame") <= F.col("end"))).select("source_id", "frame", "message_id", F.coalesce("last", F.lit(0)).alias("from"), F.coalesce("first", F.lit(TICKS)).alias("to"))
    a, b = (pair.select("source_id", "frame", F.col("message_id").alias(c), F.col("from").alias(f"{c}_from"), F.col("to").alias(f"{c}_to")) for c in "ab")
    away = lambda c: F.greatest(F.lit(0), F.col(f"{c}_to") - F.col(f"{c}_from"))
    shared = F.greatest(F.lit(0), F.least("a_to", "b_to") - F.greatest("a_from", "b_from"))
    together = F.when(F.col("a") == F.col("b"), TICKS - away("a")).otherwise(TICKS - away("a") - away("b") + shared)
    later = a.join(b, ["source_id", "frame"]).where("a <= b").select("a", "b", together.alias("joint"))
    first = s.join(begin, "source_id").where("frame = begin").select("source_id", "message_id")
    initial = first.withColumnRenamed("message_id", "a").join(first.withColumnRenamed("message_id", "b"), "source_id").where("a <= b").select("a", "b", F.lit(TICKS).alias("joint"))
    total = begin.agg(F.sum(1 + (F.col("end") - F.col("begin")) / length * TICKS).cast("long").alias("t"))
    return later.unionByName(initial).groupBy("a", "b").agg(F.sum("joint").cast("long").alias("joint")).withColumn("total", total.scalar())


def mutual_information(summaries: DataFrame, length: int) -> DataFrame:
    """(a, b, joint, mi): mutual information in bits of two ids' presence, negative where they repel each other."""
    per = summaries.groupBy("message_id").agg(F.count(F.lit(1)).alias("c"))
    n = n_intervals(summaries, length).scalar()
    both = cooccurrence(summaries).join(per.select(F.col("message_id").alias("a"), F.col("c").alias("ca")), "a").join(per.select(F.col("message_id").alias("b"), F.col("c").alias("cb")), "b").withColumn("n", n)
    cells = [("joint", "ca", "cb"), ("(ca - joint)", "ca", "(n - cb)"), ("(cb - joint)", "(n - ca)", "cb"), ("(n - ca - cb + joint)", "(n - ca)", "(n - cb)")]
    terms = " + ".join(f"case when {j} <= 0 then 0D else {j} / n * log2({j} * n / ({x} * {y})) end" for j, x, y in cells)
    return both.select("a", "b", "joint", F.expr(f"if(joint * n >= ca * cb, 1, -1) * ({terms})").alias("mi"))


def best_predictor(summaries: DataFrame, length: int) -> DataFrame:
    """(message_id, mate, entropy): of the ids seen with an id, the one that leaves the least conditional entropy; ties by name."""
    per = summaries.groupBy("message_id").agg(F.count(F.lit(1)).alias("c"))
    n = n_intervals(summaries, length).scalar()
    pairs = cooccurrence(summaries)
    both = pairs.select(F.col("a").alias("message_id"), F.col("b").alias("mate"), "joint").unionByName(pairs.select(F.col("b").alias("message_id"), F.col("a").alias("mate"), "joint"))
    both = both.join(per.select("message_id", "c"), "message_id").join(per.select(F.col("message_id").alias("mate"), F.col("c").alias("m")), "mate").withColumn("n", n)
    h = lambda p: f"(case when {p} <= 0 or {p} >= 1 then 0D else -{p} * log2({p}) - (1 - {p}) * log2(1 - {p}) end)"
    e = F.expr(f"m / n * {h('(joint / m)')} + (n - m) / n * {h('(case when n = m then 0D else (c - joint) / (n - m) end)')}")
    return both.withColumn("entropy", F.round(e, 9)).groupBy("message_id").agg(F.min(F.struct("entropy", "mate")).alias("best")).select("message_id", "best.mate", "best.entropy")


def deltas(df: DataFrame, unit: int = 1000) -> DataFrame:
    """(source_id, message_id, delta): whole seconds between successive messages of an id in a source."""
    df = previous(df, ["source_id", "message_id"], "ms")
    return df.withColumn("delta", F.floor((F.col("ms") - F.col("previous")) / unit)).where("delta is not null").select("source_id", "message_id", "delta")


def delta_model(df: DataFrame, width: int = 600) -> DataFrame:
    """(message_id, points, bins, top, periodic): an id is periodic with at least 10 points, a bin of more than 10 and more than 2 points a bin."""
    h = deltas(df).groupBy("message_id", F.floor(F.col("delta") / width).alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    per = h.groupBy("message_id").agg(F.sum("c").alias("points"), F.count(F.lit(1)).alias("bins"), F.max("c").alias("top"))
    return per.withColumn("periodic", F.expr("points >= 10 and top > 10 and points / bins > 2"))


def percentile_table(df: DataFrame, value: str, buckets: int = 1000) -> DataFrame:
    """(bucket, value): the value at place floor(n i / buckets) of the sorted values, exactly.

    Places come from a count per distinct value, so only distinct values are ordered."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("k"))
    n = counts.agg(F.sum("k").alias("n"))
    placed = running_sum(counts, value, "k", "upto").withColumn("n", n.scalar())
    lower = placed.withColumn("from", F.col("upto") - F.col("k"))
    first, last = F.ceil(F.col("from") * buckets / F.col("n")), F.ceil(F.col("upto") * buckets / F.col("n")) - 1
    spread = lower.withColumn("bucket", F.explode(F.when(first <= F.least(last, F.lit(buckets - 1)), F.sequence(first, F.least(last, F.lit(buckets - 1)))).otherwise(F.array().cast("array<bigint>"))))
    return spread.select(F.col("bucket").cast("int").alias("bucket"), F.col(value).alias("value"))
