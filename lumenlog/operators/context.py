"""Scorers that look at the other messages of an interval, and at an id's own past."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenlog.operators.framing import lagged, previous


def context_status(summaries: DataFrame, labels: DataFrame, trained: DataFrame, fraction: float = 0.3) -> DataFrame:
    """``summaries`` with cluster and status: NEW (training never saw the id), UNCLUSTERED, IN_CONTEXT (more than one member of its
    cluster is in the interval, and at least ``fraction`` of them), else OUT_OF_CONTEXT."""
    sizes = labels.withColumn("size", F.count(F.lit(1)).over(W.partitionBy("cluster")))
    known = trained.select("message_id").distinct().withColumn("known", F.lit(True))
    df = summaries.join(sizes, "message_id", "left").join(known, "message_id", "left")
    present = F.count("cluster").over(W.partitionBy("source_id", "frame", "cluster"))
    status = F.when(F.col("known").isNull(), "NEW").when(F.col("cluster").isNull(), "UNCLUSTERED").when((present > 1) & (present / F.col("size") >= fraction), "IN_CONTEXT").otherwise("OUT_OF_CONTEXT")
    return df.withColumn("status", status).drop("size", "known")


def representatives(summaries: DataFrame, labels: DataFrame) -> DataFrame:
    """``summaries`` with status: the first member of a cluster in an interval represents the others."""
    df = summaries.join(labels, "message_id", "left")
    first = F.row_number().over(W.partitionBy("source_id", "frame", "cluster").orderBy("message_id")) == 1
    return df.withColumn("status", F.when(F.col("cluster").isNull(), "UNCLUSTERED").when(first, "REPRESENTATIVE").otherwise("IN_CONTEXT"))


def mate_scores(summaries: DataFrame, pairs: DataFrame, counts: DataFrame, intervals: Column) -> DataFrame:
    """(source_id, frame, message_id, mate, mate_seen, prob): the id's probability given whether its best predictor is there, 0.5 added.

    ``pairs`` is (message_id, mate, joint), ``counts`` (message_id, c)."""
    here = summaries.select("source_id", "frame", F.col("message_id").alias("mate"), F.lit(True).alias("here"))
    df = summaries.join(pairs, "message_id").join(here, ["source_id", "frame", "mate"], "left").withColumn("mate_seen", F.coalesce("here", F.lit(False)))
    df = df.join(counts.select("message_id", "c"), "message_id").join(counts.select(F.col("message_id").alias("mate"), F.col("c").alias("m")), "mate").withColumn("intervals", intervals)
    yes = (F.col("joint") + 0.5) / (F.col("m") + 0.5)
    no = (F.col("c") - F.col("joint") + 0.5) / (F.col("intervals") - F.col("m") + 0.5)
    return df.select("source_id", "frame", "message_id", "mate", "mate_seen", F.when(F.col("mate_seen"), yes).otherwise(no).alias("prob"))


def last_seen_status(df: DataFrame) -> DataFrame:
    """(source_id, message_id, ms, since_ms, status): time since the id's last message in its source."""
    df = previous(df, ["source_id", "message_id"], "ms")
    since = F.col("ms") - F.col("previous")
    return df.select("source_id", "message_id", "ms", since.alias("since_ms"), F.when(since.isNull(), "NEW").otherwise("REGULAR").alias("status"))


def last_seen(summaries: DataFrame, length: int, run: str | None = None) -> DataFrame:
    """(source_id, frame, message_id, status, deltas, last_ms) of interval summaries with ``ticks``.

    ``deltas`` are whole seconds: from the id's last tick in an earlier interval to its first here (from the frame's beginning where there is
    none), then between the ticks. Without ticks the message counts as one in the middle. status: neverSeenBefore for an id's first
    interval in its source, new for its first in a run (column ``run``), noTimeline without ticks, else regular; last_ms is that last tick."""
    tick = length // 120
    some = F.size("ticks") > 0
    first = F.col("frame") + F.when(some, F.get("ticks", F.lit(0)) * tick).otherwise(60 * tick)
    ended = F.struct((F.col("frame") + F.when(some, F.element_at(F.when(some, F.col("ticks")), -1) * tick).otherwise(60 * tick)).alias("at"), (F.col(run) if run else F.lit(0)).alias("run"))
    got = lagged(summaries.withColumn("first", first).withColumn("ended", ended), ["source_id", "message_id"], "frame", "ended", "before")
    known = F.when(F.col("before.run") == F.col("ended.run"), F.col("before.at"))
    steps = F.when(F.size("ticks") > 1, F.zip_with(F.slice("ticks", 2, 119), F.slice("ticks", F.lit(1), F.size("ticks") - 1), lambda b, a: F.floor((b - a) * tick / 1000))).otherwise(F.array().cast("array<bigint>"))
    since = F.floor((F.col("first") - F.coalesce(known, F.col("frame"))) / 1000)
    status = F.when(F.col("before").isNull(), "neverSeenBefore").when(known.isNull(), "new").when(~some, "noTimeline").otherwise("regular")
    return got.select("source_id", "frame", "message_id", status.alias("status"), F.concat(F.array(since), steps).alias("deltas"), known.alias("last_ms"))


def periodicity_model(seen: DataFrame, points: int = 10, top: int = 10, concentration: float = 2.0) -> DataFrame:
    """(message_id, l_max, ll_max, scores) from the deltas of ``last_seen``: l_max = ln of the commonest delta's count, ll_max = -ln of its share.

    ``scores`` maps deltas seen more than once to l_max - ln count; it is null for an id with fewer than ``points`` deltas, whose commonest
    delta is not seen more than ``top`` times, or with too few deltas per distinct one. The table is one row per id and distinct delta before it is
    put together: deltas are at most the seconds between an id's intervals."""
    h = seen.select("message_id", F.explode("deltas").alias("delta")).groupBy("message_id", "delta").agg(F.count(F.lit(1)).alias("c"))
    per = h.groupBy("message_id").agg(F.sum("c").alias("points"), F.count(F.lit(1)).alias("bins"), F.max("c").alias("top"), F.map_from_entries(F.collect_list(F.when(F.col("c") > 1, F.struct("delta", F.log("c"))))).alias("m"))
    enough = F.col("points") >= points
    good = enough & (F.col("top") > top) & (F.col("points") / F.col("bins") > concentration)
    return per.select("message_id", F.when(enough, F.log("top")).alias("l_max"), F.when(enough, -F.log(F.col("top") / F.col("points"))).alias("ll_max"), F.when(good, F.transform_values("m", lambda _, v: F.log(F.col("top")) - v)).alias("scores"))


def last_seen_scores(seen: DataFrame, model: DataFrame) -> DataFrame:
    """``seen`` with log_prob, main = e^-log_prob, anomaly and given_last: the worst of its deltas by the model.

    A delta is scored by itself or, where that is better, with the one before it (one message may be extra); one never seen is ln 2 above the
    commonest. Ids without a model have log_prob 0; given_last = log_prob + ll_max only where the id has a table of deltas."""
    got = seen.join(model, "message_id", "left")
    own = F.transform("deltas", lambda d, i: F.least(F.try_element_at("scores", d), F.when(i > 0, F.try_element_at("scores", d + F.get("deltas", i - 1)))))
    worst = F.array_max(F.transform(own, lambda x: F.coalesce(x, F.col("l_max") + math.log(2))))
    log_prob = F.when(F.col("scores").isNull(), 0.0).otherwise(F.greatest(worst, F.lit(0.0)))
    got = got.withColumn("log_prob", log_prob).withColumn("given_last", F.when(F.col("scores").isNotNull(), F.col("log_prob") + F.col("ll_max")))
    return got.withColumn("main", F.exp(-F.col("log_prob"))).withColumn("anomaly", 1 - F.col("main")).drop("l_max", "ll_max", "scores")


def periodicity_scores(deltas: DataFrame, width: int = 600) -> DataFrame:
    """(message_id, bin, c, score, given_last): ln of the largest bin less ln of this one, and less ln(largest / points)."""
    h = deltas.groupBy("message_id", F.floor(F.col("delta") / width).alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    w = W.partitionBy("message_id")
    top, points = F.max("c").over(w), F.sum("c").over(w)
    score = F.log(top) - F.log("c")
    return h.select("message_id", "bin", "c", score.alias("score"), (score - F.log(top / points)).alias("given_last"))


def nist_percentiles(df: DataFrame, key: str, value: str, bins: int, total: Column) -> DataFrame:
    """(key, bin, value): percentiles at bin / bins by interpolation between the neighbours of place p (n + 1), the values filled up with zeros to ``total``.

    Only values that are there are ordered; a place among the zeros is 0."""
    # Places follow from a count per distinct value, so a key's window has one row per distinct value, however many rows it has.
    counts = df.where(F.col(value).isNotNull()).withColumn("total_n", total).groupBy(key, value).agg(F.count(F.lit(1)).alias("k"), F.max("total_n").alias("total_n"))
    w = W.partitionBy(key).orderBy(value)
    placed = counts.select(key, value, "total_n", F.sum("k").over(w).alias("upto"), "k", F.sum("k").over(W.partitionBy(key)).alias("rows")).withColumn("upto", F.col("total_n") - F.col("rows") + F.col("upto"))
    ends = placed.groupBy(key).agg(F.max("total_n").alias("total_n"), F.max(value).alias("top"))
    grid = ends.select(key, "total_n", "top", F.explode(F.sequence(F.lit(0), F.lit(bins))).alias("bin")).withColumn("at", F.col("bin") / bins * (F.col("total_n") + 1)).withColumn("low", F.floor("at"))
    # The value at a place is that of the range of places it lies in; a place below all ranges is a zero.
    near = placed.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("upto", (F.col("upto") - F.col("k")).alias("from"), F.col(value).alias("v")))).alias("ranges"))
    at = lambda p: F.get(F.filter("ranges", lambda x: (x["from"] < p) & (x["upto"] >= p)), F.lit(0))["v"]
    both = grid.join(near, key).withColumn("v0", at(F.col("low"))).withColumn("v1", at(F.col("low") + 1))
    v0, v1 = F.coalesce("v0", F.lit(0.0)), F.coalesce("v1", F.lit(0.0))
    got = F.when(F.col("low") >= F.col("total_n"), F.col("top")).otherwise(v0 + (F.col("at") - F.col("low")) * (v1 - v0))
    return both.select(key, "bin", got.alias("value"))


def rescaled_ticks(ticks: Column, start: Column, length: int, new_start: Column, new_length: int, n: int = 120) -> Column:
    """Ticks of a frame in another frame, by the exact times of their centres, clamped to -1 and n."""
    at = lambda t: start + F.lit(length) / n * (t + 0.5)
    return F.array_sort(F.array_distinct(F.transform(ticks, lambda t: F.least(F.greatest(F.floor((at(t) - new_start) * n / new_length), F.lit(-1)), F.lit(n)).cast("int"))))


def overlaps(periods: DataFrame, key: str, low: str, high: str) -> DataFrame:
    """Pairs of periods of one key that overlap: each against the greatest end before it, by order of their starts."""
    w = W.partitionBy(key).orderBy(low, high).rowsBetween(W.unboundedPreceding, -1)
    return periods.withColumn("before", F.max(high).over(w)).where(F.col("before") > F.col(low)).drop("before")
