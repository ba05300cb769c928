"""Statistics of message streams, intervals and rates, and whether a source has enough to train on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlog.operators.framing import previous, runs

SLOT = 600_000


def message_rates(df: DataFrame, sizes: tuple[int, ...] = (1, 2, 3, 6, 12, 24), wrapper: Column | None = None) -> DataFrame:
    """(source_id, slots, slot, n, n_ids, n_wrapper, wrapper_ids): messages and distinct ids per window of so many ten-minute slots, wrapper messages apart.

    Ten-minute summaries are made first; the wider windows read those."""
    fine = df.withColumn("wrapper", wrapper if wrapper is not None else F.lit(False)).groupBy("source_id", "message_id", "wrapper", F.floor(F.col("ms") / SLOT).alias("fine")).agg(F.count(F.lit(1)).alias("n"))
    wide = fine.withColumn("slots", F.explode(F.array(*map(F.lit, sizes))))
    own, extra = ~F.col("wrapper"), F.col("wrapper")
    return wide.groupBy("source_id", "slots", F.floor(F.col("fine") / F.col("slots")).alias("slot")).agg(
        F.coalesce(F.sum(F.when(own, F.col("n"))), F.lit(0)).alias("n"), F.count_distinct(F.when(own, F.col("message_id"))).alias("n_ids"),
        F.coalesce(F.sum(F.when(extra, F.col("n"))), F.lit(0)).alias("n_wrapper"), F.count_distinct(F.when(extra, F.col("message_id"))).alias("wrapper_ids"),
    )


def rate_summary(df: DataFrame, unit: str = "month") -> DataFrame:
    """(source_id, report, slots, mean_n, min_n, max_n, sd_n, zeros): the ten-minute slots of each source and calendar ``unit``; silent slots between a
    source's first and last one in the unit count as zeros. sd_n is the population standard deviation."""
    per = df.groupBy("source_id", F.floor(F.col("ms") / SLOT).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    report = F.unix_millis(F.date_trunc(unit, F.timestamp_millis(F.col("slot") * SLOT)))
    g = per.groupBy("source_id", report.alias("report")).agg((F.max("slot") - F.min("slot") + 1).alias("slots"), F.count(F.lit(1)).alias("heard"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.min("n").alias("least"), F.max("n").alias("max_n"))
    mean, zeros = F.col("n") / F.col("slots"), F.col("slots") - F.col("heard")
    sd = F.sqrt(F.greatest(F.col("squares") / F.col("slots") - mean * mean, F.lit(0.0)))
    return g.select("source_id", "report", "slots", mean.alias("mean_n"), F.when(zeros > 0, 0).otherwise(F.col("least")).alias("min_n"), "max_n", sd.alias("sd_n"), zeros.alias("zeros"))


def stream_statistics(df: DataFrame, gap: int) -> DataFrame:
    """(source_id, messages, ids, separators, mean_gap_ms, max_gap_ms, mean_n, max_span_ms, mean_ids): of all messages, and per run without a longer pause than ``gap``."""
    marked = runs(df, ["source_id"], "ms", gap)
    before = previous(marked, ["source_id", "run"], "ms").withColumn("pause", F.col("ms") - F.col("previous"))
    pauses = before.groupBy("source_id").agg(F.count(F.lit(1)).alias("messages"), F.count_distinct("message_id").alias("ids"), F.avg("pause").alias("mean_gap_ms"), F.max("pause").alias("max_gap_ms"))
    per = marked.groupBy("source_id", "run").agg(F.count(F.lit(1)).alias("n"), (F.max("ms") - F.min("ms")).alias("span"), F.count_distinct("message_id").alias("k"))
    whole = per.groupBy("source_id").agg((F.count(F.lit(1)) - 1).alias("separators"), F.avg("n").alias("mean_n"), F.max("span").alias("max_span_ms"), F.avg("k").alias("mean_ids"))
    return pauses.join(whole, "source_id")


def interval_statistics(summaries: DataFrame) -> DataFrame:
    """(source_id, frame, n_ids, n, n_new, n_never): ids and messages of every interval, ids new to the source, and ids that no source had before."""
    first = summaries.groupBy("source_id", "message_id").agg(F.min("frame").alias("mine"))
    ever = first.groupBy("message_id").agg(F.min("mine").alias("ever"))
    marked = summaries.join(first, ["source_id", "message_id"]).join(ever, "message_id")
    return marked.groupBy("source_id", "frame").agg(F.count(F.lit(1)).alias("n_ids"), F.sum("n").alias("n"), F.sum((F.col("frame") == F.col("mine")).cast("long")).alias("n_new"), F.sum((F.col("frame") == F.col("ever")).cast("long")).alias("n_never"))


def sufficiency(df: DataFrame, hour: int = 3_600_000) -> DataFrame:
    """(source_id, ids, n_hours, insufficient): too few distinct ids for the hours heard to train on: under 180 in less than 1,000 hours, under 20 in more."""
    u = df.groupBy("source_id").agg(F.count_distinct("message_id").alias("ids"), F.count_distinct(F.floor(F.col("ms") / hour)).alias("n_hours"))
    return u.withColumn("insufficient", F.expr("(ids < 180 and n_hours < 1000) or (ids < 20 and n_hours >= 1000)"))


def frequent_ids(summaries: DataFrame, more_than: int) -> DataFrame:
    """(message_id, k): ids seen in more than so many intervals."""
    return summaries.groupBy("message_id").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > more_than)


def error_top(df: DataFrame, head: Column, most: int = 20) -> DataFrame:
    """(head, n): the most frequent kinds of unparsable lines."""
    return df.groupBy(head.alias("head")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "head").limit(most)
