"""From log files to scored intervals: upload, verify, train, analyze and mask.

A store is a folder: ``summaries`` (fine message summaries by source and period), ``models/NAME``, ``results`` and ``xml``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog import catalog
from lumenlog import flow as flows
from lumenlog.functions import text as T
from lumenlog.functions.ids import plain_id
from lumenlog.functions.times import DAY
from lumenlog.operators import context, lines, loglines, periods, scoring, statistics, training
from lumenlog.operators.templates import message_ids
from lumenlog.operators.timestamps import utc_millis
from lumenlog.sources import files, readers, writers

HOST = r"\A(?:<\d{1,3}>)?(?:[A-Z][a-z]{2} [ \d]\d \d\d:\d\d:\d\d|\d \d{4}-\d\d-\d\dT\S+) (\S+) "


def _dated(spark: SparkSession, path: str, arrived: str, zone: str) -> tuple[DataFrame, DataFrame]:
    """(raw lines, entries with source_id, date_text and utc_ms, which is null for a time that can't be read)."""
    raw = readers.log_files(spark, path)
    entries = loglines.entries(raw)
    host = raw.select("file", "line_no", F.nullif(F.lower(F.substring(F.regexp_extract("line", HOST, 1), 1, 200)), F.lit("")).alias("host"))
    named = F.coalesce("host", F.lower(F.regexp_extract("file", r"([^/]+?)(?:\.log)?(?:\.gz)?\z", 1)))
    # Date texts with a comma before the milliseconds are written with a point.
    both = entries.join(host, ["file", "line_no"]).select(named.alias("source_id"), F.regexp_replace("stamp", r"(?<=\d\d:\d\d:\d\d),", ".").alias("date_text"), F.to_timestamp(F.lit(arrived)).alias("ts"), "component", "severity", "message", "file", "line_no")
    zones = both.select("source_id").distinct().withColumn("time_zone", F.lit(zone))
    return raw, utc_millis(both, zones)


def parsed(spark: SparkSession, path: str, arrived: str, zone: str = "UTC") -> DataFrame:
    """(source_id, ms, component, severity, text, instance_id) of the entries of log files; the source is the host, or the file's name where a line has none.

    A date without a year is the one closest to ``arrived`` (as 2026-01-31 12:00:00); local clocks are those of ``zone``. Entries without a readable
    time are left out (see ``unreadable``)."""
    dated = _dated(spark, path, arrived, zone)[1].where("utc_ms is not null")
    text = T.without_controls(F.col("message"))
    name = T.component_or_none(F.col("component"))
    return dated.select("source_id", F.col("utc_ms").alias("ms"), lines.component(name, text).alias("component"), "severity", text.alias("text"), F.xxhash64("file", "line_no").alias("instance_id"), F.lit(1).alias("cnt"), F.lit(0).alias("cnt_failed"))


def unreadable(spark: SparkSession, path: str, arrived: str, zone: str = "UTC") -> DataFrame:
    """(kind, n, examples) of what ``parsed`` leaves out: lines before a file's first entry, and entries whose time can't be read."""
    raw, dated = _dated(spark, path, arrived, zone)
    first = dated.groupBy("file").agg(F.min("line_no").alias("first"))
    stray = raw.join(first, "file", "left").where("first is null or line_no < first").select(F.lit("no entry").alias("kind"), "line")
    untimed = dated.where("utc_ms is null").select(F.lit("no time").alias("kind"), F.col("date_text").alias("line"))
    return writers.error_report(stray.unionByName(untimed), "kind", "line")


def with_ids(messages: DataFrame) -> DataFrame:
    """``messages`` with message_id: that of the group of similar texts within the component."""
    m = messages.withColumn("plain", T.normalised(F.col("text")))
    ids = message_ids(m.select("component", "plain", "instance_id"), "component", "plain", "instance_id")
    return m.join(ids, ["component", "plain"]).drop("plain")


def upload(spark: SparkSession, messages: DataFrame, store: str, flow: flows.Flow = flows.Flow(), unit: str = "day") -> None:
    """Message summaries of fine frames into the store; a source's period that is written again replaces itself."""
    fine = flows.FRAMERS[flow.framer](messages, flow.fine_ms)
    period = F.date_format(F.timestamp_millis(periods.period_start(F.col("frame"), unit)), "yyyy-MM-dd")
    writers.upload_intervals(fine.withColumn("period", period), f"{store}/summaries")


def stored(spark: SparkSession, store: str, flow: flows.Flow, low: str | None = None, high: str | None = None) -> DataFrame:
    """Coarse summaries put together from the stored fine ones of the periods ``low`` to ``high``."""
    fine = readers.intervals(spark, f"{store}/summaries", low=low, high=high).withColumn("source_id", F.col("source_id").cast("string"))
    coarse = F.col("frame") - F.pmod("frame", F.lit(flow.coarse_ms))
    moved = fine.withColumn("coarse", coarse).withColumn("ticks", context.rescaled_ticks(F.col("ticks"), F.col("frame"), flow.fine_ms, F.col("coarse"), flow.coarse_ms))
    return training.merged_summaries(moved, ["source_id", "coarse", "message_id"], "ticks").withColumnRenamed("coarse", "frame")


def verify(spark: SparkSession, store: str, flow: flows.Flow = flows.Flow()) -> DataFrame:
    """Whether each source has enough stored to train on."""
    return statistics.sufficiency(stored(spark, store, flow).withColumn("ms", F.col("frame")))


def train(spark: SparkSession, store: str, name: str, flow: flows.Flow = flows.Flow(), group: str | None = None, sources: list[str] | None = None, low: str | None = None, high: str | None = None, excluded: list[str] | None = None, default: bool = True) -> str:
    """Trains a model of the flow's scorers on stored summaries and makes it its group's default; its path. Periods (days) of ``excluded`` take no part."""
    s = stored(spark, store, flow, low, high)
    s = s.where(F.col("source_id").isin(sources)) if sources else s
    s = s.where(~F.date_format(F.timestamp_millis("frame"), "yyyy-MM-dd").isin(excluded)) if excluded else s
    # Every scorer reads the summaries again, some twice.
    s = s.persist()
    span = periods.time_span(s, flow.coarse_ms).first()
    if span["start"] is None:
        raise ValueError("nothing stored to train on")
    models = flows.fit(s, flow)
    meta = {"start": span["start"], "end": span["end"], "interval_ms": flow.coarse_ms, "intervals_per_day": DAY // flow.coarse_ms, "training_days": -(-(span["end"] - span["start"]) // DAY)}
    path = f"{store}/models/{name}"
    catalog.store_model(models, path, group, meta)
    for kept in (*models.values(), s):
        kept.unpersist()
    limited = scoring.limited_model(spark.read.parquet(f"{path}/percentiles")).first()["limited"]
    files.write_text(spark, f"{path}/limited", "Yes" if limited else "No")
    if default:
        catalog.set_default(spark, path)
    return path


def analyze(spark: SparkSession, messages: DataFrame, store: str, flow: flows.Flow = flows.Flow(), group: str | None = None, least: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(scored messages, scored intervals) of new messages by the group's default model; they are uploaded too, and go to the flow's outputs.

    Both results are kept in memory for the outputs and the caller, who may ``unpersist`` them."""
    path = catalog.default_model(spark, f"{store}/models", group)
    if path is None:
        raise ValueError("no model")
    models, meta = catalog.load_model(spark, path)
    upload(spark, messages, store, flow)
    new = flows.FRAMERS[flow.framer](messages, flow.coarse_ms).persist()
    scored = scoring.output_fields(flows.score(new, models, flow), meta["intervals_per_day"]) if {"clusters", "periodicity"} <= {s.name for s in flow.scorers} else flows.score(new, models, flow)
    scored = scored.persist()
    intervals = flows.score_intervals(scored, models, least)
    fresh = statistics.interval_statistics(new.select("source_id", "frame", "message_id", "n")).select("source_id", "frame", "n_new", "n_never")
    intervals = intervals.join(fresh, ["source_id", "frame"], "left").withColumn("model", F.lit(path)).withColumn("limited", F.lit(files.read_text(spark, f"{path}/limited") == "Yes")).persist()
    for name in flow.outputs:
        flows.OUTPUTS[name](scored, intervals, store)
    return scored, intervals


@flows.register(flows.OUTPUTS, "results")
def _results(scored: DataFrame, intervals: DataFrame, store: str) -> None:
    writers.upsert_results(intervals, f"{store}/results", ["source_id", "frame"])


@flows.register(flows.OUTPUTS, "xml")
def _xml(scored: DataFrame, intervals: DataFrame, store: str) -> None:
    writers.result_xml(scored, intervals.select("source_id", "frame", "anomaly", "n_ids"), f"{store}/xml")


def mask(spark: SparkSession, path: str, out: str, names: dict[str, str], host: str = "system") -> None:
    """Log files with addresses, hosts and the given names masked, as text in the order of their lines."""
    raw = readers.log_files(spark, path)
    masked: Column = lines.masked_line(F.col("line"), F.regexp_extract("line", HOST, 1), names, host)
    raw.select("file", "line_no", masked.alias("value")).repartition("file").sortWithinPartitions("file", "line_no").select("value").write.mode("overwrite").text(out)


def results(spark: SparkSession, store: str, source: str | None = None, day: str | None = None) -> DataFrame:
    """Stored results of a source and day."""
    df = spark.read.parquet(f"{store}/results")
    df = df.where(F.col("source_id") == plain_id(F.lit(source))) if source else df
    return df.where(F.date_format(F.timestamp_millis("frame"), "yyyy-MM-dd") == day) if day else df
