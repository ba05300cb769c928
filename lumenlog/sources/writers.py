"""Writers: idempotent interval uploads, upserts, XML results, table exports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.operators.relational import upsert
from lumenlog.sources import files


def upload_intervals(df: DataFrame, path: str) -> None:
    """Interval summaries by source and period; a period written again replaces itself, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_id", "period").parquet(path)


def upsert_results(df: DataFrame, path: str, keys: list[str]) -> None:
    """Stored results with those of the same keys replaced, written beside the old ones and then put in their place."""
    spark = df.sparkSession
    if not files.exists(spark, path):
        df.write.parquet(path)
        return
    merged = upsert(spark.read.parquet(path), df, keys)
    merged.write.mode("overwrite").parquet(f"{path}.next")
    files.replace(spark, f"{path}.next", path)


def write_state(spark: SparkSession, state: dict[str, object], path: str) -> None:
    """Small state of a source (numbers, texts, lists) with its version, for the next run."""
    files.write_text(spark, path, json.dumps({"version": 1, "state": state}))


def read_state(spark: SparkSession, path: str) -> dict[str, object]:
    """State written before; empty where there is none, an error where it is of another version."""
    if not files.exists(spark, path):
        return {}
    got = json.loads(files.read_text(spark, path))
    if got["version"] != 1:
        raise ValueError(f"state of version {got['version']}")
    return got["state"]


def interval_path(source: Column, ms: Column, serial: Column) -> Column:
    """Where the result of an interval is written: source, day and number."""
    return F.concat_ws("/", source, F.date_format(F.timestamp_millis(ms), "yyyyMMdd"), F.lit("intervals"), F.concat(F.lit("interval_"), serial.cast("string"), F.lit(".xml")))


def result_rows(messages: DataFrame, intervals: DataFrame) -> DataFrame:
    """One nested row per interval: its attributes and its messages by anomaly, then score (highest first), then id."""
    names = [c for c in ("n", "anomaly", "bernoulli_value", "bernoulli_frequency", "count_mean", "status", "periodicity", "severity", "critical", "sample") if c in messages.columns]
    entry = F.struct(-F.col("anomaly"), F.col("message_id").alias("_id"), *[F.col(c).alias(f"v_{c}") for c in names])
    nested = messages.groupBy("source_id", "frame").agg(F.array_sort(F.collect_list(entry)).alias("m"))
    rows = intervals.join(nested, ["source_id", "frame"], "left")
    made = F.transform("m", lambda x: F.struct(x["_id"].alias("_id"), *[x[f"v_{c}"].alias(c) for c in names]))
    return rows.select(*[F.col(c).alias(f"_{c}") for c in intervals.columns], made.alias("message"))


def result_xml(messages: DataFrame, intervals: DataFrame, path: str, compressed: bool = False) -> None:
    """``result_rows`` as XML, one element per interval, in folders by source and day."""
    rows = result_rows(messages, intervals).withColumn("source", F.col("_source_id")).withColumn("day", F.date_format(F.timestamp_millis(F.col("_frame")), "yyyyMMdd"))
    writer = rows.write.mode("overwrite").partitionBy("source", "day").format("xml").option("rowTag", "interval").option("rootTag", "intervals")
    (writer.option("compression", "gzip") if compressed else writer).save(path)


def stored_index(scores: DataFrame, stored: DataFrame, length: int, keys: list[str]) -> DataFrame:
    """``period_index`` of new scores over those stored before: a new score replaces the stored one."""
    return period_index(upsert(stored.select(*keys, "frame", "score"), scores.select(*keys, "frame", "score"), [*keys, "frame"]), length, keys)


def statistic_files(df: DataFrame, path: str, columns: list[str]) -> None:
    """One text file per statistic: its values in order, separated by commas, in parts of bounded size."""
    for c in columns:
        df.select(F.col(c).cast("string").alias("value")).where("value is not null").orderBy("value").write.mode("overwrite").csv(f"{path}/{c}")


def dump_model(tables: dict[str, DataFrame], path: str) -> None:
    """The tables of a model as text, nested columns as JSON."""
    for name, df in tables.items():
        flat = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes]
        df.select(*flat).write.mode("overwrite").option("header", True).csv(f"{path}/{name}")


def interval_xml(scored: DataFrame, path: str, compressed: bool = False) -> None:
    """One XML element per interval, its messages sorted by anomaly; partitions are sources."""
    message = F.struct(-F.col("anomaly"), F.col("message_id").alias("id"), F.col("anomaly"), F.col("n"))
    nested = scored.groupBy("source_id", "frame").agg(F.array_sort(F.collect_list(message)).alias("m"))
    rows = nested.select("source_id", F.col("frame").alias("start"), F.transform("m", lambda x: F.struct(x["id"].alias("_id"), x["anomaly"].alias("anomaly"), x["n"].alias("count"))).alias("message"))
    writer = rows.write.mode("overwrite").format("xml").option("rowTag", "interval").option("rootTag", "intervals")
    (writer.option("compression", "gzip") if compressed else writer).save(path)


def period_index(scores: DataFrame, length: int, keys: list[str]) -> DataFrame:
    """A dense list of snapshots per key and period day, with ``missing`` where no result is stored."""
    per = scores.withColumn("day", F.col("frame") - F.pmod("frame", F.lit(86_400_000)))
    grid = per.select(*keys, "day").distinct().select(*keys, "day", F.posexplode(F.sequence(F.col("day"), F.col("day") + 86_400_000 - length, F.lit(length).cast("long"))).alias("serial", "frame"))
    return grid.join(per.drop("day"), [*keys, "frame"], "left").withColumn("missing", F.col("score").isNull())


def export_tables(spark: SparkSession, names: list[str], path: str, columns: dict[str, list[str]] | None = None) -> None:
    """Tables as compressed CSV, whole or the given columns of them."""
    for name in names:
        df = spark.table(name)
        df.select(*(columns or {}).get(name, df.columns)).write.mode("overwrite").option("header", True).option("compression", "gzip").csv(f"{path}/{name}")


def error_report(df: DataFrame, kind: str, text: str, most: int = 3) -> DataFrame:
    """(kind, n, examples): counts by kind of error with the first examples; the examples are bounded per task before they meet."""
    slim = df.groupBy(kind, F.pmod(F.xxhash64(text), F.lit(256)).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min(text).alias("example"))
    return slim.groupBy(kind).agg(F.sum("n").alias("n"), F.slice(F.array_sort(F.collect_set("example")), 1, most).alias("examples"))
