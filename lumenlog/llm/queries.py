"""Queries pN_... of the operators for training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.functions.ids import plain_id
from lumenlog.llm.bpe import decode, encode, token_counts
from lumenlog.llm.neardup import groups, similar_records
from lumenlog.llm.packing import pack
from lumenlog.llm.pii import find_mentions, redact
from lumenlog.llm.residue import judged
from lumenlog.llm.runs import collapse_runs
from lumenlog.llm.sql import SQL
from lumenlog.sources.tables import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of the same message id in the lines of a source, and of nearly the same number of occurrences over intervals."""
    m = table(spark, folder, "messages").select(plain_id("source_id").alias("source_id"), plain_id("message_id").alias("message_id"), "line_no", "instance_id", "cnt", "ts")
    lines = collapse_runs(m, ["source_id"], "line_no", F.col("message_id"), F.lit(0.0), F.col("cnt"), F.expr("unix_micros(ts)"), "instance_id")
    i = table(spark, folder, "interval_messages").select(plain_id("source_id").alias("source_id"), plain_id("message_id").alias("message_id"), "interval_serial", "num_occurrences", "stored_at")
    # A change of at most 1 costs less than a boundary, of 2 or more it costs more.
    steady = collapse_runs(i, ["source_id", "message_id"], "interval_serial", F.lit(""), F.col("num_occurrences"), F.col("num_occurrences"), F.lit(0), "stored_at", penalty=1.5, least=3)
    columns = ["record_kind", "source_id", "message_id", "first_pos", "last_pos", "n_events", "span_ms"]
    a = lines.select(F.lit("messages").alias("record_kind"), "source_id", F.col("label").alias("message_id"), "first_pos", "last_pos", "n_events", F.expr("floor(to_us / 1000) - floor(from_us / 1000)").alias("span_ms"))
    b = steady.select(F.lit("interval_messages").alias("record_kind"), "source_id", "message_id", "first_pos", "last_pos", "n_events", F.expr("(last_pos - first_pos + 1) * 600000").alias("span_ms"))
    return a.select(columns).unionByName(b.select(columns))


def p2_steady(spark: SparkSession, folder: str) -> DataFrame:
    """Intervals over which the number of occurrences of a message id stays about the same: neighbours and the deviations from the run's median count."""
    i = table(spark, folder, "interval_messages").select(plain_id("source_id").alias("source_id"), plain_id("message_id").alias("message_id"), "interval_serial", "num_occurrences", "stored_at")
    got = collapse_runs(i, ["source_id", "message_id"], "interval_serial", F.lit(""), F.col("num_occurrences"), F.col("num_occurrences"), F.lit(0), "stored_at", penalty=3.0, least=2, spread=0.5)
    return got.select("source_id", "message_id", "first_pos", "last_pos", "n_rows", "n_events")


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    fatal = table(spark, folder, "messages").where("severity = 4").select(F.lit("messages").alias("record_kind"), F.col("instance_id").alias("id"), "text")
    return fatal.unionByName(table(spark, folder, "message_summaries").select(F.lit("message_summaries").alias("record_kind"), F.col("summary_id").alias("id"), F.col("text_summary").alias("text")))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of similar fatal messages, and of similar summaries."""
    return similar_records(_texts(spark, folder), "record_kind", "id", "text", 0.7).withColumnRenamed("kind", "record_kind")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every document by byte_bpe_50k."""
    return encode(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "ids")


def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    """The class, the number of links and the group of every text."""
    return groups(_texts(spark, folder), "record_kind", "id", "text", 0.7).withColumnRenamed("kind", "record_kind").withColumnRenamed("group", "group_id").withColumnRenamed("class", "class_id")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Mentions of personal information in message texts."""
    return find_mentions(table(spark, folder, "messages"), "instance_id", "text", table(spark, folder, "given_names")).select("instance_id", "kind", "start_pos")


def p5_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Message texts with each mention replaced by its kind."""
    return redact(table(spark, folder, "messages").select("instance_id", "text"), "text", table(spark, folder, "given_names")).select("instance_id", "redacted")


def p8_decoded(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's text, put together from its ids: the exact round trip."""
    ids = encode(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "ids")
    return decode(ids).select("doc_id", "text")


def p9_containers(spark: SparkSession, folder: str) -> DataFrame:
    """The container of every document, or of every piece of one longer than a container: 2,048 tokens of byte_bpe_50k."""
    sizes = token_counts(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "tokens")
    return pack(sizes, "doc_id", "tokens", 2048).select("container", "doc_id", "piece", F.col("size").alias("tokens"))


def p9_checked(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the containers of all documents: every document is placed, no container is over-full, no piece comes twice."""
    placed = p9_containers(spark, folder)
    over = placed.groupBy("container").agg(F.sum("tokens").alias("load")).where("load > 2048").agg(F.count(F.lit(1)).alias("n"))
    pieces = placed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"), F.max("piece").alias("last"), F.count_distinct("piece").alias("d"))
    return pieces.agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.expr("k <> d or k <> last + 1")).alias("wrong")).withColumn("over_full", over.scalar())


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that are template residue, filler, error pages or script notices."""
    return judged(table(spark, folder, "documents"), "doc_id", "text").where("residue").select("doc_id")


def p10_kept(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that are not excluded, with the share of residue in them."""
    return judged(table(spark, folder, "documents"), "doc_id", "text").where("not residue").select("doc_id", F.round("coverage", 6).alias("coverage"))


QUERIES = {"p2_found": p2_found, "p2_steady": p2_steady, "p4_found": p4_found, "p4_groups": p4_groups, "p5_found": p5_found, "p5_redacted": p5_redacted, "p8_ids": p8_ids, "p8_decoded": p8_decoded, "p9_containers": p9_containers, "p9_checked": p9_checked, "p10_found": p10_found, "p10_kept": p10_kept}
