"""Readers: log files, multi-log streams, groups, word lists, intervals and results."""

from __future__ import annotations

import json
from collections.abc import Iterable
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenlog.operators.loglines import _head
from lumenlog.sources import files


def log_files(spark: SparkSession, path: str, only_gzip: bool = False) -> DataFrame:
    """(line, file, line_no) of text files; gzip is opened by its suffix.

    Large files are read in splits: lines are numbered within their split, plus the lines of the splits before."""
    reader = spark.read
    if only_gzip:
        reader = reader.option("pathGlobFilter", "*.gz")
    lines = reader.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
    counts = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("file", "block", F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return lines.withColumn("k", F.row_number().over(W.partitionBy("file", "block").orderBy("place"))).join(offsets, ["file", "block"]).select("line", "file", (F.col("before") + F.col("k")).cast("long").alias("line_no"))


def spooled(spark: SparkSession, lines: Iterable[str], folder: str, batch: int = 10_000) -> int:
    """Lines of a pipe (as sys.stdin) written into a folder in numbered files, each complete as soon as it is seen, for ``line_stream``; the number of files."""
    made, rest = 0, iter(lines)
    while part := list(islice(rest, batch)):
        files.write_text(spark, f"{folder}/part-{made:09d}.log", "".join(line.rstrip("\n") + "\n" for line in part))
        made += 1
    return made


def line_stream(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """A stream of (line, file) from files that appear in a folder."""
    return spark.readStream.format("text").option("maxFilesPerTrigger", per_trigger).load(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"))


def demultiplexed(df: DataFrame, known: list[str] | None = None, block: int = 8192) -> DataFrame:
    """Lines (file, line_no, line) of a followed set of logs with the ``log`` each belongs to: '==> name <==' switches; header lines, the blank line before one, and
    unknown logs are dropped. Files are taken by blocks of lines; what holds at a block's end is carried on, what follows it is the next block's first line."""
    name = F.nullif(F.regexp_extract("line", r"^==> (.*) <==$", 1), F.lit(""))
    rows = df.withColumn("own", name).withColumn("blk", F.floor(F.col("line_no") / block))
    ends = rows.groupBy("file", "blk").agg(F.max_by("own", F.when(F.col("own").isNotNull(), F.col("line_no"))).alias("last"), F.min_by(F.struct("own"), "line_no").alias("first"))
    by = W.partitionBy("file").orderBy("blk")
    carried = ends.select("file", "blk", F.last("last", ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, -1)).alias("before"), F.lead("first").over(by).getField("own").alias("after"))
    w = W.partitionBy("file", "blk").orderBy("line_no")
    marked = rows.join(carried, ["file", "blk"]).withColumn("log", F.coalesce(F.last("own", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)), "before"))
    marked = marked.withColumn("next", F.when(F.lead("line_no").over(w).isNull(), F.col("after")).otherwise(F.lead("own").over(w)))
    kept = marked.where("own is null and log is not null and not (line = '' and next is not null)").drop("own", "next", "blk", "before", "after")
    return kept.where(F.col("log").isin(known)) if known else kept


def heads(df: DataFrame, text: str = "line") -> DataFrame:
    """``df`` with ``head``: stamp, severity, component and message of each line that is an entry's head, for streams too."""
    return df.withColumn("head", _head(F.col(text)))


def groups(path: str) -> tuple[list[dict[str, object]], list[dict[str, object]]]:
    """Analysis groups and rules of a JSON file, validated: names unique without case, evaluation orders consecutive from 1, each rule used, each group's rule there."""
    data = json.loads(files.read_text(SparkSession.active(), path))
    found = [g for kind in data["groups"].values() for g in kind]
    rules = data["rules"]
    names = [g["name"].lower() for g in found]
    if len(set(names)) != len(names) or "unassigned" in names:
        raise ValueError("group names must be unique and not reserved")
    if sorted(int(g["evaluationOrder"]) for g in found) != list(range(1, len(found) + 1)):
        raise ValueError("evaluation orders must be consecutive from 1")
    if {g["ruleName"] for g in found} != {r["name"] for r in rules}:
        raise ValueError("every group needs its rule, and every rule a group")
    return found, rules


def word_list(path: str) -> list[str]:
    """Lower-case words, one a line; '#' begins a comment; several words in a line are an error."""
    words = []
    for line in files.read_text(SparkSession.active(), path).splitlines():
        parts = line.split("#")[0].split()
        if len(parts) > 1:
            raise ValueError(f"several words in a line: {line!r}")
        words += [p.lower() for p in parts]
    return words


def intervals(spark: SparkSession, path: str, source: str | None = None, low: str | None = None, high: str | None = None) -> DataFrame:
    """Stored interval summaries; source and period are partitions, so only those asked for are read."""
    df = spark.read.parquet(path)
    for condition, value in (("source_id = '{}'", source), ("period >= '{}'", low), ("period <= '{}'", high)):
        if value is not None:
            df = df.where(condition.format(value))
    return df


def results_xml(spark: SparkSession, path: str) -> DataFrame:
    """Analysed intervals of XML files."""
    return spark.read.format("xml").option("rowTag", "interval").load(path)


def matrix(spark: SparkSession, path: str) -> DataFrame:
    """(i, j, v) of a text file of numbers separated by white space, a row a line; numbered from 0. Commas and '#' comments are allowed."""
    lines = log_files(spark, path).select((F.col("line_no") - 1).alias("i"), F.filter(F.split(F.regexp_replace("line", "#.*$", ""), r"[\s,]+"), lambda x: x != "").alias("p")).where(F.size("p") > 0)
    return lines.select("i", F.posexplode("p").alias("j", "v")).select("i", "j", F.col("v").cast("double").alias("v"))


def new_clusters(spark: SparkSession, path: str, component: str, last: int) -> DataFrame:
    """Text clusters of a component that are newer than the last one known."""
    return spark.read.parquet(path).where((F.col("component") == component) & (F.col("number") > last))
