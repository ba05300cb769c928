"""Places in a global order without one task that holds everything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenlog.sources.tables import fresh


def pieces_of(df: DataFrame, column: str, pieces: int = 256) -> DataFrame:
    """``df`` with ``piece``: the number of cuts not above the value. Cuts come from a bounded sample (the values with the least hashes), so pieces
    hold about equal shares of distinct values; results don't depend on where the cuts lie."""
    sample = df.select(column).distinct().orderBy(F.xxhash64(column), column).limit(pieces * 8).select(F.collect_list(column).alias("s"))
    values = F.array_sort("s")
    cuts = sample.select(F.transform(F.sequence(F.lit(1), F.lit(pieces - 1)), lambda i: F.get(values, F.floor(i * F.size("s") / pieces).cast("int"))).alias("cuts"))
    step = max(1, int(pieces**0.5))
    coarse = cuts.select("cuts", F.transform(F.sequence(F.lit(1), F.lit(pieces // step)), lambda i: F.get("cuts", i * step - 1)).alias("coarse"))
    both = coarse.select(F.struct(F.array_compact("cuts").alias("cuts"), F.array_compact("coarse").alias("coarse")).alias("c")).scalar()
    at, i = fresh(df, "cuts"), fresh(df, "coarse")
    # First among every step-th cut, then among the few after it.
    found = df.withColumn(at, both).withColumn(i, F.size(F.filter(F.col(at)["coarse"], lambda c: c <= F.col(column))) * step)
    near = F.slice(F.col(at)["cuts"], F.col(i) + 1, F.lit(step - 1 if step > 1 else 0))
    return found.withColumn("piece", F.col(i) + F.size(F.filter(near, lambda c: c <= F.col(column)))).drop(at, i)


def running_sum(df: DataFrame, column: str, amount: str, out: str, pieces: int = 256) -> DataFrame:
    """``df`` (one row per value of ``column``) with ``out``: the sum of ``amount`` up to and with the row in the order of the values.

    Windows run within pieces of the order; the pieces' sums are carried by one row per piece."""
    cut = pieces_of(df, column, pieces)
    sums = cut.groupBy("piece").agg(F.sum(amount).alias("ahead"))
    offsets = sums.select("piece", F.coalesce(F.sum("ahead").over(W.orderBy("piece").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    inside = F.sum(amount).over(W.partitionBy("piece").orderBy(column).rowsBetween(W.unboundedPreceding, 0))
    return cut.withColumn(out, inside).join(F.broadcast(offsets), "piece").withColumn(out, F.col(out) + F.col("ahead")).drop("piece", "ahead")
