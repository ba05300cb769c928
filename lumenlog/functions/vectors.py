"""Arrays of numbers as vectors: sums, products, distances, correlation and places in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _pairs(a: Column, b: Column) -> Column:
    """Pairs of elements of which neither is null or NaN."""
    both = F.zip_with(a, b, lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")))
    return F.filter(both, lambda p: p["x"].isNotNull() & p["y"].isNotNull() & ~F.isnan(p["x"]) & ~F.isnan(p["y"]))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.transform(_pairs(a, b), lambda p: p["x"] * p["y"]))


def plus(a: Column, b: Column, factor: float = 1.0) -> Column:
    """a + factor * b, element by element."""
    return F.zip_with(a, b, lambda x, y: x + y * factor)


def times(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def scaled(a: Column, factor: float) -> Column:
    return F.transform(a, lambda x: x * factor)


def l1(a: Column, b: Column) -> Column:
    return _sum(F.transform(_pairs(a, b), lambda p: F.abs(p["x"] - p["y"])))


def l2_squared(a: Column, b: Column) -> Column:
    return _sum(F.transform(_pairs(a, b), lambda p: (p["x"] - p["y"]) * (p["x"] - p["y"])))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(l2_squared(a, b))


def hamming(a: Column, b: Column) -> Column:
    """Number of places at which the elements differ; nulls are equal to each other, missing places differ."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), lambda same: ~same))


def pearson(a: Column, b: Column) -> Column:
    """Correlation over the places where both have a number; null where one of them doesn't vary."""

    def over(p: Column) -> Column:
        n = F.size(p).cast("double")
        x, y = _sum(F.transform(p, lambda e: e["x"])), _sum(F.transform(p, lambda e: e["y"]))
        xx, yy, xy = (_sum(F.transform(p, f)) for f in (lambda e: e["x"] * e["x"], lambda e: e["y"] * e["y"], lambda e: e["x"] * e["y"]))
        below = (n * xx - x * x) * (n * yy - y * y)
        return F.when(below > 0, (n * xy - x * y) / F.sqrt(below))

    return F.get(F.transform(F.array(_pairs(a, b)), over), F.lit(0))


def scaled_pearson(a: Column, b: Column) -> Column:
    """Correlation as a distance between 0 (the same) and 1 (opposed)."""
    return (1 - pearson(a, b)) / 2


def order_of(values: Column) -> Column:
    """Places (from 0) of the numbers in ascending order, of equal ones the first first; nulls and NaN are left out."""
    placed = F.filter(F.transform(values, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda p: p["x"].isNotNull() & ~F.isnan(p["x"].cast("double")))
    return F.transform(F.array_sort(placed), lambda p: p["i"])


def kth(values: Column, k: int) -> Column:
    """The k-th smallest number, from 1; null where there are fewer."""
    return F.get(F.array_sort(F.filter(values, lambda x: x.isNotNull())), F.lit(k - 1))


def sorted_by_key(entries: Column, descending: bool = False, by_value: bool = False) -> Column:
    """An array of (key, value) structs sorted by key; of equal keys by value where asked, else as they stood."""
    numbered = F.transform(entries, lambda e, i: F.struct(e.alias("e"), i.alias("i")))

    def compare(a: Column, b: Column) -> Column:
        x, y = (b["e"]["key"], a["e"]["key"]) if descending else (a["e"]["key"], b["e"]["key"])
        tie = [(a["e"]["value"], b["e"]["value"])] if by_value else []
        got = F.when(x < y, -1).when(x > y, 1)
        for p, q in [*tie, (a["i"], b["i"])]:
            got = got.when(p < q, -1).when(p > q, 1)
        return got.otherwise(0)

    return F.transform(F.array_sort(numbered, compare), lambda p: p["e"])


def matrix_product(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, j, v) of the product of two matrices in long form; absent cells are 0."""
    left, right = a.select("i", F.col("j").alias("k"), F.col("v").alias("x")), b.select(F.col("i").alias("k"), "j", F.col("v").alias("y"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def transposed(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def row_sums(a: DataFrame) -> DataFrame:
    return a.groupBy("i").agg(F.sum("v").alias("v"))


def column_sums(a: DataFrame) -> DataFrame:
    return a.groupBy("j").agg(F.sum("v").alias("v"))


def asymmetric_cells(a: DataFrame) -> DataFrame:
    """Cells (i, j, v, w) whose mirror image w is another value; none for a symmetric matrix."""
    b = transposed(a).withColumnRenamed("v", "w")
    return a.join(b, ["i", "j"], "full").where(~F.coalesce("v", F.lit(0.0)).eqNullSafe(F.coalesce("w", F.lit(0.0))))


def not_dominant(a: DataFrame) -> DataFrame:
    """Rows (i) whose diagonal cell is not the largest of the row in absolute value."""
    off = a.groupBy("i").agg(F.max(F.when(F.col("i") == F.col("j"), F.abs("v"))).alias("own"), F.max(F.when(F.col("i") != F.col("j"), F.abs("v"))).alias("other"))
    return off.where(F.coalesce("own", F.lit(0.0)) < F.coalesce("other", F.lit(0.0))).select("i")
