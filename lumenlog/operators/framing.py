"""Time frames: runs, tumbling and sliding frames, dense grids, roll-ups, periods and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenlog.sources.tables import fresh

HOUR = 3_600_000


def frame_start(ms: Column, length: int, offset: int = 0) -> Column:
    """Start of the tumbling frame that an instant lies in; frames are aligned to the epoch plus an offset."""
    return ms - F.pmod(ms - offset, F.lit(length))


def previous(df: DataFrame, keys: list[str], at: str, block: int = 86_400_000, strict: bool = False) -> DataFrame:
    """``df`` with ``previous``: the place in time of the key's row before (``strict``: the greatest one below), null for the first.

    A key's rows are windowed per block of time; what comes before a block is carried by one row per block that has any, so no task
    sorts all rows of a key."""
    blk, last = fresh(df, "block"), fresh(df, "last")
    rows = df.withColumn(blk, F.floor(F.col(at) / block))
    ends = rows.groupBy(*keys, blk).agg(F.max(at).alias(last))
    carried = ends.withColumn(last, F.lag(last).over(W.partitionBy(*keys).orderBy(blk)))
    inside = W.partitionBy(*keys, blk).orderBy(at)
    before = F.max(at).over(inside.rangeBetween(W.unboundedPreceding, -1)) if strict else F.lag(at).over(inside)
    return rows.withColumn("previous", before).join(carried, [*keys, blk], "left").withColumn("previous", F.coalesce("previous", last)).drop(blk, last)


def lagged(df: DataFrame, keys: list[str], at: str, column: str, out: str, block: int = 86_400_000) -> DataFrame:
    """``df`` with ``out``: ``column`` of the key's row before in order of ``at``, null for the first; in blocks of time, as ``previous``."""
    blk, last = fresh(df, "block"), fresh(df, "last")
    value = F.struct(F.col(column).alias("v"))
    rows = df.withColumn(blk, F.floor(F.col(at) / block))
    ends = rows.groupBy(*keys, blk).agg(F.max_by(value, at).alias(last))
    carried = ends.withColumn(last, F.lag(last).over(W.partitionBy(*keys).orderBy(blk)))
    got = rows.withColumn(out, F.lag(value).over(W.partitionBy(*keys, blk).orderBy(at))).join(carried, [*keys, blk], "left")
    return got.withColumn(out, F.coalesce(out, last).getField("v")).drop(blk, last)


def runs(df: DataFrame, keys: list[str], at: str, gap: int, block: int = 86_400_000, starts: Column | None = None) -> DataFrame:
    """``df`` with ``run``: a new run of a key begins where more than ``gap`` passed since the row before, or at a row for which ``starts`` holds (a logger's
    restart, another file); numbered from 1, in blocks of time."""
    blk, begins, ahead = fresh(df, "block"), fresh(df, "begins"), fresh(df, "ahead")
    rows = previous(df, keys, at, block).withColumn(begins, F.when((F.col(at) - F.col("previous") <= gap) & ~(F.lit(False) if starts is None else F.coalesce(starts, F.lit(False))), 0).otherwise(1)).drop("previous").withColumn(blk, F.floor(F.col(at) / block))
    sums = rows.groupBy(*keys, blk).agg(F.sum(begins).alias(ahead))
    offsets = sums.withColumn(ahead, F.coalesce(F.sum(ahead).over(W.partitionBy(*keys).orderBy(blk).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = W.partitionBy(*keys, blk).orderBy(at).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("run", F.sum(begins).over(inside)).join(offsets, [*keys, blk]).withColumn("run", F.col("run") + F.col(ahead)).drop(blk, begins, ahead)


def dense_grid(df: DataFrame, keys: list[str], at: str, length: int) -> DataFrame:
    """(keys, frame): every frame between a key's first and last row, empty ones included.

    The grid follows from one row per key (its ends), so its cost is keys times frames."""
    ends = df.groupBy(*keys).agg(F.min(frame_start(F.col(at), length)).alias("low"), F.max(frame_start(F.col(at), length)).alias("high"))
    return ends.select(*keys, F.explode(F.sequence("low", "high", F.lit(length).cast("long"))).alias("frame"))


def tumbling(df: DataFrame, keys: list[str], at: str, length: int, *aggregates: Column) -> DataFrame:
    """Aggregates per key and frame over the dense grid; empty frames have nulls."""
    have = df.groupBy(*keys, frame_start(F.col(at), length).alias("frame")).agg(*aggregates)
    return dense_grid(df, keys, at, length).join(have, [*keys, "frame"], "left")


def sliding(df: DataFrame, keys: list[str], at: str, length: int, step: int, *sums: str) -> DataFrame:
    """Full windows of ``length`` every ``step`` within a key's span, with the sums of the columns.

    Rows are first summed per fragment of ``step``; a window is a frame over its fragments, so no row is copied."""
    fragments = tumbling(df, keys, at, step, *[F.sum(c).alias(c) for c in sums])
    n = length // step
    w = W.partitionBy(*keys).orderBy("frame").rowsBetween(-(n - 1), 0)
    return (
        fragments.select(*keys, (F.col("frame") - (length - step)).alias("start"), F.count(F.lit(1)).over(w).alias("fragments"), *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(c) for c in sums])
        .where(f"fragments = {n}")
        .drop("fragments")
    )


def coverage(df: DataFrame, keys: list[str], at: str, length: int) -> DataFrame:
    """(keys, frame, coverage): the first frame of a key lacks what is before its first row, the last what is after its last one."""
    ends = df.groupBy(*keys).agg(F.min(at).alias("first_ms"), F.max(at).alias("last_ms"))
    grid = dense_grid(df, keys, at, length).join(ends, keys)
    front = F.when(F.col("first_ms") > F.col("frame"), F.col("first_ms") - F.col("frame")).otherwise(0)
    tail = F.when(F.col("last_ms") + 1 < F.col("frame") + length, F.col("frame") + length - F.col("last_ms") - 1).otherwise(0)
    return grid.select(*keys, "frame", ((F.lit(length) - front - tail) / length).alias("coverage"))


def serial_in_period(ms: Column, length: int, unit: str = "day") -> tuple[Column, Column]:
    """(start of the calendar period in ms, number of the frame in it), in UTC."""
    start = F.unix_millis(F.date_trunc(unit, F.timestamp_millis(ms)))
    return start, F.floor((ms - start) / length)


def roll_up(df: DataFrame, keys: list[str], serial: str, factor: int, *aggregates: Column) -> DataFrame:
    """Finer summaries merged into coarser ones: ``factor`` serial numbers become one."""
    return df.groupBy(*keys, F.floor(F.col(serial) / factor).alias(serial)).agg(*aggregates)
