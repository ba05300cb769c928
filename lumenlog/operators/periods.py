"""Calendar periods of sources, their metadata, and the intervals in them; runs of intervals; years of dates without one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenlog.operators.framing import lagged

DAY = 86_400_000


def period_start(ms: Column, unit: str) -> Column:
    """Start in ms of the calendar period (hour, day, week from Monday, month, year) in UTC."""
    return F.unix_millis(F.date_trunc(unit, F.timestamp_millis(ms)))


def shifted(start: Column, unit: str, by: int | Column) -> Column:
    """Start of the period ``by`` units later (earlier for a negative number)."""
    step = F.lit(by) if isinstance(by, int) else by
    at = F.timestamp_millis(start)
    moved = {"hour": lambda: F.timestamp_add("HOUR", step, at), "day": lambda: F.timestamp_add("DAY", step, at), "week": lambda: F.timestamp_add("WEEK", step, at), "month": lambda: F.timestamp_add("MONTH", step, at), "year": lambda: F.timestamp_add("YEAR", step, at)}
    return F.unix_millis(moved[unit]())


def period_range(df: DataFrame, low: str, high: str, unit: str) -> DataFrame:
    """``df`` with ``period``: every period from that of ``low`` to that of ``high``, one row each."""
    interval = F.expr(f"interval 1 {unit}")
    starts = F.sequence(F.date_trunc(unit, F.timestamp_millis(F.col(low))), F.date_trunc(unit, F.timestamp_millis(F.col(high))), interval)
    return df.withColumn("period", F.explode(F.transform(starts, F.unix_millis)))


def periods_between(low: Column, high: Column, unit: str) -> Column:
    """Number of periods from that of one instant to that of another."""
    return F.timestamp_diff(unit.upper(), F.date_trunc(unit, F.timestamp_millis(low)), F.date_trunc(unit, F.timestamp_millis(high)))


def within(periods: DataFrame, low: int, high: int) -> DataFrame:
    """Periods (start, end) that lie wholly in [low, high]."""
    return periods.where((F.col("start") >= low) & (F.col("end") <= high))


def for_training(periods: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Periods that are not excluded from training, by their own flag ``exclude`` or a list of (source_id, start)."""
    kept = periods.where(~F.coalesce("exclude", F.lit(False)))
    return kept if excluded is None else kept.join(excluded.select("source_id", "start"), ["source_id", "start"], "left_anti")


def with_metadata(periods: DataFrame, changes: DataFrame) -> DataFrame:
    """Periods with the changed ones' exclude, status and comment (null: unchanged) taken from ``changes`` by (source_id, start)."""
    names = ["exclude", "status", "comment"]
    new = changes.select("source_id", "start", *[F.col(c).alias(f"new_{c}") for c in names])
    joined = periods.join(new, ["source_id", "start"], "left")
    return joined.select(*[F.coalesce(f"new_{c}", c).alias(c) if c in names else F.col(c) for c in periods.columns])


def time_span(summaries: DataFrame, length: int) -> DataFrame:
    """One row (start, end): the span of all training intervals."""
    return summaries.agg(F.min("frame").alias("start"), (F.max("frame") + length).alias("end"))


def located(df: DataFrame, ms: str, unit: str, length: int) -> DataFrame:
    """``df`` with period, serial and interval_start: where an instant lies. ``length`` must divide the shortest period of the unit."""
    shortest = {"hour": 3_600_000, "day": DAY, "week": 7 * DAY, "month": DAY, "year": DAY}[unit]
    if shortest % length:
        raise ValueError(f"{length} ms do not divide a period of one {unit}")
    start = period_start(F.col(ms), unit)
    serial = F.floor((F.col(ms) - start) / length)
    return df.withColumn("period", start).withColumn("serial", serial).withColumn("interval_start", start + serial * length)


def in_order(intervals: DataFrame, keys: list[str], serial: str = "serial") -> DataFrame:
    """Intervals sorted by serial number within partitions of ``keys``; a serial number that comes twice fails the query."""
    k = F.count(F.lit(1)).over(W.partitionBy(*keys, serial))
    checked = intervals.withColumn("twice", F.when(k > 1, F.raise_error(F.concat(F.lit("interval twice: "), F.col(serial).cast("string")))).otherwise(F.lit(None).cast("string")))
    return checked.where(F.col("twice").isNull()).drop("twice").repartition(*keys).sortWithinPartitions(*keys, serial)


def stored_runs(intervals: DataFrame, length: int, file: str | None = None) -> DataFrame:
    """``intervals`` (source_id, frame) with ``run``: a new one begins where the interval before is missing, or comes from another file that jumps more than two
    frames forward or more than one back."""
    rows = intervals.withColumn("at", F.struct(F.col("frame").alias("frame"), (F.col(file) if file else F.lit(None).cast("string")).alias("file")))
    rows = lagged(rows, ["source_id"], "frame", "at", "before", block=30 * DAY)
    step = F.col("frame") - F.col("before.frame")
    other = ~F.col("before.file").eqNullSafe(F.col("at.file"))
    begins = F.when(F.col("before").isNull() | F.when(other, (step > 2 * length) | (step < -length)).otherwise(step != length), 1).otherwise(0)
    blk = F.floor(F.col("frame") / (30 * DAY))
    marked = rows.withColumn("begins", begins).withColumn("blk", blk)
    sums = marked.groupBy("source_id", "blk").agg(F.sum("begins").alias("ahead"))
    ahead = sums.withColumn("ahead", F.coalesce(F.sum("ahead").over(W.partitionBy("source_id").orderBy("blk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = F.sum("begins").over(W.partitionBy("source_id", "blk").orderBy("frame").rowsBetween(W.unboundedPreceding, 0))
    return marked.withColumn("run", inside).join(ahead, ["source_id", "blk"]).withColumn("run", F.col("run") + F.col("ahead")).drop("at", "before", "begins", "blk", "ahead")


def realigned(df: DataFrame, start: str, end: str, coverage: str, length: int) -> DataFrame:
    """Intervals moved to the frame of ``length`` that they begin in; their coverage is that of the whole frame."""
    low = F.col(start) - F.pmod(F.col(start), F.lit(length))
    return df.withColumn(coverage, F.col(coverage) * (F.col(end) - F.col(start)) / length).withColumn(start, low).withColumn(end, low + length)


def folded_coverage(values: Column) -> Column:
    """Coverage of intervals joined one after the other: the mean of what came before and the next, so the last counts most."""
    return F.aggregate(F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0))), F.get(values, F.lit(0)).cast("double"), lambda a, x: (a + x) / 2)


def fragments(df: DataFrame, keys: list[str], at: str, length: int, step: int, *sums: str) -> DataFrame:
    """Full windows of ``length`` after every fragment of ``step``, with ``kind``: REGULAR where the window is a whole frame, else CONTINUOUS (an early result)."""
    from lumenlog.operators.framing import sliding

    got = sliding(df, keys, at, length, step, *sums)
    return got.withColumn("kind", F.when(F.pmod(F.col("start"), F.lit(length)) == 0, "REGULAR").otherwise("CONTINUOUS"))


def rolled_years(df: DataFrame, keys: list[str], place: str, day_of_year: Column, first_year: int) -> DataFrame:
    """``df`` with ``year`` of dates that have none, in the order in which they stand: the year of the first is given; a date more than half a year before
    the one ahead of it lies in the next year, one more than half a year after it in the year before.

    Lines of a key are taken by blocks of ``place``, with the number of new years carried over."""
    rows = df.withColumn("doy", day_of_year).withColumn("blk", F.floor(F.col(place) / 8192))
    rows = lagged(rows, keys, place, "doy", "last", block=8192).withColumn("bump", F.when(F.col("last") - F.col("doy") > 180, 1).when(F.col("doy") - F.col("last") > 180, -1).otherwise(0))
    sums = rows.groupBy(*keys, "blk").agg(F.sum("bump").alias("ahead"))
    ahead = sums.withColumn("ahead", F.coalesce(F.sum("ahead").over(W.partitionBy(*keys).orderBy("blk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = F.sum("bump").over(W.partitionBy(*keys, "blk").orderBy(place).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("year", inside).join(ahead, [*keys, "blk"]).withColumn("year", (F.col("year") + F.col("ahead") + first_year).cast("int")).drop("doy", "blk", "last", "bump", "ahead")
