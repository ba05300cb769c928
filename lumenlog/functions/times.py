"""Dates and durations as people write them; days and zones of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY = 86_400_000


def offset_text(minutes: Column) -> Column:
    """An offset from UTC in minutes as +hh:mm or -hh:mm."""
    size = F.abs(minutes)
    return F.concat(F.when(minutes < 0, "-").otherwise("+"), F.lpad(F.floor(size / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((size % 60).cast("string"), 2, "0"))


def source_offsets(df: DataFrame, minutes: str, at: str, source: str = "source_id") -> DataFrame:
    """(source, offset): the latest offset seen of each source, as text."""
    return df.where(F.col(minutes).isNotNull()).groupBy(source).agg(offset_text(F.max_by(minutes, at)).alias("offset"))


def day_start(ms: Column, zone: str = "UTC") -> Column:
    """First millisecond of the instant's day in a zone."""
    local = F.from_utc_timestamp(F.timestamp_millis(ms), zone)
    return F.unix_millis(F.to_utc_timestamp(F.date_trunc("day", local), zone))


def day_end(ms: Column, zone: str = "UTC") -> Column:
    """Last millisecond of the instant's day in a zone."""
    local = F.from_utc_timestamp(F.timestamp_millis(ms), zone)
    return F.unix_millis(F.to_utc_timestamp(F.timestamp_add("DAY", F.lit(1), F.date_trunc("day", local)), zone)) - 1


def days_later(ms: Column, days: int, zone: str = "UTC") -> Column:
    """The same clock time in a zone so many days later (earlier for a negative number)."""
    local = F.from_utc_timestamp(F.timestamp_millis(ms), zone)
    return F.unix_millis(F.to_utc_timestamp(F.timestamp_add("DAY", F.lit(days), local), zone))


def shown(ms: Column, pattern: str = "yyyy-MM-dd HH:mm:ss", zone: str = "UTC") -> Column:
    return F.date_format(F.from_utc_timestamp(F.timestamp_millis(ms), zone), pattern)


def duration_ms(text: Column) -> Column:
    """Milliseconds of a duration as P1W, P2DT3H4M5.6S and the like (days of 24 hours); null for another text."""
    pattern = r"\A-?P(?=.)(?:(\d+)W)?(?:(\d+)D)?(?:T(?=.)(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?\z"
    part = lambda i, unit: F.coalesce(F.nullif(F.regexp_extract(text, pattern, i), F.lit("")).cast("double"), F.lit(0.0)) * unit
    total = part(1, 7 * DAY) + part(2, DAY) + part(3, 3_600_000) + part(4, 60_000) + part(5, 1000)
    return F.when(text.rlike(pattern), F.round(F.when(text.startswith("-"), -total).otherwise(total)).cast("long"))


def duration_text(ms: Column) -> Column:
    """Milliseconds as '2 days 3 h 4 min 5.006 s', without the parts that are 0; '0 s' for none."""
    size = F.abs(ms)
    days, hours, minutes = F.floor(size / DAY), F.floor(size % DAY / 3_600_000), F.floor(size % 3_600_000 / 60_000)
    rest = size % 60_000
    seconds = F.when(rest % 1000 == 0, F.floor(rest / 1000).cast("string")).otherwise(F.format_string("%d.%03d", F.floor(rest / 1000), rest % 1000))
    parts = F.concat_ws(" ", F.when(days > 0, F.concat(days, F.lit(" days"))), F.when(hours > 0, F.concat(hours, F.lit(" h"))), F.when(minutes > 0, F.concat(minutes, F.lit(" min"))), F.when(rest > 0, F.concat(seconds, F.lit(" s"))))
    return F.concat(F.when(ms < 0, "-").otherwise(""), F.when(size == 0, "0 s").otherwise(parts))


def known_zone(zone: Column, zones: list[str] | None = None) -> Column:
    """Whether a text names a time zone of the data base (without case), or an offset."""
    import zoneinfo

    names = [z.lower() for z in (zones or sorted(zoneinfo.available_timezones()))]
    return F.coalesce(F.lower(zone).isin(names) | zone.rlike(r"\A(?:UTC|GMT)?[+-]\d\d?(?::?\d\d)?\z"), F.lit(False))


def numbers_of(text: Column) -> Column:
    """The whole numbers of a text like [1, 2]; an empty array for [] and null for null."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"-?\d+"), F.lit(0)), lambda x: x.cast("long"))


def numbers_text(values: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(values.cast("array<string>"), ", "), F.lit("]"))
