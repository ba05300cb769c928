"""Dates in mixed notations and zones to one UTC instant.

Every notation is one branch of a single anchored alternation with named groups. One regex replacement per
row (in the JVM) extracts all components at once: the groups of a component are written one after the
other, and only the branch that matched gives text. Columns of components then go in Arrow batches to
integer arithmetic over whole columns: calendar ranges are checked, and instants assembled from days.
Zone rules are looked up once per zone and batch. The only join is the one with the table of sources,
whose side Spark broadcasts only below its size threshold.
"""

from __future__ import annotations

import functools
import re
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo, available_timezones

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlog.functions.ids import plain_id
from lumenlog.sources.tables import fresh

# English month names by their first three letters.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

_MONTH = r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"

#: Components: Y year, y year of two digits, M month, B month name, D day, H hour, N minute, S second, F fraction,
#: P AM or PM, Z UTC, O offset in hours and minutes, Q offset in minutes, A zone abbreviation, T zone name, E epoch digits.
_PARTS = {
    "Y": r"\d{4}", "y": r"\d{2}", "M": r"\d{1,2}", "B": _MONTH, "D": r"\d{1,2}", "H": r"\d{1,2}", "N": r"\d{2}", "S": r"\d{2}", "F": r"\d{1,12}",
    "P": r"[ap]\.?m\.?", "Z": r"z|utc|gmt", "O": r"[+-]\d{2}(?::?\d{2})?", "Q": r"[+-]\d{3}", "A": r"[a-z]{2,6}", "T": r"[a-z][a-z0-9_+\-]*(?:/[a-z0-9_+\-]+)*", "E": r"\d{1,19}",
    "1": r"\d{2}", "2": r"\d{2}", "3": r"\d{2}",
}
_ZONE = r"(?:\s*(?:<Z>|<O>|<Q>|\[<T>\])|\s+<A>)?"

#: Dates before a clock time, each written with the components above.
DATES = (
    r"<Y>-<M>-<D>(?:t|\s+)",
    r"<B>\s+<D>\s+(?:<Y>\s+)?",
    r"(?:[a-z]{3,9},?\s+)?<D>\s+<B>\s+<Y>\s+",
    r"<D>/<B>/<Y>:",
    r"<M>/<D>/<Y>,?\s+",
    r"(?:<y>|<Y>)/<M>/<D>\s+",
    r"<D>\.<M>\.<Y>,?\s+",
    r"<Y>\.<M>\.<D>\s+",
)
_CLOCK = r"<H>:<N>(?::<S>(?:[.,]<F>)?)?(?:\s*<P>)?"
_COMPACT = r"(?=\d{8}t|\d{14}[.,+\-z\s\[])<Y><1><2>t?<3><N><S>(?:[.,]<F>)?"
NOTATION = rf"\A\s*(?:(?:(?:{'|'.join(DATES)}){_CLOCK}|{_COMPACT}){_ZONE}|<E>)\s*\z"

_ORDER = "YyMBDHNSFPZOQATE"


def _compiled() -> tuple[str, str]:
    """The alternation with named groups, and the replacement that writes the components in _ORDER, separated by U+0001.

    The replacement names the groups by number, which Java resolves faster."""
    same = {"1": "M", "2": "D", "3": "H"}
    numbers: dict[str, list[int]] = {c: [] for c in _ORDER}

    def group(m: re.Match[str]) -> str:
        c = same.get(m[1], m[1])
        numbers[c].append(sum(map(len, numbers.values())) + 1)
        return f"(?<{c}{len(numbers[c])}>{_PARTS[m[1]]})"

    pattern = re.sub(r"<(\w)>", group, NOTATION)
    return f"(?si){pattern}", "\u0001".join("".join(f"${n}" for n in numbers[c]) for c in _ORDER)


PATTERN, REPLACEMENT = _compiled()


DAY = 86_400_000
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
#: Zone rules are tabled for these years; instants outside are looked up one by one.
_TABLED = (1900, 2100)


@functools.lru_cache(maxsize=1)
def _zone_names() -> dict[str, str]:
    return {n.lower(): n for n in available_timezones()}


def _offset_at(zone: str, millis: int) -> int:
    t = _EPOCH + timedelta(milliseconds=int(millis))
    return int(t.astimezone(ZoneInfo(zone)).utcoffset().total_seconds()) * 1000


@functools.lru_cache(maxsize=None)
def _rules(zone: str) -> tuple[np.ndarray, np.ndarray]:
    """Instants from which an offset holds, and the offsets, in milliseconds; found by weekly samples and bisection."""
    first, last = (int((datetime(y, 1, 1, tzinfo=timezone.utc) - _EPOCH).total_seconds()) * 1000 for y in _TABLED)
    since, offsets = [first], [_offset_at(zone, first)]
    for at in range(first, last, 7 * DAY):
        if (now := _offset_at(zone, at + 7 * DAY)) != offsets[-1]:
            low, high = at, at + 7 * DAY
            while high - low > 1000:
                mid = (low + high) // 2000 * 1000
                low, high = (mid, high) if _offset_at(zone, mid) == offsets[-1] else (low, mid)
            since.append(high)
            offsets.append(now)
    return np.array(since), np.array(offsets)


def _offsets(zone: str, millis: np.ndarray) -> np.ndarray:
    since, offsets = _rules(zone)
    found = offsets[np.clip(np.searchsorted(since, millis, "right") - 1, 0, None)]
    first, last = int(since[0]), since[0] + (datetime(_TABLED[1], 1, 1) - datetime(_TABLED[0], 1, 1)).days * DAY
    for i in np.flatnonzero((millis < first) | (millis >= last)):
        try:
            found[i] = _offset_at(zone, millis[i])
        except OverflowError:
            pass
    return found


@functools.lru_cache(maxsize=None)
def _abbreviations(zone: str) -> dict[str, int]:
    """Offsets of the zone's abbreviations in milliseconds; of several in its history the latest counts."""
    found = {}
    for year in range(1970, 2038):
        for month in (1, 7):
            t = datetime(year, month, 1, tzinfo=timezone.utc).astimezone(ZoneInfo(zone))
            if t.tzname() and t.tzname().isalpha():
                found[t.tzname().lower()] = int(t.utcoffset().total_seconds()) * 1000
    return found


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Days since 1970-01-01 of a civil date: integer arithmetic over a year that begins in March."""
    y = y - (m <= 2)
    return y * 365 + y // 4 - y // 100 + y // 400 + (153 * (m + np.where(m > 2, -3, 9)) + 2) // 5 + d - 719_469


def _leap(y: np.ndarray) -> np.ndarray:
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


def _month_days(y: np.ndarray, m: np.ndarray) -> np.ndarray:
    return np.where(m == 2, 28 + _leap(y), np.where(np.isin(m, (4, 6, 9, 11)), 30, 31))


def _years(days: np.ndarray) -> np.ndarray:
    """The civil year of a day since 1970-01-01."""
    return days.astype("datetime64[D]").astype("datetime64[Y]").astype(np.int64) + 1970


def _nearest(m: np.ndarray, d: np.ndarray, clock: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Local milliseconds of the month, day and clock in the year that brings them closest to ``there``; Feb 29 only in leap years."""
    best = np.zeros(len(m), np.int64)
    gap = np.full(len(m), np.iinfo(np.int64).max)
    here = _years(there // DAY)
    for step in (0, -1, 1, -2, 2, -3, 3, -4, 4, -5, 5, -6, 6, -7, 7, -8, 8):
        y = here + step
        wall = _days(y, m, d) * DAY + clock
        closer = (np.abs(wall - there) < gap) & (d <= _month_days(y, m))
        if abs(step) > 1:
            closer &= (m == 2) & (d == 29)
        best[closer], gap[closer] = wall[closer], np.abs(wall - there)[closer]
        if step == 1 and not ((m == 2) & (d == 29)).any():
            break
    return best


def instants(parts: pa.Array, arrived: pa.Array, zones: pa.Array) -> pa.Array:
    """Epoch milliseconds of the components that REPLACEMENT has cut out; null where they stand for none or for two instants."""
    n, width = len(parts), len(_ORDER)
    split = pc.split_pattern(pc.fill_null(parts, ""), "\u0001")
    whole = pc.equal(pc.list_value_length(split), width).to_numpy(zero_copy_only=False)
    result, good = np.zeros(n, np.int64), np.zeros(n, bool)
    at = np.flatnonzero(whole)
    if not len(at):
        return pa.nulls(n, pa.int64())
    flat = split.take(pa.array(at)).flatten()
    text = {c: flat.take(pa.array(np.arange(i, len(flat), width))) for i, c in enumerate(_ORDER)}
    has = {c: pc.not_equal(t, "").to_numpy(zero_copy_only=False) for c, t in text.items()}

    def number(c: str, missing: int = 0) -> np.ndarray:
        return pc.fill_null(pc.cast(pc.if_else(pa.array(has[c]), pc.utf8_ltrim(text[c], "+"), None), pa.int64()), missing).to_numpy(zero_copy_only=False)

    zone_texts, zone_of = _encoded(zones.take(pa.array(at)))
    # Time since the epoch; a number beyond 64 bits is none.
    ok = np.zeros(len(at), bool)
    value = np.zeros(len(at), np.int64)
    if has["E"].any():
        size = pc.utf8_length(text["E"]).to_numpy(zero_copy_only=False)
        fits = has["E"] & ((size < 19) | pc.less_equal(text["E"], str(2**63 - 1)).to_numpy(zero_copy_only=False))
        e = pc.fill_null(pc.cast(pc.if_else(pa.array(fits), text["E"], None), pa.int64()), 0).to_numpy(zero_copy_only=False)
        value = np.where(size <= 11, e * 1000, np.where(size <= 14, e, np.where(size <= 17, e // 1000, e // 1_000_000)))
        ok = fits.copy()
    # Calendar and clock.
    y = np.where(has["Y"], number("Y"), 2000 + number("y"))
    dated = has["Y"] | has["y"]
    names = pc.index_in(pc.utf8_lower(pc.utf8_slice_codeunits(text["B"], 0, 3)), pa.array(MONTHS))
    m = np.where(has["M"], number("M"), pc.fill_null(names, -1).to_numpy(zero_copy_only=False) + 1)
    d, h, minute, second = number("D"), number("H"), number("N"), number("S")
    twelve = has["P"] & (h >= 1) & (h <= 12)
    late = pc.starts_with(pc.utf8_lower(text["P"]), "p").to_numpy(zero_copy_only=False)
    fine = (h < 24) & (minute < 60) & (second < 60) & (m >= 1) & (m <= 12) & (d >= 1) & ~has["E"] & (~has["P"] | twelve)
    fine &= d <= np.where(dated, _month_days(y, m), _month_days(np.full(len(at), 2000), m))
    fine &= ~dated | (y >= 1)
    h = np.where(twelve, h % 12 + 12 * late, h)
    millis = pc.cast(pc.utf8_rpad(pc.utf8_slice_codeunits(text["F"], 0, 3), 3, "0"), pa.int64()).to_numpy(zero_copy_only=False)
    clock = ((h * 60 + minute) * 60 + second) * 1000 + millis
    # What decides on the zone: an offset, an abbreviation in the source's zone, a named zone, or the source's zone.
    fixed = has["Z"] | has["O"] | has["Q"]
    offset = np.zeros(len(at), np.int64)
    if has["O"].any():
        o = pc.replace_substring(text["O"], ":", "")
        own = pc.fill_null(pc.cast(pc.if_else(pa.array(has["O"]), pc.utf8_slice_codeunits(o, 1, 5), None), pa.int64()), 0).to_numpy(zero_copy_only=False)
        hours = np.where(pc.utf8_length(o).to_numpy(zero_copy_only=False) > 3, own // 100 * 60 + own % 100, own * 60)
        offset = np.where(has["O"], np.where(pc.starts_with(o, "-").to_numpy(zero_copy_only=False), -hours, hours) * 60_000, 0)
    offset = np.where(has["Q"], number("Q") * 60_000, offset)
    if has["A"].any():
        # Each distinct pair of zone and abbreviation is looked up once.
        words = pc.dictionary_encode(pc.utf8_lower(text["A"]))
        known, word = words.dictionary.to_pylist(), words.indices.to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(has["A"] & (zone_of >= 0))
        pairs, place = np.unique(zone_of[rows].astype(np.int64) * len(known) + word[rows], return_inverse=True)
        found = [_abbreviations(zone_texts[p // len(known)]).get(known[p % len(known)]) for p in pairs.tolist()]
        means = np.array([f is not None for f in found], bool)[place]
        offset[rows[means]] = np.array([f or 0 for f in found], np.int64)[place][means]
        fixed[rows[means]] = True
    local = ~(fixed | has["A"])
    named, name_of = _encoded(pc.if_else(pa.array(has["T"]), text["T"], None))
    for k, zone in enumerate([*zone_texts, *named]):
        mine = local & fine & ((zone_of == k) & ~has["T"] if k < len(zone_texts) else name_of == k - len(zone_texts))
        if zone and mine.any():
            i = np.flatnonzero(mine)
            came = arrived.take(pa.array(at[i]))
            known = came.is_valid().to_numpy(zero_copy_only=False)
            there = pc.fill_null(came, 0).to_numpy(zero_copy_only=False)
            wall = np.where(dated[i], _days(y[i], m[i], d[i]) * DAY + clock[i], 0)
            if not dated[i].all():
                j = np.flatnonzero(~dated[i] & known)
                wall[j] = _nearest(m[i[j]], d[i[j]], clock[i[j]], there[j] + _offsets(zone, there[j]))
            before, after = _offsets(zone, wall - DAY), _offsets(zone, wall + DAY)
            one, two = _offsets(zone, wall - before) == before, _offsets(zone, wall - after) == after
            value[i] = wall - np.where(one, before, after)
            ok[i] = np.where(before == after, True, one ^ two) & (dated[i] | known)
    i = np.flatnonzero(fixed & fine)
    came = arrived.take(pa.array(at[i]))
    known, there = came.is_valid().to_numpy(zero_copy_only=False), pc.fill_null(came, 0).to_numpy(zero_copy_only=False)
    wall = _days(y[i], m[i], d[i]) * DAY + clock[i]
    if not dated[i].all():
        j = np.flatnonzero(~dated[i])
        wall[j] = _nearest(m[i[j]], d[i[j]], clock[i[j]], there[j] + offset[i[j]])
    value[i], ok[i] = wall - offset[i], dated[i] | known
    result[at], good[at] = value, ok
    return pa.array(result, pa.int64(), mask=~good)


def _encoded(texts: pa.Array) -> tuple[list[str | None], np.ndarray]:
    """Distinct texts (None for those that are no zone), and each row's place among them, -1 for null."""
    d = pc.dictionary_encode(texts)
    names = _zone_names()
    return [names.get(x.lower()) for x in d.dictionary.to_pylist()], pc.fill_null(d.indices, -1).to_numpy(zero_copy_only=False)


def utc_millis(df: DataFrame, sources: DataFrame, text: str = "date_text", arrival: str = "ts", source: str = "source_id", out: str = "utc_ms") -> DataFrame:
    """``df`` with ``out``: epoch milliseconds of the instant that ``text`` stands for, null where it stands for none or for two.

    An offset, UTC or a zone name in the text decides; an abbreviation means what it means in the source's zone; bare digits are
    time since the epoch (seconds up to 11 digits, then milli-, micro- and nanoseconds); anything else is the local clock of the
    source. Local times that the zone skips or shows twice, impossible dates, unknown zones, null and empty texts give null.
    A missing year is the one that brings the date closest to ``arrival`` (null without arrival). A source listed with two zones
    has none. Rows are never dropped or doubled; an existing column ``out`` is replaced, other columns pass through.
    """
    keep = [c for c in df.columns if c.lower() != out.lower()]
    key, zone, result = (fresh(df, x) for x in ("source", "zone", "utc"))
    low = F.btrim(F.col("time_zone"))
    zones = sources.select(plain_id("source_id").alias(key), low.alias(zone)).where(F.col(key).isNotNull()).groupBy(key).agg(F.when(F.min(zone) == F.max(zone), F.min(zone)).alias(zone))
    cut = F.when(F.locate("\u0001", F.col(f"`{text}`")) == 0, F.regexp_replace(F.col(f"`{text}`"), PATTERN, REPLACEMENT))
    # Integer division of microseconds: casts of timestamps would lean on the session's zone.
    arrived = F.expr(f"floor(unix_micros(cast(`{arrival}` as timestamp)) / 1000)")
    udf = F.arrow_udf(instants, "long")
    return df.withColumn(key, plain_id(f"`{source}`")).join(zones, key, "left").withColumn(result, udf(cut, arrived, F.col(zone))).select(*[F.col(f"`{c}`") for c in keep], F.col(result).alias(out))
