from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenlog.operators.timestamps import _offsets, utc_millis

UTC = timezone.utc


def ms(y, m, d, h=0, mi=0, s=0, u=0, tz=UTC):
    return int(datetime(y, m, d, h, mi, s, u, tzinfo=tz).timestamp() * 1000)


B, NY, LA = ZoneInfo("Europe/Berlin"), ZoneInfo("America/New_York"), ZoneInfo("America/Los_Angeles")
CASES = [
    # text, source, expected
    ("2025-10-15T01:48:19.260768Z", "x", ms(2025, 10, 15, 1, 48, 19, 260000)),
    ("2025-10-15T05:07:12.994372937+02:00", None, ms(2025, 10, 15, 3, 7, 12, 994000)),
    ("20251015110920.823+660", "x", ms(2025, 10, 15, 0, 9, 20, 823000)),
    ("20251014225758.626-300", None, ms(2025, 10, 15, 3, 57, 58, 626000)),
    ("20251015T011413Z", None, ms(2025, 10, 15, 1, 14, 13)),
    ("15/Oct/2025:01:04:13 +0100", None, ms(2025, 10, 15, 0, 4, 13)),
    ("Wed, 15 Oct 2025 00:03:49 GMT", None, ms(2025, 10, 15, 0, 3, 49)),
    ("2025-10-15T11:09:14[Australia/Sydney]", None, ms(2025, 10, 15, 0, 9, 14)),
    ("2025-10-14 22:46:18.775856 PDT", "la", ms(2025, 10, 15, 5, 46, 18, 775000)),
    ("2025-10-14 22:46:18.775856 PDT", "berlin", None),
    ("2025-10-14 22:46:18.775856 PDT", None, None),
    ("2025-10-15 07:12:21.802473 +0545", None, ms(2025, 10, 15, 1, 27, 21, 802000)),
    ("2025-10-16 17:44:37.410909 -03", None, ms(2025, 10, 16, 20, 44, 37, 410000)),
    ("1760499310", None, 1760499310000),
    ("1760495038913", None, 1760495038913),
    ("1760490837319190", None, 1760490837319),
    ("1760490837319190123", None, 1760490837319),
    ("9" * 19, None, None),
    ("9" * 20, None, None),
    ("10/15/2025 11:09:47 AM", "berlin", ms(2025, 10, 15, 11, 9, 47, tz=B)),
    ("10/15/2025 12:09:47 AM", "berlin", ms(2025, 10, 15, 0, 9, 47, tz=B)),
    ("10/15/2025 13:09:47 PM", "berlin", None),
    ("25/10/15 04:24:20", " BERLIN ", ms(2025, 10, 15, 4, 24, 20, tz=B)),
    ("15.10.2025 10:28", "berlin", ms(2025, 10, 15, 10, 28, tz=B)),
    ("OCT 15 2025 02:47:26", "ny", ms(2025, 10, 15, 2, 47, 26, tz=NY)),
    ("2025-11-02 01:30:00,000", "ny", None),  # twice
    ("2026-03-08 02:30:00,000", "ny", None),  # never
    ("2026-03-29T02:30:00[Europe/Berlin]", None, None),
    ("2025-11-02 01:30:00 EST", "ny", ms(2025, 11, 2, 6, 30)),
    ("2025-10-15 02:11:42,464", "nowhere", None),
    ("2025-10-15 02:11:42,464", None, None),
    ("2025-10-15T02:11:42[Mars/Base]", "berlin", None),
    ("2026-13-04T10:00:00Z", None, None),
    ("2026-02-30T23:10:00.120+01:00", None, None),
    ("2024-02-29T23:10:00Z", None, ms(2024, 2, 29, 23, 10)),
    ("2025-10-15T24:00:00Z", None, None),
    ("2025-10-15T23:60:00Z", None, None),
    ("0000-00-00 00:00:00", "berlin", None),
    ("Oct", "berlin", None), ("", "berlin", None), ("yesterday", "berlin", None), (None, "berlin", None), ("?" * 100_000, "berlin", None), ("\u0001" * 20, "berlin", None),
]
YEARLESS = [
    ("Dec 31 23:59:50", datetime(2026, 1, 1, 0, 1, tzinfo=UTC), ms(2025, 12, 31, 23, 59, 50, tz=B)),
    ("Jan  1 00:00:10", datetime(2025, 12, 31, 23, 1, tzinfo=UTC), ms(2026, 1, 1, 0, 0, 10, tz=B)),
    ("Feb 29 12:00:00", datetime(2025, 3, 1, tzinfo=UTC), ms(2024, 2, 29, 12, tz=B)),
    ("Feb 30 12:00:00", datetime(2025, 3, 1, tzinfo=UTC), None),
]


@pytest.fixture(scope="module")
def sources(spark):
    return spark.createDataFrame([("berlin", "Europe/Berlin"), ("ny", "America/New_York"), ("la", "America/Los_Angeles"), ("nowhere", None), ("odd", "Not/AZone")], "source_id string, time_zone string")


def test_cases(spark, sources):
    at = datetime(2025, 10, 15, tzinfo=UTC)
    rows = [(i, t, s, at) for i, (t, s, _) in enumerate(CASES)] + [(1000 + i, t, "berlin", a) for i, (t, a, _) in enumerate(YEARLESS)]
    df = spark.createDataFrame(rows, "i long, date_text string, source_id string, ts timestamp")
    got = {r["i"]: r["utc_ms"] for r in utc_millis(df, sources).collect()}
    want = {i: c[2] for i, c in enumerate(CASES)} | {1000 + i: c[2] for i, c in enumerate(YEARLESS)}
    assert {i: (rows, got[i], w) for i, w in want.items() if got[i] != w} == {}


def test_clashing_columns_ties_and_empty(spark, sources):
    df = spark.createDataFrame([("1760499310", "ny", datetime(2025, 1, 1), 5, "a", 7)] * 3, "date_text string, source_id string, ts timestamp, `__source` int, `__zone` string, utc_ms int")
    got = utc_millis(df, sources)
    assert got.columns == ["date_text", "source_id", "ts", "__source", "__zone", "utc_ms"]
    assert [r["utc_ms"] for r in got.collect()] == [1760499310000] * 3
    assert utc_millis(df.limit(0), sources).count() == 0
    assert utc_millis(df, sources.limit(0)).where("utc_ms is not null").count() == 3


@settings(max_examples=60, deadline=None)
@given(st.datetimes(datetime(1950, 1, 1), datetime(2090, 1, 1)), st.sampled_from(["Europe/Berlin", "America/Sao_Paulo", "Asia/Kathmandu", "Australia/Lord_Howe", "America/New_York"]))
def test_offsets_are_those_of_the_zone(t, zone):
    import numpy as np

    at = t.replace(tzinfo=UTC, microsecond=0)
    assert _offsets(zone, np.array([int(at.timestamp() * 1000)]))[0] == at.astimezone(ZoneInfo(zone)).utcoffset() / timedelta(milliseconds=1)
    assert pa.array([1]).null_count == 0
