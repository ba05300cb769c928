import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlog.llm import runs
from lumenlog.llm.runs import boundaries, collapse_runs, segments


def exhaustive(d, penalty):
    """The least cost over all segmentations, and the fewest boundaries that reach it."""
    n = len(d) + 1
    return min((sum(d[i] for i in range(n - 1) if not cut >> i & 1) + penalty * bin(cut).count("1"), bin(cut).count("1")) for cut in range(1 << (n - 1)))


def test_boundaries_are_optimal():
    r = random.Random(5)
    for _ in range(200):
        d = [r.choice([0, 0, 0.4, 1, 1.5, 2, 3]) for _ in range(r.randint(0, 9))]
        starts = boundaries(np.array(d, float), 1.25)
        cost = sum(x for i, x in enumerate(d) if i + 1 not in starts) + 1.25 * (len(starts) - 1)
        assert starts[0] == 0 and (pytest.approx(cost), len(starts) - 1) == exhaustive(d, 1.25)


def brute(rows, tolerance, least):
    """rows: (source, pos, label, value, n, at, prefer)"""
    out = []
    by = {}
    for x in sorted((x for x in rows if x[0] is not None and x[1] is not None), key=lambda x: x[6]):
        by.setdefault((x[0], x[1]), x)
    run = []

    def close():
        if len(run) >= least:
            out.append((run[0][0], run[0][2], run[0][1], run[-1][1], len(run), sum(x[4] or 0 for x in run), min(x[5] for x in run), max(x[5] for x in run)))
        run.clear()

    last = None
    for key in sorted(by):
        x = by[key]
        ok = x[2] is not None and x[3] is not None
        if not (last and ok and run and last[0] == x[0] and last[1] + 1 == x[1] and last[2] == x[2] and abs(last[3] - x[3]) <= tolerance):
            close()
        if ok:
            run.append(x)
        last = x
    close()
    return sorted(out)


def test_whole_runs_are_optimal():
    """Deviations from the median against all segmentations."""

    def cost(part, links, spread):
        h = len(part) // 2
        return sum(links) + spread * (sum(sorted(part)[-h:]) - sum(sorted(part)[:h]) if h else 0)

    r = random.Random(6)
    for _ in range(150):
        x = [float(r.randint(0, 6)) for _ in range(r.randint(1, 9))]
        d, n = [abs(a - b) * 0.3 for a, b in zip(x, x[1:], strict=False)], len(x)
        total = lambda s: sum(cost(x[a:b], d[a : b - 1], 0.5) for a, b in zip(s, [*s[1:], n], strict=True)) + 1.5 * (len(s) - 1)  # noqa: B023, E731
        best = min(total([0, *[i + 1 for i in range(n - 1) if cut >> i & 1]]) for cut in range(1 << (n - 1)))
        assert total(segments(x, d, 1.5, 0.5)) == pytest.approx(best)


def test_a_slow_drift_is_cut_only_by_the_cost_of_whole_runs(spark):
    rows = [("a", p, "x", 1 + p // 3, 1, p, p) for p in range(30)]  # each differs by at most 1 from the one before
    df = spark.createDataFrame(rows, "s string, p long, label string, value int, n int, at long, i long")
    of = lambda **k: sorted((x["first_pos"], x["last_pos"]) for x in collapse_runs(df, ["s"], "p", F.col("label"), F.col("value"), F.col("n"), F.col("at"), "i", penalty=1.5, **k).collect())
    assert of() == [(0, 29)]
    cut = of(spread=0.5)
    assert len(cut) > 2 and cut[0][0] == 0 and cut[-1][1] == 29 and all(a[1] + 1 == b[0] for a, b in zip(cut, cut[1:], strict=False))


@pytest.mark.parametrize("block", [1, 3, 7, 8192])
@pytest.mark.parametrize("tolerance,least", [(0, 2), (1, 3)])
def test_against_brute_force(spark, monkeypatch, block, tolerance, least):
    monkeypatch.setattr(runs, "FAN", 4)
    r = random.Random(block + least)
    rows = [(r.choice(["a", "a", "a", "b", None]), r.choice([None, *range(60)]), r.choice(["x", "x", "x", "y", None]), r.choice([1, 1, 2, 3, None]), r.choice([1, 5, None]), r.randint(0, 99), i) for i in range(400)]
    df = spark.createDataFrame(rows, "s string, p long, label string, value int, n int, at long, i long").selectExpr("*", "'x' as k0", "1 as `group`")
    got = collapse_runs(df, ["s"], "p", F.col("label"), F.col("value"), F.col("n"), F.col("at"), "i", penalty=tolerance + 0.5, least=least, block=block)
    assert sorted(tuple(x) for x in got.collect()) == brute(rows, tolerance, least)


def test_empty(spark):
    df = spark.createDataFrame([], "s string, p long, label string, n int, at long, i long")
    assert collapse_runs(df, ["s"], "p", F.col("label"), F.lit(0.0), F.col("n"), F.col("at"), "i").count() == 0
