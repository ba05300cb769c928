import random
import re
from itertools import combinations

import pytest

from lumenlog.llm import neardup
from lumenlog.llm.neardup import groups, similar_records


def brute(rows, t):
    out = set()
    rows = sorted({(k, i, x) for k, i, x in rows if x is not None})
    for (k, i, x), (m, j, y) in combinations(rows, 2):
        if k == m and i != j:
            a, b = (set(re.findall("[a-z0-9]+", z.lower())) for z in (x, y))
            if (a or b) and len(a & b) >= t * len(a | b) - 1e-9 or not a and not b and x == y:
                out.add((k, min(i, j), max(i, j)))
    return out


def make(seed, n):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(n):
        if texts and r.random() < 0.6:
            w = r.choice(texts).split()
            for _ in range(r.randint(0, 4)):
                k = r.randint(0, len(w))
                w[k : k + r.randint(0, 1)] = r.choice([[], [r.choice(vocabulary)]])
            texts.append(" ".join(w) or "x")
        else:
            texts.append(" ".join(r.choice(vocabulary) for _ in range(r.randint(1, 25))))
    extra = ["", "", "---", "--", None, None, "A b, C!", "a B c", "x " * 20_000]
    return [(r.choice("pq"), i, x) for i, x in enumerate([*texts, *extra])]


@pytest.mark.parametrize("tile", [4, 2048])
@pytest.mark.parametrize("threshold", [0.7, 0.8])
def test_all_pairs(spark, monkeypatch, tile, threshold):
    rows = make(tile, 160)
    real = neardup.candidate_pairs
    monkeypatch.setattr(neardup, "candidate_pairs", lambda s, c, t, _: real(s, c, t, tile))
    df = spark.createDataFrame([*rows, *rows[:5]], "kind string, id long, text string").selectExpr("kind as k", "id as i", "text as words", "1 as class")
    got = [tuple(r) for r in similar_records(df, "k", "i", "words", threshold).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, threshold)


def test_groups(spark):
    rows = make(11, 120)
    pairs = brute(rows, 0.7)
    parent = {(k, i): i for k, i, x in rows if x is not None}

    def find(n):
        while parent[n] != n[1]:
            n = (n[0], parent[n])
        return n

    for k, a, b in pairs:
        x, y = sorted((find((k, a)), find((k, b))), key=lambda n: n[1])
        parent[y] = x[1]
    got = {(r["kind"], r["id"]): r for r in groups(spark.createDataFrame(rows, "k string, i long, t string"), "k", "i", "t").collect()}
    assert {n: r["group"] for n, r in got.items()} == {n: find(n)[1] for n in parent}
    classes = {(r["kind"], r["class"]) for r in got.values()}
    links = {(k, a, b) for k, a, b in pairs if (k, a) in classes and (k, b) in classes}
    assert all(r["n_links"] == sum(1 for k, a, b in links if k == r["kind"] and r["class"] in (a, b)) for r in got.values())


def test_empty(spark):
    assert similar_records(spark.createDataFrame([], "k string, i long, t string"), "k", "i", "t").count() == 0


@pytest.mark.parametrize("tile", [4, 64])
def test_words_in_every_text(spark, monkeypatch, tile):
    """Every group is larger than a tile: all words are frequent, one is in every text."""
    r = random.Random(5)
    few = [f"v{i}" for i in range(9)]
    rows = [("k", i, " ".join(["common", *r.sample(few, r.randint(1, 8))])) for i in range(200)]
    real = neardup.candidate_pairs
    monkeypatch.setattr(neardup, "candidate_pairs", lambda s, c, t, _: real(s, c, t, tile))
    got = [tuple(x) for x in similar_records(spark.createDataFrame(rows, "kind string, id long, text string"), "kind", "id", "text", 0.7).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 0.7)


def test_thresholds(spark):
    df = spark.createDataFrame([("k", 1, "a b")], "kind string, id long, text string")
    with pytest.raises(ValueError):
        similar_records(df, "kind", "id", "text", 0.5)
    assert similar_records(df, "kind", "id", "text", 1.0).count() == 0


def test_nulls_and_empty_tables(spark):
    rows = [("k", 1, None), (None, 2, "a b c d"), (None, 3, "a b c d e"), ("k", None, "a b c d"), ("k", 5, "a b c d"), ("k", 6, "a b c d e")]
    df = spark.createDataFrame(rows, "kind string, id long, text string")
    assert [tuple(r) for r in similar_records(df, "kind", "id", "text").collect()] == [("k", 5, 6)]
    assert sorted((r["id"], r["n_links"], r["group"]) for r in groups(df, "kind", "id", "text").collect()) == [(5, 1, 5), (6, 1, 5)]
    for empty in (df.limit(0), df.where("id = 1")):
        assert similar_records(empty, "kind", "id", "text").count() == 0 and groups(empty, "kind", "id", "text").count() == 0
