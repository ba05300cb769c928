"""Each query against its SQL in DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from lumenlog.plans import analytics, problems

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for p in Path(FOLDER).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def plain(x):
        if isinstance(x, bool):
            return str(x)
        if isinstance(x, (int, float)) and not (isinstance(x, float) and math.isnan(x)):
            return f"{round(float(x), 6) + 0.0:.6f}"
        return str(x)

    return sorted(tuple(plain(r[i]) for i in order) for r in data)


ALL = {**analytics.QUERIES, **problems.QUERIES}
SQL = {**analytics.SQL, **problems.SQL}


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = ALL[name](spark, FOLDER)
    want = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_texts_of_every_severity_take_part(spark, tmp_path):
    rows = [(i, "m", "c", severity, f"pump {word} stopped in hall four today") for i, (severity, word) in enumerate([(1, "a"), (4, "b"), (None, "c"), (0, "d")])]
    rows += [(9, "only_fatal", "d", 4, "quite another text"), (10, "only_null", "d", None, None)]
    spark.createDataFrame(rows, "instance_id long, message_id string, component_id string, severity int, text string").write.parquet(str(tmp_path / "messages.parquet"))
    got = {r["message_id"]: (r["n_texts"], r["template"]) for r in analytics.template_merge(spark, str(tmp_path)).collect()}
    assert got == {"m": (4, "pump * stopped in hall four today"), "only_fatal": (1, "quite another text")}
    ids = {r["component"]: r["n_texts"] for r in analytics.word_levenshtein_clusters(spark, str(tmp_path)).collect()}
    assert ids == {"c": 4, "d": 1}


def test_text_sample_is_the_first_of_the_most_critical(spark):
    from lumenlog.operators import training

    rows = [("m", 5, 1, "calm"), ("m", 9, 2, "fatal abort b"), ("m", 8, 4, "abort fatal a"), ("m", 3, 3, None), ("n", 2, 1, "late"), ("n", 1, 2, "early"), ("o", 1, 1, None)]
    df = spark.createDataFrame([("s", *r) for r in rows], "source_id string, message_id string, ms long, instance_id long, text string")
    got = {r["message_id"]: (r["sample"], r["score"]) for r in training.text_samples(df, 3_600_000).collect()}
    assert got == {"m": ("abort fatal a", 2), "n": ("early", 0), "o": (None, None)}


def test_bucket_rarity_of_seen_and_unseen_ids(spark):
    from pyspark.sql import functions as F

    from lumenlog.operators import scoring, training

    seen = spark.createDataFrame([("s", k, "m", n) for k, n in enumerate([1, 1, 1, 4])], "source_id string, frame long, message_id string, n long")
    new = spark.createDataFrame([("m", 1), ("m", 5), ("m", 2), ("x", 1)], "message_id string, n long")
    got = {(r["message_id"], r["n"]): r["main"] for r in scoring.bucket_rarity_scores(new, training.rarity(seen, 1), F.lit(4)).collect()}
    assert got == pytest.approx({("m", 1): 1 - 4.5 / 5, ("m", 5): 1 - 1.5 / 3.5 * 4.5 / 5, ("m", 2): 1 - 0.5 / 3.5 * 4.5 / 5, ("x", 1): 1 - 0.5 / 5})


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")
def test_differences_of_all_sources(spark):
    got = analytics.set_difference_by_day(spark, FOLDER).collect()
    assert len({r["source_id"] for r in got}) == 15 and {r["change"] for r in got} >= {"add", "delete"}
