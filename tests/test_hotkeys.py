from lumenlog.operators.hotkeys import tree_aggregate

AGG = {"n": ("count", None), "s": ("sum", "v"), "low": ("min", "v"), "high": ("max", "v")}


def test_tree_equals_plain(spark):
    # One key holds most rows, another is null.
    df = spark.range(0, 20_000, 1, 5).selectExpr("case when id % 3 > 0 then 'hot' when id % 7 = 0 then null else 'k' || id % 50 end as k", "if(id % 11 = 0, null, id) as v", "id as chunk", "1 as `__chunk`")
    from pyspark.sql import functions as F

    want = {r["k"]: tuple(r)[1:] for r in df.groupBy("k").agg(F.count("*"), F.sum("v"), F.min("v"), F.max("v")).collect()}
    for rows, fan in ((100, 2), (1000, 4), (131_072, 32)):
        got = {r["k"]: tuple(r)[1:] for r in tree_aggregate(df, ["k"], AGG, chunk_rows=rows, fan_in=fan).collect()}
        assert got == want


def test_empty_and_nulls(spark):
    df = spark.createDataFrame([("a", None), ("a", None)], "k string, v long")
    assert [tuple(r) for r in tree_aggregate(df, ["k"], AGG).collect()] == [("a", 2, None, None, None)]
    assert tree_aggregate(df.limit(0), ["k"], AGG).count() == 0
