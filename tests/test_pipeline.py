import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lumenlog import __main__ as commands
from lumenlog import catalog, flow, pipeline
from lumenlog.sources import files, readers, writers


def write_logs(folder, days, hosts=("web1", "db1"), odd=False):
    r = random.Random(4)
    folder.mkdir(parents=True, exist_ok=True)
    for host in hosts:
        t = datetime(2026, 3, 2)
        with open(folder / f"{host}.log", "w") as f:
            while t < datetime(2026, 3, 2) + timedelta(days=days):
                stamp = t.strftime("%b %d %H:%M:%S").replace(" 0", "  ", 1)
                f.write(f"{stamp} {host} sshd[{r.randint(1, 999)}]: connection from 10.0.0.{r.randint(1, 250)} port {r.randint(1, 9)} closed\n")
                if r.random() < 0.4:
                    f.write(f"{stamp} {host} cron: job {r.choice('abc')} finished in {r.randint(1, 5000)} ms\n\tdone\n")
                if r.random() < 0.05:
                    f.write(f"{stamp} {host} kernel: disk failure on device sda{r.randint(1, 3)}, error fatal\n")
                if odd:
                    f.write(f"{stamp} {host} newd: never heard of this before\n")
                t += timedelta(minutes=r.randint(3, 40))
    return str(folder)


def test_from_lines_to_scored_intervals(spark, tmp_path):
    store, own = str(tmp_path / "store"), flow.Flow(scorers=(flow.Step("clusters", {"restarts": 4}), *flow.Flow().scorers[1:]))
    old = pipeline.with_ids(pipeline.parsed(spark, write_logs(tmp_path / "old", 3), "2026-03-06 00:00:00"))
    first = old.orderBy("ms").first()
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.log").write_text("stray\nFeb 30 10:00:00 h a: b\nFeb 3 10:00:00 h a: c\n")
    assert {r["kind"]: (r["n"], r["examples"]) for r in pipeline.unreadable(spark, str(tmp_path / "bad"), "2026-03-06 00:00:00").collect()} == {"no entry": (1, ["stray"]), "no time": (1, ["Feb 30 10:00:00"])}
    assert (first["source_id"], first["ms"] >= 1772409600000, first["component"]) == (first["source_id"], True, "sshd")
    assert {r["source_id"] for r in old.select("source_id").distinct().collect()} == {"web1", "db1"}
    n = old.count()
    for _ in range(2):  # a second upload replaces the first
        pipeline.upload(spark, old, store, own)
    coarse = pipeline.stored(spark, store, own)
    assert coarse.agg(F.sum("n")).first()[0] == n
    sample = coarse.where("critical > 0").first()
    assert "fatal" in sample["sample"] and sample["critical"] >= 2
    assert {r["source_id"]: r["insufficient"] for r in pipeline.verify(spark, store, own).collect()} == {"web1": True, "db1": True}
    path = pipeline.train(spark, store, "m1", own, high="2026-03-04")
    models, meta = catalog.load_model(spark, path)
    assert {"rarity", "count", "labels", "periodicity", "percentiles"} <= set(models) and meta["intervals_per_day"] == 24 and meta["training_days"] == 3
    new = pipeline.with_ids(pipeline.parsed(spark, write_logs(tmp_path / "new", 1, ("web1",), odd=True), "2026-03-06 00:00:00"))
    for _ in range(2):  # a second analysis replaces its results
        scored, intervals = pipeline.analyze(spark, new, store, own)
    rows = scored.select("status", "bernoulli_value", "anomaly", "periodicity", "message_id").collect()
    assert {r["status"] for r in rows if r["message_id"].startswith("newd")} == {"NEW"} and max(r["bernoulli_value"] for r in rows) == 101
    assert all(r["anomaly"] == 0 for r in rows if r["status"] == "IN_CONTEXT")
    got = pipeline.results(spark, store)
    assert got.count() == intervals.count() == new.select((F.col("ms") / 3_600_000).cast("long").alias("h")).distinct().count()
    assert got.where("anomaly > 1 or anomaly < 0").where("anomaly != 1.01").count() == 0
    assert spark.read.format("xml").option("rowTag", "interval").load(f"{store}/xml").count() == got.count()
    with pytest.raises(ValueError):
        pipeline.train(spark, store, "none", own, low="2030-01-01")


def test_flows_are_checked(spark, tmp_path):
    path = str(tmp_path / "f.json")
    files.write_text(spark, path, json.dumps({"coarse_ms": 7_200_000, "scorers": [{"name": "rarity"}, {"name": "count"}, {"name": "weighted", "settings": {"weights": '{"4": 2}'}}], "outputs": []}))
    assert [n for n, _ in flow.load(spark, path).checked()][-1] == "weighted"
    for wrong in ({"coarse": 1}, {"coarse_ms": 700_000}, {"scorers": [{"name": "nobody"}]}, {"scorers": [{"name": "rarity", "settings": {"x": 1}}]}, {"outputs": ["paper"]}, {"scorers": [{"name": "clusters", "settings": {"restarts": "many"}}]}):
        files.write_text(spark, path, json.dumps(wrong))
        with pytest.raises(ValueError):
            flow.load(spark, path)
    with pytest.raises(ValueError):
        flow.register(flow.SCORERS, "rarity")(object)


def test_own_scorer(spark):
    @flow.register(flow.SCORERS, "loud")
    @flow.dataclass(frozen=True)
    class Loud:
        factor: float = 2.0
        after: tuple[str, ...] = ()

        def fit(self, summaries, models, length):
            return {"mean": summaries.groupBy("message_id").agg(F.avg("n").alias("mean"))}

        def score(self, messages, models, length):
            return messages.join(models["mean"], "message_id", "left").withColumn("anomaly", F.when(F.col("n") > self.factor * F.col("mean"), 1.0).otherwise(0.0)).drop("mean")

    try:
        own = flow.Flow(scorers=(flow.Step("loud", {"factor": 1.5}),), outputs=())
        s = spark.createDataFrame([("s", 3_600_000 * i, "a", 10 if i == 3 else 1) for i in range(5)], "source_id string, frame long, message_id string, n long")
        models = flow.fit(s, own)
        assert [r["anomaly"] for r in flow.score(s, models, own).orderBy("frame").collect()] == [0, 0, 0, 1, 0]
        assert flow.score_intervals(flow.score(s, models, own), models).count() == 5
    finally:
        del flow.SCORERS["loud"]


def test_models_and_state(spark, tmp_path):
    m = {"t": spark.createDataFrame([(1,)], "x int")}
    for name in ("a", "b"):
        catalog.store_model(m, str(tmp_path / name), "g", {}, default=True)
    assert catalog.default_model(spark, str(tmp_path), "g").endswith("/b") and sum(x["default"] for x in catalog.models(spark, str(tmp_path)).values()) == 1
    catalog.store_model(m, str(tmp_path / "c"), None, {"version": "0.9"}, default=True)
    assert catalog.default_model(spark, str(tmp_path), "other").endswith("/c")
    with pytest.raises(ValueError):
        catalog.load_model(spark, str(tmp_path / "c"))
    with pytest.raises(Exception):
        catalog.store_model({"t": m["t"].select(F.raise_error(F.lit("no")).alias("x"))}, str(tmp_path / "d"), "g", {})
    assert not files.exists(spark, str(tmp_path / "d"))
    assert writers.read_state(spark, str(tmp_path / "s")) == {}
    writers.write_state(spark, {"last": {"a": 5}}, str(tmp_path / "s"))
    assert writers.read_state(spark, str(tmp_path / "s")) == {"last": {"a": 5}}
    v = catalog.Version.parse
    assert v("3.2.1") < v("3.10") and v("2") == v("2.0.0") and int(v("1.2.3")) == 1002003 and str(v("1.2")) == "1.2"
    writers.dump_model({"t": spark.createDataFrame([(1, [2])], "x int, y array<int>")}, str(tmp_path / "dump"))
    writers.statistic_files(spark.createDataFrame([(2,), (1,)], "x int"), str(tmp_path / "stat"), ["x"])
    assert [r[0] for r in spark.read.csv(str(tmp_path / "stat" / "x")).collect()] == ["1", "2"]


def test_tables(spark):
    catalog.create_tables(spark, "store_test")
    try:
        catalog.ask(spark, "insert into store_test.message_ids values ('a', 0), ('b', 1); select 1")
        sizes = {r["table"]: r["n"] for r in catalog.table_sizes(spark, "store_test").collect()}
        assert sizes["message_ids"] == 2 and set(sizes) == set(catalog.TABLES)
        catalog.empty_tables(spark, "store_test")
        assert spark.table("store_test.message_ids").count() == 0
    finally:
        catalog.drop_tables(spark, "store_test")
        spark.sql("drop database store_test cascade")


def test_groups_updated(spark):
    sources = spark.createDataFrame([("web1",), ("db1",)], "source_id string")
    old = spark.createDataFrame([("a", "web*", 1), ("b", "*", 2)], "group_name string, rule string, evaluation_order int")
    new = spark.createDataFrame([("a", "db*", 1), ("c", "x*", 2)], "group_name string, rule string, evaluation_order int")
    changes, assigned, stale = catalog.updated_groups(sources, old, new)
    assert {tuple(r) for r in changes.collect()} == {("a", "update"), ("b", "delete"), ("c", "add")}
    assert {tuple(r) for r in assigned.collect()} == {("web1", "UNASSIGNED"), ("db1", "a")}
    assert sorted(r[0] for r in stale.collect()) == ["a", "b"]


def test_commands(spark, tmp_path, capsys):
    assert commands.main(["list"]) == 0 and "p1_found" in capsys.readouterr().out
    assert commands.training_span("2026-01-01", None, 3, "2026-02-01") == ("2026-01-01", "2026-01-03")
    assert commands.training_span(None, None, 2, "2026-02-01") == ("2026-01-30", "2026-01-31")
    with pytest.raises(ValueError):
        commands.training_span("2026-03-01", "2026-02-01", None, "2026-04-01")
    logs = write_logs(tmp_path / "logs", 1, ("web1",))
    (tmp_path / "logs" / "web1.log").open("a").write("not a head at all\n")
    assert commands.main(["mask", logs, str(tmp_path / "masked"), "--name", "sda", "disk", "--host", "h"]) == 0
    masked = [r["value"] for r in spark.read.text(str(tmp_path / "masked")).collect()]
    assert masked[-1] == "not a head at all" and not any(" web1 " in x or "10.0.0." in x for x in masked) and any("127.0.0.1" in x for x in masked)


def test_small_results(spark):
    df = spark.range(3)
    assert catalog.one(df.where("id = 1")) == 1 and catalog.one(df.where("id > 5")) is None and sorted(catalog.column(df)) == [0, 1, 2]
    for wrong in (lambda: catalog.one(df), lambda: catalog.one(df.where("id > 5"), needed=True), lambda: catalog.column(df, 2)):
        with pytest.raises(ValueError):
            wrong()
    seen = []
    assert catalog.each_row(df, lambda r: seen.append(r["id"])) == 3 and sorted(seen) == [0, 1, 2]
    names = spark.createDataFrame([("web-*",), ("",), (None,), ("x" * 201,), ("a;b",)], "n string")
    assert sorted((r["reason"]) for r in catalog.bad_names(names, "n").collect()) == ["missing", "missing", "sign", "too long"]
    a, b = flow.Flow(), flow.Flow(fine_ms=300_000)
    assert flow.flow_of("WEB", {"web": b}, a) is b and flow.flow_of(None, {"web": b}, a) is a


def test_lines_of_a_pipe(spark, tmp_path):
    assert readers.spooled(spark, (f"line {i}\n" for i in range(25)), str(tmp_path / "spool"), 10) == 3
    q = readers.line_stream(spark, str(tmp_path / "spool")).writeStream.format("memory").queryName("piped").option("checkpointLocation", str(tmp_path / "cp")).trigger(once=True).start()
    assert q.awaitTermination(60) and spark.table("piped").count() == 25
