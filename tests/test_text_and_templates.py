import random

import pytest
from pyspark.sql import functions as F

from lumenlog.functions import text as T
from lumenlog.operators.clusters import information_clusters, kmeans, n_clusters, partition, score
from lumenlog.operators.ordering import running_sum
from lumenlog.operators.templates import distance, message_ids, template, templates, threshold


@pytest.mark.parametrize("a,b,want", [("s i t t i n g", "k i t t e n", "* i t t * n *"), ("I love cocoa.", "I love cocoa", "I love cocoa*"), ("I dont love cocoa.", "I love cocoa", "I * love cocoa*"), ("I like cocoa A B C", "I like cocoa", "I like cocoa *"), ("I like cocoa. A", "I like cocoa, A", "I like cocoa* A"), ("", "", ""), (None, "x", "*")])
def test_template(a, b, want):
    assert template(a, b) == want and template(b, a) == want


def test_distance_and_threshold():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
            row = new
        return row[-1]

    r = random.Random(1)
    for _ in range(200):
        a, b = ([r.choice("xyz") for _ in range(r.randint(0, 9))] for _ in range(2))
        most = r.randint(0, 9)
        assert distance(a, b, most) == min(plain(a, b), most + 1)
    assert [threshold(n, 20) for n in (0, 2, 4, 6, 12)] == [0, 0, 1, 1, 3]


def test_ids_and_templates(spark):
    rows = [("c", "disk a is full now today", 1), ("c", "disk a is full now today", 2), ("c", "disk a is empty now today", 3), ("c", "quite another text", 4), (None, "disk a is full now today", 5), ("d", None, 6), ("d", "", 7)]
    df = spark.createDataFrame(rows, "component string, text string, i long")
    got = {(r["component"], r["text"]): r["message_id"] for r in message_ids(df, "component", "text", "i").collect()}
    assert got["c", "disk a is full now today"] == got["c", "disk a is empty now today"] != got["c", "quite another text"] and len(got) == 5
    t = {r["component"]: r["template"] for r in templates(df.where("text like 'disk%'"), "component", "text", "i").collect()}
    assert t == {"c": "disk a is * now today"}


def test_ids_equal_a_search_through_all_representatives(spark):
    r = random.Random(5)
    names = [[f"w{r.randint(0, 30)}" for _ in range(r.choice([0, 1, 2, 3, 4, 6, 7, 8, 14, 15, 16, 31, 70]))] for _ in range(40)]
    rows = []
    for i in range(700):
        x = list(r.choice(names))
        for _ in range(r.randint(0, 2 + len(x) // 4)):
            at = 0 if r.random() < 0.3 else r.randint(0, len(x))  # often the first word
            x[at : at + r.randint(0, 1)] = [f"w{r.randint(0, 30)}"] * r.randint(0, 1)
        rows.append((r.choice("cd"), " ".join(x), i))
    rows += [("e", "alpha is full on node now today", 1), ("e", "omega is full on node now today", 2)]
    want, seen = {}, {}
    for c, t, _ in rows:
        if (c, t) not in want:
            recent = seen.setdefault(c, [])
            k = next((k for k, (other, _) in enumerate(recent) if distance(t.split(), other, most := threshold(len(t.split()), len(other))) <= most), None)
            recent.insert(0, (t.split(), len(recent)) if k is None else recent.pop(k))
            want[c, t] = f"{c}_{recent[0][1]}"
    got = message_ids(spark.createDataFrame(rows, "component string, text string, i long"), "component", "text", "i")
    assert {(x["component"], x["text"]): x["message_id"] for x in got.collect()} == want
    assert want["e", rows[-1][1]] == want["e", rows[-2][1]] and len(set(want.values())) < len(want) - 200


def test_text_functions(spark):
    df = spark.createDataFrame([("root@a.bc mail x.y@d.ef from 10.2.3.4 id DEADBEEF99 n 123456  end ",), (None,), ("",)], "t string")
    assert df.select(T.normalised(F.col("t"))).first()[0] == "%%%root@EMAIL%%% mail %%%EMAIL%%% from %%%IPV4%%% id %%%NUMBER%%% n %%%NUMBER%%% end"
    one = spark.createDataFrame([("hello.world (CONT.) a=b, /usr/local/bin/x ok", "Fatal ERROR now, fatal", "mq-?1*", [0, 1, 8, 119])], "t string, c string, g string, k array<int>")
    r = one.select(T.words(F.col("t")).alias("w"), T.path_words(F.col("t")).alias("p"), T.critical_score(F.col("c")).alias("s"), F.rlike(F.lit("MQ-1"), T.glob_pattern(F.col("g"))).alias("g"), T.time_vector(F.col("k")).alias("v")).first()
    assert r["w"][:6] == ["hello", ".", "world", "a", "=", "b"] and "/usr/local/bin/x" in r["p"] and r["s"] == 3 and r["g"]
    assert r["v"] == "AwEAAAAAAAAAAAAAAACA"
    assert one.select(T.ticks_of(T.time_vector(F.col("k")))).first()[0] == [0, 1, 8, 119]


@pytest.mark.parametrize("pieces", [2, 7, 256])
def test_running_sum(spark, pieces):
    r = random.Random(pieces)
    values = r.sample(range(10_000), 500)
    df = spark.createDataFrame([(v, r.randint(1, 5)) for v in values], "v long, k long").cache()
    got = {x["v"]: x["s"] for x in running_sum(df, "v", "k", "s", pieces).collect()}
    total, want = 0, {}
    for x in sorted(df.collect()):
        total += x["k"]
        want[x["v"]] = total
    assert got == want and running_sum(df.limit(0), "v", "k", "s").count() == 0


def test_information_clusters(spark):
    ids = [f"a{i}" for i in range(4)] + [f"b{i}" for i in range(4)]
    pairs = [(x, y, 0.9 if x[0] == y[0] else 0.05) for i, x in enumerate(ids) for y in ids[i + 1 :]]
    got = {r["message_id"]: r["cluster"] for r in information_clusters(spark.createDataFrame(pairs, "a string, b string, mi double"), restarts=4).collect()}
    assert len({got[f"a{i}"] for i in range(4)}) == 1 and got["a0"] != got["b0"]
    assert [n_clusters(n) for n in (1, 2, 3, 4, 100)] == [1, 1, 2, 2, 10]
    import numpy as np

    m = np.random.default_rng(1).random((9, 9))
    best, labels = partition(m + m.T, 3, 5)
    assert abs(best - score(m + m.T, labels, 1.0)) < 1e-9


def test_kmeans(spark):
    import numpy as np

    g = np.random.default_rng(3)
    x = np.concatenate([g.normal(c, 0.3, (20, 2)) for c in ((0, 0), (9, 0), (0, 9))])
    df = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)] + [(99, None)], "i long, v array<double>").repartition(3, "i")
    got = {r["i"]: r for r in kmeans(df, "i", "v", k=3).collect()}
    assert set(got) == set(range(60)) and len({r["cluster"] for r in got.values()}) == 3
    assert all(len({got[i]["cluster"] for i in range(b, b + 20)}) == 1 for b in (0, 20, 40))
    means = [x[b : b + 20].mean(0) for b in (0, 20, 40)]
    assert abs(got[0]["score"] - sum(((x[i] - means[i // 20]) ** 2).sum() for i in range(60))) < 1e-9
    labels = {r["i"]: r for r in kmeans(df, "i", "v").collect()}
    of = np.array([labels[i]["cluster"] for i in range(60)])
    assert 3 < len(set(of)) <= 8  # the root of 60
    for i in range(60):  # nobody is nearer to the mean of another cluster
        d = {c: ((x[i] - x[of == c].mean(0)) ** 2).sum() for c in set(of)}
        assert min(d, key=d.get) == of[i] and abs(d[of[i]] - labels[i]["distance"]) < 1e-9
    assert labels[0]["score"] <= kmeans(df, "i", "v", runs=1).first()["score"] < got[0]["score"]
    assert kmeans(df.limit(0), "i", "v").count() == 0


@pytest.mark.parametrize("n,k", [(50, 7), (600, 24)])
def test_partition_ends_where_no_move_helps(n, k):
    import numpy as np

    g = np.random.default_rng(n)
    group = g.integers(0, k, n)
    m = np.where(group[:, None] == group, 0.6, 0.1) + g.random((n, n)) * 0.1
    m = m + m.T
    best, labels = partition(m, k, 1, 0.1)
    assert len(set(labels)) == k
    for i in g.choice(n, 8, replace=False):
        for c in range(k):
            if (labels == labels[i]).sum() > 1:
                other = labels.copy()
                other[i] = c
                assert score(m, other, 0.1) <= best + 1e-9
