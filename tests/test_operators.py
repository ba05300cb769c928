"""Small tests of rules on lines, periods, statistics, vectors, dates and reference data, against plain Python where it says more."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lumenlog.functions import text as T
from lumenlog.functions import times, vectors
from lumenlog.operators import context, framing, lines, periods, relational, scoring, statistics, training

HOUR = 3_600_000


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_normal_form(spark):
    texts = {
        "mail root@a.example.org now": "mail %%%root@EMAIL%%% now", "from x.y+z@b.example, to root@c.d": "from %%%EMAIL%%% , to %%%root@EMAIL%%%", "at 10.0.0.255 and 10.0.0.256": "at %%%IPV4%%% and 10.0.0.256",
        "six 1.2.3.4.5.6": "six %%%IPV6%%%", "id DEADBEEF 12345 123 abcdef1": "id %%%NUMBER%%% %%%NUMBER%%% 123 abcdef1", " a\t\tb ": "a b", "": "",
    }
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.normalised(F.col("t")).alias("n")).collect()
    assert {r["t"]: r["n"] for r in got} == texts


def test_components_of_commands(spark):
    cases = [
        ("sudo", "anna : TTY=x ; USER=root ; COMMAND=/bin/ls -l /tmp | grep x", "sudo(anna):/bin/ls | grep"), ("SUDO", "no command here", "SUDO"), ("/usr/sbin/cron", "(root) CMD (exec /bin/run 'a|b' && /bin/two)", "/usr/sbin/cron(root):exec /bin/run && /bin/two"),
        ("/usr/sbin/cron", " CMD (" + " ; ".join(f"c{i}" for i in range(9)) + ")", "/usr/sbin/cron:c0 ; c1 ; c2 ; c3 ; c4"), ("puppet-agent", "(/Stage[main]/X 12345) done", "puppet-agent:/Stage[main]/X %%%NUMBER%%%"), ("puppet-agent", "(" + "x" * 300 + ")", "puppet-agent:" + "x" * 100),
        ("sudo", "a:COMMAND=" + "y" * 300, ("sudo(a):" + "y" * 300)[:120]), ("cron", "(root) CMD (x)", "cron"), (None, "x", None), ("sudo", None, "sudo"),
    ]
    df = spark.createDataFrame([(i, c, t) for i, (c, t, _) in enumerate(cases)], "i int, component_id string, text string")
    got = df.select("i", lines.component(F.col("component_id"), F.col("text")).alias("c")).orderBy("i").collect()
    assert [r["c"] for r in got] == [w for _, _, w in cases]
    wrapped = lines.wrappers(df.withColumn("message_id", F.lit("m")).withColumn("component_id", lines.component(F.col("component_id"), F.col("text"))))
    assert rows(wrapped, "i", "message_id", "component_id") == [(0, "sudo(anna)", "wrapper"), (2, "/usr/sbin/cron(root)", "wrapper"), (6, "sudo(a)", "wrapper")]
    limits = spark.createDataFrame([("sudo(a):x", 12, 30), ("puppet-agent:x", 12, 30), ("c", 12, 30), ("c", 1, 1)], "c string, a int, b int").select(lines.edit_threshold(F.col("c"), F.col("a"), F.col("b")).alias("t")).collect()
    assert [r["t"] for r in limits] == [3, 0, 3, 0]


def test_magic_words_and_restarts(spark):
    df = spark.createDataFrame([("Job STARTED, ended with Error; stopped starting",), ("root stop",), ("",)], "t string")
    assert [r["w"] for r in df.select(lines.magic_words(F.col("t")).alias("w")).collect()] == [["started", "ended", "error", "stopped"], ["stop"], []]
    got = spark.createDataFrame([("syslog-ng", "syslog-ng starting up; version=3"), ("x", "syslog-ng starting up"), ("Syslog-NG", "other"), (None, None)], "c string, t string").select(lines.logger_restarted(F.col("c"), F.col("t")).alias("r")).collect()
    assert [r["r"] for r in got] == [True, False, False, False]


@pytest.mark.parametrize("block", [1, 3, 100])
def test_repeats(spark, block):
    said = [(1, "last message repeated 9 times"), (2, "a"), (3, "last message repeated 3 times"), (4, "b"), (5, "c"), (6, "message repeated 2 times"), (7, "last message repeated 5 times")]
    df = spark.createDataFrame([("f", i, t) for i, t in said], "file string, line_no long, text string")
    assert rows(lines.repeats_added(df, ["file"], "line_no", block=block), "line_no", "text", "cnt") == [(2, "a", 3), (4, "b", 1), (5, "c", 7)]


def test_masks_and_sources(spark):
    df = spark.createDataFrame([("h1 mail a@b.cc from 1.2.3.4 at Acme", "h1"), ("Acme 1.2.3.4", ""), (None, None)], "line string, host string")
    assert [r["m"] for r in df.select(lines.masked_line(F.col("line"), F.col("host"), {"Acme": "Corp"}).alias("m")).collect()] == ["system mail user@example.com from 127.0.0.1 at Corp", "Acme 1.2.3.4", None]
    kept, others = lines.allowed_sources(spark.createDataFrame([("a",), ("b",), ("b",)], "source_id string"), spark.createDataFrame([("a",)], "source_id string"))
    assert kept.count() == 1 and rows(others, "source_id", "n") == [("b", 2)]
    heads = spark.createDataFrame([("Jan  2 03:04:05 h a b c d e f",), ("2026-01-02T03:04:05Z a b c d e f g h i j k",), ("a b c d e",)], "line string").select(lines.error_heads(F.col("line")).alias("h")).collect()
    assert [r["h"] for r in heads] == ["<month> <day> <clock> h a b c", "<time> a b c d e f g h i", "a b c d"]


def test_cluster_logs_and_restarts(spark):
    df = spark.createDataFrame([("25/06/08 14:37:39 ERROR Exec: went away",), ("nothing",), (None,)], "line string")
    got = df.select(lines.spark_fields(F.col("line")).alias("a"), lines.spark_fields(F.col("line"), as_source=False).alias("b")).collect()
    assert tuple(got[0]["a"]) == (1749393459000, "error", "master", 3, "went away") and tuple(got[0]["b"])[1:3] == (None, "Exec") and got[1]["a"] is None and got[2]["a"] is None
    m = spark.createDataFrame([("s", 0, "x", "a"), ("s", 10, "syslog-ng", "syslog-ng starting up; version"), ("s", 20, "x", "b"), ("s", 99, "x", "c")], "source_id string, ms long, component string, text string")
    assert [r["run"] for r in framing.runs(m, ["source_id"], "ms", 50, starts=lines.logger_restarted(F.col("component"), F.col("text"))).orderBy("ms").collect()] == [1, 2, 2, 3]


def last_seen_plain(summaries, length):
    """Interval after interval, with the last tick of every id kept."""
    tick, known, out = length // 120, {}, []
    for source, frame, message, ticks in sorted(summaries, key=lambda s: s[1]):
        first = frame + (ticks[0] if ticks else 60) * tick
        before = known.get((source, message))
        deltas = [(first - (frame if before is None else before)) // 1000] + [(b - a) * tick // 1000 for a, b in zip(ticks, ticks[1:], strict=False)]
        out.append((source, frame, message, "neverSeenBefore" if before is None else "regular" if ticks else "noTimeline", deltas))
        known[source, message] = frame + (ticks[-1] if ticks else 60) * tick
    return sorted(out)


def periodicity_plain(seen):
    """Scores of every interval's deltas by a table of all of them."""
    counts = {}
    for _, _, message, _, deltas in seen:
        for d in deltas:
            counts.setdefault(message, {}).setdefault(d, 0)
            counts[message][d] += 1
    out = {}
    for source, frame, message, _, deltas in seen:
        c = counts[message]
        n, top = sum(c.values()), max(c.values())
        if n < 10 or top <= 10 or n / len(c) <= 2:
            out[source, frame, message] = (0.0, None)
            continue
        score = {d: math.log(top) - math.log(k) for d, k in c.items() if k > 1}
        worst = 0.0
        for i, d in enumerate(deltas):
            options = [x for x in (score.get(d), score.get(d + deltas[i - 1]) if i else None) if x is not None]
            worst = max(worst, min(options, default=math.log(top) + math.log(2)))
        out[source, frame, message] = (worst, worst - math.log(top / n))
    return out


def test_last_seen_against_plain_python(spark):
    r = random.Random(8)
    made = [(s, HOUR * i, m, sorted(r.sample(range(0, 120, 30 if m == "steady" else 7), r.randint(0, 4) if m != "steady" else 4))) for s in "ab" for m in ("steady", "x", "y") for i in range(40) if r.random() < 0.7]
    df = spark.createDataFrame(made, "source_id string, frame long, message_id string, ticks array<int>")
    seen = context.last_seen(df, HOUR)
    plain = last_seen_plain(made, HOUR)
    assert sorted((x["source_id"], x["frame"], x["message_id"], x["status"], x["deltas"]) for x in seen.collect()) == plain
    want = periodicity_plain(plain)
    got = context.last_seen_scores(seen, context.periodicity_model(seen)).collect()
    assert any(v[1] is not None for v in want.values()) and any(v[0] > 0 for v in want.values())
    for x in got:
        score, given = want[x["source_id"], x["frame"], x["message_id"]]
        assert x["log_prob"] == pytest.approx(score) and (x["given_last"] is None if given is None else x["given_last"] == pytest.approx(given))
    runs = context.last_seen(df.withColumn("run", (F.col("frame") / (20 * HOUR)).cast("int")), HOUR, "run")
    assert {x["status"] for x in runs.collect()} == {"neverSeenBefore", "new", "regular", "noTimeline"}


def test_chain_in_context_against_plain_python(spark):
    r = random.Random(2)
    made = [("s", HOUR * i, m, r.randint(1, 30)) for i in range(60) for m in "abcdef" if r.random() < (0.5 if m in "abc" else 0.2)]
    labels = {"a": 1, "b": 1, "c": 1}
    frames = {f: {m: n for _, g, m, n in made if g == f} for f in {x[1] for x in made}}
    n_all = (max(frames) - min(frames)) // HOUR + 1
    inside = {(f, m) for f, here in frames.items() for m in here if m in labels and sum(x in labels for x in here) > 1 and sum(x in labels for x in here) / 3 >= 0.3}
    stat = {}
    for m in "abcdef":
        mine = [(f, here[m]) for f, here in frames.items() if m in here]
        out = [math.log(n) for f, n in mine if (f, m) not in inside]
        stat[m] = (len(mine), len(out), sum(out) / len(out) if out else None, max(n for _, n in mine))
    least = min([1.0] + [s[2] for s in stat.values() if s[2]])
    df = spark.createDataFrame(made, "source_id string, frame long, message_id string, n long")
    got = {(x["frame"], x["message_id"]): x for x in scoring.message_scores(df, HOUR, spark.createDataFrame(list(labels.items()), "message_id string, cluster int")).collect()}
    assert len(got) == len(made) and 0 < len(inside) < len(made)
    for _, f, m, n in made:
        c, c_out, mu0, most = stat[m]
        p = ((c_out if m in labels and (f, m) not in inside else c) + 0.5) / (n_all + 1)
        mu = least if mu0 is None else mu0
        sigma = max(0.5, math.sqrt(mu))
        density = lambda k: 0.0 if math.log(k) <= mu else ((math.log(k) - mu) / sigma) ** 2 / 2  # noqa: B023, E731
        bad = bool(mu0) and density(most) >= 15
        count = 0.0 if (f, m) in inside or bad else density(n)
        x = got[f, m]
        assert x["rarity"] == pytest.approx(-math.log(p / (1 - p))) and x["count_score"] == pytest.approx(count)
        assert x["anomaly"] == pytest.approx(0 if (f, m) in inside else 0.2 * count + 0.8 * -math.log(p / (1 - p)))


@pytest.mark.parametrize("span", [HOUR, 7 * HOUR, 10_000 * HOUR])
def test_cooccurrence_against_plain_python(spark, span):
    r = random.Random(3)
    made = [(r.choice(["s", "t", None]), HOUR * r.randint(0, 40), r.choice([*"fbadce", None])) for _ in range(400)]
    here = {}
    for s, f, m in made:
        if s and m:
            here.setdefault((s, f), set()).add(m)
    want = {}
    for ids in here.values():
        for a in ids:
            for b in ids:
                if a < b:
                    want[a, b] = want.get((a, b), 0) + 1
    df = spark.createDataFrame(made, "source_id string, frame long, message_id string")
    assert {(x["a"], x["b"]): x["joint"] for x in training.cooccurrence(df, span).collect()} == want
    assert training.cooccurrence(df.limit(0), span).count() == 0


def test_log_factorial(spark):
    ns = [0, 1, 2, 19, 20, 21, 100, 12345, 10**6, 10**9]
    got = spark.createDataFrame([(n,) for n in ns], "n long").select(training.log_factorial(F.col("n")).alias("x")).collect()
    assert [r["x"] for r in got] == [pytest.approx(math.lgamma(n + 1), rel=1e-13, abs=1e-12) for n in ns]


def test_output_fields_and_integration(spark):
    df = spark.createDataFrame([("NEW", 0.5, 4.0, None, "new", -1.0), ("IN_CONTEXT", 0.002, 2.0, 0.8, "regular", 0.3), ("OUT_OF_CONTEXT", 0.3, 0.0, 0.7, "regular", 0.3), ("UNCLUSTERED", 1.0, 1.0, None, "regular", 0.3)], "status string, raw_anomaly double, frequency double, given_last double, last_seen string, anomaly double")
    got = scoring.output_fields(df, 24).collect()
    assert [(r["bernoulli_value"], r["bernoulli_frequency"], r["periodicity"], r["anomaly"]) for r in got] == [(101.0, 6.0, "NEW", 0.0), (1.0, 12.0, "IN_SYNC", 0.3), (30.0, 0.0, "NOT_IN_SYNC", 0.3), (100.0, 24.0, "NON_PERIODIC", 0.3)]
    two = spark.createDataFrame([(0.0, None), (2.0, 2.0), (None, 3.0), (None, None)], "a double, b double")
    worst, name = scoring.most_abnormal({"a": F.col("a"), "b": F.col("b")})
    used, log_prob, p = scoring.best_of_two_stats(("a", F.col("a")), ("b", F.col("b")))
    assert [tuple(r) for r in two.select(worst, name, used, log_prob, p).collect()] == [(0.0, None, "a", 0.0, 1.0), (2.0, "a", "a", 2.0, math.exp(-2)), (3.0, "b", "b", 3.0, math.exp(-3)), (0.0, None, "none", 0.0, 1.0)]


def test_periods(spark):
    one = spark.createDataFrame([(1_772_496_000_123, 1_775_000_000_000)], "a long, b long")  # 2026-03-03 and 2026-03-31
    assert [periods.period_range(one, "a", "b", u).count() for u in ("day", "week", "month")] == [29, 5, 1]
    got = one.select(periods.shifted(periods.period_start(F.col("a"), "month"), "month", -1).alias("m"), periods.periods_between(F.col("a"), F.col("b"), "day").alias("d")).first()
    assert (got["m"], got["d"]) == (1_769_904_000_000, 28)
    with pytest.raises(ValueError):
        periods.located(one, "a", "day", 7_000_000)
    p = spark.createDataFrame([("s", 0, 10, False, 0, "x"), ("s", 20, 30, True, 0, "y"), ("s", 40, 50, None, 0, None)], "source_id string, start long, end long, exclude boolean, status int, comment string")
    assert rows(periods.within(p, 5, 50), "start") == [(20,), (40,)] and rows(periods.for_training(p), "start") == [(0,), (40,)]
    assert rows(periods.for_training(p, p.where("start = 0")), "start") == [(40,)]
    changed = periods.with_metadata(p, spark.createDataFrame([("s", 0, True, None, "new")], "source_id string, start long, exclude boolean, status int, comment string"))
    assert rows(changed.where("start = 0"), "exclude", "status", "comment") == [(True, 0, "new")] and changed.count() == 3
    with pytest.raises(Exception):
        periods.in_order(spark.createDataFrame([("s", 1), ("s", 1)], "source_id string, serial long"), ["source_id"]).collect()
    runs = periods.stored_runs(spark.createDataFrame([("s", HOUR * i, f) for i, f in ((0, "a"), (1, "a"), (3, "a"), (5, "b"), (9, "c"))], "source_id string, frame long, file string"), HOUR, "file")
    assert [r["run"] for r in runs.orderBy("frame").collect()] == [1, 1, 2, 2, 3]
    cover = spark.createDataFrame([([1.0, 0.5, 0.0],), ([0.25],)], "v array<double>").select(periods.folded_coverage(F.col("v")).alias("c")).collect()
    assert [r["c"] for r in cover] == [0.375, 0.25]
    moved = periods.realigned(spark.createDataFrame([(HOUR + 600_000, HOUR + 1_200_000, 1.0)], "a long, b long, c double"), "a", "b", "c", HOUR).first()
    assert tuple(moved) == (HOUR, 2 * HOUR, pytest.approx(1 / 6))
    days = spark.createDataFrame([("f", i, d) for i, d in enumerate([360, 361, 2, 365, 3, 100])], "file string, line_no long, d int")
    assert [r["year"] for r in periods.rolled_years(days, ["file"], "line_no", F.col("d"), 2025).orderBy("line_no").collect()] == [2025, 2025, 2026, 2025, 2026, 2026]


def test_statistics(spark):
    df = spark.createDataFrame([("s", "a", 0), ("s", "b", 600_000), ("s", "a", 1_900_000), ("s", "a", 9_000_000)], "source_id string, message_id string, ms long")
    got = statistics.stream_statistics(df, 1_800_000).first()
    assert (got["messages"], got["ids"], got["separators"], got["mean_gap_ms"], got["max_gap_ms"], got["mean_n"], got["max_span_ms"]) == (4, 2, 1, 950_000, 1_300_000, 2.0, 1_900_000)
    rate = statistics.rate_summary(df).first()
    assert (rate["slots"], rate["zeros"], rate["min_n"], rate["max_n"], rate["mean_n"]) == (16, 12, 0, 1, 0.25) and rate["sd_n"] == pytest.approx(math.sqrt(3) / 4)
    w = statistics.message_rates(df, (1, 24), F.col("message_id") == "b").where("slots = 24").first()
    assert (w["n"], w["n_ids"], w["n_wrapper"], w["wrapper_ids"]) == (3, 1, 1, 1)


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0, None, 4.0], [2.0, 1.0, 5.0, 8.0])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    got = df.select(vectors.dot(a, b), vectors.l1(a, b), vectors.l2(a, b), vectors.hamming(a, b), vectors.pearson(a, b), vectors.order_of(b), vectors.kth(a, 2), vectors.kth(a, 9), vectors.plus(a, b, -1.0), vectors.times(a, b), vectors.scaled(a, 2.0), vectors.scaled_pearson(a, b)).first()
    x, y = [1, 2, 4], [2, 1, 8]
    mx, my = sum(x) / 3, sum(y) / 3
    r = sum((p - mx) * (q - my) for p, q in zip(x, y, strict=True)) / math.sqrt(sum((p - mx) ** 2 for p in x) * sum((q - my) ** 2 for q in y))
    assert list(got) == [36.0, 6.0, pytest.approx(math.sqrt(18)), 4, pytest.approx(r), [1, 0, 2, 3], 2.0, None, [-1.0, 1.0, None, -4.0], [2.0, 2.0, None, 32.0], [2.0, 4.0, None, 8.0], pytest.approx((1 - r) / 2)]
    e = spark.createDataFrame([([("b", 1), ("a", 3), ("b", 0)],)], "e array<struct<key:string,value:int>>")
    order = lambda **k: [tuple(x) for x in e.select(vectors.sorted_by_key(F.col("e"), **k)).first()[0]]
    assert order() == [("a", 3), ("b", 1), ("b", 0)] and order(by_value=True) == [("a", 3), ("b", 0), ("b", 1)] and order(descending=True) == [("b", 1), ("b", 0), ("a", 3)]
    m = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 0, 2.0), (1, 1, 1.0)], "i int, j int, v double")
    assert rows(vectors.matrix_product(m, m), "i", "j", "v") == [(0, 0, 5.0), (0, 1, 4.0), (1, 0, 4.0), (1, 1, 5.0)]
    assert vectors.asymmetric_cells(m).count() == 0 and vectors.asymmetric_cells(m.where("i <= j")).count() == 2 and rows(vectors.not_dominant(m), "i") == [(0,), (1,)]
    assert rows(vectors.row_sums(m), "i", "v") == [(0, 3.0), (1, 3.0)] and rows(vectors.column_sums(m.where("i = 0")), "j", "v") == [(0, 1.0), (1, 2.0)]


def test_times(spark):
    d = {"P1W": 604_800_000, "P1DT2H3M4.5S": 93_784_500, "PT0.001S": 1, "-PT1M": -60_000, "P": None, "PT": None, "1 day": None, "P1.5D": None}
    got = spark.createDataFrame([(t,) for t in d], "t string").select("t", times.duration_ms(F.col("t")).alias("x")).collect()
    assert {r["t"]: r["x"] for r in got} == d
    shown = spark.createDataFrame([(0,), (93_784_500,), (-61_000,), (86_400_000,)], "x long").select(times.duration_text(F.col("x")).alias("x")).collect()
    assert [r["x"] for r in shown] == ["0 s", "1 days 2 h 3 min 4.500 s", "-1 min 1 s", "1 days"]
    spring = 1_774_742_400_000 + 6 * HOUR  # 2026-03-29, when Berlin goes to summer time
    day = spark.createDataFrame([(spring,)], "ms long").select(times.day_start(F.col("ms"), "Europe/Berlin"), times.day_end(F.col("ms"), "Europe/Berlin"), times.days_later(F.col("ms"), -1, "Europe/Berlin"), times.shown(F.col("ms"), "HH:mm", "Europe/Berlin")).first()
    assert (day[1] - day[0] + 1, spring - day[2], day[3]) == (23 * HOUR, 23 * HOUR, "08:00")
    z = spark.createDataFrame([("europe/berlin",), ("+01:00",), ("Nowhere",), (None,)], "z string").select(times.known_zone(F.col("z")).alias("k")).collect()
    assert [r["k"] for r in z] == [True, True, False, False]
    n = spark.createDataFrame([("[1, -2]",), ("[]",)], "t string").select(times.numbers_of(F.col("t")).alias("n"), times.numbers_text(times.numbers_of(F.col("t"))).alias("t")).collect()
    assert [(r["n"], r["t"]) for r in n] == [([1, -2], "[1, -2]"), ([], "[]")]
    off = times.source_offsets(spark.createDataFrame([("s", 60, 1), ("s", -570, 2), ("s", None, 3)], "source_id string, m int, at long"), "m", "at")
    assert rows(off, "source_id", "offset") == [("s", "-09:30")]


def test_reference_data(spark):
    g = spark.createDataFrame([("A",), ("b",)], "group_name string")
    assert rows(relational.without_groups(g, ["B"]), "group_name") == [("A",)]
    with pytest.raises(ValueError):
        relational.without_groups(g, ["c"])
    with pytest.raises(KeyError):
        relational.renamed(g, {"x": "y"})
    old = spark.createDataFrame([("o1", "a"), ("o1", "b"), ("o2", "c"), ("o3", "d"), ("o3", "e"), ("o4", "z")], "id string, member string")
    new = spark.createDataFrame([("n1", "a"), ("n1", "b"), ("n2", "c"), ("n2", "x"), ("n3", "d"), ("n4", "e")], "id string, member string")
    assert [(r["id"], r["change"], r["names"]) for r in relational.evolution(old, new).orderBy("id").collect()] == [("o1", "unchanged", ["n1"]), ("o2", "contained", ["n2"]), ("o3", "split", ["n3", "n4"]), ("o4", "split", [])]
    m = relational.managed_systems(spark.createDataFrame([("s", "linux", None, 1), ("s", None, "+01:00", 2), ("s", None, None, 3)], "source_id string, os_name string, offset string, at long"), "at")
    assert rows(m, "source_id", "os_name", "offset") == [("s", "linux", "+01:00")]


def test_lagged_and_whole_summaries(spark):
    df = spark.createDataFrame([("k", i * 40_000_000, i) for i in range(6)], "k string, at long, v int")
    assert [r["p"] for r in framing.lagged(df, ["k"], "at", "v", "p").orderBy("at").collect()] == [None, 0, 1, 2, 3, 4]
    m = spark.createDataFrame([("s", "a", 5, 1, "calm", 2, 3, 1), ("s", "a", 1, 2, None, 1, None, None), ("s", "a", 9, 3, "fatal error", 4, 1, 0), ("s", "a", 10, 4, "fatal failure", 0, 1, 0)], "source_id string, message_id string, ms long, instance_id long, text string, severity int, cnt int, cnt_failed int")
    got = training.message_summaries(m, 600_000).first()
    assert (got["n"], got["failed"], got["severity"], got["critical"], got["sample"]) == (6, 1, 1, 2, "fatal error")
    assert training.message_summaries(m.limit(0), 600_000).count() == 0
