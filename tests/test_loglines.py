import random
import re

import pytest

from lumenlog.operators.loglines import entries, entry_heads

LINES = [
    ("a", 1, "stray continuation"), ("a", 2, "<14>1 2026-03-29T10:31:54.535-04:00 h postrelay 12 ID7 [o@1 x=\"26\"][p@1 y=\"a\\]b\"] hello there"), ("a", 3, "\tat x.Y.z(Y.java:3)"), ("a", 4, ""), ("a", 5, "Mar 28 07:34:33 h -- MARK --"),
    ("a", 6, "<109>Mar  8 07:37:03 h sched[15]: out: of memory"), ("a", 7, "Mar 28 07:37:03 h free text only"), ("a", 8, "[Mon Dec 15 09:00:34.650367 2025] [core:warn] [pid 19675] boom"), ("a", 9, "ts=2026-01-30T09:53:18.055Z trace=\"a b\" level=err app=ledger msg=\"say \\\"hi\\\"\" dur=3ms"),
    ("b", 1, '{"ts": 1762, "lvl": "CRITICAL", "svc": "x", "message": "caf\\u00e9 \\"q\\"", "thread": 2}'), ("b", 2, "2025-11-05 04:04:35,268 [pool-2-thread-0] TRACE c.bug.Q - lease"), ("b", 3, "  seen at 2025-12-04 10:03:11 by x"), ("b", 4, "25/06/08 14:37:39 SEVERE Exec: go"), ("b", 5, "E1101 06:43:12.353746   15401 jij.go:231] bad"),
    ("b", 6, "2025.11.05 04:14:49 | D | quota | fine"), ("c", 1, "no head at all"), ("d", 1, None), (None, 1, "x"),
]
WANT = {
    ("a", 2): (3, "2026-03-29T10:31:54.535-04:00", 1, "postrelay", "hello there\n\tat x.Y.z(Y.java:3)\n"), ("a", 5): (1, "Mar 28 07:34:33", 0, "", "-- MARK --"), ("a", 6): (1, "Mar  8 07:37:03", 1, "sched", "out: of memory"), ("a", 7): (1, "Mar 28 07:37:03", 0, "", "free text only"),
    ("a", 8): (1, "Mon Dec 15 09:00:34.650367 2025", 2, "core", "boom"), ("a", 9): (1, "2026-01-30T09:53:18.055Z", 3, "ledger", 'say "hi"'), ("b", 1): (1, "1762", 4, "x", 'café "q"'), ("b", 2): (2, "2025-11-05 04:04:35,268", 1, "c.bug.Q", "lease\n  seen at 2025-12-04 10:03:11 by x"),
    ("b", 4): (1, "25/06/08 14:37:39", 3, "Exec", "go"), ("b", 5): (1, "1101 06:43:12.353746", 3, "jij.go", "bad"), ("b", 6): (1, "2025.11.05 04:14:49", 1, "quota", "fine"),
}


@pytest.mark.parametrize("block", [1, 3, 8192])
def test_entries(spark, block):
    df = spark.createDataFrame(LINES, "file string, line_no long, line string").selectExpr("*", "1 as start", "'x' as head")
    heads = {(r["file"], r["line_no"]): (r["n_lines"], r["stamp"], r["severity"], r["component"], r["msg_chars"]) for r in entry_heads(df, block).collect()}
    assert heads == {k: (*v[:4], len(v[4])) for k, v in WANT.items()}
    whole = {(r["file"], r["line_no"]): (r["n_lines"], r["stamp"], r["severity"], r["component"], r["message"]) for r in entries(df, block).collect()}
    assert whole == WANT


def test_long_and_empty(spark):
    df = spark.createDataFrame([("f", 1, "Mar 28 07:37:03 h c: " + "é" * 200_000), ("f", 2, "x" * 100_000)], "file string, line_no long, line string")
    assert entry_heads(df).collect()[0]["msg_chars"] == 300_001
    assert entry_heads(df.limit(0)).count() == 0


BROKEN = ["[Mon Jan 01 10:00:00 2024] [core warn] hello", "E0102 10:00:00.123 12 file.cc:33]no blank", '{"ts": "2024-01-01", broken}', "2024-01-01 10:00:00,1 [t] INFO a.b -no blank", "<14>1 2024-01-01T00:00:00Z h app"]


def test_lines_that_only_begin_like_a_head(spark):
    lines = [("f", 1, "25/06/08 14:37:39 INFO Exec: go"), *[("f", i, x) for i, x in enumerate(BROKEN, 2)]]
    df = spark.createDataFrame(lines, "file string, line_no long, line string")
    got = entries(df).collect()
    assert [(r["line_no"], r["n_lines"], r["message"]) for r in got] == [(1, 6, "\n".join(["go", *BROKEN]))]
    assert entry_heads(df).collect()[0]["msg_chars"] == len(got[0]["message"])
    assert entries(df.where("line_no > 1")).count() == 0


def test_every_control_character(spark):
    odd = [chr(c) for c in range(1, 32) if chr(c) not in "\t\n\x0b\x0c\r"]
    lines = [(f"f{ord(c)}", k, x) for c in odd for k, x in ((1, f"2024-01-01 10:00:00,1 [t] WARN a{c}b - hi {c} there"), (2, f"x{c}"))]
    got = {r["file"]: r for r in entries(spark.createDataFrame(lines, "file string, line_no long, line string")).collect()}
    assert {f: (r["severity"], r["component"], r["message"]) for f, r in got.items()} == {f"f{ord(c)}": (2, f"a{c}b", f"hi {c} there\nx{c}") for c in odd}


_MD = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) {1,2}\d{1,2} \d\d:\d\d:\d\d"
PLAIN = [
    (rf"(?:<(?P<p>\d{{1,3}})>)?(?P<s>{_MD}) \S+ (?P<m>-- MARK -- ?)", None),
    (rf"(?:<(?P<p>\d{{1,3}})>)?(?P<s>{_MD}) \S+ (?P<c>[^\s:\[\]]+)(?:\[[^\]\s]*\])?:(?: (?P<m>.*))?", None),
    (rf"(?:<(?P<p>\d{{1,3}})>)?(?P<s>{_MD}) \S+(?: (?P<m>.*))?", None),
    (r"(?P<s>\d\d/\d\d/\d\d \d\d:\d\d:\d\d) +(?P<l>[A-Za-z]+) +(?P<c>[^\s:]+):(?: (?P<m>.*))?", None),
    (r"(?P<s>\d{4}-\d\d-\d\d \d\d:\d\d:\d\d[,.]\d{1,9}) \[[^\]]*\] +(?P<l>[A-Za-z]+) +(?P<c>\S+) -(?: (?P<m>.*))?", None),
]
WORDS = {"debug": 1, "info": 1, "warn": 2, "error": 3, "severe": 3, "fatal": 4}


def plain_entries(lines):
    """The same cascade line by line, with a list of patterns tried one after the other."""
    out = []
    for k, line in enumerate(lines, 1):
        got = next((m for p, _ in PLAIN if (m := re.fullmatch(p, line, re.S | re.A))), None)
        if got:
            d = got.groupdict()
            severity = [4, 4, 4, 3, 2, 1, 1, 1][int(d["p"]) % 8] if d.get("p") else WORDS.get((d.get("l") or "").lower(), 0)
            out.append([k, 1, d["s"], severity, d.get("c") or "", d["m"] or ""])
        elif out:
            out[-1][1] += 1
            out[-1][5] += "\n" + line
    return [tuple(x) for x in out]


def test_against_plain_parser(spark):
    r = random.Random(5)
    bits = ["Mar  8 07:37:03", "<13>", "h", "-- MARK --", "25/06/08 14:37:39", "2024-01-01 10:00:00,1", "[t]", "INFO", "severe", "a.b", "-", "app[1]:", "app:", ":", "x y", "", "\x01"]
    files = {f"f{i}": [" ".join(r.choices(bits, k=r.randint(0, 7))).replace("<13> ", "<13>") if r.random() < 0.5 else r.choice(["Mar  8 07:37:03 h a[1]: b", "25/06/08 14:37:39 WARN X: y", "2024-01-01 10:00:00,1 [t] INFO a - z", "more", ""]) for _ in range(40)] for i in range(30)}
    df = spark.createDataFrame([(f, k, x) for f, lines in files.items() for k, x in enumerate(lines, 1)], "file string, line_no long, line string")
    got = {f: [] for f in files}
    for e in entries(df, 7).orderBy("line_no").collect():
        got[e["file"]].append((e["line_no"], e["n_lines"], e["stamp"], e["severity"], e["component"], e["message"]))
    assert got == {f: plain_entries(lines) for f, lines in files.items()}
