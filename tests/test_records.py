import datetime
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from lumenlog.operators.records import MESSAGE_EXPORT, Field, judged


def verdict(record):
    """The rules, character by character."""
    fields, i, n = [], 0, len(record)
    while True:
        if record[i : i + 1] == '"':
            j, text = i + 1, ""
            while True:
                k = record.find('"', j)
                if k < 0:
                    return "quoting"
                text += record[j:k]
                if record[k + 1 : k + 2] == '"':
                    text, j = text + '"', k + 2
                    continue
                i = k + 1
                break
            if i < n and record[i] != ",":
                return "quoting"
            fields.append(text)
        else:
            k = record.find(",", i)
            end = n if k < 0 else k
            if '"' in record[i:end]:
                return "quoting"
            fields.append(record[i:end])
            i = end
        if i >= n:
            break
        i += 1
    if len(fields) != 7:
        return "columns"
    s, ts, _, _, severity, cnt, _ = fields
    ok = 1 <= len(s) <= 200 and not re.search(r"\s", s) and re.fullmatch(r"[0-4]", severity) and re.fullmatch("[0-9]+", cnt) and int(cnt) > 0
    try:
        ok = ok and re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}", ts) and datetime.datetime.strptime(ts, "%Y-%m-%d %H:%M:%S")
    except ValueError:
        ok = False
    return None if ok else "value"


GOOD = 's1,2025-10-15 00:24:53,m_1,c,1,1,text'
FIXED = [
    GOOD, GOOD.replace("text", '"a ""quoted"" text, with\ncommas"'), GOOD.replace("text", ""), GOOD.replace("text", '""'), '"s1","2025-10-15 00:24:53","m","c","0","12","x"', "", ",,,,,,", GOOD + ",more", GOOD + '"', GOOD.replace("text", 'te"xt'),
    GOOD.replace("text", '"open'), GOOD.replace("text", '"shut" x'), GOOD.replace(",1,1,", ",5,1,"), GOOD.replace(",1,1,", ",1,0,"), GOOD.replace(",1,1,", ",1,007,"), GOOD.replace(",1,1,", ",1,-3,"), GOOD.replace(",1,1,", ",1,1.0,"), GOOD.replace("10-15", "02-29"),
    GOOD.replace("2025-10-15", "2024-02-29"), GOOD.replace("2025-10-15", "1900-02-29"), GOOD.replace("2025-10-15", "2000-02-29"), GOOD.replace("00:24", "24:00"), GOOD.replace("s1", "s 1"), GOOD.replace("s1", "s" * 200), GOOD.replace("s1", "s" * 201), GOOD.replace("s1", "s 1"), GOOD.replace("s1", '"s,1"'), GOOD.replace("text", "x" * 300_000), GOOD.replace("text", '"' + '""x' * 60_000 + '"'),
    ";".join(GOOD.split(",")), "\n" + GOOD, GOOD + "\n", GOOD.replace("2025", "٢025"), '"s""1"' + GOOD[2:], '"s,"""' + GOOD[2:],
]


def _judge(spark, records):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(records)], "record_no long, record string")
    return {r["record_no"]: r for r in judged(df, MESSAGE_EXPORT).collect()}


def test_fixed_records(spark):
    got = _judge(spark, FIXED)
    assert [(i, FIXED[i][:60], got[i]["reason"]) for i in got if got[i]["reason"] != verdict(FIXED[i])] == []
    row = got[1]["row"]
    assert (row["source_id"], row["severity"], row["cnt"], row["text"]) == ("s1", 1, 1, 'a "quoted" text, with\ncommas')
    assert got[12]["broken"] == "severity" and got[0]["broken"] is None


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(st.sampled_from(['"', ",", "a", "1", "\n", " ", 's1,2025-10-15 00:24:53,"m",c,1,1', '""']), max_size=9).map("".join), min_size=25, max_size=60))
def test_against_the_rules(spark, records):
    got = _judge(spark, records)
    assert [(r, got[i]["reason"]) for i, r in enumerate(records) if got[i]["reason"] != verdict(r)] == []


def test_fields_hold_any_character(spark):
    """Every control character, in quoted and plain fields, comes out as it went in."""
    odd = [chr(c) for c in [*range(1, 32), 127, 0x85, 0xA0, 0x2028, 0xFFFD] if chr(c) not in ",\""]
    records = [f's1,2024-01-01 00:00:00,m{c}x,"c{c},{c}",2,3,hello{c}world' for c in odd]
    got = _judge(spark, records)
    assert [got[i]["reason"] for i in range(len(odd))] == [None] * len(odd)
    assert [(r["message_id"], r["component_id"], r["severity"], r["cnt"], r["text"]) for r in (got[i]["row"] for i in range(len(odd)))] == [(f"m{c}x", f"c{c},{c}", 2, 3, f"hello{c}world") for c in odd]


def test_empty_first_field(spark):
    df = spark.createDataFrame([(",b",), ('"",""',)], "record string")
    assert [tuple(r["row"]) for r in judged(df, (Field("a"), Field("b"))).collect()] == [("", "b"), ("", "")]


def test_nulls_clashes_empty(spark):
    df = spark.createDataFrame([(None, "x", 1)], "record string, reason string, row int")
    got = judged(df, MESSAGE_EXPORT)
    assert got.columns == ["record", "reason", "broken", "row"] and got.collect()[0]["reason"] == "columns"
    assert judged(df.limit(0), MESSAGE_EXPORT).count() == 0


def test_broken_fields_come_out_of_a_query(spark, tmp_path):
    from lumenlog.plans import problems

    bad = [GOOD.replace(",1,1,", ",5,1,"), GOOD.replace("10-15", "02-30"), GOOD.replace("text", 'te"xt'), "s1,2025-10-15 00:24:53", GOOD + ",more"]
    spark.createDataFrame(list(enumerate([*bad, GOOD])), "record_no long, record string").write.parquet(str(tmp_path / "raw_records.parquet"))
    got = {r["record_no"]: (r["reason"], r["broken"]) for r in problems.QUERIES["p7_broken"](spark, str(tmp_path)).collect()}
    assert got == {0: ("value", "severity"), 1: ("value", "ts"), 2: ("quoting", "text"), 3: ("columns", "message_id"), 4: ("columns", None)}
