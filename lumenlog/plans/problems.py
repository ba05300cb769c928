"""Queries pN_... of the general operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.functions.ids import plain_id
from lumenlog.operators.hotkeys import tree_aggregate
from lumenlog.operators.loglines import entries, entry_heads
from lumenlog.operators.records import MESSAGE_EXPORT, judged
from lumenlog.operators.timestamps import utc_millis
from lumenlog.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of messages whose date stands for exactly one instant."""
    got = utc_millis(table(spark, folder, "messages").select("instance_id", "source_id", "date_text", "ts"), table(spark, folder, "sources"))
    return got.where("utc_ms is not null").select("instance_id", "utc_ms")


def _keys() -> Column:
    """Every row counts for its source, its message id, and the pair of both."""
    source, message, none = plain_id("source_id"), plain_id("message_id"), F.lit(None).cast("string")
    kinds = (("source", source, none), ("message", none, message), ("source and message", source, message))
    return F.explode(F.array(*[F.struct(F.lit(k).alias("key_kind"), s.alias("source_id"), m.alias("message_id")) for k, s, m in kinds])).alias("k")


def p3_key_results(spark: SparkSession, folder: str) -> DataFrame:
    """Complete results per source, per message id and per pair of both, of both tables (null: rows without the id)."""
    m = table(spark, folder, "messages").select(
        F.lit("messages").alias("record_kind"), _keys(),
        F.col("cnt").cast("long").alias("n"), F.col("cnt_failed").cast("long").alias("failed"), "severity", F.expr("unix_micros(ts)").alias("at"), F.length("text").cast("long").alias("chars"),
    )
    i = table(spark, folder, "interval_messages").select(
        F.lit("interval_messages").alias("record_kind"), _keys(),
        F.col("num_occurrences").cast("long").alias("n"), F.lit(None).cast("long").alias("failed"), "severity", F.expr("unix_micros(interval_start)").alias("at"), F.lit(None).cast("long").alias("chars"),
    )
    # The tables are counted by their footers; every row counts for three keys.
    n_rows = 3 * sum(table(spark, folder, t).count() for t in ("messages", "interval_messages"))
    rows = m.unionByName(i).select("record_kind", "k.key_kind", "k.source_id", "k.message_id", "n", "failed", "severity", "at", "chars")
    return tree_aggregate(
        rows, ["record_kind", "key_kind", "source_id", "message_id"],
        {"n_rows": ("count", None), "sum_n": ("sum", "n"), "sum_failed": ("sum", "failed"), "max_n": ("max", "n"), "max_severity": ("max", "severity"), "first_us": ("min", "at"), "last_us": ("max", "at"), "sum_chars": ("sum", "chars")},
        chunks=max(1, -(-n_rows // 131_072)),
    )


P3_SQL = """
with r as (
  select 'messages' record_kind, nullif(lower(trim(source_id, ' \t\r\n')), '') s, nullif(lower(trim(message_id, ' \t\r\n')), '') m, cnt n, cnt_failed failed, severity, epoch_us(ts) as at_us, length(text) chars from messages
  union all select 'interval_messages', nullif(lower(trim(source_id, ' \t\r\n')), ''), nullif(lower(trim(message_id, ' \t\r\n')), ''), num_occurrences, null, severity, epoch_us(interval_start), null from interval_messages),
k as (
  select *, 'source' key_kind, s source_id, cast(null as varchar) message_id from r
  union all select *, 'message', null, m from r
  union all select *, 'source and message', s, m from r)
select record_kind, key_kind, source_id, message_id, count(*) n_rows, cast(sum(n) as bigint) sum_n, cast(sum(failed) as bigint) sum_failed, cast(max(n) as bigint) max_n, max(severity) max_severity,
  min(at_us) first_us, max(at_us) last_us, cast(sum(chars) as bigint) sum_chars
from k group by record_kind, key_kind, source_id, message_id
"""


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """One row per log entry."""
    return entry_heads(table(spark, folder, "log_lines")).select("file", "line_no", "n_lines", "stamp", "severity", "component", "msg_chars")


def p6_entries(spark: SparkSession, folder: str) -> DataFrame:
    """One row per log entry with its whole message."""
    return entries(table(spark, folder, "log_lines"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records that can't be loaded, with the reason."""
    return judged(table(spark, folder, "raw_records").select("record_no", "record"), MESSAGE_EXPORT).where("reason is not null").select("record_no", "reason")


def p7_broken(spark: SparkSession, folder: str) -> DataFrame:
    """Records that can't be loaded, with the reason and the first broken field (null where what follows the last field is wrong)."""
    return judged(table(spark, folder, "raw_records").select("record_no", "record"), MESSAGE_EXPORT).where("reason is not null").select("record_no", "reason", "broken")


def p7_loaded(spark: SparkSession, folder: str) -> DataFrame:
    """The good records as typed rows."""
    return judged(table(spark, folder, "raw_records"), MESSAGE_EXPORT).where("reason is null").select("record_no", "row.*")


_ANY = r'(?:"(?:[^"]|"")*"|[^",]*)'
_CELLS = "abcdefg"
_JUDGED = rf"""
with r as (select record_no, file, record, regexp_matches(record, '(?s)\A{_ANY}(?:,{_ANY})*\z') quoted, regexp_matches(record, '(?s)\A{_ANY}(?:,{_ANY}){{6}}\z') wide from raw_records),
s as (select record_no, quoted, wide, case when wide then regexp_extract(record, '(?s)\A{",".join([f"({_ANY})"] * 7)}\z', ['a', 'b', 'c', 'd', 'e', 'f', 'g']) end x from r),
v as (select record_no, quoted, wide, {", ".join(f"case when x.{c} like chr(34) || '%' then replace(x.{c}[2:-2], chr(34) || chr(34), chr(34)) else x.{c} end {c}" for c in _CELLS)} from s),
j as (select *, case when not quoted then 'quoting' when not wide then 'columns'
  when not regexp_matches(a, '\A[^ \t\r\n\f\v]{{1,200}}\z') or not regexp_matches(b, '\A[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}} [0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}\z') or try_strptime(b, '%Y-%m-%d %H:%M:%S') is null
    or not regexp_matches(e, '\A[0-4]\z') or not regexp_matches(f, '\A0*[1-9][0-9]*\z') then 'value' end reason from v)
"""
P7_SQL = _JUDGED + "select record_no, reason from j where reason is not null"
P7_LOADED_SQL = _JUDGED + "select record_no, a source_id, b ts, c message_id, d component_id, cast(e as integer) severity, cast(f as bigint) cnt, g as text from j where reason is null"

QUERIES = {"p1_found": p1_found, "p3_key_results": p3_key_results, "p6_found": p6_found, "p6_entries": p6_entries, "p7_found": p7_found, "p7_broken": p7_broken, "p7_loaded": p7_loaded}
SQL = {"p3_key_results": P3_SQL, "p7_found": P7_SQL, "p7_loaded": P7_LOADED_SQL}
