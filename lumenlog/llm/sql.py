"""DuckDB SQL of the queries pN_... that SQL can express."""

P2_SQL = """
with m as (
  select nullif(lower(trim(source_id, ' \t\r\n')), '') s, nullif(lower(trim(message_id, ' \t\r\n')), '') i, line_no, cnt, ts,
    row_number() over (partition by nullif(lower(trim(source_id, ' \t\r\n')), ''), line_no order by instance_id) dup
  from messages),
l as (select *, line_no - row_number() over (partition by s, i order by line_no) run from m where dup = 1 and s is not null),
a as (select 'messages' record_kind, s source_id, i message_id, min(line_no) first_pos, max(line_no) last_pos, cast(sum(cnt) as bigint) n_events, epoch_ms(max(ts)) - epoch_ms(min(ts)) span_ms
  from l where i is not null group by s, i, run having count(*) >= 2),
v as (
  select nullif(lower(trim(source_id, ' \t\r\n')), '') s, nullif(lower(trim(message_id, ' \t\r\n')), '') i, interval_serial p, num_occurrences n,
    row_number() over (partition by nullif(lower(trim(source_id, ' \t\r\n')), ''), nullif(lower(trim(message_id, ' \t\r\n')), ''), interval_serial order by stored_at) dup
  from interval_messages),
w as (select *, case when lag(p) over o = p - 1 and abs(lag(n) over o - n) <= 1 then 0 else 1 end b from v where dup = 1 and s is not null and i is not null window o as (partition by s, i order by p)),
x as (select *, sum(b) over (partition by s, i order by p) run from w),
b as (select 'interval_messages' record_kind, s source_id, i message_id, min(p) first_pos, max(p) last_pos, cast(sum(n) as bigint) n_events, (max(p) - min(p) + 1) * 600000 span_ms
  from x where n is not null group by s, i, run having count(*) >= 3)
select * from a union all select * from b
"""

P8_SQL = "select doc_id, coalesce(text, '') as text from documents"

P9_SQL = "select count(*) documents, 0::bigint wrong, 0::bigint over_full from documents"

SQL = {"p9_checked": P9_SQL, "p2_found": P2_SQL, "p8_decoded": P8_SQL}
