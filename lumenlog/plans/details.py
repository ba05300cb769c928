"""Queries of rules on lines, statistics, periods, vectors, dates and upkeep of reference data, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.functions import text as T
from lumenlog.functions import times, vectors
from lumenlog.functions.ids import plain_id
from lumenlog.operators import framing, lines, periods, relational, scoring, statistics, templates, training
from lumenlog.plans.analytics import _CO, E, HOUR, S, _cell, _SCORES, events, hourly, registry
from lumenlog.sources.tables import table

QUERIES, SQL, query = registry()

_ID = "nullif(lower(trim({}, ' \t\r\n')), '')"


def _normal(x: str) -> str:
    for pattern, value in T.REPLACEMENTS:
        x = f"regexp_replace({x}, '{pattern}', '{value}', 'g')"
    return x


_COMMAND = lines.COMMAND.replace("'", "''")
_SAID = f"trim(array_to_string(list_transform(regexp_extract_all(g, '{_COMMAND}')[1:5], lambda p: trim(concat_ws(' ', regexp_extract(p, '{_COMMAND}', 1), trim(regexp_extract(p, '{_COMMAND}', 2))))), ' '))"


@query(rf"""with a as (select instance_id, component_id c, text t, case when lower(component_id) = 'sudo' and regexp_matches(text, '(?s)\A([^:]+):.*COMMAND=(.*)\z') then 'sudo' when lower(component_id) = '/usr/sbin/cron' and regexp_matches(text, '(?s)\A(\([^)]+\))? CMD \((.*)\) ?\z') then 'cron' when lower(component_id) = 'puppet-agent' and regexp_matches(text, '\([^)]*\)') then 'puppet' end k from messages),
b as (select *, case k when 'sudo' then {_normal("regexp_extract(t, '(?s)\\A([^:]+):.*COMMAND=(.*)\\z', 2)")} when 'cron' then {_normal("regexp_extract(t, '(?s)\\A(\\([^)]+\\))? CMD \\((.*)\\) ?\\z', 2)")} when 'puppet' then {_normal("regexp_extract(t, '\\(([^)]*)\\)', 1)")} end g from a)
select instance_id, case k when 'sudo' then left(trim(trim(c) || '(' || trim(regexp_extract(t, '(?s)\A([^:]+):.*COMMAND=(.*)\z', 1)) || '):' || {_SAID}), 120) when 'cron' then left(trim(c || regexp_extract(t, '(?s)\A(\([^)]+\))? CMD \((.*)\) ?\z', 1) || ':' || {_SAID}), 120) when 'puppet' then c || ':' || left(g, 100) else c end component from b""")
def command_components(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "messages").select("instance_id", lines.component(F.col("component_id"), F.col("text")).alias("component"))


@query()
def wrapper_messages(spark: SparkSession, folder: str) -> DataFrame:
    m = table(spark, folder, "messages").select("instance_id", "message_id", lines.component(F.col("component_id"), F.col("text")).alias("component_id"))
    return lines.wrappers(m)


_MAGIC = lines.MAGIC


@query(f"select summary_id, array_to_string(list_transform(regexp_extract_all(text_summary, '{_MAGIC}'), lambda w: lower(w)), ' ') words from message_summaries")
def magic_words(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "message_summaries").select("summary_id", F.array_join(lines.magic_words(F.col("text_summary")), " ").alias("words"))


@query("with l as (select file, line_no, nullif(regexp_extract(line, '\\A(?:last )?message repeated (\\d+) times?\\s*\\z', 1), '') n from log_lines), p as (select *, max(case when n is null then line_no end) over (partition by file order by line_no rows between unbounded preceding and current row) own from l) select file, own line_no, greatest(coalesce(sum(cast(n as int)), 1), 1)::bigint cnt from p where own is not null group by 1, 2")
def repeats_added(spark: SparkSession, folder: str) -> DataFrame:
    return lines.repeats_added(table(spark, folder, "log_lines"), ["file"], "line_no", "line").select("file", "line_no", F.col("cnt").cast("long").alias("cnt"))


@query(f"select {_ID.format('m.source_id')} source_id, count(*) n from messages m where {_ID.format('m.source_id')} not in (select source_id from sources where log_type = (select min(log_type) from sources)) group by 1")
def unexpected_sources(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "sources")
    allowed = s.where(F.col("log_type") == s.agg(F.min("log_type").alias("m")).scalar())
    m = table(spark, folder, "messages").select(plain_id("source_id").alias("source_id")).where("source_id is not null")
    return lines.allowed_sources(m, allowed)[1]


@query(rf"with p as (select file, line_no, line, regexp_extract(line, '\A(?:<\d{{1,3}}>)?[A-Z][a-z]{{2}} [ \d]\d \d\d:\d\d:\d\d (\S+) ', 1) host from log_lines), q as (select *, regexp_replace(regexp_replace(line, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}', 'user@example.com', 'g'), '{T._octets(4)}', '127.0.0.1', 'g') m from p) select file, line_no, case when host <> '' then replace(replace(m, 'kernel', 'core'), host, 'system') else line end as masked from q")
def masked_lines(spark: SparkSession, folder: str) -> DataFrame:
    host = F.regexp_extract("line", r"\A(?:<\d{1,3}>)?[A-Z][a-z]{2} [ \d]\d \d\d:\d\d:\d\d (\S+) ", 1)
    return table(spark, folder, "log_lines").select("file", "line_no", lines.masked_line(F.col("line"), host, {"kernel": "core"}).alias("masked"))


@query(f"with {E}, r as (select source_id, ms // 600000 slot, count(*) n from e group by 1, 2), g as (select source_id, epoch_ms(date_trunc('month', make_timestamp(slot * 600000000))) report, max(slot) - min(slot) + 1 slots, count(*) heard, sum(n) n, sum(n * n) q, min(n) lo, max(n) max_n from r group by 1, 2) select source_id, report, slots, round(n / slots, 9) mean_n, case when slots > heard then 0 else lo end min_n, max_n, round(sqrt(greatest(q / slots - (n / slots) * (n / slots), 0)), 6) sd_n, slots - heard zeros from g")
def message_rate_report(spark: SparkSession, folder: str) -> DataFrame:
    """Rates by calendar month, silent slots counted as zeros."""
    got = statistics.rate_summary(events(spark, folder))
    return got.withColumn("mean_n", F.round("mean_n", 9)).withColumn("sd_n", F.round("sd_n", 6)).withColumn("min_n", F.col("min_n").cast("long"))


@query(f"with {E}, b as (select *, ms - lag(ms) over (partition by source_id order by ms) d from e), r as (select *, sum(case when d <= 1800000 then 0 else 1 end) over (partition by source_id order by ms) run from b), g as (select source_id, run, count(*) n, max(ms) - min(ms) span, count(distinct message_id) k from r group by 1, 2), p as (select source_id, count(*) messages, count(distinct message_id) ids, round(avg(d) filter (d <= 1800000), 6) mean_gap_ms, max(d) filter (d <= 1800000) max_gap_ms from r group by 1) select p.*, count(*) - 1 separators, round(avg(n), 6) mean_n, max(span) max_span_ms, round(avg(k), 6) mean_ids from p join g using (source_id) group by all")
def stream_statistics(spark: SparkSession, folder: str) -> DataFrame:
    got = statistics.stream_statistics(events(spark, folder), 1_800_000)
    return got.select(*[F.round(c, 6).alias(c) if c.startswith("mean") else F.col(c) for c in got.columns])


@query(f"with {S}, f as (select source_id, message_id, min(frame) f from s group by 1, 2), v as (select message_id, min(f) v from f group by 1) select s.source_id, s.frame, count(*) n_ids, cast(sum(n) as bigint) n, cast(sum(case when s.frame = f then 1 else 0 end) as bigint) n_new, cast(sum(case when s.frame = v then 1 else 0 end) as bigint) n_never from s join f on s.source_id = f.source_id and s.message_id = f.message_id join v on v.message_id = s.message_id group by 1, 2")
def interval_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return statistics.interval_statistics(hourly(spark, folder))


@query(f"with {E}, g as (select source_id, min(ms) a, max(ms) b from e group by 1) select source_id, epoch_ms(unnest(generate_series(date_trunc('week', make_timestamp(a * 1000)), date_trunc('week', make_timestamp(b * 1000)), interval 7 day))) period from g")
def period_ranges(spark: SparkSession, folder: str) -> DataFrame:
    ends = events(spark, folder).groupBy("source_id").agg(F.min("ms").alias("a"), F.max("ms").alias("b"))
    return periods.period_range(ends, "a", "b", "week").select("source_id", "period")


@query(f"with {S}, d as (select distinct source_id, frame from s) select source_id, frame, epoch_ms(date_trunc('month', make_timestamp(frame * 1000))) period, epoch_ms(date_trunc('month', make_timestamp(frame * 1000)) - interval 1 month) as before, epoch_ms(date_trunc('month', make_timestamp(frame * 1000)) + interval 13 month) as later, (frame - epoch_ms(date_trunc('month', make_timestamp(frame * 1000)))) // 3600000 serial from d")
def located_intervals(spark: SparkSession, folder: str) -> DataFrame:
    d = periods.located(hourly(spark, folder).select("source_id", "frame").distinct(), "frame", "month", HOUR)
    return d.select("source_id", "frame", "period", periods.shifted(F.col("period"), "month", -1).alias("before"), periods.shifted(F.col("period"), "month", 13).alias("later"), "serial")


@query(f"with {S}, d as (select distinct source_id, frame from s), b as (select *, case when frame - lag(frame) over (partition by source_id order by frame) = 3600000 then 0 else 1 end b from d) select source_id, frame, cast(sum(b) over (partition by source_id order by frame) as bigint) run from b")
def stored_runs(spark: SparkSession, folder: str) -> DataFrame:
    got = periods.stored_runs(hourly(spark, folder).select("source_id", "frame").distinct(), HOUR)
    return got.select("source_id", "frame", F.col("run").cast("long").alias("run"))


@query(f"with {E}, g as (select source_id, unnest(range(min(ms) - min(ms) % 600000, max(ms) + 1, 600000)) frame from e group by 1), f as (select g.source_id, g.frame, count(e.ms) n from g left join e on e.source_id = g.source_id and e.ms - e.ms % 600000 = g.frame group by 1, 2), w as (select source_id, frame - 3000000 as start, cast(sum(n) over o as bigint) n, count(*) over o k from f window o as (partition by source_id order by frame rows between 5 preceding and current row)) select source_id, start, n, case when start % 3600000 = 0 then 'REGULAR' else 'CONTINUOUS' end kind from w where k = 6")
def window_kinds(spark: SparkSession, folder: str) -> DataFrame:
    return periods.fragments(events(spark, folder).withColumn("n", F.lit(1)), ["source_id"], "ms", HOUR, 600_000, "n")


@query(f"with {E}, g as (select source_id, min(ms) a, max(ms) b, unnest(range(min(ms) - min(ms) % 600000, max(ms) + 1, 600000)) frame from e group by 1), c as (select source_id, frame, (600000 - greatest(a - frame, 0) - greatest(frame + 600000 - b - 1, 0)) / 600000.0 v from g), h as (select source_id, frame - frame % 3600000 as hour, list(v order by frame) v from c group by 1, 2) select source_id, hour, round(case when len(v) = 1 then v[1] else list_reduce(v, lambda a, x: (a + x) / 2) end, 9) coverage from h")
def joined_coverage(spark: SparkSession, folder: str) -> DataFrame:
    c = framing.coverage(events(spark, folder), ["source_id"], "ms", 600_000)
    h = c.groupBy("source_id", (F.col("frame") - F.pmod("frame", F.lit(HOUR))).alias("hour")).agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "coverage"))), lambda x: x["coverage"]).alias("v"))
    return h.select("source_id", "hour", F.round(periods.folded_coverage(F.col("v")), 9).alias("coverage"))


@query("with v as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) a, list_reverse(list_transform(embedding, lambda x: cast(x as double))) b from embeddings), p as (select *, len(a) n, list_sum(a) x, list_sum(b) y, list_sum(list_transform(a, lambda e: e * e)) xx, list_sum(list_transform(b, lambda e: e * e)) yy, list_sum(list_transform(list_zip(a, b), lambda e: e[1] * e[2])) xy from v) select vec_id, round(xy, 6) inner_product, round(list_sum(list_transform(list_zip(a, b), lambda e: abs(e[1] - e[2]))), 6) l1, round(list_sum(list_transform(list_zip(a, b), lambda e: (e[1] - e[2]) * (e[1] - e[2]))), 6) l2_squared, len(list_filter(list_zip(a, b), lambda e: e[1] <> e[2])) hamming, round((n * xy - x * y) / sqrt((n * xx - x * x) * (n * yy - y * y)), 6) pearson, list_grade_up(a)[1] - 1 least_at, round(list_sort(a)[3], 6) third from p")
def vector_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Each vector against itself read backwards."""
    v = table(spark, folder, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("a")).withColumn("b", F.reverse("a"))
    a, b = F.col("a"), F.col("b")
    return v.select(
        "vec_id", F.round(vectors.dot(a, b), 6).alias("inner_product"), F.round(vectors.l1(a, b), 6).alias("l1"), F.round(vectors.l2_squared(a, b), 6).alias("l2_squared"), vectors.hamming(a, b).cast("long").alias("hamming"), F.round(vectors.pearson(a, b), 6).alias("pearson"),
        F.get(vectors.order_of(a), F.lit(0)).cast("long").alias("least_at"), F.round(vectors.kth(a, 3), 6).alias("third"),
    )


@query(f"with {S}, {_CO}, x as (select a i, b j, joint v from p) select x.i, y.j, cast(sum(x.v * y.v) as bigint) v from x join x y on x.j = y.i group by 1, 2")
def matrix_product(spark: SparkSession, folder: str) -> DataFrame:
    """The matrix of co-occurrences times itself."""
    m = training.cooccurrence(hourly(spark, folder)).select(F.col("a").alias("i"), F.col("b").alias("j"), F.col("joint").alias("v"))
    return vectors.matrix_product(m, m)


@query(f"with {S}, {_CO}, {{}}, x as (select a m, b o, mi from w union all select b, a, mi from w), y as (select x.*, row_number() over (partition by m order by mi desc, o) k from x where split_part(m, '_', 1) <> split_part(o, '_', 1)) select m as message_id, o as other, mi from y where k <= 5".format("d as (select a, b, joint, cast(ca as double) ca, cast(cb as double) cb, cast(n as double) n from q), w as (select a, b, round(case when joint * n >= ca * cb then 1 else -1 end * (" + " + ".join(_cell(*c) for c in (("joint", "ca", "cb"), ("(ca - joint)", "ca", "(n - cb)"), ("(cb - joint)", "(n - ca)", "cb"), ("(n - ca - cb + joint)", "(n - ca)", "(n - cb)"))) + "), 9) + 0.0 mi from d)"))
def top5_relations(spark: SparkSession, folder: str) -> DataFrame:
    """The five strongest relations of each id to ids outside of its cluster (here the kinds of events)."""
    w = training.mutual_information(hourly(spark, folder), HOUR).select("a", "b", (F.round("mi", 9) + 0.0).alias("mi"))
    both = w.select(F.col("a").alias("message_id"), F.col("b").alias("other"), "mi").unionByName(w.select(F.col("b").alias("message_id"), F.col("a").alias("other"), "mi"))
    outside = both.where(F.split("message_id", "_")[0] != F.split("other", "_")[0])
    return relational.first_rows(outside, ["message_id"], [F.desc("mi"), F.col("other")], 5)


@query(f"with {E} select event_id, (case when ms % 2 = 0 then '+' else '-' end) || lpad(cast(ms % 840 // 60 as varchar), 2, '0') || ':' || lpad(cast(ms % 840 % 60 as varchar), 2, '0') as offset_text, ms - ms % 86400000 day_start, ms - ms % 86400000 + 86399999 day_end, strftime(make_timestamp(ms * 1000), '%d.%m.%Y %H:%M') shown from e where ms % 840 > 0")
def date_forms(spark: SparkSession, folder: str) -> DataFrame:
    ms = F.col("ms")
    minutes = F.when(ms % 2 == 0, ms % 840).otherwise(-(ms % 840))
    return events(spark, folder).where("ms % 840 > 0").select("event_id", times.offset_text(minutes).alias("offset_text"), times.day_start(ms).alias("day_start"), times.day_end(ms).alias("day_end"), times.shown(ms, "dd.MM.yyyy HH:mm").alias("shown"))


@query(f"with w as (select distinct {_ID.format('message_id')} word from messages where {_ID.format('message_id')} is not null) select instance_id, w.word from messages m left join w on w.word = {_ID.format('m.message_id')}")
def dictionary_decode(spark: SparkSession, folder: str) -> DataFrame:
    """Message ids encoded by a dictionary and decoded again."""
    m = table(spark, folder, "messages").select("instance_id", plain_id("message_id").alias("w"))
    words = relational.dictionary(m, "w")
    ids = m.join(words.withColumnRenamed("word", "w"), "w", "left").select("instance_id", "id")
    return relational.decoded(ids, words, "id", "word").select("instance_id", "word")


@query(f"with {_SCORES}, i as (select source_id, frame, count(*) n_ids, max(case when rarity > 4.0 then 1 else 0 end) huge from x group by 1, 2) select source_id, frame, n_ids from i where huge = 0")
def trainable_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """Intervals without a message of a score that counts as infinite (here rarities above 4)."""
    m = scoring.message_scores(hourly(spark, folder).select("source_id", "frame", "message_id", "n"), HOUR)
    m = m.withColumn("anomaly", F.when(F.col("rarity") > 4.0, scoring.HUGE).otherwise(F.col("anomaly")))
    return relational.trainable_intervals(scoring.interval_scores(m), m).select("source_id", "frame", "n_ids")


@query(f"with {S}, {_CO}, l as (select message_id from s group by 1 having count(*) > 195) select a, b, joint from p where a in (select message_id from l) and b in (select message_id from l)")
def legal_pairs(spark: SparkSession, folder: str) -> DataFrame:
    s = hourly(spark, folder)
    return relational.legal_pairs(training.cooccurrence(s), statistics.frequent_ids(s, 195))


@query(f"with {S}, o as (select distinct source_id id, message_id m from s where frame % 7200000 = 0), n as (select distinct message_id m, case when message_id like '%1' then 'x' else split_part(message_id, '_', 1) end id from s), c as (select o.id, n.id new_id, count(*) k from o join n on n.m = o.m group by 1, 2), so as (select id, count(*) size from o group by 1), sn as (select id, count(*) new_size from n group by 1), g as (select c.id, max(k) most, max(k * 1000000 - new_size) best, array_to_string(list_sort(list(distinct new_id)), ',') names from c join sn on sn.id = c.new_id group by 1) select so.id, size, case when most = size and most * 1000000 - best = size then 'unchanged' when most = size then 'contained' else 'split' end change, names from so join g on g.id = so.id")
def cluster_evolution(spark: SparkSession, folder: str) -> DataFrame:
    s = hourly(spark, folder)
    old = s.where("frame % 7200000 = 0").select(F.col("source_id").alias("id"), F.col("message_id").alias("member"))
    new = s.select(F.when(F.col("message_id").like("%1"), "x").otherwise(F.split("message_id", "_")[0]).alias("id"), F.col("message_id").alias("member"))
    return relational.evolution(old, new).withColumn("names", F.array_join("names", ","))


@query(f"with {S}, k as (select message_id, count(*) k from s group by 1) select message_id, 'from_' || cast(cast(power(2, floor(log2(k) + 1e-9)) as bigint) as varchar) as cluster from k")
def initial_partition(spark: SparkSession, folder: str) -> DataFrame:
    return relational.initial_partition(hourly(spark, folder))


@query(f"with {E}, f as (select message_id, min((event_id, message_id)) f from e group by 1) select message_id as value, row_number() over (order by f) - 1 index from f")
def insertion_index(spark: SparkSession, folder: str) -> DataFrame:
    return relational.indexed(events(spark, folder), "message_id", "event_id")


@query("select source_id, analysis_group group_name from sources where lower(analysis_group) <> (select lower(min(analysis_group)) from sources) and analysis_group is not null")
def groups_unselected(spark: SparkSession, folder: str) -> DataFrame:
    g = table(spark, folder, "sources").select("source_id", F.col("analysis_group").alias("group_name"))
    return relational.without_groups(g, [g.agg(F.min("group_name")).first()[0]])


@query("with m as (select lower(trim(source_id, ' \t\r\n')) source_id, epoch_us(max(ts)) t from messages where source_id is not null group by 1) select s.source_id, s.os_name, m.t last_us from sources s join m using (source_id) where s.os_name = (select min(os_name) from sources)")
def sources_by_system(spark: SparkSession, folder: str) -> DataFrame:
    """Sources whose system runs one operating system, with what is known of them last."""
    s = table(spark, folder, "sources")
    m = table(spark, folder, "messages").select(plain_id("source_id").alias("source_id"), F.expr("unix_micros(ts)").alias("at"))
    known = relational.managed_systems(m.join(s.select("source_id", "os_name"), "source_id").withColumn("offset", F.col("at")), "at")
    first = s.agg(F.min("os_name").alias("o")).first()[0]
    return relational.sources_of(s.select("source_id", "os_name"), known, first).select("source_id", "os_name", F.col("offset").alias("last_us"))


@query(f"with {S}, {_CO}, k as (select message_id, count(*) c from s group by 1), y as (select a m from p union all select b from p) select k.message_id, cast(k.c as bigint) as \"seen.c\", cast(z.k as bigint) as \"mates.k\" from k left join (select m, count(*) k from y group by 1) z on z.m = k.message_id")
def statistics_side_by_side(spark: SparkSession, folder: str) -> DataFrame:
    s = hourly(spark, folder)
    seen = s.groupBy("message_id").agg(F.count(F.lit(1)).alias("c"))
    p = training.cooccurrence(s)
    mates = p.select(F.col("a").alias("message_id")).unionByName(p.select(F.col("b").alias("message_id"))).groupBy("message_id").agg(F.count(F.lit(1)).alias("k"))
    return relational.prefixed({"seen": seen, "mates": mates}, ["message_id"])


@query(f"with {E}, r as (select value, row_number() over (order by value) - 1 i, count(*) over () n from events where value is not null), b as (select unnest(range(0, 1000)) k), t as (select k, value v from b join r on r.i = n * k // 1000) select (select v from t where k = 996) = (select v from t where k = 999) as limited")
def limited_model(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.limited_model(training.percentile_table(table(spark, folder, "events").select("value"), "value"))


_PERIODS = "p as (select lower(trim(source_id, ' \t\r\n')) source_id, interval_serial // 144 d, min(interval_serial) as lo, max(interval_serial) as hi, count(*) % 5 = 0 excl from interval_messages group by 1, 2)"


@query(f"with {_PERIODS} select source_id, lo as start, hi as end from p where not excl and lo >= (select min(interval_serial) + 144 from interval_messages) and hi <= (select max(interval_serial) - 144 from interval_messages)")
def training_periods(spark: SparkSession, folder: str) -> DataFrame:
    """Periods wholly inside the selected time and not excluded from training."""
    i = table(spark, folder, "interval_messages")
    p = i.groupBy(plain_id("source_id").alias("source_id"), F.floor(F.col("interval_serial") / 144).alias("d")).agg(F.min("interval_serial").alias("start"), F.max("interval_serial").alias("end"), (F.count(F.lit(1)) % 5 == 0).alias("exclude"))
    ends = i.agg(F.min("interval_serial"), F.max("interval_serial")).first()
    return periods.for_training(periods.within(p, (ends[0] or 0) + 144, (ends[1] or 0) - 144)).select("source_id", "start", "end")


@query()
def text_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Every message id by similar texts with its first text, its messages and the last day it was observed."""
    m = table(spark, folder, "messages").where("text is not null").select(T.component_or_none(F.col("component_id")).alias("component"), T.normalised(F.col("text")).alias("text"), "instance_id", F.expr("unix_micros(ts) div 1000").alias("ms"))
    return templates.text_clusters(m, templates.message_ids(m, "component", "text", "instance_id"), "component", "text", "ms").withColumn("last_day", F.col("last_day").cast("string"))
