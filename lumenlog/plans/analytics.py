"""Queries of the analytics operators over the event tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenlog.operators import clusters, context, framing, lines, relational, scoring, statistics, training
from lumenlog.operators.templates import message_ids, templates
from lumenlog.functions import text as T
from lumenlog.functions.ids import plain_id
from lumenlog.sources import writers
from lumenlog.sources.tables import table

HOUR = framing.HOUR
Query = Callable[[SparkSession, str], DataFrame]


def registry() -> tuple[dict[str, Query], dict[str, str], Callable[..., Callable[[Query], Query]]]:
    """Queries and SQL by name, and the decorator that adds a query to them."""
    queries: dict[str, Query] = {}
    texts: dict[str, str] = {}

    def query(sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            queries[f.__name__] = f
            if sql:
                texts[f.__name__] = sql
            return f

        return add

    return queries, texts, query


QUERIES, SQL, query = registry()


def events(spark: SparkSession, folder: str) -> DataFrame:
    """events as messages: 15 sources, 50 message ids."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, folder, "events").select(
        F.concat(F.lit("s"), F.col("user_id") % 15).alias("source_id"), F.concat_ws("_", "event_type", k % 10).alias("message_id"),
        F.expr("unix_micros(cast(ts as timestamp)) div 1000").alias("ms"), "event_id", "value", "user_id",
    )


def hourly(spark: SparkSession, folder: str) -> DataFrame:
    return training.interval_summaries(events(spark, folder), HOUR)


E = """e as (select 's' || (user_id % 15) source_id, event_type || '_' || (cast(json_extract_string(props, '$.k') as bigint) % 10) message_id, epoch_us(ts) // 1000 ms, event_id, value, user_id from events)"""
S = E + """, s as (select source_id, ms - ms % 3600000 frame, message_id, count(*) n, min(ms) first_ms from e group by all),
nn as (select cast(sum(k) as bigint) n_intervals from (select (max(frame) - min(frame)) / 3600000 + 1 k from s group by source_id))"""


@query(f"with {E}, g as (select source_id, unnest(range(min(ms) - min(ms) % 3600000, max(ms) + 1, 3600000)) frame from e group by 1) select g.source_id, g.frame, count(e.ms) n, count(distinct message_id) n_ids from g left join e on e.source_id = g.source_id and e.ms - e.ms % 3600000 = g.frame group by 1, 2")
def tumbling_dense_intervals(spark: SparkSession, folder: str) -> DataFrame:
    got = framing.tumbling(events(spark, folder), ["source_id"], "ms", HOUR, F.count(F.lit(1)).alias("n"), F.count_distinct("message_id").alias("n_ids"))
    return got.select("source_id", "frame", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_ids", F.lit(0)).alias("n_ids"))


@query(f"with {E}, g as (select source_id, unnest(range(min(ms) - min(ms) % 600000, max(ms) + 1, 600000)) frame from e group by 1), f as (select g.source_id, g.frame, count(e.ms) n from g left join e on e.source_id = g.source_id and e.ms - e.ms % 600000 = g.frame group by 1, 2), w as (select source_id, frame - 3000000 as start, cast(sum(n) over o as bigint) n, count(*) over o k from f window o as (partition by source_id order by frame rows between 5 preceding and current row)) select source_id, start, n from w where k = 6")
def sliding_intervals(spark: SparkSession, folder: str) -> DataFrame:
    return framing.sliding(events(spark, folder).withColumn("n", F.lit(1)), ["source_id"], "ms", HOUR, 600_000, "n")


@query(f"with {E}, b as (select *, case when ms - lag(ms) over (partition by source_id order by ms) <= 1800000 then 0 else 1 end b from e), r as (select *, sum(b) over (partition by source_id order by ms) run from b) select source_id, cast(run as bigint) run, count(*) n, min(ms) from_ms, max(ms) to_ms, count(distinct message_id) n_ids from r group by 1, 2")
def session_runs(spark: SparkSession, folder: str) -> DataFrame:
    r = framing.runs(events(spark, folder), ["source_id"], "ms", 1_800_000)
    return r.groupBy("source_id", F.col("run").cast("long").alias("run")).agg(F.count(F.lit(1)).alias("n"), F.min("ms").alias("from_ms"), F.max("ms").alias("to_ms"), F.count_distinct("message_id").alias("n_ids"))


@query(f"with {E} select source_id, ms - ms % 3600000 frame, message_id, count(*) n, min(ms) first_ms, array_to_string(list_sort(list_distinct(list(cast((ms % 3600000) * 120 // 3600000 as integer)))), ',') ticks from e group by 1, 2, 3")
def interval_message_summary(spark: SparkSession, folder: str) -> DataFrame:
    return hourly(spark, folder).select("source_id", "frame", "message_id", "n", "first_ms", F.array_join(F.col("ticks").cast("array<string>"), ",").alias("ticks"))


@query(f"with {E} select source_id, ms - ms % 3600000 frame, count(distinct message_id) n_ids from e group by 1, 2")
def interval_unique_ids(spark: SparkSession, folder: str) -> DataFrame:
    return hourly(spark, folder).groupBy("source_id", "frame").agg(F.count(F.lit(1)).alias("n_ids"))


@query(f"with {E} select source_id, message_id, ms // 3600000 serial, count(*) n, min(ms) first_ms from e group by 1, 2, 3")
def interval_rollup_x6(spark: SparkSession, folder: str) -> DataFrame:
    fine = training.interval_summaries(events(spark, folder), 600_000).withColumn("serial", F.floor(F.col("frame") / 600_000))
    return framing.roll_up(fine, ["source_id", "message_id"], "serial", 6, F.sum("n").alias("n"), F.min("first_ms").alias("first_ms"))


@query(f"with {S} select distinct source_id, frame, epoch_ms(date_trunc('week', make_timestamp(frame * 1000))) period, (frame - epoch_ms(date_trunc('week', make_timestamp(frame * 1000)))) // 3600000 serial from s")
def period_serial_numbers(spark: SparkSession, folder: str) -> DataFrame:
    period, serial = framing.serial_in_period(F.col("frame"), HOUR, "week")
    return hourly(spark, folder).select("source_id", "frame").distinct().select("source_id", "frame", period.alias("period"), serial.alias("serial"))


@query(f"with {E}, g as (select source_id, min(ms) a, max(ms) b, unnest(range(min(ms) - min(ms) % 3600000, max(ms) + 1, 3600000)) frame from e group by 1) select source_id, frame, round((3600000 - greatest(a - frame, 0) - greatest(frame + 3600000 - b - 1, 0)) / 3600000.0, 9) coverage from g")
def coverage_factor(spark: SparkSession, folder: str) -> DataFrame:
    return framing.coverage(events(spark, folder), ["source_id"], "ms", HOUR).withColumn("coverage", F.round("coverage", 9))


@query(f"with {S} select message_id, count(*) seen, n_intervals, round(count(*) / n_intervals, 9) probability, round(greatest(1.0, -ln(count(*) / n_intervals)) / 101, 9) score from s, nn group by 1, 3")
def bernoulli_train(spark: SparkSession, folder: str) -> DataFrame:
    return training.bernoulli(hourly(spark, folder), HOUR).select("message_id", "seen", "n_intervals", F.round("probability", 9).alias("probability"), F.round("score", 9).alias("score"))


@query(f"with {S} select message_id, count(*) seen, n_intervals, round((count(*) + 0.5) / (n_intervals + 1), 9) probability, round(least(1.0, (count(*) + 0.5) / (n_intervals + 0.5 - count(*))), 9) odds, round(-ln((count(*) + 0.5) / (n_intervals + 0.5 - count(*))), 9) log_prob from s, nn group by 1, 3")
def bernoulli_full_train(spark: SparkSession, folder: str) -> DataFrame:
    return training.bernoulli_full(hourly(spark, folder), HOUR).select("message_id", "seen", "n_intervals", *[F.round(c, 9).alias(c) for c in ("probability", "odds", "log_prob")])


_MU = "m as (select message_id, avg(ln(n)) mu, max(n) max_n, greatest(0.5, sqrt(greatest(avg(ln(n)), 0))) sigma from s group by 1)"


@query(f"with {S}, {_MU} select message_id, round(mu, 9) mu, max_n, case when ln(max_n) > mu and power((ln(max_n) - mu) / sigma, 2) / 2 >= 15 then true else false end bad_fit from m")
def lognormal_train(spark: SparkSession, folder: str) -> DataFrame:
    return training.log_normal(hourly(spark, folder)).withColumn("mu", F.round("mu", 9))


@query(f"with {S} select message_id, cast(sum(n) as bigint) total, round(sum(n) / n_intervals, 9) rate from s, nn group by 1, n_intervals")
def poisson_train(spark: SparkSession, folder: str) -> DataFrame:
    return training.poisson(hourly(spark, folder), HOUR).select("message_id", "total", F.round("rate", 9).alias("rate"))


@query(f"with {S}, h as (select message_id, least(16, floor(log2(n) + 1e-12)) bucket, count(*) c from s group by 1, 2), i as (select message_id, sum(c) total from h group by 1), g as (select message_id, total, unnest(range(0, 17)) bucket from i) select g.message_id, cast(g.bucket as integer) bucket, coalesce(c, 0) count, round((coalesce(c, 0) + 0.5) / (total + 8.5), 9) prob from g left join h on h.message_id = g.message_id and h.bucket = g.bucket")
def rarity_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return training.rarity(hourly(spark, folder), HOUR).withColumn("prob", F.round("prob", 9))


_CO = "p as (select a.message_id a, b.message_id b, count(*) joint from s a join s b on a.source_id = b.source_id and a.frame = b.frame and a.message_id < b.message_id group by 1, 2), c as (select message_id, count(*) c from s group by 1), q as (select p.*, ca.c ca, cb.c cb, n_intervals n from p join c ca on ca.message_id = a join c cb on cb.message_id = b, nn)"


@query(f"with {S}, {_CO} select a, b, joint from p")
def cooccurrence_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return training.cooccurrence(hourly(spark, folder))


def _cell(j: str, x: str, y: str) -> str:
    return f"case when {j} <= 0 then 0 else {j} / n * log2({j} * n / ({x} * {y} * 1.0)) end"


@query(f"with {S}, {_CO}, d as (select a, b, joint, cast(ca as double) ca, cast(cb as double) cb, cast(n as double) n from q) select a, b, joint, round(case when joint * n >= ca * cb then 1 else -1 end * ({_cell('joint', 'ca', 'cb')} + {_cell('(ca - joint)', 'ca', '(n - cb)')} + {_cell('(cb - joint)', '(n - ca)', 'cb')} + {_cell('(n - ca - cb + joint)', '(n - ca)', '(n - cb)')}), 9) + 0.0 mi from d")
def mutual_information(spark: SparkSession, folder: str) -> DataFrame:
    return training.mutual_information(hourly(spark, folder), HOUR).withColumn("mi", F.round("mi", 9) + 0.0)


@query(f"""with {S}, {_CO}, d as (select a i, b mate, joint, cast(ca as double) c, cast(cb as double) m, cast(n as double) n from q union all select b, a, joint, cb, ca, n from q),
h as (select i, mate, n, m, joint / m p, case when n = m then 0 else (c - joint) / (n - m) end r from d),
x as (select i message_id, mate, round(m / n * (case when p <= 0 or p >= 1 then 0 else -p * log2(p) - (1 - p) * log2(1 - p) end) + (n - m) / n * (case when r <= 0 or r >= 1 then 0 else -r * log2(r) - (1 - r) * log2(1 - r) end), 9) entropy from h)
select message_id, arg_min(mate, (entropy, mate)) mate, min(entropy) entropy from x group by 1""")
def max_information_context(spark: SparkSession, folder: str) -> DataFrame:
    return training.best_predictor(hourly(spark, folder), HOUR)


@query(f"with {E}, d as (select message_id, (ms - lag(ms) over (partition by source_id, message_id order by ms)) // 1000 // 600 bin from e), h as (select message_id, bin, count(*) c from d where bin is not null group by 1, 2) select message_id, cast(sum(c) as bigint) points, count(*) bins, max(c) top, sum(c) >= 10 and max(c) > 10 and sum(c) / count(*) > 2 periodic from h group by 1")
def delta_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return training.delta_model(events(spark, folder))


@query(f"with {E} select event_id, (ms - max(ms) over (partition by message_id order by ms range between unbounded preceding and 1 preceding)) as since_ms from e")
def last_seen_asof(spark: SparkSession, folder: str) -> DataFrame:
    return framing.previous(events(spark, folder), ["message_id"], "ms", strict=True).select("event_id", (F.col("ms") - F.col("previous")).alias("since_ms"))


@query(f"with {E} select source_id, message_id, min(ms) first_ms from e group by 1, 2")
def first_seen(spark: SparkSession, folder: str) -> DataFrame:
    return events(spark, folder).groupBy("source_id", "message_id").agg(F.min("ms").alias("first_ms"))


@query(f"with {S}, f as (select source_id, message_id, min(frame) f from s group by 1, 2) select s.source_id, s.frame, count(*) n_ids, cast(sum(case when s.frame = f then 1 else 0 end) as bigint) n_new from s join f on s.source_id = f.source_id and s.message_id = f.message_id group by 1, 2")
def new_messages_per_interval(spark: SparkSession, folder: str) -> DataFrame:
    s = hourly(spark, folder)
    s = s.join(s.groupBy("source_id", "message_id").agg(F.min("frame").alias("f")), ["source_id", "message_id"])
    return s.groupBy("source_id", "frame").agg(F.count(F.lit(1)).alias("n_ids"), F.sum(F.when(F.col("frame") == F.col("f"), 1).otherwise(0)).alias("n_new"))


@query("with v as (select value, row_number() over (order by value) - 1 i, count(*) over () n from events where value is not null), b as (select unnest(range(0, 1000)) bucket) select cast(bucket as integer) bucket, round(value, 9) as value from b join v on v.i = n * bucket // 1000")
def percentile_table_1000(spark: SparkSession, folder: str) -> DataFrame:
    return training.percentile_table(table(spark, folder, "events").select("value"), "value").withColumn("value", F.round("value", 9))


@query(f'with {S}, h as (select message_id, least(16, floor(log2(n) + 1e-12)) bucket, count(*) c from s group by 1, 2), i as (select message_id, sum(c) total, max(c) likeliest from h group by 1) select source_id, frame, s.message_id, round((c + 0.5) / (likeliest + 0.5), 9) normalised, round(1 - (c + 0.5) / (total + 8.5) * (total + 0.5) / (n_intervals + 1), 9) as "full", round(1 - (c + 0.5) / (likeliest + 0.5) * (total + 0.5) / (n_intervals + 1), 9) main from s join h on h.message_id = s.message_id and h.bucket = least(16, floor(log2(s.n) + 1e-12)) join i on i.message_id = s.message_id, nn')
def bucket_rarity_scores(spark: SparkSession, folder: str) -> DataFrame:
    s = hourly(spark, folder)
    got = scoring.bucket_rarity_scores(s.withColumn("all_n", training.n_intervals(s, HOUR).scalar()), training.rarity(s, HOUR), F.col("all_n"))
    return got.select("source_id", "frame", "message_id", *[F.round(c, 9).alias(c) for c in ("normalised", "full", "main")])


_SCORES = f"{S}, {_MU}, c as (select message_id, count(*) c from s group by 1), x as (select s.source_id, s.frame, s.message_id, s.n, -ln((c + 0.5) / (n_intervals + 0.5 - c)) rarity, case when ln(s.n) <= mu or (ln(max_n) > mu and power((ln(max_n) - mu) / sigma, 2) / 2 >= 15) then 0.0 else power((ln(s.n) - mu) / sigma, 2) / 2 end count_score from s join m on m.message_id = s.message_id join c on c.message_id = s.message_id, nn)"


@query(f"with {_SCORES} select source_id, frame, message_id, n, round(rarity, 6) rarity, round(count_score, 6) count_score, round(0.2 * count_score + 0.8 * rarity, 6) anomaly from x")
def message_scores(spark: SparkSession, folder: str) -> DataFrame:
    got = scoring.message_scores(hourly(spark, folder).select("source_id", "frame", "message_id", "n"), HOUR)
    return got.select("source_id", "frame", "message_id", "n", *[F.round(c, 6).alias(c) for c in ("rarity", "count_score", "anomaly")])


@query(f"with {_SCORES} select source_id, frame, round(sum(0.2 * count_score + 0.8 * rarity), 5) score, count(*) n_ids from x group by 1, 2")
def interval_scores(spark: SparkSession, folder: str) -> DataFrame:
    got = scoring.interval_scores(scoring.message_scores(hourly(spark, folder).select("source_id", "frame", "message_id", "n"), HOUR))
    return got.withColumn("score", F.round("score", 5))


@query(f"with {_SCORES}, i as (select source_id, frame, round(sum(0.2 * count_score + 0.8 * rarity), 5) score from x group by 1, 2), v as (select score, row_number() over (order by score) - 1 k, count(*) over () n from i), t as (select bucket, score as p from (select unnest(range(0, 1000)) bucket) b join v on v.k = n * bucket // 1000) select source_id, frame, score, round(case when score > 1.5 * (select max(p) from t) then 1.01 else least(1.0, (select count(*) from t where p < score) / 1000.0) end, 6) as rank from i")
def interval_percentile_rank(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.percentile_rank(interval_scores(spark, folder).select("source_id", "frame", "score")).withColumn("rank", F.round("rank", 6))


@query(f"with {_SCORES} select source_id, frame, message_id, round(least(rarity, nullif(count_score, 0)), 6) best, case when nullif(count_score, 0) is null or rarity <= count_score then 'rarity' else 'count' end used from x")
def best_of_two(spark: SparkSession, folder: str) -> DataFrame:
    m = scoring.message_scores(hourly(spark, folder).select("source_id", "frame", "message_id", "n"), HOUR)
    c = F.nullif("count_score", F.lit(0.0))
    return m.select("source_id", "frame", "message_id", F.round(scoring.best_of_two(F.col("rarity"), c), 6).alias("best"), F.when(c.isNull() | (F.col("rarity") <= c), "rarity").otherwise("count").alias("used"))


@query(f"with {E}, k as (select unnest([1, 2, 3, 6, 12, 24]) k) select source_id, k slots, ms // (600000 * k) slot, count(*) n, count(distinct message_id) n_ids from e, k group by 1, 2, 3")
def message_rate_multi_granularity(spark: SparkSession, folder: str) -> DataFrame:
    return statistics.message_rates(events(spark, folder)).select("source_id", "slots", "slot", "n", "n_ids")


@query(f"with {E}, r as (select source_id, ms // 600000 slot, count(*) n from e group by 1, 2) select source_id, count(*) slots, round(avg(n), 9) mean_n, min(n) min_n, max(n) max_n, round(stddev_pop(n), 9) sd_n from r group by 1")
def message_rate_stats(spark: SparkSession, folder: str) -> DataFrame:
    r = events(spark, folder).groupBy("source_id", F.floor(F.col("ms") / 600_000).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    return r.groupBy("source_id").agg(F.count(F.lit(1)).alias("slots"), F.round(F.avg("n"), 9).alias("mean_n"), F.min("n").alias("min_n"), F.max("n").alias("max_n"), F.round(F.stddev_pop("n"), 9).alias("sd_n"))


_OLD, _NEW = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) {1,2}\d{1,2} \d\d:\d\d:\d\d", r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d+)?(?:Z|[+-]\d\d:?\d\d)"


@query(f"with r as (select array_to_string(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(line, '{_NEW}', '<time>', 'g'), '{_OLD}', '<month> <day> <clock>', 'g'), ' +'), lambda w: w <> '')[1:case when regexp_matches(line, '{_NEW}') then 10 when regexp_matches(line, '{_OLD}') then 7 else 4 end], ' ') head from log_lines) select head, count(*) n from r group by 1 order by n desc, head limit 20")
def parse_error_topk(spark: SparkSession, folder: str) -> DataFrame:
    return statistics.error_top(table(spark, folder, "log_lines"), lines.error_heads(F.col("line")))


@query(f"with {E} select event_id, source_id from (select *, row_number() over (partition by source_id, ms // 3600000 order by ms, event_id) k from e) where k <= 5")
def unexpected_source_limit5(spark: SparkSession, folder: str) -> DataFrame:
    return relational.first_rows(events(spark, folder), ["source_id", F.floor(F.col("ms") / HOUR)], [F.col("ms"), F.col("event_id")], 5).select("event_id", "source_id")


@query(f"with {E}, u as (select source_id, count(distinct message_id) ids, count(distinct ms // 3600000) n_hours from e group by 1) select *, (ids < 180 and n_hours < 1000) or (ids < 20 and n_hours >= 1000) insufficient from u")
def training_sufficiency(spark: SparkSession, folder: str) -> DataFrame:
    return statistics.sufficiency(events(spark, folder))


@query("select source_id, case when source_id like 'dns-%' then 'names' when source_id like 'mq-%' then 'queues' when regexp_matches(source_id, '^.*-3.?$') then 'thirties' else 'UNASSIGNED' end group_name from sources")
def group_assignment_glob(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame([("names", "dns-*", 1), ("queues", "MQ-*", 2), ("thirties", "*-3?", 3)], "group_name string, rule string, evaluation_order int")
    return relational.assign_groups(table(spark, folder, "sources"), rules)


@query("with w as (select distinct nullif(lower(trim(message_id, ' \t\r\n')), '') word from messages where nullif(lower(trim(message_id, ' \t\r\n')), '') is not null) select word, row_number() over (order by word) - 1 id from w")
def dictionary_encode(spark: SparkSession, folder: str) -> DataFrame:
    return relational.dictionary(table(spark, folder, "messages").select(plain_id("message_id").alias("w")), "w")


@query("with d as (select min(stored_at) low from interval_messages) select source_id, interval_serial, message_id, arg_max(num_occurrences, (stored_at::date > low::date + 30, stored_at)) num_occurrences from interval_messages, d group by 1, 2, 3")
def results_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """What was stored in the first month, with the later results put in its place."""
    i = table(spark, folder, "interval_messages").select("source_id", "interval_serial", "message_id", "num_occurrences", "stored_at")
    day = F.to_date("stored_at")
    late = day > i.agg(F.date_add(F.to_date(F.min("stored_at")), 30).alias("low")).scalar()
    keys = ["source_id", "interval_serial", "message_id"]
    newest = lambda df: df.groupBy(*keys).agg(F.max_by("num_occurrences", "stored_at").alias("num_occurrences"))
    return relational.upsert(newest(i.where(~late)), newest(i.where(late)), keys)


@query("with m as (select distinct nullif(lower(trim(source_id, ' \t\r\n')), '') s from messages), i as (select distinct lower(trim(source_id, ' \t\r\n')) s from interval_messages) select x.source_id, x.os_name from sources x join m on m.s = x.source_id join i on i.s = x.source_id")
def analysed_sources_3way(spark: SparkSession, folder: str) -> DataFrame:
    m = table(spark, folder, "messages").select(plain_id("source_id").alias("source_id")).distinct()
    i = table(spark, folder, "interval_messages").select(plain_id("source_id").alias("source_id")).distinct()
    return table(spark, folder, "sources").join(m, "source_id", "left_semi").join(i, "source_id", "left_semi").select("source_id", "os_name")


@query("select lower(trim(source_id, ' \t\r\n')) source_id, epoch_ms(date_trunc('day', max(interval_start) at time zone 'UTC')) period from interval_messages group by 1")
def last_period_per_source(spark: SparkSession, folder: str) -> DataFrame:
    last = table(spark, folder, "interval_messages").groupBy(plain_id("source_id").alias("source_id")).agg(F.max(F.expr("unix_millis(interval_start)")).alias("t"))
    return last.select("source_id", (F.col("t") - F.pmod("t", F.lit(86_400_000))).alias("period"))


@query(f"with {S}, a as (select message_id, count(*) c from s where source_id = 's1' group by 1), b as (select message_id, count(*) c from s where source_id = 's2' group by 1) select coalesce(a.message_id, b.message_id) message_id, case when a.message_id is null then 'add' when b.message_id is null then 'delete' else 'update' end change from a full join b on a.message_id = b.message_id where a.message_id is null or b.message_id is null or a.c <> b.c")
def set_difference(spark: SparkSession, folder: str) -> DataFrame:
    s = hourly(spark, folder)
    a, b = (s.where(F.col("source_id") == k).groupBy("message_id").agg(F.count(F.lit(1)).alias("c")) for k in ("s1", "s2"))
    return relational.set_changes(a, b, "message_id", "c")


@query(f"""with {E}, d as (select source_id, message_id, ms - ms % 86400000 d, count(*) c from e group by 1, 2, 3), l as (select min(d) low, max(d) high from d), a as (select source_id, message_id, d + 86400000 d, c from d, l where d < high), b as (select source_id, message_id, d, c from d, l where d > low)
select coalesce(a.source_id, b.source_id) source_id, coalesce(a.message_id, b.message_id) message_id, coalesce(a.d, b.d) as day, case when a.c is null then 'add' when b.c is null then 'delete' else 'update' end change from a full join b on a.source_id = b.source_id and a.message_id = b.message_id and a.d = b.d where a.c is distinct from b.c""")
def set_difference_by_day(spark: SparkSession, folder: str) -> DataFrame:
    """What changes in the messages of every source from each day to the next, named by the later one."""
    day = F.col("ms") - F.pmod("ms", F.lit(24 * HOUR))
    d = events(spark, folder).groupBy("source_id", "message_id", day.alias("day")).agg(F.count(F.lit(1)).alias("c"))
    ends = d.agg(F.min("day").alias("low"), F.max("day").alias("high"))
    keyed = lambda at: F.struct("source_id", "message_id", at.alias("day")).alias("key")
    old = d.where(F.col("day") < ends.select("high").scalar()).select(keyed(F.col("day") + 24 * HOUR), "c")
    new = d.where(F.col("day") > ends.select("low").scalar()).select(keyed(F.col("day")), "c")
    return relational.set_changes(old, new, "key", "c").select("key.source_id", "key.message_id", "key.day", "change")


@query(f"with {E} select message_id, array_to_string(list_sort(list_distinct(list(cast((ms % 3600000) * 120 // 3600000 as integer)))), ',') ticks from e group by 1")
def set_union(spark: SparkSession, folder: str) -> DataFrame:
    return hourly(spark, folder).groupBy("message_id").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("ticks")))).cast("array<string>"), ",").alias("ticks"))


@query(f"with {E}, a as (select distinct source_id id, message_id m from e where ms % 2 = 0), b as (select distinct source_id id, message_id m from e where ms % 2 = 1), c as (select a.id o, b.id n, count(*) k from a join b on a.m = b.m group by 1, 2), sa as (select id, count(*) k from a group by 1), sb as (select id, count(*) k from b group by 1) select n new_id, o old_id, round(c.k / (sa.k + sb.k - c.k), 9) similarity from c join sa on sa.id = o join sb on sb.id = n where c.k / (sa.k + sb.k - c.k) > 0.5")
def jaccard_match(spark: SparkSession, folder: str) -> DataFrame:
    e = events(spark, folder).select(F.col("source_id").alias("id"), F.col("message_id").alias("member"), "ms")
    return relational.best_names(e.where("ms % 2 = 0"), e.where("ms % 2 = 1")).withColumn("similarity", F.round("similarity", 9))


_CRIT = ", ".join(f"'{w}'" for w in T.CRITICAL_WORDS)


@query(rf"select summary_id, len(list_filter(regexp_split_to_array(lower(text_summary), '\s+'), lambda w: list_contains([{_CRIT}], w))) score from message_summaries")
def critical_word_score(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "message_summaries").select("summary_id", T.critical_score(F.col("text_summary")).cast("long").alias("score"))


@query(rf"with m as (select nullif(lower(trim(source_id, ' \t\r\n')), '') source_id, nullif(lower(trim(message_id, ' \t\r\n')), '') message_id, epoch_us(ts) // 1000 ms, instance_id, text, len(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: list_contains([{_CRIT}], w))) score from messages) select source_id, ms - ms % 3600000 frame, message_id, arg_max(text, (score, -ms, -instance_id)) filter (text is not null) sample, max(score) score from m group by 1, 2, 3".replace(r"\t\r\n", "\t\r\n"))
def text_samples(spark: SparkSession, folder: str) -> DataFrame:
    m = table(spark, folder, "messages").select(plain_id("source_id").alias("source_id"), plain_id("message_id").alias("message_id"), F.expr("unix_micros(cast(ts as timestamp)) div 1000").alias("ms"), "instance_id", "text")
    return training.text_samples(m, HOUR)


def _normalise_sql() -> str:
    x = "text"
    for pattern, value in T.REPLACEMENTS:
        x = f"regexp_replace({x}, '{pattern}', '{value}', 'g')"
    return f"select instance_id, {x} as text from messages"


@query(_normalise_sql())
def text_normalise(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "messages").select("instance_id", T.normalised(F.col("text")).alias("text"))


@query(r"select summary_id, array_to_string(regexp_extract_all(text_summary, '[:,&=!></.\\(){}\[\]]|[^:,&=!></.\\(){}\[\] \t\n]+')[1:120], ' ') words from message_summaries")
def tokenise_words(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "message_summaries").select("summary_id", F.array_join(T.words(F.col("text_summary")), " ").alias("words"))


@query(rf"select instance_id, regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}', 'user@example.com', 'g'), '{T._octets(4)}', '127.0.0.1', 'g') as masked from messages")
def mask_ip_email(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "messages").select("instance_id", T.masked(F.col("text")).alias("masked"))


@query(r"select file, line_no, regexp_extract(line, '^(?:<\d{1,3}>)?([A-Z][a-z]{2} [ \d]\d \d\d:\d\d:\d\d) (\S+) ', 1) stamp, lower(regexp_extract(line, '^(?:<\d{1,3}>)?([A-Z][a-z]{2} [ \d]\d \d\d:\d\d:\d\d) (\S+) ', 2)) host from log_lines where regexp_matches(line, '^(?:<\d{1,3}>)?[A-Z][a-z]{2} [ \d]\d \d\d:\d\d:\d\d \S+ ')")
def syslog3164_parse(spark: SparkSession, folder: str) -> DataFrame:
    p = r"^(?:<\d{1,3}>)?([A-Z][a-z]{2} [ \d]\d \d\d:\d\d:\d\d) (\S+) "
    return table(spark, folder, "log_lines").where(F.col("line").rlike(p)).select("file", "line_no", F.regexp_extract("line", p, 1).alias("stamp"), T.host_name(F.regexp_extract("line", p, 2)).alias("host"))


@query(r"select file, line_no, cast(regexp_extract(line, '^<(\d{1,3})>1 (\S+) (\S+) (\S+) ', 1) as integer) pri, regexp_extract(line, '^<(\d{1,3})>1 (\S+) (\S+) (\S+) ', 3) host, nullif(regexp_extract(line, '^<(\d{1,3})>1 (\S+) (\S+) (\S+) ', 4), '-') app from log_lines where regexp_matches(line, '^<\d{1,3}>1 \S+ \S+ \S+ ')")
def syslog5424_parse(spark: SparkSession, folder: str) -> DataFrame:
    p = r"^<(\d{1,3})>1 (\S+) (\S+) (\S+) "
    x = lambda i: F.regexp_extract("line", p, i)
    return table(spark, folder, "log_lines").where(F.col("line").rlike(p)).select("file", "line_no", x(1).cast("int").alias("pri"), x(3).alias("host"), F.nullif(x(4), F.lit("-")).alias("app"))


@query(r"select file, line_no, epoch_ms(strptime('20' || regexp_extract(line, '^(\d\d/\d\d/\d\d \d\d:\d\d:\d\d) (\w+) (\w+): ', 1), '%Y/%m/%d %H:%M:%S')) ms, lower(regexp_extract(line, '^(\d\d/\d\d/\d\d \d\d:\d\d:\d\d) (\w+) (\w+): ', 2)) source_id, 'master' component from log_lines where regexp_matches(line, '^\d\d/\d\d/\d\d \d\d:\d\d:\d\d \w+ \w+: ')")
def spark_log_parse(spark: SparkSession, folder: str) -> DataFrame:
    got = table(spark, folder, "log_lines").withColumn("f", lines.spark_fields(F.col("line"))).where("f is not null")
    return got.select("file", "line_no", "f.ms", "f.source_id", "f.component")


@query("select l_returnflag, round(covar_samp(l_quantity, l_extendedprice), 4) cov, round(corr(l_quantity, l_extendedprice), 9) cor, round(median(l_discount), 9) med from lineitem group by 1")
def nan_safe_covariance(spark: SparkSession, folder: str) -> DataFrame:
    ok = F.nanvl("l_quantity", F.lit(None)).isNotNull() & F.nanvl("l_extendedprice", F.lit(None)).isNotNull()
    x, y = F.when(ok, F.col("l_quantity")), F.when(ok, F.col("l_extendedprice"))
    return table(spark, folder, "lineitem").groupBy("l_returnflag").agg(F.round(F.covar_samp(x, y), 4).alias("cov"), F.round(F.corr(x, y), 9).alias("cor"), F.round(F.median("l_discount"), 9).alias("med"))


@query("select vec_id, round(list_sum(list_transform(embedding, lambda x: abs(cast(x as double)))), 4) l1, round(sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * cast(x as double)))), 4) l2 from embeddings")
def l1_l2_distance(spark: SparkSession, folder: str) -> DataFrame:
    v = F.transform("embedding", lambda x: x.cast("double"))
    add = lambda f: F.aggregate(F.transform(v, f), F.lit(0.0), lambda a, x: a + x)
    return table(spark, folder, "embeddings").select("vec_id", F.round(add(F.abs), 4).alias("l1"), F.round(F.sqrt(add(lambda x: x * x)), 4).alias("l2"))


@query(f"with {E}, d as (select source_id, ms - lag(ms) over (partition by source_id order by ms, event_id) d from e) select source_id, count(d) n, round(avg(d), 6) mean_ms, max(d) max_ms from d group by 1")
def inter_arrival(spark: SparkSession, folder: str) -> DataFrame:
    d = framing.previous(events(spark, folder), ["source_id"], "ms").select("source_id", (F.col("ms") - F.col("previous")).alias("d"))
    return d.groupBy("source_id").agg(F.count("d").alias("n"), F.round(F.avg("d"), 6).alias("mean_ms"), F.max("d").alias("max_ms"))


@query(f"with {_SCORES}, o as (select source_id, frame, message_id, round(rarity, 6) rarity, round(0.2 * count_score + 0.8 * rarity, 6) anomaly from x) select * from o order by anomaly desc, rarity desc, message_id nulls first, source_id, frame limit 50")
def top_messages(spark: SparkSession, folder: str) -> DataFrame:
    m = message_scores(spark, folder).select("source_id", "frame", "message_id", "rarity", "anomaly")
    return m.orderBy(F.desc("anomaly"), F.desc("rarity"), F.asc_nulls_first("message_id"), "source_id", "frame").limit(50)


@query("select lower(trim(source_id, ' \t\r\n')) source_id, severity, count(*) n, cast(sum(cnt) as bigint) cnt, cast(sum(coalesce(cnt_failed, 0)) as bigint) failed from messages where source_id is not null and trim(source_id, ' \t\r\n') <> '' group by 1, 2")
def severity_counts(spark: SparkSession, folder: str) -> DataFrame:
    m = table(spark, folder, "messages").select(plain_id("source_id").alias("source_id"), "severity", "cnt", "cnt_failed").where("source_id is not null")
    return m.groupBy("source_id", "severity").agg(F.count(F.lit(1)).alias("n"), F.sum("cnt").alias("cnt"), F.sum(F.coalesce("cnt_failed", F.lit(0))).alias("failed"))


@query(f"with {E}, g as (select source_id, ms, lag(ms) over (partition by source_id order by ms) p from e) select source_id, ms - ms % 600000 as until, (ms // 600000 - p // 600000 - 1) missing from g where ms // 600000 - p // 600000 > 1")
def logger_gaps(spark: SparkSession, folder: str) -> DataFrame:
    slot = F.floor(F.col("ms") / 600_000)
    g = framing.previous(events(spark, folder), ["source_id"], "ms").withColumn("missing", slot - F.floor(F.col("previous") / 600_000) - 1)
    return g.where("missing > 0").select("source_id", (slot * 600_000).alias("until"), "missing")


@query(f"with {S} select message_id, cast(floor(min(p) * 1e9 + 0.5) / 1e9 as double) least_lp from (select s.message_id, n * ln(l) - l - lgamma(n + 1.0) p from s join (select message_id, sum(n) / any_value(n_intervals) l from s, nn group by 1) m on m.message_id = s.message_id) group by 1")
def poisson_scores(spark: SparkSession, folder: str) -> DataFrame:
    s = hourly(spark, folder)
    got = scoring.poisson_scores(s, training.poisson(s, HOUR))
    return got.groupBy("message_id").agg((F.floor(-F.max("poisson_score") * 1e9 + 0.5) / 1e9).alias("least_lp"))


@query(f"with {E}, t as (select source_id, ms - ms % 3600000 frame, message_id, list_distinct(list((ms % 3600000) * 120 // 3600000)) t from e group by 1, 2, 3) select source_id, frame, message_id, to_base64(unhex(array_to_string(list_transform(range(0, list_max(t) // 8 + 1), lambda b: printf('%02X', cast(coalesce(list_sum(list_transform(list_filter(t, lambda x: x // 8 = b), lambda x: cast(power(2, x % 8) as bigint))), 0) as bigint))), ''))) time_vector from t")
def timeline_base64(spark: SparkSession, folder: str) -> DataFrame:
    return hourly(spark, folder).select("source_id", "frame", "message_id", T.time_vector(F.col("ticks")).alias("time_vector"))


@query()
def template_merge(spark: SparkSession, folder: str) -> DataFrame:
    m = table(spark, folder, "messages").select(plain_id("message_id").alias("message_id"), T.normalised(F.col("text")).alias("text"), "instance_id")
    return templates(m, "message_id", "text", "instance_id")


@query()
def word_levenshtein_clusters(spark: SparkSession, folder: str) -> DataFrame:
    m = table(spark, folder, "messages").where("text is not null").select(T.component_or_none(F.col("component_id")).alias("component"), T.normalised(F.col("text")).alias("text"), "instance_id")
    return message_ids(m, "component", "text", "instance_id").groupBy("component", "message_id").agg(F.count(F.lit(1)).alias("n_texts"), F.min("text").alias("example"))


@query()
def information_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return clusters.information_clusters(training.mutual_information(hourly(spark, folder), HOUR).select("a", "b", "mi"))


def _labels(summaries: DataFrame) -> DataFrame:
    """Clusters by the kind of event: ten ids each; ids ending in 9 belong to none."""
    return summaries.select("message_id").distinct().where("message_id not like '%9'").withColumn("cluster", F.split("message_id", "_")[0])


_CL = "c as (select distinct message_id, string_split(message_id, '_')[1] as cluster from s where message_id not like '%9'), z as (select cluster, count(*) size from c group by 1), t as (select distinct message_id from s where source_id <> 's3')"


@query(f"with {S}, {_CL}, p as (select s.source_id, s.frame, s.message_id, c.cluster, size, count(c.cluster) over (partition by s.source_id, s.frame, c.cluster) k, t.message_id tm from s left join c using (message_id) left join z using (cluster) left join t on t.message_id = s.message_id) select source_id, frame, message_id, cluster, case when tm is null then 'NEW' when cluster is null then 'UNCLUSTERED' when k > 1 and k / size >= 0.3 then 'IN_CONTEXT' else 'OUT_OF_CONTEXT' end status from p")
def clustering_context(spark: SparkSession, folder: str) -> DataFrame:
    s = hourly(spark, folder).select("source_id", "frame", "message_id")
    return context.context_status(s, _labels(s), s.where("source_id <> 's3'")).select("source_id", "frame", "message_id", "cluster", "status")


@query(f"with {S}, {_CL} select s.source_id, s.frame, s.message_id, case when c.cluster is null then 'UNCLUSTERED' when row_number() over (partition by s.source_id, s.frame, c.cluster order by s.message_id) = 1 then 'REPRESENTATIVE' else 'IN_CONTEXT' end status from s left join c using (message_id)")
def clustering_uniquify(spark: SparkSession, folder: str) -> DataFrame:
    s = hourly(spark, folder).select("source_id", "frame", "message_id")
    return context.representatives(s, _labels(s)).select("source_id", "frame", "message_id", "status")


@query(f"with {E} select source_id, message_id, ms, ms - lag(ms) over o since_ms, case when lag(ms) over o is null then 'NEW' else 'REGULAR' end status from e window o as (partition by source_id, message_id order by ms)")
def last_seen_status(spark: SparkSession, folder: str) -> DataFrame:
    return context.last_seen_status(events(spark, folder))


@query(f"with {E}, d as (select message_id, (ms - lag(ms) over (partition by source_id, message_id order by ms)) // 1000 // 600 bin from e), h as (select message_id, bin, count(*) c from d where bin is not null group by 1, 2) select message_id, bin, c, round(ln(max(c) over w) - ln(c), 9) + 0.0 score, round(ln(max(c) over w) - ln(c) - ln(max(c) over w / sum(c) over w), 9) given_last from h window w as (partition by message_id)")
def periodicity_scores(spark: SparkSession, folder: str) -> DataFrame:
    got = context.periodicity_scores(training.deltas(events(spark, folder)))
    return got.select("message_id", "bin", "c", (F.round("score", 9) + 0.0).alias("score"), F.round("given_last", 9).alias("given_last"))


@query(f"""with {S}, {_CO}, d as (select a i, b mate, joint, cast(ca as double) c, cast(cb as double) m, cast(n as double) n from q union all select b, a, joint, cb, ca, n from q),
h as (select i, mate, n, m, joint / m p, case when n = m then 0 else (c - joint) / (n - m) end r from d),
x as (select i message_id, mate, round(m / n * (case when p <= 0 or p >= 1 then 0 else -p * log2(p) - (1 - p) * log2(1 - p) end) + (n - m) / n * (case when r <= 0 or r >= 1 then 0 else -r * log2(r) - (1 - r) * log2(1 - r) end), 9) entropy from h),
b as (select message_id i, arg_min(mate, (entropy, mate)) mate from x group by 1), j as (select b.i, b.mate, joint from b join (select a i, b mate, joint from p union all select b, a, joint from p) l on l.i = b.i and l.mate = b.mate),
r as (select s.source_id, s.frame, s.message_id, j.mate, o.message_id is not null mate_seen, joint, ci.c c, cm.c m, n_intervals n from s join j on j.i = s.message_id left join s o on o.source_id = s.source_id and o.frame = s.frame and o.message_id = j.mate join c ci on ci.message_id = s.message_id join c cm on cm.message_id = j.mate, nn)
select source_id, frame, message_id, mate, mate_seen, round(case when mate_seen then (joint + 0.5) / (m + 0.5) else (c - joint + 0.5) / (n - m + 0.5) end, 9) prob from r""")
def mate_context_scores(spark: SparkSession, folder: str) -> DataFrame:
    s = hourly(spark, folder).select("source_id", "frame", "message_id", "n")
    best = training.best_predictor(s, HOUR).select("message_id", "mate")
    p = training.cooccurrence(s)
    both = p.select(F.col("a").alias("message_id"), F.col("b").alias("mate"), "joint").unionByName(p.select(F.col("b").alias("message_id"), F.col("a").alias("mate"), "joint"))
    counts = s.groupBy("message_id").agg(F.count(F.lit(1)).alias("c"))
    got = context.mate_scores(s, best.join(both, ["message_id", "mate"]), counts, training.n_intervals(s, HOUR).scalar())
    return got.withColumn("prob", F.round("prob", 9))


@query(f"""with {E}, h as (select message_id, source_id, ms // 3600000 f, count(*) * 1.0 n from e group by all), t as (select message_id, count(*) + 50 as n, list_sort(list_concat(list_transform(range(0, 50), lambda x: 0.0), list(n))) v from h group by 1),
g as (select message_id, n, v, b, b / 100.0 * (n + 1) pos, cast(floor(b / 100.0 * (n + 1)) as integer) lo from t, (select unnest(range(0, 101)) b))
select message_id, cast(b as integer) bin, round(case when lo >= n then v[-1] else (case when lo = 0 then 0 else v[lo] end) + (pos - lo) * (coalesce(v[lo + 1], 0) - (case when lo = 0 then 0 else v[lo] end)) end, 6) as value from g""")
def percentile_nist_100(spark: SparkSession, folder: str) -> DataFrame:
    s = hourly(spark, folder).select("message_id", F.col("n").cast("double").alias("n"))
    # Fifty intervals without the message stand for zeros.
    total = s.groupBy("message_id").agg((F.count(F.lit(1)) + 50).alias("total"))
    return context.nist_percentiles(s.join(total, "message_id"), "message_id", "n", 100, F.col("total")).withColumn("value", F.round("value", 6))


@query(f"with {S}, i as (select source_id, frame, sum(n) score from s group by 1, 2), d as (select distinct source_id, frame - frame % 86400000 d from i), g as (select source_id, d, unnest(range(0, 24)) k from d) select g.source_id, d as day, cast(k as integer) serial, cast(score as bigint) score, score is null missing from g left join i on i.source_id = g.source_id and i.frame = d + k * 3600000")
def period_index(spark: SparkSession, folder: str) -> DataFrame:
    scores = hourly(spark, folder).groupBy("source_id", "frame").agg(F.sum("n").alias("score"))
    return writers.period_index(scores, HOUR, ["source_id"]).select("source_id", "day", "serial", "score", "missing")


@query(f"with {E}, h as (select source_id, message_id, ms - ms % 600000 f, list_sort(list_distinct(list(cast((ms % 600000) * 120 // 600000 as integer)))) t from e group by all) select source_id, message_id, f as frame, array_to_string(list_sort(list_distinct(list_transform(t, lambda x: cast(floor((f + 5000 * (x + 0.5) - (f - f % 3600000)) / 30000) as integer)))), ',') ticks from h")
def timeline_rescale(spark: SparkSession, folder: str) -> DataFrame:
    s = training.interval_summaries(events(spark, folder), 600_000)
    hour = F.col("frame") - F.pmod("frame", F.lit(HOUR))
    return s.select("source_id", "message_id", "frame", F.array_join(context.rescaled_ticks(F.col("ticks"), F.col("frame"), 600_000, hour, HOUR).cast("array<string>"), ",").alias("ticks"))


@query(f"with {S} select message_id, count(*) k from s group by 1 having count(*) > 100")
def drop_rare_messages(spark: SparkSession, folder: str) -> DataFrame:
    return statistics.frequent_ids(hourly(spark, folder), 100)


@query("select o_orderkey, count(*) over (partition by o_custkey order by o_totalprice desc, o_orderkey) place, o_totalprice from orders qualify place <= 5")
def top5_per_key(spark: SparkSession, folder: str) -> DataFrame:
    w = W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, folder, "orders").select("o_orderkey", F.row_number().over(w).cast("long").alias("place"), "o_totalprice").where("place <= 5")


@query("select i.source_id, i.interval_serial, i.message_id, s.summary_id from (select distinct source_id, interval_serial, message_id from interval_messages) i left join message_summaries s on s.source_id = i.source_id and s.interval_serial = i.interval_serial and s.message_id = i.message_id")
def intervals_with_summaries(spark: SparkSession, folder: str) -> DataFrame:
    i = table(spark, folder, "interval_messages").select("source_id", "interval_serial", "message_id").distinct()
    return i.join(table(spark, folder, "message_summaries").select("source_id", "interval_serial", "message_id", "summary_id"), ["source_id", "interval_serial", "message_id"], "left")


@query("with v as (select v.vec_id, l.label, list_sum(list_transform(range(1, len(embedding) + 1), lambda i: (cast(embedding[i] as double) - m[i]) * (cast(embedding[i] as double) - m[i]))) d from embeddings v join (select label, list(a order by i) m from (select label, i, avg(cast(embedding[i] as double)) a from embeddings, unnest(range(1, len(embedding) + 1)) u(i) group by 1, 2) group by 1) l on true) select vec_id, cast(arg_min(label, (d, label)) as integer) nearest, round(sqrt(min(d)), 4) distance from v group by 1")
def nearest_centroid(spark: SparkSession, folder: str) -> DataFrame:
    v = table(spark, folder, "embeddings").select("vec_id", "label", F.posexplode(F.transform("embedding", lambda x: x.cast("double"))).alias("i", "x"))
    means = v.groupBy("label", "i").agg(F.avg("x").alias("a")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "a"))), lambda s: s["a"]).alias("m"))
    # The centroids are as many as labels: one array for all tasks.
    table_of = means.agg(F.collect_list(F.struct("label", "m")).alias("c")).scalar()
    rows = table(spark, folder, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e")).withColumn("c", table_of)
    square = lambda m: F.aggregate(F.zip_with("e", m, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    best = F.array_min(F.transform("c", lambda k: F.struct(square(k["m"]).alias("d"), k["label"].alias("label"))))
    return rows.withColumn("best", best).select("vec_id", F.col("best.label").cast("int").alias("nearest"), F.round(F.sqrt("best.d"), 4).alias("distance"))


@query()
def kmeans_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return clusters.kmeans(table(spark, folder, "embeddings"), "vec_id", "embedding")


@query("select c_mktsegment, round(bround, 1) as rounded from (select c_mktsegment, round_even(sum(c_acctbal) / count(*), 1) bround from customer group by 1)")
def round_half_even(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").groupBy("c_mktsegment").agg(F.bround(F.avg("c_acctbal"), 1).alias("rounded"))


@query(f"with {E}, b as (select *, case when ms - lag(ms) over (partition by source_id order by ms) <= 1800000 then 0 else 1 end b from e), r as (select *, sum(b) over (partition by source_id order by ms) run from b), g as (select source_id, run, count(*) n, max(ms) - min(ms) span, count(distinct message_id) k from r group by 1, 2) select source_id, count(*) runs, round(avg(n), 6) mean_n, max(span) max_span, round(avg(k), 6) mean_ids from g group by 1")
def message_stream_stats(spark: SparkSession, folder: str) -> DataFrame:
    r = framing.runs(events(spark, folder), ["source_id"], "ms", 1_800_000).groupBy("source_id", "run").agg(F.count(F.lit(1)).alias("n"), (F.max("ms") - F.min("ms")).alias("span"), F.count_distinct("message_id").alias("k"))
    return r.groupBy("source_id").agg(F.count(F.lit(1)).alias("runs"), F.round(F.avg("n"), 6).alias("mean_n"), F.max("span").alias("max_span"), F.round(F.avg("k"), 6).alias("mean_ids"))


@query("with p as (select lower(trim(source_id, ' \t\r\n')) s, interval_serial // 6 h, min(interval_serial) a, max(interval_serial) + 3 b from interval_messages group by 1, 2), o as (select *, max(b) over (partition by s order by a, b rows between unbounded preceding and 1 preceding) before from p) select s source_id, a low, b high from o where before > a")
def overlapping_periods(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "interval_messages").groupBy(plain_id("source_id").alias("source_id"), F.floor(F.col("interval_serial") / 6).alias("h")).agg(F.min("interval_serial").alias("low"), (F.max("interval_serial") + 3).alias("high"))
    return context.overlaps(p, "source_id", "low", "high").select("source_id", "low", "high")


@query(f"with {S}, {_MU} select message_id, cast(ceil(exp(mu + sigma * sqrt(-2 * ln(0.1)))) as bigint) n_90, cast(ceil(exp(mu + sigma * sqrt(-2 * ln(0.01)))) as bigint) n_99 from m")
def count_thresholds(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.count_thresholds(training.log_normal(hourly(spark, folder)))


_OUT = "case when c.cluster is not null and k > 1 and k / size >= 0.3 then 0 else 1 end"


@query(f"with {S}, {_CL}, x as (select s.message_id, {_OUT} o from (select s.*, c.cluster, count(c.cluster) over (partition by s.source_id, s.frame, c.cluster) k from s left join c using (message_id)) s left join c using (message_id) left join z on z.cluster = c.cluster) select message_id, count(*) seen, cast(sum(o) as bigint) seen_out, round((sum(o) + 0.5) / (n_intervals + 1), 9) out_probability from x, nn group by message_id, n_intervals")
def bernoulli_out_of_context(spark: SparkSession, folder: str) -> DataFrame:
    s = hourly(spark, folder).select("source_id", "frame", "message_id")
    marked = context.context_status(s, _labels(s), s).withColumn("inside", F.col("status") == "IN_CONTEXT")
    seen = marked.groupBy("message_id").agg(F.count(F.lit(1)).alias("seen"), F.sum(F.when(F.col("inside"), 0).otherwise(1)).alias("seen_out"))
    got = training.bernoulli_full(marked, HOUR, "inside").select("message_id", F.round("out_probability", 9).alias("out_probability"))
    return seen.join(got, "message_id")
