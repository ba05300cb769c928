"""Queries of training and scoring in context of clusters, of summaries as a whole, and of times since a message was last seen, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.functions.ids import plain_id
from lumenlog.operators import clusters, context, scoring, training
from lumenlog.operators.templates import templates
from lumenlog.plans.analytics import _CL, _CRIT, E, HOUR, S, _labels, hourly, registry
from lumenlog.sources.tables import table

QUERIES, SQL, query = registry()

# An id is in context where more than one member of its cluster is in the interval, and at least three tenths of them.
_IN = f"""{S}, {_CL}, k as (select s.*, c.cluster, z.size, case when c.cluster is not null and count(c.cluster) over (partition by s.source_id, s.frame, c.cluster) > 1 and count(c.cluster) over (partition by s.source_id, s.frame, c.cluster) / size >= 0.3 then 1 else 0 end inside
  from s left join c using (message_id) left join z on z.cluster = c.cluster),
l as (select message_id, avg(ln(n)) filter (inside = 0) mu0, max(n) max_n, count(*) c, count(*) filter (inside = 0) c_out, sum(n) filter (inside = 0) n_out from k group by 1),
f as (select *, coalesce(mu0, (select least(1.0, min(mu0)) from l where mu0 > 0), 1.0) mu from l),
g as (select *, greatest(0.5, sqrt(mu)) sigma, coalesce(mu0 > 0, false) and ln(max_n) > mu and power((ln(max_n) - mu) / greatest(0.5, sqrt(mu)), 2) / 2 >= 15 bad from f),
x as (select k.source_id, k.frame, k.message_id, k.n, inside, (case when inside = 0 and cluster is not null then c_out else c end + 0.5) / (n_intervals + 1) p, case when inside = 1 or bad or ln(k.n) <= mu then 0.0 else power((ln(k.n) - mu) / sigma, 2) / 2 end count_score, mu
  from k join g on g.message_id = k.message_id, nn)"""


@query(f"with {_IN} select source_id, frame, message_id, round(-ln(p / (1 - p)), 6) rarity, round(count_score, 6) count_score, round(exp(mu), 6) count_mean, round(1 / p, 6) frequency, round(case when inside = 1 then 0.0 else 0.2 * count_score + 0.8 * -ln(p / (1 - p)) end, 6) anomaly from x")
def context_message_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Scores in context: statistics in context are left out of training, and what a cluster explains has score 0."""
    s = hourly(spark, folder).select("source_id", "frame", "message_id", "n")
    got = scoring.message_scores(s, HOUR, _labels(s))
    return got.select("source_id", "frame", "message_id", *[F.round(c, 6).alias(c) for c in ("rarity", "count_score", "count_mean", "frequency", "anomaly")])


@query(f"with {_IN} select message_id, round(mu, 9) mu, max_n, bad bad_fit from g")
def lognormal_out_of_context(spark: SparkSession, folder: str) -> DataFrame:
    s = hourly(spark, folder)
    marked = context.context_status(s, _labels(s), s).withColumn("inside", F.col("status") == "IN_CONTEXT")
    return training.log_normal(marked, "inside").select("message_id", F.round("mu", 9).alias("mu"), "max_n", "bad_fit")


_FACT = "lgamma(n + 1.0)"


@query(f"with {_IN}, r as (select message_id, n_out / n_intervals rate from g, nn), w as (select coalesce(least(1.0, min(rate)), 1.0) least_rate from r where rate > 0), y as (select k.source_id, k.frame, k.message_id, k.n, inside, coalesce(rate, 0) rate, least_rate, case when coalesce(rate, 0) <= 0 then least_rate else rate end t from k join r on r.message_id = k.message_id, w) select source_id, frame, message_id, round(case when inside = 1 then 0.0 else -(n * ln(t) - t - {_FACT}) end, 6) poisson_score, round(-(n * ln(least_rate) - least_rate - {_FACT}), 6) poisson_most, round(case when inside = 1 then 0.0 when rate <= 0 then 1.0 else 0.999 * (1 - exp(n * ln(t) - t - {_FACT})) end, 6) poisson_main from y")
def poisson_scores_in_context(spark: SparkSession, folder: str) -> DataFrame:
    s = hourly(spark, folder).select("source_id", "frame", "message_id", "n")
    marked = context.context_status(s, _labels(s), s)
    model = training.poisson(marked.withColumn("inside", F.col("status") == "IN_CONTEXT"), HOUR, "inside")
    return scoring.poisson_scores(marked, model).select("source_id", "frame", "message_id", *[F.round(c, 6).alias(c) for c in ("poisson_score", "poisson_most", "poisson_main")])


@query()
def clustered_message_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The whole chain: clusters of information by mutual information, those worth keeping, the status of every id in every interval, and the scores."""
    s = hourly(spark, folder).select("source_id", "frame", "message_id", "n")
    pairs = training.mutual_information(s, HOUR).select("a", "b", "mi")
    found = clusters.information_clusters(pairs)
    kept = found.join(clusters.kept_clusters(found, pairs).select("cluster"), "cluster", "left_semi").select("message_id", "cluster")
    got = scoring.message_scores(s, HOUR, kept)
    return got.select("source_id", "frame", "message_id", "cluster", "status", *[F.round(c, 6).alias(c) for c in ("rarity", "count_score", "anomaly")])


@query(f"with {_IN} select source_id, frame, message_id, round((case when inside = 1 then 0.0 else 0.2 * count_score + 0.8 * -ln(p / (1 - p)) end) * case length(message_id) % 5 when 4 then 2.0 when 0 then 0.5 else 1.0 end, 6) anomaly from x")
def severity_weighted_scores(spark: SparkSession, folder: str) -> DataFrame:
    s = hourly(spark, folder).select("source_id", "frame", "message_id", "n", (F.length("message_id") % 5).alias("severity"))
    got = scoring.message_scores(s, HOUR, _labels(s), {4: 2.0, 0: 0.5})
    return got.select("source_id", "frame", "message_id", F.round("anomaly", 6).alias("anomaly"))


@query(f"with {_IN}, m as (select source_id, frame, message_id, inside, count_score, -ln(p / (1 - p)) rarity, 1 - p / (1 - p) bernoulli, 1 - exp(-count_score) lognormal from x) select source_id, frame, message_id, round(greatest(0.0, bernoulli, lognormal), 6) worst, case when greatest(bernoulli, lognormal) <= 0 then null when bernoulli >= lognormal then 'bernoulli' else 'lognormal' end scorer, case when rarity is null and nullif(count_score, 0) is null then 'none' when rarity is null or nullif(count_score, 0) < rarity then 'count' else 'rarity' end used from m")
def integrated_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The worst of the scorers with its name, and the better explained of rarity and count."""
    s = hourly(spark, folder).select("source_id", "frame", "message_id", "n")
    got = scoring.message_scores(s, HOUR, _labels(s))
    worst, name = scoring.most_abnormal({"bernoulli": F.col("rarity_main"), "lognormal": F.col("count_main")})
    used, _, _ = scoring.best_of_two_stats(("rarity", F.col("rarity")), ("count", F.nullif("count_score", F.lit(0.0))))
    return got.select("source_id", "frame", "message_id", F.round(worst, 6).alias("worst"), name.alias("scorer"), used.alias("used"))


_SEEN = f"""{E}, t as (select source_id, ms - ms % 3600000 frame, message_id, list_sort(list_distinct(list(cast((ms % 3600000) * 120 // 3600000 as integer)))) t from e group by all),
v as (select *, lag(frame + t[-1] * 30000) over (partition by source_id, message_id order by frame) p from t),
d as (select source_id, frame, message_id, p, list_prepend(cast(floor((frame + t[1] * 30000 - coalesce(p, frame)) / 1000) as bigint), list_transform(range(2, len(t) + 1), lambda i: cast((t[i] - t[i - 1]) * 30 as bigint))) deltas from v)"""


@query(f"with {_SEEN} select source_id, frame, message_id, case when p is null then 'neverSeenBefore' else 'regular' end status, array_to_string(deltas, ',') deltas, p last_ms from d")
def last_seen_deltas(spark: SparkSession, folder: str) -> DataFrame:
    got = context.last_seen(hourly(spark, folder), HOUR)
    return got.select("source_id", "frame", "message_id", "status", F.array_join(F.col("deltas").cast("array<string>"), ",").alias("deltas"), "last_ms")


@query(f"""with {_SEEN}, h as (select message_id, delta, count(*) c from (select message_id, unnest(deltas) delta from d) group by 1, 2), m as (select message_id, sum(c) points, count(*) bins, max(c) top from h group by 1),
w as (select message_id, points, top, points >= 10 and top > 10 and points / bins > 2 good from m), u as (select source_id, frame, d.message_id, unnest(deltas) delta, unnest(list_prepend(null, deltas[:-2])) before from d),
z as (select u.source_id, u.frame, u.message_id, max(coalesce(least(ln(w.top) - ln(a.c), ln(w.top) - ln(b.c)), ln(w.top) + ln(2))) worst from u join w on w.message_id = u.message_id and good left join h a on a.message_id = u.message_id and a.delta = u.delta and a.c > 1 left join h b on b.message_id = u.message_id and b.delta = u.delta + u.before and b.c > 1 group by 1, 2, 3)
select d.source_id, d.frame, d.message_id, round(coalesce(greatest(worst, 0), 0), 6) log_prob, round(case when good then greatest(worst, 0) - ln(top / points) end, 6) given_last from d join w on w.message_id = d.message_id left join z on z.source_id = d.source_id and z.frame = d.frame and z.message_id = d.message_id""")
def last_seen_scores(spark: SparkSession, folder: str) -> DataFrame:
    seen = context.last_seen(hourly(spark, folder), HOUR)
    got = context.last_seen_scores(seen, context.periodicity_model(seen))
    return got.select("source_id", "frame", "message_id", F.round("log_prob", 6).alias("log_prob"), F.round("given_last", 6).alias("given_last"))


@query(f"""with {_IN}, y as (select source_id, frame, round(sum(case when inside = 1 then 0.0 else 0.2 * count_score + 0.8 * -ln(p / (1 - p)) end), 5) score from x group by 1, 2), v as (select score, row_number() over (order by score) - 1 k, count(*) over () n from y), pt as (select bucket, score as p from (select unnest(range(0, 1000)) bucket) b join v on v.k = n * bucket // 1000)
select source_id, frame, score, round(greatest(0.2, case when score > 1.5 * (select max(p) from pt) then 1.01 else least(1.0, (select count(*) from pt where p < score) / 1000.0) end), 6) anomaly, round(case when case when score > 1.5 * (select max(p) from pt) then 1.01 else least(1.0, (select count(*) from pt where p < score) / 1000.0) end < 0.2 then -ln(0.8) else score end, 5) log_prob from y""")
def final_interval_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Interval scores in context as ranks of at least 0.2."""
    s = hourly(spark, folder).select("source_id", "frame", "message_id", "n")
    sums = scoring.interval_scores(scoring.message_scores(s, HOUR, _labels(s))).select("source_id", "frame", F.round("score", 5).alias("score"))
    got = scoring.final_interval_scores(scoring.percentile_rank(sums), 0.2)
    return got.select("source_id", "frame", "score", F.round("anomaly", 6).alias("anomaly"), F.round("log_prob", 5).alias("log_prob"))


_M = rf"m as (select nullif(lower(trim(source_id, ' \t\r\n')), '') source_id, nullif(lower(trim(message_id, ' \t\r\n')), '') message_id, epoch_us(ts) // 1000 ms, instance_id, text, severity, cnt, cnt_failed, len(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: list_contains([{_CRIT}], w))) score from messages)".replace(r"\t\r\n", "\t\r\n")
_WHOLE = f"{_M}, g as (select source_id, ms - ms % 600000 frame, message_id, cast(sum(coalesce(cnt, 1)) as bigint) n, cast(sum(coalesce(cnt_failed, 0)) as bigint) failed, min(ms) first_ms, arg_min(coalesce(severity, -1), (ms, instance_id)) severity, max(score) critical, arg_max(text, (score, -ms, -instance_id)) filter (text is not null) sample, list_sort(list_distinct(list(cast((ms % 600000) * 120 // 600000 as integer)))) ticks from m group by 1, 2, 3)"


def _messages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "messages").select(plain_id("source_id").alias("source_id"), plain_id("message_id").alias("message_id"), F.expr("unix_micros(cast(ts as timestamp)) div 1000").alias("ms"), "instance_id", "text", "severity", "cnt", "cnt_failed")


@query(f"with {_WHOLE} select source_id, frame, message_id, n, failed, first_ms, nullif(severity, -1) severity, critical, sample, array_to_string(ticks, ',') ticks from g")
def whole_summaries(spark: SparkSession, folder: str) -> DataFrame:
    return training.message_summaries(_messages(spark, folder), 600_000).withColumn("ticks", F.array_join(F.col("ticks").cast("array<string>"), ","))


@query(f"with {_WHOLE} select source_id, message_id, frame // 3600000 as hour, cast(sum(n) as bigint) n, cast(sum(failed) as bigint) failed, min(first_ms) first_ms, nullif(max(severity), -1) severity, max(critical) critical, arg_max(sample, (critical, -first_ms)) filter (critical is not null) sample from g group by 1, 2, 3")
def merged_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """Ten-minute summaries merged into hours: the severity is the largest, the sample the most critical."""
    fine = training.message_summaries(_messages(spark, folder), 600_000).withColumn("hour", F.floor(F.col("frame") / HOUR))
    return training.merged_summaries(fine, ["source_id", "message_id", "hour"])


@query()
def interval_templates(spark: SparkSession, folder: str) -> DataFrame:
    """The template of each id's texts in each hour of a source."""
    m = _messages(spark, folder).withColumn("frame", F.floor(F.col("ms") / HOUR) * HOUR)
    return templates(m, ["source_id", "frame", "message_id"], "text", "instance_id")


@query(f"""with {E}, t as (select source_id, ms - ms % 3600000 frame, message_id, min((ms % 3600000) * 120 // 3600000) first, max((ms % 3600000) * 120 // 3600000) last from e group by 1, 2, 3), g as (select source_id, min(frame) lo, max(frame) hi from t group by 1),
u as (select coalesce(n.source_id, b.source_id) source_id, coalesce(n.frame, b.frame + 3600000) frame, coalesce(n.message_id, b.message_id) message_id, coalesce(b.last, 0) f, coalesce(n.first, 120) t from t n full join t b on b.source_id = n.source_id and b.frame + 3600000 = n.frame and b.message_id = n.message_id),
w as (select u.* from u join g using (source_id) where frame > lo and frame <= hi), z as (select t.* from t join g using (source_id) where frame = lo),
j as (select a.message_id a, b.message_id b, case when a.message_id = b.message_id then 120 - greatest(0, a.t - a.f) else 120 - greatest(0, a.t - a.f) - greatest(0, b.t - b.f) + greatest(0, least(a.t, b.t) - greatest(a.f, b.f)) end k from w a join w b on a.source_id = b.source_id and a.frame = b.frame and a.message_id <= b.message_id
union all select a.message_id, b.message_id, 120 from z a join z b on a.source_id = b.source_id and a.message_id <= b.message_id)
select a, b, cast(sum(k) as bigint) joint, (select cast(sum(1 + (hi - lo) / 3600000 * 120) as bigint) from g) total from j group by 1, 2""")
def smoothed_cooccurrence(spark: SparkSession, folder: str) -> DataFrame:
    return training.smoothed_cooccurrence(hourly(spark, folder), HOUR)
