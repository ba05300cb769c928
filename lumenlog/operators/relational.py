"""Relational operators: dictionaries, glob rules, upserts, routing, set differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenlog.functions.text import glob_pattern
from lumenlog.operators.ordering import running_sum


def dictionary(words: DataFrame, column: str, known: DataFrame | None = None) -> DataFrame:
    """(word, id): ids of known words stay; new words get the next numbers in order of the words.

    New words are numbered within pieces of their order plus the pieces' offsets, so no task sorts all words."""
    new = words.where(F.col(column).isNotNull()).select(F.col(column).alias("word")).distinct()
    base = F.lit(0)
    if known is not None:
        new = new.join(known.select("word"), "word", "left_anti")
        base = known.agg(F.coalesce(F.max("id") + 1, F.lit(0)).alias("m")).scalar()
    numbered = running_sum(new.withColumn("one", F.lit(1)), "word", "one", "place")
    out = numbered.withColumn("base", base).select("word", (F.col("place") - 1 + F.col("base")).cast("long").alias("id"))
    return out if known is None else known.select("word", "id").unionByName(out)


def assign_groups(sources: DataFrame, rules: DataFrame, source: str = "source_id") -> DataFrame:
    """(source, group): the first rule by evaluation order whose glob matches, else UNASSIGNED.

    Rules (group_name, rule, evaluation_order) are a short list; Spark broadcasts them only below its size threshold."""
    matched = sources.select(source).distinct().join(rules.select("group_name", "evaluation_order", glob_pattern(F.col("rule")).alias("pattern")), F.expr(f"`{source}` rlike pattern"), "left")
    return matched.groupBy(source).agg(F.coalesce(F.min_by("group_name", "evaluation_order"), F.lit("UNASSIGNED")).alias("group_name"))


def upsert(stored: DataFrame, fresh_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows with the fresh ones in place of those with the same keys."""
    return stored.join(fresh_rows.select(*keys), keys, "left_anti").unionByName(fresh_rows)


def set_changes(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change): what to add, delete or update to get from old to new."""
    both = old.select(key, F.col(value).alias("was"), F.lit(True).alias("in_old")).join(new.select(key, F.col(value).alias("is"), F.lit(True).alias("in_new")), key, "full")
    change = F.when(F.col("in_old").isNull(), "add").when(F.col("in_new").isNull(), "delete").when(~F.col("was").eqNullSafe(F.col("is")), "update")
    return both.select(key, change.alias("change")).where("change is not null")


def first_rows(df: DataFrame, keys: list[Column | str], order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of every key."""
    return df.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(f"place <= {most}").drop("place")


def best_names(old: DataFrame, new: DataFrame, least: float = 0.5) -> DataFrame:
    """(new_id, old_id, similarity): cluster names carried over where member sets share more than ``least`` (Jaccard).

    Both sides are (id, member); only clusters with a common member meet."""
    a, b = old.select(F.col("id").alias("old_id"), "member").distinct(), new.select(F.col("id").alias("new_id"), "member").distinct()
    common = a.join(b, "member").groupBy("old_id", "new_id").agg(F.count(F.lit(1)).alias("common"))
    sa, sb = a.groupBy("old_id").agg(F.count(F.lit(1)).alias("sa")), b.groupBy("new_id").agg(F.count(F.lit(1)).alias("sb"))
    j = F.col("common") / (F.col("sa") + F.col("sb") - F.col("common"))
    return common.join(sa, "old_id").join(sb, "new_id").select("new_id", "old_id", j.alias("similarity")).where(F.col("similarity") > least)


def decoded(df: DataFrame, words: DataFrame, column: str, out: str) -> DataFrame:
    """``df`` with ``out``: the word of each id in ``column``; null for an id that the dictionary doesn't have."""
    return df.join(words.select(F.col("id").alias(column), F.col("word").alias(out)), column, "left")


def renamed(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """The columns that ``mapping`` names, under their new names; one that ``df`` doesn't have is an error."""
    missing = sorted(set(mapping) - set(df.columns))
    if missing:
        raise KeyError(f"no such statistics: {missing}")
    return df.select(*[F.col(old).alias(new) for old, new in mapping.items()])


def prefixed(charts: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Statistics of several scorers side by side, each named scorer.statistic; every scorer has one row per key."""
    out = None
    for name, df in charts.items():
        own = df.select(*keys, *[F.col(f"`{c}`").alias(f"{name}.{c}") for c in df.columns if c not in keys])
        out = own if out is None else out.join(own, keys, "full")
    if out is None:
        raise ValueError("no scorers")
    return out


def legal_pairs(pairs: DataFrame, legal: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Pairs of which both sides are among ``legal`` (message_id)."""
    ids = legal.select("message_id").distinct()
    return pairs.join(ids.withColumnRenamed("message_id", a), a, "left_semi").join(ids.withColumnRenamed("message_id", b), b, "left_semi").select(*pairs.columns)


def trainable_intervals(intervals: DataFrame, messages: DataFrame, huge: float = 1001.0) -> DataFrame:
    """Intervals (source_id, frame, n_ids) that interval scores are trained on: with messages, and none of them with the score ``huge``."""
    bad = messages.where(F.col("anomaly") == huge).select("source_id", "frame").distinct()
    return intervals.where("n_ids > 0").join(bad, ["source_id", "frame"], "left_anti")


def managed_systems(df: DataFrame, at: str) -> DataFrame:
    """(source_id, os_name, offset): the latest operating system and offset of every source; nulls don't replace what was known."""
    known = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(at))).alias(c)
    return df.groupBy("source_id").agg(known("os_name"), known("offset"))


def evolution(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, size, change, names): what became of each old cluster (id, member): 'unchanged', 'contained' in one new cluster, or 'split'; the new clusters with its members in order."""
    a = old.select("id", "member").distinct()
    b = new.select(F.col("id").alias("new_id"), "member").distinct()
    sizes, new_sizes = a.groupBy("id").agg(F.count(F.lit(1)).alias("size")), b.groupBy("new_id").agg(F.count(F.lit(1)).alias("new_size"))
    common = a.join(b, "member").groupBy("id", "new_id").agg(F.count(F.lit(1)).alias("k")).join(new_sizes, "new_id")
    met = common.groupBy("id").agg(F.max("k").alias("most"), F.max(F.struct("k", (-F.col("new_size")).alias("less"))).alias("best"), F.array_sort(F.collect_set("new_id")).alias("names"))
    whole = F.col("most") == F.col("size")
    change = F.when(whole & (-F.col("best.less") == F.col("size")), "unchanged").when(whole, "contained").otherwise("split")
    return sizes.join(met, "id", "left").select("id", "size", change.alias("change"), F.coalesce("names", F.array().cast("array<string>")).alias("names"))


def initial_partition(summaries: DataFrame, step: float = 2.0) -> DataFrame:
    """(message_id, cluster): ids grouped by how many intervals they are in, by powers of ``step``; the name says the least number."""
    per = summaries.groupBy("message_id").agg(F.count(F.lit(1)).alias("k"))
    level = F.floor(F.log(F.col("k").cast("double")) / F.log(F.lit(step)) + 1e-9)
    return per.select("message_id", F.concat(F.lit("from_"), F.ceil(F.pow(F.lit(step), level)).cast("string")).alias("cluster"))


def indexed(df: DataFrame, column: str, order: str) -> DataFrame:
    """(value, index): distinct values numbered from 0 in the order in which they first come."""
    first = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.min(F.struct(order, column)).alias("first"))
    return running_sum(first.withColumn("one", F.lit(1)), "first", "one", "place").select("value", (F.col("place") - 1).cast("long").alias("index"))


def without_groups(groups: DataFrame, unselected: list[str]) -> DataFrame:
    """All groups but those named, without case; an unknown name is an error."""
    names = {n.lower() for n in unselected}
    known = {r["g"] for r in groups.select(F.lower("group_name").alias("g")).distinct().where(F.col("g").isin(sorted(names))).collect()}
    if names - known:
        raise ValueError(f"unknown groups: {sorted(names - known)}")
    return groups.where(~F.lower("group_name").isin(sorted(names)))


def sources_of(sources: DataFrame, managed: DataFrame, os_name: str) -> DataFrame:
    """Sources whose managed system runs an operating system."""
    return sources.join(managed.where(F.col("os_name") == os_name).select("source_id", "offset"), "source_id")
