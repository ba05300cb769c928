"""Tables by name, ad-hoc SQL, reference data, and the model registry."""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lumenlog.operators.relational import assign_groups, set_changes
from lumenlog.sources import files

#: Tables of a store with their columns.
TABLES = {
    "message_ids": "word string, id long", "component_ids": "word string, id long", "rules": "name string, description string, rule string", "groups": "group_name string, rule_name string, evaluation_order int",
    "sources": "source_id string, group_name string, log_type string", "managed_systems": "source_id string, os_name string, offset string", "periods": "source_id string, start long, end long, exclude boolean, status int, comment string",
    "intervals": "source_id string, frame long, n_ids long, coverage double", "summaries": "source_id string, frame long, message_id string, n long, failed long, severity int, sample string, critical long, ticks array<int>",
    "models": "path string, group_name string, is_default boolean, start long, end long, version string", "results": "source_id string, frame long, score double, anomaly double, n_ids long, n_new long, n_never long, limited boolean, model string",
    "text_clusters": "component string, number long, text string, last_day date",
}


def register(spark: SparkSession, folder: str) -> list[str]:
    """Temporary views of the Parquet tables of a folder; their names."""
    names = [re.sub(r"^.*/|\.parquet$", "", p) for p in files.found(spark, f"{folder}/*.parquet")]
    for n in names:
        spark.read.parquet(f"{folder}/{n}.parquet").createOrReplaceTempView(n)
    return names


def ask(spark: SparkSession, text: str) -> list[DataFrame]:
    """Results of statements separated by semicolons; those that change data have none to show."""
    return [spark.sql(s) for s in text.split(";") if s.strip()]


def one(df: DataFrame, needed: bool = False) -> object:
    """The value of a result of one column and at most one row; None (or an error where it is ``needed``) for no row, an error for more."""
    rows = df.limit(2).collect()
    if len(rows) > 1 or (needed and not rows):
        raise ValueError(f"{'no row' if not rows else 'several rows'} where one is wanted")
    return rows[0][0] if rows else None


def column(df: DataFrame, most: int = 100_000) -> list[object]:
    """The first column of a short result; more than ``most`` rows are an error, not a cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    return [r[0] for r in rows]


def each_row(df: DataFrame, call: Callable[[Row], None]) -> int:
    """Hands the rows to a function one by one, a partition at a time on the driver; their number."""
    n = 0
    for n, row in enumerate(df.toLocalIterator(), 1):
        call(row)
    return n


#: What names of groups, rules and sources may be: letters, digits and a few signs, so long at most.
NAME, LONGEST_NAME = r"\A[\p{L}\p{N}][\p{L}\p{N} ._*?-]*\z", 200


def bad_names(df: DataFrame, column: str, longest: int = LONGEST_NAME) -> DataFrame:
    """(value, reason) of names that can't be used: missing, too long, or with a sign that names can't have."""
    c = F.col(column)
    reason = F.when(F.coalesce(F.length(c), F.lit(0)) == 0, "missing").when(F.length(c) > longest, "too long").when(~c.rlike(NAME), "sign")
    return df.select(c.alias("value"), reason.alias("reason")).where("reason is not null")


def create_tables(spark: SparkSession, database: str) -> None:
    spark.sql(f"create database if not exists {database}")
    for name, columns in TABLES.items():
        spark.sql(f"create table if not exists {database}.{name} ({columns}) using parquet")


def drop_tables(spark: SparkSession, database: str) -> None:
    for name in TABLES:
        spark.sql(f"drop table if exists {database}.{name}")


def empty_tables(spark: SparkSession, database: str) -> None:
    for name in TABLES:
        spark.sql(f"truncate table {database}.{name}")


def table_sizes(spark: SparkSession, database: str) -> DataFrame:
    """(table, n) of all tables of a database."""
    counts = [spark.table(f"{database}.{t.name}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(t.name).alias("table"), "n") for t in spark.catalog.listTables(database)]
    return functools.reduce(DataFrame.unionByName, counts)


def updated_groups(sources: DataFrame, old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(changes, assignments, groups that lose their default model) on the way from ``old`` groups to ``new`` ones (group_name, rule, evaluation_order).

    A group that is deleted, or whose rule changed, has no default model any more."""
    keyed = lambda df: df.select("group_name", F.concat_ws("\u0000", "rule", F.col("evaluation_order").cast("string")).alias("what"))
    changes = set_changes(keyed(old), keyed(new), "group_name", "what")
    rules = set_changes(old.select("group_name", "rule"), new.select("group_name", "rule"), "group_name", "rule")
    return changes, assign_groups(sources, new), rules.where("change <> 'add'").select("group_name")


@functools.total_ordering
@dataclass(frozen=True)
class Version:
    """A version of numbers; missing ones are 0."""

    parts: tuple[int, ...]

    @classmethod
    def parse(cls, text: str) -> Version:
        if not re.fullmatch(r"\d+(\.\d+)*", text):
            raise ValueError(f"no version: {text!r}")
        return cls(tuple(map(int, text.split("."))))

    def _padded(self) -> tuple[int, ...]:
        return (*self.parts, *[0] * (8 - len(self.parts)))

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Version) and self._padded() == other._padded()

    def __hash__(self) -> int:
        return hash(self._padded())

    def __lt__(self, other: Version) -> bool:
        return self._padded() < other._padded()

    def __int__(self) -> int:
        """Three parts of three digits each."""
        a, b, c = self._padded()[:3]
        return (a * 1000 + b) * 1000 + c

    def __str__(self) -> str:
        return ".".join(map(str, self.parts))


#: Version of stored models, and the oldest that results can be written for.
VERSION, SUPPORTED = Version.parse("2.0"), Version.parse("1.0")


def store_model(models: dict[str, DataFrame], path: str, group: str | None, meta: dict[str, object], default: bool = False) -> None:
    """A model is a folder of Parquet tables and its metadata; the metadata is written last, so what a failed write leaves is no model, and is removed."""
    if not models:
        raise ValueError("a model has at least one table")
    spark = next(iter(models.values())).sparkSession
    try:
        for name, df in models.items():
            df.write.mode("overwrite").parquet(f"{path}/{name}")
        files.write_text(spark, f"{path}/model.json", json.dumps({"version": str(VERSION), **meta, "group": group, "default": False, "tables": sorted(models)}))
    except Exception:
        files.remove(spark, path)
        raise
    if default:
        set_default(spark, path)


def metadata(spark: SparkSession, path: str) -> dict[str, object]:
    return json.loads(files.read_text(spark, f"{path}/model.json"))


def models(spark: SparkSession, root: str) -> dict[str, dict[str, object]]:
    """Metadata of all models below a folder, by path."""
    return {p.rsplit("/", 1)[0]: json.loads(files.read_text(spark, p)) for p in files.found(spark, f"{root}/*/model.json")}


def set_default(spark: SparkSession, path: str) -> None:
    """Makes a model the default of its group; the one before is none any more."""
    root, own = path.rstrip("/").rsplit("/", 1)[0], metadata(spark, path)
    for other, meta in models(spark, root).items():
        if meta["default"] and meta["group"] == own["group"]:
            files.write_text(spark, f"{other}/model.json", json.dumps({**meta, "default": False}))
    files.write_text(spark, f"{path}/model.json", json.dumps({**own, "default": True}))


def load_model(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict[str, object]]:
    """Tables and metadata; a model older than SUPPORTED is refused."""
    meta = metadata(spark, path)
    if Version.parse(str(meta["version"])) < SUPPORTED:
        raise ValueError(f"model version {meta['version']} is not supported")
    return {n: spark.read.parquet(f"{path}/{n}") for n in meta["tables"]}, meta


def default_model(spark: SparkSession, root: str, group: str | None) -> str | None:
    """Folder of a group's default model, else of the default without a group."""
    known = models(spark, root)
    for wanted in (group, None):
        for path, meta in sorted(known.items(), reverse=True):
            if meta["default"] and meta["group"] == wanted:
                return path
    return None
