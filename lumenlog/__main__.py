"""Commands over a store of logs: python -m lumenlog COMMAND --help"""

from __future__ import annotations

import argparse
import sys
from datetime import datetime, timedelta

from pyspark.sql import SparkSession


def training_span(start: str | None, end: str | None, days: int | None, today: str) -> tuple[str | None, str]:
    """First and last day of training: of start, end and a number of days two say it all; the end is yesterday unless given."""
    day = lambda t: datetime.strptime(t, "%Y-%m-%d")
    if start and end and days is not None:
        raise ValueError("start, end and days at once")
    if start and days is not None:
        return start, (day(start) + timedelta(days=days - 1)).strftime("%Y-%m-%d")
    last = end or (day(today) - timedelta(days=1)).strftime("%Y-%m-%d")
    first = start or ((day(last) - timedelta(days=days - 1)).strftime("%Y-%m-%d") if days is not None else None)
    if first and first > last:
        raise ValueError(f"{first} lies after {last}")
    return first, last


def _arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lumenlog", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of the queries")
    sub.add_parser("version")
    run = sub.add_parser("run", help="a query over a folder of tables")
    run.add_argument("name"), run.add_argument("folder"), run.add_argument("out")
    sql = sub.add_parser("sql", help="statements over a folder of tables")
    sql.add_argument("folder"), sql.add_argument("text")
    for name, note in (("upload", "log files into a store"), ("analyze", "scores of log files by the default model")):
        c = sub.add_parser(name, help=note)
        c.add_argument("store"), c.add_argument("path")
        c.add_argument("--arrived", default=datetime.now().strftime("%Y-%m-%d %H:%M:%S")), c.add_argument("--zone", default="UTC"), c.add_argument("--flow"), c.add_argument("--group")
    train = sub.add_parser("train", help="a model from a store")
    train.add_argument("store"), train.add_argument("name")
    train.add_argument("--start"), train.add_argument("--end"), train.add_argument("--days", type=int), train.add_argument("--exclude", nargs="*", default=[]), train.add_argument("--sources", nargs="*"), train.add_argument("--group"), train.add_argument("--flow")
    verify = sub.add_parser("verify", help="whether sources have enough to train on, or whether a flow is right")
    verify.add_argument("store"), verify.add_argument("--flow")
    mask = sub.add_parser("mask", help="log files without addresses and names")
    mask.add_argument("path"), mask.add_argument("out"), mask.add_argument("--name", nargs=2, action="append", default=[]), mask.add_argument("--host", default="system")
    tables = sub.add_parser("tables", help="create, drop, empty or count the tables of a database")
    tables.add_argument("what", choices=("create", "drop", "empty", "count")), tables.add_argument("database")
    stats = sub.add_parser("stats", help="statistics of the messages of log files")
    stats.add_argument("path"), stats.add_argument("--arrived", default=datetime.now().strftime("%Y-%m-%d %H:%M:%S")), stats.add_argument("--zone", default="UTC")
    return p


def main(args: list[str]) -> int:
    a = _arguments().parse_args(args)
    from lumenlog import catalog, pipeline
    from lumenlog import flow as flows
    from lumenlog.operators import statistics
    from lumenlog.plans import analytics, details, models, problems

    queries = {**analytics.QUERIES, **details.QUERIES, **models.QUERIES, **problems.QUERIES}
    if a.command == "list":
        print("\n".join(sorted(queries)))
        return 0
    if a.command == "version":
        print(catalog.VERSION)
        return 0
    spark = SparkSession.builder.appName("lumenlog").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    flow = flows.load(spark, a.flow) if getattr(a, "flow", None) else flows.Flow()
    if a.command == "run":
        queries[a.name](spark, a.folder).write.mode("overwrite").parquet(a.out)
    elif a.command == "sql":
        catalog.register(spark, a.folder)
        for df in catalog.ask(spark, a.text):
            df.show(truncate=False)
    elif a.command == "upload":
        pipeline.upload(spark, pipeline.with_ids(pipeline.parsed(spark, a.path, a.arrived, a.zone)), a.store, flow)
    elif a.command == "analyze":
        pipeline.analyze(spark, pipeline.with_ids(pipeline.parsed(spark, a.path, a.arrived, a.zone)), a.store, flow, a.group)[1].orderBy("source_id", "frame").show(100, truncate=False)
    elif a.command == "train":
        low, high = training_span(a.start, a.end, a.days, datetime.now().strftime("%Y-%m-%d"))
        print(pipeline.train(spark, a.store, a.name, flow, a.group, a.sources, low, high, a.exclude))
    elif a.command == "verify":
        pipeline.verify(spark, a.store, flow).show(100, truncate=False)
    elif a.command == "mask":
        pipeline.mask(spark, a.path, a.out, dict(a.name), a.host)
    elif a.command == "stats":
        m = pipeline.with_ids(pipeline.parsed(spark, a.path, a.arrived, a.zone))
        statistics.stream_statistics(m, 1_800_000).show(100, truncate=False)
        statistics.rate_summary(m).show(100, truncate=False)
    else:
        {"create": catalog.create_tables, "drop": catalog.drop_tables, "empty": catalog.empty_tables, "count": lambda s, d: catalog.table_sizes(s, d).show(100)}[a.what](spark, a.database)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
