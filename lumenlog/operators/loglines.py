r"""Log lines of many programs into entries with fields.

Heads of entries are found by time-stamp expressions; every other line belongs to the last head before it in
its file. That cumulative grouping runs in blocks of a file's lines, so that no task gets a whole file: within a
block a window carries the last head forward, and one row per block (its last head) carries it over the
blocks before. Fields of heads come from an ordered cascade: one alternation whose branches are the layouts
in order, with named groups for the fields, applied in one replacement per head; key-value and
JSON heads, whose fields have no order, are branches of their own and are read by key.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenlog.sources.tables import fresh

# Severity of level words and of their initials; syslog priorities count modulo 8.
LEVELS = {
    1: "trace debug info notice t d i n",
    2: "warn warning w",
    3: "err error severe e s",
    4: "crit critical fatal alert emerg emergency panic c f a",
}
PRIORITIES = (4, 4, 4, 3, 2, 1, 1, 1)
STAMP_KEYS, LEVEL_KEYS, COMPONENT_KEYS, MESSAGE_KEYS = ("ts", "time", "@timestamp", "timestamp"), ("level", "lvl", "severity"), ("component", "app", "svc", "logger"), ("msg", "message")

_MONTH_DAY = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[ ]{1,2}\d{1,2}"
_VALUE = r'(?:"(?:[^"\\]++|\\.)*+"|[^\s"]*+)'
_SD = r'(?:-|(?:\[(?:[^"\]]++|"(?:[^"\\]++|\\.)*+")*+\])+)'

#: Layouts in the order in which they are tried: S stamp, P syslog priority, L level, C component, M message.
LAYOUTS = {
    "syslog 5424": rf"<P:\d{{1,3}}>\d <S:\S+> \S+ (?:-|<C:\S+>) \S+ \S+ {_SD}(?: <M:.*>)?",
    "syslog mark": rf"(?:<P:\d{{1,3}}>)?<S:{_MONTH_DAY} \d\d:\d\d:\d\d> \S+ <M:-- MARK -- ?>",
    "syslog 3164": rf"(?:<P:\d{{1,3}}>)?<S:{_MONTH_DAY} \d\d:\d\d:\d\d> \S+ <C:[^\s:\[\]]+>(?:\[[^\]\s]*\])?:(?: <M:.*>)?",
    "syslog free": rf"(?:<P:\d{{1,3}}>)?<S:{_MONTH_DAY} \d\d:\d\d:\d\d> \S+(?: <M:.*>)?",
    "bracketed": rf"\[<S:[A-Z][a-z]{{2}} {_MONTH_DAY} \d\d:\d\d:\d\d(?:\.\d+)? \d{{4}}>\] \[(?:<C:[^\]:\n]*>:)?<L:\w+>\](?: \[pid [^\]]*\])?(?: <M:.*>)?",
    "threaded": r"<S:\d{4}-\d\d-\d\d \d\d:\d\d:\d\d[,.]\d{1,9}> \[[^\]]*\] +<L:[A-Za-z]+> +<C:\S+> -(?: <M:.*>)?",
    "piped": r"<S:\d{4}\.\d\d\.\d\d \d\d:\d\d:\d\d(?:[.,]\d+)?> \| *<L:[A-Za-z]+> *\| *<C:[^|\n]*?> *\|(?: <M:.*>)?",
    "short": r"<S:\d\d/\d\d/\d\d \d\d:\d\d:\d\d> +<L:[A-Za-z]+> +<C:[^\s:]+>:(?: <M:.*>)?",
    "lettered": r"<L:[A-Z]><S:\d{4} \d\d:\d\d:\d\d\.\d{1,9}> +\d+ <C:[^\s:\]]+>:\d+\](?: <M:.*>)?",
}
KEYED = rf'\A(?:{"|".join(map(re.escape, STAMP_KEYS))})=\S+ (?:[\w.@-]+={_VALUE} ?)*+\z'
JSON = rf'\A\{{.*"(?:{"|".join(map(re.escape, STAMP_KEYS))})" ?:.*\}}\s*\z'

_FIELDS = "SPLCM"


def _compiled() -> tuple[str, str]:
    """The cascade as one anchored alternation with named groups, and the replacement that writes the fields, a line feed before each.

    No field but the message, which comes last, can hold a line feed, so a split into six pieces gives the fields back whatever a line holds."""
    numbers: dict[str, list[int]] = {c: [] for c in _FIELDS}
    branches = []
    for i, layout in enumerate(LAYOUTS.values()):
        pattern, at = "", 0
        layout = layout.replace(r"<P:\d{1,3}>\d", r"\x3c<P:\d{1,3}>\x3e\d").replace(r"(?:<P:\d{1,3}>)?", r"(?:\x3c<P:\d{1,3}>\x3e)?")
        while (m := re.compile(r"<([SPLCM]):").search(layout, at)) is not None:
            end = layout.index(">", m.end())
            numbers[m[1]].append(1 + sum(map(len, numbers.values())))
            pattern += layout[at : m.start()] + f"(?<{m[1]}{i}>{layout[m.end() : end]})"
            at = end + 1
        branches.append(pattern + layout[at:])
    return rf"(?s)\A(?:{'|'.join(branches)})\z", "".join("\n" + "".join(f"${n}" for n in numbers[c]) for c in _FIELDS)


CASCADE, REPLACEMENT = _compiled()

#: Cheap starts of the layouts: whether a line is a head.
HEAD = (
    r"\A(?:\x3c\d{1,3}\x3e\d \d{4}-\d\d-\d\dT\S+ |(?:\x3c\d{1,3}\x3e)?" + _MONTH_DAY + r" \d\d:\d\d:\d\d \S"
    r"|\[[A-Z][a-z]{2} " + _MONTH_DAY + r" \d\d:\d\d:\d\d(?:\.\d+)? \d{4}\] \[|\d{4}-\d\d-\d\d \d\d:\d\d:\d\d[,.]\d{1,9} \[[^\]]*\] +[A-Za-z]+ +\S+ -"
    r"|\d{4}\.\d\d\.\d\d \d\d:\d\d:\d\d(?:[.,]\d+)? \||\d\d/\d\d/\d\d \d\d:\d\d:\d\d +[A-Za-z]+ +[^\s:]+:|[A-Z]\d{4} \d\d:\d\d:\d\d\.\d{1,9} +\d+ [^\s:\]]+:\d+\])"
)


def _severity(level: Column, priority: Column) -> Column:
    word = F.lower(level)
    got = F.lit(0)
    for value, words in LEVELS.items():
        got = F.when(word.isin(words.split()), F.lit(value)).otherwise(got)
    by_priority = F.element_at(F.array(*map(F.lit, PRIORITIES)), (F.pmod(priority.try_cast("int"), F.lit(8)) + 1).cast("int"))
    return F.when(F.coalesce(priority, F.lit("")) != "", by_priority).otherwise(got)


def _keyed(line: Column, keys: tuple[str, ...]) -> Column:
    """The value as written of the first of the keys that a key-value line has; fields before it are stepped over whole."""
    return F.regexp_extract(line, rf'(?s)\A(?:[\w.@-]+={_VALUE} ?)*?(?:{"|".join(map(re.escape, keys))})=({_VALUE})', 1)


def _bare(value: Column) -> Column:
    """A key-value field's value without quotes and escapes."""
    inner = F.substr(value, F.lit(2), F.length(value) - 2)
    for code, char in (("n", "\n"), ("t", "\t"), ("r", "\r")):
        inner = F.regexp_replace(inner, rf"(?<!\\)((?:\\\\)*)\\{code}", f"$1{char}")
    return F.when(value.startswith('"'), F.regexp_replace(inner, r"(?s)\\(.)", "$1")).otherwise(value)


def _head(line: Column) -> Column:
    """Struct (stamp, severity, component, message) of a head, null for another line.

    A line that begins like a head but fits no layout to its end is another line: the cascade leaves it as it is, without the line feed in front."""
    parts = F.split(F.regexp_replace(line, CASCADE, REPLACEMENT), "\n", len(_FIELDS) + 1)
    field = lambda p, i: F.get(p, F.lit(i))
    text = F.transform(F.array(parts), lambda p: F.when(field(p, 0) == "", F.struct(field(p, 1).alias("stamp"), _severity(field(p, 3), field(p, 2)).alias("severity"), field(p, 4).alias("component"), field(p, 5).alias("message"))))[0]
    keyed = F.transform(
        F.array(line),
        lambda x: F.struct(_bare(_keyed(x, STAMP_KEYS)).alias("stamp"), _severity(_bare(_keyed(x, LEVEL_KEYS)), F.lit("")).alias("severity"), _bare(_keyed(x, COMPONENT_KEYS)).alias("component"), _bare(_keyed(x, MESSAGE_KEYS)).alias("message")),
    )[0]
    names = [*STAMP_KEYS, *LEVEL_KEYS, *COMPONENT_KEYS, *MESSAGE_KEYS]
    schema = ", ".join(f"`{n}` string" for n in names)
    first = lambda o, keys: F.coalesce(*[o[k] for k in keys], F.lit(""))
    json = F.transform(F.array(F.from_json(line, schema)), lambda o: F.when(first(o, STAMP_KEYS) != "", F.struct(first(o, STAMP_KEYS).alias("stamp"), _severity(first(o, LEVEL_KEYS), F.lit("")).alias("severity"), first(o, COMPONENT_KEYS).alias("component"), first(o, MESSAGE_KEYS).alias("message"))))[0]
    return F.when(line.rlike(HEAD), text).when(line.rlike(KEYED), keyed).when(line.rlike(rf"(?s){JSON}"), json)


def _placed(df: DataFrame, block_lines: int) -> tuple[DataFrame, str]:
    """Lines with the line number of their entry's head (column named second); lines before a file's first head are left out."""
    start, blk, last = (fresh(df, x) for x in ("start", "block", "last"))
    lines = df.withColumn(blk, F.floor(F.col("line_no") / block_lines))
    own = F.when(F.col("head").isNotNull(), F.col("line_no"))
    within = W.partitionBy("file", blk).orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    blocks = lines.groupBy("file", blk).agg(F.max(own).alias(last))
    before = W.partitionBy("file").orderBy(blk).rowsBetween(W.unboundedPreceding, -1)
    carried = blocks.select("file", blk, F.last(last, ignorenulls=True).over(before).alias(last))
    placed = lines.withColumn(start, F.last(own, ignorenulls=True).over(within)).join(carried, ["file", blk], "left")
    return placed.withColumn(start, F.coalesce(start, last)).where(F.col(start).isNotNull()).drop(blk, last), start


def entry_heads(df: DataFrame, block_lines: int = 8192) -> DataFrame:
    """One row per entry of (line, file, line_no): file, line_no and n_lines, stamp, severity, component, msg_chars.

    ``msg_chars`` counts the message after the head with each further line preceded by a line feed; the texts of
    further lines never leave their task, only their lengths. Empty lines and lines that only begin like a head (or are broken
    JSON) are further lines like any other; a null line counts as empty; rows without file or line_no are left out; extra columns are ignored. Lines
    stored twice under one number count twice; of two heads under one number the greater counts.
    """
    lines = df.where("file is not null and line_no is not null").select("file", "line_no", F.coalesce("line", F.lit("")).alias("line"))
    heads = lines.select("file", "line_no", _head(F.col("line")).alias("head"), F.length("line").alias("chars"))
    slim = heads.select("file", "line_no", "chars", F.when(F.col("head").isNotNull(), F.struct(F.col("head.stamp"), F.col("head.severity"), F.col("head.component"), F.length("head.message").alias("chars"))).alias("head"))
    placed, start = _placed(slim, block_lines)
    further = F.sum(F.when(F.col("head").isNull(), F.col("chars") + 1).otherwise(0))
    got = placed.groupBy("file", F.col(start).alias("line_no")).agg(F.count(F.lit(1)).cast("int").alias("n_lines"), F.max("head").alias("head"), further.alias("further"))
    return got.select("file", "line_no", "n_lines", "head.stamp", "head.severity", "head.component", (F.col("head.chars") + F.col("further")).cast("int").alias("msg_chars"))


def entries(df: DataFrame, block_lines: int = 8192) -> DataFrame:
    """Like entry_heads, with the whole ``message`` instead of its length; an entry's lines are put together in one row."""
    lines = df.where("file is not null and line_no is not null").select("file", "line_no", F.coalesce("line", F.lit("")).alias("line"))
    placed, start = _placed(lines.withColumn("head", _head(F.col("line"))), block_lines)
    got = placed.groupBy("file", F.col(start).alias("at")).agg(
        F.max("head").alias("head"), F.count(F.lit(1)).cast("int").alias("n_lines"), F.array_sort(F.collect_list(F.when(F.col("head").isNull(), F.struct("line_no", "line")))).alias("more")
    )
    return got.select("file", F.col("at").alias("line_no"), "n_lines", "head.stamp", "head.severity", "head.component", F.array_join(F.concat(F.array("head.message"), F.col("more.line")), "\n").alias("message"))
