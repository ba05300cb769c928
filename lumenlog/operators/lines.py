"""Rules on single log lines and messages: components of wrapper commands, magic words, restarts of a logger, repeats, allowed sources, masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenlog.functions.text import normalised
from lumenlog.sources.tables import fresh

#: A command of a command line: the signs that part it from the one before, its word (after exec or a test for being executable), and the rest.
COMMAND = r"([|;&]*) *((?:(?i:exec) *|\[ *-x *)?[^ ;|&>]+)(?:'[^']*'|>&|[^;|&'])*"
#: Most commands of a line that name a component, and most characters of a component and of a group.
COMMANDS, LONGEST, GROUP = 5, 120, 100
# Words that must be the same in two texts for them to be one message, those that may end in "ed" and those as they are.
MAGIC_STEMS = "start end fail exception finish exit begin terminat".split()
MAGIC_WORDS = "enable enabled disable disabled error failure stop stopped".split()
MAGIC = rf"(?i)\b(?:(?:{'|'.join(MAGIC_STEMS)})(?:ed)?|{'|'.join(sorted(MAGIC_WORDS, key=len, reverse=True))})\b"
# Forms of the messages of sudo and cron that say who ran what.
SUDO, CRON = r"(?s)\A([^:]+):.*COMMAND=(.*)\z", r"(?s)\A(\([^)]+\))? CMD \((.*)\) ?\z"


def commands(text: Column) -> Column:
    """The words of the first commands of a command line with the signs between them."""
    pieces = F.slice(F.regexp_extract_all(text, F.lit(COMMAND), F.lit(0)), 1, COMMANDS)
    named = F.transform(pieces, lambda p: F.btrim(F.concat_ws(" ", F.regexp_extract(p, COMMAND, 1), F.btrim(F.regexp_extract(p, COMMAND, 2)))))
    return F.btrim(F.array_join(named, " "))


def component(name: Column, text: Column) -> Column:
    """The component of a message: for sudo and cron also the user and the commands run, for puppet-agent the group in its first brackets, both normalised.

    A null text leaves the component as it is."""
    sudo, cron = SUDO, CRON
    low = F.lower(name)
    by_sudo = F.concat(F.btrim(name), F.lit("("), F.btrim(F.regexp_extract(text, sudo, 1)), F.lit("):"), commands(normalised(F.regexp_extract(text, sudo, 2))))
    by_cron = F.concat(name, F.regexp_extract(text, cron, 1), F.lit(":"), commands(normalised(F.regexp_extract(text, cron, 2))))
    group = F.substring(normalised(F.regexp_extract(text, r"\(([^)]*)\)", 1)), 1, GROUP)
    return (
        F.when((low == "sudo") & text.rlike(sudo), F.substring(F.btrim(by_sudo), 1, LONGEST))
        .when((low == "/usr/sbin/cron") & text.rlike(cron), F.substring(F.btrim(by_cron), 1, LONGEST))
        .when((low == "puppet-agent") & text.rlike(r"\([^)]*\)"), F.concat(name, F.lit(":"), group))
        .otherwise(name)
    )


def edit_threshold(name: Column, a: Column, b: Column) -> Column:
    """Most word edits between two texts of so many words that are one message, by the component's kind: round((min(a, b) - less) / factor), 0 at least."""
    kinds = F.when(F.lower(name).rlike(r"\A(?:sudo\(|/usr/sbin/cron)"), F.struct(F.lit(4.0).alias("factor"), F.lit(2).alias("less"))).when(F.lower(name).startswith("puppet-agent:"), F.struct(F.lit(3.0).alias("factor"), F.lit(11).alias("less"))).otherwise(F.struct(F.lit(3.33).alias("factor"), F.lit(2).alias("less")))
    return F.floor(F.greatest(F.lit(0.0), (F.least(a, b) - kinds["less"]) / kinds["factor"]) + 0.5).cast("int")


def wrappers(df: DataFrame) -> DataFrame:
    """The extra messages of sudo and cron commands of (component_id, message_id, ...): the part of the component before the colon, in lower
    case, is the message id, the component is 'wrapper'."""
    prefix = F.regexp_extract("component_id", r"(?i)\A((?:/usr/sbin/cron|sudo)[^:]+):", 1)
    return df.where(prefix != "").withColumn("message_id", F.lower(prefix)).withColumn("component_id", F.lit("wrapper"))


def magic_words(text: Column) -> Column:
    """The magic words of a text in order, in lower case; texts match only where their lists are equal."""
    return F.transform(F.regexp_extract_all(text, F.lit(MAGIC), F.lit(0)), F.lower)


def logger_restarted(name: Column, text: Column) -> Column:
    """Whether a message says that the logger itself starts up."""
    return F.coalesce((F.lower(name) == "syslog-ng") & text.rlike(r"(?i)\Asyslog-ng starting up\b"), F.lit(False))


def repeats_added(df: DataFrame, keys: list[str], place: str, text: str = "text", block: int = 8192) -> DataFrame:
    """``df`` with ``cnt``: a line 'last message repeated N times' stands for N messages in all of the one before it, and is dropped.

    Lines are taken by blocks of the whole number ``place``; a repeat at a block's beginning is carried to the last message before. One without a
    message before it is dropped."""
    blk, own, last = fresh(df, "block"), fresh(df, "own"), fresh(df, "last")
    n = F.nullif(F.regexp_extract(text, r"\A(?:last )?message repeated (\d+) times?\s*\z", 1), F.lit("")).try_cast("int")
    rows = df.withColumn("repeats", n).withColumn(blk, F.floor(F.col(place) / block)).withColumn(own, F.when(F.col("repeats").isNull(), F.col(place)))
    within = W.partitionBy(*keys, blk).orderBy(place).rowsBetween(W.unboundedPreceding, 0)
    ends = rows.groupBy(*keys, blk).agg(F.max(own).alias(last))
    carried = ends.select(*keys, blk, F.last(last, ignorenulls=True).over(W.partitionBy(*keys).orderBy(blk).rowsBetween(W.unboundedPreceding, -1)).alias(last))
    placed = rows.withColumn(own, F.last(own, ignorenulls=True).over(within)).join(carried, [*keys, blk], "left").withColumn(own, F.coalesce(own, last))
    extra = placed.where("repeats is not null").groupBy(*keys, F.col(own).alias(place)).agg(F.sum("repeats").alias("cnt"))
    return df.join(rows.where("repeats is null").select(*keys, place), [*keys, place], "left_semi").join(extra, [*keys, place], "left").withColumn("cnt", F.greatest(F.coalesce("cnt", F.lit(1)), F.lit(1)))


def allowed_sources(df: DataFrame, allowed: DataFrame, source: str = "source_id") -> tuple[DataFrame, DataFrame]:
    """(rows of allowed sources, counts of the others by source)."""
    names = allowed.select(source).distinct()
    return df.join(names, source, "left_semi"), df.join(names, source, "left_anti").groupBy(source).agg(F.count(F.lit(1)).alias("n"))


def error_heads(line: Column) -> Column:
    """What stands for an unparsable line in reports: its first 4 words, or with the time stamp masked the first 7 (old syslog) or 10 (new syslog)."""
    old, new = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) {1,2}\d{1,2} \d\d:\d\d:\d\d", r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d+)?(?:Z|[+-]\d\d:?\d\d)"
    most = F.when(line.rlike(new), 10).when(line.rlike(old), 7).otherwise(4)
    masked = F.regexp_replace(F.regexp_replace(line, new, "<time>"), old, "<month> <day> <clock>")
    return F.array_join(F.slice(F.filter(F.split(masked, " +"), lambda w: w != ""), F.lit(1), most), " ")


def masked_line(line: Column, host: Column, names: dict[str, str], new_host: str = "system") -> Column:
    """A parsed line with addresses masked, the literals of ``names`` (a company's name) replaced and its host renamed; a line without a host stays as it is."""
    from lumenlog.functions.text import masked

    out = masked(line)
    for old, new in names.items():
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.when(F.coalesce(F.length(host), F.lit(0)) > 0, F.replace(out, host, F.lit(new_host))).otherwise(line)


#: A line of a cluster's own log: date, level, component, text.
SPARK_LINE = r"(?s)\A(\d\d/\d\d/\d\d \d\d:\d\d:\d\d) (\w+) (\w+): ?(.*)\z"


def spark_fields(line: Column, as_source: bool = True) -> Column:
    """Struct (ms, source_id, component, severity, text) of a line of a cluster's own log, null for another line. Clocks are UTC.

    Such lines name no host: with ``as_source`` their level stands as the source, and the component is 'master'; else the source is null and the
    component is the one written."""
    part = lambda i: F.regexp_extract(line, SPARK_LINE, i)
    level = F.lower(part(2))
    severity = F.when(level.isin("fatal", "critical"), 4).when(level.isin("error", "severe"), 3).when(level.isin("warn", "warning"), 2).when(level.isin("info", "debug", "trace"), 1).otherwise(0)
    source, name = (level, F.lit("master")) if as_source else (F.lit(None).cast("string"), part(3))
    made = F.struct(F.unix_millis(F.try_to_timestamp(part(1), F.lit("yy/MM/dd HH:mm:ss"))).alias("ms"), source.alias("source_id"), name.alias("component"), severity.alias("severity"), part(4).alias("text"))
    return F.when(line.rlike(SPARK_LINE), made)
