r"""Delimited records: good rows out, bad ones with the reason.

A schema is compiled into one anchored regex for whole rows: a record that it matches is good. Only
failures go through patterns of growing field prefixes (one field, two fields, ...), first of the
structure (quoting, columns), then of the values; the first that does not match names the broken field and gives the
reason. All of it is JVM regexes. Quantifiers are possessive: Java then matches them in a loop, so that texts of any length
neither backtrack nor overflow the stack.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlog.sources.tables import fresh


@dataclass(frozen=True)
class Field:
    """A column: ``value`` is the regex of its unquoted values (None: anything), ``cast`` the type it is loaded as."""

    name: str
    value: str | None = None
    cast: str = "string"


_DATE = (
    r"(?:\d{4}-(?:(?:0[13578]|1[02])-(?:0[1-9]|[12]\d|3[01])|(?:0[469]|11)-(?:0[1-9]|[12]\d|30)|02-(?:0[1-9]|1\d|2[0-8]))"
    r"|(?:\d\d(?:0[48]|[2468][048]|[13579][26])|(?:[02468][048]|[13579][26])00)-02-29)"
)

#: The export of messages: white space nowhere in a source id; a real time; severity 0 to 4; a count from 1.
MESSAGE_EXPORT = (
    Field("source_id", r"[^\s\p{Z}\u001c-\u001f\u0085]{1,200}"),
    Field("ts", rf"(?!0000){_DATE} (?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d"),
    Field("message_id"),
    Field("component_id"),
    Field("severity", r"[0-4]", "int"),
    Field("cnt", r"0*+[1-9][0-9]*+", "long"),
    Field("text"),
)

_PLAIN = r'[^",]*+'
_QUOTED = r'"(?:[^"]++|"")*+"'
_ANY = rf"(?:{_QUOTED}|{_PLAIN})"


def _field(f: Field) -> str:
    """The field as written, quoted or not, with a value that the column allows."""
    if f.value is None:
        return _ANY
    # Inside quotes a class of excluded characters may also be a doubled quote, outside it is neither quote nor comma; a lookahead ends the value where the field ends.
    inside = re.sub(r"\[\^([^\]]*)\]", r'(?:[^"\1]|"")', f.value)
    outside = f.value.replace("[^", '[^",')
    return rf'(?:"(?:{inside})"(?=,|\z)|(?:{outside})(?=,|\z))'


def row_pattern(schema: tuple[Field, ...]) -> str:
    """The anchored regex of a whole good row."""
    return rf"(?s)\A{','.join(_field(f) for f in schema)}\z"


def _prefix(parts: list[str], end: str) -> str:
    return rf"(?s)\A{','.join(parts)}{end}"


def diagnosis(record: Column, schema: tuple[Field, ...]) -> Column:
    """Struct (reason, broken) of a record that is not null: both null for a good one.

    A bad record goes through patterns of growing prefixes, first of the fields as they are written: the first prefix that does not end at a comma
    or the record's end names the broken field, which is missing where the prefix before is the whole record ('columns'), else wrongly quoted
    ('quoting'). What follows the last field is 'quoting' or 'columns' with no field named. Then the prefixes of valid values: the first that does
    not match names the field of a wrong 'value'."""
    n, end = len(schema), r"(?=,|\z)"
    found = lambda why, name: F.struct(F.lit(why).cast("string").alias("reason"), F.lit(name).cast("string").alias("broken"))
    steps = [(record.rlike(row_pattern(schema)), found(None, None))]
    for i, f in enumerate(schema):
        missing = record.rlike(_prefix([_ANY] * i, r"\z")) if i else F.lit(False)
        steps.append((~record.rlike(_prefix([_ANY] * (i + 1), end)), F.when(missing, found("columns", f.name)).otherwise(found("quoting", f.name))))
    steps.append((~record.rlike(_prefix([_ANY] * n, rf"(?:,{_ANY})*+\z")), found("quoting", None)))
    steps.append((~record.rlike(_prefix([_ANY] * n, r"\z")), found("columns", None)))
    values = [_field(f) for f in schema]
    steps += [(~record.rlike(_prefix(values[: i + 1], end)), found("value", f.name)) for i, f in enumerate(schema) if f.value is not None]
    got = found("value", None)
    for condition, result in reversed(steps):
        got = F.when(condition, result).otherwise(got)
    return got


def fields(record: Column, schema: tuple[Field, ...]) -> Column:
    """A struct of the good record's fields, unquoted and typed: one extraction steps from comma to comma, so a field may hold any characters."""
    cut = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(f",({_ANY})"), F.lit(1))

    def one(parts: Column, i: int, f: Field) -> Column:
        raw = F.get(parts, F.lit(i))
        plain = F.when(raw.startswith('"'), F.replace(F.substr(raw, F.lit(2), F.length(raw) - 2), F.lit('""'), F.lit('"'))).otherwise(raw)
        return (plain if f.cast == "string" else plain.try_cast(f.cast)).alias(f.name)

    return F.get(F.transform(F.array(cut), lambda parts: F.struct(*[one(parts, i, f) for i, f in enumerate(schema)])), F.lit(0))


def judged(df: DataFrame, schema: tuple[Field, ...], record: str = "record") -> DataFrame:
    """``df`` with ``reason`` (null for good records), ``broken`` (the first broken field of a bad one) and ``row`` (the fields of a good one).

    Empty records fail by their columns; null records too. Texts of any length are matched whole. Existing
    columns of these three names are replaced, others pass through. Repeated rows are judged each.
    """
    r = F.col(f"`{record}`")
    why = fresh(df, "why")
    keep = [c for c in df.columns if c.lower() not in ("reason", "broken", "row")]
    absent = F.struct(F.lit("columns").alias("reason"), F.lit(schema[0].name).alias("broken"))
    return df.withColumn(why, F.when(r.isNull(), absent).otherwise(diagnosis(r, schema))).select(
        *[F.col(f"`{c}`") for c in keep],
        F.col(f"{why}.reason").alias("reason"),
        F.col(f"{why}.broken").alias("broken"),
        F.when(F.col(f"{why}.reason").isNull(), fields(r, schema)).alias("row"),
    )
