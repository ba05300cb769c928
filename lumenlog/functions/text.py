"""Text functions of Columns: normal forms, tokens, masks, globs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that make a message critical.
CRITICAL_WORDS = "abend abort abnormal abnormally crash deadlock exit error expire fatal failed failure unavailable corrupt corrupted severe unrecoverable".split()

#: A number from 0 to 255, leading zeros allowed; a domain is labels of word characters, each with a dot after it but perhaps the last.
_OCTET = r"(?:25[0-5]|(?:2[0-4]|[01]?\d)?\d)"
_DOMAIN = r"(?:\w+\.)+\w*"


def _octets(n: int) -> str:
    """So many numbers from 0 to 255 with dots between them."""
    return rf"\b{_OCTET}(?:\.{_OCTET}){{{n - 1}}}\b"


def _run(of: str, least: int) -> str:
    """A whole word of at least so many of the characters."""
    return rf"\b[{of}]{{{least},}}\b"


# The placeholders of the normal form, in the order in which they are put in. Mail to root is kept apart from other mail.
REPLACEMENTS = (
    (rf"\broot@{_DOMAIN}\b", " %%%root@EMAIL%%% "),
    (rf"\b[A-Za-z\d.][\w.+-]*@{_DOMAIN}\b", " %%%EMAIL%%% "),
    (_octets(6), " %%%IPV6%%% "),
    (_octets(4), " %%%IPV4%%% "),
    (_run(r"\dA-F", 7), " %%%NUMBER%%% "),
    (_run(r"\d", 4), " %%%NUMBER%%% "),
    (r"[\t ]+", " "),
    (r"^ | $", ""),
)
#: Delimiters that are tokens of their own.
DELIMITERS = r":,&=!></.\\(){}\[\]"


def normalised(text: Column) -> Column:
    """The text with addresses and numbers replaced, in order."""
    for pattern, value in REPLACEMENTS:
        text = F.regexp_replace(text, pattern, value)
    return text


def _first(tokens: Column, most: int | None) -> Column:
    return tokens if most is None else F.slice(tokens, 1, most)


def words(text: Column, most: int | None = 120) -> Column:
    """Tokens: pieces between white space, cut at delimiters, which stay; '(CONT.)' is dropped. Only the first ``most`` are kept, all with None:
    texts that differ only after those are alike."""
    plain = F.regexp_replace(text, r"(?<![^ \t\n])\(CONT\.\)(?![^ \t\n])", " ")
    return _first(F.regexp_extract_all(plain, F.lit(rf"[{DELIMITERS}]|[^{DELIMITERS} \t\n]+"), F.lit(0)), most)


def path_words(text: Column, most: int | None = 120) -> Column:
    """Tokens of which paths with two slashes or more stay whole; ``most`` as in ``words``."""
    return _first(F.regexp_extract_all(text, F.lit(rf"(?:[\w.\-]*/)(?:[\w.\-]+/)+[\w.\-]*|[{DELIMITERS}]|[^{DELIMITERS} \t\n]+"), F.lit(0)), most)


def critical_score(text: Column, critical: list[str] | None = None) -> Column:
    """Number of white-space tokens that are critical words."""
    known = F.array(*map(F.lit, critical or CRITICAL_WORDS))
    return F.size(F.filter(F.split(F.lower(text), r"\s+"), lambda w: F.array_contains(known, w)))


def masked(text: Column) -> Column:
    """The line with e-mail and IPv4 addresses replaced by fixed ones."""
    text = F.regexp_replace(text, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "user@example.com")
    return F.regexp_replace(text, _octets(4), "127.0.0.1")


def printable(text: Column) -> Column:
    """Characters outside printable ASCII become blanks."""
    return F.regexp_replace(text, "[^ -~]", " ")


def without_controls(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x1f\x7f]", "")


def glob_pattern(glob: Column) -> Column:
    """A regex of a glob: * any text, ? at most one character, letter case dropped, everything else as it is."""
    quoted = F.regexp_replace(glob, r"([.+^$|(){}\[\]\\])", r"\\$1")
    return F.concat(F.lit("(?i)^"), F.regexp_replace(F.regexp_replace(quoted, r"\*", ".*"), r"\?", ".?"), F.lit("$"))


def component_or_none(component: Column) -> Column:
    return F.when(F.coalesce(F.length(component), F.lit(0)) == 0, F.lit("(NO_COMPONENT)")).otherwise(component)


def host_name(host: Column) -> Column:
    """Lower case, at most 200 characters."""
    return F.lower(F.substring(host, 1, 200))


def time_vector(ticks: Column, size: int = 120) -> Column:
    """Base64 of the bit set of ticks, lowest bit first in each byte, trailing zero bytes cut."""
    byte = lambda b: F.aggregate(F.filter(ticks, lambda t: F.floor(t / 8) == b), F.lit(0), lambda a, t: (a + F.pow(F.lit(2), t % 8)).cast("int"))
    last = F.floor(F.array_max(ticks) / 8).cast("int")
    hexes = F.transform(F.sequence(F.lit(0), F.coalesce(last, F.lit(0))), lambda b: F.lpad(F.hex(byte(b)), 2, "0"))
    return F.when(F.size(ticks) <= 0, F.lit("")).otherwise(F.base64(F.unhex(F.array_join(hexes, ""))))


def ticks_of(vector: Column) -> Column:
    """Ticks of a Base64 time vector."""
    h = F.hex(F.unbase64(vector))
    bits = F.transform(F.sequence(F.lit(0), F.greatest((F.length(h) * 4 - 1).cast("int"), F.lit(0))), lambda t: F.when(F.shiftright(F.conv(F.substr(h, (F.floor(t / 8) * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int"), 0).bitwiseAND(F.pow(F.lit(2), t % 8).cast("int")) != 0, t))
    return F.when(F.length(h) > 0, F.array_compact(bits)).otherwise(F.array().cast("array<int>"))
