"""Word-level alignment: edit distance, templates, and grouping of texts into message ids."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a text that count; texts that differ only after them are alike. None for all: alignment takes time with the square of the words.
MOST_WORDS: int | None = 120
_WORD = re.compile(r"[:,&=!></.\\(){}\[\]]|[^:,&=!></.\\(){}\[\]\s]+")


def words(text: str | None, most: int | None = MOST_WORDS) -> list[tuple[str, bool]]:
    """(word, whether a blank stands before it) of at most ``most`` words, of all with None; '(CONT.)' is dropped."""
    out = []
    for piece in (text or "").split():
        if piece == "(CONT.)":
            continue
        out += [(m[0], k == 0) for k, m in enumerate(_WORD.finditer(piece))]
    return out[:most]


def distance(a: list[str], b: list[str], most: int = 120) -> int:
    """Edits of whole words between two texts, or ``most`` + 1 where it is more; only a band of ``most`` is computed."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        low, high = max(1, i - most), min(len(b), i + most)
        new = [most + 1] * (len(b) + 1)
        new[0] = i
        for j in range(low, high + 1):
            new[j] = min(row[j - 1] + (x != b[j - 1]), row[j] + 1, new[j - 1] + 1)
        if min(new) > most:
            return most + 1
        row = new
    return min(row[-1], most + 1)


def template(a: str | None, b: str | None, most: int | None = MOST_WORDS) -> str:
    """The common words of two texts in order, with one * for every stretch in which they differ.

    Alignment costs one per word; of equal ways back substitution comes before dropping a word of the first, then of the second."""
    x, y = words(a, most), words(b, most)
    n, m = len(x), len(y)
    cost = [[i + j if not i or not j else 0 for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            cost[i][j] = min(cost[i - 1][j - 1] + (x[i - 1][0] != y[j - 1][0]), cost[i - 1][j] + 1, cost[i][j - 1] + 1)
    out: list[tuple[str, bool]] = []
    i, j = n, m
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + (x[i - 1][0] != y[j - 1][0]):
            same = x[i - 1][0] == y[j - 1][0]
            out.append((x[i - 1][0] if same else "*", x[i - 1][1] and y[j - 1][1] if not same else x[i - 1][1] or y[j - 1][1]))
            i, j = i - 1, j - 1
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            out.append(("*", x[i - 1][1]))
            i -= 1
        else:
            out.append(("*", y[j - 1][1]))
            j -= 1
    text, before = "", ""
    for word, blank in reversed(out):
        if word == "*" and before == "*":
            continue
        text += (" " if blank and text else "") + word
        before = word
    return text


def threshold(a: int, b: int, factor: float = 3.33, less: int = 2) -> int:
    """Most edits between texts of so many words that are one message."""
    return int(max(0.0, (min(a, b) - less) / factor) + 0.5)


class Representatives:
    """Representatives of one component in the order of their use; ``find`` gives what a search through all of them would.

    The words of a representative are cut into one part more than the edits allowed, so a text within the threshold holds at least one part
    unchanged, shifted by no more words than the edits pay for. Only representatives that share such a part are compared (exact, nothing is lost)."""

    def __init__(self) -> None:
        self.words: list[list[str]] = []
        self.distinct: list[set[str]] = []
        self.used: list[int] = []
        self.clock = 0
        self.sizes: set[int] = set()
        self.cuts: dict[int, list[tuple[int, int]]] = {}
        self.parts: dict[tuple[str, ...], dict[tuple[int, int], list[int]]] = {}
        self.room: dict[tuple[int, int], tuple[int, int] | None] = {}

    def _touch(self, number: int) -> int:
        self.clock += 1
        self.used[number] = self.clock
        return number

    def add(self, words: list[str]) -> int:
        m = len(words)
        if m not in self.cuts:
            k = min(threshold(m, m), max(0, m - 1)) + 1
            self.cuts[m] = [(m * i // k, m * (i + 1) // k) for i in range(k)]
            self.sizes |= {high - low for low, high in self.cuts[m]}
        for low, high in self.cuts[m]:
            self.parts.setdefault(tuple(words[low:high]), {}).setdefault((m, low), []).append(len(self.words))
        self.words.append(words)
        self.distinct.append(set(words))
        self.used.append(0)
        return self._touch(len(self.words) - 1)

    def _shifts(self, n: int, m: int) -> tuple[int, int] | None:
        """How far a part of a text of ``m`` words can lie to the left and right in one of ``n`` words; None where the lengths are too far apart."""
        if (n, m) not in self.room:
            most, more = threshold(n, m), n - m
            spare = (most - abs(more)) // 2
            self.room[n, m] = None if most < abs(more) else (min(0, more) - spare, max(0, more) + spare)
        return self.room[n, m]

    def find(self, words: list[str]) -> int | None:
        """The most recently used representative within the threshold, now the first in order, or None."""
        n, near = len(words), set()
        for size in self.sizes:
            for start in range(n - size + 1 if size else not n):
                for (m, low), got in self.parts.get(tuple(words[start : start + size]), {}).items():
                    if (room := self._shifts(n, m)) and room[0] <= start - low <= room[1]:
                        near.update(got)
        if not near:
            return None
        mine, bits = set(words), {}
        for i, x in enumerate(words):
            bits[x] = bits.get(x, 0) | 1 << i
        for number in sorted(near, key=self.used.__getitem__, reverse=True):
            other, has = self.words[number], self.distinct[number]
            most = threshold(n, len(other))
            # A word that only one of the two has costs an edit of its own.
            if len(mine - has) <= most and len(has - mine) <= most and _edits(bits, n, other) <= most:
                return self._touch(number)
        return None


def _edits(bits: dict[str, int], n: int, other: list[str]) -> int:
    """Edits of whole words between ``other`` and a text of ``n`` words whose places are ``bits``; a row of the table at a time, as bits."""
    if not n:
        return len(other)
    every, last = (1 << n) - 1, 1 << (n - 1)
    up, down, got = every, 0, n
    for x in other:
        eq = bits.get(x, 0)
        v = eq | down
        h = (((eq & up) + up) ^ up) | eq
        plus, minus = down | (every & ~(h | up)), up & h
        if plus & last:
            got += 1
        elif minus & last:
            got -= 1
        plus, minus = plus << 1 | 1, minus << 1
        up, down = (minus | ~(v | plus)) & every, plus & v & every
    return got


def message_ids(df: DataFrame, component: str, text: str, order: str, most: int | None = MOST_WORDS) -> DataFrame:
    """(component, text, message_id): texts within the threshold of a representative share its id.

    The distinct texts of a component are searched in order, most recently used representative first, against all representatives of the component;
    one that is close to none becomes a representative itself. Ids are the component and the running number of the representative.
    A component is one task; null texts have no id, null components form one of their own. Only the first ``most`` words of a text count, all with None."""
    distinct = df.where(f"`{text}` is not null").groupBy(component, text).agg(F.min(order).alias("first"))

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["first", text])
        known, ids = Representatives(), []
        for t in pdf[text]:
            mine = [x for x, _ in words(t, most)]
            number = known.find(mine)
            ids.append(known.add(mine) if number is None else number)
        return pd.DataFrame({component: pdf[component], text: pdf[text], "number": ids})

    kind = df.schema[component].dataType.simpleString()
    # A fixed number of partitions: small as the texts are, they take long, so they must not be put together.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    got = distinct.repartition(parts, component).groupBy(component).applyInPandas(cluster, f"`{component}` {kind}, `{text}` string, number int")
    return got.select(component, text, F.concat_ws("_", component, "number").alias("message_id"))


def text_clusters(df: DataFrame, ids: DataFrame, component: str, text: str, ms: str) -> DataFrame:
    """(component, message_id, text, last_day, n) of ``df`` and its ``message_ids``: the first text of each id, the last day it was observed, and its messages."""
    day = F.to_date(F.timestamp_millis(F.col(ms)))
    return df.join(ids, [component, text]).groupBy(component, "message_id").agg(F.min_by(text, F.struct(ms, text)).alias("text"), F.max(day).alias("last_day"), F.count(F.lit(1)).alias("n"))


def templates(df: DataFrame, key: str | list[str], text: str, order: str, most: int | None = MOST_WORDS) -> DataFrame:
    """(key columns, n_texts, template): the ordered fold of the texts of a key; equal texts take part once, so a key's work is bounded by its distinct texts.

    Rows with a null in a key column or without a text are left out. Only the first ``most`` words of a text count, all with None."""
    keys = [key] if isinstance(key, str) else key
    distinct = df.where(" and ".join(f"`{c}` is not null" for c in [*keys, text])).groupBy(*keys, text).agg(F.min(order).alias("first"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = pdf.sort_values(["first", text])[text].tolist()
        got = texts[0]
        for t in texts[1:]:
            got = template(got, t, most)
            if got == "*":
                break
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "n_texts": [len(texts)], "template": [got]})

    # A key with one text needs no fold.
    counted = distinct.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_texts"), F.min(text).alias("template"))
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    single = counted.where("n_texts = 1")
    several = distinct.join(counted.where("n_texts > 1").select(*keys), keys, "left_semi").groupBy(*keys).applyInPandas(fold, f"{kinds}, n_texts long, template string")
    return several.unionByName(single)
