"""Byte-level BPE with a public vocabulary, in Spark's higher-order functions.

Texts are split by the vocabulary's pattern (one JVM regex); words of the same spelling have the same ids. Over the
whole corpus the words are counted (combined before the shuffle) and kept, and every distinct word is encoded once, by a fold over
its bytes. The most frequent words, at most ``table_words``, become a literal table that every task looks words up in: where there are
no others, texts are done where they lie. Else texts get the ids of their rarer words by a join on the word, of which none is
frequent, so no key is hot; what is shuffled is each text's distinct rarer words, by word and by text, and once the texts, never the table.
Where only the number of ids is asked for, a text is reduced to the number of its frequent words' ids where it lies, and is not shuffled.

The fold: a word is an array of hexadecimal byte pieces and an array of the ranks of neighbouring pieces put together
(null: no token). Each step merges the first pair of least rank and looks up the ranks of the two new pairs.
Ranks come from a literal map, cut by checksum into buckets, as a look-up in Spark's maps is a search. A fold of n bytes takes
n² steps, so distinct words of more than LONG bytes (blobs without a break) are merged by the same ranks with a heap.
"""

from __future__ import annotations

import base64
import functools
import heapq
import json
import zlib
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.llm.shared import checkpointed
from lumenlog.sources.tables import fresh

#: Folder of the public vocabularies.
TOKENIZERS = "/opt/tokenizers"
#: The vocabulary's split pattern; (?U) makes \s the Unicode white space. The most frequent alternatives come first, where no other
#: can begin, and give nothing back, as nothing follows them: the matches are those of '(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+|...
PATTERN = r"(?U) ?\p{L}++| ?\p{N}++|'(?:s|t|re|ve|m|ll|d)| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+"
BUCKETS = 1 << 15
#: Distinct words of more bytes than this are merged with a heap, which takes n log n steps instead of n².
LONG = 512


@functools.lru_cache(maxsize=4)
def ranks(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> dict[bytes, int]:
    """Token -> rank, which is its id."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(folder, f"{name}.tiktoken").read_bytes().splitlines() if line)}


def _literal(spark: SparkSession, entries: dict[str, object], kind: str) -> Column:
    """A literal array of BUCKETS small maps, by the checksum of the key.

    It is made by a scalar subquery of one row: tasks get its value as a literal, while plans and the driver's
    log of them hold only its name instead of some megabytes of text each."""
    buckets: list[dict[str, object]] = [{} for _ in range(BUCKETS)]
    for key, value in entries.items():
        buckets[zlib.crc32(key.encode()) % BUCKETS][key] = value
    row = json.dumps(buckets, ensure_ascii=False, separators=(",", ":"))
    return spark.createDataFrame([(row,)], "t string").select(F.from_json("t", f"array<map<string,{kind}>>").alias("t")).scalar()


def _given(table: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a table column bound to a variable: mentioned once, the column is not written into rows but merged into the projection."""
    return F.get(F.transform(F.array(table), body), F.lit(0))


def _bucket(key: Column) -> Column:
    return F.pmod(F.crc32(key.cast("binary")), F.lit(BUCKETS)).cast("int")


def _found(table: Column, key: Column) -> Column:
    """The key's entry, or null."""
    return F.try_element_at(F.get(table, _bucket(key)), key)


@functools.lru_cache(maxsize=4)
def _rank_json(name: str, folder: str) -> dict[str, int]:
    return {token.hex().upper(): rank for token, rank in ranks(name, folder).items()}


def fold(word: Column, rank_table: Column) -> Column:
    """Ids of a word: ranked merges folded over its bytes; an empty word gives no ids."""
    rank = lambda x: _found(rank_table, x)

    def start(h: Column) -> Column:
        n = F.length(h) / 2
        p = F.transform(F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>")), lambda i: F.substr(h, i * 2 + 1, F.lit(2)))
        r = F.transform(F.when(n > 1, F.sequence(F.lit(0), (n - 2).cast("int"))).otherwise(F.array().cast("array<int>")), lambda i: rank(F.substr(h, i * 2 + 1, F.lit(4))))
        return F.struct(p.alias("p"), r.alias("r"))

    def merge(a: Column, i: Column) -> Column:
        """Pieces i and i + 1 (from 1) become one."""
        p, r = a["p"], a["r"]
        size = F.size(p)
        put = F.concat(F.get(p, i - 1), F.get(p, i))
        none = F.array().cast("array<int>")
        left = F.when(i > 1, F.concat(F.slice(r, F.lit(1), i - 2), F.array(rank(F.concat(F.get(p, i - 2), put))))).otherwise(none)
        right = F.when(i < size - 1, F.concat(F.array(rank(F.concat(put, F.get(p, i + 1)))), F.slice(r, i + 2, size))).otherwise(none)
        return F.struct(F.concat(F.slice(p, F.lit(1), i - 1), F.array(put), F.slice(p, i + 2, size)).alias("p"), F.concat(left, right).alias("r"))

    def step(a: Column, _: Column) -> Column:
        least = F.array_min(a["r"])
        return F.when(least.isNull(), a).otherwise(F.get(F.transform(F.array(F.array_position(a["r"], least).cast("int")), lambda i: merge(a, i)), F.lit(0)))

    def folded(h: Column) -> Column:
        n = (F.length(h) / 2).cast("int")
        steps = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, start(h), step, lambda a: F.transform(a["p"], rank))

    return F.get(F.transform(F.array(F.hex(F.encode(word, "UTF-8"))), folded), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text in order; put together they are the text."""
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def merged(word: bytes, table: dict[bytes, int]) -> list[int]:
    """Ids of one word by a heap of ranked neighbours, for words of any length."""
    n = len(word)
    piece = [word[i : i + 1] for i in range(n)]
    after, before = [*range(1, n), -1], [-1, *range(n - 1)]
    heap = [(r, i, 2) for i in range(n - 1) if (r := table.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        j = after[i]
        if not piece[i] or j < 0 or len(piece[i]) + len(piece[j]) != size:
            continue
        piece[i] += piece[j]
        piece[j] = b""
        after[i] = k = after[j]
        if k >= 0:
            before[k] = i
        for a, b in ((before[i], i), (i, k)):
            if a >= 0 and b >= 0 and (r := table.get(piece[a] + piece[b])) is not None:
                heapq.heappush(heap, (r, a, len(piece[a]) + len(piece[b])))
    return [table[p] for p in piece if p]


def counted_words(df: DataFrame, text: str) -> DataFrame:
    """(w, n) of every distinct word of all texts, kept outside the lineage."""
    return checkpointed(df.select(F.explode(words(F.col(f"`{text}`"))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")))


#: Eighths of powers of two: words with about equal counts are in or out of the table together.
_LEVEL = "cast(floor(log2(n) * 8) as int)"


def _cut(counted: DataFrame, table_words: int) -> tuple[int, int, int]:
    """(level of count from which words are in the table, number of those words, number of the others); at most 512 levels come to the driver."""
    levels = sorted(((r["level"], r["k"]) for r in counted.groupBy(F.expr(_LEVEL).alias("level")).agg(F.count(F.lit(1)).alias("k")).collect()), reverse=True)
    total, inside, cut = sum(k for _, k in levels), 0, 1 << 20
    for level, k in levels:
        if inside + k > table_words:
            break
        inside, cut = inside + k, level
    return cut, inside, total - inside


def word_values(counted: DataFrame, parts: int, value: Callable[[Column], Column], name: str, folder: str) -> DataFrame:
    """(w, v): ``value`` of the ids of every word, each encoded once."""

    def heaped(texts: pa.Array) -> pa.Array:
        table = ranks(name, folder) if texts.null_count < len(texts) else {}
        return pa.array([None if t is None else merged(t.encode(), table) for t in texts.to_pylist()], pa.list_(pa.int32()))

    w = F.col("w")
    # A given number of partitions: words are small, but take long.
    spread = counted.select("w").repartition(parts).withColumn("ranks", _literal(counted.sparkSession, _rank_json(name, folder), "int"))
    short = F.octet_length(w) <= LONG
    ids = F.when(short, _given(F.col("ranks"), lambda t: fold(w, t))).otherwise(F.arrow_udf(heaped, "array<int>")(F.when(~short, w)))
    return spread.select("w", value(ids).alias("v"))


def _table(values: DataFrame) -> Column:
    """A literal array of BUCKETS maps from word to value, by the checksum of the word; made by a scalar subquery of one row."""
    filled = values.groupBy(_bucket(F.col("w")).alias("b")).agg(F.map_from_entries(F.collect_list(F.struct("w", "v"))).alias("m"))
    every = values.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("b"))
    return every.join(filled, "b", "left").agg(F.transform(F.array_sort(F.collect_list(F.struct("b", "m")), lambda x, y: x["b"] - y["b"]), lambda x: x["m"]).alias("t")).scalar()


def _divided(df: DataFrame, text: str, value: Callable[[Column], Column], table_words: int, name: str, folder: str) -> tuple[Column, DataFrame, DataFrame | None]:
    """The literal table of the frequent words' values, those words, and (w, v) of the others: none where the table holds all."""
    counted = counted_words(df, text)
    cut, inside, outside = _cut(counted, table_words)
    frequent, rare = counted.where(f"{_LEVEL} >= {cut}"), counted.where(f"{_LEVEL} < {cut}")
    table = _table(word_values(frequent, max(8, inside // 2048), value, name, folder))
    return table, frequent.select("w"), word_values(rare, max(8, outside // 4096), value, name, folder) if outside else None


def _hashed(df: DataFrame) -> list[Column]:
    """The columns that tell rows apart and can be hashed."""
    return [F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind]


def encode(df: DataFrame, text: str = "text", out: str = "ids", table_words: int = 32_768, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``df`` with ``out``: the text's ids, without special tokens (their strings are ordinary text).

    Null and empty texts give an empty list. Texts are taken whole. An existing column ``out`` is replaced;
    rows are neither dropped nor doubled, and other columns pass through.
    """
    keep = [F.col(f"`{c}`") for c in df.columns if c.lower() != out.lower()]
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    table, frequent, rare = _divided(df, text, lambda ids: ids, table_words, name, folder)
    known, own, row = (fresh(df, x) for x in ("known", "own", "row"))
    value_of = _found
    if rare is not None:
        df = df.withColumn(row, F.xxhash64(*_hashed(df)))
        pairs = df.select(row, F.explode(F.array_distinct(words(F.col(f"`{text}`")))).alias("w")).join(F.broadcast(frequent), "w", "left_anti")
        # Rows that are the same have the same pairs: a set holds them once.
        found = pairs.join(rare, "w").groupBy(row).agg(F.map_from_entries(F.collect_set(F.struct("w", "v"))).alias(own))
        df = df.join(found, row, "left")
        value_of = lambda t, w: F.coalesce(_found(t, w), F.try_element_at(F.col(own), w))
    # The table is joined to the texts last: below a join it would be written into each shuffled row.
    return df.withColumn(known, table).select(*keep, _given(F.col(known), lambda t: F.flatten(F.transform(words(body), lambda w: value_of(t, w)))).alias(out))


def token_counts(df: DataFrame, text: str = "text", out: str = "tokens", table_words: int = 32_768, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """Like encode, with the number of ids instead of the ids: only a number per word is looked up and added.

    The order of words doesn't matter to a sum, so the join needs no text: of the columns, only those that are used later are shuffled.
    """
    keep = [F.col(f"`{c}`") for c in df.columns if c.lower() != out.lower()]
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    table, frequent, rare = _divided(df, text, F.size, table_words, name, folder)
    known, here, there, pairs, row, second = (fresh(df, x) for x in ("known", "here", "there", "pairs", "row", "second"))
    every = df.withColumn(known, table)
    # The ids of the words in the table, and above 32 bits the number of words that aren't: a text has fewer than 2^31 of either.
    other = F.lit(1 << 32)
    looked = lambda t: F.aggregate(words(body), F.lit(0).cast("long"), lambda a, w: a + F.coalesce(_found(t, w).cast("long"), other))
    total = _given(F.col(known), looked)
    if rare is None:
        return every.select(*keep, total.alias(out))
    # 96 bits tell rows apart: here, other than in encode, two rows of the same hash would get each other's words.
    key = [F.xxhash64(*_hashed(df)).alias(row), F.hash(*_hashed(df)).alias(second)]
    outside = df.select(*key, F.explode(words(F.col(f"`{text}`"))).alias("w")).join(F.broadcast(frequent), "w", "left_anti")
    found = outside.join(rare, "w").groupBy(row, second).agg(F.sum("v").alias(there), F.count(F.lit(1)).alias(pairs))
    # Rows that are the same have their words added together: pairs / (total >> 32) times.
    added = F.expr(f"`{there}` div (`{pairs}` div (`{here}` >> 32))")
    joined = every.select(*keep, *key, total.alias(here)).join(found, [row, second], "left")
    return joined.select(*keep, (F.col(here).bitwiseAND(F.lit((1 << 32) - 1)) + F.when(F.col(pairs) > 0, added).otherwise(F.lit(0))).alias(out))


def decode(df: DataFrame, ids: str = "ids", out: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``df`` with ``out``: the text of the ids, the binary pieces put together; null ids give null."""
    by_rank = sorted(((r, t.hex()) for t, r in ranks(name, folder).items()))
    row = df.sparkSession.createDataFrame([(json.dumps([h for _, h in by_rank]),)], "t string")
    pieces = row.select(F.from_json("t", "array<string>").alias("t")).scalar()
    t = fresh(df, "pieces")
    keep = [F.col(f"`{c}`") for c in df.columns if c.lower() != out.lower()]
    return df.withColumn(t, pieces).select(*keep, _given(F.col(t), lambda p: F.decode(F.unhex(F.array_join(F.transform(F.col(ids), lambda i: F.get(p, i)), "")), "UTF-8")).alias(out))
