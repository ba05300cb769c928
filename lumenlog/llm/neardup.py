"""Near-duplicate texts: exact similarity join by tiled comparison of bit vectors.

A text is the set of its distinct words, and two texts are similar if their Jaccard similarity is at least a
threshold t. In terms of sets of a and b words that differ in d words this is d <= r (a + b) with
r = (1 - t) / (1 + t), the radius.

* Every set is folded into a bit vector: a word flips the bit that its hash names. Flipping makes the
  exclusive-or of two vectors the vector of the words in which the sets differ, so its bit count is at most d:
  a pair whose bit count exceeds the radius is never similar. What is left (nearly only true pairs) is checked
  against the word sets themselves.
* Not all pairs are compared. Words are ordered from rare to frequent (by a table of hashed counts over all
  texts, with several slots for each distinct word). Two similar sets share l of the first a - ceil(t a) + l words of each, for every l up to the
  words they share, so texts are compared only within the group of such a word (l = 1). A group of more texts than a tile holds is
  divided by a second word (l = 2; sets that are similar and not equal share at least two words): its texts are compared within the groups of
  both words.
* What is still larger than a tile is cut into tiles of bounded size by set size (the population count before folding). A tile is
  compared with itself and with the tiles whose sizes are within the radius, in numpy, a block of pairs at once.
  Every pair of tiles is a task's unit of work of bounded size, however large the group.

Texts with equal sets (copies) are one class and take part once; pairs are expanded to records at the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlog.llm.shared import checkpointed

#: Slots of the table of hashed word counts: four for each distinct word, within these bounds (the largest table is 16 MB in a task). The table
#: only orders words; whatever the order, no pair is lost.
LEAST_SLOTS, MOST_SLOTS = 1 << 16, 1 << 22
#: 64-bit pieces of a bit vector.
PIECES = 2
#: Most texts of a tile.
TILE = 2048
#: Tasks that the rows of one component's label are spread over.
SALTS = 32


def word_sets(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``words``: the sorted 64-bit hashes of the distinct words (longest runs of a-z and 0-9 in the lower-cased text)."""
    return df.withColumn("words", F.array_sort(F.array_distinct(F.expr(f"transform(regexp_extract_all(lower(`{text}`), '[a-z0-9]+', 0), w -> xxhash64(w))"))))


def classes(df: DataFrame, kind: str, ident: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(members, sets): the class of every record, and the words of every class.

    The class of texts with equal word sets is their smallest id. Texts without a word are similar only where they are equal.
    Rows without a text, an id or a kind belong to no class.
    """
    rows = word_sets(df.where(f"`{text}` is not null and `{ident}` is not null and `{kind}` is not null").select(F.col(kind).alias("kind"), F.col(ident).cast("long").alias("id"), F.col(text).alias("text")), "text")
    none = F.size("words") == 0
    keyed = rows.select("kind", "id", "words", F.when(none, F.xxhash64(F.lit("no word"), "text")).otherwise(F.xxhash64("words")).alias("h1"), F.when(none, F.hash("text")).otherwise(F.hash("words")).alias("h2"))
    # Each set once, with the ids of its texts counted; the texts are read once more for the ids alone.
    sets = checkpointed(keyed.groupBy("kind", "h1", "h2").agg(F.min("id").alias("class"), F.any_value("words").alias("words")))
    members = keyed.select("kind", "id", "h1", "h2").distinct().join(sets.select("kind", "h1", "h2", "class"), ["kind", "h1", "h2"]).select("kind", "id", "class")
    return checkpointed(members), sets.where(F.size("words") > 0).select("kind", "class", "words")


def _slot(words: np.ndarray, slots: int) -> np.ndarray:
    return (words.view(np.uint64) >> np.uint64(64 - slots.bit_length() + 1)).astype(np.int64)


def word_counts(sets: DataFrame) -> np.ndarray:
    """Counts of all sets' words by hash slot, over all rows; as many slots as fit the number of distinct words, within the bounds."""
    distinct = sets.select(F.explode("words").alias("w")).agg(F.approx_count_distinct("w").alias("n")).first()["n"]
    slots = 1 << int(np.clip(4 * distinct, LEAST_SLOTS, MOST_SLOTS) - 1).bit_length()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots, np.int64)
        for b in batches:
            total += np.bincount(_slot(b.column(0).flatten().to_numpy(), slots), minlength=slots)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["slot", "n"])

    rows = sets.select("words").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(slots, np.int32)
    table[rows["slot"].to_numpy()] = np.minimum(rows["n"].to_numpy(), 2**31 - 1)
    return table


def _vectors(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bit vectors, (rows, PIECES): every word flips one bit."""
    bit = (values.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 6 - PIECES.bit_length() + 1)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    out = np.zeros((len(offsets) - 1, PIECES), np.uint64)
    np.bitwise_xor.at(out, (row, (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
    return out


def _ordered(words: pa.Array, counts: np.ndarray, threshold: float) -> tuple[np.ndarray, ...]:
    """(values, offsets, sizes, order, place, length): the words of all sets, their places from rare to frequent, and the length of each set's prefix."""
    values, offsets = words.flatten().to_numpy(), np.concatenate([[0], np.cumsum(words.value_lengths().to_numpy())])
    size = np.diff(offsets)
    row = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((values, counts[_slot(values, len(counts))], row))
    # Rounding down a hair: a prefix too long by one loses nothing.
    length = size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1
    return values, offsets, size, order, np.arange(len(values)) - offsets[:-1][row], length, row


def prefixes(sets: DataFrame, counts: np.ndarray, threshold: float) -> DataFrame:
    """(kind, word, class, size, v0, v1): each class once under every word of its prefix, with its bit vector."""
    sent = sets.sparkSession.sparkContext.broadcast(counts)
    names = [f"v{i}" for i in range(PIECES)]

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind, ident, words = b.column(0), b.column(1), b.column(2)
            values, offsets, size, order, place, length, row = _ordered(words, sent.value, threshold)
            # A word that is its slot's only occurrence is in no other text.
            kept = order[(place < length[row]) & (sent.value[_slot(values, len(sent.value))][order] > 1)]
            at = row[kept]
            v = _vectors(values, offsets)[at].view(np.int64)
            yield pa.RecordBatch.from_arrays([kind.take(pa.array(at)), pa.array(values[kept]), ident.take(pa.array(at)), pa.array(size[at].astype(np.int32)), *[pa.array(v[:, i].copy()) for i in range(PIECES)]], names=["kind", "word", "class", "size", *names])

    return sets.select("kind", "class", "words").mapInArrow(explode, "kind string, word long, class long, size int, " + ", ".join(f"{n} long" for n in names))


def second_words(heavy: DataFrame, counts: np.ndarray, threshold: float) -> DataFrame:
    """Like ``prefixes``, of (kind, class, words, firsts): each class once under every pair of one of the ``firsts`` and another word of the prefix that is one longer."""
    sent = heavy.sparkSession.sparkContext.broadcast(counts)
    names = [f"v{i}" for i in range(PIECES)]

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind, ident, words = b.column(0), b.column(1), b.column(2)
            firsts, many = b.column(3).flatten().to_numpy(), b.column(3).value_lengths().to_numpy()
            values, offsets, size, order, place, length, row = _ordered(words, sent.value, threshold)
            kept = order[place <= length[row]]
            # Every kept word beside every first word of its set.
            reps = many[row[kept]]
            entry = np.repeat(np.arange(len(kept)), reps)
            within = np.arange(len(entry)) - np.repeat(np.cumsum(reps) - reps, reps)
            first, other = firsts[(np.cumsum(many) - many)[row[kept[entry]]] + within], values[kept[entry]]
            is_first = np.bincount(entry, weights=first == other, minlength=len(kept)) > 0
            # Two first words meet once.
            use = (first != other) & (~is_first[entry] | (first < other))
            first, other, at = first[use], other[use], row[kept[entry[use]]]
            low, high = np.minimum(first, other).view(np.uint64), np.maximum(first, other).view(np.uint64)
            both = ((low * np.uint64(0x9E3779B97F4A7C15)) ^ (high * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9))).view(np.int64)
            v = _vectors(values, offsets)[at].view(np.int64)
            yield pa.RecordBatch.from_arrays([kind.take(pa.array(at)), pa.array(both), ident.take(pa.array(at)), pa.array(size[at].astype(np.int32)), *[pa.array(v[:, i].copy()) for i in range(PIECES)]], names=["kind", "word", "class", "size", *names])

    return heavy.select("kind", "class", "words", "firsts").mapInArrow(explode, "kind string, word long, class long, size int, " + ", ".join(f"{n} long" for n in names))


def _close(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs whose vectors differ in no more bits than the radius of their sizes allows."""
    distance = np.zeros((len(a), len(b)), np.uint8 if PIECES < 4 else np.uint16)
    for i in range(PIECES):
        distance += np.bitwise_count(a[:, i, None] ^ b[None, :, i])
    sums = size_a[:, None] + size_b[None, :]
    return np.nonzero(distance <= (radius * sums + 1e-9).astype(distance.dtype if sums.max() < 250 else np.int64))


def _compared(radius: float, threshold: float) -> object:
    step = 512

    def pairs_of(sizes: np.ndarray, vectors: np.ndarray, ids: np.ndarray, second: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows are sorted by size within each side; ``second`` marks the other tile (None: one tile with itself)."""
        a = np.arange(len(ids)) if second is None else np.flatnonzero(~second)
        b = a if second is None else np.flatnonzero(second)
        for i in range(0, len(a), step):
            for j in range(i if second is None else 0, len(b), step):
                p, q = a[i : i + step], b[j : j + step]
                # Skip where all sizes differ beyond the radius: the smaller set is too small a part of the larger.
                if sizes[p[-1]] < threshold * sizes[q[0]] - 1e-9 or sizes[q[-1]] < threshold * sizes[p[0]] - 1e-9:
                    continue
                x, y = _close(vectors[p], vectors[q], sizes[p], sizes[q], radius)
                if second is None and i == j:
                    keep = x < y
                    x, y = x[keep], y[keep]
                yield ids[p[x]], ids[q[y]]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by kind, word and pair of tiles, then side and size; a cell may spread over batches."""
        rest: pa.Table | None = None
        for batch in batches:
            if batch.num_rows:
                whole = pa.Table.from_batches([batch])
                rest = whole if rest is None else pa.concat_tables([rest, whole])
                cell = rest["cell"].to_numpy()
                cut = np.flatnonzero(cell != cell[-1])
                if len(cut):
                    yield from cells(rest.slice(0, int(cut[-1]) + 1))
                    rest = rest.slice(int(cut[-1]) + 1)
        if rest is not None:
            yield from cells(rest)

    def cells(t: pa.Table) -> Iterator[pa.RecordBatch]:
        cell, sizes, ids = (t[c].to_numpy() for c in ("cell", "size", "class"))
        other = t["other"].to_numpy()
        vectors = np.stack([t[f"v{i}"].to_numpy().view(np.uint64) for i in range(PIECES)], axis=1)
        ends = np.append(np.flatnonzero(np.diff(cell)) + 1, len(cell))
        kind = t["kind"].combine_chunks() if t["kind"].num_chunks else t["kind"]
        start = 0
        left, right, at = [], [], []
        for end in ends.tolist():
            if end - start > 1:
                own = slice(start, end)
                second = other[own] == 1 if other[own].any() or other[end - 1] == 2 else None
                for x, y in pairs_of(sizes[own], vectors[own], ids[own], second):
                    if len(x):
                        left.append(x)
                        right.append(y)
                        at.append(np.full(len(x), start))
            start = end
        if left:
            x, y = np.concatenate(left), np.concatenate(right)
            kinds = t["kind"].take(pa.array(np.concatenate(at))).combine_chunks()
            yield pa.RecordBatch.from_arrays([kinds, pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["kind", "a", "b"])

    return compare


def _split(prefix: DataFrame, tile: int) -> tuple[DataFrame, DataFrame]:
    """(rows of groups that fit a tile, rows of larger ones with ``n``)."""
    loads = prefix.groupBy("kind", "word").agg(F.count(F.lit(1)).alias("n")).where(f"n > {tile}")
    return prefix.join(loads.select("kind", "word"), ["kind", "word"], "left_anti"), prefix.join(loads, ["kind", "word"])


def _cells(heavy: DataFrame, threshold: float, tile: int) -> DataFrame:
    """Rows of large groups laid into cells, one for each pair of tiles that may hold similar sets."""
    # Tiles of a group: bands of sizes (similar sizes lie in the same or neighbouring bands), large bands cut by hash.
    band = F.floor(F.log("size") / -math.log(threshold) + 1e-9).cast("int")
    parts = F.ceil(F.col("n") / tile).cast("int")
    tiles = heavy.withColumn("band", band).withColumn("part", F.pmod(F.xxhash64("class"), parts).cast("int")).withColumn("parts", parts)
    # A tile is (band, part); a row goes to each cell of its tile and a tile not before it whose band is the same or the next.
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    cell = lambda band1, part1, band2, part2, other: F.struct(band1.alias("band1"), part1.alias("part1"), band2.alias("band2"), part2.alias("part2"), other.alias("other"))
    b, p = F.col("band"), F.col("part")
    own = F.transform(every, lambda k: cell(b, F.least(p, k), b, F.greatest(p, k), F.when(k == p, 0).when(k > p, 2).otherwise(1)))
    above = F.transform(every, lambda k: cell(b, p, b + 1, k, F.lit(2)))
    below = F.transform(every, lambda k: cell(b - 1, k, b, p, F.lit(1)))
    return tiles.withColumn("c", F.explode(F.concat(own, above, below)))


def candidate_pairs(sets: DataFrame, counts: np.ndarray, threshold: float, tile: int = TILE) -> DataFrame:
    """Distinct (kind, a, b), a < b: all pairs of classes that may be similar; ``threshold`` is above one half, so that similar sets share two words."""
    radius = (1 - threshold) / (1 + threshold)
    # Prefixes are kept: how many texts a word's group has decides where its rows go.
    light, heavy = _split(checkpointed(prefixes(sets, counts, threshold)), tile)
    firsts = heavy.groupBy("kind", "class").agg(F.collect_list("word").alias("firsts"))
    with_words = firsts.join(sets.select("kind", "class", "words"), ["kind", "class"])
    light2, heavy2 = _split(checkpointed(second_words(with_words, counts, threshold)), tile)
    columns = ["kind", "class", "size", *[f"v{i}" for i in range(PIECES)]]
    small = light.select(*columns, F.xxhash64("kind", "word").alias("cell"), F.lit(0).alias("other"))
    pairs = light2.select(*columns, F.xxhash64("kind", "word", F.lit("second")).alias("cell"), F.lit(0).alias("other"))
    large = _cells(heavy2, threshold, tile).select(*columns, F.xxhash64("kind", "word", "c.band1", "c.part1", "c.band2", "c.part2").alias("cell"), F.col("c.other").alias("other"))
    laid = small.unionByName(pairs).unionByName(large).repartition("cell").sortWithinPartitions("cell", "other", "size")
    return laid.mapInArrow(_compared(radius, threshold), "kind string, a long, b long").distinct()


def similar_classes(sets: DataFrame, threshold: float = 0.7, tile: int = TILE) -> DataFrame:
    """(kind, a, b, similarity), a < b: all pairs of classes whose word sets have at least this Jaccard similarity."""
    if not 0.5 < threshold <= 1:
        raise ValueError("the threshold must be above one half")
    found = candidate_pairs(sets, word_counts(sets), threshold, tile)
    one = sets.select("kind", F.col("class").alias("a"), F.col("words").alias("wa"))
    two = sets.select("kind", F.col("class").alias("b"), F.col("words").alias("wb"))
    both = found.join(one, ["kind", "a"]).join(two, ["kind", "b"])
    common = F.size(F.array_intersect("wa", "wb"))
    checked = both.withColumn("common", common).withColumn("similarity", F.col("common") / (F.size("wa") + F.size("wb") - F.col("common")))
    return checked.where(f"similarity >= {threshold} - 1e-12D").select("kind", "a", "b", "similarity")


def similar_records(df: DataFrame, kind: str, ident: str, text: str, threshold: float = 0.7) -> DataFrame:
    """(kind, id_a, id_b), id_a < id_b: all pairs of records of one kind whose texts are similar, equal texts included.

    Ids are unique within a kind; a repeated row counts once. Rows without a text, an id or a kind are in no pair, texts without a word only in pairs of equal texts.
    n equal texts are n (n - 1) / 2 pairs: where copies are many, use ``groups``, which doesn't expand them.
    """
    members, sets = classes(df, kind, ident, text)
    a = members.select("kind", F.col("class").alias("a"), F.col("id").alias("x"))
    b = members.select("kind", F.col("class").alias("b"), F.col("id").alias("y"))
    across = similar_classes(sets, threshold).select("kind", "a", "b").join(a, ["kind", "a"]).join(b, ["kind", "b"])
    shared = members.groupBy("kind", "class").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("kind", F.col("class").alias("a"))
    within = shared.join(a, ["kind", "a"]).join(b.withColumnRenamed("b", "a"), ["kind", "a"]).where("x < y")
    pairs = across.select("kind", "x", "y").unionByName(within.select("kind", "x", "y"))
    return pairs.select("kind", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, class, group): the least class of each connected component.

    Rounds of taking the least label of the neighbours and then the label of one's label; lineage is cut by checkpoint() after
    each round, and what comes to the driver is one sum that tells whether labels still change."""
    both = checkpointed(edges.select("kind", F.col("a").alias("class"), F.col("b").alias("other")).unionByName(edges.select("kind", F.col("b").alias("class"), F.col("a").alias("other"))))
    labels = checkpointed(both.select("kind", "class").distinct().withColumn("group", F.col("class")))
    last = None
    while True:
        near = both.join(labels.withColumnRenamed("class", "other"), ["kind", "other"]).groupBy("kind", "class").agg(F.min("group").alias("near"))
        lower = labels.join(near, ["kind", "class"]).select("kind", "class", F.least("group", "near").alias("group"))
        # The label of each label in use, copied so often that the rows of a common label spread over as many tasks.
        used = lower.select("kind", F.col("group").alias("class")).distinct()
        jump = lower.join(used, ["kind", "class"], "left_semi").select("kind", F.col("class").alias("group"), F.col("group").alias("jump"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        salted = lower.withColumn("salt", F.pmod(F.xxhash64("class"), F.lit(SALTS)).cast("int"))
        labels = checkpointed(salted.join(jump, ["kind", "group", "salt"]).select("kind", "class", F.least("group", "jump").alias("group")))
        total = labels.agg(F.sum(F.col("group").cast("decimal(38,0)"))).first()[0]
        if total == last:
            break
        last = total
    return nodes.join(labels, ["kind", "class"], "left").select("kind", "class", F.coalesce("group", "class").alias("group"))


def groups(df: DataFrame, kind: str, ident: str, text: str, threshold: float = 0.7) -> DataFrame:
    """(kind, id, class, n_links, group) of every record with a kind, an id and a text: its class of equal word sets, the number of other classes
    that are similar to it, and the least class of its group of linked classes. Copies are not expanded into pairs."""
    members, sets = classes(df, kind, ident, text)
    links = checkpointed(similar_classes(sets, threshold).select("kind", "a", "b"))
    ends = links.select("kind", F.col("a").alias("class")).unionByName(links.select("kind", F.col("b").alias("class")))
    degree = ends.groupBy("kind", "class").agg(F.count(F.lit(1)).alias("n_links"))
    grouped = components(members.select("kind", "class").distinct(), links).join(degree, ["kind", "class"], "left")
    return members.join(grouped, ["kind", "class"]).select("kind", "id", "class", F.coalesce("n_links", F.lit(0)).alias("n_links"), "group")
