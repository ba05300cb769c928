"""Packing of items of whole sizes into containers of a fixed capacity.

Harmonic packing: an item of more than capacity/(k+1) and at most capacity/k belongs to class k, and k items of a class
fill a container. So containers of a class take a fixed number of items, whichever they are, and workers fill them independently
of each other: an item's number in its class, divided by k, is its container. Alone that leaves the rest of each container (nearly
half of it in class 1) empty. A finisher uses that rest: before the items of a class get containers of their own, they take the room that
larger classes left over, containers with the same room a fixed number of items of one size. As sizes are whole numbers, the
plan of both needs only the number of items of every size (at most capacity + 1 numbers); it names, for every size, ranges of
item numbers with the first container and the fixed count per container. Items are numbered within hash chunks of a size plus
the chunks' offsets, so no task sees all items of a size, and each item finds its container by arithmetic.

An item larger than a container is cut into full pieces and a rest; other items are never cut.
"""

from __future__ import annotations

import bisect
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenlog.llm.shared import checkpointed

Range = tuple[int, int, int, int, int, int]


class _Rooms:
    """Ranges of containers by the room left in them."""

    def __init__(self) -> None:
        self.ranges: dict[int, list[tuple[int, int]]] = {}
        self.sizes: list[int] = []  # sorted keys of ranges

    def put(self, left: int, low: int, high: int) -> None:
        if high > low and left > 0:
            if left not in self.ranges:
                self.ranges[left] = []
                bisect.insort(self.sizes, left)
            self.ranges[left].append((low, high))

    def take(self, size: int, n: int) -> list[Range]:
        """Puts up to ``n`` items of a size, numbered from 0, into the containers with the least room that fits, as many in each as fit."""
        made: list[Range] = []
        left_over: list[tuple[int, int, int]] = []
        at, i = 0, bisect.bisect_left(self.sizes, size)
        while at < n and i < len(self.sizes):
            left = self.sizes[i]
            each = left // size
            ranges = self.ranges[left]
            while ranges and at < n:
                low, high = ranges.pop()
                whole = min(high - low, (n - at) // each)
                if whole:
                    made.append((size, at, at + whole * each, low, each, 0))
                    left_over.append((left - each * size, low, low + whole))
                    at, low = at + whole * each, low + whole
                if low < high and at < n:  # fewer than ``each`` items are left
                    made.append((size, at, n, low, each, 0))
                    left_over.append((left - (n - at) * size, low, low + 1))
                    at, low = n, low + 1
                if low < high:
                    ranges.append((low, high))
            if ranges:
                i += 1
            else:
                del self.ranges[self.sizes.pop(i)]
        for room in left_over:
            self.put(*room)
        return made


def plan(counts: dict[int, int], capacity: int) -> tuple[list[Range], int]:
    """(size, first item, end item, first container, items per container, shift) for all ranges, and the number of containers.

    Item i of a range lies in container first + (i - first item + shift) // items per container. Classes go from large items to small.
    """
    ranges: list[Range] = []
    rooms, containers = _Rooms(), 0
    for k, sizes in groupby(sorted((s for s in counts if s > 0), reverse=True), lambda s: capacity // s):
        own: list[tuple[int, int]] = []
        for size in sizes:
            finished = rooms.take(size, counts[size])
            ranges += finished
            own.append((size, finished[-1][2] if finished else 0))
        # Containers of the class: k items each, in the order of their sizes.
        place, load, opened = 0, 0, []
        for size, at in own:
            n = counts[size] - at
            if not n:
                continue
            ranges.append((size, at, counts[size], containers, k, place))
            begun = min(n, -place % k)
            load += begun * size
            if begun and not (place + begun) % k:
                opened.append((capacity - load, (place + begun) // k - 1, (place + begun) // k))
                load = 0
            whole = (n - begun) // k
            first = (place + begun) // k
            opened.append((capacity - k * size, first, first + whole))
            load += (n - begun - whole * k) * size
            place += n
        if place % k:
            opened.append((capacity - load, place // k, place // k + 1))
        for left, low, high in opened:
            rooms.put(left, containers + low, containers + high)
        containers += -(-place // k)
    if counts.get(0):  # items of size 0 take no room: spread evenly
        containers = max(containers, 1)
        ranges.append((0, 0, counts[0], 0, -(-counts[0] // containers), 0))
    return ranges, containers


def pack(df: DataFrame, ident: str, size: str, capacity: int, chunk_items: int = 65_536) -> DataFrame:
    """(ident, piece, size, container) for every item: piece 0 of an item that is whole, 0, 1, ... of one that is cut.

    Sizes are whole numbers; null or negative sizes count as 0. Ids should be unique (rows with equal ids and sizes are
    packed each, ties in the numbering are broken arbitrarily). An empty table gives an empty result.
    """
    n = F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0))
    full = F.floor(n / capacity).cast("int")
    rest = (n - full * capacity).cast("int")
    sizes = F.when((rest > 0) | (full == 0), F.concat(F.array_repeat(F.lit(capacity), full), F.array(rest))).otherwise(F.array_repeat(F.lit(capacity), full))
    items = checkpointed(df.select(F.col(ident).alias("id"), F.posexplode(sizes).alias("piece", "size")))
    total = items.count()
    chunks = max(1, -(-total // chunk_items))
    items = items.withColumn("chunk", F.pmod(F.xxhash64("id", "piece"), F.lit(chunks)))
    by_chunk = items.groupBy("size", "chunk").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["size"]: r["n"] for r in by_chunk.groupBy("size").agg(F.sum("n").alias("n")).collect()}  # at most capacity + 1 rows
    ranges, _ = plan(counts, capacity)
    before = by_chunk.withColumn("offset", F.coalesce(F.sum("n").over(W.partitionBy("size").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    numbered = items.withColumn("place", F.row_number().over(W.partitionBy("size", "chunk").orderBy("id", "piece")) - 1).join(before, ["size", "chunk"])
    numbered = numbered.withColumn("number", F.col("place") + F.col("offset"))
    table = df.sparkSession.createDataFrame(ranges or [(-1, 0, 0, 0, 1, 0)], "size int, low long, high long, first long, each long, shift long")
    # The plan has a few rows per size, whatever the number of items.
    placed = numbered.join(F.broadcast(table), "size").where("number >= low and number < high")
    return placed.select(F.col("id").alias(ident), "piece", "size", F.expr("first + (number - low + shift) div each").alias("container"))
