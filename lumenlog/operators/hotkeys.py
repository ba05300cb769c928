"""Per-key results where a few keys hold most rows: multi-level tree aggregation."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlog.sources.tables import fresh

_MERGE = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


def tree_aggregate(df: DataFrame, keys: list[str], aggregates: dict[str, tuple[str, str | None]], chunk_rows: int = 131_072, fan_in: int = 32, chunks: int | None = None) -> DataFrame:
    """Aggregates (``name -> (count | sum | min | max, column)``) per key, never merging more than ``fan_in`` states at once.

    Rows are cut into chunks of ``chunk_rows`` where they lie; each chunk's rows are combined into one
    state per key before anything is shuffled (the state of a chunk leaves its task complete). Then
    rounds merge up to ``fan_in`` chunks' states per key until one is left, so however many rows a
    key has, no reducer receives more than ``fan_in`` states of it. The rounds follow from the number of
    chunks: ``chunks`` where the caller knows it, else the number of rows over ``chunk_rows``. Of Parquet tables a count reads only
    footers; what explodes or filters rows is better counted before and given as ``chunks``.

    Null keys form a key of their own; null values are skipped, a key of only nulls gives null (count:
    all rows). An empty table gives an empty result. The result has the keys and the aggregates only.
    """
    chunk = fresh(df, "chunk")
    if chunks is None:
        chunks = max(1, math.ceil(df.count() / chunk_rows))
    rounds = max(1, math.ceil(math.log(max(chunks, 2), fan_in)))
    slots = fan_in**rounds
    place = F.monotonically_increasing_id()
    # The upper bits are the partition, the lower 33 the row's place in it: a chunk is a piece of one task's rows.
    number = F.xxhash64(F.shiftright(place, 33), F.floor(place.bitwiseAND((1 << 33) - 1) / chunk_rows))
    made = {"count": lambda _: F.count(F.lit(1)), "sum": F.sum, "min": F.min, "max": F.max}
    states = df.withColumn(chunk, F.pmod(number, F.lit(slots))).groupBy(*keys, chunk).agg(*[made[how](column and F.col(column)).alias(name) for name, (how, column) in aggregates.items()])
    for level in range(rounds):
        by = [] if level == rounds - 1 else [F.floor(F.col(chunk) / fan_in).alias(chunk)]
        states = states.groupBy(*keys, *by).agg(*[_MERGE[how](name).alias(name) for name, (how, _) in aggregates.items()])
    return states
