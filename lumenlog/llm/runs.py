"""Runs of identical or near-identical consecutive events by optimal segmentation.

Per entity the events, in order of their positions, are cut into runs so that the dissimilarity within the runs plus
a penalty for each boundary is least: F(t) = min over s < t of F(s) + C(s, t) + penalty. C(s, t) sums a
dissimilarity of neighbours and, with a weight ``spread``, the deviations of all events of the run from its median. Both only grow
when runs are put together, so the pruned search (a start s is dropped as soon as F(s) + C(s, t) >= F(t)) keeps few
starts. Neighbours whose positions don't follow on each
other, whose labels differ, or of which one has no value, are infinitely dissimilar.

Without ``spread`` C adds up over neighbours, and the optimum has a boundary exactly where a pair of neighbours costs more than
the penalty: runs that are chains of small steps, as far apart as their ends may be. With it a slow drift is cut
where the deviations from the median outweigh a boundary.

Without ``spread`` a long entity is cut into blocks of positions that are segmented apart from each other, so no task gets a whole
entity. As C adds up over neighbours, the optimal segmentation of the whole is that of the blocks, with
the last run of a block and the first of the next joined if the pair of neighbours between them costs no
more than a boundary; that pair lies in neither block, so runs at the edges of blocks are joined by windows
over those edge runs only: first within groups of FAN blocks, then the runs at the edges of the groups.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Blocks whose edge runs one task joins.
FAN = 4096
_RUN = "first_pos long, last_pos long, n_rows long, n_events long, from_us long, to_us long, first_value double, last_value double, edge boolean"


def boundaries(dissimilarity: np.ndarray, penalty: float) -> list[int]:
    """Starts of the runs of the optimal segmentation of len(dissimilarity) + 1 events; pruned dynamic programming.

    dissimilarity[i] is that of events i and i + 1. Of segmentations that cost the same, the one with the
    fewest boundaries is taken.
    """
    d = dissimilarity.tolist()
    n = len(d) + 1
    cost = [-penalty] + [0.0] * n  # F(t), with F(0) so that the first run is free
    back = [0] * (n + 1)
    starts, sums = [0], [0.0]  # candidate starts s, and C(s, t)
    for t in range(1, n + 1):
        if t > 1:
            step = d[t - 2]
            sums = [c + step for c in sums]
            starts.append(t - 1)
            sums.append(0.0)
        best, at = min((cost[s] + c + penalty, s) for s, c in zip(starts, sums, strict=True))
        cost[t], back[t] = best, at
        kept = [(s, c) for s, c in zip(starts, sums, strict=True) if cost[s] + c < best]
        starts, sums = [s for s, _ in kept], [c for _, c in kept]
    cuts, t = [], n
    while t > 0:
        t = back[t]
        cuts.append(t)
    return cuts[::-1]


def segments(values: list[float], links: list[float], penalty: float, spread: float) -> list[int]:
    """Starts of the runs of the optimal segmentation where a run costs its links and ``spread`` times its deviations from its median; pruned dynamic programming.

    Of segmentations that cost the same, the one with the fewest boundaries found first is taken."""
    n = len(values)
    cost, back = [-penalty] + [0.0] * n, [0] * (n + 1)
    starts: list[tuple[int, list[float], float]] = []  # start, its events sorted, their links
    for t in range(1, n + 1):
        x = values[t - 1]
        if t > 1:
            starts = [(s, sorted_, link + links[t - 2]) for s, sorted_, link in starts]
        starts.append((t - 1, [], 0.0))
        costs = []
        for s, events, link in starts:
            bisect.insort(events, x)
            h = len(events) // 2
            costs.append(cost[s] + link + spread * (sum(events[-h:]) - sum(events[:h]) if h else 0.0))
        best = min(costs) + penalty
        cost[t], back[t] = best, starts[costs.index(min(costs))][0]
        starts = [c for c, k in zip(starts, costs, strict=True) if k < best]
    cuts, t = [], n
    while t > 0:
        t = back[t]
        cuts.append(t)
    return cuts[::-1]


def _segmented(penalty: float, least: int, keyed: int, spread: float) -> object:
    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by entity, block and position; a block's rows may spread over batches."""
        rest: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = pa.Table.from_batches([batch])
            rest = whole if rest is None else pa.concat_tables([rest, whole]).combine_chunks()
            group = rest["group"].to_numpy()
            cut = int(np.searchsorted(group != group[-1], False)) if group[0] == group[-1] else int(np.flatnonzero(group != group[-1])[-1]) + 1
            if group[0] == group[-1]:
                continue
            yield from out(rest.slice(0, cut))
            rest = rest.slice(cut)
        if rest is not None:
            yield from out(rest)

    def out(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        n = t.num_rows
        get = lambda c: t[c].to_numpy()
        group, pos = get("group"), get("pos")
        label = pc.fill_null(pc.dictionary_encode(t["label"]).combine_chunks().indices, -1).to_numpy(zero_copy_only=False)
        value = pc.fill_null(t["value"], np.nan).to_numpy().astype(float)
        # Rows stored more than once follow each other; the first counts.
        first = np.ones(n, bool)
        first[1:] = (group[1:] != group[:-1]) | (pos[1:] != pos[:-1])
        i = np.flatnonzero(first)
        d = np.abs(np.diff(value[i]))
        d[~(np.diff(pos[i]) == 1) | (np.diff(group[i]) != 0) | (label[i][1:] != label[i][:-1]) | (label[i][1:] < 0) | np.isnan(d)] = np.inf
        void = (label[i] < 0) | np.isnan(value[i])
        # Infinite dissimilarity always is a boundary: what lies between two of them is segmented by itself.
        hard = np.concatenate([[0], np.flatnonzero(np.isinf(d)) + 1, [len(i)]])
        starts = []
        for a, b in zip(hard[:-1].tolist(), hard[1:].tolist(), strict=True):
            if b - a == 1:
                starts.append(a)
            elif spread:
                starts += [a + c for c in segments(value[i[a:b]].tolist(), d[a : b - 1].tolist(), penalty, spread)]
            else:
                starts += [a + c for c in boundaries(d[a : b - 1], penalty)]
        s = np.array(starts)
        e = np.append(s[1:], len(i)) - 1
        block_first = np.concatenate([[True], np.diff(group[i]) != 0])
        block_last = np.concatenate([np.diff(group[i]) != 0, [True]])
        edge = block_first[s] | block_last[e]
        keep = ~void[s] & (edge | (e - s + 1 >= least))
        count = np.add.reduceat(pc.fill_null(t["n"], 0).to_numpy()[i], s)
        at = pc.fill_null(t["at"], 0).to_numpy()[i]
        low, high = np.minimum.reduceat(at, s), np.maximum.reduceat(at, s)
        s, e = s[keep], e[keep]
        head = [t[c].take(pa.array(i[s])).combine_chunks() for c in t.column_names[:keyed]]
        made = [head_ for head_ in head] + [t["label"].take(pa.array(i[s])).combine_chunks()]
        numbers = [pos[i][s], pos[i][e], e - s + 1, count[keep], low[keep], high[keep], value[i][s], value[i][e], edge[keep]]
        yield pa.RecordBatch.from_arrays([*made, *map(pa.array, numbers)], names=[*t.column_names[:keyed], "label", *[x.split()[0] for x in _RUN.split(", ")]])

    return segment


def collapse_runs(df: DataFrame, entity: list[str], pos: str, label: Column, value: Column, n: Column, at: Column, prefer: str, penalty: float = 0.5, least: int = 2, block: int = 8192, spread: float = 0.0) -> DataFrame:
    """Runs of at least ``least`` events: entity columns, label, first_pos, last_pos, n_rows, n_events (sum of ``n``), from_us, to_us (of ``at``).

    Of rows with the same entity and position the one with the smallest ``prefer`` counts. A null label or
    value ends a run and belongs to none; a null ``n`` adds nothing; rows with a null in the entity or the position belong to no run.
    Runs that would cost the same as their pieces stay whole. Empty tables give no runs; extra columns are ignored. With ``spread``
    an entity is segmented as a whole by one task: it is for entities of bounded length.
    """
    if spread:
        block = 1 << 62
    names = [f"k{i}" for i in range(len(entity))]
    rows = df.where(" and ".join(f"`{c}` is not null" for c in [*entity, pos])).select(
        *[F.col(c).alias(k) for c, k in zip(entity, names, strict=True)],
        label.alias("label"), value.cast("double").alias("value"), n.cast("long").alias("n"), at.cast("long").alias("at"), F.col(pos).cast("long").alias("pos"), F.col(prefer).alias("prefer"), F.floor(F.col(pos) / block).alias("block"),
    )
    group = F.xxhash64(*names, "block").alias("group")
    # One shuffle: blocks of an entity spread over the tasks.
    laid = rows.withColumn("group", group).repartition("group").sortWithinPartitions("group", *names, "pos", "prefer").select(*names, "group", "label", "value", "n", "at", "pos")
    kinds = ", ".join(f"{k} string" for k in names)
    runs = laid.mapInArrow(_segmented(penalty, least, len(names), spread), f"{kinds}, label string, {_RUN}")
    # Edge runs, a few per block: joined within groups of blocks, then those at the edges of the groups.
    values = ["first_pos", "last_pos", "n_rows", "n_events", "from_us", "to_us", "first_value", "last_value"]

    def joined(df: DataFrame, *group: str) -> DataFrame:
        by = W.partitionBy(*names, "label", *group).orderBy("first_pos")
        follows = (F.lag("last_pos").over(by) + 1 == F.col("first_pos")) & (F.abs(F.lag("last_value").over(by) - F.col("first_value")) <= penalty)
        marked = df.withColumn("begins", F.when(follows, 0).otherwise(1)).withColumn("run", F.sum("begins").over(by))
        made = [F.min("first_pos"), F.max("last_pos"), F.sum("n_rows"), F.sum("n_events"), F.min("from_us"), F.max("to_us"), F.min_by("first_value", "first_pos"), F.max_by("last_value", "first_pos")]
        return marked.groupBy(*names, "label", *group, "run").agg(*[m.alias(v) for m, v in zip(made, values, strict=True)]).drop("run")

    if not spread:
        size = block * FAN
        # Runs that lie within their block are groups of their own.
        near = joined(runs.withColumn("group", F.floor(F.col("first_pos") / size)).withColumn("alone", F.when(~F.col("edge"), F.col("first_pos"))), "group", "alone")
        # Of the others those that touch a group's first or last position may go on in the next.
        touches = (F.pmod("first_pos", F.lit(size)) == 0) | (F.pmod(F.col("last_pos") + 1, F.lit(size)) == 0)
        runs = joined(near.drop("group", "alone").withColumn("alone", F.when(~touches, F.col("first_pos"))), "alone")
    kept = [*names, "label", "first_pos", "last_pos", "n_rows", "n_events", "from_us", "to_us"]
    return runs.where(f"n_rows >= {least}").select(*[F.col(k).alias(c) for c, k in zip(entity, names, strict=True)], *kept[len(names) :])
