"""Information clustering of message ids by single moves over the matrix of mutual information."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def n_clusters(ids: int, factor: float = 1.0) -> int:
    """max(2, factor sqrt(n)); one cluster below three ids; at most n - 1."""
    return 1 if ids < 3 else min(max(2, int(factor * np.sqrt(ids))), ids - 1)


def score(matrix: np.ndarray, labels: np.ndarray, alpha: float) -> float:
    """Sum over clusters of size times mean similarity, plus alpha times the entropy of the sizes."""
    total = 0.0
    for k in np.unique(labels):
        at = np.flatnonzero(labels == k)
        if len(at) > 1:
            block = matrix[np.ix_(at, at)]
            total += len(at) * (block.sum() - np.trace(block)) / (len(at) * (len(at) - 1))
        p = len(at) / len(labels)
        total -= alpha * p * np.log2(p)
    return total


def partition(matrix: np.ndarray, k: int, seed: int, alpha: float = 1.0, trials: int = 100_000, idle: int = 15_000) -> tuple[float, np.ndarray]:
    """Clusters dealt at random, then each trial moves one element to the cluster where it raises the score most, if any does.

    Elements come in random order without return until one moves. Ends when none of all elements moves, after ``trials`` or after ``idle`` in a row
    without a move; the last element of a cluster stays. Sums by element and cluster are carried along, so a trial takes k steps."""
    n = len(matrix)
    r = np.random.default_rng(seed)
    off = matrix - np.diag(np.diag(matrix))
    labels = np.empty(n, int)
    labels[r.permutation(n)] = np.arange(n) % k
    to = np.stack([off[:, labels == c].sum(1) for c in range(k)], axis=1)
    size = np.bincount(labels, minlength=k)
    total = np.array([to[labels == c, c].sum() for c in range(k)])
    share = np.arange(1, n + 1) / n
    entropy = alpha * np.concatenate([[0.0], -share * np.log2(share)])
    order, still = np.arange(n), 0
    for _ in range(trials):
        if still >= min(n, idle):
            break
        at = r.integers(still, n)
        i = order[at]
        order[at], order[still] = order[still], i
        was = labels[i]
        if size[was] > 1:
            rest, gone = size - (np.arange(k) == was), total.copy()
            gone[was] -= 2 * to[i, was]
            gain = (gone + 2 * to[i]) / np.maximum(rest, 1) - gone / np.maximum(rest - 1, 1) + entropy[rest + 1] - entropy[rest]
            new = int(gain.argmax())
            if gain[new] > gain[was] + 1e-12:
                total = gone
                total[new] += 2 * to[i, new]
                to[:, was] -= off[:, i]
                to[:, new] += off[:, i]
                size[was] -= 1
                size[new] += 1
                labels[i] = new
                still = 0
                continue
        still += 1
    return score(matrix, labels, alpha), labels


def information_clusters(pairs: DataFrame, restarts: int = 50, trials: int = 100_000, most_ids: int = 4096, alpha: float = 0.1, idle: int = 15_000) -> DataFrame:
    """(message_id, cluster, score) from (a, b, mi): the best of ``restarts`` seeded runs, which run in parallel.

    A run has ``trials`` moves, or 50 per id where that is more, and normally ends earlier, when no single move raises its score.
    The dense matrix is bounded by ``most_ids`` ids (a dictionary of message ids has a few thousand); more are refused."""
    spark = pairs.sparkSession
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    names = sorted(r["id"] for r in ids.limit(most_ids + 1).collect())
    if len(names) > most_ids:
        raise ValueError(f"more than {most_ids} message ids")
    matrix = np.zeros((len(names), len(names)))
    # Columns of numbers, not rows: at most half of most_ids squared.
    rows = pairs.select("a", "b", "mi").toArrow()
    i, j = (pc.index_in(rows[c], pa.array(names)).to_numpy() for c in "ab")
    matrix[i, j] = matrix[j, i] = rows["mi"].to_numpy()
    k = n_clusters(len(names))
    sent = spark.sparkContext.broadcast(matrix)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for seed in pdf["id"]:
                s, labels = partition(sent.value, k, int(seed), alpha, max(trials, 50 * len(names)), idle)
                yield pd.DataFrame({"seed": seed, "score": s, "message_id": names, "cluster": labels})

    seeds, kind = spark.range(0, restarts, 1, restarts), "seed long, score double, message_id string, cluster int"
    best = seeds.mapInPandas(run, kind).agg(F.min_by("seed", F.struct(-F.col("score"), F.col("seed"))).alias("s")).first()["s"]
    return seeds.where(F.col("id") == best).mapInPandas(run, kind).select("message_id", "cluster", "score")


def kept_clusters(labels: DataFrame, pairs: DataFrame, ratio: float = 0.5) -> DataFrame:
    """(cluster, size, info): clusters of two or more whose mean information is at least ``ratio`` of the mean over all pairs, without the least of them."""
    a, b = labels.select(F.col("message_id").alias("a"), "cluster"), labels.select(F.col("message_id").alias("b"), "cluster")
    inside = pairs.join(a, "a").join(b, ["b", "cluster"]).groupBy("cluster").agg(F.avg("mi").alias("info"))
    sizes = labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).join(inside, "cluster").where("size > 1")
    mean = pairs.agg(F.avg("mi")).scalar()
    least = sizes.agg(F.min("info")).scalar()
    return sizes.withColumn("m", mean).withColumn("l", least).where(f"info >= m * {ratio} and info > l").select("cluster", "size", "info")


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each row (of equally near ones the first), and the squared distance."""
    label, least = np.zeros(len(x), int), np.full(len(x), np.inf)
    for k, c in enumerate(centroids):
        d = ((x - c) ** 2).sum(1)
        label[d < least] = k
        least = np.minimum(least, d)
    return label, least


def kmeans(df: DataFrame, key: str, vector: str, k: int | None = None, runs: int = 10, most_iterations: int = 300, seed: int = 101) -> DataFrame:
    """(key, cluster, distance, score): k-means of all rows by squared L2; the run of the least total cost (``score``), of equal ones the first.

    ``k`` is the rounded root of the number of rows unless given, and never more than that number. Each run starts from k rows drawn by a seeded
    hash of their keys and ends when no centroid moves or after ``most_iterations``; a cluster that loses all rows has its centroid at zero. All
    runs share each pass over the rows; the driver holds k centroids a run. Rows without a vector are left out; null or non-finite elements and
    vectors of different lengths are refused; an empty table gives no rows. ``distance`` is squared."""
    spark = df.sparkSession
    rows = df.where(F.col(vector).isNotNull()).select(key, F.transform(vector, lambda x: x.cast("double")).alias(vector))
    n = rows.count()
    kind = f"`{key}` {df.schema[key].dataType.simpleString()}, cluster int, distance double, score double"
    if not n:
        return spark.createDataFrame([], kind)
    k = min(n, k or int(np.sqrt(n) + 0.5))

    def matrix(pdf: pd.DataFrame) -> np.ndarray:
        x = np.array([np.asarray(v, float) for v in pdf[vector]])
        if not np.isfinite(x).all():
            raise ValueError("vectors with null or non-finite elements")
        return x

    def step(centroids: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, float]]:
        """The means of the rows nearest to each centroid and the total cost, by run."""
        sent = spark.sparkContext.broadcast(centroids)

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums = {r: (np.zeros_like(c), np.zeros(len(c), int), np.zeros(len(c))) for r, c in sent.value.items()}
            for pdf in batches:
                if len(pdf):
                    x = matrix(pdf)
                    for r, (total, count, cost) in sums.items():
                        label, d = nearest(x, sent.value[r])
                        np.add.at(total, label, x)
                        np.add.at(count, label, 1)
                        np.add.at(cost, label, d)
            part = TaskContext.get().partitionId()
            for r, (total, count, cost) in sums.items():
                at = np.flatnonzero(count)
                yield pd.DataFrame({"run": r, "cluster": at, "part": part, "n": count[at], "cost": cost[at], "total": list(total[at])})

        def whole(pdf: pd.DataFrame) -> pd.DataFrame:
            # In the order of the partitions, so that equal assignments give equal means to the last bit.
            pdf = pdf.sort_values("part")
            mean = np.sum(np.stack(pdf["total"].to_list()), axis=0) / pdf["n"].sum()
            return pd.DataFrame({"run": [pdf["run"].iloc[0]], "cluster": [pdf["cluster"].iloc[0]], "cost": [pdf["cost"].sum()], "mean": [mean]})

        parts = rows.mapInPandas(partial, "run int, cluster int, part int, n long, cost double, total array<double>")
        got = {r: [np.zeros_like(c), 0.0] for r, c in centroids.items()}
        for x in sorted(parts.groupBy("run", "cluster").applyInPandas(whole, "run int, cluster int, cost double, mean array<double>").collect()):
            got[x["run"]][0][x["cluster"]] = x["mean"]
            got[x["run"]][1] += x["cost"]
        sent.destroy()
        return {r: (c, cost) for r, (c, cost) in got.items()}

    moving = {}
    for r in range(runs):
        drawn = rows.select(F.xxhash64(F.lit(seed + r), key).alias("h"), key, vector).orderBy("h", key, vector).limit(k).collect()
        moving[r] = np.array([x[vector] for x in drawn], float)
    ended: dict[int, tuple[float, np.ndarray]] = {}
    for i in range(most_iterations):
        for r, (new, cost) in step(moving).items():
            if i == most_iterations - 1 or (new == moving[r]).all():
                ended[r] = (cost, moving.pop(r))
            else:
                moving[r] = new
        if not moving:
            break
    score, centroids = ended[min(ended, key=lambda r: (ended[r][0], r))]
    sent = spark.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                label, d = nearest(matrix(pdf), sent.value)
                yield pd.DataFrame({key: pdf[key], "cluster": label, "distance": d, "score": score})

    return rows.mapInPandas(assign, kind)
