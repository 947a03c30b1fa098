"""Centroid clustering in integers: a PCA rotation bounds distances from below, what the bound leaves is verified exactly."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import materialise
from marketloom.llm.vectors import finite, integers, packed, unpacked

#: Vectors that a task looks at at once.
_BLOCK = 8192


def _moments(rows: DataFrame, vector: str, dim: int, scale: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, sums and sums of products of all components: summed in each task, then by cell, so dim * dim cells reach the driver."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim + 1, dim + 1))
        for batch in batches:
            q = integers(batch.column(0), scale)[0].reshape(-1, dim)
            one = np.concatenate([q, np.ones((len(q), 1))], axis=1)
            total += one.T @ one
        yield pa.RecordBatch.from_pydict({"cell": np.arange(total.size), "v": total.ravel()})

    cells = rows.select(vector).mapInArrow(partial, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((dim + 1) ** 2)
    for cell, v in cells:
        total[cell] = v
    total = total.reshape(dim + 1, dim + 1)
    return int(total[dim, dim]), total[dim, :dim], total[:dim, :dim]


def rotation(n: int, sums: np.ndarray, products: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The mean, and the directions of greatest variance as columns, widest first."""
    mean = sums / n
    _, axes = np.linalg.eigh(products / n - np.outer(mean, mean))
    return mean, axes[:, ::-1]


def rotated(q: np.ndarray, mean: np.ndarray, axes: np.ndarray, leading: int) -> tuple[np.ndarray, np.ndarray]:
    """The leading rotated coordinates of integer rows, and the norm of the rest."""
    y = (q - mean) @ axes
    return y[:, :leading], np.sqrt((y[:, leading:] ** 2).sum(axis=1))


def nearest(q: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: np.ndarray, c_lead: np.ndarray, c_rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and exact squared distance of the nearest centroid (ties: the smaller number), and how many were verified.

    The projected distance plus the squared difference of the residual norms never exceeds the true distance. The centroid with
    the least bound is measured in integers; all whose bound does not exceed that distance are measured too. The slack covers
    the rounding of the bound, so it loses nothing.
    """
    sizes = (lead ** 2).sum(axis=1) + rest ** 2
    c_sizes = (c_lead ** 2).sum(axis=1) + c_rest ** 2
    bound = (lead ** 2).sum(axis=1)[:, None] + (c_lead ** 2).sum(axis=1)[None, :] - 2 * lead @ c_lead.T + (rest[:, None] - c_rest[None, :]) ** 2
    bound -= 1e-9 * (sizes[:, None] + c_sizes[None, :]) + 1e-6
    first = bound.argmin(axis=1)
    upper = ((q - centroids[first]) ** 2).sum(axis=1)
    row, col = np.nonzero(bound <= upper[:, None])
    exact = np.concatenate([((q[row[i : i + 65536]] - centroids[col[i : i + 65536]]) ** 2).sum(axis=1) for i in range(0, len(row), 65536)])
    starts = np.searchsorted(row, np.arange(len(q)))
    least = np.minimum.reduceat(exact, starts)
    hit = np.flatnonzero(exact == least[row])
    chosen = col[hit[np.searchsorted(row[hit], np.arange(len(q)))]]
    return chosen, least, len(row)


def fit_centroids(rows: DataFrame, vector: str, dim: int, k: int = 40, rounds: int = 5, scale: int = 256, seed: int = 2, leading: int = 16) -> tuple[DataFrame, list[list[int]]]:
    """Assignments (vec_id, cluster, distance) and the final centroids; see cluster_vectors.

    The rotated table is written once and read by every round. What reaches the driver is k rows of sums a round.
    """
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    kept = rows.select("vec_id", vector).filter(finite(vector) & (F.size(vector) == dim))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    # Null ids have no hash and come last; vectors of one id go by their components.
    start = kept.select(order.alias("_o"), whole.alias("_w")).orderBy(F.asc_nulls_last("_o"), "_w").limit(k).collect()
    centroids = [list(r["_w"]) for r in start]
    if not centroids:
        return kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), []
    mean, axes = rotation(*_moments(kept, vector, dim, scale))
    leading = min(leading, dim)

    def rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = integers(batch.column(1), scale)[0].reshape(-1, dim)
            lead, rest = rotated(q, mean, axes, leading)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), packed(q.astype(np.int32)), packed(lead), pa.array(rest)], names=["vec_id", "q", "lead", "rest"])

    table = materialise(kept.mapInArrow(rotate, "vec_id long, q binary, lead binary, rest double"), "rotated")

    def assigned(batch: pa.RecordBatch, now: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
        c_lead, c_rest = rotated(now, mean, axes, leading)
        for at in range(0, batch.num_rows, _BLOCK):
            part = batch.slice(at, _BLOCK)
            q = unpacked(part.column(1), np.int32, dim).astype(np.int64)
            lead, rest = unpacked(part.column(2), np.float64, leading), part.column(3).to_numpy(zero_copy_only=False)
            yield q, *nearest(q, lead, rest, now, c_lead, c_rest)[:2], part.column(0)

    for _ in range(rounds):
        now = np.array(centroids, dtype=np.int64)

        def sums(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros((len(now), dim), dtype=np.int64), np.zeros(len(now), dtype=np.int64)
            for batch in batches:
                for q, cluster, _, _ in assigned(batch, now):
                    np.add.at(total, cluster, q)
                    count += np.bincount(cluster, minlength=len(now))
            held = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(count[held]), pa.array(total[held].tolist(), type=pa.list_(pa.int64()))], names=["cluster", "n", "s"])

        part = table.mapInArrow(sums, "cluster int, n long, s array<long>").select("cluster", "n", F.posexplode("s").alias("i", "s"))
        for cluster, i, n, s in part.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():
            centroids[cluster][i] = int(s) // n

    now = np.array(centroids, dtype=np.int64)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, cluster, distance, ids in assigned(batch, now):
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return materialise(table.mapInArrow(last, "vec_id long, cluster int, distance long"), "assigned"), centroids


def cluster_vectors(rows: DataFrame, vector: str = "embedding", dim: int = 64, k: int = 40, rounds: int = 5, scale: int = 256, seed: int = 2, leading: int = 16) -> DataFrame:
    """k-means in integers over all vectors of exactly dim finite components, turned into floor(scale * component).

    The first centroids are the k vectors with the least sha256 of `seed:vec_id`. Each round assigns every vector to its nearest
    centroid and moves every centroid that has vectors to the floor of their mean; then vectors are assigned once more.

    Returns vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256, one row for each vector kept. Rows with a
    null vector, a null or non-finite component or another number of components are left out. Rows that repeat a vec_id are vectors
    of their own; where they compete for a first centroid, components decide. A null vec_id is clustered and comes last among
    the first centroids. Fewer vectors than k give as many centroids; an empty table gives no rows. Components whose integer
    reaches 2 ** 27 raise ArithmeticError. Other columns are not looked at.
    """
    assigned, centroids = fit_centroids(rows, vector, dim, k, rounds, scale, seed, leading)
    sums = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    # k rows at most, whatever the input.
    per = rows.sparkSession.createDataFrame([(i, sums.get(i, 0), sum(sums.values()), d) for i, d in enumerate(digests)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
