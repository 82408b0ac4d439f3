"""Centroid clustering of integer vectors by a progressive search over Walsh-Hadamard coefficients.

Vectors and centroids are transformed exactly (sums and differences of integers only); the transform keeps squared
distances up to the factor 64. Coefficients are ordered by the number of their sign changes, so that the first ones
carry the coarse shape. A search adds up squared coefficient differences from coarse to fine. What the coefficients
still to come can add lies between the squared difference and the squared sum of the two tails' norms; a centroid whose
least total is above another's greatest is strictly worse and is dropped. What is left is finished over all 64.

Vectors never move: each round is one pass over the table, in which a task adds up its vectors by cluster and sends at
most 64 sums a cluster. The driver holds the centroids alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowatlas.llm.common import stable

SIZE = 64
#: Coefficients are added in slices that end here.
LEVELS = (0, 1, 2, 4, 8, 16, 32, 64)
#: Up to this magnitude all sums of squares of a search fit 64 bits; beyond it Python's integers are used.
SMALL = 2**24


def _coarse_first() -> np.ndarray:
    """Places of the transform's coefficients by their functions' sign changes."""
    at = np.arange(SIZE)
    ones = np.array([[bin(i & j).count("1") % 2 for j in at] for i in at])
    return np.argsort(np.abs(np.diff(ones, axis=1)).sum(axis=1), kind="stable")


ORDER = _coarse_first()


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)`` of doubles, as exact integers."""
    scaled = np.floor(values * scale)
    if np.abs(scaled).max(initial=0) <= SMALL:
        return scaled.astype(np.int64)
    return np.array([int(x) for x in scaled.ravel()], dtype=object).reshape(scaled.shape)


def transform(vectors: np.ndarray) -> np.ndarray:
    """The 64 Walsh-Hadamard coefficients of each row, coarse ones first."""
    n, half = len(vectors), 1
    while half < SIZE:
        pairs = vectors.reshape(n, SIZE // (2 * half), 2, half)
        left, right = pairs[:, :, 0], pairs[:, :, 1]
        vectors = np.stack([left + right, left - right], axis=2).reshape(n, SIZE)
        half *= 2
    return vectors[:, ORDER]


def _tails(coefficients: np.ndarray) -> list[np.ndarray]:
    """Squared norms, as doubles, of what follows each level."""
    squares = coefficients * coefficients
    return [squares[:, at:].sum(axis=1).astype(np.float64) for at in LEVELS]


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (the smaller of equally near ones) and exact squared distance, by row."""
    n, k = len(vectors), len(centroids)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if object in (vectors.dtype, centroids.dtype):
        vectors, centroids = vectors.astype(object), centroids.astype(object)
    a, b = transform(vectors), transform(centroids)
    a_tails, b_tails = _tails(a), _tails(b)
    row, number = np.repeat(np.arange(n), k), np.tile(np.arange(k), n)
    total = np.zeros(n * k, a.dtype)
    for level, (start, end) in enumerate(zip(LEVELS, LEVELS[1:]), 1):
        gap = a[row, start:end] - b[number, start:end]
        total = total + (gap * gap).sum(axis=1)
        if end == SIZE:
            break
        # bounds of the whole sums, widened by more than doubles can be off
        x, y = a_tails[level][row], b_tails[level][number]
        sure, cross = total.astype(np.float64) + x + y, 2 * np.sqrt(x) * np.sqrt(y)
        slack = 1e-9 * (sure + cross) + 1
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        bound = np.repeat(np.minimum.reduceat(sure + cross + slack, first), np.diff(np.r_[first, len(row)]))
        stay = sure - cross - slack <= bound
        row, number, total = row[stay], number[stay], total[stay]
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    least = np.minimum.reduceat(total, first)
    best = np.flatnonzero(total == np.repeat(least, np.diff(np.r_[first, len(row)])))
    best = best[np.r_[True, row[best][1:] != row[best][:-1]]]
    return number[best], least // SIZE


def _batches(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        values = batch.column(1).flatten().to_numpy(zero_copy_only=False)
        yield batch.column(0), whole(values.reshape(-1, SIZE), scale)


def _assigned(vectors: DataFrame, centroids: np.ndarray, scale: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, rows in _batches(batches, scale):
            number, distance = nearest(rows, centroids)
            yield pa.RecordBatch.from_arrays([ids, pa.array(number, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(run, "vec_id long, cluster int, distance long")


def _moved(vectors: DataFrame, centroids: np.ndarray, scale: int) -> np.ndarray:
    """The centroids after one round: floors of the exact means of their vectors; those without vectors stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = [0] * len(centroids), [[0] * SIZE for _ in centroids]
        for _, rows in _batches(batches, scale):
            number, _ = nearest(rows, centroids)
            for c in np.unique(number):
                mine = rows[number == c]
                counts[c] += len(mine)
                sums[c] = [s + int(x) for s, x in zip(sums[c], mine.sum(axis=0))]
        held = [c for c in range(len(centroids)) if counts[c]]
        columns = [[c for c in held for _ in range(SIZE)], list(range(SIZE)) * len(held), [counts[c] for c in held for _ in range(SIZE)], [str(x) for c in held for x in sums[c]]]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string())], ["cluster", "place", "n", "total"])

    parts = vectors.mapInArrow(run, "cluster int, place int, n long, total string")
    sums = parts.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    out = centroids.tolist()
    for r in sums.collect():  # 64 rows a cluster
        out[r["cluster"]][r["place"]] = int(r["total"]) // r["n"]
    return _packed(out)


def _packed(rows: list[list[int]]) -> np.ndarray:
    small = all(abs(x) <= SMALL for r in rows for x in r)
    return np.array(rows, dtype=np.int64 if small else object).reshape(len(rows), SIZE)


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def cluster(vectors: DataFrame, *, clusters: int = 16, rounds: int = 3, scale: int = 64, seed: str = "1") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each vector of ``vec_id, embedding``.

    A vector takes part if it has exactly 64 components, none of them null or not finite; a null embedding doesn't. The
    first centroids are the vectors with the smallest SHA-256 of ``<seed>:<vec_id>``; vectors without an id come last
    there, and rows that share an id are ordered by their components. Fewer vectors than ``clusters`` give as many
    centroids as there are vectors. Rows that repeat are vectors of their own. Equally near centroids: the smaller
    number. An empty table gives no rows, and further columns of ``vectors`` don't show. A squared distance or an inertia
    beyond 64 bits is an error.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where((F.size("embedding") == SIZE) & F.forall("embedding", _finite))
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    start = rows.orderBy(name.asc_nulls_last(), "embedding").select("embedding").limit(clusters).collect()
    centroids = _packed([whole(np.array(r["embedding"]), scale).tolist() for r in start])
    if start:
        for _ in range(rounds):
            centroids = _moved(rows, centroids, scale)
    found = stable(_assigned(rows, centroids, scale))
    sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row a cluster
    facts = [(c, s, sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, s in sums.items()]
    facts = vectors.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
