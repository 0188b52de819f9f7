"""Centroid clustering of integer vectors by Lloyd's rounds with Elkan's bounds.

Each vector carries its cluster, an upper bound of the distance to its centroid and a lower bound of the distance to every
centroid from round to round, in a written table. By the triangle inequality a centroid needs no distance where the upper
bound lies below its lower bound or below half the distance between the two centroids. Bounds are rounded away from the
truth at every step, and only strictly greater distances are skipped, so each assignment is that of all exact distances,
ties included. Distances themselves are of integers, and exact.

Centroids are k rows of fixed length, the only thing that goes to the driver and to every task. New centroids are sums
of integers by cluster, pre-aggregated in each task, so a cluster of any size is no hot key.

Defined cases: vectors that are null, of another length, hold null or non-finite components, or components whose
integer passes ``LARGEST`` (distances would pass 64 bits) take no part; rows that repeat an id are vectors of their own,
and start as centroids in the order of their components; null ids come last in that order; with fewer vectors than k,
each is a centroid at the start; an empty table gives an empty result; inertias beyond 64 bits are null; further columns
take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, scratch, written

#: Integers up to this size: 64 squared differences of them fit 63 bits.
LARGEST = 2**27
#: Up to this size products and sums are exact in double precision.
_EXACT_FLOAT = 2**20


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, scale: int = 256) -> DataFrame:
    """(vec_id, v array<int>) of the rows that take part: floor(scale * x) of each component."""
    raw = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), raw.alias("raw"))
    fits = F.forall("raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float(LARGEST / scale)))
    rows = rows.filter(F.coalesce((F.size("raw") == dims) & fits, F.lit(False)))
    return rows.select("vec_id", F.transform("raw", lambda x: F.floor(x * F.lit(float(scale))).cast("int")).alias("v"))


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of ``seed:vec_id``, in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    found = rows.select(key.alias("key"), "v").orderBy(F.asc_nulls_last("key"), "v").limit(k).collect()
    return np.array([r["v"] for r in found], np.int64)


def squared(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """All squared distances, exact."""
    if max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0)) <= _EXACT_FLOAT:
        p, c = points.astype(float), centroids.astype(float)
        return ((p * p).sum(axis=1)[:, None] - 2 * (p @ c.T) + (c * c).sum(axis=1)[None, :]).astype(np.int64)
    return np.stack([((points - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def above(exact: np.ndarray) -> np.ndarray:
    """Roots of integers, rounded up: never below the truth."""
    return np.nextafter(np.sqrt(np.nextafter(exact.astype(float), np.inf)), np.inf)


def below(exact: np.ndarray) -> np.ndarray:
    """Roots of integers, rounded down: never above the truth."""
    return np.maximum(np.nextafter(np.sqrt(np.maximum(np.nextafter(exact.astype(float), -np.inf), 0)), -np.inf), 0)


def moved(upper: np.ndarray, lower: np.ndarray, cluster: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bounds after each centroid has moved by at most ``shift``."""
    return np.nextafter(upper + shift[cluster], np.inf), np.maximum(np.nextafter(lower - shift[None, :], -np.inf), 0)


def reassigned(
    points: np.ndarray, centroids: np.ndarray, halves: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(cluster, upper, lower, distances computed) under the bounds. halves: half of each two centroids' distance, rounded down."""
    n, k = lower.shape
    cluster, upper, lower = cluster.copy(), upper.copy(), lower.copy()
    other = np.arange(k)[None, :] != cluster[:, None]
    near = np.where(other, halves[cluster], np.inf)
    rows = np.flatnonzero(upper >= near.min(axis=1, initial=np.inf))
    rows = rows[(other[rows] & (upper[rows, None] >= lower[rows]) & (upper[rows, None] >= near[rows])).any(axis=1)]
    if not len(rows):
        return cluster, upper, lower, 0
    # The bound to the own centroid becomes exact first; what it then rules out needs no distance.
    own = ((points[rows] - centroids[cluster[rows]]) ** 2).sum(axis=1)
    upper[rows] = above(own)
    lower[rows, cluster[rows]] = below(own)
    at, c = np.nonzero(other[rows] & (upper[rows, None] >= lower[rows]) & (upper[rows, None] >= near[rows]))
    exact = ((points[rows[at]] - centroids[c]) ** 2).sum(axis=1)
    lower[rows[at], c] = below(exact)
    # The nearest of those computed and the own one; of equal distances the smaller number.
    best = np.full((len(rows), k), np.iinfo(np.int64).max)
    best[np.arange(len(rows)), cluster[rows]] = own
    best[at, c] = exact
    cluster[rows] = best.argmin(axis=1)
    upper[rows] = above(best.min(axis=1))
    return cluster, upper, lower, len(rows) + len(at)


def _matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)


def _lists(matrix: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1], pa.array(matrix.ravel(), kind))


_STATE = "vec_id long, v array<int>, cluster int, upper double, lower array<double>, computed long"


def _started(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The state after the first round, which computes every distance."""
    dims = centroids.shape[1]

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            exact = squared(_matrix(b["v"], np.int64, dims), centroids)
            cluster = exact.argmin(axis=1)
            upper, lower = above(exact[np.arange(len(exact)), cluster]), below(exact)
            yield _batch(b, cluster, upper, lower, np.full(len(exact), len(centroids)))

    return rows.mapInArrow(start, _STATE)


def _batch(b: pa.RecordBatch, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, computed: np.ndarray) -> pa.RecordBatch:
    columns = [b["vec_id"], b["v"], pa.array(cluster, pa.int32()), pa.array(upper), _lists(lower, pa.float64()), pa.array(computed, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["vec_id", "v", "cluster", "upper", "lower", "computed"])


def _next(state: DataFrame, centroids: np.ndarray, old: np.ndarray) -> DataFrame:
    """The state after one more round, with centroids that moved from ``old``."""
    k, dims = centroids.shape
    shift, halves = above(((centroids - old) ** 2).sum(axis=1)), np.nextafter(below(squared(centroids, centroids)) / 2, -np.inf)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points = _matrix(b["v"], np.int64, dims)
            cluster = b["cluster"].to_numpy().astype(np.int64)
            upper, lower = moved(b["upper"].to_numpy(), _matrix(b["lower"], float, k), cluster, shift)
            cluster, upper, lower, n = reassigned(points, centroids, halves, cluster, upper, lower)
            computed = b["computed"].to_numpy(zero_copy_only=False).copy()
            computed[:1] += n  # counted by batch, at its first row
            yield _batch(b, cluster, upper, lower, computed)

    return state.mapInArrow(step, _STATE)


def _updated(state: DataFrame, old: np.ndarray) -> np.ndarray:
    """floor(sum / count) of each cluster's vectors, in integers; empty clusters keep their centroid."""
    sums = [F.sum(F.col("v")[d].cast("long")).alias(f"s{d}") for d in range(old.shape[1])]
    new = old.copy()
    for row in state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *sums).collect():  # k rows at most
        new[row["cluster"]] = [row[f"s{d}"] // row["n"] for d in range(old.shape[1])]
    return new


def clustered(
    vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, scale: int = 256
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 and, by row, the distances it took (``computed``)."""
    spark = vectors.sparkSession
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, computed long"
    rows = written(integers(vectors, id_col, vector_col, dims, scale))
    centroids = first_centroids(rows, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], schema)
    path = scratch(spark)
    state = written(_started(rows, centroids), path=path)
    for _ in range(rounds):
        old, centroids = centroids, _updated(state, centroids)
        after = scratch(spark)
        state = written(_next(state, centroids, old), path=after)
        discard(spark, path)  # no later step reads the round before
        path = after
    final = spark.createDataFrame(
        [(c, [int(x) for x in v], hashlib.sha256(",".join(str(int(x)) for x in v).encode()).hexdigest()) for c, v in enumerate(centroids)],
        "cluster int, centroid array<long>, centroid_sha256 string",
    )
    exact = F.aggregate(F.zip_with("v", "centroid", lambda a, b: (a - b) * (a - b)), F.lit(0).cast("long"), lambda s, x: s + x)
    # k rows, whatever the table's size.
    out = state.join(F.broadcast(final), "cluster").select("vec_id", "cluster", exact.alias("distance"), "centroid_sha256", "computed")
    sums = {r["cluster"]: r["s"] for r in out.groupBy("cluster").agg(F.try_sum("distance").alias("s")).collect()}
    total = None if None in sums.values() or sum(sums.values()) >= 2**63 else sum(sums.values())
    totals = spark.createDataFrame([(c, s, total) for c, s in sums.items()], "cluster int, cluster_inertia long, inertia long")
    return out.join(F.broadcast(totals), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "computed")
