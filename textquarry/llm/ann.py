"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut into two halves and each half is quantised by its own codebook, so that K centroids a half make K * K
cells. Every vector is filed under its cell. A query ranks the centroids of each half by distance and walks the
grid of centroid pairs in order of summed distance with a heap, until the cells it has met hold enough entries; those
cells' entries are reranked by exact distance in double precision.

The codebooks are fitted on at most ``SAMPLE_ROWS`` vectors, the smallest by hash; every vector is indexed. Cells are
dealt in blocks of bounded size and meet their queries in blocks of bounded size, so that a cell with a third of all
vectors is worked on by many tasks; each pair of blocks returns its best k for each query, which are then merged.

Defined cases: vectors that are null, empty, all zero, or hold null or non-finite components take no part; so do
vectors whose length is not the most common one (the greater where two are as common); equal vectors are each
other's neighbours at distance 0; ties go to the smaller id; null ids take no part; rows that repeat an id are
candidates of one id and count once, by their nearest vector; with fewer candidates than k, all are returned; an
empty table gives an empty result; further columns take no part.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Bound of the codebooks' training sample, in vectors.
SAMPLE_ROWS = 20_000
#: Centroids for each half.
CENTROIDS = 16
#: A query's walk ends when its cells hold this share of all vectors, and at least MIN_CANDIDATES of them.
SHARE = 0.6
MIN_CANDIDATES = 1_000
#: Vectors and queries in a block.
BLOCK, QUERY_BLOCK = 2048, 256


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id IS NOT NULL")
    kept = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.filter(F.coalesce(kept, F.lit(False)))


def _kmeans(points: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Centroids by Lloyd's rounds from a farthest-first start; deterministic for the same points in the same order."""
    k = min(k, len(np.unique(points, axis=0)))
    centres = points[:1]
    gap = ((points - centres[0]) ** 2).sum(axis=1)
    while len(centres) < k:
        centres = np.vstack((centres, points[int(gap.argmax())]))
        gap = np.minimum(gap, ((points - centres[-1]) ** 2).sum(axis=1))
    for _ in range(rounds):
        near = _nearest(points, centres)
        for c in range(len(centres)):
            if (near == c).any():
                centres[c] = points[near == c].mean(axis=0)
    return centres


def _distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((points**2).sum(axis=1)[:, None] - 2 * points @ centres.T + (centres**2).sum(axis=1)[None, :], 0)


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return _distances(points, centres).argmin(axis=1)


def walk(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, enough: int) -> list[int]:
    """Cells in order of first[i] + second[j], by a heap over the sorted halves, until they hold ``enough`` entries."""
    one, two = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, met, cells, held = [(first[one[0]] + second[two[0]], 0, 0)], {(0, 0)}, [], 0
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        cell = int(one[i]) * len(second) + int(two[j])
        if sizes[cell]:
            cells.append(cell)
            held += int(sizes[cell])
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(one) and b < len(two) and (a, b) not in met:
                met.add((a, b))
                heapq.heappush(heap, (first[one[a]] + second[two[b]], a, b))
    return cells


def codebooks(rows: DataFrame, centroids: int = CENTROIDS, sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray] | None:
    """The centroids of both halves, or None without vectors."""
    sample = rows.select("vec_id", "v").orderBy(F.xxhash64("vec_id", F.lit(5)), "vec_id").limit(sample_rows).collect()
    if not sample:
        return None
    points = np.array([r["v"] for r in sorted(sample, key=lambda r: r["vec_id"])], float)
    half = points.shape[1] // 2
    return _kmeans(points[:, :half].copy(), centroids), _kmeans(points[:, half:].copy(), centroids)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), float)


def search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    centroids: int = CENTROIDS,
    share: float = SHARE,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """Each query's k nearest of ``vectors``, itself left out: query_id, rank, vec_id, score (Euclidean distance)."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows, asked = usable(vectors, id_col, vector_col), usable(queries, id_col, vector_col)
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if common is None:
        return spark.createDataFrame([], schema)
    rows, asked = rows.filter(F.size("v") == common["n"]), asked.filter(F.size("v") == common["n"])
    books = spark.sparkContext.broadcast(codebooks(rows, centroids, sample_rows))

    def file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, second = books.value
        for batch in batches:
            if len(batch):
                m = _matrix(batch["v"])
                half = m.shape[1] // 2
                yield batch.assign(cell=_nearest(m[:, :half], first) * len(second) + _nearest(m[:, half:], second))

    filed = written(rows.mapInPandas(file, "vec_id long, v array<double>, cell long"))
    # One count for each of at most centroids * centroids cells.
    counted = {r["cell"]: r["count"] for r in filed.groupBy("cell").count().collect()}
    sizes = np.zeros(len(books.value[0]) * len(books.value[1]), np.int64)
    for cell, n in counted.items():
        sizes[cell] = n
    enough = max(int(share * sizes.sum()), MIN_CANDIDATES, 4 * k)

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, second = books.value
        for batch in batches:
            if not len(batch):
                continue
            m = _matrix(batch["v"])
            half = m.shape[1] // 2
            d1, d2 = _distances(m[:, :half], first), _distances(m[:, half:], second)
            cells = [walk(a, b, sizes, enough) for a, b in zip(d1, d2, strict=True)]
            at = np.repeat(np.arange(len(batch)), [len(c) for c in cells])
            yield pd.DataFrame({"query_id": batch["vec_id"].to_numpy()[at], "q": batch["v"].to_numpy()[at], "cell": np.concatenate([np.array(c, np.int64) for c in cells])})

    probes = written(asked.mapInPandas(plan, "query_id long, q array<double>, cell long"))
    asked_of = {r["cell"]: r["count"] for r in probes.groupBy("cell").count().collect()}
    dealt = spark.createDataFrame(
        [(c, -(-n // BLOCK), -(-asked_of[c] // QUERY_BLOCK)) for c, n in counted.items() if c in asked_of] or [(-1, 1, 1)], "cell long, parts int, turns int"
    )
    dealt = F.broadcast(dealt)  # at most one row for each cell
    parts, turns = F.sequence(F.lit(0), F.col("parts") - 1), F.sequence(F.lit(0), F.col("turns") - 1)
    entries = filed.join(dealt, "cell").select("cell", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"), F.explode(turns).alias("turn"), "vec_id", "v")
    wanted = probes.join(dealt, "cell").select("cell", F.explode(parts).alias("part"), F.pmod(F.xxhash64("query_id"), F.col("turns")).cast("int").alias("turn"), "query_id", "q")

    def rerank(entries: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if not len(entries) or not len(wanted):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        m, ids = _matrix(entries["v"]), entries["vec_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        m, ids, out = m[order], ids[order], []
        for query, q in zip(wanted["query_id"], wanted["q"], strict=True):
            score = np.sqrt(((m - np.asarray(q, float)) ** 2).sum(axis=1))
            score[ids == query] = np.inf
            # Rows that repeat an id stand side by side; the k nearest ids are among this many rows at most.
            best = np.argsort(score, kind="stable")
            seen: dict[int, float] = {}
            for i in best:
                if len(seen) == k or score[i] == np.inf:
                    break
                seen.setdefault(int(ids[i]), float(score[i]))
            out += [(query, i, s) for i, s in seen.items()]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    keys = ["cell", "part", "turn"]
    found = entries.groupBy(*keys).cogroup(wanted.groupBy(*keys)).applyInPandas(rerank, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
