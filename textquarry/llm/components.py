"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _nearest(edges: DataFrame) -> DataFrame:
    """(u, least): the least of each node and its neighbours; written, so that the join with it meets plain shuffles, which can be split."""
    return written(edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("least")))


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node that has a link, with the smallest node it can reach.

    Each round hangs all larger neighbours of a node on its smallest one (large star), then all smaller ones
    (small star), until every node hangs on its component's smallest. Rounds grow with the logarithm of a chain's
    length; each is written, so lineage stays short. Links to itself and null ends are ignored.
    """
    first, second = F.col(a), F.col(b)
    edges = links.filter(first.isNotNull() & second.isNotNull() & (first != second))
    edges = written(edges.select(F.greatest(first, second).alias("u"), F.least(first, second).alias("v")).distinct())
    before = None
    while True:
        every = _both_ways(edges)
        stars = every.join(_nearest(every), "u").filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()
        stars = written(stars)
        # Small star: the smaller neighbours of a node, and the node itself, hang on the smallest of them.
        least = written(stars.groupBy("u").agg(F.min("v").alias("least")))
        moved = stars.join(least, "u").filter("v > least").select(F.col("v").alias("u"), F.col("least").alias("v"))
        edges = written(moved.union(least.select("u", F.col("least").alias("v"))).distinct())
        now = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now == before or not now[0]:
            break
        before = now
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
