"""Mixing sources to target weights (native: DataFrame functions only).

Words are summed per source, the sources' targets follow by water-filling, and every document is emitted
floor(rate) times plus once more with the probability of the fraction, by a coin that hashes seed and id.

Defined cases: a null text has size 0; a null source is a source of its own, ordered last; a null id takes its
coin from the text; rows that repeat an id share its coin; a source without words has target 0 and rate 0;
an empty table gives an empty result. Other columns pass through ``emit`` unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, free_name, written

#: The weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: A source gives at most this many times its words.
MAX_RATE = 3
SEED = "mix-1"
#: Above this many sources the table of rates is joined by shuffle instead of broadcast.
BROADCAST_SOURCES = 50_000


def word_count(text: Column) -> Column:
    """Number of words as LONG, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def coin(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from 52 bits of md5; the same for the same key and seed, on any cluster."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 13), 16, 10)
    return bits.cast("double") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_rate: int = MAX_RATE) -> DataFrame:
    """(source, size) rows to one row per source: source, source_size, target.

    All words are shared by weight; no target exceeds ``max_rate`` times its source, the excess is reshared by
    weight until none is above. With the sources in order of cap / weight that fixed point has a closed form:
    the level at the first source whose share of what is left stays within its cap.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weighed = per_source.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), turn.cast("int") + 1))
    weighed = weighed.withColumn("cap", F.col("source_size") * F.lit(max_rate))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    levels = weighed.withColumn("level", left.cast("double") / F.sum("weight").over(after))
    holds = F.col("level") * F.col("weight") <= F.col("cap")
    # The level only falls along this order once it holds, so the first that holds is the largest that does.
    levels = levels.withColumn("level", F.max(F.when(holds, F.col("level"))).over(every))
    target = F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))
    return levels.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    max_rate: int = MAX_RATE,
    seed: str = SEED,
) -> DataFrame:
    """One narrow row per document: doc_id, size, source_size, target, copies, taken (= size * copies)."""
    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    sizes = written(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), coin(key, seed).alias("coin")
        )
    )
    return _with_copies(sizes, source_targets(sizes, weights, max_rate), "source")


def _with_copies(rows: DataFrame, targets: DataFrame, source_col: str) -> DataFrame:
    targets = written(targets)
    side = targets.withColumnRenamed("source", "_of_source")
    # One row per source; its size is checked before it is broadcast.
    side = F.broadcast(side) if targets.count() <= BROADCAST_SOURCES else side
    joined = rows.join(side, rows[source_col].eqNullSafe(side["_of_source"]), "left").drop("_of_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    more = (F.col("coin") < rate - F.floor(rate)).cast("long")
    joined = joined.withColumn("copies", F.floor(rate).cast("long") + more)
    return joined.withColumn("taken", F.col("size") * F.col("copies"))


def emit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mixture itself: every row of ``docs``, all columns, as often as the mix takes it."""
    weights, max_rate, seed = how.get("weights", WEIGHTS), how.get("max_rate", MAX_RATE), how.get("seed", SEED)
    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    sizes = docs.select(F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    whole = free_name(docs, "whole_row")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(whole), F.col(source_col).alias("source"), F.lit(0).cast("long").alias("size"), coin(key, seed).alias("coin")
    )
    taken = _with_copies(rows, source_targets(sizes, weights, max_rate), "source").filter("copies > 0")
    return taken.select(whole, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(f"{whole}.*")
