"""Generators of rows from texts and vectors: blocks, token windows, nearest prototypes, answer spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import dot
from ..functions.text import clean_ascii, near_age_word
from .relations import checkpointed


def line_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A document's non-empty cleaned lines: doc_id, block_index (that of the line), text, char_count."""
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n")).alias("block_index", "line"))
    blocks = lines.select("doc_id", "block_index", clean_ascii(F.col("line")).alias("text"))
    return blocks.filter("text <> ''").withColumn("char_count", F.char_length("text"))


def token_windows(df: DataFrame, tokens: str, size: int = 400, stride: int = 50) -> DataFrame:
    """``df`` with one row for each window of ``size`` tokens; neighbours share ``stride`` tokens, the last window ends the text."""
    n, step = F.size(tokens), size - stride
    count = F.when(n > size, F.ceil((n - size) / F.lit(step)) + 1).otherwise(1).cast("int")
    starts = F.transform(F.sequence(F.lit(0), count - 1), lambda k: k * step)
    out = df.withColumn("window_start", F.explode(starts))
    return out.withColumn("window", F.slice(F.col(tokens), F.col("window_start") + 1, F.lit(size)))


def window_span(start: Column, stop: Column, window_start: Column, window: Column) -> tuple[Column, Column]:
    """First and last token of an answer within a window; (0, 0) if it is not wholly inside."""
    inside = (start >= window_start) & (stop < window_start + F.size(window))
    return F.when(inside, start - window_start).otherwise(0), F.when(inside, stop - window_start).otherwise(0)


#: Prototypes that are packed into one row, and with it into every task.
PACKED = 1_000


def prototype_similarity(vectors: DataFrame, prototypes: DataFrame, vector: str = "embedding") -> DataFrame:
    """``vectors`` with the greatest similarity to any prototype vector; null without one.

    Prototypes are a stated query set: up to ``PACKED`` of them, counted first, go to every task as one row; more of them meet
    the vectors in blocks of that size, and the greatest of each block's similarities counts.
    """
    known = prototypes.filter(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("_p"))
    best = lambda found: F.array_max(F.transform(found, lambda p: dot(F.col(vector), p)))
    if known.limit(PACKED + 1).count() <= PACKED:
        packed = known.agg(F.collect_list("_p").alias("_prototypes"))
        return vectors.join(F.broadcast(packed)).withColumn("similarity", best("_prototypes")).drop("_prototypes")
    blocks = -(-known.count() // PACKED)
    packed = known.groupBy(F.pmod(F.xxhash64("_p"), F.lit(blocks)).cast("int").alias("_block")).agg(F.collect_list("_p").alias("_prototypes"))
    rows = checkpointed(vectors.withColumn("_row", F.monotonically_increasing_id()))
    each = rows.select("_row", vector).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition("_block", F.pmod("_row", F.lit(blocks)))
    found = each.join(checkpointed(packed), "_block").groupBy("_row").agg(F.max(best("_prototypes")).alias("similarity"))
    return rows.join(found, "_row", "left").drop("_row")


def age_spans(df: DataFrame, text: str, number: str) -> DataFrame:
    """``df`` with ``answer_start`` of the first whole-word hit of ``number`` that has an age word within 30 characters; no hit, no row."""
    word = F.concat(F.lit(r"\b"), F.col(number), F.lit(r"\b"))
    pieces = F.split(F.col(text), word, -1)
    lengths = F.transform(F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: F.char_length(p))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("hits"))
    n = F.char_length(number)
    hits = F.aggregate(
        lengths, start, lambda acc, gap: F.struct((acc["at"] + gap + n).alias("at"), F.array_append(acc["hits"], acc["at"] + gap).alias("hits")), lambda acc: acc["hits"]
    )
    found = F.get(F.filter(hits, lambda h: near_age_word(F.col(text), h, h + n)), 0)
    return df.withColumn("answer_start", found).filter("answer_start IS NOT NULL")


def fuzzy_pick(candidates: Column, selection: Column) -> Column:
    """The candidate that equals the selection in lower case, else the first that shares a word with it, else null."""
    low = F.lower(selection)
    same = F.filter(candidates, lambda c: F.lower(c) == low)
    near = F.filter(candidates, lambda c: F.arrays_overlap(F.split(F.lower(c), r"\s+"), F.split(low, r"\s+")))
    return F.coalesce(F.get(same, 0), F.get(near, 0))
