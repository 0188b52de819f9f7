"""Exact dedup by deterministic block naming (native: DataFrame functions only).

A text is cut into blocks of fixed size. Distinct blocks are sorted and numbered; a block's number is its name.
Then adjacent names are paired, distinct pairs are sorted and numbered in the same way, and so on until one name
is left for each document: two documents end with the same name at the same level exactly if their texts are equal.
No step trusts a hash: where two blocks share a hash, they are joined by the block itself.

Distinct blocks and pairs are pre-aggregated before each shuffle, so a text with many copies sends each of its
blocks once per task; names come back by an equi-join whose hot keys adaptive execution can split.

Defined cases: a null text equals the empty text; a null id orders before all others; of rows that repeat the
largest id of a group, one stays; an empty table gives an empty result; other columns take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, lower_ascii, written

#: Characters in a block.
BLOCK_CHARS = 256


def normalised(text: Column) -> Column:
    """What is compared: A-Z lower-cased, null as the empty text."""
    return lower_ascii(F.coalesce(text, F.lit("")))


def _blocks(text: Column, size: int) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def _named(distinct: DataFrame, *keys: str) -> DataFrame:
    """Distinct rows, sorted and numbered within their partitions; no two rows get the same number."""
    return distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def _first_names(texts: DataFrame, occurrences: DataFrame, size: int, stable: bool) -> DataFrame | None:
    """(uid, i, name) of every block. ``occurrences`` holds each block's hash, ``texts`` the blocks themselves.

    None where different blocks share a hash and another scan of ``texts`` could number the rows otherwise.
    """
    blocks = texts.select(F.explode(_blocks(F.col("norm"), size)).alias("block")).withColumn("h", F.xxhash64("block"))
    distinct = blocks.groupBy("h", "block").agg(F.lit(1).alias("one"))
    names = written(_named(distinct, "h", "block").select("h", "name"))
    shared = names.groupBy("h").count().filter("count > 1")
    if shared.isEmpty():
        return occurrences.join(names, "h").select("uid", "i", "name")
    if not stable:
        return None
    # Different blocks with one hash: the blocks themselves are the key.
    names = written(_named(distinct, "h", "block").select("h", "block", "name"))
    cut = texts.select("uid", F.posexplode(_blocks(F.col("norm"), size)).alias("i", "block")).withColumn("h", F.xxhash64("block"))
    return cut.join(names, ["h", "block"]).select("uid", "i", "name")


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = BLOCK_CHARS, uid_col: str | None = None) -> DataFrame:
    """One row per row of ``docs``: uid, doc_id, text_sha256, level, name; equal (level, name) means equal texts.

    The uid is that of ``uid_col``, where the rows of a written table bring one; else rows are numbered as they are read.
    """
    uid = F.monotonically_increasing_id() if uid_col is None else F.col(uid_col)
    keyed = docs.select(uid.alias("uid"), F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    base = written(
        keyed.select(
            "uid", "doc_id", F.sha2("norm", 256).alias("text_sha256"), F.transform(_blocks(F.col("norm"), size), lambda b: F.xxhash64(b)).alias("hashes")
        )
    )
    occurrences = base.select("uid", F.posexplode("hashes").alias("i", "h"))
    state = _first_names(keyed, occurrences, size, uid_col is not None)
    if state is None:
        numbered = written(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("uid")))
        return identities(numbered, "doc_id", "text", size, "uid")
    left = base.select(F.max(F.size("hashes"))).first()[0] or 0
    level = 0
    # Names of one level are unique in that level only, so the level is part of the identity.
    sizes = base.select("uid", F.size("hashes").alias("n"))
    ended = [base.filter(F.size("hashes") == 0).select("uid", F.lit(-1).alias("level"), F.lit(0).cast("long").alias("name"))]
    state = state.join(sizes, "uid").select("uid", "i", "name", "n")
    while True:
        state = written(state)
        ended.append(state.filter("n = 1").select("uid", F.lit(level).alias("level"), "name"))
        if left <= 1:
            break
        open_ = state.filter("n > 1")
        pairs = open_.groupBy("uid", F.floor(F.col("i") / 2).cast("int").alias("j")).agg(
            F.max(F.when(F.col("i") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("i") % 2 == 1, F.col("name"))), F.lit(-1).cast("long")).alias("b"),
            F.max(F.ceil(F.col("n") / 2)).cast("int").alias("n"),
        )
        pairs = written(pairs)
        # Written, so that the join with a very common pair meets plain shuffles, which can be split.
        names = written(_named(pairs.groupBy("a", "b").agg(F.lit(1).alias("one")), "a", "b").select("a", "b", "name"))
        state = pairs.join(names, ["a", "b"]).select("uid", F.col("j").alias("i"), "name", "n")
        left, level = (left + 1) // 2, level + 1
    found = ended[0]
    for more in ended[1:]:
        found = found.union(more)
    return base.select("uid", "doc_id", "text_sha256").join(found, "uid")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = BLOCK_CHARS, uid_col: str | None = None) -> DataFrame:
    """One row per row of ``docs``: uid, doc_id, keep_id, group_size, kept, text_sha256."""
    rows = written(identities(docs, id_col, text_col, size, uid_col))
    # Written, so that the rows of a very large group meet its one row through plain shuffles, which can be split.
    groups = written(rows.groupBy("level", "name").agg(F.max(F.struct("doc_id", "uid")).alias("keep"), F.count(F.lit(1)).alias("group_size")))
    return rows.join(groups, ["level", "name"]).select(
        "uid", "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("uid") == F.col("keep.uid")).alias("kept"), "text_sha256"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs``, all columns, without those whose text equals that of a row that stays.

    The rows are written once with their numbers: a second scan of ``docs`` may split files otherwise and number rows anew.
    """
    uid = free_name(docs, "uid")
    rows = written(docs.withColumn(uid, F.monotonically_increasing_id()))
    gone = exact_dedup(rows, id_col, text_col, size, uid).filter(~F.col("kept")).select(F.col("uid").alias(uid))
    return rows.join(gone, uid, "left_anti").select([f"`{c}`" for c in docs.columns])
