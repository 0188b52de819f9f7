"""From documents to encoded training data; each stage calls one operator of the llm subpackage.

Defined cases, for every stage: an empty table gives an empty one; further columns pass through, whatever their names, and
those that a stage works with get other names; texts of any length are read whole; null texts count as empty. Rows that
repeat an id are rows of their own, but in near dedup, where they are one document, and in mixing, where they share a coin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm import exact_dedup, mixing, near_dedup, quality, queries
from textquarry.llm.common import free_name, table, written


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at least 0.5; it is fitted on the labelled rows of ``docs``.

    An empty or null text has the score of the bias; without labelled rows of both kinds all scores are equal.
    """
    score = free_name(docs, "score")
    scored = quality.with_scores(docs, table(spark, sf_dir, "labels"), score)
    return scored.filter(F.col(score) >= 0.5).drop(score)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest id; one row of several with that id. Empty and null texts are one group."""
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more. Texts without words are near nothing and stay."""
    return near_dedup.keep_one(docs, words=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it; a null source is a source, the last one. Sources without words take no row."""
    return mixing.emit(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's piece ids, checked by decoding them; an empty or null text has none. The last stage: doc_id, n_ids, ids, round_trip."""
    return queries.encoded(spark, docs)


STAGES = [("quality", quality_filter), ("exact dedup", exact), ("near dedup", near), ("mixing", mixed), ("encoding", encoded)]

#: The classifier and the codec have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each one's rows are written before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = written(docs) if k < len(STAGES) - 1 else docs
    return docs
