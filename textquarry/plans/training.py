"""Preparing all trainings from one pass over articles and answers: six tables with one split that no document crosses.

Articles, answers, candidate texts and the split are joined once, into a checkpointed table; the six tables are selections
of it. A table with fewer rows than its training needs is left out, and says so.

Defined cases: an article without an answer to a field gives that table no row; missing answers in any spelling count as
none; repeated documents give a row each; a null document takes no part.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.replies import listed_answer
from ..functions.text import missing
from ..operators.generators import age_spans
from ..operators.relations import checkpointed, group_split

#: Rows that a training needs at least, and what ages are asked by.
LEAST = {"ranker": 1, "generator": 5, "study_type": 10, "sex": 10, "conditions": 5, "ages": 10}
QUESTIONS = {"minimum": "What is the minimum age?", "maximum": "What is the maximum age?"}
#: Characters of the abstract that the selector reads, and what stands around what it reads.
SELECTOR_CHARS = 400
SELECTOR_INPUT = ("Abstract: ", "\n\nCandidates: ", "\n\nSelect the primary medical conditions being studied:")


class Prepared(NamedTuple):
    """``tables`` by training, each with doc_id and split; ``counts`` of all six, those that were too few among them."""

    tables: dict[str, DataFrame]
    counts: dict[str, int]


def joined(docs: DataFrame, gold: DataFrame, candidates: DataFrame, seed: int = 42) -> DataFrame:
    """One row for each article with answers: its texts, ``candidate_text`` (the abstract without candidates), answers, split.

    ``docs`` has doc_id, title, abstract; ``candidates`` doc_id, candidate_text; ``gold`` doc_id and the answers.
    """
    split = group_split(gold.filter("doc_id IS NOT NULL"), "doc_id", seed)
    rows = docs.select("doc_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("abstract", F.lit("")).alias("abstract")).join(split, "doc_id")
    rows = rows.join(candidates.select("doc_id", "candidate_text"), "doc_id", "left")
    text = F.coalesce(F.nullif(F.trim("candidate_text"), F.lit("")), F.col("abstract"))
    return checkpointed(rows.withColumn("candidate_text", text))


def selector_input(abstract: Column, candidates: Column) -> Column:
    """What a selector of conditions reads: the abstract's opening, the candidates, and what to do."""
    head, middle, end = SELECTOR_INPUT
    return F.concat(F.lit(head), F.left(abstract, F.lit(SELECTOR_CHARS)), F.lit(middle), F.array_join(candidates, ", "), F.lit(end))


def tables(rows: DataFrame, entities: DataFrame, ranker: DataFrame | None = None) -> dict[str, DataFrame]:
    """The six tables of ``joined`` rows; ``entities`` has doc_id, candidates (names), ``ranker`` doc_id, positive, negatives."""
    told = lambda field: ~missing(F.col(field))
    said = lambda field: F.upper(F.trim(field))
    names = rows.filter(told("conditions")).join(entities.select("doc_id", "candidates"), "doc_id").withColumn("answers", listed_answer(F.col("conditions")))
    names = names.filter((F.size("candidates") > 0) & (F.size("answers") > 0))
    both = rows.select(
        "doc_id", "split", F.col("candidate_text").alias("context"),
        F.explode(F.array(*[F.struct(F.lit(b).alias("bound"), F.lit(q).alias("question"), F.col(f"{b}_age").alias("gold")) for b, q in QUESTIONS.items()])).alias("x"),
    ).select("doc_id", "split", "context", "x.*")
    both = both.filter(told("gold") & (F.trim("context") != "")).withColumns({"number": F.regexp_extract("gold", r"(\d+)", 1), "_low": F.lower("context")}).filter("number <> ''")
    spans = age_spans(both, "_low", "number")
    out = {
        "generator": rows.filter(told("eligibility_criteria") & (F.trim("candidate_text") != "")).select("doc_id", "split", F.col("candidate_text").alias("input"), F.col("eligibility_criteria").alias("target")),
        "study_type": rows.filter(told("study_type")).select("doc_id", "split", F.concat("title", F.lit(" "), "abstract").alias("text"), said("study_type").alias("label")),
        "sex": rows.filter(told("sex")).select("doc_id", "split", F.col("candidate_text").alias("text"), said("sex").alias("label")),
        "conditions": names.select("doc_id", "split", selector_input(F.col("abstract"), F.col("candidates")).alias("input"), F.array_join("answers", ", ").alias("target")),
        "ages": spans.select("doc_id", "split", "question", "context", F.substring(F.col("context"), F.col("answer_start") + 1, F.char_length("number")).alias("answer_text"), F.col("answer_start").alias("start_pos")),
    }
    if ranker is not None:
        out = {"ranker": ranker.join(rows.select("doc_id", "split").distinct(), "doc_id").filter(F.size("negatives") > 0).select("doc_id", "split", "query", "positive", "negatives")} | out
    return out


def prepared(docs: DataFrame, gold: DataFrame, candidates: DataFrame, entities: DataFrame, ranker: DataFrame | None = None, seed: int = 42) -> Prepared:
    """All tables that have rows enough, and the rows of every one; counted in one job."""
    every = tables(joined(docs, gold, candidates, seed), entities, ranker)
    counted = None
    for name, table in every.items():
        n = table.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        counted = n if counted is None else counted.union(n)
    counts = {r["name"]: r["n"] for r in counted.collect()}
    return Prepared({k: v for k, v in every.items() if counts[k] >= LEAST[k]}, counts)
