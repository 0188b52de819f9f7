"""Submissions from one prompt a document: rank sections, fill the budget, prompt, salvage the reply, resume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.replies import flat_answer, listed_answer, salvage
from ..functions.text import NOT_SPECIFIED, cap, clean
from ..operators.relations import remaining, resumed
from ..operators.selection import SECTION_BUDGET, SECTION_CHARS, SECTION_THRESHOLD, prefix_to_overflow
from .models import Extractor, extract

FIELDS = ("conditions", "study_type", "sex", "minimum_age", "maximum_age", "eligibility_criteria")
REPLY = ", ".join(f"{f} string" for f in FIELDS)


def section_chunk(title: Column, text: Column) -> Column:
    """A section in a prompt: its title on a line of its own, if it has one, and the start of its text."""
    head = F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit("\n"), title, F.lit("\n"))).otherwise(F.lit(""))
    return F.concat(head, cap(F.coalesce(text, F.lit("")), SECTION_CHARS), F.lit("\n"))


def bodies(scored: DataFrame, threshold: float = SECTION_THRESHOLD, budget: int = SECTION_BUDGET) -> DataFrame:
    """(doc_id, body): sections (section_index, title, text, score) at or above the threshold, best first, up to the budget."""
    rows = scored.filter(F.col("score") >= threshold).withColumn("chunk", section_chunk(F.col("title"), F.col("text")))
    rows = rows.withColumn("chunk_chars", F.char_length("chunk"))
    kept = prefix_to_overflow(rows, ["doc_id"], "score", "section_index", "chunk_chars", budget)
    item = F.struct((-F.col("score")).alias("key"), "section_index", "chunk")
    return kept.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["chunk"]), "").alias("body"))


def prompts(docs: DataFrame, bodies_: DataFrame) -> DataFrame:
    """``docs`` with ``prompt``: title, abstract and body, empty where a document has none."""
    joined = docs.join(bodies_, "doc_id", "left")
    part = lambda name, value: F.concat(F.lit(f"{name}: "), clean(value), F.lit("\n"))
    text = F.concat(part("Title", F.col("title")), part("Abstract", F.col("abstract")), F.lit("Sections:"), F.coalesce("body", F.lit("")))
    return joined.withColumn("prompt", F.concat(text, F.lit(f"\nAnswer as one JSON object with {', '.join(FIELDS)}; write {NOT_SPECIFIED} for what the text does not say.")))


def submit(prompted: DataFrame, extractor: Extractor, thinking: bool = False) -> DataFrame:
    """One row a document: doc_id, the six fields (``NOT_SPECIFIED`` where the reply has none) and ``error``."""
    calls = extract(prompted.withColumn("_field", F.lit("all")), "_field", "prompt", extractor, attempts=1)
    found = salvage(F.col("reply"), REPLY, thinking)
    rows = calls.withColumn("_r", found)
    error = F.coalesce("error", F.when(F.col("_r").isNull(), "no JSON object in the reply"))
    value = {f: F.coalesce(F.nullif(clean(F.col(f"_r.{f}")), F.lit("")), F.lit(NOT_SPECIFIED)) for f in FIELDS}
    value["conditions"] = F.coalesce(F.nullif(flat_answer(listed_answer(F.col("_r.conditions"))), F.lit("")), F.lit(NOT_SPECIFIED))
    return rows.select("doc_id", *[value[f].alias(f) for f in FIELDS], error.alias("error"))


def run(prompted: DataFrame, extractor: Extractor, done: DataFrame | None = None, thinking: bool = False) -> DataFrame:
    """``submit`` for the documents that are not done, together with those that are."""
    if done is None:
        return submit(prompted, extractor, thinking)
    return resumed(done, submit(remaining(prompted, done, "doc_id"), extractor, thinking))
