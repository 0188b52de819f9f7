"""From candidates to a submission: classify blocks, route them to fields, build contexts, extract, format."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.replies import ENUMS, EXTRACTION_PRICE, REPLY_SCHEMAS, price, salvage
from ..functions.submission import id_order, submission
from ..functions.text import embedding_text, headed_context, routed_piece
from ..operators.selection import CONTEXT_CHARS, FALLBACK_BLOCKS, THRESHOLDS, by_field, route, truncated_concat
from .models import Classifier, Extractor, KeywordClassifier, SilentExtractor, classify, extract


def probabilities(blocks: DataFrame, classifier: Classifier | None = None) -> DataFrame:
    """One row a block and field: doc_id, block_id, block_index, field, p. Texts stay with their blocks."""
    text = embedding_text(F.col("section_path"), F.col("block_type"), F.col("text"))
    found = classify(blocks.withColumn("_input", text), "_input", "probabilities", classifier or KeywordClassifier())
    return found.select("doc_id", "block_id", "block_index", F.explode("probabilities").alias("field", "p")).filter(F.col("field").isin(*THRESHOLDS))


def routed(rows: DataFrame) -> DataFrame:
    """The rows that reach their field's threshold, or fill it up to its fewest blocks."""
    return route(rows, ["doc_id", "field"], "p", "block_index", by_field(THRESHOLDS, F.col("field")), by_field(FALLBACK_BLOCKS, F.col("field")))


def block_counts(rows: DataFrame) -> DataFrame:
    """Blocks of each field, a column a field."""
    return rows.groupBy("doc_id").pivot("field", list(THRESHOLDS)).count().fillna(0)


def with_texts(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Routed rows with their blocks' section_path and text: joined after the ranking, which shuffles no text."""
    return rows.join(blocks.select("doc_id", "block_id", "section_path", "text"), ["doc_id", "block_id"])


def contexts(rows: DataFrame, docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, field, context): a field's blocks in page order up to its cap; one row for every document and field."""
    rows = with_texts(rows, blocks)
    piece = routed_piece(F.col("block_index"), F.col("section_path"), F.col("text"))
    lists = rows.groupBy("doc_id", "field").agg(F.array_sort(F.collect_list(F.struct("block_index", piece.alias("piece")))).alias("_l"))
    bodies = lists.select("doc_id", "field", truncated_concat(F.transform("_l", lambda x: x["piece"]), by_field(CONTEXT_CHARS, F.col("field"))).alias("body"))
    every = docs.withColumn("field", F.explode(F.array(*[F.lit(f) for f in THRESHOLDS])))
    joined = every.join(bodies, ["doc_id", "field"], "left")
    headed = headed_context(F.col("title"), F.col("abstract"), F.col("keywords"), F.col("body"), "Classifier-routed current-study evidence", "Not provided", "No body evidence was routed.")
    return joined.select("doc_id", "field", F.when(F.col("field") == "condition_study_type", headed).otherwise(F.coalesce("body", F.lit(""))).alias("context"))


#: What each field's prompt asks for, above the evidence.
ASKED = {
    "condition_study_type": "Name the conditions studied and say whether the study is INTERVENTIONAL or OBSERVATIONAL.",
    "demographics": "Give the sex of the participants (MALE, FEMALE or ALL) and their minimum and maximum age.",
    "eligibility": "List the inclusion criteria and the exclusion criteria of the participants.",
}


def prompts(contexts_: DataFrame) -> DataFrame:
    """(doc_id, field, context) with ``prompt``: what is asked, then the evidence."""
    asked = by_field(ASKED, F.col("field"))
    return contexts_.withColumn("prompt", F.concat(asked, F.lit("\n\nEvidence follows:\n\n"), F.coalesce("context", F.lit(""))))


def predictions(contexts_: DataFrame, extractor: Extractor | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id with cond, demo, elig), and the failed calls as dead letters. A reply outside its enumeration counts as failed."""
    calls = extract(contexts_, "field", "context", extractor or SilentExtractor())
    names = {"condition_study_type": "cond", "demographics": "demo", "eligibility": "elig"}
    parsed = {names[f]: F.when(F.col("field") == f, salvage(F.col("reply"), schema)) for f, schema in REPLY_SCHEMAS.items()}
    rows = calls.select("doc_id", "field", "error", *[c.alias(n) for n, c in parsed.items()])
    valid = F.coalesce(F.col("cond.study_type").isin(*ENUMS["study_type"]), F.lit(False)) | F.coalesce(F.col("demo.sex").isin(*ENUMS["sex"]), F.lit(False)) | F.col("elig").isNotNull()
    dead = rows.filter(~valid).select(F.col("doc_id").cast("string").alias("candidate_file"), F.col("field").alias("stage"), F.coalesce(F.substring_index("error", ":", 1), F.lit("InvalidReply")).alias("error_type"), "error")
    good = rows.filter(valid).groupBy("doc_id").agg(*[F.first(n, ignorenulls=True).alias(n) for n in names.values()])
    return good, dead


def submit(results: DataFrame) -> DataFrame:
    """The submission, numeric ids first."""
    return submission(results).orderBy(*id_order(F.col("pmcids")))


def with_cost(usage: DataFrame) -> DataFrame:
    return usage.withColumn("estimated_cost_usd", price(F.col("input_tokens"), F.col("output_tokens"), EXTRACTION_PRICE))


def serialised(rows: DataFrame) -> DataFrame:
    """(doc_id, field, blocks): the routed blocks of each field, which have their section_path, in page order, without their texts."""
    item = F.struct("block_index", "block_id", "section_path", "p")
    return rows.groupBy("doc_id", "field").agg(F.array_sort(F.collect_list(item)).alias("blocks"))
