"""Evidence retrieval: encode blocks, score them against queries, select by field or in one unified list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import RAISED, context_piece, embedding_text, headed_context, normal_path, prior
from ..operators.generators import prototype_similarity
from ..operators.selection import CHAR_FRACTION, MAX_CHARS, MIN_BLOCKS, MIN_CHARS, SCORE_TARGET, TOP_K, by_field, pack, prefix_to_budget, top_k
from .models import Encoder, HashingEncoder, encode

# The queries of the unified selection.
UNIFIED_QUERIES = (
    "Current study cohort, study population, participants, patients, enrollment, recruitment, eligibility criteria, inclusion criteria, exclusion criteria.",
    "Current study design, medical condition, disease, diagnosis, participant demographics, age eligibility, sex eligibility.",
)


def encoded_blocks(blocks: DataFrame, encoder: Encoder | None = None) -> DataFrame:
    """Blocks with the normalised vector of their path, type and text."""
    text = embedding_text(F.col("section_path"), F.col("block_type"), F.col("text"))
    return encode(blocks.withColumn("_input", text), "_input", "embedding", encoder or HashingEncoder()).drop("_input")


def queries_frame(spark: SparkSession, queries: tuple[str, ...], encoder: Encoder | None = None) -> DataFrame:
    """The queries' vectors, encoded once."""
    rows = spark.createDataFrame([(k, q) for k, q in enumerate(queries)], "query_index int, query string")
    return encode(rows, "query", "embedding", encoder or HashingEncoder())


def unified(blocks: DataFrame, score: str = "similarity", fraction: float = CHAR_FRACTION, min_blocks: int = MIN_BLOCKS) -> DataFrame:
    """The best blocks of each document (doc_id, block_index, char_count and a score) up to the budget."""
    return prefix_to_budget(blocks, ["doc_id"], score, "block_index", "char_count", fraction, min_blocks)


def unified_stats(blocks: DataFrame, score: str = "similarity", fraction: float = CHAR_FRACTION, min_blocks: int = MIN_BLOCKS) -> DataFrame:
    """One row a document: blocks, candidates, characters, target, fraction, top and lowest score.

    One exchange by document serves the ranking, the running budget and the totals.
    """
    narrow = blocks.select("doc_id", "block_index", "char_count", score)
    rows = prefix_to_budget(narrow, ["doc_id"], score, "block_index", "char_count", fraction, min_blocks, kept="_kept")
    taken = lambda c: F.when(F.col("_kept"), F.col(c))
    out = rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("num_blocks"), F.sum("char_count").alias("total_chars"), F.count_if("_kept").alias("num_candidates"),
        F.sum(taken("char_count")).alias("selected_chars"), F.max(taken(score)).alias("top_score"), F.min(taken(score)).alias("lowest_selected_score"),
    )
    out = out.fillna(0, ["num_candidates", "selected_chars", "top_score", "lowest_selected_score"])
    share = F.when(F.col("total_chars") > 0, F.col("selected_chars") / F.col("total_chars")).otherwise(0.0)
    return out.withColumns({"target_chars": F.ceil(F.lit(fraction) * F.col("total_chars")).cast("long"), "selected_char_fraction": share})


def run_stats(stats: DataFrame) -> DataFrame:
    """Mean, median and extremes over documents, one row."""
    out = []
    for column in ("num_blocks", "num_candidates", "selected_char_fraction"):
        out += [F.avg(column).alias(f"mean_{column}"), F.median(column).alias(f"median_{column}"), F.min(column).alias(f"least_{column}"), F.max(column).alias(f"most_{column}")]
    short = F.count_if(F.col("selected_chars") < F.col("target_chars")).alias("below_target")
    return stats.agg(F.count(F.lit(1)).alias("documents"), *out, short)


def unified_documents(docs: DataFrame, chosen: DataFrame, stats: DataFrame) -> DataFrame:
    """Documents with their candidates in page order as an array, and a warning where none was found."""
    rows = chosen.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("block_index", "block_id", "similarity", "section_path", "block_type", "text", "char_count"))).alias("candidates"))
    warning = F.when(F.col("candidates").isNull(), "no blocks with text")
    return docs.join(stats, "doc_id", "left").join(rows, "doc_id", "left").withColumn("warning", warning)


def field_candidates(scored: DataFrame) -> DataFrame:
    """Each field's best blocks of rows with ``field`` and ``similarity``: similarity times the section's factor, ranked after that."""
    path = normal_path(F.col("section_path"))
    factor = F.lit(None).cast("double")
    for field in RAISED:
        factor = F.when(F.col("field") == field, prior(path, field)).otherwise(factor)
    rows = scored.withColumn("metadata_multiplier", factor).withColumn("final_score", F.col("similarity") * F.col("metadata_multiplier"))
    # The greatest of the fields' numbers prunes before the shuffle, each field's own after it.
    return top_k(rows, ["doc_id", "field"], "final_score", "block_index", max(TOP_K.values())).filter(F.col("rank") <= by_field(TOP_K, F.col("field")))


def field_similarities(blocks: DataFrame, prototypes: dict[str, DataFrame]) -> DataFrame:
    """``blocks``, a row for each field, with the greatest similarity to the field's prototypes; one scan scores all fields."""
    scored, names = blocks, {}
    for k, field in enumerate(prototypes):
        names[field] = f"_similarity_{k}"
        scored = prototype_similarity(scored, prototypes[field]).withColumnRenamed("similarity", names[field])
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(c).alias("similarity")) for f, c in names.items()])
    return scored.withColumn("_f", F.explode(each)).select(*blocks.columns, "_f.field", "_f.similarity")


def field_contexts(blocks: DataFrame, docs: DataFrame, prototypes: dict[str, DataFrame]) -> DataFrame:
    """(doc_id, field, taken, context): candidates by field, packed greedily, joined in the order they were taken."""
    found = field_candidates(field_similarities(blocks, {f: prototypes[f] for f in RAISED}))
    piece = context_piece(F.col("section_path"), F.col("text"))
    found = found.withColumns({"piece": piece, "piece_chars": F.char_length(piece)})
    packs = pack(found.withColumn("_f", F.col("field")), ["doc_id", "field"], "final_score", "block_index", "block_id", "piece_chars",
                 by_field(SCORE_TARGET, F.col("field")), by_field(MIN_CHARS, F.col("field")), by_field(MAX_CHARS, F.col("field")))
    taken = packs.select("doc_id", "field", F.posexplode("taken").alias("order", "t")).select("doc_id", "field", "order", F.col("t.id").alias("block_id"))
    rows = taken.join(found.select("doc_id", "field", "block_id", "piece"), ["doc_id", "field", "block_id"])
    bodies = rows.groupBy("doc_id", "field").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order", "piece"))), lambda x: x["piece"]), "\n\n").alias("body"))
    joined = packs.join(bodies, ["doc_id", "field"], "left").join(docs, "doc_id", "left")
    headed = headed_context(F.col("title"), F.col("abstract"), F.col("keywords"), F.col("body"), "Retrieved body evidence")
    context = F.when(F.col("field") == "condition_study_type", headed).otherwise(F.coalesce("body", F.lit("")))
    return joined.select("doc_id", "field", "taken", context.alias("context"))


def inspect(documents: DataFrame, number: str, n: int = 20) -> DataFrame:
    """The first candidates of one document, found by its number with or without PMC in front."""
    wanted = documents.filter(F.col("doc_id").isin(number, f"PMC{number}"))
    first = Window.orderBy(F.col("doc_id") != number)
    return wanted.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("doc_id", F.inline(F.slice("candidates", 1, n)))
