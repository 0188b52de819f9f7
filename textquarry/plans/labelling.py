"""Annotation runs: label with two models, compare, summarise, consolidate, split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.annotations import ANNOTATORS, LABELS, TARGETS, complete, with_comparison, with_targets
from ..functions.replies import LABELLING_PRICES, count_of, label_reply, price
from ..operators.relations import check, chosen_columns, group_split, label_grid

REQUIRED = ("sample_id", "doc_id", "block_id", "section_path", "text")
PREPARED = (
    "sample_id", "doc_id", "block_id", "split", "section_path", "text", "model_input", *TARGETS.values(), "final_labels", "final_labels_json",
    "number_of_positive_labels", "is_multilabel", "is_no_useful_evidence", "resolution_method",
)
LABEL_PROMPT = "Section: {section}\n\nText:\n{text}"


def prompts(samples: DataFrame) -> DataFrame:
    section = F.coalesce("section_path", F.lit(""))
    return samples.withColumn("prompt", F.concat(F.lit("Section: "), section, F.lit("\n\nText:\n"), F.coalesce("text", F.lit(""))))


def pending(samples: DataFrame, done: DataFrame, name: str) -> DataFrame:
    """Samples without a complete result of one annotator."""
    return samples.join(done.filter(complete(done, name)).select("sample_id").distinct(), "sample_id", "left_anti")


def results(replies: DataFrame, name: str) -> DataFrame:
    """One annotator's columns from (sample_id, reply, error, input_tokens, output_tokens); tokens of bad replies count."""
    good, bad = label_reply(F.col("reply"))
    rows = replies.withColumns({"_good": F.when(F.col("error").isNull(), good), "_error": F.coalesce("error", bad, F.lit(""))})
    cost = price(F.col("input_tokens"), F.col("output_tokens"), LABELLING_PRICES[name])
    return rows.select(
        "sample_id",
        F.col("_good.label").alias(f"{name}_label"),
        F.col("_good.overall_relevance").alias(f"{name}_overall_relevance"),
        F.col("_good.reason").alias(f"{name}_reason"),
        F.col("input_tokens").alias(f"{name}_input_tokens"),
        F.col("output_tokens").alias(f"{name}_output_tokens"),
        cost.alias(f"{name}_cost_usd"),
        F.col("_error").alias(f"{name}_error"),
    )


def compared(samples: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    return with_comparison(samples.join(first, "sample_id", "left").join(second, "sample_id", "left"))


def summary(df: DataFrame, names: tuple[str, str] = ANNOTATORS) -> DataFrame:
    """Rows, agreement among rows with two valid labels, reviews, cost and tokens, one row."""
    both = F.coalesce(F.col(f"{names[0]}_label").isin(*LABELS) & F.col(f"{names[1]}_label").isin(*LABELS), F.lit(False))
    cost = [F.sum(count_of(F.col(f"{n}_cost_usd"))).alias(f"{n}_cost_usd") for n in names if f"{n}_cost_usd" in df.columns]
    agree = F.avg(F.when(both, F.col("models_agree").cast("double")))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(both).alias("both_valid"), agree.alias("agreement_rate"), F.count_if("needs_review").alias("needs_review"), *cost)


def disagreements(df: DataFrame, names: tuple[str, str] = ANNOTATORS) -> DataFrame:
    grid = label_grid(df, f"{names[0]}_label", f"{names[1]}_label", LABELS)
    return grid.orderBy(F.desc("count"), f"{names[0]}_label", f"{names[1]}_label")


def prepared(df: DataFrame, names: tuple[str, str] = ANNOTATORS, seed: int = 42) -> DataFrame:
    """Training rows with final labels, targets and a split in which no document is in two parts."""
    labels = tuple(f"{n}_label" for n in names)
    check(df, "sample_id", (*REQUIRED, *labels), ("doc_id",), dict.fromkeys(labels, LABELS))
    rows = group_split(with_targets(df, names), "doc_id", seed)
    return chosen_columns(rows, (*PREPARED, *labels), ("label", "relevance_difference", "needs_review", "models_agree"))
