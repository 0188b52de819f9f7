"""Two annotators' labels: comparison, consolidation, targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import strip, training_text

# The labels in canonical order, the target columns, the annotators' names in column names.
NO_EVIDENCE = "No Useful Evidence"
TARGETS = {
    "Condition & Study Type": "target_condition_study_type",
    "Demographics": "target_demographics",
    "Eligibility Criteria": "target_eligibility_criteria",
}
POSITIVE = tuple(TARGETS)
LABELS = (*POSITIVE, NO_EVIDENCE)
ANNOTATORS = ("haiku", "gemini")


def resolve(a: Column, b: Column, names: tuple[str, str] = ANNOTATORS) -> tuple[Column, Column]:
    """The union of two labels in canonical order, and how it came about."""
    a, b = strip(a), strip(b)
    none = F.array().cast("array<string>")
    a_none, b_none = a == NO_EVIDENCE, b == NO_EVIDENCE
    both = F.filter(F.array(*[F.lit(x) for x in POSITIVE]), lambda x: (x == a) | (x == b))
    labels = F.when(a_none & b_none, none).when(b_none, F.array(a)).when(a_none, F.array(b)).when(a == b, F.array(a)).otherwise(both)
    how = (
        F.when(a_none & b_none, "both_no_useful_evidence")
        .when(b_none, f"kept_{names[0]}_useful_label")
        .when(a_none, f"kept_{names[1]}_useful_label")
        .when(a == b, "agreed_useful_label")
        .otherwise("combined_two_useful_labels")
    )
    return labels, how


def with_targets(df: DataFrame, names: tuple[str, str] = ANNOTATORS) -> DataFrame:
    """``df`` with final labels, their counts and flags, one 0/1 target a label, and the model's input text."""
    labels, how = resolve(F.col(f"{names[0]}_label"), F.col(f"{names[1]}_label"), names)
    out = df.withColumn("_labels", labels).withColumn("resolution_method", how)
    count = F.size("_labels")
    quoted = F.concat(F.lit('["'), F.array_join("_labels", '", "'), F.lit('"]'))
    out = out.withColumns(
        {
            "final_labels": F.when(count > 0, F.array_join("_labels", " | ")).otherwise(NO_EVIDENCE),
            "final_labels_json": F.when(count > 0, quoted).otherwise("[]"),
            "number_of_positive_labels": count,
            "is_multilabel": (count > 1).cast("int"),
            "is_no_useful_evidence": (count == 0).cast("int"),
            **{column: F.array_contains("_labels", label).cast("int") for label, column in TARGETS.items()},
        }
    )
    if {"section_path", "text"} <= set(df.columns):
        out = out.withColumn("model_input", training_text(F.col("section_path"), F.col("text")))
    return out.drop("_labels")


def with_comparison(df: DataFrame, names: tuple[str, str] = ANNOTATORS) -> DataFrame:
    """``df`` with agreement, disagreement, difference in relevance and whether a row needs review."""
    a, b = names
    valid = lambda n: F.coalesce(F.col(f"{n}_label").isin(*LABELS), F.lit(False))
    same = F.coalesce(F.col(f"{a}_label") == F.col(f"{b}_label"), F.lit(False))
    relevance = lambda n: F.col(f"{n}_overall_relevance").try_cast("double")
    failed = lambda n: F.length(F.coalesce(F.col(f"{n}_error"), F.lit(""))) > 0
    gap = F.abs(relevance(a) - relevance(b))
    out = df.withColumns({"models_agree": valid(a) & valid(b) & same, "label_disagreement": valid(a) & valid(b) & ~same, "relevance_difference": gap})
    out = out.withColumn("needs_review", F.col("label_disagreement") | F.coalesce(F.col("relevance_difference") >= 2, F.lit(False)) | failed(a) | failed(b))
    if "label" in df.columns:
        out = out.withColumns({f"{n}_matches_existing": valid(n) & F.coalesce(F.col(f"{n}_label") == F.col("label"), F.lit(False)) for n in names})
    return out


def complete(df: DataFrame, name: str) -> Column:
    """Whether an annotator's result is done: a valid label and no error."""
    return F.coalesce(F.col(f"{name}_label").isin(*LABELS), F.lit(False)) & (strip(F.col(f"{name}_error")) == "")


def percent(count: Column, total: Column) -> Column:
    """Share in percent, rounded half to even at two places; 0 of nothing."""
    return F.when(total > 0, F.bround(count / total * 100, 2)).otherwise(F.lit(0.0))
