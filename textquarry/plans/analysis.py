"""Evaluation and diagnostics: scores, comparison of two systems, failures, lengths and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import WEIGHTS, composite, gated, numbers, set_similarity, text_score, word_cosine
from ..functions.submission import article_id
from ..functions.text import mentions_age, missing_wide
from ..operators.selection import worst_k

NUMERIC = ("sex", "minimum_age", "maximum_age")
SEMANTIC = ("conditions", "study_type")
BUDGET, FULL_SHARE = 20_000, 0.5


def paired(predictions: DataFrame, gold: DataFrame, key: str = "pmcids") -> DataFrame:
    """Inner join; all other columns get _pred and _gold. Repeated keys give every pair."""
    rename = lambda df, suffix: df.select(key, *[F.col(c).alias(f"{c}{suffix}") for c in df.columns if c != key])
    return rename(predictions, "_pred").join(rename(gold, "_gold"), key)


def scores(pairs: DataFrame, fast: bool = False) -> DataFrame:
    """``pairs`` with a score for each field and ``overall``. ``fast`` takes similarity for eligibility too, and no gate."""
    side = lambda f: (F.col(f"{f}_pred"), F.col(f"{f}_gold"))
    # The numbers of all sides in one column: what reads them is one expression.
    pairs = pairs.withColumn("_numbers", F.transform(F.array(*[c for f in NUMERIC for c in side(f)]), numbers))
    found = {f: set_similarity(F.col("_numbers")[2 * k], F.col("_numbers")[2 * k + 1]) for k, f in enumerate(NUMERIC)}
    for f in SEMANTIC:
        found[f] = word_cosine(*side(f)) if fast else gated(*side(f), word_cosine(*side(f)))
    found["eligibility_criteria"] = word_cosine(*side("eligibility_criteria")) if fast else text_score(*side("eligibility_criteria"))
    out = pairs.withColumns({f"score_{f}": c for f, c in found.items()}).drop("_numbers")
    return out.withColumn("score_overall", composite({f: F.col(f"score_{f}") for f in WEIGHTS}))


def mean_scores(scored: DataFrame) -> DataFrame:
    return scored.agg(*[F.avg(f"score_{f}").alias(f) for f in (*WEIGHTS, "overall")])


def drill_down(scored: DataFrame, key: str = "pmcids", score: str = "score_overall", k: int = 10) -> DataFrame:
    return worst_k(scored, score, key, k)


def comparable(system: DataFrame, key: str = "pmcids") -> DataFrame:
    """Rows with a normalised key, without those that specify nothing at all."""
    normal = system.withColumn(key, article_id(F.col(key)))
    nothing = F.lit(True)
    for f in WEIGHTS:
        nothing = nothing & missing_wide(F.col(f))
    return normal.filter(~nothing)


def compared(old: DataFrame, new: DataFrame, key: str = "pmcids", fields: tuple[str, ...] = (*WEIGHTS, "overall")) -> DataFrame:
    """Score differences of two scored systems on the keys of both; ``by_gain`` puts them in order."""
    left = old.select(key, *[F.col(f"score_{f}").alias(f"old_{f}") for f in fields])
    right = new.select(key, *[F.col(f"score_{f}").alias(f"new_{f}") for f in fields])
    return left.join(right, key).select(key, *[(F.col(f"new_{f}") - F.col(f"old_{f}")).alias(f"delta_{f}") for f in fields])


def by_gain(deltas: DataFrame, key: str = "pmcids", column: str = "delta_overall") -> DataFrame:
    """The greatest gain first."""
    return deltas.orderBy(F.desc(column), key)


def verdicts(deltas: DataFrame, column: str = "delta_overall") -> DataFrame:
    """Wins, ties and losses, and mean differences, one row."""
    d = F.col(column)
    means = [F.avg(c).alias(f"mean_{c}") for c in deltas.columns if c.startswith("delta_")]
    return deltas.agg(F.count_if(d > 0).alias("wins"), F.count_if(d == 0).alias("ties"), F.count_if(d < 0).alias("losses"), *means)


def missing_ages(pairs: DataFrame, articles: DataFrame, key: str = "pmcids") -> DataFrame:
    """Gold minimum ages of rows whose prediction is missing, with whether the article mentions an age: counts, greatest first."""
    lost = F.col("minimum_age_pred").isNull() | F.col("minimum_age_pred").isin("Not Specified", "None")
    rows = pairs.filter(lost).join(articles.select(key, mentions_age(F.col("text")).alias("age_in_text")), key, "left")
    return rows.groupBy("minimum_age_gold", "age_in_text").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "minimum_age_gold", "age_in_text")


def budget_policy(df: DataFrame, chars: str) -> DataFrame:
    """``df`` with the characters that its context may take, and the share that is: all of a short text, half of a long one up to a cap."""
    n = F.col(chars)
    budget = F.when(n <= BUDGET, n).otherwise(F.least(F.lit(BUDGET), F.floor(F.lit(FULL_SHARE) * n)))
    kind = F.when(n <= BUDGET, "full").when(F.floor(F.lit(FULL_SHARE) * n) >= BUDGET, "capped").otherwise("adaptive")
    out = df.withColumns({"budget_chars": budget.cast("long"), "budget_kind": kind})
    return out.withColumn("coverage", F.when(n > 0, F.col("budget_chars") / n).otherwise(0.0))


def section_scores(sections: DataFrame, query: str, threshold: float | None = None) -> DataFrame:
    """Sections (doc_id, section_index, title, text) by the better of their title's and their opening's similarity."""
    q = F.lit(query)
    score = F.greatest(word_cosine(q, F.coalesce("title", F.lit(""))), word_cosine(q, F.left(F.coalesce("text", F.lit("")), F.lit(200))))
    out = sections.withColumn("score", score)
    out = out.filter(F.col("score") >= threshold) if threshold is not None else out
    return out.orderBy(F.desc("score"), "doc_id", "section_index")


def article_chars(title: Column, abstract: Column, sections: Column) -> Column:
    """Characters of an article: its title, its abstract and its sections' texts; what is null counts 0."""
    n = lambda x: F.coalesce(F.char_length(x), F.lit(0)).cast("long")
    body = F.aggregate(F.coalesce(sections, F.array().cast("array<string>")), F.lit(0).cast("long"), lambda s, x: s + n(x))
    return n(title) + n(abstract) + body


def context_lengths(old: DataFrame, new: DataFrame, key: str = "doc_id", context: str = "context") -> DataFrame:
    """Characters of two systems' contexts side by side."""
    size = lambda df, name: df.select(key, F.char_length(context).alias(name))
    return size(old, "old_chars").join(size(new, "new_chars"), key, "full")
