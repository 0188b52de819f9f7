"""Selection of blocks: top-k, running budgets, greedy packing, routing with fallback, truncating concatenation.

Rankings add the block's position as the last key, so ties keep document order. Running budgets and top-k are windows
over (group, rank); the two packers whose next step depends on what was taken so far are folds over a sorted array of
at most the candidates that top-k left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Candidates, score targets and lengths by field group; the unified selection; routing; context caps.
FIELDS = ("condition_study_type", "demographics", "eligibility")
TOP_K = {"condition_study_type": 40, "demographics": 40, "eligibility": 60}
SCORE_TARGET = {"condition_study_type": 0.8, "demographics": 1.5, "eligibility": 2.5}
MIN_CHARS = {"condition_study_type": 0, "demographics": 1800, "eligibility": 3000}
MAX_CHARS = {"condition_study_type": 2000, "demographics": 4500, "eligibility": 8000}
CHAR_FRACTION, MIN_BLOCKS = 0.30, 8
THRESHOLDS = {"condition_study_type": 0.33, "demographics": 0.03, "eligibility": 0.05}
FALLBACK_BLOCKS = {"condition_study_type": 2, "demographics": 2, "eligibility": 3}
CONTEXT_CHARS = {"condition_study_type": 30_000, "demographics": 30_000, "eligibility": 50_000}
SECTION_CHARS, SECTION_BUDGET, SECTION_THRESHOLD = 600, 5_000, 0.20


def by_field(values: dict[str, float], field: Column) -> Column:
    """The value of a row's field group."""
    out = F.lit(None)
    for name, value in values.items():
        out = F.when(field == name, F.lit(value)).otherwise(out)
    return out


def ranked(df: DataFrame, group: list[str], score: str, position: str, name: str = "rank") -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.col(score).desc_nulls_last(), F.col(position))
    return df.withColumn(name, F.row_number().over(order))


def top_k(df: DataFrame, group: list[str], score: str, position: str, k: int | Column) -> DataFrame:
    """The ``k`` rows of each group with the highest score; a literal ``k`` is pruned before the shuffle."""
    return ranked(df, group, score, position).filter(F.col("rank") <= k)


def worst_k(df: DataFrame, score: str, position: str, k: int) -> DataFrame:
    """The ``k`` rows with the lowest score."""
    return df.orderBy(F.col(score).asc_nulls_last(), position).limit(k)


def prefix_to_budget(
    df: DataFrame, group: list[str], score: str, position: str, chars: str, fraction: float = CHAR_FRACTION, min_blocks: int = MIN_BLOCKS, kept: str | None = None
) -> DataFrame:
    """Best blocks first until they hold ``fraction`` of the group's characters and are ``min_blocks``, the crossing one included.

    With ``kept`` all rows stay, and that column says which are selected.
    """
    all_rows = Window.partitionBy(*group)
    so_far = all_rows.orderBy(F.col(score).desc_nulls_last(), F.col(position)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    target = F.greatest(F.lit(1), F.ceil(F.lit(fraction) * F.sum(chars).over(all_rows)))
    spent = F.sum(chars).over(so_far) - F.col(chars)
    out = df.withColumns({"target_chars": target.cast("long"), "_spent": spent, "rank": F.count(F.lit(1)).over(so_far).cast("int")})
    chosen = (F.col("_spent") < F.col("target_chars")) | (F.col("rank") <= min_blocks)
    return (out.withColumn(kept, chosen) if kept else out.filter(chosen)).drop("_spent")


def prefix_to_overflow(df: DataFrame, group: list[str], score: str, position: str, chars: str, budget: int = SECTION_BUDGET) -> DataFrame:
    """Best rows first, up to the first that would pass the budget."""
    so_far = Window.partitionBy(*group).orderBy(F.col(score).desc_nulls_last(), F.col(position)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("running_chars", F.sum(chars).over(so_far)).filter(F.col("running_chars") <= budget)


def route(df: DataFrame, group: list[str], probability: str, position: str, threshold: Column, fallback: Column) -> DataFrame:
    """Rows at or above their threshold; where those are fewer than ``fallback``, the likeliest others fill up."""
    out = ranked(df, group, probability, position, "_rank").withColumn("above", F.coalesce(F.col(probability), F.lit(0.0)) >= threshold)
    return out.filter(F.col("above") | (F.col("_rank") <= fallback)).drop("_rank")


def packed(candidates: Column, target: Column, least: Column, most: Column) -> Column:
    """Greedy packing of an array of structs (id, score, chars), in order: the structs that are taken.

    One with an id seen before is passed over. One that would pass ``most`` is passed over too, later smaller ones may
    still fit; but the first is taken whatever its length. Packing ends when the score reaches ``target`` and the length
    ``least``.
    """
    start = F.struct(F.slice(candidates, 1, 0).alias("taken"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("chars"), F.lit(False).alias("done"))

    def step(acc: Column, row: Column) -> Column:
        seen = F.exists(acc["taken"], lambda t: t["id"] == row["id"])
        fits = (acc["chars"] + row["chars"] <= most) | (F.size(acc["taken"]) == 0)
        take = ~acc["done"] & ~seen & fits
        score, chars = acc["score"] + row["score"], acc["chars"] + row["chars"]
        return F.when(
            take,
            F.struct(
                F.array_append(acc["taken"], row).alias("taken"), score.alias("score"), chars.cast("long").alias("chars"), ((score >= target) & (chars >= least)).alias("done")
            ),
        ).otherwise(acc)

    return F.aggregate(candidates, start, step, lambda acc: acc["taken"])


def pack(df: DataFrame, group: list[str], score: str, position: str, block: str, chars: str, target: Column, least: Column, most: Column) -> DataFrame:
    """One row per group with ``taken``: an array of (id, score, chars, position) in the order of taking."""
    item = F.struct((-F.col(score)).alias("key"), F.col(position).alias("position"), F.col(block).alias("id"), F.col(score).cast("double").alias("score"), F.col(chars).cast("long").alias("chars"))
    lists = df.groupBy(*group).agg(F.array_sort(F.collect_list(item)).alias("_items"))
    rows = F.transform("_items", lambda x: F.struct(x["id"].alias("id"), x["score"].alias("score"), x["chars"].alias("chars"), x["position"].alias("position")))
    return lists.withColumn("_rows", rows).select(*group, packed(F.col("_rows"), target, least, most).alias("taken"))


def truncated_concat(pieces: Column, most: int | Column, separator: str = "\n\n") -> Column:
    """Pieces in order, joined, up to ``most`` characters: the piece that passes the cap is cut and stripped at its end."""
    most = F.lit(most) if isinstance(most, int) else most
    gap = len(separator)
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("used"), F.lit(False).alias("full"), F.lit(False).alias("some"))

    def step(acc: Column, piece: Column) -> Column:
        cost = F.when(acc["some"], F.lit(gap)).otherwise(F.lit(0))
        room = most - acc["used"] - cost
        fits = F.char_length(piece) <= room
        part = F.when(fits, piece).otherwise(F.regexp_replace(F.left(piece, F.greatest(room, F.lit(0))), r"(?U)\s+$", ""))
        text = F.concat(acc["text"], F.when(acc["some"], F.lit(separator)).otherwise(F.lit("")), part)
        stop = acc["full"] | (room <= 0)
        return F.when(stop, F.struct(acc["text"].alias("text"), acc["used"].alias("used"), F.lit(True).alias("full"), acc["some"].alias("some"))).otherwise(
            F.struct(text.alias("text"), (acc["used"] + cost + F.char_length(part)).alias("used"), F.lit(False).alias("full"), F.lit(True).alias("some"))
        )

    return F.aggregate(pieces, start, step, lambda acc: acc["text"])


def paragraphs(text: Column, least: int = 80) -> Column:
    """Paragraphs at blank lines, or sentences where there is one only, merged until each holds ``least`` characters."""
    text = F.coalesce(text, F.lit(""))
    tidy = lambda parts: F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: p != "")
    at_blanks, at_ends = tidy(F.split(text, r"\n\s*\n+")), tidy(F.split(text, r"(?<=[.;:])\s+(?=[A-Z0-9])"))
    parts = F.when(F.size(at_blanks) > 1, at_blanks).otherwise(at_ends)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, part: Column) -> Column:
        grows = F.char_length(acc["open"]) < least
        longer = F.ltrim(F.concat(acc["open"], F.lit(" "), part))
        return F.struct(
            F.when(grows, acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])).alias("done"), F.when(grows, longer).otherwise(part).alias("open")
        )

    merged = F.aggregate(parts, start, step, lambda acc: F.when(acc["open"] != "", F.array_append(acc["done"], acc["open"])).otherwise(acc["done"]))
    return F.when(F.size(merged) > 0, merged).otherwise(F.array(text))
