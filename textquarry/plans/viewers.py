"""What a person looks at: articles, prompts, predictions and their gold as texts, shortened on demand; whole tables, a text a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import WEIGHTS

#: Fixed value: what a shortened text ends in.
SHORTENED = "\n... [truncated]"


def truncated(text: Column, chars: int | None = None) -> Column:
    """The text, or its first ``chars`` characters and a mark that it goes on; null as empty."""
    whole = F.coalesce(text, F.lit(""))
    return whole if chars is None else F.when(F.char_length(whole) > chars, F.concat(F.left(whole, F.lit(chars)), F.lit(SHORTENED))).otherwise(whole)


def _ruled(title: Column, body: Column) -> Column:
    return F.concat(F.lit("=" * 100 + "\n"), title, F.lit("\n" + "=" * 100 + "\n"), body)


def articles(docs: DataFrame, sections: DataFrame, chars: int | None = None) -> DataFrame:
    """(doc_id, view): title, abstract and sections in order, each section shortened by itself; documents without sections too."""
    name = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.lit("Untitled Section"))
    part = F.concat(F.lit("["), F.lpad(F.col("section_index").cast("string"), 2, "0"), F.lit("] "), name, F.lit("\n"), truncated(F.col("text"), chars))
    listed = sections.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("section_index", part.alias("p")))).alias("_s"))
    body = F.array_join(F.transform(F.coalesce("_s", F.array().cast("array<struct<section_index:int,p:string>>")), lambda x: x["p"]), "\n\n")
    rows = docs.join(listed, "doc_id", "left")
    abstract = F.concat(F.lit("Abstract\n"), truncated(F.col("abstract"), chars), F.lit("\n\n"))
    return rows.select("doc_id", _ruled(F.concat(F.col("doc_id").cast("string"), F.lit("\n"), F.coalesce("title", F.lit(""))), F.concat(abstract, body)).alias("view"))


def prompts(rows: DataFrame, chars: int | None = None) -> DataFrame:
    """(doc_id, field, chars, view) of rows with ``prompt``; ``chars`` counts the whole prompt."""
    return rows.select("doc_id", "field", F.char_length(F.coalesce("prompt", F.lit(""))).alias("chars"), _ruled(F.concat_ws(" ", F.col("doc_id").cast("string"), "field"), truncated(F.col("prompt"), chars)).alias("view"))


def predictions(pairs: DataFrame, chars: int | None = None, key: str = "pmcids", fields: tuple[str, ...] = tuple(WEIGHTS)) -> DataFrame:
    """(key, view) of scored pairs: each field's score, prediction and gold."""

    def shown(f: str) -> Column:
        score = F.format_number(F.coalesce(F.col(f"score_{f}"), F.lit(0.0)), 4) if f"score_{f}" in pairs.columns else F.lit("-")
        return F.concat(F.lit(f"{f}  "), score, F.lit("\n  predicted: "), truncated(F.col(f"{f}_pred"), chars), F.lit("\n  gold:      "), truncated(F.col(f"{f}_gold"), chars))

    present = [f for f in fields if f"{f}_pred" in pairs.columns]
    return pairs.select(key, _ruled(F.col(key).cast("string"), F.concat_ws("\n", *[shown(f) for f in present])).alias("view"))
