"""Scores of sections against a query through an encoder, several views of each section in one pass.

Every text that any view needs goes to the encoder once, in one list for each section; similarities are computed where the
vectors are, and only numbers come back.

Defined cases: null titles and texts are empty, and an empty text is like nothing; ties go to the earlier section, then to
the earlier paragraph; a section without paragraphs of enough length has no paragraph score (null).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import missing, word_count
from ..operators.selection import top_k
from .models import HashingEncoder, given

#: Characters of an opening, of a body, of a ranker's snippet and of a training text, and words of a paragraph.
OPENING, BODY, SNIPPET, TRAINING, WORDY = 200, 4000, 300, 500, 15
#: Fixed value: characters of a paragraph that is scored by itself.
PARAGRAPH = 80


def pooled(vectors: Column, mask: Column) -> Column:
    """The mean of the vectors whose mask is not 0, in double precision: one fold. No such vector gives zeros, no vector at all null."""
    size = F.size(F.get(vectors, 0))
    zeros = F.transform(F.sequence(F.lit(1), size), lambda _: F.lit(0.0))
    weighed = F.zip_with(vectors, mask, lambda v, m: F.struct(v.alias("v"), F.coalesce(m.cast("double"), F.lit(0.0)).alias("m")))
    opened = F.struct(zeros.alias("s"), F.lit(0.0).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        added = F.zip_with(acc["s"], x["v"], lambda s, v: s + F.when(x["m"] != 0, v.cast("double") * x["m"]).otherwise(0.0))
        return F.struct(added.alias("s"), (acc["n"] + x["m"]).alias("n"))

    mean = F.aggregate(weighed, opened, step, lambda acc: F.transform(acc["s"], lambda s: s / F.greatest(acc["n"], F.lit(1e-9))))
    return F.when(size > 0, mean)


def similarities(texts: Column, query: Column, encoder) -> Column:
    """The cosine of each of an array of texts with ``query``, in one call of the encoder for a batch."""

    @F.pandas_udf("array<double>")
    def scored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        own = given(encoder)
        for lists, queries in batches:
            asked = queries.fillna("").tolist()
            lists = [[t or "" for t in x] if x is not None else [] for x in lists]
            distinct = {t: k for k, t in enumerate(dict.fromkeys([*asked, *(t for x in lists for t in x)]))}
            v = np.asarray(own.encode(list(distinct)), float) if distinct else np.zeros((0, 1))
            v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            yield pd.Series([[float(v[distinct[t]] @ v[distinct[q]]) if t else 0.0 for t in x] for x, q in zip(lists, asked, strict=True)], dtype="object")

    return scored(texts, query)


def view_scores(sections: DataFrame, query: str, encoder=None, title: str = "title", text: str = "text", paragraphs: Column | None = None) -> DataFrame:
    """``sections`` with title_score, opening_score, body_score, paragraph_score and best_paragraph.

    Paragraphs are the text's lines of at least ``PARAGRAPH`` characters, unless they are given.
    """
    name, body = F.coalesce(title, F.lit("")), F.coalesce(text, F.lit(""))
    parts = paragraphs if paragraphs is not None else F.filter(F.transform(F.split(body, r"\n+"), lambda p: F.trim(p)), lambda p: F.char_length(p) >= PARAGRAPH)
    rows = sections.withColumn("_parts", F.coalesce(parts, F.array().cast("array<string>")))
    views = F.concat(F.array(name, F.left(body, F.lit(OPENING)), F.left(body, F.lit(BODY))), "_parts")
    rows = rows.withColumn("_s", similarities(views, F.lit(query), encoder or HashingEncoder()))
    of_parts = F.slice("_s", F.lit(4), F.greatest(F.size("_s") - 3, F.lit(0)))
    best = F.array_max(of_parts)
    place = (F.array_position(of_parts, best) - 1).cast("int")
    return rows.withColumns(
        {"title_score": F.col("_s")[0], "opening_score": F.col("_s")[1], "body_score": F.col("_s")[2], "paragraph_score": best, "best_paragraph": F.when(best.isNotNull(), F.get("_parts", place))}
    ).drop("_s", "_parts")


def ranked_sections(scored: DataFrame, views: tuple[str, ...] = ("title_score", "opening_score"), threshold: float | None = None) -> DataFrame:
    """Scored sections with ``score``, the best of some views, and ``rank`` in their document; those under the threshold are left out."""
    score = F.greatest(*[F.coalesce(v, F.lit(0.0)) for v in views]) if len(views) > 1 else F.coalesce(views[0], F.lit(0.0))
    rows = scored.withColumn("score", score)
    rows = rows if threshold is None else rows.filter(F.col("score") >= threshold)
    return top_k(rows, ["doc_id"], "score", "section_index", 2**31 - 1)


def ranker_candidates(sections: DataFrame, query: str, encoder=None, k: int = 3) -> DataFrame:
    """(doc_id, section_index, text, score, rank) of each document's k best candidates.

    Candidates are sections with a text, by title and opening; and of untitled sections also the paragraphs of enough words.
    ``sections`` has doc_id, section_index, title, text, paragraphs.
    """
    name, body = F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))
    lines = F.when(F.trim(name) == "", F.filter(F.coalesce("paragraphs", F.array().cast("array<string>")), lambda p: word_count(p) >= WORDY)).otherwise(F.array().cast("array<string>"))
    rows = sections.filter(F.trim(body) != "").withColumn("_lines", lines)
    snippets = F.concat(F.array(F.trim(F.concat(name, F.lit(" "), F.left(body, F.lit(SNIPPET))))), F.transform("_lines", lambda p: F.left(p, F.lit(SNIPPET))))
    rows = rows.withColumns({"_s": similarities(snippets, F.lit(query), encoder or HashingEncoder()), "_texts": F.concat(F.array(body), "_lines")})
    each = rows.select("doc_id", "section_index", F.posexplode(F.arrays_zip(F.col("_texts").alias("text"), F.col("_s").alias("score"))).alias("_n", "_x"))
    order = (F.col("section_index").cast("long") * 100_000 + F.col("_n")).alias("_place")
    best = top_k(each.select("doc_id", "section_index", order, "_x.text", "_x.score"), ["doc_id"], "score", "_place", k)
    return best.drop("_place")


def truth_similarity(sections: DataFrame, truths: DataFrame, encoder=None) -> DataFrame:
    """(doc_id, section_index, text, similarity) of sections to the true answer (doc_id, truth), as a ranker's examples need them.

    Only documents with an answer and at least two sections with a text; texts are title and opening.
    """
    told = truths.filter(~missing(F.col("truth"))).select("doc_id", "truth")
    text = F.left(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), "text"), F.lit(TRAINING))
    rows = sections.filter(F.trim(F.coalesce("text", F.lit(""))) != "").select("doc_id", "section_index", text.alias("text"))
    several = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select("doc_id")
    rows = rows.join(several, "doc_id").join(told, "doc_id")
    return rows.select("doc_id", "section_index", "text", similarities(F.array("text"), F.col("truth"), encoder or HashingEncoder())[0].alias("similarity"))
