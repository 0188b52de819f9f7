"""Training and use of the whole extraction: six fields of every article, from artifacts that a store keeps.

``train`` prepares all tables in one pass, fits what the library can fit (two classifiers, a tagger of conditions from weak
labels, thresholds of ages) on the training part, and keeps each as an artifact with its figures on the validation
part. ``predict`` loads what the store has; a field whose model is missing says that nothing is specified, conditions without
a selector are all candidates, and eligibility without a generator is the best sections.

Defined cases: repeated documents give a row each; documents without sections, title or abstract specify nothing where these
are needed; an answer that training never saw is never said by a classifier.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.replies import listed_answer
from ..functions.text import NOT_SPECIFIED
from ..operators.generators import token_windows
from ..operators.relations import checkpointed, classification_report
from . import answers, artifacts, classifier, entities, generation, sections, training
from .models import given, ranker_examples

#: What sections are ranked by, characters of a text that the tagger reads, tokens of a window and shared by two.
QUERY = "Eligibility criteria: who could take part in the study, and who could not."
TAGGED_CHARS, WINDOW, SHARED = 512, 400, 50


class SpanModel(Protocol):
    """Start and end scores of every token of a window for a question."""

    def scores(self, question: str, tokens: list[str]) -> tuple[list[float], list[float]]: ...


class NumberSpans:
    """Numbers near words of age, and near words of the question's bound: what needs no weights."""

    AGE = ("year", "yr", "age", "old")
    BOUND = {"minimum": ("least", "older", "over", "above", "minimum", "from"), "maximum": ("most", "younger", "under", "below", "maximum", "to", "up")}

    def scores(self, question: str, tokens: list[str]) -> tuple[list[float], list[float]]:
        low = [t.lower() for t in tokens]
        asked = next((words for b, words in self.BOUND.items() if b in question.lower()), ())
        out = []
        for k, t in enumerate(low):
            near = low[max(0, k - 4) : k + 4]
            said = any(c.isdigit() for c in t)
            out.append(4.0 * said * any(a in w for w in near for a in self.AGE) + 3.0 * said * any(w.strip(".,;:()") in asked for w in low[max(0, k - 3) : k]) + said)
        return out, out


def age_answers(texts: DataFrame, model=None, text: str = "candidate_text") -> DataFrame:
    """(doc_id, bound, answer, score) of each text's most confident window for each question."""
    rows = texts.filter(F.trim(F.coalesce(text, F.lit(""))) != "").select("doc_id", F.split(F.trim(text), r"\s+").alias("tokens"))
    questions = F.array(*[F.struct(F.lit(b).alias("bound"), F.lit(q).alias("question")) for b, q in training.QUESTIONS.items()])
    asked = token_windows(rows, "tokens", WINDOW, SHARED).select("doc_id", "window_start", "window", F.explode(questions).alias("q")).select("doc_id", "window_start", "window", "q.*")

    @F.pandas_udf("struct<starts:array<double>,ends:array<double>>")
    def scored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        own = given(model or NumberSpans())
        for asked_, windows in batches:
            yield pd.DataFrame([own.scores(q, list(w)) for q, w in zip(asked_, windows, strict=True)], columns=["starts", "ends"])

    spans = asked.withColumn("_s", scored("question", "window")).select("*", "_s.starts", "_s.ends").drop("_s")
    return answers.merged(answers.window_answers(spans), ["doc_id", "bound"])


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.left(F.coalesce(text, F.lit("")), F.lit(TAGGED_CHARS)), r"\s+"), lambda w: w != "")


def weak_tags(words: Column, names: Column) -> Column:
    """B, I and O of words where they spell one of the names, punctuation and case aside; the longest name first."""

    @F.pandas_udf("array<string>")
    def marked(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        bare = lambda w: w.lower().strip(".,;:()[]'\"")
        for rows, wanted in batches:
            out = []
            for ws, ns in zip(rows, wanted, strict=True):
                low, tags = [bare(w) for w in ws], ["O"] * len(ws)
                for name in sorted(([bare(p) for p in n.split()] for n in (ns if ns is not None else []) if n.strip()), key=len, reverse=True):
                    for k in range(len(low) - len(name) + 1):
                        if low[k : k + len(name)] == name and set(tags[k : k + len(name)]) == {"O"}:
                            tags[k : k + len(name)] = ["B", *["I"] * (len(name) - 1)]
                out.append(tags)
            yield pd.Series(out, dtype="object")

    return marked(words, names)


def entity_candidates(docs: DataFrame, tagger: entities.Tagger) -> DataFrame:
    """(doc_id, candidates) from title, abstract and keywords."""
    sources = F.array(words_of(F.col("title")), words_of(F.col("abstract")), words_of(F.array_join(F.coalesce("keywords", F.array().cast("array<string>")), " ")))
    rows = entities.tagged(docs.select("doc_id", F.posexplode(sources).alias("source", "words")), "words", tagger)
    each = rows.select("doc_id", "source", F.posexplode(F.arrays_zip("words", "tags")).alias("place", "x"))
    return entities.candidates(each.select("doc_id", "source", "place", F.regexp_replace("x.words", r"^[.,;:()\[\]]+|[.,;:()\[\]]+$", "").alias("token"), F.col("x.tags").alias("tag")))


class Trained(NamedTuple):
    """Versions by name, rows of each training table, and figures on the validation part."""

    versions: dict[str, str]
    counts: dict[str, int]
    figures: dict[str, tuple[float, float]]


def train(docs: DataFrame, parts: DataFrame, gold: DataFrame, store: str, encoder=None, spans=None, seed: int = 42, bits: int = 14) -> Trained:
    """Fits and keeps what the answers allow. ``docs`` has doc_id, title, abstract, keywords; ``parts`` doc_id, section_index, title, text, paragraphs."""
    spark = docs.sparkSession
    candidates = checkpointed(generation.candidate_texts(sections.ranker_candidates(parts, QUERY, encoder)))
    truths = gold.select("doc_id", F.col("eligibility_criteria").alias("truth"))
    examples = ranker_examples(sections.truth_similarity(parts, truths, encoder), QUERY)
    rows = training.joined(docs, gold, candidates, seed)
    names = rows.filter(F.col("split") == "train").select(F.explode(F.array(words_of(F.col("title")), words_of(F.col("abstract")))).alias("words"), listed_answer(F.col("conditions")).alias("names"))
    tagged = checkpointed(names.filter("size(words) > 0").withColumn("tags", weak_tags(F.col("words"), F.col("names"))))
    versions: dict[str, str] = {}
    tagger = None
    if not tagged.filter(F.array_contains("tags", "B")).isEmpty():
        tagger = entities.train(tagged, bits=bits)
        versions["conditions"] = artifacts.keep(spark, artifacts.Artifact("conditions", entities.TAGS, {}, {"weights": tagger.weights, "moves": tagger.moves}, {"bits": bits}), store)
    found = entity_candidates(docs, tagger) if tagger else spark.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, candidates array<string>")
    prepared = training.prepared(docs, gold, candidates, found, examples, seed)
    figures: dict[str, tuple[float, float]] = {}
    for name in ("study_type", "sex"):
        if name not in prepared.tables:
            continue
        table = checkpointed(prepared.tables[name])
        fitted = classifier.fit(table.filter("split = 'train'"), "text", "label", name, bits)
        if fitted is not None:
            versions[name] = artifacts.keep(spark, fitted, store)
            held = classifier.predicted(table.filter("split = 'validation'").withColumnRenamed("label", "truth"), "text", fitted)
            report = classification_report(held, "label", "truth").first()
            if report["accuracy"] is not None:
                figures[name] = (report["accuracy"], report["weighted_f1"])
    told = rows.filter(F.col("split") == "train")
    wanted = told.select("doc_id", F.explode(F.array(*[F.struct(F.lit(b).alias("bound"), F.col(f"{b}_age").alias("gold")) for b in training.QUESTIONS])).alias("x")).select("doc_id", "x.*")
    limits = answers.calibrated(age_answers(told.select("doc_id", "candidate_text").distinct(), spans), wanted, tuple(training.QUESTIONS), ["doc_id"]).collect()
    thresholds = {r["bound"]: float(r["threshold"]) for r in limits}
    versions["ages"] = artifacts.keep(spark, artifacts.Artifact("ages", tuple(sorted(thresholds)), thresholds, {}, {}), store)
    return Trained(versions, prepared.counts, figures)


def _kept(spark: SparkSession, store: str, name: str) -> artifacts.Artifact | None:
    return artifacts.load(spark, store, name) if artifacts.versions(spark, store, name) else None


def predict(docs: DataFrame, parts: DataFrame, store: str, encoder=None, spans=None, generator=None, replies: DataFrame | None = None) -> DataFrame:
    """(doc_id, conditions, study_type, sex, minimum_age, maximum_age, eligibility_criteria), all text, of every document."""
    spark = docs.sparkSession
    ranked = checkpointed(sections.ranker_candidates(parts, QUERY, encoder))
    candidates = generation.candidate_texts(ranked)
    base = docs.select("doc_id", "title", "abstract", "keywords").join(candidates, "doc_id", "left")
    text = F.coalesce(F.nullif(F.trim("candidate_text"), F.lit("")), "abstract")
    base = checkpointed(base.withColumns({"candidate_text": text, "_head": F.concat_ws(" ", "title", "abstract")}))
    rows = classifier.predicted(base, "_head", _kept(spark, store, "study_type"), "study_type", "_p").drop("_p")
    rows = classifier.predicted(rows, "candidate_text", _kept(spark, store, "sex"), "sex", "_p").drop("_p")
    # Without a text there is nothing to classify.
    for field, source in (("study_type", "_head"), ("sex", "candidate_text")):
        rows = rows.withColumn(field, F.when(F.trim(F.coalesce(source, F.lit(""))) == "", NOT_SPECIFIED).otherwise(F.col(field)))
    ids = base.select("doc_id").distinct()
    limits = (_kept(spark, store, "ages") or artifacts.Artifact("ages", (), {}, {}, {})).thresholds
    thresholds = spark.createDataFrame([(b, limits.get(b, answers.DEFAULT)) for b in training.QUESTIONS], "bound string, threshold double")
    asked = ids.withColumn("bound", F.explode(F.array(*[F.lit(b) for b in training.QUESTIONS])))
    said = answers.accepted_answers(asked, age_answers(base.select("doc_id", "candidate_text").distinct(), spans), thresholds, ["doc_id"])
    ages = said.groupBy("doc_id").pivot("bound", list(training.QUESTIONS)).agg(F.first("answer"))
    ages = ages.select("doc_id", *[F.col(b).alias(f"{b}_age") for b in training.QUESTIONS])
    kept = _kept(spark, store, "conditions")
    if kept is None:
        named = ids.withColumn("conditions", F.lit(NOT_SPECIFIED))
    else:
        tagger = entities.Tagger(np.array(kept.arrays["weights"]), np.array(kept.arrays["moves"]), kept.settings["bits"])
        picked = ids.join(entity_candidates(base.dropDuplicates(["doc_id"]), tagger), "doc_id", "left")
        picked = picked.join(replies.select("doc_id", "reply"), "doc_id", "left") if replies is not None else picked.withColumn("reply", F.lit(None).cast("string"))
        named = picked.select("doc_id", F.array_join(entities.selected(F.col("candidates"), F.col("reply")), ", ").alias("conditions"))
    eligible = generation.two_stages(ids, ranked, generator).select("doc_id", F.col("eligibility").alias("eligibility_criteria"))
    out = rows.join(ages, "doc_id", "left").join(named, "doc_id", "left").join(eligible, "doc_id", "left")
    fields = ("conditions", "study_type", "sex", "minimum_age", "maximum_age", "eligibility_criteria")
    return out.select("doc_id", *[F.coalesce(F.nullif(F.col(f), F.lit("")), F.lit(NOT_SPECIFIED)).alias(f) for f in fields])
