"""Models behind protocols, each with a deterministic offline default that needs no weights.

Anything with the right method can take the place of a default: an encoder, a block classifier, an extractor of replies. A
model may be given as it is, and goes to each task with its code, or as ``Lazy``, a key and a factory: then each worker
process makes it once, however many tasks it runs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import NOT_SPECIFIED


class Encoder(Protocol):
    def encode(self, texts: list[str]) -> np.ndarray: ...


class Classifier(Protocol):
    def probabilities(self, texts: list[str]) -> list[dict[str, float]]: ...


class Extractor(Protocol):
    def reply(self, field: str, context: str) -> str: ...


class Lazy:
    """A model that each worker process makes once for ``key``, by calling ``factory``."""

    _made: dict = {}

    def __init__(self, key: str, factory: Callable[[], object]):
        self.key, self.factory = key, factory

    def get(self):
        if self.key not in Lazy._made:
            Lazy._made[self.key] = self.factory()
        return Lazy._made[self.key]


def given(model):
    """The model itself, where it may be one that is made in the worker."""
    return model.get() if hasattr(model, "get") else model


class HashingEncoder:
    """Unit vectors of hashed words and word pairs."""

    def __init__(self, size: int = 256):
        self.size = size

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size))
        for k, text in enumerate(texts):
            words = text.lower().split()
            for token in [*words, *map(" ".join, zip(words, words[1:], strict=False))]:
                h = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "little")
                out[k, h % self.size] += 1.0 if h >> 63 else -1.0
            size = np.linalg.norm(out[k])
            out[k] /= size or 1.0
        return out


class KeywordClassifier:
    """Probabilities from the share of a field's words in the text."""

    # Words that speak for a field.
    WORDS = {
        "condition_study_type": ("disease", "condition", "diagnosis", "trial", "cohort", "randomized", "observational"),
        "demographics": ("age", "aged", "years", "sex", "male", "female", "women", "men"),
        "eligibility": ("inclusion", "exclusion", "eligible", "criteria", "excluded", "enrolled", "participants"),
    }

    def probabilities(self, texts: list[str]) -> list[dict[str, float]]:
        out = []
        for text in texts:
            words = text.lower().split()
            out.append({f: min(1.0, 5 * sum(w.strip(".,;:()") in known for w in words) / (len(words) or 1)) for f, known in self.WORDS.items()})
        return out


class SilentExtractor:
    """Replies that say nothing: what an untrained model gives."""

    REPLIES = {
        "condition_study_type": f'{{"conditions": "{NOT_SPECIFIED}", "study_type": "OBSERVATIONAL"}}',
        "demographics": f'{{"sex": "ALL", "minimum_age": "{NOT_SPECIFIED}", "maximum_age": "{NOT_SPECIFIED}"}}',
        "eligibility": '{"inclusion_criteria": [], "exclusion_criteria": []}',
    }

    def reply(self, field: str, context: str) -> str:
        return self.REPLIES[field]


def encode(df: DataFrame, text: str, out: str, encoder: Encoder) -> DataFrame:
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = given(encoder)
        for texts in batches:
            yield pd.Series(list(own.encode(texts.fillna("").tolist()).astype(np.float32)), dtype="object")

    return df.withColumn(out, vectors(F.col(text)))


def classify(df: DataFrame, text: str, out: str, classifier: Classifier) -> DataFrame:
    @F.pandas_udf(T.MapType(T.StringType(), T.DoubleType()))
    def probabilities(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = given(classifier)
        for texts in batches:
            yield pd.Series(own.probabilities(texts.fillna("").tolist()), dtype="object")

    return df.withColumn(out, probabilities(F.col(text)))


def extract(df: DataFrame, field: str, context: str, extractor: Extractor, attempts: int = 5, wait: Callable[[int], None] = lambda n: None) -> DataFrame:
    """``df`` with ``reply`` and ``error``: a call is tried again after any failure; the last failure is the error."""

    @F.pandas_udf(T.StructType([T.StructField("reply", T.StringType()), T.StructField("error", T.StringType())]))
    def called(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        own = given(extractor)
        for fields, contexts in batches:
            rows = []
            for f, c in zip(fields, contexts, strict=True):
                row = (None, "no attempt")
                for n in range(1, attempts + 1):
                    try:
                        row = (own.reply(f, c), None)
                        break
                    except Exception as e:  # a model's or connection's failure of any kind
                        row = (None, f"{type(e).__name__}: {e}")
                        if n < attempts:
                            wait(n)
                rows.append(row)
            yield pd.DataFrame(rows, columns=["reply", "error"])

    return df.withColumn("_call", called(F.col(field), F.col(context))).select("*", "_call.reply", "_call.error").drop("_call")


def accepted(answer: Column, score: Column, threshold: Column) -> Column:
    """A question-answering model's answer if its score is greater than the threshold."""
    return F.when(score > threshold, answer).otherwise(F.lit(NOT_SPECIFIED))


def ranker_examples(scored: DataFrame, query: str, negatives: int = 4) -> DataFrame:
    """(doc_id, query, positive, negatives): the section most like the truth, and the first others in order.

    ``scored`` has doc_id, section_index, text and similarity to the truth.
    """
    best = scored.groupBy("doc_id").agg(F.max_by(F.struct("section_index", "text"), F.struct("similarity", -F.col("section_index"))).alias("best"))
    others = scored.join(best, "doc_id").filter("section_index <> best.section_index")
    first = others.groupBy("doc_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("section_index", "text"))), 1, negatives).alias("n"))
    return best.join(first, "doc_id", "left").select(
        "doc_id", F.lit(query).alias("query"), F.col("best.text").alias("positive"), F.transform(F.coalesce("n", F.array().cast("array<struct<section_index:int,text:string>>")), lambda x: x["text"]).alias("negatives")
    )
