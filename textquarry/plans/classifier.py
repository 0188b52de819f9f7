"""A text classifier: logistic regression over hashed words and word pairs, trained in Spark and kept as an artifact.

Texts become (place, count) lists once, natively. Each round every task adds up the gradient of its rows into one array of
fixed size, Spark sums these by place, and the driver moves the weights; nothing grows with the rows but the rows.

Defined cases: null texts are empty, and take part with the bias alone; rows with a null label take no part in training;
fewer than ``least`` rows, or fewer than two labels, train nothing (None), and an untrained classifier answers that nothing
is specified; of equal probabilities the label that sorts first is said.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import NOT_SPECIFIED
from ..operators.relations import checkpointed
from .artifacts import Artifact, Shipped, ship

#: log2 of the places, and how many labels a classifier may tell apart.
BITS, LABELS = 16, 100
#: Rounds, the first step's length, and the weight of the penalty on large weights.
ROUNDS, STEP, PENALTY = 40, 0.5, 1e-4


_SPACE = re.compile(r"\s+", re.ASCII)


def _terms(words: list[str]) -> list[str]:
    return [*words, *map(" ".join, zip(words, words[1:], strict=False))]


def places(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights of a text's words and word pairs; weights have length 1 together."""
    found, counts = np.unique([zlib.crc32(t.encode()) & ((1 << bits) - 1) for t in _terms([w for w in _SPACE.split(text.lower()) if w])], return_counts=True)
    weights = counts.astype(float)
    return found.astype(np.int64), weights / (np.sqrt((weights**2).sum()) or 1.0)


def features(text: Column, bits: int) -> Column:
    """What ``places`` gives, as an array of (at, x), by built-in functions; the words of ASCII white space only."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")

    def listed(w: Column) -> Column:
        pairs = F.transform(F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), lambda x, k: F.concat(F.get(w, k), F.lit(" "), x))
        return F.array_sort(F.transform(F.concat(w, pairs), lambda t: F.crc32(t.cast("binary")).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))))

    return F.transform(F.array(words), listed)[0]


class LinearClassifier:
    """Probabilities of labels by the weights of an artifact; the first row is the bias."""

    def __init__(self, artifact: Artifact):
        self.labels, self.weights, self.bits = artifact.labels, artifact.arrays["weights"], artifact.settings["bits"]

    def probabilities(self, texts: list[str]) -> list[dict[str, float]]:
        out = []
        for text in texts:
            at, x = places(text, self.bits)
            z = self.weights[0] + x @ self.weights[1 + at] if len(at) else self.weights[0]
            e = np.exp(z - z.max())
            out.append(dict(zip(self.labels, (e / e.sum()).tolist(), strict=True)))
        return out


def fit(df: DataFrame, text: str, label: str, name: str = "classifier", bits: int = BITS, rounds: int = ROUNDS, least: int = 10) -> Artifact | None:
    """The artifact of a classifier of ``label`` by ``text``; None where there is too little to learn from."""
    spark = df.sparkSession
    rows = df.filter(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("label"), features(F.col(text), bits).alias("at"))
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).limit(LABELS + 1).collect()}
    if len(counts) > LABELS:
        raise ValueError(f"more than {LABELS} labels")
    n, labels = sum(counts.values()), sorted(counts)
    if n < least or len(labels) < 2:
        return None
    number = {x: k for k, x in enumerate(labels)}
    rows = checkpointed(rows)
    weights, squares = np.zeros((1 + (1 << bits), len(labels))), np.zeros((1 + (1 << bits), len(labels)))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(weights)  # 2 ** bits rows

        def gradient(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            w = shared.value
            total = np.zeros_like(w)
            for b in batches:
                for label_, at in zip(b["label"], b["at"], strict=True):
                    found, c = np.unique(at, return_counts=True)
                    x = c / (np.sqrt((c.astype(float) ** 2).sum()) or 1.0)
                    z = w[0] + x @ w[1 + found]
                    e = np.exp(z - z.max())
                    e /= e.sum()
                    e[number[label_]] -= 1
                    total[0] += e
                    total[1 + found] += x[:, None] * e
            moved = np.flatnonzero(total.any(axis=1))
            if len(moved):  # a task without rows has no list for Arrow to take its type from
                yield pd.DataFrame({"at": moved, "g": total[moved].tolist()})

        sums = [F.sum(F.col("g")[k]).alias(f"g{k}") for k in range(len(labels))]
        found = rows.mapInPandas(gradient, "at long, g array<double>").groupBy("at").agg(*sums).collect()  # 2 ** bits rows at most
        slope = PENALTY * weights
        slope[[r["at"] for r in found]] += np.array([[r[f"g{k}"] for k in range(len(labels))] for r in found]) / n
        squares += slope**2
        weights = weights - STEP * slope / np.sqrt(squares + 1e-12)
        shared.unpersist()
    return Artifact(name, tuple(labels), {}, {"weights": weights.astype(np.float32)}, {"bits": bits, "rows": n})


def predicted(df: DataFrame, text: str, artifact: Artifact | None, out: str = "label", probability: str = "probability") -> DataFrame:
    """``df`` with the likeliest label and its probability; without a trained classifier nothing is specified.

    A label with a threshold in the artifact is said only above it.
    """
    if artifact is None:
        return df.withColumns({out: F.lit(NOT_SPECIFIED), probability: F.lit(None).cast("double")})
    model: Shipped = ship(df.sparkSession, artifact, LinearClassifier)

    @F.pandas_udf("struct<label:string,p:double>")
    def best(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = model.get()
        for texts in batches:
            found = [max(p.items(), key=lambda x: x[1]) for p in own.probabilities(texts.fillna("").tolist())]
            yield pd.DataFrame(found, columns=["label", "p"])

    said = F.col("_said.label")
    if artifact.thresholds:
        limits = F.create_map(*[x for k, t in sorted(artifact.thresholds.items()) for x in (F.lit(k), F.lit(float(t)))])
        said = F.when(F.col("_said.p") > F.coalesce(F.element_at(limits, said), F.lit(0.0)), said).otherwise(F.lit(NOT_SPECIFIED))
    return df.withColumn("_said", best(F.col(text))).withColumns({out: said, probability: F.col("_said.p")}).drop("_said")
