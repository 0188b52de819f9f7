"""Text generation over a step protocol, by beam search, and the extraction of eligibility in two stages.

A step model scores the next token of many prefixes at once. The search keeps a bounded number of prefixes for each row,
and runs all rows of a batch side by side, so one call of the model serves them all. Scores are sums of logarithms.

Defined cases: null and empty sources generate nothing (the empty text); equal totals go to the prefix that was ahead, then
to the smaller token; a row ends when as many ended sequences as beams are at hand, or at ``longest`` tokens; a model whose
tokens are all forbidden ends the sequence there.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import NOT_SPECIFIED
from ..operators.selection import top_k
from .models import given

#: Prefixes that are kept, what repeated tokens are divided by, and the length of runs that may not come twice.
BEAMS, REPETITION, RUN = 4, 2.0, 3


class StepModel(Protocol):
    """``end`` is the token that ends a text; ``scores`` gives a row of log-probabilities by token for each (source, prefix)."""

    end: int

    def scores(self, sources: list[str], prefixes: list[tuple[int, ...]]) -> np.ndarray: ...

    def text(self, tokens: tuple[int, ...]) -> str: ...


def allowed(scores: np.ndarray, prefix: tuple[int, ...], repetition: float, run: int) -> np.ndarray:
    """The scores after a prefix: tokens of the prefix are made less likely, those that would repeat a run are forbidden."""
    out = scores.copy()
    for t in set(prefix) if repetition != 1.0 else ():
        out[t] = out[t] * repetition if out[t] < 0 else out[t] / repetition
    if run and len(prefix) >= run - 1:
        tail = prefix[len(prefix) - run + 1 :] if run > 1 else ()
        for k in range(len(prefix) - run + 1):
            if prefix[k : k + run - 1] == tail:
                out[prefix[k + run - 1]] = -np.inf
    return out


def beams(model: StepModel, sources: list[str], longest: int, width: int = BEAMS, repetition: float = REPETITION, run: int = RUN) -> list[tuple[int, ...]]:
    """The best sequence of each source, by total over length among those that ended, else among those at hand."""
    open_: list[list[tuple[float, tuple[int, ...]]]] = [[(0.0, ())] for _ in sources]
    ended: list[list[tuple[float, tuple[int, ...]]]] = [[] for _ in sources]
    for _ in range(longest):
        asked = [(r, total, prefix) for r, row in enumerate(open_) for total, prefix in row]
        if not asked:
            break
        found = model.scores([sources[r] for r, _, _ in asked], [prefix for _, _, prefix in asked])
        grown: list[list[tuple[float, int, int, tuple[int, ...]]]] = [[] for _ in sources]
        for k, ((r, total, prefix), scores) in enumerate(zip(asked, found, strict=True)):
            scores = allowed(np.asarray(scores, float), prefix, repetition, run)
            # No row can use more of one prefix than its beams, and one that ends.
            for t in np.argsort(-scores, kind="stable")[: width + 1]:
                if scores[t] > -np.inf:
                    grown[r].append((-(total + scores[t]), k, int(t), prefix))
        for r, row in enumerate(grown):
            if not open_[r]:
                continue
            best = sorted(row)[: 2 * width]
            ended[r] += [(-s, prefix) for s, _, t, prefix in best if t == model.end]
            ended[r] = sorted(ended[r], key=lambda x: -x[0] / max(len(x[1]), 1))[:width]
            open_[r] = [] if len(ended[r]) >= width else [(-s, (*prefix, t)) for s, _, t, prefix in best if t != model.end][:width]
    out = []
    for r in range(len(sources)):
        every = ended[r] or open_[r]
        out.append(max(every, key=lambda x: x[0] / max(len(x[1]), 1))[1] if every else ())
    return out


def generated(df: DataFrame, source: str, model, out: str = "generated", longest: int = 256, width: int = BEAMS, together: int = 64) -> DataFrame:
    """``df`` with the generated text of ``source``; ``model`` is a step model, or one that workers make. ``together`` rows are searched side by side."""

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = given(model)
        for rows in batches:
            found: list[str] = []
            given_texts = rows.fillna("").tolist()
            for k in range(0, len(given_texts), together):
                part = given_texts[k : k + together]
                asked = [t for t in part if t.strip()]
                made = iter(beams(own, asked, longest, width))
                found += [own.text(next(made)) if t.strip() else "" for t in part]
            yield pd.Series(found, dtype="object")

    return df.withColumn(out, texts(F.col(source)))


def candidate_texts(sections: DataFrame, score: str = "score", k: int = 3) -> DataFrame:
    """(doc_id, candidate_text): each document's k best sections, the best first, as one text.

    ``sections`` has doc_id, section_index, text and the ranker's score.
    """
    best = top_k(sections.filter(F.trim(F.coalesce("text", F.lit(""))) != ""), ["doc_id"], score, "section_index", k)
    listed = F.array_sort(F.collect_list(F.struct("rank", "text")))
    return best.groupBy("doc_id").agg(F.trim(F.array_join(F.transform(listed, lambda x: x["text"]), " ")).alias("candidate_text"))


def two_stages(docs: DataFrame, sections: DataFrame, model=None, k: int = 3, longest: int = 256) -> DataFrame:
    """``docs`` with ``eligibility``: the best sections, then what the generator makes of them; the sections themselves without a generator.

    A document without sections, or of which nothing is generated, specifies nothing.
    """
    rows = docs.join(candidate_texts(sections, k=k), "doc_id", "left")
    if model is not None:
        rows = generated(rows, "candidate_text", model, "_made", longest)
    said = F.trim(F.coalesce("_made" if model is not None else "candidate_text", F.lit("")))
    return rows.withColumn("eligibility", F.when(said != "", said).otherwise(F.lit(NOT_SPECIFIED))).drop("candidate_text", "_made")
