"""Entities in texts: a structured perceptron that tags tokens B, I or O, and the selection of what its spans name.

Training mixes parameters: each round, every shard of sentences is read in order by one task that starts from the shared
weights, and the shards' averaged weights are averaged again. Weights are an array of fixed size, hashed features by
tag, so what a task holds and what comes to the driver is bounded, whatever the sentences hold. Decoding is over tag
sequences in which I follows B or I only.

Defined cases: null sentences and empty ones take no part in training and have no tags; an I that may not stand where it
does in training data is read as B; equal totals go to the tag that comes first in B, I, O at every step back.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import NOT_SPECIFIED, strip
from ..operators.generators import fuzzy_pick
from ..operators.relations import checkpointed, first_per_key, tag_spans

TAGS = ("B", "I", "O")
#: log2 of the hashed features.
BITS = 18
#: Entities of fewer characters say nothing: a fixed value.
SHORTEST = 3
_FORBIDDEN = -1e18


def features(words: list[str], k: int) -> list[str]:
    """What speaks for the tag of word k: itself, its ends and shape, and its neighbours."""
    word = words[k]
    low = word.lower()
    shape = "".join("A" if c.isupper() else "a" if c.islower() else "0" if c.isdigit() else "-" for c in word[:8])
    before, after = words[k - 1].lower() if k else "<s>", words[k + 1].lower() if k + 1 < len(words) else "</s>"
    return ["1", f"w={low}", f"s={low[-3:]}", f"p={low[:3]}", f"h={shape}", f"b={before}", f"a={after}", f"bw={before} {low}"]


class Tagger:
    """Weights of features by tag and of tags after tags; the last row of ``moves`` is the sentence's start."""

    def __init__(self, weights: np.ndarray | None = None, moves: np.ndarray | None = None, bits: int = BITS):
        self.bits = bits
        self.weights = np.zeros((1 << bits, len(TAGS))) if weights is None else weights
        self.moves = np.zeros((len(TAGS) + 1, len(TAGS))) if moves is None else moves

    def places(self, words: list[str]) -> list[list[int]]:
        mask = (1 << self.bits) - 1
        return [[zlib.crc32(f.encode()) & mask for f in features(words, k)] for k in range(len(words))]

    def scores(self, places: list[list[int]]) -> np.ndarray:
        return np.array([self.weights[p].sum(axis=0) for p in places])

    def decode(self, words: list[str]) -> list[str]:
        return [TAGS[t] for t in self.path(self.scores(self.places(words)))] if words else []

    def path(self, scores: np.ndarray) -> list[int]:
        """The tags of the greatest total among the sequences that are allowed."""
        moves = self.moves.copy()
        moves[[TAGS.index("O"), len(TAGS)], TAGS.index("I")] = _FORBIDDEN
        best, back = scores[0] + moves[-1], []
        for s in scores[1:]:
            into = best[:, None] + moves[:-1]
            back.append(into.argmax(axis=0))
            best = into.max(axis=0) + s
        out = [int(best.argmax())]
        for b in reversed(back):
            out.append(int(b[out[-1]]))
        return out[::-1]


def allowed(tags: list[str]) -> list[str]:
    """The tags with every I that follows neither B nor I read as B."""
    out: list[str] = []
    for t in tags:
        out.append("B" if t == "I" and (not out or out[-1] == "O") else t)
    return out


def _round(sentences: Iterator[tuple[list[str], list[str]]], tagger: Tagger) -> tuple[np.ndarray, np.ndarray, int]:
    """The weights after one pass, averaged over all its steps, and the number of sentences."""
    total_w, total_m, n = np.zeros_like(tagger.weights), np.zeros_like(tagger.moves), 0
    for words, tags in sentences:
        n += 1
        places = tagger.places(words)
        said, true = tagger.path(tagger.scores(places)), [TAGS.index(t) for t in allowed(tags)]
        if said == true:
            continue
        before_s = before_t = len(TAGS)
        for p, s, t in zip(places, said, true, strict=True):
            if s != t:
                for change, tag in ((1.0, t), (-1.0, s)):
                    np.add.at(tagger.weights[:, tag], p, change)
                    # What changes at step n counts for all later steps of the average.
                    np.add.at(total_w[:, tag], p, change * (n - 1))
            if (before_s, s) != (before_t, t):
                for change, (b, x) in ((1.0, (before_t, t)), (-1.0, (before_s, s))):
                    tagger.moves[b, x] += change
                    total_m[b, x] += change * (n - 1)
            before_s, before_t = s, t
    if not n:
        return tagger.weights, tagger.moves, 0
    return tagger.weights - total_w / n, tagger.moves - total_m / n, n


def train(tagged: DataFrame, words: str = "words", tags: str = "tags", rounds: int = 6, shards: int = 8, bits: int = BITS) -> Tagger:
    """A tagger from (words, tags) arrays of equal length.

    Shards are dealt by the sentences' hash and read as streams; each round sends one array of fixed size a shard.
    """
    spark = tagged.sparkSession
    kept = tagged.select(F.col(words).alias("w"), F.col(tags).alias("t")).filter("size(w) > 0 AND size(w) = size(t)")
    order = F.md5(F.to_json(F.struct("w", "t")))
    rows = checkpointed(kept.withColumn("_o", order).repartition(shards, F.expr(f"pmod(conv(substring(_o, 1, 8), 16, 10), {shards})")).sortWithinPartitions("_o").select("w", "t"))
    tagger = Tagger(bits=bits)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((tagger.weights, tagger.moves))  # 2 ** bits rows at most

        def read(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            weights, moves = shared.value
            sentences = ((list(w), list(t)) for b in batches for w, t in zip(b["w"], b["t"], strict=True))
            w, m, n = _round(sentences, Tagger(weights.copy(), moves.copy(), bits))
            if n:
                at = np.flatnonzero(w.any(axis=1))
                yield pd.DataFrame({"at": np.concatenate((at, -1 - np.arange(len(m)))), "v": [*w[at].tolist(), *m.tolist()]})

        mixed = rows.mapInPandas(read, "at long, v array<double>")
        # A row that a shard does not send is 0 there: sums are divided by the shards that read anything.
        sums = [F.sum(F.col("v")[k]).alias(f"v{k}") for k in range(len(TAGS))]
        found = mixed.groupBy("at").agg(F.count(F.lit(1)).alias("n"), *sums).collect()
        active = max((r["n"] for r in found if r["at"] == -1), default=0)
        if not active:
            break
        weights, moves = np.zeros_like(tagger.weights), np.zeros_like(tagger.moves)
        for r in found:
            target, at = (weights, r["at"]) if r["at"] >= 0 else (moves, -1 - r["at"])
            target[at] = [r[f"v{k}"] / active for k in range(len(TAGS))]
        tagger = Tagger(weights, moves, bits)
        shared.unpersist()
    return tagger


def tagged(df: DataFrame, words: str, tagger: Tagger, out: str = "tags") -> DataFrame:
    """``df`` with the tags of an array of words."""
    shared = df.sparkSession.sparkContext.broadcast((tagger.weights, tagger.moves, tagger.bits))

    @F.pandas_udf("array<string>")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights, moves, bits = shared.value
        own = Tagger(weights, moves, bits)
        for rows in batches:
            yield pd.Series([own.decode([w or "" for w in r]) if r is not None else [] for r in rows], dtype="object")

    return df.withColumn(out, decoded(F.col(words)))


def candidates(tokens: DataFrame, doc: str = "doc_id", source: str = "source", place: str = "place", token: str = "token", tag: str = "tag") -> DataFrame:
    """(doc, candidates): each document's entities of its sources in order, the first spelling of those equal in lower case.

    ``source`` numbers title, abstract and keywords; spans do not reach from one into the next.
    """
    spans = tag_spans(tokens, [doc, source], place, tag, token).filter(F.char_length("span") >= SHORTEST)
    spans = spans.withColumn("_low", F.lower("span"))
    first = first_per_key(spans, [doc, "_low"], [source, "begin_at"])
    listed = F.array_sort(F.collect_list(F.struct(F.col(source).alias("s"), F.col("begin_at").alias("p"), F.col("span").alias("x"))))
    return first.groupBy(doc).agg(F.transform(listed, lambda x: x["x"]).alias("candidates"))


def selected(candidates: Column, reply: Column) -> Column:
    """What a selector's reply, names at commas, picks of the candidates; the names themselves where it picks none.

    Without a reply all candidates stand, without candidates nothing is specified.
    """
    names = F.filter(F.transform(F.split(reply, ","), lambda x: strip(x)), lambda x: x != "")
    picked = F.filter(F.transform(names, lambda n: fuzzy_pick(candidates, n)), lambda x: x.isNotNull())
    nothing = F.array(F.lit(NOT_SPECIFIED))
    chosen = F.when(F.size(picked) > 0, picked).when(F.size(names) > 0, names).otherwise(nothing)
    return F.when(F.coalesce(F.size(candidates), F.lit(0)) <= 0, nothing).when(reply.isNull(), candidates).otherwise(chosen)


def conditions(docs: DataFrame, tokens: DataFrame, replies: DataFrame | None = None, doc: str = "doc_id") -> DataFrame:
    """``docs`` with ``conditions``: tagged tokens to spans, to candidates, to what the selector's replies (doc, reply) pick."""
    found = docs.join(candidates(tokens, doc), doc, "left")
    found = found.join(replies.select(doc, "reply"), doc, "left") if replies is not None else found.withColumn("reply", F.lit(None).cast("string"))
    return found.withColumn("conditions", selected(F.col("candidates"), F.col("reply"))).drop("candidates", "reply")
