"""Quality classifier: naive-Bayes support vectors.

Features are presence indicators of n-grams: byte n-grams of 1 to 3 over the lower-cased text, and n-grams of 1 to 4
over word shapes (what a word ends in, whether it shouts, whether it repeats the word before). Each indicator is
scaled by its class log-count ratio, and a linear hinge-loss model is fitted on the scaled indicators by dual
coordinate descent; a logistic of the margin, fitted on the training margins, makes the score.

The model is fitted on at most ``SAMPLE_ROWS`` labelled rows, the smallest by hash of the id; scoring covers every
row and the whole text. Only the text is an input of a score.

Defined cases: a null text is the empty text, whose score comes from the bias alone; labels other than 0 and 1 and
null ids take no part in training; where an id has several labels the larger counts; with one class only in the
labels, every score is that class's share; an empty table gives an empty result; further columns pass through.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name

#: Bound of the training sample, in rows.
SAMPLE_ROWS = 6_000
#: Hashed byte n-grams and word-shape n-grams.
BUCKETS = 1 << 16
SHAPE_BUCKETS = 1 << 12
COST = 1.0
EPOCHS = 12
#: Bytes of text featurised at a time; longer texts go chunk by chunk, so memory stays bounded.
CHUNK = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.uint8)  # 0 letter or byte of one, 1 digit, 2 sentence mark, 3 other ASCII mark
_KIND[48:58] = 1
_KIND[[33, 63]] = 4
_KIND[[44, 46, 58, 59, 39]] = 2
_KIND[[c for c in range(35, 127) if not chr(c).isalnum() and chr(c) not in ",.:;'!?"]] = 3


def _mark(flags: np.ndarray, keys: np.ndarray, base: int, size: int) -> None:
    keys = keys * np.uint32(2654435761)
    keys ^= keys >> np.uint32(15)
    flags[base + (keys & np.uint32(size - 1))] = True


def features(text: str | None, flags: np.ndarray) -> np.ndarray:
    """Sorted numbers of the indicators that the whole text sets. ``flags`` is scratch, all False, and left so."""
    data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    carry, at = None, 0
    while at < len(data):
        end = min(at + CHUNK, len(data))
        if end < len(data) and (gaps := np.flatnonzero(_SPACE[data[at:end]])).size:
            end = at + int(gaps[-1]) + 1  # a chunk ends with a word, unless one word fills it
        part = data[max(0, at - 2) : end]
        low = _LOWER[part].astype(np.uint32)
        low[_SPACE[part]] = 32
        _mark(flags, low + np.uint32(1 << 24), 0, BUCKETS)
        if len(low) > 1:
            _mark(flags, (low[:-1] << np.uint32(8)) + low[1:] + np.uint32(2 << 24), 0, BUCKETS)
        if len(low) > 2:
            _mark(flags, (low[:-2] << np.uint32(16)) + (low[1:-1] << np.uint32(8)) + low[2:] + np.uint32(3 << 24), 0, BUCKETS)
        carry = _shapes(data[at:end], flags, carry)
        at = end
    found = np.flatnonzero(flags)
    flags[found] = False
    return found.astype(np.int32)


def _shapes(part: np.ndarray, flags: np.ndarray, carry):
    """Word-shape n-grams of one chunk; ``carry`` holds the last words' shapes and hash of the chunk before."""
    gap = np.concatenate(([True], _SPACE[part], [True]))
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    begin, end = edge[::2], edge[1::2]
    if not len(begin):
        return carry
    power = _POWERS[: len(part)]
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(part.astype(np.uint64) * power, dtype=np.uint64)))
    word = (total[end] - total[begin]) * _INVERSE[begin]
    last, before = part[end - 1], part[np.maximum(end - 2, begin)]
    upper = np.concatenate((np.zeros(1, np.int64), np.cumsum((part >= 65) & (part <= 90))))
    lower = np.concatenate((np.zeros(1, np.int64), np.cumsum((part >= 97) & (part <= 122))))
    shouts = (upper[end] - upper[begin] > 1) & (lower[end] == lower[begin])
    repeats = word == np.concatenate(([carry[1] if carry else np.uint64(0)], word[:-1]))
    shape = _KIND[last].astype(np.uint32) * 5 + _KIND[before]
    shape = ((shape * 2 + shouts) * 2 + repeats) * 2 + (end - begin == 1) + 1
    shape = shape.astype(np.uint32)
    if carry is not None:
        shape = np.concatenate((carry[0], shape))
    for n in range(1, 5):
        if len(shape) >= n:
            key = np.full(len(shape) - n + 1, n, np.uint32)
            for k in range(n):
                key = key * np.uint32(257) + shape[k : len(shape) - n + 1 + k]
            _mark(flags, key, BUCKETS, SHAPE_BUCKETS)
    return shape[-3:], word[-1]


_BASE = 0x9E3779B97F4A7C15


def _power_table(base: int) -> np.ndarray:
    out = np.full(CHUNK, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS = _power_table(_BASE)
_INVERSE = _power_table(pow(_BASE, -1, 1 << 64))


def fit(rows: list[np.ndarray], labels: list[int], cost: float = COST, epochs: int = EPOCHS) -> dict:
    """From the indicators of each training row to the model: ``weights`` (float32), ``ratio``, ``bias``, ``slope``, ``shift``."""
    total = BUCKETS + SHAPE_BUCKETS
    y = np.where(np.asarray(labels) == 1, 1.0, -1.0)
    n_pos, n_neg = int((y > 0).sum()), int((y < 0).sum())
    if not n_pos or not n_neg:
        share = n_pos / max(1, n_pos + n_neg) if rows else 0.5
        shift = math.log((share + 1e-3) / (1 - share + 1e-3))
        return {"weights": np.zeros(total, np.float32), "bias": 0.0, "slope": 1.0, "shift": shift}
    counts = {s: np.zeros(total) for s in (1.0, -1.0)}
    for row, s in zip(rows, y, strict=True):
        counts[s][row] += 1
    # Log ratio of the smoothed shares of the class's rows that have the indicator.
    ratio = np.log((counts[1.0] + 1) / (n_pos + 2)) - np.log((counts[-1.0] + 1) / (n_neg + 2))
    ratio[counts[1.0] + counts[-1.0] == 0] = 0
    # Rows are scaled to unit length, so that long texts weigh as much as short ones.
    values = [ratio[r] for r in rows]
    values = [v / (np.linalg.norm(v) or 1) for v in values]
    weigh = {1.0: cost * len(rows) / (2 * n_pos), -1.0: cost * len(rows) / (2 * n_neg)}
    w, bias, alpha = np.zeros(total), 0.0, np.zeros(len(rows))
    square = [float(v @ v) + 1 for v in values]
    order = np.random.RandomState(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            grad = y[i] * (w[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - grad / square[i], 0.0), weigh[y[i]])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
    margins = np.array([w[r] @ v + bias for r, v in zip(rows, values, strict=True)])
    slope, shift = _logistic(margins, y, {s: 1 / n for s, n in ((1.0, n_pos), (-1.0, n_neg))})
    return {"weights": (w * ratio).astype(np.float32), "ratio": ratio.astype(np.float32), "bias": bias, "slope": slope, "shift": shift}


def _logistic(margins: np.ndarray, y: np.ndarray, weight: dict) -> tuple[float, float]:
    """Slope and shift of a class-balanced logistic on the margins, by gradient steps; zero margin stays near 0.5."""
    target, each = (y > 0).astype(float), np.where(y > 0, weight[1.0], weight[-1.0]) / 2
    slope, shift = 1.0, 0.0
    for _ in range(300):
        p = 1 / (1 + np.exp(-np.clip(slope * margins + shift, -30, 30)))
        err = (p - target) * each
        slope, shift = min(max(slope - 2 * float(err @ margins), 0.5), 20.0), shift - 2 * float(err.sum())
    return slope, shift


def score(text: str | None, model: dict, flags: np.ndarray) -> float:
    row = features(text, flags)
    margin = model["bias"]
    if len(row) and "ratio" in model:
        length = float(np.sqrt(np.square(model["ratio"][row].astype(np.float64)).sum()))
        margin += float(model["weights"][row].astype(np.float64).sum()) / (length or 1.0)
    z = min(max(model["slope"] * margin + model["shift"], -30.0), 30.0)
    return 1 / (1 + math.exp(-z))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _indicators(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    flags = np.zeros(BUCKETS + SHAPE_BUCKETS, bool)
    for texts in batches:
        yield pd.Series([features(t, flags) for t in texts], dtype="object")


def training_sample(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``sample_rows`` labelled ids' rows (doc_id, indicators, quality); the held-out third takes no part."""
    known = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.filter(~held_out(F.col("doc_id")))
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(sample_rows)
    # At most sample_rows rows of two numbers.
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # Ids that repeat may bring more rows than asked for; those that stay are the first by the text's hash.
    found = found.orderBy("doc_id", F.xxhash64("text"), "text").limit(2 * sample_rows)
    return found.select("doc_id", _indicators("text").alias("indicators"), "quality")


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> dict:
    """The fitted model; the driver sees indicators of the bounded sample, as Arrow buffers, and no texts."""
    sample = training_sample(docs, labels, sample_rows).toArrow()
    ids, quality = (sample.column(c).to_numpy() for c in ("doc_id", "quality"))
    lists = sample.column("indicators").combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    rows = [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    order = sorted(range(len(rows)), key=lambda k: (ids[k], hashlib.md5(rows[k].tobytes()).digest()))
    return fit([rows[k] for k in order], [int(quality[k]) for k in order])


def with_scores(docs: DataFrame, labels: DataFrame, score_col: str = "score", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs``, all columns, with ``score_col`` in 0 to 1: how likely the label is 1; a name in use gets underscores in front."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample_rows))

    @F.pandas_udf(T.DoubleType())
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        flags = np.zeros(BUCKETS + SHAPE_BUCKETS, bool)
        for texts in batches:
            yield pd.Series([score(t, model.value, flags) for t in texts], dtype="float64")

    return docs.withColumn(free_name(docs, score_col), scored(F.col("text")))
