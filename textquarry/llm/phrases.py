"""Phrase collocations by hash-pruned passes over the corpus.

Pass k counts phrases of k words exactly. While it does, it also counts the phrases of k + 1 words by hash bucket; buckets
that stay below the threshold can hold no frequent phrase. The next pass looks only at phrases whose bucket is set and both
of whose parts of k words are frequent. Both tests are bitmaps of 2 ** ``bits`` bits, whatever the corpus holds, so what is
broadcast and what goes to the driver is bounded; a bit set wrongly costs time and no exactness, as what passes is counted
by its words.

A task holds a window of text, one counter of phrases that is put out whenever it reaches ``HELD`` entries, and one array of
bucket counts, which stop at the threshold, as more says nothing. Counters are summed by Spark; bucket arrays in
two steps, by groups of tasks.

Defined cases: a null text is empty; a null language is ``und``; a piece of any length is read in windows that overlap by
what a phrase needs; repeated rows count as often as they stand; an empty table gives an empty result; further columns
take no part; a language without frequent phrases gives no row.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, scratch, written

#: Words in a phrase, at most.
WORDS = 5
#: log2 of the buckets. More buckets prune better in larger corpora, and cost each task as many bytes.
BITS = 22
#: Entries of a task's counter before it is put out, and bytes of text in a window.
HELD, WINDOW = 100_000, 1 << 18
#: Rows that are joined to one buffer before it is cut into windows.
ROWS = 500
#: Buckets that are sent as one row; tasks whose rows are summed together first.
CHUNK, TASKS = 1 << 14, 256

#: Pieces end at these, words at spaces and tabs; A-Z are lower-cased.
_TABLE = bytearray(range(256))
for _c in b".,;:!?\x0a\x0b\x0c\x0d":
    _TABLE[_c] = 0x0A
_TABLE[0x09] = 0x20
for _c in range(ord("A"), ord("Z") + 1):
    _TABLE[_c] = _c + 32

_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2 ** 64."""
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = np.full(n, _BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return (h ^ (h >> np.uint64(29))) * _MIX


class Words:
    """The words of one window: where they start and end, whether a piece ends after each, and a hash of each."""

    __slots__ = ("data", "start", "end", "last", "hash")

    def __init__(self, data: bytes, seed: int):
        a = np.frombuffer(data, np.uint8)
        word = np.zeros(len(a) + 2, bool)
        word[1:-1] = (a != 0x20) & (a != 0x0A)
        edge = np.flatnonzero(word[1:] != word[:-1])
        self.data, self.start, self.end = data, edge[::2], edge[1::2]
        lines = np.concatenate((np.zeros(1, np.int64), np.cumsum(a == 0x0A)))
        self.last = np.ones(len(self.start), bool)
        self.last[:-1] = lines[self.start[1:]] != lines[self.end[:-1]]
        up, down = _powers(max(WINDOW, 1 << int(len(a)).bit_length()))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[: len(a)], dtype=np.uint64)))
        self.hash = _mixed((sums[self.end] - sums[self.start]) * down[self.start] + np.uint64(seed))

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes): for each word, whether a phrase of k words starts there, and its hash (any value where none does)."""
        n = len(self.start)
        fits, h = np.zeros(n, bool), self.hash.copy()
        if n >= k:
            fits[: n - k + 1] = True
            for j in range(k - 1):
                fits[: n - k + 1] &= ~self.last[j : n - k + 1 + j]
                h[: n - k + 1] = _mixed(h[: n - k + 1] * np.uint64(0x2545F4914F6CDD1D) + self.hash[j + 1 : n - k + 2 + j])
        return fits, h

    def phrases(self, places: np.ndarray, k: int) -> list[bytes]:
        """The phrases of k words at the places, single-spaced."""
        data, starts, ends = self.data, self.start[places], self.end[places + k - 1]
        found = [data[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
        sizes = np.concatenate((np.zeros(1, np.int64), np.cumsum(self.end - self.start)))
        for x in np.flatnonzero(ends - starts != sizes[places + k] - sizes[places] + k - 1).tolist():
            found[x] = b" ".join(found[x].split())
        return found


_WORD = re.compile(rb"[^ \n]+")


def windows(texts: list[bytes], overlap: int = WORDS, size: int = WINDOW) -> Iterator[tuple[bytes, int]]:
    """(bytes, words that stood in the window before): joined texts, cut between pieces; a longer piece between words.

    A window that ends inside a piece is followed by one that starts with its last ``overlap`` words.
    """
    data, at, again = b"\n".join(texts).translate(bytes(_TABLE)), 0, 0
    while at < len(data):
        end, after = at, 0
        while True:
            end += size
            cut = then = data.rfind(b"\n", at, end) + 1 if end < len(data) else len(data)
            if cut:
                break
            cut = data.rfind(b" ", at, end)
            starts = [m.start() for m in _WORD.finditer(data, at, cut)] if cut > at else []
            if len(starts) > overlap:
                then, after = starts[-overlap], overlap
                break
        yield data[at:cut], again
        at, again = then, after


def _tested(bitmap: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    at = h >> np.uint64(64 - bits)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & np.uint8(1) == 1


def _seed(lang: str) -> int:
    return zlib.crc32(lang.encode()) * 0x9E3779B1


_ROWS = "lang string, phrase string, n long, chunk int, task int, counts binary"


def _packed(table: np.ndarray, least: int) -> Iterator[tuple[int, bytes]]:
    """(chunk, counts) of the chunks that hold any, each count at most ``least``."""
    small = np.minimum(table, least).astype(np.uint8 if least < 256 else np.uint32)
    for c in range(0, len(small), CHUNK):
        part = small[c : c + CHUNK]
        if part.any():
            yield c // CHUNK, zlib.compress(part.tobytes(), 1)


def _summed(rows: DataFrame, bits: int, least: int) -> np.ndarray:
    """The bitmap of buckets whose counts, summed over all tasks, reach ``least``; 2 ** bits bits come to the driver."""
    kind = np.uint8 if least < 256 else np.uint32

    def total(parts: pd.Series) -> np.ndarray:
        table = np.zeros(min(CHUNK, 1 << bits), np.uint32)
        for x in parts:
            table += np.frombuffer(zlib.decompress(x), kind)
        return np.minimum(table, least)

    def some(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"chunk": group["chunk"].iloc[:1], "counts": [zlib.compress(total(group["counts"]).astype(kind).tobytes(), 1)]})

    def every(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"chunk": group["chunk"].iloc[:1], "bitmap": [np.packbits(total(group["counts"]) >= least).tobytes()]})

    first = rows.groupBy("chunk", F.expr(f"task div {TASKS}").alias("tasks")).applyInPandas(some, "chunk int, counts binary")
    bitmap = np.zeros((1 << bits) // 8, np.uint8)
    for row in first.groupBy("chunk").applyInPandas(every, "chunk int, bitmap binary").collect():
        part = np.frombuffer(row["bitmap"], np.uint8)
        bitmap[row["chunk"] * CHUNK // 8 :][: len(part)] = part
    return bitmap


def _counted(texts: DataFrame, k: int, longest: int, bits: int, least: int, buckets: np.ndarray | None, frequent: np.ndarray | None) -> DataFrame:
    """Pass k: (lang, phrase, n) of phrases in part sums, (lang, null, n) of all words, (chunk, task, counts) of the next buckets."""
    spark = texts.sparkSession
    maps = spark.sparkContext.broadcast((buckets, frequent))  # 2 ** bits bits each

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, frequent = maps.value
        held: dict[str, Counter] = {}
        words: Counter = Counter()
        table = np.zeros(1 << bits, np.uint32)

        def rows() -> pa.RecordBatch:
            found = [(lang, p, n) for lang, c in held.items() for p, n in c.items()]
            held.clear()
            cols = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.binary()).cast(pa.string()), pa.array([x[2] for x in found], pa.int64())]
            cols += [pa.nulls(len(found), t) for t in (pa.int32(), pa.int32(), pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["lang", "phrase", "n", "chunk", "task", "counts"])

        for b in (whole.slice(k, ROWS) for whole in batches for k in range(0, whole.num_rows, ROWS)):
            by_lang: dict[str, list[bytes]] = {}
            for lang, text in zip(b["lang"].to_pylist(), b["text"].to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(text)
            for lang, parts in by_lang.items():
                counter, seed = held.setdefault(lang, Counter()), _seed(lang)
                for data, again in windows(parts, longest):
                    w = Words(data, seed)
                    size = len(w.start)
                    fits, h = w.grams(k)
                    if k > 1:
                        shorter = _tested(frequent, w.grams(k - 1)[1], bits)
                        fits[:-1] &= shorter[:-1] & shorter[1:]
                        fits &= _tested(buckets, h, bits)
                    # What lies wholly in the words of the window before has been counted there.
                    fresh = fits & (np.arange(size) + k > again)
                    if k == 1:
                        words[lang] += int(fresh.sum())
                    counter.update(w.phrases(np.flatnonzero(fresh), k))
                    if k < longest:
                        longer, g = w.grams(k + 1)
                        longer[:-1] &= fits[:-1] & fits[1:]
                        longer &= np.arange(size) + k + 1 > again
                        np.add.at(table, (g[longer] >> np.uint64(64 - bits)).astype(np.int64), 1)
                    if sum(map(len, held.values())) >= HELD:
                        yield rows()
                        counter = held.setdefault(lang, Counter())
        yield rows()
        task = TaskContext.get().partitionId()
        found = list(_packed(table, least)) if k < longest else []
        ends = [(lang, n, None, None) for lang, n in words.items()] + [(None, None, c, x) for c, x in found]
        if ends:
            cols = [pa.array([x[0] for x in ends], pa.string()), pa.nulls(len(ends), pa.string()), pa.array([x[1] for x in ends], pa.int64())]
            cols += [pa.array([x[2] for x in ends], pa.int32()), pa.array([task] * len(ends), pa.int32()), pa.array([x[3] for x in ends], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["lang", "phrase", "n", "chunk", "task", "counts"])

    return texts.mapInArrow(count, _ROWS)


def _bits_of(phrases: DataFrame, k: int, bits: int) -> np.ndarray:
    """The bitmap of the hashes of (lang, phrase), phrases of k words."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << bits, np.uint32)
        for b in batches:
            by_lang: dict[str, list[bytes]] = {}
            for lang, phrase in zip(b["lang"].to_pylist(), b["phrase"].to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(phrase.encode())
            for lang, parts in by_lang.items():
                for data, _ in windows(parts):
                    fits, h = Words(data, _seed(lang)).grams(k)
                    table[(h[fits] >> np.uint64(64 - bits)).astype(np.int64)] = 1
        found = list(_packed(table, 1))
        if found:
            cols = [pa.array([x[0] for x in found], pa.int32()), pa.array([TaskContext.get().partitionId()] * len(found), pa.int32()), pa.array([x[1] for x in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["chunk", "task", "counts"])

    return _summed(phrases.select("lang", "phrase").mapInArrow(mark, "chunk int, task int, counts binary"), bits, 1)


def frequent_phrases(
    docs: DataFrame, least: int = 100, longest: int = WORDS, text_col: str = "text", lang_col: str = "lang", bits: int = BITS
) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all phrases of 1 to ``longest`` words that occur ``least`` times or more, and (lang, n) of all words."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("binary").alias("text")).filter("text IS NOT NULL")
    buckets = frequent = total = None
    found = []
    for k in range(1, longest + 1):
        path = scratch(spark)
        rows = written(_counted(texts, k, longest, bits, least, buckets, frequent), path=path)
        if total is None:
            total = written(rows.filter("phrase IS NULL AND lang IS NOT NULL").groupBy("lang").agg(F.sum("n").alias("n")))
        counts = rows.filter("phrase IS NOT NULL").groupBy("lang", "phrase").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
        found.append(written(counts.select("lang", "phrase", F.lit(k).alias("words"), "f")))
        if k < longest:
            buckets = _summed(rows.filter("counts IS NOT NULL"), bits, least)
            frequent = _bits_of(found[-1], k, bits)
        discard(spark, path)
        if k < longest and not buckets.any():
            break
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    return every, total


def collocations(
    docs: DataFrame,
    least: int = 100,
    top: int = 2000,
    absorbed: int = 100,
    longest: int = WORDS,
    text_col: str = "text",
    lang_col: str = "lang",
    bits: int = BITS,
) -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    A phrase's score is the least, over its cuts in two, of floor(1000 * a * n / (l * r)); it is dropped where a longer
    frequent phrase that holds it occurs at least ``absorbed`` per cent as often. Counts of holding phrases never grow with
    length, so only phrases of one word more need be looked at.
    """
    every, total = frequent_phrases(docs, least, longest, text_col, lang_col, bits)
    word = F.split("phrase", " ")
    joined = lambda start, n: F.array_join(F.slice(word, start, n), " ")
    candidates = every.filter("words > 1")
    ends = candidates.select("lang", F.explode(F.array(joined(F.lit(1), F.col("words") - 1), joined(F.lit(2), F.col("words") - 1))).alias("phrase"), "f")
    longer = ends.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = candidates.join(longer, ["lang", "phrase"], "left").filter(F.expr(f"longer IS NULL OR 100 * longer < {absorbed} * f"))
    kept = written(kept.select("lang", "phrase", "words", F.col("f").alias("a")))
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("head"), joined(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    part = lambda name, value: every.select("lang", F.col("phrase").alias(name), F.col("f").alias(value))
    cuts = cuts.join(part("head", "l"), ["lang", "head"]).join(part("rest", "r"), ["lang", "rest"]).join(total, "lang")
    # Exact: a product of these digits fits 38.
    exact = lambda name, digits: F.col(name).cast(f"decimal({digits},0)")
    above = exact("a", 14) * exact("n", 16) * F.lit(1000).cast("decimal(4,0)")
    cuts = cuts.withColumn("above", above).withColumn("under", exact("l", 16) * exact("r", 16)).withColumn("score", F.expr("above div under"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("cut")).select("lang", "phrase", "cut.*")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return best.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
