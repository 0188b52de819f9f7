"""SentencePiece encoding and decoding by a relational lattice and a Viterbi fold.

The text, with one space in front, is cut into words where no piece of the table can cross. Distinct words are
counted; the ``DICTIONARY_WORDS`` most frequent ones are encoded by relations: their substrings of bounded length are
exploded, equi-joined to the piece table (whose size the model file fixes), the edges found are grouped by word, and a
higher-order aggregate folds them into the segmentation that the model's algorithm asks for. For unigram models that is
Viterbi: the highest total score, ties going to the longer last piece. The scores of BPE models are ranks of merges,
whose best sum is not what such a model encodes; there the fold takes, edge by edge, the merge of the highest score,
the leftmost of equals. Characters in no piece become their UTF-8 bytes' pieces. The dictionary that results has a bounded size, so it
is broadcast, and each document is encoded where it lies, without a shuffle of texts; words beyond the dictionary, and
those longer than ``LATTICE_CHARS``, go through the same algorithm in the worker.

Ids are those of the SentencePiece library for the same file, for either kind of model.

No word goes on after a character that a space follows, so texts are cut at their single spaces first, and each distinct
stretch between two of them is looked up as a word or cut into words once while a worker remembers it. Each distinct
word is encoded, decoded and compared once. Texts with runs of spaces, or spaces at an end, are cut into words as a whole.

Decoding joins the pieces' bytes, turns the marker into a space and drops the space in front: decoding what was
encoded gives back every text exactly, U+2581 included, which encoding treats as a character without a piece. As the
bytes of a text are those of its words in turn, a text between whose words nothing is lost comes back whole if each of
its words does.

Defined cases: where a column of the asked name exists in any case, the new one gets underscores in front; null and empty texts have no ids and decode to the empty text; an id outside the table raises; repeated
rows are encoded one by one; an empty table gives an empty result; further columns pass through.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, written

#: Words that go through the relational lattice, and so the size of what is broadcast.
DICTIONARY_WORDS = 1 << 18
#: Longer words are encoded in the worker: a fold over n positions looks at n times as many edges.
LATTICE_CHARS = 40
#: In longer words merges are found by a heap, in shorter ones by a scan of all pairs, which takes less time there.
SCANNED_CHARS = 64
#: Pieces in a table that may be broadcast.
MOST_PIECES = 1 << 19
#: Distinct words and stretches that a worker counts before it hands them on.
COUNTED = 200_000
#: Bytes of words beyond the dictionary, and of each half of the stretches between spaces, that a worker remembers, with what an
#: entry takes besides its text and ids; and the longest of these.
REMEMBERED_BYTES, ENTRY_BYTES = 40 << 20, 220
LONGEST_REMEMBERED = 100
#: Characters of a text after which a worker hands on what it has counted.
LONG_TEXT = 1 << 20
#: Rows of an Arrow batch that a worker encodes before it passes them on.
ROWS_AT_A_TIME = 500
UNKNOWN_PENALTY = 10.0
MARKER = "▁"
#: From fine to coarse; the first that cuts no piece of the table is used.
PATTERNS = (r" *[A-Za-zÀ-ÖØ-öø-ɏ]+| *[^A-Za-zÀ-ÖØ-öø-ɏ \n]+| +|\n", r" *[^ \n]+| +|\n", r"(?s).+")
#: Numbers of the fields and piece types in a model file.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """(number, value) of each field of one serialized message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[at : at + size]
            at += size


@dataclass(frozen=True)
class Model:
    """A piece table: ``scores`` by piece (marker as space) with its id, bytes' ids, and each id's bytes."""

    scores: dict[str, tuple[int, float]]
    byte_ids: tuple[int, ...]
    unknown_id: int
    unknown_score: float
    pieces: tuple[bytes, ...]
    longest: int
    prefix: str
    pattern: str
    merges: bool

    @cached_property
    def costs(self) -> dict[str, float]:
        """Each piece's score with the sign changed: the merge that comes first costs least."""
        return {piece: -score for piece, (_, score) in self.scores.items()}


def load_model(path: str) -> Model:
    """The model in the file at ``path``, which only the driver reads."""
    with open(path, "rb") as file:
        data = file.read()
    table, prefix, kind = [], True, UNIGRAM
    for number, value in fields(data):
        if number == PIECES:
            piece = dict(fields(value))
            table.append((piece.get(1, b"").decode(), float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0]), piece.get(3, NORMAL)))
        elif number == TRAINER:
            kind = dict(fields(value)).get(3, UNIGRAM)
        elif number == NORMALIZER:
            spec = dict(fields(value))
            if spec.get(2) or spec.get(4, 1):
                raise ValueError("models that rewrite characters or drop spaces are not supported: they have no exact round trip")
            prefix = bool(spec.get(3, 1))
    if kind not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models are supported")
    return make_model(table, prefix, kind == BPE)


def make_model(table: list[tuple[str, float, int]], prefix: bool = True, merges: bool = False) -> Model:
    """From (piece, score, type) in the order of ids."""
    if len(table) > MOST_PIECES:
        raise ValueError(f"more than {MOST_PIECES} pieces")
    scores, byte_ids, unknown, pieces = {}, {}, 0, []
    for k, (piece, score, kind) in enumerate(table):
        pieces.append(piece.replace(MARKER, " ").encode())
        if kind in (NORMAL, USER_DEFINED):
            scores.setdefault(piece.replace(MARKER, " "), (k, score))
        elif kind == BYTE:
            byte_ids[int(piece[3:5], 16)] = k
            pieces[-1] = bytes([int(piece[3:5], 16)])
        elif kind == UNKNOWN:
            unknown, pieces[-1] = k, " ⁇ ".encode()
        else:
            pieces[-1] = b""
    pattern = next(p for p in PATTERNS if p == PATTERNS[-1] or all(re.findall(p, x) == [x] for x in scores))
    least = min((s for _, s in scores.values()), default=0.0)
    whole = tuple(byte_ids[b] for b in range(256)) if len(byte_ids) == 256 else ()
    return Model(scores, whole, unknown, least - UNKNOWN_PENALTY, tuple(pieces), max(map(len, scores), default=1), " " if prefix else "", pattern, merges)


def encode_word(word: str, model: Model) -> list[int]:
    """A word's ids, in the worker."""
    if not model.merges:
        parts = [word[start:end] for start, end in viterbi(word, model)]
    else:
        parts = scanned(word, model.costs) if len(word) <= SCANNED_CHARS else merged(word, model)
    ids: list[int] = []
    for part in parts:
        found = model.scores.get(part)
        if found:
            ids.append(found[0])
        elif model.byte_ids:
            ids += [model.byte_ids[b] for b in part.encode("utf-8", "replace")]
        else:
            ids.append(model.unknown_id)
    return ids


def viterbi(word: str, model: Model) -> list[tuple[int, int]]:
    """(start, end) of the best path: for each end the best start, the earlier one where totals are equal."""
    n = len(word)
    best, back = [0.0] + [-np.inf] * n, [0] * (n + 1)
    for start in range(n):
        base, single = best[start], False
        for end in range(start + 1, min(n, start + model.longest) + 1):
            found = model.scores.get(word[start:end])
            if found:
                single |= end == start + 1
                if base + found[1] > best[end]:
                    best[end], back[end] = base + found[1], start
        if not single and base + model.unknown_score > best[start + 1]:
            best[start + 1], back[start + 1] = base + model.unknown_score, start
    path = []
    while n:
        path.append((back[n], n))
        n = back[n]
    return path[::-1]


def scanned(word: str, costs: dict[str, float]) -> list[str]:
    """The symbols after all merges, the least cost first, the leftmost of equals; each merge scans all pairs."""
    parts, none = list(word), np.inf
    cost = [costs.get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
    while cost and (least := min(cost)) < none:
        k = cost.index(least)
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
        del cost[k]
        if k:
            cost[k - 1] = costs.get(parts[k - 1] + parts[k], none)
        if k < len(cost):
            cost[k] = costs.get(parts[k] + parts[k + 1], none)
    return parts


def merged(word: str, model: Model) -> list[str]:
    """What ``scanned`` gives, in n log n steps, for words of any length."""
    n, scores = len(word), model.scores
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of each symbol, by its first character
    heap: list[tuple[float, int, int]] = []

    def offer(left: int) -> None:
        if left >= 0 and after[left] < n:
            end = after[after[left]]
            found = scores.get(word[left:end]) if end - left <= model.longest else None
            if found:
                heapq.heappush(heap, (-found[1], left, end))

    for k in range(n - 1):
        offer(k)
    while heap:
        _, left, end = heapq.heappop(heap)
        right = after[left] if left == 0 or after[before[left]] == left else n
        if right >= n or after[right] != end or before[right] != left:
            continue  # one of the two has merged with another meanwhile
        after[left] = end
        before[right] = -2
        if end < n:
            before[end] = left
        offer(before[left])
        offer(left)
    path, at = [], 0
    while at < n:
        path.append(word[at : after[at]])
        at = after[at]
    return path


def decode_ids(ids, model: Model) -> str:
    text = b"".join([model.pieces[i] for i in ids]).decode("utf-8", "replace")
    return text[len(model.prefix) :] if text.startswith(model.prefix) else text


def spaced(text: str, model: Model) -> bool:
    """Whether the text's words are those of its stretches between single spaces, each with one space in front."""
    return model.prefix == " " and model.pattern != PATTERNS[-1] and text[0] != " " and text[-1] != " " and "  " not in text


def word_counts(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """(word, n) of all words of up to ``LATTICE_CHARS`` in all texts, pre-aggregated in the worker."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = re.compile(model.pattern).findall
        stretches: Counter = Counter()
        words: Counter = Counter()

        def counted() -> pa.RecordBatch:
            for stretch, n in stretches.items():
                for word in cut(" " + stretch):
                    words[word] += n
            kept = [(w, n) for w, n in words.items() if len(w) <= LATTICE_CHARS]
            stretches.clear()
            words.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                text = text.as_py()
                if not text:
                    continue
                if spaced(text, model):
                    stretches.update(text.split(" "))
                else:
                    words.update(cut(model.prefix + text))
                if len(stretches) + len(words) > COUNTED or len(text) > LONG_TEXT:
                    yield counted()
        yield counted()

    return docs.select(F.col(text_col)).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """At most ``most`` words, none of them rarer than a word left out by a factor of 2 ** (1/8) or more."""
    grade = F.floor(F.log2("n") * 8)
    graded = counts.groupBy(grade.alias("grade")).count().orderBy(F.desc("grade")).collect()  # a few hundred rows at most
    held, least = 0, None
    for row in graded:
        held += row["count"]
        if held > most:
            break
        least = row["grade"]
    return counts.filter(grade >= F.lit(least)) if least is not None else counts.limit(0)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` names it, inside lambdas too."""
    return F.get(F.transform(F.array(value), body), 0)


def lattice(words: DataFrame, model: Model) -> DataFrame:
    """(word, ids) of distinct words: substrings, equi-join with the pieces, edges by word, Viterbi fold."""
    spark = words.sparkSession
    table = pd.DataFrame([(p, i, s) for p, (i, s) in model.scores.items()], columns=["piece", "id", "score"])
    pieces = F.broadcast(spark.createDataFrame(table, "piece string, id int, score double"))  # at most MOST_PIECES rows
    last = F.char_length("word")
    spans = F.flatten(
        F.transform(
            F.sequence(F.lit(0), last - 1),
            lambda s: F.transform(
                F.sequence(F.lit(1), F.least(F.lit(model.longest), last - s)),
                lambda n: F.struct(s.alias("start"), (s + n).alias("end"), F.substring(F.col("word"), s + 1, n).alias("piece")),
            ),
        )
    )
    cut = words.select("word", F.inline(spans))
    known = F.col("id").isNotNull()
    edges = cut.join(pieces, "piece", "left").filter(known | (F.col("end") == F.col("start") + 1))
    edge = F.struct(
        "end", "start", F.coalesce("score", F.lit(model.unknown_score)).alias("score"), F.coalesce("id", F.lit(-1)).alias("id")
    )
    grouped = edges.groupBy("word").agg(F.collect_list(edge).alias("edges")).withColumn("n", F.char_length("word"))

    def step(acc, end):
        # The largest total; of equal totals the smallest start, which is the longest piece.
        reach = F.transform(
            F.filter(F.col("edges"), lambda e: e["end"] == end),
            lambda e: F.struct((F.element_at(acc["best"], e["start"] + 1) + e["score"]).alias("total"), (-e["start"]).alias("back"), e["id"].alias("id")),
        )
        top = F.array_max(reach)
        return F.struct(
            F.array_append(acc["best"], top["total"]).alias("best"), F.array_append(acc["back"], F.struct((-top["back"]).alias("start"), top["id"].alias("id"))).alias("back")
        )

    segment = "array<struct<start:int,end:int,id:int>>"
    if model.merges:

        def merge(acc, _):
            # Edges over exactly two of the present symbols; the best one's inner cut goes, with all edges that need it.
            cuts, edges = acc["cuts"], acc["edges"]
            open_ = F.filter(edges, lambda e: F.get(cuts, F.array_position(cuts, e["start"]).cast("int") + 1) == e["end"])
            top = F.array_max(F.transform(open_, lambda e: F.struct(e["score"].alias("score"), (-e["start"]).alias("back"), e["end"].alias("end"))))

            def join(best):
                inner = F.get(cuts, F.array_position(cuts, -best["back"]).cast("int"))
                merged_pair = F.struct((-best["back"]).alias("first"), best["end"].alias("last"), inner.alias("inner"))
                return _let(merged_pair, without)

            def without(m):
                left = F.filter(edges, lambda e: (e["start"] != m["inner"]) & (e["end"] != m["inner"]) & ((e["start"] != m["first"]) | (e["end"] != m["last"])))
                return F.struct(F.array_remove(cuts, m["inner"]).alias("cuts"), left.alias("edges"))

            done = F.struct(cuts.alias("cuts"), F.slice(edges, 1, 0).alias("edges"))
            return F.when(F.size(edges) == 0, acc).otherwise(_let(top, lambda best: F.when(best.isNull(), done).otherwise(join(best))))

        wide = F.filter(F.col("edges"), lambda e: e["end"] - e["start"] > 1)
        start = F.struct(F.sequence(F.lit(0), F.col("n")).alias("cuts"), wide.alias("edges"))
        folded = grouped.withColumn("cuts", F.aggregate(F.sequence(F.lit(1), F.col("n")), start, merge, lambda acc: acc["cuts"]))
        whole = lambda c, e: F.get(F.filter(F.col("edges"), lambda x: (x["start"] == c) & (x["end"] == e)), 0)["id"]
        path = F.transform(
            F.slice("cuts", 1, F.size("cuts") - 1),
            lambda c, k: F.struct(c.alias("start"), F.get("cuts", k + 1).alias("end"), whole(c, F.get("cuts", k + 1)).alias("id")),
        )
        traced = folded.withColumn("path", path.cast(segment))
    else:
        start = F.struct(F.array(F.lit(0.0)).alias("best"), F.array().cast("array<struct<start:int,id:int>>").alias("back"))
        folded = grouped.withColumn("back", F.aggregate(F.sequence(F.lit(1), F.col("n")), start, step, lambda acc: acc["back"]))

        def retrace(acc, _):
            here = F.element_at(F.col("back"), F.greatest(acc["at"], F.lit(1)))
            done = acc["at"] == 0
            path = F.when(done, acc["path"]).otherwise(F.concat(F.array(F.struct(here["start"].alias("start"), acc["at"].alias("end"), here["id"].alias("id"))), acc["path"]))
            return F.struct(F.when(done, F.lit(0)).otherwise(here["start"]).alias("at"), path.alias("path"))

        none = F.struct(F.col("n").alias("at"), F.array().cast(segment).alias("path"))
        traced = folded.withColumn("path", F.aggregate(F.sequence(F.lit(1), F.col("n")), none, retrace, lambda acc: acc["path"]))
    if model.byte_ids:
        ids_of = F.array(*[F.lit(i) for i in model.byte_ids])
        char = lambda p: F.hex(F.encode(F.substring(F.col("word"), p["start"] + 1, F.lit(1)), "UTF-8"))
        spelled = lambda p: F.transform(F.regexp_extract_all(char(p), F.lit("(..)")), lambda x: F.element_at(ids_of, F.conv(x, 16, 10).cast("int") + 1))
    else:
        spelled = lambda p: F.array(F.lit(model.unknown_id))
    ids = F.flatten(F.transform("path", lambda p: F.when(p["id"] >= 0, F.array(p["id"])).otherwise(spelled(p))))
    return traced.select("word", ids.alias("ids"))


def dictionary(docs: DataFrame, model: Model, text_col: str = "text", most: int = DICTIONARY_WORDS) -> DataFrame:
    """(word, ids) of the frequent words of all texts."""
    counts = written(word_counts(docs, model, text_col))
    return lattice(frequent(counts, most).select("word"), model)


class Codec:
    """A worker's view of the model and the dictionary; made once for each worker process."""

    made: dict[int, "Codec"] = {}

    def __init__(self, model: Model, words: Iterable[str], ids: Iterable[bytes]):
        self.model, self.cut = model, re.compile(model.pattern).findall
        # Words of the dictionary that decoding gives back, those with a space in front under what follows it; and the others.
        self.led, self.bare, self.odd = {}, {}, {}
        for word, found in zip(words, ids, strict=True):
            if not self.whole(word, found):
                self.odd[word] = found
            elif word[0] == " ":
                self.led[word[1:]] = found
            else:
                self.bare[word] = found
        self.extra: dict[str, bytes] = {}
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.extra_bytes = self.memo_bytes = 0
        self.strange = False

    @classmethod
    def of(cls, shared) -> "Codec":
        if shared.id not in cls.made:
            model, words, sizes, ids = shared.value
            ends = np.cumsum(sizes) * 4
            cls.made.clear()
            # One by one: lists of all words and ids would be held beside the tables that are made of them.
            each = (w.group() for w in re.finditer("[^\0]+", words))
            cls.made = {shared.id: cls(model, each, (ids[e - 4 * n : e] for e, n in zip(ends, sizes, strict=True)))}
        return cls.made[shared.id]

    def whole(self, word: str, ids: bytes) -> bool:
        """Whether decoding the ids gives back the word."""
        return b"".join([self.model.pieces[i] for i in struct.unpack(f"<{len(ids) // 4}i", ids)]) == word.encode("utf-8", "replace")

    def word(self, word: str) -> bytes:
        """A word's ids; one that decodes to anything else is noted."""
        found = (self.led.get(word[1:]) if word[0] == " " else self.bare.get(word)) or self.extra.get(word)
        if found is None:
            found = self.odd.get(word)
            if found is None:
                ids = encode_word(word, self.model)
                found = struct.pack(f"<{len(ids)}i", *ids)
            if not self.whole(word, found):
                self.strange = True
            elif len(word) <= LATTICE_CHARS:
                if self.extra_bytes >= REMEMBERED_BYTES:
                    self.extra.clear()
                    self.extra_bytes = 0
                self.extra[word] = found
                self.extra_bytes += ENTRY_BYTES + len(word) + len(found)
        return found

    def stretch(self, stretch: str) -> bytes:
        """The ids of a stretch between spaces, with a space in front; those of several words are remembered."""
        spelled = " " + stretch
        found = self.extra.get(spelled)
        if found is not None:
            return found
        found = self.older.get(stretch)
        if found is None:
            words = self.cut(spelled)
            if len(words) == 1 and words[0] == spelled:
                return self.word(spelled)
            found = b"".join([self.word(w) for w in words])
            self.strange |= "".join(words) != spelled
            if self.strange:
                return found
        if len(stretch) <= LONGEST_REMEMBERED:
            self.memo[stretch] = found
            self.memo_bytes += ENTRY_BYTES + len(stretch) + len(found)
        return found

    def encode(self, text: str | None) -> tuple[np.ndarray, bool]:
        """A text's ids, and whether decoding them gives it back."""
        if not text:
            return np.zeros(0, "<i4"), True
        if self.memo_bytes >= REMEMBERED_BYTES:
            # What comes again moves back from the older half; the rest is forgotten with it.
            self.older, self.memo, self.memo_bytes = self.memo, {}, 0
        self.strange = False
        if spaced(text, self.model):
            known, met, other = self.led.get, self.memo.get, self.stretch
            ids = np.frombuffer(b"".join([known(x) or met(x) or other(x) for x in text.split(" ")]), "<i4")
            return ids, not self.strange or decode_ids(ids.tolist(), self.model) == text
        ids = np.frombuffer(b"".join([self.word(w) for w in self.cut(self.model.prefix + text)]), "<i4")
        return ids, decode_ids(ids.tolist(), self.model) == text


def _shared(docs: DataFrame, model: Model, text_col: str, most: int):
    """The model and the dictionary, at most ``most`` words, as a broadcast."""
    # As Arrow buffers: an object for each word's ids would take several times the memory in the driver.
    found = dictionary(docs, model, text_col, most).filter(~F.contains("word", F.lit("\0"))).toArrow()
    lists = found.column("ids").combine_chunks()
    lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks)
    sizes, ids = np.diff(lists.offsets.to_numpy()).astype(np.int64), lists.flatten().to_numpy(zero_copy_only=False).astype("<i4").tobytes()
    return docs.sparkSession.sparkContext.broadcast((model, "\0".join(found.column("word").to_pylist()), sizes, ids))


class _Handle:
    """A broadcast together with a number that names it in workers."""

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, broadcast._jbroadcast.id()

    def __getstate__(self):
        return self.broadcast, self.id

    def __setstate__(self, state):
        self.broadcast, self.id = state

    @property
    def value(self):
        return self.broadcast.value


def encode(
    docs: DataFrame, model: Model, text_col: str = "text", ids_col: str = "ids", exact_col: str | None = None, most: int = DICTIONARY_WORDS
) -> DataFrame:
    """``docs``, all columns, with ``ids_col`` array<int>, and with ``exact_col``: whether decoding gives back the text.

    Names that ``docs`` has already, in any case, get underscores in front.

    The texts are read twice, for the dictionary and here, and stay in their partitions.
    """
    shared = _Handle(_shared(docs, model, text_col, most))
    at = docs.columns.index(text_col)
    ids_col, exact_col = free_name(docs, ids_col), exact_col and free_name(docs, exact_col)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(shared)
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS_AT_A_TIME):
                batch = whole.slice(first, ROWS_AT_A_TIME)
                found = [codec.encode(t) for t in batch.column(at).to_pylist()]
                ids = [i for i, _ in found]
                ends = np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype(np.int32)
                columns = [*batch.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))]
                if exact_col:
                    columns.append(pa.array([same for _, same in found]))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = T.StructType([*docs.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType()))])
    if exact_col:
        schema = schema.add(exact_col, T.BooleanType())
    names = schema.names
    return docs.mapInArrow(encoded, schema)


def decode(rows: DataFrame, model: Model, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``rows``, all columns, with ``text_col``: the text of ``ids_col``, null where that is null; a name in use gets underscores in front."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.StringType())
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for ids in batches:
            yield pd.Series([None if i is None else decode_ids(i.tolist(), shared.value) for i in ids], dtype="object")

    return rows.withColumn(free_name(rows, text_col), decoded(F.col(ids_col)))
