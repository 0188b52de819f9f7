"""Near-dedup by b-bit MinHash.

Words are the runs between ASCII separators of the A-Z lower-cased text; a document's set holds its distinct word
shingles (with fewer words than a shingle has, the whole sequence as one). 252 minima make 42 bands of 6 rows; the
low two bits of each minimum are packed into a signature. Then:

1. rows with equal sets form one class, which has a number; all further steps meet classes, so copies cost nothing;
2. classes that share a band are candidates. Each is paired with the first class of its bucket, so a bucket of n
   gives n - 1 pairs, and links found so far join classes into components;
3. the share of equal low bits, corrected for chance collisions, estimates each pair's similarity; pairs that may
   reach the threshold are confirmed on the full sets;
4. buckets that still hold several components are open: their members are compared across components, block by block,
   first by signature; members with a partner whose estimate can reach the threshold come again with their full sets,
   and a block gives at most one confirmed link for each member, those that join components.

A pair in one component need not be compared, as it cannot change any component; every other pair of one bucket is.
A link at the threshold shares no band with probability under 1e-5 (0.8) or 1e-8 (0.85); its estimate falls below the
margin only if it is off by six of its standard deviations: 3e-8 at 0.8, 1e-9 at 0.85 (binomial, independent minima).

Python sees Arrow batches, which Spark bounds in bytes, and works through them text by text; of a very long text only
the words' hashes, 8 bytes each, are held at once, and nothing that outlasts the text grows with it.

Defined cases: null text, empty text or no words: an empty set, linked with nothing, its own component; a null id
takes no part, has a null component and is kept; rows that repeat an id are one document with several sets, whose
links all count, each with its own n_shingles; an empty table gives an empty result; further columns take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, written
from .components import components

ROWS, BANDS = 6, 42
MINIMA = ROWS * BANDS
#: The estimate's margin below the threshold: six of its standard deviations at 0.8, more beyond.
MARGIN = 0.18
#: Members of an open bucket, and shingles of theirs, that one part of it has in the mean; two parts make a block.
BLOCK = 512
BLOCK_SHINGLES = 1 << 20
#: Ids up to this count are broadcast to pick the documents whose sets are needed; beyond, they are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Shingles that meet all minima at a time, and bytes of a text that are hashed at a time.
STEP = 4096
CHUNK = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_BASE = 0x9E3779B97F4A7C15 | 1
_ROUND = 1 << 64
_RNG = np.random.RandomState(20240229)
_FACTORS = (_RNG.randint(0, 1 << 32, MINIMA, dtype=np.uint64).astype(np.uint32) | np.uint32(1))[:, None]


def _powers(base: int) -> np.ndarray:
    out = np.full(CHUNK + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


#: Powers of the hash's base and of its inverse, for one chunk.
_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, _ROUND))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray) -> np.ndarray:
    """One hash for each word of a text's bytes, chunk by chunk; a word may cross chunks."""
    found, carry, length = [], 0, 0  # what the open word has so far: its sum, and its bytes
    for at in range(0, len(data), CHUNK):
        part = data[at : at + CHUNK]
        inside = ~_SPACE[part]
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        begin, end = edge[::2], edge[1::2]
        if length and not inside[0]:
            found.append(np.array([carry], np.uint64))
            carry = length = 0
        if not len(begin):
            continue
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((_LOWER[part] + np.uint64(1)) * _UP[: len(part)], dtype=np.uint64)))
        word = (total[end] - total[begin]) * _DOWN[begin]
        if length:  # the first word goes on with the open one
            carry = (carry + int(word[0]) * pow(_BASE, length, _ROUND)) % _ROUND
            length += int(end[0])
            if len(word) > 1 or end[0] < len(part):
                found.append(np.array([carry], np.uint64))
                carry = length = 0
            word, begin, end = word[1:], begin[1:], end[1:]
        if len(word) and end[-1] == len(part):
            carry, length = int(word[-1]), int(end[-1] - begin[-1])
            word = word[:-1]
        found.append(word)
    if length:
        found.append(np.array([carry], np.uint64))
    return _mix(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def shingles(text: str | np.ndarray | None, words: int) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles."""
    data = text if isinstance(text, np.ndarray) else np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    word = word_hashes(data)
    if not len(word):
        return word
    width = min(words, len(word))
    out = np.full(len(word) - width + 1, width, np.uint64)
    for k in range(width):
        out = _mix(out * np.uint64(0x100000001B3) + word[k : len(word) - width + 1 + k])
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def minima(hashes: np.ndarray) -> np.ndarray:
    """The minimum of each of the hash functions over a non-empty set."""
    low, high = hashes.astype(np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), STEP):
        np.minimum(least, (_FACTORS * low[None, at : at + STEP] + high[None, at : at + STEP]).min(axis=1), out=least)
    return least


def packed(least: np.ndarray) -> np.ndarray:
    """Two low bits of each minimum, after a mixing multiplication, in 64-bit words of 32 each."""
    bits = ((least * np.uint32(0x9E3779B1)) >> np.uint32(30)).astype(np.uint64)
    bits = np.concatenate((bits, np.zeros(-len(bits) % 32, np.uint64))).reshape(-1, 32)
    return (bits << (np.arange(32, dtype=np.uint64) * np.uint64(2))).sum(axis=1, dtype=np.uint64).view(np.int64)


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    for k in range(ROWS):
        key = _mix(key * np.uint64(0x100000001B3) + rows[:, k])
    return key.view(np.int64)


_SIGNED = "doc_id long, n_shingles long, set_key string, signature array<long>, bands array<long>"


def _texts(column: pa.Array) -> Iterator[np.ndarray]:
    """Each text's bytes, without a copy; null as none."""
    column = column.cast(pa.large_binary())
    ends, data = np.frombuffer(column.buffers()[1], np.int64), np.frombuffer(column.buffers()[2] or b"", np.uint8)
    known = column.is_valid()
    for k in range(len(column)):
        first, last = ends[column.offset + k], ends[column.offset + k + 1]
        yield data[first:last] if known[k].as_py() else data[:0]


def _lists(parts: list[np.ndarray]) -> pa.Array:
    """An Arrow list for each of the arrays; null for those without values."""
    ends = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    empty = np.array([not len(p) for p in parts] + [False])
    values = pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64())
    return pa.ListArray.from_arrays(pa.array(ends, mask=empty), values)


def _digest(hashes: np.ndarray) -> str:
    return hashlib.md5(hashes.tobytes()).hexdigest()


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """One row per row of (doc_id, text), with the set's size and digest, the packed signature and the band keys."""
    none = np.zeros(0, np.int64)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, signs, bands = [], [], [], []
            for text in _texts(batch.column("text")):
                found = shingles(text, words)
                least = minima(found) if len(found) else None
                sizes.append(len(found))
                keys.append(None if least is None else _digest(found))
                signs.append(none if least is None else packed(least))
                bands.append(none if least is None else band_keys(least))
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.string()), _lists(signs), _lists(bands)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "set_key", "signature", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sign, _SIGNED)


#: Shingles that a worker hands on at a time.
SHINGLES_AT_A_TIME = 1 << 20


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, set_key, shingles) of each row with words."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, sets, held = [], [], [], 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), _texts(batch.column("text")), strict=True):
                found = shingles(text, words)
                if len(found):
                    ids.append(doc_id)
                    keys.append(_digest(found))
                    sets.append(found.view(np.int64))
                    held += len(found)
                if held > SHINGLES_AT_A_TIME:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.string()), _lists(sets)], names=names)
                    ids, keys, sets, held = [], [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.string()), _lists(sets)], names=names)

    names = ["doc_id", "set_key", "shingles"]
    return docs.mapInArrow(take, "doc_id long, set_key string, shingles array<long>")


def estimate(a: Column, b: Column) -> Column:
    """Similarity from two packed signatures: the share of equal pairs of bits, less what chance makes equal."""
    even = F.lit(0x5555555555555555)
    differ = lambda x, y: x.bitwiseXOR(y)
    unequal = F.aggregate(
        F.zip_with(a, b, lambda x, y: F.bit_count((differ(x, y)).bitwiseOR(F.shiftrightunsigned(differ(x, y), 1)).bitwiseAND(even))),
        F.lit(0),
        lambda s, x: s + x,
    )
    equal = F.lit(1.0) - unequal / F.lit(float(MINIMA))
    return (equal - 0.25) / 0.75


def _sets_of(docs: DataFrame, classes: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(cid, shingles) of the classes in ``ids``; each set comes from the texts of the class's smallest document."""
    wanted = written(classes.join(ids, "cid", "left_semi").select("cid", F.col("rep").alias("doc_id"), "set_key"))
    few = wanted.count() <= BROADCAST_IDS
    known = wanted.select("doc_id").distinct()
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known) if few else known, "doc_id", "left_semi")
    # An id that repeats brings several texts; the digest tells which of them is meant.
    sets = full_sets(chosen, words).join(F.broadcast(wanted) if few else wanted, ["doc_id", "set_key"])
    return written(sets.groupBy("cid").agg(F.first("shingles").alias("shingles")))


def _confirmed(pairs: DataFrame, classes: DataFrame, sets: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets meet the threshold."""
    side = lambda name: classes.select(F.col("cid").alias(name), F.col("n_shingles").alias(f"n_{name}"), F.col("signature").alias(f"s_{name}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b")
    fits = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    likely = written(sized.filter(fits & (estimate(F.col("s_a"), F.col("s_b")) >= percent / 100 - MARGIN)).select("a", "b"))
    found = sets(likely.select(F.col("a").alias("cid")).union(likely.select("b")).distinct())
    both = likely.join(found.select(F.col("cid").alias("a"), F.col("shingles").alias("x")), "a")
    both = both.join(found.select(F.col("cid").alias("b"), F.col("shingles").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y")).cast("long")
    return both.filter(100 * shared >= percent * (F.size("x") + F.size("y") - shared)).select("a", "b")


_BLOCK = ("key", "p", "q")
_MEMBER = "key long, p int, q int, part int, cid long, component long, n_shingles long, signature array<long>"


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (key, p, q), from batches sorted by it; a block has two parts' rows at most, whatever the bucket's size."""
    rest: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in _BLOCK], axis=1)
        edges = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        starts = [0, *edges.tolist(), batch.num_rows]
        for start, stop in zip(starts[:-1], starts[1:], strict=True):
            here = tuple(keys[start])
            if here != last and rest:
                yield pa.concat_tables(rest).combine_chunks()
                rest = []
            last = here
            rest.append(pa.Table.from_batches([batch.slice(start, stop - start)]))
    if rest:
        yield pa.concat_tables(rest).combine_chunks()


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A list column's values and the ends of its lists."""
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    ends = lists.offsets.to_numpy()
    return lists.values.to_numpy()[ends[0] : ends[-1]], ends - ends[0]


def _near_pairs(block: pa.Table, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, rows): each row with those across components whose sizes and estimate allow the threshold."""
    least = (percent / 100 - MARGIN) * 0.75 + 0.25
    part, p, q = block["part"].to_numpy(), block["p"][0].as_py(), block["q"][0].as_py()
    ids, comps, sizes = (block[c].to_numpy() for c in ("cid", "component", "n_shingles"))
    sig = _flat(block["signature"])[0].view(np.uint64).reshape(len(ids), -1)
    even, right = np.uint64(0x5555555555555555), np.flatnonzero(part == q)
    for k in np.flatnonzero(part == p):
        others = right[(comps[right] != comps[k]) & (100 * np.minimum(sizes[right], sizes[k]) >= percent * np.maximum(sizes[right], sizes[k]))]
        if p == q:
            others = others[ids[others] > ids[k]]
        if len(others):
            x = sig[others] ^ sig[k]
            equal = 1 - np.bitwise_count((x | (x >> np.uint64(1))) & even).sum(axis=1) / MINIMA
            others = others[equal >= least]
            if len(others):
                yield int(k), others


def _open_links(rows: DataFrame, sets: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """Confirmed links (a, b) across components in buckets that hold several.

    ``rows``: key, cid, component, n_shingles, signature. ``sets`` gives (cid, shingles) of a table of cids.
    """
    spans = rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"), F.min("component").alias("lo"), F.max("component").alias("hi")
    )
    parts = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("s") / BLOCK_SHINGLES)).cast("int")
    spans = written(spans.filter("lo < hi").select("key", parts.alias("parts")))
    blocked = rows.join(spans, "key").withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    ends = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(o, F.col("part")).alias("p"), F.greatest(o, F.col("part")).alias("q"))
    )
    dealt = blocked.withColumn("cell", F.explode(ends)).select("key", "cell.p", "cell.q", "part", "cid", "component", "n_shingles", "signature")

    def promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _by_block(batches):
            wanted = np.zeros(block.num_rows, bool)
            for k, others in _near_pairs(block, percent):
                wanted[k] = wanted[others] = True
            if wanted.any():
                yield from block.filter(pa.array(wanted)).to_batches()

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _by_block(batches):
            ids, comps, root = block["cid"].to_numpy(), block["component"].to_numpy(), {}
            full, ends = _flat(block["shingles"])

            def find(x: int) -> int:
                while root.get(x, x) != x:
                    x = root[x]
                return x

            found = []
            for k, others in _near_pairs(block, percent):
                mine_set = full[ends[k] : ends[k + 1]]
                for o in others:
                    mine, other = find(comps[k]), find(comps[o])
                    if mine != other:
                        its = full[ends[o] : ends[o + 1]]
                        # Both are distinct, in the order of unsigned numbers; together, equal neighbours are shared ones.
                        both = np.sort(np.concatenate((mine_set, its)))
                        shared = int(np.count_nonzero(both[1:] == both[:-1]))
                        if 100 * shared >= percent * (len(mine_set) + len(its) - shared):
                            root[max(mine, other)] = min(mine, other)
                            found.append((min(ids[k], ids[o]), max(ids[k], ids[o])))
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    likely = written(dealt.repartition(*_BLOCK).sortWithinPartitions(*_BLOCK).mapInArrow(promising, _MEMBER))
    full = likely.join(sets(likely.select("cid").distinct()), "cid")
    return full.repartition(*_BLOCK).sortWithinPartitions(*_BLOCK).mapInArrow(confirm, "a long, b long").distinct()


def near_dedup(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    signed = written(signatures(docs, words))
    with_set = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    # Tables that hot keys meet are written first, so that the joins below meet plain shuffles, which can be split.
    one = F.min_by(F.struct("n_shingles", "signature", "bands"), "doc_id").alias("one")
    grouped = with_set.groupBy("set_key").agg(F.min("doc_id").alias("rep"), one)
    classes = written(grouped.select(F.monotonically_increasing_id().alias("cid"), "rep", "set_key", "one.*"))
    # Each document's classes; an id that repeats can have several, which it links.
    members = written(with_set.select("doc_id", "set_key").join(classes.select("set_key", "cid"), "set_key").select("doc_id", "cid"))
    several = members.groupBy("doc_id").agg(F.min("cid").alias("a"), F.max("cid").alias("hi")).filter("a < hi").select("doc_id", "a")
    same = members.join(several, "doc_id").filter("cid > a").select("a", F.col("cid").alias("b")).distinct()
    sets = lambda ids: _sets_of(docs, classes, ids, words)
    rows = classes.select("cid", F.explode("bands").alias("key"))
    buckets = written(rows.groupBy("key").agg(F.min("cid").alias("centre"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "centre"))
    in_bucket = written(rows.join(buckets, "key"))
    stars = in_bucket.filter("cid > centre").select(F.col("centre").alias("a"), F.col("cid").alias("b")).distinct()
    found = written(components(_confirmed(stars, classes, sets, percent).union(same)))
    labelled = in_bucket.select("key", "cid").join(found.withColumnRenamed("node", "cid"), "cid", "left")
    labelled = labelled.withColumn("component", F.coalesce("component", "cid"))
    labelled = written(labelled.join(classes.select("cid", "n_shingles", "signature"), "cid"))
    more = written(_open_links(labelled, sets, percent))
    if not more.isEmpty():
        found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    # A component's name is the smallest document of its classes.
    placed = written(classes.select("cid", "rep", "set_key").join(found.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid")))
    names = written(placed.groupBy("component").agg(F.min("rep").alias("component_id")))
    named = written(placed.join(names, "component").select("set_key", "component_id"))
    joined = signed.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without those of a component's other documents."""
    gone = free_name(docs, "gone")
    away = near_dedup(docs, words, percent, id_col, text_col).filter(~F.col("kept")).select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(away, F.col(id_col).cast("long") == F.col(gone), "left_anti")
