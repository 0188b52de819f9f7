"""Graded similarity of words over a taxonomy of concepts, and the text score that uses it.

A taxonomy is three relations: ``links`` (concept, parent), ``counts`` (concept, n) of concepts seen in some corpus, and
``senses`` (word, pos, concept, rank). The ancestors of all concepts are the closure of the links; a concept's information is
the negative logarithm of the share of all counts that lie at or below it; two concepts are as similar as the
information of their most informative common ancestor, twice, over the sum of their own. Two words are as similar as
the best of their first senses.

Defined cases: links in a circle end; a concept that nothing at or below it was counted for has no information and is like
nothing; a word without a sense is like nothing; without a taxonomy, words are like each other if they are equal.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple, Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scores import EMPTY_VERBS, combined_text_score, word_order_overlap
from ..functions.text import cap, missing, strip
from ..operators.relations import discard, shared_path, written

#: Fixed value: senses of a word that are compared, by rank.
SENSES = 3
#: Rows of words by what they are under that every task holds; beyond them, texts are dealt to parts of so many words.
HELD, DEALT = 1 << 20, 1 << 21
#: Texts that are scored at once.
TEXTS = 4096
#: Parts of speech that count as nouns, and as verbs.
NOUNS, VERBS = ("NOUN", "PROPN"), ("VERB",)


def closure(links: DataFrame, concept: str = "concept", parent: str = "parent") -> DataFrame:
    """(concept, ancestor) of every concept, itself among its ancestors.

    Concepts above others are closed first: each round joins all their paths with all of them, so rounds grow with the logarithm
    of the depth. The others, most of all, are joined to these once.
    """
    spark = links.sparkSession
    known = links.filter(F.col(concept).isNotNull())
    steps = known.filter(F.col(parent).isNotNull() & (F.col(concept) != F.col(parent))).select(F.col(concept).alias("concept"), F.col(parent).alias("ancestor")).distinct()
    path, before = shared_path(spark), -1
    upper = written(steps.join(steps.select(F.col("ancestor").alias("concept")).distinct(), "concept", "left_semi"), path)
    while (n := upper.count()) != before:
        before, old, path = n, path, shared_path(spark)
        further = upper.select(F.col("concept").alias("ancestor"), F.col("ancestor").alias("_up"))
        upper = written(upper.union(upper.join(further, "ancestor").select("concept", F.col("_up").alias("ancestor"))).distinct(), path)
        discard(spark, old)
    above = upper.select(F.col("concept").alias("_by"), "ancestor")
    paths = steps.union(steps.select("concept", F.col("ancestor").alias("_by")).join(above, "_by").select("concept", "ancestor")).distinct()
    nodes = known.select(F.col(concept).alias("concept")).union(known.filter(F.col(parent).isNotNull()).select(F.col(parent).alias("concept"))).distinct()
    return written(paths.filter("concept <> ancestor").union(nodes.select("concept", F.col("concept").alias("ancestor"))))


def information(ancestors: DataFrame, counts: DataFrame) -> DataFrame:
    """(concept, n, information): n counts every concept below once, however many ways lead to it."""
    found = ancestors.join(counts.groupBy("concept").agg(F.sum("n").alias("n")), "concept")
    below = found.groupBy(F.col("ancestor").alias("concept")).agg(F.sum("n").cast("long").alias("n")).filter("n > 0")
    # One row.
    total = found.filter("concept = ancestor").agg(F.sum("n").alias("total"))
    return below.join(F.broadcast(total)).select("concept", "n", F.log(F.col("total") / F.col("n")).alias("information"))


class Taxonomy(NamedTuple):
    """``senses``, ``ancestors`` and ``information`` as the functions here make them."""

    senses: DataFrame
    ancestors: DataFrame
    information: DataFrame

    def similarity(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` (a, b, pos), distinct, with ``similarity``."""
        return word_similarity(pairs, self)


def _profile(needed: DataFrame, taxonomy: Taxonomy, senses: int = SENSES) -> DataFrame:
    """What each word of ``needed`` (word, pos) is under: (word, pos, concept, own information of the sense, ancestor, its information)."""
    known = taxonomy.senses.filter(F.col("rank") <= senses).join(needed, ["word", "pos"]).select("word", "pos", "concept").distinct()
    of = taxonomy.information.select("concept", F.col("information").alias("own"))
    up = taxonomy.information.select(F.col("concept").alias("ancestor"), F.col("information").alias("shared"))
    profile = known.join(of, "concept").join(taxonomy.ancestors, "concept").join(up, "ancestor")
    return profile.select("word", "pos", "concept", "own", "ancestor", "shared")


def word_similarity(pairs: DataFrame, taxonomy: Taxonomy, senses: int = SENSES) -> DataFrame:
    """``pairs`` (a, b, pos), distinct, with ``similarity``: the best over the words' first senses; 0 where they share nothing."""
    needed = pairs.select(F.col("a").alias("word"), "pos").union(pairs.select("b", "pos")).distinct()
    profile = written(_profile(needed, taxonomy, senses))
    left = pairs.join(profile.select(F.col("word").alias("a"), "pos", F.col("own").alias("own_a"), "ancestor", "shared"), ["a", "pos"])
    right = profile.select(F.col("word").alias("b"), "pos", F.col("own").alias("own_b"), "ancestor")
    # For each two senses the most informative ancestor gives the greatest value, so one maximum serves ancestors and senses.
    both = F.col("own_a") + F.col("own_b")
    best = left.join(right, ["b", "pos", "ancestor"]).groupBy("a", "b", "pos").agg(F.max(F.when(both > 0, 2 * F.col("shared") / both)).alias("similarity"))
    return pairs.join(best, ["a", "b", "pos"], "left").fillna(0.0, ["similarity"])


def equal_words(pairs: DataFrame) -> DataFrame:
    """``pairs`` (a, b, pos) with ``similarity`` 1 where the words are equal in lower case, else 0: without a taxonomy."""
    return pairs.withColumn("similarity", (F.lower("a") == F.lower("b")).cast("double"))


class Analyzer(Protocol):
    """Tokens of texts, each a dict of ``TOKEN``'s fields; such as a tagger with lemmas."""

    def tokens(self, texts: list[str]) -> list[list[dict]]: ...


TOKEN = "array<struct<lemma:string,pos:string,tag:string,stop:boolean,alpha:boolean>>"
#: Characters of a text that are analysed; a fixed value of the score.
ANALYSED_CHARS = 1000


def analysed(df: DataFrame, text: str, out: str, factory: Callable[[], Analyzer]) -> DataFrame:
    """``df`` with the tokens of ``text`` by an analyser, which each task makes once."""

    @F.pandas_udf(TOKEN)
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        analyzer = factory()
        for texts in batches:
            yield pd.Series(analyzer.tokens(texts.fillna("").tolist()), dtype="object")

    return df.withColumn(out, tokens(cap(strip(F.col(text)), ANALYSED_CHARS)))


def nouns(tokens: Column) -> Column:
    """(word, tag) of nouns that are no stop words; tags of nouns do not matter."""
    kept = F.filter(tokens, lambda t: t["pos"].isin(*NOUNS) & ~t["stop"])
    return F.transform(kept, lambda t: F.struct(F.lower(t["lemma"]).alias("word"), F.lit("").alias("tag")))


def verbs(tokens: Column) -> Column:
    """(word, tag) of verbs that say something."""
    kept = F.filter(tokens, lambda t: t["pos"].isin(*VERBS) & ~F.lower(t["lemma"]).isin(*EMPTY_VERBS))
    return F.transform(kept, lambda t: F.struct(F.lower(t["lemma"]).alias("word"), t["tag"].alias("tag")))


def plain_words(tokens: Column) -> Column:
    """Alphabetic words that are no stop words, in order."""
    return F.transform(F.filter(tokens, lambda t: t["alpha"] & ~t["stop"]), lambda t: F.lower(t["lemma"]))


def best_matches(pairs: DataFrame, key: str, similarity: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(key, pos, matched): the mean over the left words of the best similarity to a right word.

    ``pairs`` has key, pos, and ``left`` and ``right``, arrays of (word, tag). A left word is compared with the right words of
    its tag, or with all if there are none. Each two words are compared once, whatever the rows they stand in.
    """
    words = pairs.filter((F.size("left") > 0) & (F.size("right") > 0)).select(key, "pos", "right", F.explode("left").alias("l"))
    words = words.groupBy(key, "pos", "l").agg(F.count(F.lit(1)).alias("n"), F.first("right").alias("right"))
    same = F.filter("right", lambda r: r["tag"] == F.col("l.tag"))
    pool = F.array_distinct(F.transform(F.when(F.size(same) > 0, same).otherwise(F.col("right")), lambda r: r["word"]))
    met = written(words.select(key, "pos", "n", F.col("l.tag").alias("tag"), F.col("l.word").alias("a"), F.explode(pool).alias("b")))
    found = similarity(met.select("a", "b", "pos").distinct()).select("a", "b", "pos", "similarity")
    best = met.join(found, ["a", "b", "pos"]).groupBy(key, "pos", "a", "tag").agg(F.first("n").alias("n"), F.max("similarity").alias("best"))
    return best.groupBy(key, "pos").agg((F.sum(F.col("n") * F.col("best")) / F.sum("n")).alias("matched"))


class Profiles:
    """Words by what they are under, as a task holds them: the same values as ``word_similarity`` by one look at each word.

    Of an ancestor's senses the one of least information gives the greatest value, so a pool of words is known by these.
    """

    def __init__(self, found: pa.Table):
        """``found`` has word, pos, ancestor, own, shared, a row for each ancestor of a word."""
        ancestors = _whole(found["ancestor"]).dictionary_encode()
        self.ancestors, kinds = ancestors.indices.to_numpy(), _whole(found["pos"])
        self.number, own, shared = len(ancestors.dictionary) + 1, found["own"].to_numpy(), found["shared"].to_numpy()
        self.words: dict[str, tuple] = {}
        for pos in pc.unique(kinds).to_pylist():
            at = np.flatnonzero(pc.equal(kinds, pos).to_numpy(zero_copy_only=False))
            words = _whole(found["word"]).take(pa.array(at)).dictionary_encode()
            of = words.indices.to_numpy()
            order = np.argsort(of, kind="stable")
            starts = np.searchsorted(of[order], np.arange(len(words.dictionary) + 1))
            at = at[order]
            self.words[pos] = words.dictionary, starts, self.ancestors[at].astype(np.int64), own[at], shared[at]

    def matched(self, pos: str, left: pa.Array, right: pa.Array) -> pa.Array:
        """What ``best_matches`` gives for each row of two lists of (word, tag); null words are like nothing and count for nothing."""
        rows, nothing = len(left), (pa.array([], pa.string()), np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
        known, starts, ancestors, own, shared = self.words.get(pos, nothing)
        sides = [[pc.list_parent_indices(x).to_numpy(), *pc.list_flatten(x).flatten()] for x in (left, right)]
        tags = pc.unique(pc.drop_null(pa.concat_arrays([sides[0][2], sides[1][2]])))
        (l_row, l_tag, l_word, l_said), (r_row, r_tag, r_word, r_said) = (
            # Tags from 1, and 0 for none; words by number, and -1 for those that are under nothing.
            (r, _numbers(t, tags) + 1, _numbers(w, known), pc.is_valid(w).to_numpy(zero_copy_only=False)) for r, w, t in sides
        )
        # A pool is a row and a tag, or a row and 0 for all its words. A left word is compared with its tag's, if the row has the tag.
        width = len(tags) + 1
        own_pool, all_pool = r_row * width + r_tag, r_row * width
        pool = l_row * width + l_tag
        pool = np.where(_among(pool, np.unique(own_pool[r_tag > 0])), pool, l_row * width)
        filled = np.unique(np.concatenate([own_pool[r_said], all_pool[r_said]]))
        counts = l_said & _among(pool, filled)
        pool, l_row, l_word = pool[counts], l_row[counts], l_word[counts]
        # The least information of each pool's senses under each ancestor.
        used = np.unique(pool)
        pools, members = np.concatenate([own_pool, all_pool]), np.tile(r_word, 2)
        met = (members >= 0) & _among(pools, used)
        pools, members = np.divmod(np.unique(np.searchsorted(used, pools[met]) * len(starts) + members[met]), len(starts))
        entry, place = _spread(members, starts)
        under = pools[entry] * self.number + ancestors[place]
        order = np.argsort(under, kind="stable")
        under, first = np.unique(under[order], return_index=True)
        least = np.minimum.reduceat(own[place][order], first) if len(first) else np.zeros(0)
        # The best of each left word's ancestors that its pool shares.
        entry, place = _spread(l_word, starts)
        wanted = np.searchsorted(used, pool)[entry] * self.number + ancestors[place]
        hit = _among(wanted, under)
        entry, place = entry[hit], place[hit]
        both = own[place] + least[np.searchsorted(under, wanted[hit])]
        best = np.zeros(len(pool))
        np.maximum.at(best, entry[both > 0], 2 * shared[place][both > 0] / both[both > 0])
        n = np.bincount(l_row, minlength=rows)
        return pa.array(np.bincount(l_row, best, minlength=rows) / np.maximum(n, 1), pa.float64(), mask=n == 0)


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def _numbers(values: pa.Array, among: pa.Array) -> np.ndarray:
    """Each value's place in ``among``, -1 without one."""
    return pc.fill_null(pc.index_in(values, value_set=among, skip_nulls=True), -1).to_numpy().astype(np.int64)


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Whether each value is one of ``ordered``, which are distinct and in order."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _spread(words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, place) of each row of each word's profile; words of -1 have none."""
    sizes = np.where(words >= 0, starts[words + 1] - starts[words], 0) if len(starts) > 1 else np.zeros(len(words), np.int64)
    entry = np.repeat(np.arange(len(words)), sizes)
    return entry, np.repeat(starts[words] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(entry))


SIDES = {"NOUN": nouns, "VERB": verbs}


def _matches(profiles: Profiles, columns: list[pa.Array]) -> list[pa.Array]:
    """Of the lists of (word, tag) by part of speech and side."""
    return [profiles.matched(pos, *columns[2 * k : 2 * k + 2]) for k, pos in enumerate(SIDES)]


def _matched(df: DataFrame, key: str, left_tokens: str, right_tokens: str, taxonomy: Taxonomy, held: int, dealt: int) -> DataFrame:
    """``df`` with ``_nouns`` and ``_verbs`` as ``best_matches`` gives them, without rows of word pairs.

    Up to ``held`` rows of profiles, every task holds them all; beyond them, texts are dealt to parts of ``dealt`` words in the
    mean, and a task holds the profiles of the words of one part.
    """
    # Each list is a column of its own, as it would be made for each use otherwise.
    lists = [f"_l{k}" for k in range(2 * len(SIDES))]
    df = df.withColumns(dict(zip(lists, [kind(F.col(t)) for kind in SIDES.values() for t in (left_tokens, right_tokens)], strict=True)))
    said = df.select(F.explode(_words(lists)).alias("w")).select("w.*").distinct()
    # Written once, as it is counted first. An ancestor of all concepts says nothing.
    found = written(_profile(said, taxonomy).filter("shared > 0").groupBy("pos", "word", "ancestor").agg(F.min("own").alias("own"), F.first("shared").alias("shared")))
    if found.count() > held:
        return df.drop(*lists).join(_dealt(df.select(key, *lists), key, lists, found, dealt), key, "left")
    shared = df.sparkSession.sparkContext.broadcast(found.toArrow())  # ``held`` rows at most

    @F.arrow_udf("struct<NOUN:double,VERB:double>")
    def matched(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        profiles = Profiles(shared.value)
        for columns in batches:
            yield pa.StructArray.from_arrays(_matches(profiles, columns), list(SIDES))

    return df.withColumn("_m", matched(*lists)).withColumns({"_nouns": F.col("_m.NOUN"), "_verbs": F.col("_m.VERB")}).drop("_m", *lists)


def _words(lists: list[str]) -> Column:
    """(pos, word) of all ``lists``, which go by part of speech and side."""
    none, kinds = F.array().cast("array<struct<word:string,tag:string>>"), [pos for pos in SIDES for _ in range(2)]
    return F.concat(*[F.transform(F.coalesce(c, none), lambda w: F.struct(F.lit(pos).alias("pos"), w["word"].alias("word"))) for c, pos in zip(lists, kinds, strict=True)])  # noqa: B023


def _dealt(df: DataFrame, key: str, lists: list[str], found: DataFrame, dealt: int) -> DataFrame:
    """(key, ``_nouns``, ``_verbs``) by parts of the rows, each with the profiles of its own words."""
    # Written once, as rows are numbered.
    rows = written(df.withColumn("_id", F.monotonically_increasing_id()))
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(_words(lists))).alias("words")).first()
    each = max(1, total["n"] * dealt // max(1, total["words"] or 0))
    # Rows that were read together stay together. The upper bits of the number are the file's, the lower ones the row's.
    place = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    rows = rows.withColumn("_part", F.col("_id") - place + F.floor(place / each)).drop("_id")
    said = rows.select("_part", F.explode(_words(lists)).alias("w"))
    profiles = found.groupBy("pos", "word").agg(F.collect_list(F.struct("ancestor", "own", "shared")).alias("under"))
    held = said.select("_part", "w.*").distinct().join(profiles, ["pos", "word"]).select(F.col("_part").alias("_of"), "pos", "word", *[F.col(f"under.{c}").alias(c) for c in ("ancestor", "own", "shared")])

    def score(texts: pa.Table, under: pa.Table) -> pa.Table:
        given = {c: _whole(under[c]) for c in ("pos", "word", "ancestor", "own", "shared")}
        of = pc.list_parent_indices(given["ancestor"])
        profiles = Profiles(pa.table({c: v.take(of) if c in ("pos", "word") else pc.list_flatten(v) for c, v in given.items()}))
        done = []
        for batch in texts.to_batches(max_chunksize=TEXTS):
            done.append(pa.RecordBatch.from_arrays([batch[key], *_matches(profiles, [batch[c] for c in lists])], [key, "_nouns", "_verbs"]))
        return pa.Table.from_batches(done)

    out = T.StructType([df.schema[key], T.StructField("_nouns", T.DoubleType()), T.StructField("_verbs", T.DoubleType())])
    return rows.groupBy("_part").cogroup(held.groupBy("_of")).applyInArrow(score, out)


def text_scores(
    df: DataFrame, key: str, left: str, right: str, left_tokens: str, right_tokens: str, similarity: Callable[[DataFrame], DataFrame] | Taxonomy = equal_words, out: str = "score",
    held: int = HELD, dealt: int = DEALT,
) -> DataFrame:
    """``df`` with the text score of two analysed texts, from nouns, verbs by tag, and word order; ``key`` is unique.

    With a taxonomy, no pairs of words are made as rows.
    """
    # What needs the texts is computed where they are read, so that no join carries them.
    rows = df.withColumns({"_a": plain_words(F.col(left_tokens)), "_b": plain_words(F.col(right_tokens))})
    rows = rows.withColumns({"_overlap": F.coalesce(word_order_overlap(F.col("_a"), F.col("_b")), F.lit(0.0)), "_none": missing(F.col(left)) | missing(F.col(right))}).drop("_a", "_b")
    rows = _matched(rows, key, left_tokens, right_tokens, similarity, held, dealt) if isinstance(similarity, Taxonomy) else _joined(rows, key, left_tokens, right_tokens, similarity)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    score = F.when(F.col("_none"), 0.0).otherwise(combined_text_score(zero("_nouns"), zero("_verbs"), F.col("_overlap")))
    return rows.withColumn(out, score).drop("_nouns", "_verbs", "_overlap", "_none")


def _joined(df: DataFrame, key: str, left_tokens: str, right_tokens: str, similarity: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``df`` with ``_nouns`` and ``_verbs``, by joins of pairs of words."""
    side = lambda pos, kind: df.select(key, F.lit(pos).alias("pos"), kind(F.col(left_tokens)).alias("left"), kind(F.col(right_tokens)).alias("right"))
    matched = best_matches(side("NOUN", nouns).union(side("VERB", verbs)), key, similarity)
    each = matched.groupBy(key).agg(F.max(F.when(F.col("pos") == "NOUN", F.col("matched"))).alias("_nouns"), F.max(F.when(F.col("pos") == "VERB", F.col("matched"))).alias("_verbs"))
    return df.join(each, key, "left")
