"""Part-of-speech tags by a first-order model: trained from a tagged table, decoded over its states.

Training counts tags after tags and words under tags. Scores are logarithms in millionths, as integers, so that sums are exact
and ties are settled alike by any engine: by the tag that sorts first. A word that was never seen takes the scores of
its ending, one whose ending was never seen those of tags alone.

Tables of scores that a task can hold go to every task, and sentences are decoded where they are read, without a shuffle.
Larger ones are joined to the words, a row for each, and the fold over their scores gives the same tags.

Defined cases: null words and tags take no part in training; a null or empty sentence has no tags; a null word is
decoded as one never seen; training without rows is an error; further columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.relations import checkpointed

#: Characters of an ending, and how many tags a model may have: they are held as literals of the plan.
ENDING, TAGS = 3, 100
#: Scores of words and endings by tag that a task holds; beyond them, tables are joined.
HELD = 1 << 20
#: Sums of a step that are held at a time.
SUMS = 1 << 22
#: What each count is raised by.
SMOOTHING = 1.0


class TagModel(NamedTuple):
    """``tags`` in order; ``first`` and ``moves[before][after]`` as scores; tables of scores by word and by ending; scores of none."""

    tags: list[str]
    first: list[int]
    moves: list[list[int]]
    words: DataFrame
    endings: DataFrame
    other: list[int]


def _score(part: Column, whole: Column | float, kinds: Column | float) -> Column:
    """The logarithm of a smoothed share, in millionths."""
    return F.round(F.log((part + SMOOTHING) / (whole + SMOOTHING * kinds)) * 1_000_000).cast("long")


def ending(word: Column) -> Column:
    return F.lower(F.right(word, F.lit(ENDING)))


def train(tagged: DataFrame, sentence: str = "sentence", place: str = "place", word: str = "word", tag: str = "tag") -> TagModel:
    """The model of a table with one row for each word; counted in Spark, only tags by tags come to the driver."""
    rows = tagged.select(F.col(sentence).alias("s"), F.col(place).alias("p"), F.lower(word).alias("word"), F.col(tag).alias("tag")).filter("word IS NOT NULL AND tag IS NOT NULL")
    by_tag = {r["tag"]: r["n"] for r in rows.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).limit(TAGS + 1).collect()}
    if not by_tag or len(by_tag) > TAGS:
        raise ValueError(f"a tagged table needs 1 to {TAGS} tags, not {len(by_tag) or 'none'}")
    tags = sorted(by_tag)
    before = F.lag("tag").over(Window.partitionBy("s").orderBy("p"))
    pairs = rows.withColumn("before", before).groupBy("before", "tag").agg(F.count(F.lit(1)).alias("n"))
    scored = pairs.withColumn("whole", F.sum("n").over(Window.partitionBy("before")))  # at most a row for each two tags
    found = {(r["before"], r["tag"]): (r["score"], r["whole"]) for r in scored.withColumn("score", _score(F.col("n"), F.col("whole"), float(len(tags)))).collect()}
    wholes = {b: whole for (b, _), (_, whole) in found.items()}
    spark = tagged.sparkSession
    unseen = {b: n for b, n in wholes.items()} | {t: wholes.get(t, 0) for t in [None, *tags]}
    # The same expression gives the scores of pairs that never occur.
    zero = spark.createDataFrame([(b, float(n)) for b, n in unseen.items()], "before string, whole double").withColumn("score", _score(F.lit(0.0), F.col("whole"), float(len(tags))))
    floor = {r["before"]: r["score"] for r in zero.collect()}
    move = lambda b, t: found[(b, t)][0] if (b, t) in found else floor[b]
    totals = spark.createDataFrame([(t, by_tag[t]) for t in tags], "tag string, whole long")

    def emissions(key: str) -> DataFrame:
        """(key, scores by tag): how likely each tag shows this word or ending."""
        seen = rows.withColumn("key", F.col("word") if key == "word" else ending(F.col("word"))).groupBy("key", "tag").agg(F.count(F.lit(1)).alias("n"))
        kinds = float(seen.select("key").distinct().count() + 1)
        wide = seen.groupBy("key").agg(*[F.max(F.when(F.col("tag") == t, F.col("n"))).alias(f"n{k}") for k, t in enumerate(tags)])
        each = [_score(F.coalesce(F.col(f"n{k}"), F.lit(0)), float(by_tag[t]), kinds) for k, t in enumerate(tags)]
        return checkpointed(wide.select(F.col("key").alias(key), F.array(*each).alias(f"{key}_scores")))

    alone = totals.withColumn("score", _score(F.col("whole"), float(sum(by_tag.values())), float(len(tags))))
    other = {r["tag"]: r["score"] for r in alone.collect()}
    return TagModel(tags, [move(None, t) for t in tags], [[move(b, t) for t in tags] for b in tags], emissions("word"), emissions("ending"), [other[t] for t in tags])


def _literal(rows: list) -> Column:
    return F.array(*[_literal(r) if isinstance(r, list) else F.lit(r).cast("long") for r in rows])


def best_tags(scores: Column, model: TagModel) -> Column:
    """The tags of the greatest total, from each word's scores by tag; of equal ones the tag that sorts first, at every step back."""
    places = list(range(len(model.tags)))
    moves = _literal(model.moves)
    state = "array<struct<total:long,back:int>>"
    opened = F.zip_with(F.element_at(scores, 1), _literal(model.first), lambda e, f: F.struct((e + f).alias("total"), F.lit(0).alias("back"))).cast(state)

    def step(states: Column, emitted: Column) -> Column:
        before = F.element_at(states, -1)

        def into(t: int) -> Column:
            # back is negative, so that the greatest struct is of the first of equal totals.
            return F.array_max(F.transform(before, lambda x, b: F.struct((x["total"] + moves[b][t] + emitted[t]).alias("total"), (-b).cast("int").alias("back"))))

        return F.array_append(states, F.array(*[into(t) for t in places]).cast(state))

    rest = F.slice(scores, F.lit(2), F.greatest(F.size(scores) - 1, F.lit(0)))
    states = F.aggregate(rest, F.array(opened), step)

    def trace(path: Column, at: Column) -> Column:
        """path: tags' places from the end; at: the states of the place before."""
        return F.array_append(path, -at[F.element_at(path, -1)]["back"])

    last = F.array_max(F.transform(F.element_at(states, -1), lambda x, t: F.struct(x["total"].alias("total"), (-t).cast("int").alias("t"))))
    back = F.reverse(F.slice(states, F.lit(2), F.greatest(F.size(states) - 1, F.lit(0))))
    path = F.aggregate(back, F.array(-last["t"]), trace)
    names = F.array(*[F.lit(t) for t in model.tags])
    return F.when(F.size(scores) > 0, F.transform(F.reverse(path), lambda t: names[t])).otherwise(F.array().cast("array<string>"))


def best_paths(places: np.ndarray, sizes: np.ndarray, scores: np.ndarray, first: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Numbers of the tags that ``best_tags`` gives, of sentences on end: ``sizes`` words each, whose scores are in the row of ``places``.

    A step takes the next word of all sentences that have one, the longest first.
    """
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = (np.cumsum(sizes) - sizes)[order], sizes[order]
    longest = int(sizes[0]) if len(sizes) else 0
    left = np.searchsorted(-sizes, -np.arange(longest))  # sentences with a word at each step
    back, found = np.zeros((len(places), len(first)), np.int8), np.zeros(len(places), np.int64)
    total = scores[places[starts[: left[0]]]] + first if longest else np.zeros((0, len(first)), np.int64)
    for k in range(1, longest):
        at = starts[: left[k]] + k
        into = total[: left[k], :, None] + moves
        # Of equal totals the first, as everywhere.
        back[at] = into.argmax(axis=1)
        total[: left[k]] = into.max(axis=1) + scores[places[at]]
    said = total.argmax(axis=1)
    for k in reversed(range(longest)):
        at = starts[: left[k]] + k
        found[at] = said[: left[k]]
        said[: left[k]] = back[at, said[: left[k]]]
    return found


def tag(df: DataFrame, words: str, model: TagModel, out: str = "tags", held: int = HELD) -> DataFrame:
    """``df`` with the tags of ``words``, an array for each sentence."""
    if (model.words.count() + model.endings.count()) * len(model.tags) > held:
        return _joined(df, words, model, out)
    seen, ends = ([(r[0], r[1]) for r in t.select(key, f"{key}_scores").collect()] for t, key in ((model.words, "word"), (model.endings, "ending")))  # ``held`` numbers at most
    scores = np.array([s for _, s in seen] + [s for _, s in ends] + [model.other], np.int64)
    places = {w: k for k, (w, _) in enumerate(seen)}, {e: k for k, (e, _) in enumerate(ends, len(seen))}
    shared = df.sparkSession.sparkContext.broadcast((*places, scores, np.array(model.first, np.int64), np.array(model.moves, np.int64)))
    names, most = model.tags, max(1, SUMS // len(model.tags) ** 2)

    @F.arrow_udf("array<string>")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        by_word, by_ending, scores, first, moves = shared.value
        known = pa.array(names, pa.string())
        for sentences in batches:
            said = sentences.flatten().dictionary_encode()
            at = [by_word.get(w, by_ending.get(w[-ENDING:], len(scores) - 1)) for w in said.dictionary.to_pylist()]
            row = np.array(at, np.int64)[said.indices.to_numpy()]
            sizes = pc.list_value_length(sentences).to_numpy().astype(np.int64)
            ends = np.concatenate(([0], np.cumsum(sizes)))
            parts = [slice(k, k + most) for k in range(0, len(sizes), most)]
            tags = [best_paths(row[ends[p.start] : ends[min(p.stop, len(sizes))]], sizes[p], scores, first, moves) for p in parts]
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), known.take(pa.array(np.concatenate([*tags, np.zeros(0, np.int64)]))))

    # Lower-cased by Spark, as the words of the tables are.
    lowered = F.transform(F.coalesce(words, F.array().cast("array<string>")), lambda w: F.coalesce(F.lower(w), F.lit("")))
    return df.withColumn(out, decoded(lowered))


def _joined(df: DataFrame, words: str, model: TagModel, out: str) -> DataFrame:
    """``tag`` by joins: each distinct word to the tables of scores once, then back to the sentences by their number."""
    rows = checkpointed(df.withColumn("_row", F.monotonically_increasing_id()))
    said = rows.select("_row", F.posexplode(words).alias("_place", "_raw")).withColumn("word", F.coalesce(F.lower("_raw"), F.lit("")))
    distinct = said.select("word").distinct().join(model.words, "word", "left").withColumn("ending", ending(F.col("word"))).join(model.endings, "ending", "left")
    distinct = distinct.select("word", F.coalesce("word_scores", "ending_scores", _literal(model.other)).alias("_s"))
    scored = said.join(distinct, "word").groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_place", "_s"))).alias("_scores"))
    tags = best_tags(F.transform("_scores", lambda x: x["_s"]), model)
    found = scored.select("_row", tags.alias(out))
    empty = F.array().cast("array<string>")
    return rows.join(found, "_row", "left").withColumn(out, F.coalesce(out, empty)).drop("_row")
