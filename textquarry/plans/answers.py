"""Extractive answers: from start and end scores over overlapping windows to one calibrated answer a question.

A window's best span is found by one fold that carries the best start so far; its confidence is the mean of the two
softmax shares. Of a text's windows the most confident one answers. Answers are normalised, and stand only above the
threshold that calibration found for the question.

Defined cases: a window without scores, or with starts and ends of different length, answers nothing; null scores count as
the lowest; equal spans go to the earlier end, then the earlier start; equally confident windows to the earlier one; a
question without any gold answer, or none that any threshold gets right, keeps ``DEFAULT``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import normal_age
from ..functions.text import NOT_SPECIFIED, missing
from ..operators.relations import best_threshold, threshold_sweep
from .models import accepted

#: Thresholds that calibration tries, and the one it starts from.
THRESHOLDS = tuple(0.10 + 0.05 * k for k in range(15))
DEFAULT = 0.35
_LOWEST = -1e30


def _filled(scores: Column) -> Column:
    return F.transform(scores, lambda x: F.coalesce(x.cast("double"), F.lit(_LOWEST)))


def softmax_share(scores: Column, at: Column) -> Column:
    """The softmax share of the place ``at``, from 0."""
    # Bound once: a lambda would compute the greatest score again for each element.
    bound = F.array(F.struct(scores.alias("x"), F.array_max(scores).alias("top"), at.alias("at")))
    total = lambda b: F.aggregate(b["x"], F.lit(0.0), lambda s, x: s + F.exp(x - b["top"]))
    return F.transform(bound, lambda b: F.exp(F.get(b["x"], b["at"]) - b["top"]) / total(b))[0]


def _first_max(scores: Column) -> Column:
    """The first place of the greatest score, from 0."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def _joint(starts: Column, ends: Column) -> Column:
    """struct(f, l): first and last place of the greatest sum of a start and an end that is not before it."""
    state = "struct<at:int,start:double,first:int,total:double,f:int,l:int>"
    opened = F.struct(*[F.lit(x) for x in (0, None, 0, None, 0, 0)]).cast(state)

    def step(acc: Column, x: Column) -> Column:
        # The best start up to here, and the best span that ends here or before.
        later = acc["start"].isNull() | (x["s"] > acc["start"])
        start, first = F.when(later, x["s"]).otherwise(acc["start"]), F.when(later, acc["at"]).otherwise(acc["first"])
        better = acc["total"].isNull() | (start + x["e"] > acc["total"])
        total = F.when(better, start + x["e"]).otherwise(acc["total"])
        return F.struct(acc["at"] + 1, start, first, total, F.when(better, first).otherwise(acc["f"]), F.when(better, acc["at"]).otherwise(acc["l"])).cast(state)

    pairs = F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("s"), e.alias("e")))
    return F.aggregate(pairs, opened, step, lambda acc: F.struct(acc["f"].alias("f"), acc["l"].alias("l")))


def best_span(starts: Column, ends: Column, independent: bool = False) -> Column:
    """struct(first, last, confidence): the span of the greatest sum of start and end scores whose end is not before its start.

    ``independent`` takes the best start and the best end each by itself, and no answer (null) where the end comes first.
    """

    def span(w: Column) -> Column:
        s, e = w["s"], w["e"]
        place = F.struct(_first_max(s).alias("f"), _first_max(e).alias("l")) if independent else _joint(s, e)
        confidence = lambda p: (softmax_share(s, p["f"]) + softmax_share(e, p["l"])) / 2
        answer = lambda p: F.struct(p["f"].alias("first"), p["l"].alias("last"), confidence(p).alias("confidence"))
        return F.when((F.size(s) > 0) & (F.size(s) == F.size(e)), F.transform(F.array(place), lambda p: F.when(p["l"] >= p["f"], answer(p)))[0])

    # Scores are bound once, whatever expression they are.
    return F.transform(F.array(F.struct(starts.alias("s"), ends.alias("e"))), span)[0]


def window_answers(windows: DataFrame, starts: str = "starts", ends: str = "ends", tokens: str = "window", independent: bool = False) -> DataFrame:
    """``windows`` with ``answer`` and ``score``: the tokens of the best span, joined by spaces, and its confidence; both null without one."""
    rows = windows.withColumn("_span", best_span(_filled(F.col(starts)), _filled(F.col(ends)), independent))
    answer = F.array_join(F.slice(F.col(tokens), F.col("_span.first") + 1, F.col("_span.last") - F.col("_span.first") + 1), " ")
    return rows.withColumns({"answer": F.when(F.col("_span").isNotNull(), answer), "score": F.col("_span.confidence")}).drop("_span")


def merged(answers: DataFrame, keys: list[str], start: str = "window_start") -> DataFrame:
    """(keys, answer, score): the most confident window of each text and question; none, where no window answers."""
    window = Window.partitionBy(*keys).orderBy(F.desc("score"), start)
    best = answers.filter(F.col("score").isNotNull()).withColumn("_n", F.row_number().over(window)).filter("_n = 1")
    return best.select(*keys, "answer", "score")


def calibrated(answers: DataFrame, gold: DataFrame, questions: tuple[str, ...], keys: list[str], question: str = "bound") -> DataFrame:
    """(question, threshold, accuracy) of every question in ``questions``, from texts with a gold answer (keys, question, gold).

    A text without an answer says nothing is specified, at every threshold.
    """
    asked = gold.filter(~missing(F.col("gold"))).select(*keys, question, "gold")
    rows = asked.join(answers, [*keys, question], "left").withColumns({"answer": normal_age(F.coalesce("answer", F.lit(""))), "score": F.coalesce("score", F.lit(0.0))})
    best = best_threshold(threshold_sweep(rows, question, "answer", "score", "gold", THRESHOLDS, NOT_SPECIFIED), question)
    every = answers.sparkSession.createDataFrame([(q,) for q in questions], f"{question} string")
    right = F.coalesce(F.col("accuracy"), F.lit(0.0))
    found = every.join(best, question, "left")
    return found.select(question, F.when(right > 0, F.col("threshold")).otherwise(DEFAULT).alias("threshold"), right.alias("accuracy"))


def accepted_answers(asked: DataFrame, answers: DataFrame, thresholds: DataFrame, keys: list[str], question: str = "bound") -> DataFrame:
    """(keys, question, answer) of every text that was asked: the normalised answer above the question's threshold, else nothing specified."""
    # A row for each question.
    rows = asked.select(*keys, question).distinct().join(answers, [*keys, question], "left").join(F.broadcast(thresholds.select(question, "threshold")), question, "left")
    said = accepted(normal_age(F.col("answer")), F.col("score"), F.coalesce("threshold", F.lit(DEFAULT)))
    return rows.select(*keys, question, F.coalesce(said, F.lit(NOT_SPECIFIED)).alias("answer"))
