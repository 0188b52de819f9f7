"""Scores of predictions against references: numbers, cosine, word overlap, composites."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import cap, missing, strip

# Weights of the fields, exponents of the text score, verbs without meaning of their own.
WEIGHTS = {"conditions": 0.15, "study_type": 0.10, "sex": 0.05, "minimum_age": 0.10, "maximum_age": 0.10, "eligibility_criteria": 0.50}
LAMBDA, ALPHA = 0.6, 0.6
SCORED_CHARS = 1000
EMPTY_VERBS = "be have say do go make know get see come take think look want give use find tell ask seem feel try leave call".split()
# Number words in English.
UNITS = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
TENS = {w: 10 * i for i, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}
SCALES = {"thousand": 10**3, "million": 10**6, "billion": 10**9}

NUMBER = r"\b\d+(?:\.\d+)?\b"


def digits(text: Column) -> Column:
    """The distinct numbers written in digits."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER), F.lit(0)), lambda x: x.cast("double")))


#: Without one of these words no run of words says a number.
SPOKEN = r"(?i)\b(?:" + "|".join([*UNITS, *TENS, "hundred", *SCALES]) + r")\b"


#: What a word is in a spoken number, and what it says.
UNIT, TEN, HUNDRED, SCALE, POINT, OTHER = range(6)
_KINDS = {**{w: (UNIT, v) for w, v in UNITS.items()}, **{w: (TEN, v) for w, v in TENS.items()}, "hundred": (HUNDRED, 100), **{w: (SCALE, v) for w, v in SCALES.items()}, "point": (POINT, 0)}
#: Words of a run that may say a number together: a fixed value.
RUN = 5


_ENTRIES = ", ".join(f"'{w}', named_struct('kind', {k}, 'value', {v}L)" for w, (k, v) in _KINDS.items())


def _kind(word: Column) -> Column:
    """struct(kind, value) of a word."""
    # As text: a constant that is parsed once, where a call for each entry would be made.
    return F.coalesce(F.element_at(F.expr(f"map({_ENTRIES})"), word), F.expr(f"named_struct('kind', {OTHER}, 'value', 0L)"))


def said_number(kinds: Column) -> Column:
    """The number that a whole run of (kind, value) says, such as those of ``two hundred and five``; null if it says none.

    One fold: the sum of closed scales, the group that is open, and the digits after a point.
    """
    state = "struct<total:long,group:long,said:boolean,ok:boolean,digits:string>"
    opened = F.struct(F.lit(0), F.lit(0), F.lit(False), F.lit(True), F.lit(None)).cast(state)

    def step(acc: Column, w: Column) -> Column:
        kind, value = w["kind"], w["value"]
        after_point = acc["digits"].isNotNull()
        one = F.when(acc["group"] == 0, F.lit(1)).otherwise(acc["group"])
        group = F.when(kind.isin(UNIT, TEN), acc["group"] + value).when(kind == HUNDRED, one * 100).when(kind == SCALE, 0).otherwise(acc["group"])
        fits = F.when(after_point, (kind == UNIT) & (value < 10)).otherwise((kind <= SCALE) | ((kind == POINT) & acc["said"]))
        digits = F.when(after_point, F.concat(acc["digits"], value.cast("string"))).when(kind == POINT, F.lit(""))
        return F.struct(
            F.when(~after_point & (kind == SCALE), acc["total"] + one * value).otherwise(acc["total"]), F.when(after_point, acc["group"]).otherwise(group), F.lit(True), acc["ok"] & fits, digits
        ).cast(state)

    def finish(acc: Column) -> Column:
        whole = acc["total"] + acc["group"]
        broken = F.concat(whole.cast("string"), F.lit("."), acc["digits"]).cast("double")
        return F.when(acc["ok"] & acc["said"] & ~F.coalesce(acc["digits"] == "", F.lit(False)), F.coalesce(broken, whole.cast("double")))

    return F.aggregate(kinds, opened, step, finish)


def spoken(text: Column) -> Column:
    """The numbers that runs of one to five words say, in order of their runs.

    Runs are tried where a number word stands; a run that begins with anything else says none, or what a shorter one says.
    """
    low = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+", " "))
    parts = F.transform(F.split(low, " "), lambda w: F.filter(F.split(F.regexp_replace(w, r"^[.,;:()]+|[.,;:()]+$", ""), "-"), lambda p: (p != "") & (p != "and")))
    # Bound once, as lambdas would compute them again for each run.
    bound = F.array(F.transform(parts, lambda ps: F.transform(ps, _kind)))

    def found(kinds: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(kinds) - 1), lambda i: F.get(F.get(kinds, i), F.lit(0))["kind"] <= SCALE)
        run = lambda i, n: said_number(F.flatten(F.slice(kinds, i + 1, n)))
        runs = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(RUN), F.size(kinds) - i)), lambda n: run(i, n))))
        return F.filter(runs, lambda x: x.isNotNull())

    return F.transform(bound, found)[0]


def numbers(text: Column) -> Column:
    """All numbers of a text, in digits and in words, as a sorted array. Only texts with a number word are read for spoken ones."""
    some = F.coalesce(text, F.lit("")).rlike(SPOKEN)
    return F.array_sort(F.when(some, F.array_distinct(F.concat(digits(text), spoken(text)))).otherwise(digits(text)))


def set_similarity(a: Column, b: Column) -> Column:
    """1 for two empty sets, 0 if one is empty, else the shared part of the larger."""
    larger = F.greatest(F.size(a), F.size(b))
    return F.when(larger == 0, 1.0).when(F.least(F.size(a), F.size(b)) == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / larger)


def number_similarity(a: Column, b: Column) -> Column:
    """Of the numbers in digits and in words."""
    return set_similarity(numbers(a), numbers(b))


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def gated(a: Column, b: Column, similarity: Column) -> Column:
    """0 where one of the texts is empty or a missing answer, else ``similarity``."""
    return F.when(missing(a) | missing(b), 0.0).otherwise(similarity)


def words(text: Column, chars: int | None = None) -> Column:
    """Lower-cased alphabetic words of the text, or of its first characters."""
    body = strip(text) if chars is None else cap(strip(text), chars)
    return F.filter(F.split(F.lower(body), r"[^\p{L}]+"), lambda w: w != "")


def word_cosine(a: Column, b: Column) -> Column:
    """Similarity without a model: the cosine of two texts' word counts.

    One fold over the words of both in order: each run of equal words adds to the product and to the two lengths.
    """
    side = lambda text, k: F.transform(words(text), lambda w: F.struct(w.alias("w"), F.lit(k).alias("k")))
    state = "struct<w:string,x:double,y:double,xy:double,xx:double,yy:double>"
    opened = F.struct(F.lit(None), *[F.lit(0.0)] * 5).cast(state)

    def step(acc: Column, t: Column) -> Column:
        one, two = (t["k"] == 0).cast("double"), (t["k"] == 1).cast("double")
        same = acc["w"] == t["w"]
        more = F.struct(acc["w"], acc["x"] + one, acc["y"] + two, acc["xy"], acc["xx"], acc["yy"])
        new = F.struct(t["w"], one, two, acc["xy"] + acc["x"] * acc["y"], acc["xx"] + acc["x"] * acc["x"], acc["yy"] + acc["y"] * acc["y"])
        return F.when(same, more.cast(state)).otherwise(new.cast(state))

    def finish(acc: Column) -> Column:
        size = F.sqrt(acc["xx"] + acc["x"] * acc["x"]) * F.sqrt(acc["yy"] + acc["y"] * acc["y"])
        return F.when(size > 0, (acc["xy"] + acc["x"] * acc["y"]) / size).otherwise(0.0)

    return F.aggregate(F.array_sort(F.concat(side(a, 0), side(b, 1))), opened, step, finish)


def bigrams(tokens: Column) -> Column:
    """Adjacent pairs."""
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.zip_with(F.slice(tokens, F.lit(1), n), F.slice(tokens, F.lit(2), n), lambda x, y: F.concat(x, F.lit(" "), y))


def word_order_overlap(a: Column, b: Column) -> Column:
    """Shared words of the larger vocabulary, and shared adjacent pairs of the longer text, 6 to 4."""
    one, two = F.array_distinct(a), F.array_distinct(b)
    simple = F.size(F.array_intersect(one, two)) / F.greatest(F.size(one), F.size(two))
    pairs_a, pairs_b = bigrams(a), bigrams(b)
    adjacent = F.size(F.array_intersect(pairs_a, pairs_b)) / F.greatest(F.size(pairs_a), F.size(pairs_b), F.lit(1))
    both = (F.size(a) > 0) & (F.size(b) > 0)
    return F.when(both, F.lit(ALPHA) * simple + F.lit(1 - ALPHA) * adjacent).otherwise(0.0)


def combined_text_score(nouns: Column, verbs: Column, overlap: Column) -> Column:
    """The text score from the similarities of nouns and verbs and the word-order overlap, within 0 and 1."""
    x = F.pow(nouns, F.lit(LAMBDA))
    y = F.pow(verbs + overlap, F.lit(LAMBDA - LAMBDA**2))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x + y) / (1 + x)))


def best_match(a: Column, b: Column) -> Column:
    """Mean over ``a`` of whether ``b`` has the same word: the similarity of nouns or verbs without a thesaurus."""
    hits = F.aggregate(F.transform(a, lambda w: F.array_contains(b, w).cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), hits / F.size(a)).otherwise(0.0)


def text_score(a: Column, b: Column) -> Column:
    """The text score with the offline analyser: every word that is no empty verb stands for a noun, none for a verb."""
    left, right = words(a, SCORED_CHARS), words(b, SCORED_CHARS)
    content = lambda x: F.array_except(x, F.array(*[F.lit(v) for v in EMPTY_VERBS]))
    return gated(a, b, combined_text_score(best_match(content(left), content(right)), F.lit(0.0), word_order_overlap(left, right)))


def composite(scores: dict[str, Column]) -> Column:
    """The weighted sum of the fields' scores."""
    total = F.lit(0.0)
    for field, weight in WEIGHTS.items():
        total = total + F.lit(weight) * scores[field]
    return total


def normal_age(text: Column) -> Column:
    """The first number as whole years, whatever its unit; else the stripped text."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), r"(\d+(?:\.\d+)?)", 1)
    return F.when(found != "", F.concat(F.floor(found.cast("double")).cast("string"), F.lit(" Years"))).otherwise(strip(text))
