import pytest
from pyspark.sql import functions as F

from textquarry.functions import annotations as an
from textquarry.functions import replies, submission, text
from textquarry.functions import scores as sc
from textquarry.plans import analysis


def values(spark, rows, schema, column):
    """The column's value for each row, in order."""
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"_k int, {schema}")
    return [r[0] for r in df.select(column.alias("v"), "_k").orderBy("_k").collect()]


def test_cleaning(spark):
    rows = [(" a \t\n b ",), (None,), ("",), ("  x",)]
    assert values(spark, rows, "t string", text.clean(F.col("t"))) == ["a b", "", "", "x"]
    assert values(spark, [(" a  b\n",), (None,)], "t string", text.strip(F.col("t"))) == ["a  b", ""]


def test_paths_and_priors(spark):
    rows = [(["Methods", " Acknowledgments"],), (None,), (["Inclusion Criteria"],), (["Author contribution"],)]
    assert values(spark, rows, "p array<string>", text.normal_path(F.col("p"))) == ["methods > acknowledgementss", "", "inclusion criteria", "author contributions"]
    got = values(spark, [("inclusion of patients",), ("references > participants",), ("x",)], "p string", text.prior(F.col("p"), "eligibility"))
    assert got == pytest.approx([1.10, 1.06 * 0.85, 1.0])


@pytest.mark.parametrize(
    ("a", "b", "expected"),
    [("Not Specified", "Not Specified", 1.0), ("18 Years", "Not Specified", 0.0), ("18 Years", "18 Years", 1.0), ("18 Years", "65 Years", 0.0), ("18 to 65 years", "18 Years", 0.5), ("male", "female", 1.0)],
)
def test_number_similarity(spark, a, b, expected):
    assert values(spark, [(a, b)], "a string, b string", sc.number_similarity(F.col("a"), F.col("b"))) == [expected]


def spoken_number(words):
    """The number that a whole run of words says, by the rule as it stands; None if it says none."""
    total = group = 0
    said = False
    parts = [p for w in words for p in w.split("-") if p and p != "and"]
    for k, word in enumerate(parts):
        if word in sc.UNITS:
            group += sc.UNITS[word]
        elif word in sc.TENS:
            group += sc.TENS[word]
        elif word == "hundred":
            group = (group or 1) * 100
        elif word in sc.SCALES:
            total, group = total + (group or 1) * sc.SCALES[word], 0
        elif word == "point" and said and k + 1 < len(parts) and all(p in sc.UNITS and sc.UNITS[p] < 10 for p in parts[k + 1 :]):
            return float(f"{total + group}." + "".join(str(sc.UNITS[p]) for p in parts[k + 1 :]))
        else:
            return None
        said = True
    return float(total + group) if said else None


def numbers_in(text):
    import re

    found = {float(m) for m in re.findall(sc.NUMBER, text or "", flags=re.ASCII)}
    words = (text or "").lower().split()
    runs = (words[i:j] for i in range(len(words)) for j in range(i + 1, min(i + 5, len(words)) + 1))
    return found | {spoken_number([w.strip(".,;:()") for w in run]) for run in runs} - {None}


def test_numbers_in_words(spark):
    import random

    assert numbers_in("eighteen years old") == {18.0} and {205.0, 2.0, 200.0, 5.0} <= numbers_in("two hundred and five")
    rng = random.Random(2)
    vocabulary = [*"zero one two nine ten nineteen twenty ninety hundred thousand million billion point and years twenty-one Two, (five) -six a-b 18 2.5 - , hundred-and-one point. seven".split(), "\n", "\u00a0"]
    rows = [(" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 14))),) for _ in range(400)]
    rows += [("twenty-one and 3",), ("two point five",), ("point five",), ("one point",), ("",), (None,), ("eighteen years old " * 200,)]
    got = values(spark, rows, "t string", sc.numbers(F.col("t")))
    assert got == [sorted(numbers_in(t)) for (t,) in rows]


def test_word_cosine(spark):
    import math
    import random
    from collections import Counter

    rng = random.Random(3)
    draw = lambda: " ".join(rng.choice(["a", "B", "bb", "é", "x1y", ""]) for _ in range(rng.randrange(0, 12)))
    rows = [(draw(), draw()) for _ in range(200)] + [(None, "a"), ("a " * 3000 + "tail", "tail"), ("", "")]

    def cosine(a, b):
        import re

        one, two = (Counter(w for w in re.split(r"[^a-zé]+", (t or "").lower()) if w) for t in (a, b))
        size = math.sqrt(sum(n * n for n in one.values())) * math.sqrt(sum(n * n for n in two.values()))
        return sum(n * two[w] for w, n in one.items()) / size if size else 0.0

    assert values(spark, rows, "a string, b string", sc.word_cosine(F.col("a"), F.col("b"))) == pytest.approx([cosine(a, b) for a, b in rows])


def test_text_score_and_composite(spark):
    got = values(spark, [("a cat sat", "a cat sat"), ("cat", "dog"), ("Not Specified", "cat"), (None, "x")], "a string, b string", sc.text_score(F.col("a"), F.col("b")))
    assert got[0] == pytest.approx(1.0) and got[1] == 0.0 and got[2] == 0.0 and got[3] == 0.0
    same = {c: "Not Specified" for c in ("conditions", "study_type", "sex", "minimum_age", "maximum_age", "eligibility_criteria")}
    one = spark.createDataFrame([{"pmcids": "1", **same}])
    scored = analysis.scores(analysis.paired(one, one)).first()
    assert scored["score_overall"] == pytest.approx(0.25)
    assert sum(sc.WEIGHTS.values()) == pytest.approx(1.0) and max(sc.WEIGHTS, key=sc.WEIGHTS.get) == "eligibility_criteria"


def test_normal_age(spark):
    got = values(spark, [("6 Months",), ("18.5 y",), (" none ",), (None,)], "t string", sc.normal_age(F.col("t")))
    assert got == ["6 Years", "18 Years", "none", ""]


def test_labels(spark):
    a, b, c, none = an.LABELS
    rows = [(none, none), (a, none), (none, b), (c, c), (c, a)]
    df = spark.createDataFrame([(str(k), x, y) for k, (x, y) in enumerate(rows)], "sample_id string, haiku_label string, gemini_label string")
    got = an.with_targets(df).orderBy("sample_id").collect()
    assert [r["final_labels"] for r in got] == [none, a, b, c, f"{a} | {c}"]
    assert [r["resolution_method"].split("_")[0] for r in got] == ["both", "kept", "kept", "agreed", "combined"]
    assert got[4]["final_labels_json"] == f'["{a}", "{c}"]' and got[0]["final_labels_json"] == "[]"
    assert [r["target_condition_study_type"] for r in got] == [0, 1, 0, 0, 1]


def test_percent_rounds_half_to_even(spark):
    assert values(spark, [(1, 800), (3, 800), (0, 0)], "a int, b int", an.percent(F.col("a"), F.col("b"))) == [0.12, 0.38, 0.0]


def test_salvage(spark):
    rows = [('{"a": "x"}',), ('Sure:\n```json\n{"a":\n  "y"}\n```',), ("no",), (None,), ('<think>{"a": 1</think>{"a": "z"}',), ('{"a": ',)]
    got = values(spark, rows, "t string", replies.salvage(F.col("t"), "a string", thinking=True))
    assert [g and g["a"] for g in got] == ["x", "y", None, None, "z", None]


def test_label_reply(spark):
    good = '{"label": "Demographics", "overall_relevance": 4, "reason": " r "}'
    rows = [(good,), (f"```json\n{good}\n```",), ("[1]",), ("{",), (good.replace("4", "true"),), (good.replace("4", "6"),), (good.replace("4", "0"),), (good.replace(" r ", " "),), (good.replace("Demographics", "x"),)]
    value, error = replies.label_reply(F.col("t"))
    assert [v and tuple(v) for v in values(spark, rows, "t string", value)] == [("Demographics", 4, "r")] * 2 + [None] * 7
    assert values(spark, rows, "t string", error)[:2] == [None, None] and all(values(spark, rows, "t string", error)[2:])


def test_prices_and_delays(spark):
    assert values(spark, [(1_000_000, 1_000_000), (None, 0)], "a int, b int", replies.price(F.col("a"), F.col("b"))) == [18.0, 0.0]
    assert values(spark, [("3",), ("x",), (None,)], "t string", replies.count_of(F.col("t"))) == [3.0, 0.0, 0.0]
    assert replies.delay(1, 0.5) == 1.5 and replies.delay(9, 0.5) == 60.0 and replies.delay(9, 0.5, False) == 60.5


def test_submission(spark):
    assert values(spark, [("PMC123",), ("pmc9 x",), ("abc",), (" 7 ",)], "t string", submission.article_id(F.col("t"))) == ["123", "9", "abc", "7"]
    assert values(spark, [("a; - b * c",), ("Not Specified",), (None,)], "t string", submission.listed(F.col("t"))) == [["a", "b", "c"], [], []]
    lists = [(["it's", 'a "b"'],), ([],)]
    assert values(spark, lists, "l array<string>", submission.conditions(F.col("l"))) == [repr(["it's", 'a "b"']), "['Not Specified']"]
    assert values(spark, [(["a.", "; "],), ([],)], "l array<string>", submission.criteria("H", F.col("l"))) == ["H: * a.", "H: * Not Specified."]
    ids = spark.createDataFrame([("x",), ("10",), ("9",)], "i string").orderBy(*submission.id_order(F.col("i")))
    assert [r[0] for r in ids.collect()] == ["9", "10", "x"]
    assert values(spark, [("Study-Type",), ("eligibility criteria",), ("other",)], "t string", submission.field_name(F.col("t"))) == ["condition_study_type", "eligibility", "other"]


def test_missing_answers(spark):
    assert values(spark, [(" not specified",), ("nan",), ("None",), ("x",), (None,)], "t string", text.missing(F.col("t"))) == [True, True, False, False, True]
    assert values(spark, [("None",), ("['Not Specified']",), (None,), ("x",)], "t string", text.missing_wide(F.col("t"))) == [True, True, True, False]
    assert values(spark, [("aged 18",), ("14 or 180",), (None,)], "t string", text.mentions_age(F.col("t"))) == [True, False, False]
