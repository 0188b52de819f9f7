import random

import pytest
from pyspark.sql import functions as F

from textquarry.operators import generators as gen
from textquarry.operators import relations as rel


def test_group_split_keeps_quotas_and_groups(spark):
    df = spark.createDataFrame([(g, i) for g in range(53) for i in range(g % 4 + 1)], "doc_id int, i int")
    out = rel.group_split(df, "doc_id").cache()
    groups = {r["split"]: r["groups"] for r in rel.split_summary(out, "doc_id", ("i",)).collect()}
    assert groups == {"train": 42, "validation": 5, "test": 6} and out.count() == df.count()
    assert rel.leaking_groups(out, "doc_id").count() == 0
    assert sorted(map(tuple, rel.group_split(df.repartition(3), "doc_id").collect())) == sorted(map(tuple, out.collect()))
    one = rel.group_split(df.filter("doc_id = 3"), "doc_id")
    assert [r["split"] for r in one.select("split").distinct().collect()] == ["test"]


def test_tag_spans_equal_the_loop(spark):
    rng = random.Random(1)
    rows = [(d, k, rng.choice(["B", "I", "I", "O", "DISEASE"]), f"t{k}") for d in range(40) for k in range(25)]
    got = sorted((r["d"], r["begin_at"], r["span"]) for r in rel.tag_spans(spark.createDataFrame(rows, "d int, k int, tag string, tok string"), ["d"], "k", "tag", "tok").collect())
    want = []
    for d in range(40):
        open_ = None
        for _, k, tag, token in (r for r in rows if r[0] == d):
            if tag == "B":
                if open_:
                    want.append((d, *open_))
                open_ = (k, token)
            elif tag == "I" and open_:
                open_ = (open_[0], f"{open_[1]} {token}")
            elif tag == "DISEASE":
                want.append((d, k, token))
            elif tag == "O" and open_:
                want.append((d, *open_))
                open_ = None
        if open_:
            want.append((d, *open_))
    assert got == sorted(want)


def test_links(spark):
    sections = spark.createDataFrame([("d", "s0", None, 0), ("d", "s1", "s0", 1), ("d", "s2", "s0", 2), ("d", "s3", None, 3)], "doc_id string, section_id string, parent_id string, order int")
    got = {r["section_id"]: (r["prev_sibling_id"], r["next_sibling_id"]) for r in rel.with_sibling_sections(sections).collect()}
    assert got == {"s0": (None, None), "s1": (None, "s2"), "s2": ("s1", None), "s3": (None, None)}


def test_grid_and_checks(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "a"), ("a", "a"), ("x", "b")], "p string, q string")
    got = {r["combination"]: (r["count"], r["percentage_of_disagreements"]) for r in rel.label_grid(df, "p", "q", ("a", "b", "c")).collect()}
    assert len(got) == 6 and got["a → b"] == (2, 66.67) and got["c → a"] == (0, 0.0)
    empty = rel.label_grid(df.limit(0), "p", "q", ("a", "b")).collect()
    assert [r["percentage_of_disagreements"] for r in empty] == [0.0, 0.0]
    with pytest.raises(rel.CheckFailed, match="repeated p a"):
        rel.check(df, "p", ("p", "q"))
    with pytest.raises(rel.CheckFailed, match="missing: z"):
        rel.check(df, "p", ("z",))


def test_sweep_takes_the_lowest_of_equals(spark):
    df = spark.createDataFrame([("m", "A", 0.3, "A"), ("m", "A", 0.05, "N")], "b string, ans string, s double, gold string")
    best = rel.best_threshold(rel.threshold_sweep(df, "b", "ans", "s", "gold", (0.1, 0.2, 0.3), "N"), "b").first()
    assert (best["threshold"], best["accuracy"]) == (0.1, 1.0)


def test_histogram_and_profile(spark):
    df = spark.createDataFrame([(float(x),) for x in range(11)], "x double")
    assert [r["count"] for r in rel.histogram(df, "x", 5).orderBy("bin").collect()] == [2, 2, 2, 2, 3]
    assert rel.profile(df, "x").first()["p90"] == pytest.approx(9.0)


def test_resume(spark):
    old, new = spark.createDataFrame([(1, "a")], "i int, x string"), spark.createDataFrame([(2,)], "i int")
    assert sorted(map(tuple, rel.resumed(old, new).collect())) == [(1, "a"), (2, None)]
    assert [r[0] for r in rel.remaining(new.union(old.select("i")), old, "i").collect()] == [2]
    assert rel.with_defaults(old, {"x": F.lit("d"), "y": F.lit(0)}).columns == ["i", "x", "y"]
    assert rel.chosen_columns(old, ("i",), ("z", "x")).columns == ["i", "x"]


def test_generators(spark):
    df = spark.createDataFrame([(1, [str(k) for k in range(10)]), (2, ["a"]), (3, [])], "i int, t array<string>")
    got = sorted((r["i"], r["window_start"], len(r["window"])) for r in gen.token_windows(df, "t", 4, 1).collect())
    assert got == [(1, 0, 4), (1, 3, 4), (1, 6, 4), (2, 0, 1), (3, 0, 0)]
    texts = spark.createDataFrame([(1, "In 18 trials, 18 persons." + " " * 40 + "Minimum age 18 years.", "18"), (2, "118 years", "18")], "i int, t string, n string")
    assert [(r["i"], r["answer_start"]) for r in gen.age_spans(texts, "t", "n").collect()] == [(1, 77)]
    picks = spark.createDataFrame([(["Heart failure", "Asthma"], "asthma"), (["Heart failure"], "renal failure"), (["x"], "y")], "c array<string>, s string")
    assert [r[0] for r in picks.select(gen.fuzzy_pick(F.col("c"), F.col("s"))).collect()] == ["Asthma", "Heart failure", None]
    lines = gen.line_blocks(spark.createDataFrame([(1, "a\n\n b  c "), (2, None)], "doc_id int, text string")).collect()
    assert [(r["block_index"], r["text"]) for r in lines] == [(0, "a"), (2, "b c")]
