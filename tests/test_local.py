import random

import pytest
from pyspark.sql import functions as F

from textquarry import cli
from textquarry.functions import replies
from textquarry.operators import generators
from textquarry.operators import relations as rel
from textquarry.plans import local, viewers

from .test_sources import ARTICLE


class Echo:
    def reply(self, field, context):
        if "broken" in context:
            raise OSError("down")
        return '<think>{</think>Sure: {"conditions": "[\'a\', \'b\']", "sex": "ALL"}' if "Title: t" in context else "nothing"


def test_local_submission(spark):
    scored = spark.createDataFrame([("d", k, f"T{k}" if k else "", "x" * 900, 0.9 - k / 10) for k in range(9)], "doc_id string, section_index int, title string, text string, score double")
    body = {r["doc_id"]: r["body"] for r in local.bodies(scored).collect()}["d"]
    chunks = [("" if k == 0 else f"\nT{k}\n") + "x" * 600 + "\n" for k in range(8)]
    want = ""
    for c in chunks:
        if len(want) + len(c) > 5000:
            break
        want += c
    assert body == want
    docs = spark.createDataFrame([("d", "t", "abs"), ("e", "broken", None), ("f", "u", "")], "doc_id string, title string, abstract string")
    prompted = local.prompts(docs, local.bodies(scored))
    got = {r["doc_id"]: r for r in local.submit(prompted, Echo(), thinking=True).collect()}
    assert (got["d"]["conditions"], got["d"]["sex"], got["d"]["minimum_age"], got["d"]["error"]) == ("a, b", "ALL", "Not Specified", None)
    assert got["e"]["error"].startswith("OSError") and got["f"]["error"] == "no JSON object in the reply"
    done = local.submit(prompted.filter("doc_id = 'd'"), Echo(), thinking=True)
    assert sorted(r["doc_id"] for r in local.run(prompted, Echo(), done, thinking=True).collect()) == ["d", "e", "f"]


def test_answers(spark):
    df = spark.createDataFrame([(0, "['a', \"b's\"]"), (1, "a, b"), (2, "[broken"), (3, None)], "k int, t string")
    got = [r[0] for r in df.orderBy("k").select(replies.listed_answer(F.col("t"))).collect()]
    assert got == [["a", "b's"], ["a", "b"], ["[broken"], []]
    schema = replies.response_format("condition_study_type")["json_schema"]["schema"]
    assert schema["required"] == ["conditions", "study_type"] and schema["properties"]["study_type"]["enum"] == ["INTERVENTIONAL", "OBSERVATIONAL"]
    assert replies.response_format("eligibility")["json_schema"]["schema"]["properties"]["inclusion_criteria"]["type"] == "array"
    assert df.select(replies.now_text()).first()[0].endswith("+00:00")


def test_reports(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "p string, t string")
    r = rel.classification_report(df, "p", "t").first()
    assert r["accuracy"] == 0.5 and r["weighted_f1"] == pytest.approx((2 / 3 * 1 + 0.5 * 3) / 4)
    assert rel.hit_rate(spark.createDataFrame([(1,), (None,)], "x int"), "x").first()[0] == 0.5
    kept, held = rel.row_split(spark.range(1000), 0.1)
    assert kept.count() + held.count() == 1000 and 50 < held.count() < 150


def test_cli(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(4):
        (tmp_path / "in" / f"PMC{k}.nxml").write_text(ARTICLE)
    cli.main(["articles", "--nxml-dir", str(tmp_path / "in"), "--output", str(tmp_path / "out"), "--test"], spark)
    assert spark.read.parquet(str(tmp_path / "out" / "documents")).count() == 3
    spark.createDataFrame([(1, "en", "s")], "doc_id long, lang string, source string").write.parquet(str(tmp_path / "t" / "documents.parquet"))
    cli.main(["query", "pair_counts", "--tables", str(tmp_path / "t"), "--output", str(tmp_path / "rows")], spark)
    assert spark.read.parquet(str(tmp_path / "rows")).count() == 1


def test_cli_options(spark, tmp_path, capsys):
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(5):
        (folder / f"PMC{k}.nxml").write_text(f"<article><article-title>T{k}</article-title><abstract>short abstract</abstract><body><sec><title>Methods</title><p>text of {k} that goes on</p><p>more</p></sec></body></article>")
    base = ["--nxml-dir", str(folder), "--output", str(tmp_path / "out")]
    cli.main(["articles", *base, "--ids", "1", "PMC3", "--format", "csv"], spark)
    cli.main(["articles", *base, "--format", "csv", "--resume"], spark)
    found = spark.read.option("header", True).csv(str(tmp_path / "out" / "documents"))
    assert sorted(r["doc_id"] for r in found.collect()) == [f"PMC{k}" for k in range(5)]
    cli.main(["view", *base, "--limit", "2", "--max-chars", "8"], spark)
    views = [r["view"] for r in spark.read.parquet(str(tmp_path / "out" / "views")).collect()]
    assert len(views) == 2 and all("[00] Methods\ntext of " in v and "\n... [truncated]" in v and "Abstract\nshort ab\n... [truncated]" in v for v in views)
    cli.main(["queries", "--with-sql"])
    assert "pair_counts" in capsys.readouterr().out.split()
    with pytest.raises(SystemExit, match="no query"):
        cli.main(["query", "nothing", "--tables", "x", "--output", "y"], spark)


def test_views(spark):
    pairs = spark.createDataFrame([("1", "abcdef", "x", 0.25)], "pmcids string, sex_pred string, sex_gold string, score_sex double")
    assert viewers.predictions(pairs, 3).first()["view"].endswith("sex  0.2500\n  predicted: abc\n... [truncated]\n  gold:      x")
    rows = spark.createDataFrame([(1, "f", "p" * 9), (2, "f", None)], "doc_id int, field string, prompt string")
    got = {r["doc_id"]: (r["chars"], r["view"].split("\n")[-1]) for r in viewers.prompts(rows, 20).collect()}
    assert got == {1: (9, "p" * 9), 2: (0, "")}


def test_many_prototypes_meet_vectors_in_blocks(spark, monkeypatch):
    rng = random.Random(1)
    draw = lambda: [rng.uniform(-1, 1) for _ in range(4)]
    vectors, protos = [draw() for _ in range(50)], [draw() for _ in range(23)]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(vectors)] + [(99, None)], "k int, embedding array<double>")
    queries = spark.createDataFrame([(p,) for p in protos] + [(None,)], "embedding array<double>")
    want = {k: max(sum(a * b for a, b in zip(v, p, strict=True)) for p in protos) for k, v in enumerate(vectors)} | {99: None}
    for packed in (1000, 5):
        monkeypatch.setattr(generators, "PACKED", packed)
        got = {r["k"]: r["similarity"] for r in generators.prototype_similarity(df, queries).collect()}
        assert got[99] is None and {k: x for k, x in got.items() if k != 99} == pytest.approx({k: x for k, x in want.items() if k != 99})
    assert {r["similarity"] for r in generators.prototype_similarity(df, queries.limit(0)).collect()} == {None}


def test_rows_without_a_group_are_one_group(spark):
    df = spark.createDataFrame([(k, None if k % 10 == 0 else f"g{k % 7}") for k in range(70)], "k int, g string")
    got = rel.group_split(df, "g").collect()
    assert len(got) == 70 and len({r["split"] for r in got if r["g"] is None}) == 1
