import pytest
from pyspark.sql import functions as F

from textquarry.functions.annotations import LABELS
from textquarry.operators.relations import CheckFailed
from textquarry.plans import analysis, labelling, models, retrieval, routing
from textquarry.sources import articles
from textquarry.streaming import evidence

from .test_sources import ARTICLE


@pytest.fixture(scope="module")
def parsed(spark):
    return articles.trees(spark.createDataFrame([("PMC1", ARTICLE), ("x", ARTICLE)], "doc_id string, xml string")).cache()


@pytest.fixture(scope="module")
def blocks(parsed):
    return articles.blocks(parsed).withColumnRenamed("order", "block_index").withColumn("char_count", F.char_length("text"))


def test_unified_retrieval(spark, parsed, blocks):
    vectors = retrieval.encoded_blocks(blocks)
    scored = retrieval.prototype_similarity(vectors, retrieval.queries_frame(spark, retrieval.UNIFIED_QUERIES))
    chosen = retrieval.unified(scored)
    stats = retrieval.unified_stats(scored).collect()
    assert {(s["num_blocks"], s["num_candidates"]) for s in stats} == {(6, 6)}
    docs = retrieval.unified_documents(articles.documents(parsed), chosen, retrieval.unified_stats(scored))
    assert [r["block_id"] for r in retrieval.inspect(docs, "1", 2).collect()] == ["PMC1::block_0", "PMC1::block_1"]
    assert retrieval.run_stats(retrieval.unified_stats(scored)).first()["documents"] == 2


def test_field_contexts(spark, parsed, blocks):
    vectors = retrieval.encoded_blocks(blocks)
    queries = {f: retrieval.queries_frame(spark, (f.replace("_", " "),)) for f in ("condition_study_type", "demographics", "eligibility")}
    got = retrieval.field_contexts(vectors, articles.documents(parsed), queries).collect()
    assert len(got) == 6
    one = next(r for r in got if r["field"] == "condition_study_type")
    assert one["context"].startswith("Title:\nA short title") and "Section: " in one["context"]


def test_routing_to_submission(parsed, blocks):
    rows = routing.routed(routing.probabilities(blocks))
    assert {r["eligibility"] >= 3 for r in routing.block_counts(rows).collect()} == {True}
    contexts = routing.contexts(rows, articles.documents(parsed), blocks).cache()
    assert contexts.count() == 6
    good, dead = routing.predictions(contexts)
    out = routing.submit(good).collect()
    assert [r["pmcids"] for r in out] == ["1", "x"] and out[0]["conditions"] == "['Not Specified']" and dead.count() == 0

    class Broken:
        def reply(self, field, context):
            raise RuntimeError("down")

    good, dead = routing.predictions(contexts, Broken())
    assert good.count() == 0 and {r["error_type"] for r in dead.collect()} == {"RuntimeError"}


def test_labelling(spark):
    samples = spark.createDataFrame([(str(k), f"d{k % 3}", f"b{k}", "Methods", "t") for k in range(6)], "sample_id string, doc_id string, block_id string, section_path string, text string")
    reply = '{"label": "%s", "overall_relevance": 3, "reason": "r"}'
    made = [[(str(k), reply % LABELS[(k + s) % 4 if k else 0], None, 10, 10) for k in range(6)] for s in (0, 1)]
    made[1][5] = ("5", "oops", None, 10, 10)
    sides = [labelling.results(spark.createDataFrame(rows, "sample_id string, reply string, error string, input_tokens int, output_tokens int"), n) for rows, n in zip(made, ("haiku", "gemini"), strict=True)]
    both = labelling.compared(samples, *sides).cache()
    s = labelling.summary(both).first()
    assert (s["rows"], s["both_valid"], s["needs_review"]) == (6, 5, 5)
    assert [r["sample_id"] for r in labelling.pending(samples, both, "gemini").collect()] == ["5"]
    assert labelling.disagreements(both).count() == 12
    with pytest.raises(CheckFailed):
        labelling.prepared(both)
    rows = labelling.prepared(both.filter("sample_id <> '5'"))
    assert rows.columns[:4] == ["sample_id", "doc_id", "block_id", "split"] and rows.count() == 5
    assert labelling.prompts(samples).first()["prompt"].startswith("Section: Methods")


def test_comparison_of_systems(spark):
    fields = ("conditions", "study_type", "sex", "minimum_age", "maximum_age", "eligibility_criteria")
    make = lambda rows: spark.createDataFrame([(k, *[v] * 6) for k, v in rows], ", ".join(f"{c} string" for c in ("pmcids", *fields)))
    gold, old, new = make([("1", "18 Years"), ("2", "5")]), make([("PMC1", "9"), ("PMC2", "5"), ("3", "None")]), make([("1", "18 Years"), ("2", "5")])
    assert analysis.comparable(old).count() == 2
    scored = [analysis.scores(analysis.paired(analysis.comparable(s), gold), fast=True) for s in (old, new)]
    v = analysis.verdicts(analysis.compared(*scored)).first()
    assert (v["wins"], v["ties"], v["losses"]) == (1, 1, 0)
    assert analysis.section_scores(spark.createDataFrame([("d", 0, "Age", "x"), ("d", 1, "y", "the age")], "doc_id string, section_index int, title string, text string"), "age").first()["title"] == "Age"
    assert analysis.context_lengths(spark.createDataFrame([("d", "ab")], "doc_id string, context string"), spark.createDataFrame([("d", "abc")], "doc_id string, context string")).first()[1:] == (2, 3)


def test_models(spark):
    e = models.HashingEncoder(16)
    assert (e.encode(["a b", ""])[1] == 0).all() and abs((e.encode(["a b"])[0] ** 2).sum() - 1) < 1e-9
    scored = spark.createDataFrame([("d", k, f"s{k}", s) for k, s in enumerate((0.1, 0.9, 0.9, 0.2, 0.3, 0.1))], "doc_id string, section_index int, text string, similarity double")
    row = models.ranker_examples(scored, "q").first()
    assert row["positive"] == "s1" and row["negatives"] == ["s0", "s2", "s3", "s4"]
    df = spark.createDataFrame([("x", 0.4), ("x", 0.35)], "a string, s double")
    assert [r[0] for r in df.select(models.accepted(F.col("a"), F.col("s"), F.lit(0.35))).collect()] == ["x", "Not Specified"]


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "a\nb"), (2, "c")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    docs = evidence.document_stream(spark, str(tmp_path / "in"))
    score = lambda b: b.withColumn("similarity", F.lit(1.0))
    evidence.select_stream(docs, str(tmp_path / "out"), str(tmp_path / "cp"), score).awaitTermination()
    evidence.select_stream(docs, str(tmp_path / "out"), str(tmp_path / "cp"), score).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
