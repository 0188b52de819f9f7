"""Artifacts, the classifier, generation, section scores, training preparation and streams without copies."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textquarry.plans import artifacts, classifier, generation, models, sections, training
from textquarry.streaming import evidence

# Artifacts


def artifact(seed=0, thresholds=None):
    rng = np.random.default_rng(seed)
    return artifacts.Artifact("m", ("a", "b"), thresholds or {"a": 0.4}, {"w": rng.normal(size=(7, 2)).astype(np.float32), "n": np.arange(3)}, {"bits": 3, "é": [1]})


def test_versions_are_kept_once_and_come_back(spark, tmp_path):
    store, one, two = str(tmp_path), artifact(1), artifact(2)
    assert artifacts.versions(spark, store, "m") == []
    with pytest.raises(ValueError, match="no version"):
        artifacts.load(spark, store, "m")
    first, second = artifacts.keep(spark, one, store), artifacts.keep(spark, two, store)
    assert first != second and artifacts.keep(spark, one, store) == first
    assert [v for v, _ in artifacts.versions(spark, store, "m")] == [first, second]
    back = artifacts.load(spark, store, "m", second)
    assert back.labels == two.labels and back.thresholds == two.thresholds and back.settings == two.settings
    assert all(np.array_equal(back.arrays[k], two.arrays[k]) and back.arrays[k].dtype == two.arrays[k].dtype for k in two.arrays)
    assert artifacts.load(spark, store, "m").to_bytes() == one.to_bytes()
    with pytest.raises(ValueError, match="no version"):
        artifacts.load(spark, store, "m", "f" * 32)
    spark.createDataFrame([(0, bytearray(b"x"))], "part int, content binary").write.mode("overwrite").parquet(f"{store}/m/{first}")
    with pytest.raises(ValueError, match="damaged"):
        artifacts.load(spark, store, "m", first)


def test_label_maps_and_thresholds_are_checked(spark, tmp_path):
    assert artifacts.checked_labels({"b": 1, "a": 0}) == ("a", "b")
    for bad in ({"a": 1}, {"a": 0, "b": 0}, {"a": 0, "b": 2}):
        with pytest.raises(ValueError, match="label map"):
            artifacts.checked_labels(bad)
    for bad in ({"c": 0.5}, {"a": 1.5}):
        with pytest.raises(ValueError, match="thresholds"):
            artifacts.keep(spark, artifact(thresholds=bad), str(tmp_path))


def test_workers_read_a_version_once(spark):
    shipped = artifacts.ship(spark, artifact(3), Held)

    @F.udf("string")
    def ask(k):
        own = shipped.get()
        own.asked += 1
        return f"{id(own)} {own.total:.6f}"

    rows = [r[0].split() for r in spark.range(0, 40, 1, 8).select(ask("id")).collect()]
    assert {x for _, x in rows} == {f"{artifact(3).arrays['w'].sum():.6f}"}
    assert len({k for k, _ in rows}) <= 8


class Held:
    def __init__(self, found):
        self.total, self.asked = float(found.arrays["w"].sum()), 0


def test_lazy_models_are_made_by_key(spark):
    made = models.Lazy("hash-8", lambda: models.HashingEncoder(8))
    assert made.get() is models.Lazy("hash-8", lambda: None).get()
    df = spark.createDataFrame([("a b",), (None,)], "t string")
    assert [len(r["v"]) for r in models.encode(df, "t", "v", made).collect()] == [8, 8]


# Classifier


def test_native_features_equal_those_of_workers(spark):
    rows = [("The  big\tDog the",), ("",), (None,), ("x",), ("été \n a a a",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(classifier.features(F.col("t"), 10)).collect()]
    for (t,), at in zip(rows, got, strict=True):
        found, x = classifier.places(t or "", 10)
        want, c = np.unique(np.array(at, int), return_counts=True)
        assert found.tolist() == want.tolist() and (not len(c) or np.allclose(x, c / np.sqrt((c**2).sum())))


def test_classifier_learns_and_keeps_thresholds(spark, tmp_path):
    rng = random.Random(4)
    words = {"trial": ["randomized", "placebo", "arm"], "cohort": ["observed", "registry", "followed"], "review": ["searched", "pooled", "studies"]}
    draw = lambda k: " ".join(rng.choice(words[k] if rng.random() < 0.5 else ["the", "of", "patients", "were", "in"]) for _ in range(14))
    rows = [(k, draw(k)) for k in words for _ in range(60)] + [(None, "lost"), ("trial", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "label string, t string")
    found = classifier.fit(df, "t", "label", bits=10, rounds=20)
    assert found.labels == ("cohort", "review", "trial") and found.settings["rows"] == 181
    held = spark.createDataFrame([(k, draw(k)) for k in words for _ in range(30)], "truth string, t string")
    out = classifier.predicted(held, "t", found).collect()
    assert sum(r["label"] == r["truth"] for r in out) >= 85 and all(0 < r["probability"] <= 1 for r in out)
    strict = found._replace(thresholds={x: 1.0 for x in found.labels})
    assert {r["label"] for r in classifier.predicted(held, "t", strict).collect()} == {"Not Specified"}
    assert classifier.fit(df.limit(5), "t", "label") is None and classifier.fit(df.filter("label = 'trial'"), "t", "label") is None
    assert {r["label"] for r in classifier.predicted(held, "t", None).collect()} == {"Not Specified"}


def test_classifier_learns_beside_tasks_without_rows(spark):
    df = spark.createDataFrame([(x, f"{x} word {k}") for x, n in (("a", 8), ("b", 5)) for k in range(n)], "label string, t string")
    spread, whole = (classifier.fit(df.repartition(n), "t", "label", bits=6, rounds=3) for n in (40, 1))
    assert np.allclose(spread.arrays["weights"], whole.arrays["weights"], atol=1e-6) and whole.arrays["weights"].any()


# Generation


class Table:
    """Next-token scores from a table by the last token and the source's length."""

    end = 0

    def __init__(self, size=4, seed=1):
        rng = np.random.default_rng(seed)
        self.rows = np.log(rng.dirichlet(np.ones(size), size=(size + 1, 3)))

    def scores(self, sources, prefixes):
        return np.array([self.rows[(p[-1] if p else -1), len(s) % 3] for s, p in zip(sources, prefixes, strict=True)])

    def text(self, tokens):
        return " ".join(f"t{t}" for t in tokens)


def exhaustive(model, source, longest, repetition, run):
    """The best ended sequence by total over length, among all; as long as allowed."""
    best = None
    for n in range(longest):
        for tokens in itertools.product(range(1, 4), repeat=n):
            total, prefix = 0.0, ()
            for t in (*tokens, 0):
                total += generation.allowed(model.scores([source], [prefix])[0], prefix, repetition, run)[t]
                prefix = (*prefix, t)
            if total > -np.inf and (best is None or total / max(n, 1) > best[0] + 1e-12):
                best = (total / max(n, 1), tokens)
    return best[1]


@pytest.mark.parametrize(("repetition", "run"), [(1.0, 0), (2.0, 3), (1.3, 2)])
def test_wide_beams_equal_exhaustive_search(repetition, run):
    for seed in range(6):
        model = Table(seed=seed)
        sources = ["a", "bb", "ccc"]
        found = generation.beams(model, sources, 5, 4**5, repetition, run)
        for s, tokens in zip(sources, found, strict=True):
            value = [sum(generation.allowed(model.scores([s], [p[:k]])[0], p[:k], repetition, run)[(*p, 0)[k]] for k in range(len(p) + 1)) / max(len(p), 1) for p in (tokens, exhaustive(model, s, 5, repetition, run))]
            assert value[0] == pytest.approx(value[1], abs=1e-9)


def test_runs_do_not_repeat_and_rows_are_alone():
    model = Table(seed=3)
    model.rows[:, :, 0] = -50.0  # hardly ever ends
    sources = ["a", "bb", "ccc", "dddd"]
    found = generation.beams(model, sources, 30)
    for tokens in found:
        runs = [tokens[k : k + 3] for k in range(len(tokens) - 2)]
        assert len(runs) == len(set(runs))
    assert found == [generation.beams(model, [s], 30)[0] for s in sources]


def test_two_stages(spark):
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id int")
    rows = [(1, 0, "low", 0.1), (1, 1, "high", 0.9), (1, 2, "mid", 0.5), (1, 3, "none", 0.0), (2, 0, " ", 0.9)]
    parts = spark.createDataFrame(rows, "doc_id int, section_index int, text string, score double")
    plain = {r["doc_id"]: r["eligibility"] for r in generation.two_stages(docs, parts).collect()}
    assert plain == {1: "high mid low", 2: "Not Specified", 3: "Not Specified"}
    made = {r["doc_id"]: r["eligibility"] for r in generation.two_stages(docs, parts, models.Lazy("table", Table), longest=6).collect()}
    assert made[1] == (Table().text(generation.beams(Table(), ["high mid low"], 6)[0]) or "Not Specified") and made[2] == made[3] == "Not Specified"


# Sections


def test_pooling_equals_masked_means(spark):
    rng = np.random.default_rng(5)
    rows = [([[float(x) for x in v] for v in rng.normal(size=(n, 3))], [int(x) for x in rng.integers(0, 2, n)]) for n in (1, 2, 5, 9)]
    rows += [([[1.0, 2.0, 3.0]], [0]), ([], []), (None, None)]
    got = [r[0] for r in spark.createDataFrame(rows, "v array<array<double>>, m array<int>").select(sections.pooled(F.col("v"), F.col("m"))).collect()]
    for (v, m), g in zip(rows, got, strict=True):
        if not v:
            assert g is None
        else:
            w = np.array(m, float)
            assert g == pytest.approx(((np.array(v) * w[:, None]).sum(axis=0) / max(w.sum(), 1e-9)).tolist())


def test_views_and_candidates(spark):
    long = "who may take part in the study is said in a line that goes on for more than eighty characters here"
    rows = [(1, 0, "Methods", f"short\n{long}\nother words in a line that goes on and on for more than eighty characters, as I said", ["a b"]), (1, 1, None, None, None), (1, 2, "", f"{long} x", [long, "few words"]), (1, 3, "who may take part", "nothing", []), (2, 0, " ", " ", [])]
    df = spark.createDataFrame(rows, "doc_id int, section_index int, title string, text string, paragraphs array<string>")
    query, encoder = "who may take part in the study", models.HashingEncoder()
    cos = lambda t: float(encoder.encode([t])[0] @ encoder.encode([query])[0]) if t else 0.0
    got = {(r["doc_id"], r["section_index"]): r for r in sections.view_scores(df, query).collect()}
    one = got[1, 0]
    assert one["title_score"] == pytest.approx(cos("Methods")) and one["body_score"] == pytest.approx(cos(rows[0][3])) and one["opening_score"] == pytest.approx(cos(rows[0][3][:200]))
    assert one["best_paragraph"] == long and one["paragraph_score"] == pytest.approx(cos(long))
    assert got[1, 1]["title_score"] == 0 and got[1, 1]["paragraph_score"] is None and got[1, 1]["best_paragraph"] is None
    ranked = sections.ranked_sections(sections.view_scores(df, query), threshold=0.1).filter("doc_id = 1").orderBy("rank").collect()
    assert [r["section_index"] for r in ranked][0] == 3 and all(r["score"] >= 0.1 for r in ranked)
    best = sections.ranker_candidates(df, query, k=10).filter("doc_id = 1").orderBy("rank").collect()
    want = [(f"Methods {rows[0][3][:300]}", rows[0][3]), (f"{long} x", f"{long} x"), (long, long), ("who may take part nothing", "nothing")]
    assert [(r["text"], round(r["score"], 9)) for r in best] == [(t, round(cos(s), 9)) for s, t in sorted(want, key=lambda x: -cos(x[0]))]
    truths = spark.createDataFrame([(1, query), (2, "x")], "doc_id int, truth string")
    pairs = sections.truth_similarity(df, truths).collect()
    assert {r["section_index"] for r in pairs} == {0, 2, 3} and all(r["similarity"] == pytest.approx(cos(r["text"])) for r in pairs)
    examples = models.ranker_examples(spark.createDataFrame(pairs), query).first()
    assert examples["positive"].startswith("who may take part nothing") or examples["positive"].strip().startswith("who may")
    assert len(examples["negatives"]) == 2


# Training tables


def test_all_trainings_share_one_split(spark):
    docs = spark.createDataFrame([(k, f"Title {k}", f"Adults aged 18 to 65 years, text {k}" if k % 2 else None) for k in range(40)] + [(None, "t", "a")], "doc_id int, title string, abstract string")
    gold = spark.createDataFrame(
        [(k, "['gout', 'asthma']" if k % 3 else "nan", "observational" if k < 30 else " ", "all" if k < 9 else "Not Specified", "18 Years" if k % 2 else "nan", "66 Years", "adults only") for k in range(38)],
        "doc_id int, conditions string, study_type string, sex string, minimum_age string, maximum_age string, eligibility_criteria string",
    )
    candidates = spark.createDataFrame([(1, " "), (2, "Age 21 years or 66 years old"), (4, "66 beds and 66 yrs")], "doc_id int, candidate_text string")
    names = spark.createDataFrame([(k, ["Gout", "Lupus"] if k != 4 else []) for k in range(40)], "doc_id int, candidates array<string>")
    found = training.prepared(docs, gold, candidates, names)
    assert found.counts["study_type"] == 30 and found.counts["sex"] == 9 and "sex" not in found.tables
    assert found.counts["conditions"] == len([k for k in range(38) if k % 3 and k != 4]) and found.counts["generator"] == 19 + 2
    rows = found.tables["ages"].collect()
    assert all(r["context"][r["start_pos"] : r["start_pos"] + 2] == r["answer_text"] for r in rows)
    spans = {(r["doc_id"], r["question"]): (r["answer_text"], r["start_pos"]) for r in rows}
    low, high = training.QUESTIONS["minimum"], training.QUESTIONS["maximum"]
    assert spans[1, low] == ("18", 12) and (1, high) not in spans and spans[2, high] == ("66", 16) and spans[4, high][0] == "66"
    line = found.tables["conditions"].filter("doc_id = 1").first()
    assert line["target"] == "gout, asthma" and "Candidates: Gout, Lupus\n\nSelect" in line["input"]
    splits = {}
    for table in found.tables.values():
        for r in table.select("doc_id", "split").collect():
            assert splits.setdefault(r["doc_id"], r["split"]) == r["split"]
    assert set(splits.values()) == {"train", "validation", "test"}


# Streams


def test_copies_are_dropped_across_batches(spark, tmp_path):
    path, out = tmp_path / "in", []
    schema = "doc_id long, text string, arrived timestamp"

    def add(name, rows):
        spark.createDataFrame(rows, "doc_id long, text string, at string").select("doc_id", "text", F.col("at").cast("timestamp").alias("arrived")).coalesce(1).write.mode("append").parquet(str(path))

    def run():
        docs = evidence.once_stream(evidence.document_stream(spark, str(path), schema, 1), within="1 hour")
        writer = docs.writeStream.option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda b, n: out.extend(b.collect()))
        writer.trigger(availableNow=True).start().awaitTermination()

    add("a", [(1, "x", "2024-01-01 10:00:00"), (1, "x", "2024-01-01 10:01:00"), (2, "y", "2024-01-01 10:02:00")])
    run()
    assert sorted(r["doc_id"] for r in out) == [1, 2]
    add("b", [(1, "again", "2024-01-01 10:30:00"), (3, "z", "2024-01-01 10:31:00")])
    run()  # a new run goes on from the state
    assert sorted(r["doc_id"] for r in out) == [1, 2, 3]
    add("c", [(4, "far", "2024-01-02 10:00:00")])
    run()
    add("d", [(1, "later", "2024-01-02 10:01:00"), (4, "copy", "2024-01-02 10:02:00")])
    run()
    assert sorted(r["doc_id"] for r in out) == [1, 1, 2, 3, 4], "the state forgets what lies behind"
