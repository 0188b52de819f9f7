"""Training and use of the whole extraction on articles with known answers."""

import random

import pytest
from pyspark.sql import functions as F

from textquarry.plans import artifacts, extraction, models


def corpus(n=120):
    rng = random.Random(8)
    docs, parts, gold = [], [], []
    for k in range(n):
        trial, name, low = k % 2, rng.choice(["gout", "heart failure", "asthma"]), rng.choice([18, 21, 40])
        sex = rng.choice(["ALL", "FEMALE"])
        kind = "randomized placebo arms" if trial else "observed registry followed"
        docs.append((k, f"A study of {name}", f"We {kind} patients with {name} in one place, and {name} was common.", ["care"]))
        who = "women only took part" if sex == "FEMALE" else "men and women took part"
        parts += [(k, 0, "Background", "The weather was fine and the river was low that year.", []), (k, 1, "Eligibility criteria", f"Those who could take part in the study: {who}, aged at least {low} years.", []), (k, 2, "Results", "Nothing else was found here at all.", [])]
        gold.append((k, name, "INTERVENTIONAL" if trial else "observational", sex, f"{low} Years", "nan", f"Adults of {low} or more"))
    return docs, parts, gold


@pytest.fixture(scope="module")
def tables(spark):
    docs, parts, gold = corpus()
    d = "doc_id int, title string, abstract string, keywords array<string>"
    p = "doc_id int, section_index int, title string, text string, paragraphs array<string>"
    g = "doc_id int, conditions string, study_type string, sex string, minimum_age string, maximum_age string, eligibility_criteria string"
    return spark.createDataFrame([*docs, (900, None, None, None)], d), spark.createDataFrame([*parts, (901, 0, "x", "no document", [])], p), spark.createDataFrame(gold, g)


def test_train_and_predict(spark, tables, tmp_path):
    docs, parts, gold = tables
    store = str(tmp_path / "store")
    empty = {r["doc_id"]: r for r in extraction.predict(docs.filter("doc_id < 3"), parts, store).collect()}
    assert empty[0]["study_type"] == empty[0]["sex"] == empty[0]["conditions"] == "Not Specified" and "could take part" in empty[0]["eligibility_criteria"]
    found = extraction.train(docs, parts, gold, store, encoder=models.Lazy("hash-64", lambda: models.HashingEncoder(64)), bits=12)
    assert set(found.versions) == {"conditions", "study_type", "sex", "ages"} and found.counts["study_type"] == 120 and found.counts["ranker"] == 120
    assert all(accuracy >= 0.9 for accuracy, _ in found.figures.values()) and set(found.figures) == {"study_type", "sex"}
    assert artifacts.load(spark, store, "ages").thresholds["maximum"] == 0.35
    out = {r["doc_id"]: r for r in extraction.predict(docs, parts, store).collect()}
    assert len(out) == 121 and set(out[900].asDict().values()) == {900, "Not Specified"}
    right = {f: 0 for f in ("conditions", "study_type", "sex", "minimum_age")}
    for r in gold.collect():
        for f in right:
            right[f] += out[r["doc_id"]][f].upper() == r[f].upper()
    assert all(n >= 110 for n in right.values()), right
    picks = spark.createDataFrame([(0, "nothing known")], "doc_id int, reply string")
    assert extraction.predict(docs.filter("doc_id = 0"), parts, store, replies=picks).first()["conditions"] == "nothing known"


def test_weak_tags(spark):
    rows = [("Heart failure, and (failure) heart failure".split(), ["heart failure", "failure"]), (["x"], None), ([], ["x"]), (["a", "b"], ["", "b"])]
    df = spark.createDataFrame(rows, "w array<string>, n array<string>")
    assert [r[0] for r in df.select(extraction.weak_tags(F.col("w"), F.col("n"))).collect()] == [["B", "I", "O", "B", "B", "I"], ["O"], [], ["O", "B"]]
