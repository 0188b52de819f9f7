"""Taxonomies, tags, entities, answers and calls against brute force."""

import itertools
import json
import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textquarry.plans import answers, calls, entities, model_queries, tagging, taxonomy
from textquarry.plans.queries import ORACLES

# Taxonomies

LINKS = [("dog", "canine"), ("wolf", "canine"), ("canine", "animal"), ("cat", "feline"), ("feline", "animal"), ("cat", "pet"), ("dog", "pet"), ("pet", "thing"), ("animal", "thing"),
         ("loop", "pool"), ("pool", "loop"), ("rock", "thing"), ("self", "self"), ("lone", None), (None, "thing")]
COUNTS = [("dog", 8), ("wolf", 2), ("cat", 6), ("canine", 1), ("rock", 3), ("pet", 0), ("loop", 4), ("unknown", 9)]
SENSES = [("hound", "dog", 1), ("dog", "dog", 1), ("dog", "rock", 4), ("cat", "cat", 1), ("cat", "feline", 2), ("wolf", "wolf", 1), ("stone", "rock", 1), ("ghost", "lone", 1), ("loop", "loop", 1)]


def reachable():
    up = {}
    for c, p in LINKS:
        if c:
            up.setdefault(c, set()).update({p} - {None})
        if c and p:
            up.setdefault(p, set())
    out = {}
    for c in up:
        seen, todo = {c}, [c]
        while todo:
            new = up[todo.pop()] - seen
            seen |= new
            todo += new
        out[c] = seen
    return out


def informations():
    reach = reachable()
    counts = {c: n for c, n in COUNTS if c in reach}
    total = sum(counts.values())
    n = {a: sum(k for c, k in counts.items() if a in reach[c]) for a in reach}
    return {a: math.log(total / k) for a, k in n.items() if k}


def likeness(a, b):
    reach, info = reachable(), informations()
    best = 0.0
    for (w, x, r), (v, y, s) in itertools.product(SENSES, SENSES):
        if (w, v) == (a, b) and r <= 3 and s <= 3 and x in info and y in info and info[x] + info[y] > 0:
            shared = [info[c] for c in reach[x] & reach[y] if c in info]
            best = max([best, *(2 * i / (info[x] + info[y]) for i in shared)])
    return best


@pytest.fixture(scope="module")
def animals(spark):
    links = spark.createDataFrame(LINKS, "concept string, parent string")
    ancestors = taxonomy.closure(links)
    senses = spark.createDataFrame([(w, "NOUN", c, r) for w, c, r in SENSES], "word string, pos string, concept string, rank int")
    return taxonomy.Taxonomy(senses, ancestors, taxonomy.information(ancestors, spark.createDataFrame(COUNTS, "concept string, n long")))


def test_closure_and_information(animals):
    assert {(r[0], r[1]) for r in animals.ancestors.collect()} == {(c, a) for c, up in reachable().items() for a in up}
    found = {r["concept"]: r["information"] for r in animals.information.collect()}
    assert found == pytest.approx(informations())


def test_word_similarity_equals_brute_force(spark, animals):
    words = sorted({w for w, _, _ in SENSES} | {"never"})
    pairs = spark.createDataFrame([(a, b, "NOUN") for a in words for b in words], "a string, b string, pos string")
    found = {(r["a"], r["b"]): r["similarity"] for r in animals.similarity(pairs).collect()}
    assert found == pytest.approx({(a, b): likeness(a, b) for a in words for b in words})
    assert found["hound", "dog"] == 1.0 and 0 < found["wolf", "dog"] < 1 and found["never", "never"] == 0
    same = {(r["a"], r["b"]): r["similarity"] for r in taxonomy.equal_words(pairs).collect()}
    assert same == {(a, b): float(a == b) for a in words for b in words}


class Plain:
    """Tokens by fixed lists."""

    def tokens(self, texts):
        kind = lambda w: ("VERB", "VBZ" if w.endswith("s") else "VBD") if w in ("runs", "ran", "sits", "has") else ("NOUN", "NN")
        return [[{"lemma": w, "pos": kind(w)[0], "tag": kind(w)[1], "stop": w in ("the", "a"), "alpha": w.isalpha()} for w in t.lower().split()] for t in texts]


def by_hand(a, b, like):
    """The text score as its definition has it."""
    if a is None or b is None or a.strip().lower() in ("", "nan", "not specified") or b.strip().lower() in ("", "nan", "not specified"):
        return 0.0
    one, two = Plain().tokens([a.strip()[:1000], b.strip()[:1000]])
    nouns = [[t["lemma"] for t in x if t["pos"] == "NOUN" and not t["stop"]] for x in (one, two)]
    noun = np.mean([max(like(n, m) for m in nouns[1]) for n in nouns[0]]) if all(nouns) else 0.0
    verbs = [[(t["lemma"], t["tag"]) for t in x if t["pos"] == "VERB" and t["lemma"] != "have"] for x in (one, two)]
    each = []
    for v, tag in verbs[0]:
        pool = [w for w, t in verbs[1] if t == tag] or [w for w, _ in verbs[1]]
        each.append(max((like(v, w) for w in pool), default=0.0))
    verb = np.mean(each) if all(verbs) else 0.0
    ws = [[t["lemma"] for t in x if not t["stop"] and t["alpha"]] for x in (one, two)]
    overlap = 0.0
    if all(ws):
        bg = [set(itertools.pairwise(w)) for w in ws]
        overlap = 0.6 * len(set(ws[0]) & set(ws[1])) / max(len(set(ws[0])), len(set(ws[1]))) + 0.4 * len(bg[0] & bg[1]) / max(len(ws[0]) - 1, len(ws[1]) - 1, 1)
    x, y = noun**0.6, (verb + overlap) ** 0.24
    return min(1.0, max(0.0, (x + y) / (1 + x)))


TEXTS = ["the dog runs", "a hound ran and ran", "wolf sits", "the cat", "Not Specified", None, "", "stone 12 dog dog cat", "runs", "the a the", "cat " * 400]


@pytest.mark.parametrize("graded", [True, False])
def test_text_scores_equal_the_definition(spark, animals, graded):
    rows = [(f"{i}:{k}", a, b) for i, a in enumerate(TEXTS) for k, b in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "key string, a string, b string")
    df = taxonomy.analysed(taxonomy.analysed(df, "a", "ta", Plain), "b", "tb", Plain)
    like = (lambda x, y: likeness(x, y)) if graded else (lambda x, y: float(x == y))
    found = taxonomy.text_scores(df, "key", "a", "b", "ta", "tb", animals.similarity if graded else taxonomy.equal_words)
    got = {r["key"]: r["score"] for r in found.collect()}
    assert got == pytest.approx({k: by_hand(a, b, like) for k, a, b in rows}, abs=1e-9)


def test_text_scores_without_rows_of_word_pairs(spark, animals):
    rows = [(f"{i}:{k}", a, b) for i, a in enumerate(TEXTS) for k, b in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "key string, a string, b string")
    df = taxonomy.analysed(taxonomy.analysed(df, "a", "ta", Plain), "b", "tb", Plain)
    held, joined = (taxonomy.text_scores(df, "key", "a", "b", "ta", "tb", animals, held=n) for n in (taxonomy.HELD, 0))
    assert "Join" not in held._jdf.queryExecution().executedPlan().toString()
    want = pytest.approx({k: by_hand(a, b, likeness) for k, a, b in rows}, abs=1e-9)
    assert all({r["key"]: r["score"] for r in t.collect()} == want for t in (held, joined))


@pytest.mark.parametrize("dealt", [1, 40, 1 << 21])
def test_text_scores_by_parts_of_the_words(spark, animals, dealt):
    """Beyond what every task may hold, no pairs of words are made as rows either."""
    rows = [(f"{i}:{k}", a, b) for i, a in enumerate(TEXTS) for k, b in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "key string, a string, b string")
    df = taxonomy.analysed(taxonomy.analysed(df, "a", "ta", Plain), "b", "tb", Plain)
    pairs = []
    watched = type("Watched", (taxonomy.Taxonomy,), {"similarity": lambda self, p: pairs.append(p) or super(type(self), self).similarity(p)})(*animals)
    found = taxonomy.text_scores(df, "key", "a", "b", "ta", "tb", watched, held=0, dealt=dealt)
    assert {r["key"]: r["score"] for r in found.collect()} == pytest.approx({k: by_hand(a, b, likeness) for k, a, b in rows}, abs=1e-9) and not pairs


def test_matches_in_place_equal_joins(spark, animals):
    """Random words, null words, null tags and tags that only one side has, in slices of lists."""
    rng = random.Random(5)
    words, tags = ["hound", "dog", "cat", "wolf", "stone", "ghost", "loop", "never", None], ["x", "y", "z", None]
    side = lambda: [{"word": rng.choice(words), "tag": rng.choice(tags)} for _ in range(rng.randrange(6))]
    rows = [(k, "NOUN", side(), side()) for k in range(300)]
    token = "array<struct<word:string,tag:string>>"
    pairs = spark.createDataFrame(rows, f"key int, pos string, left {token}, right {token}").withColumns({c: F.filter(c, lambda t: t["word"].isNotNull() & t["tag"].isNotNull()) for c in ("left", "right")})
    want = {r["key"]: r["matched"] for r in taxonomy.best_matches(pairs, "key", animals.similarity).collect()}
    needed = spark.createDataFrame([(w, "NOUN") for w in words if w], "word string, pos string")
    held = taxonomy.Profiles(taxonomy._profile(needed, animals).filter("shared > 0").groupBy("pos", "word", "ancestor").agg(F.min("own").alias("own"), F.first("shared").alias("shared")).toArrow())
    lists = pairs.select("key", "left", "right").toArrow().combine_chunks()
    got = {}
    for part in (lists.slice(0, 100), lists.slice(100, 150), lists.slice(250)):
        batch = part.to_batches()[0]
        got.update(zip(batch["key"].to_pylist(), held.matched("NOUN", *batch.columns[1:]).to_pylist(), strict=True))
    assert {k: v for k, v in got.items() if v is not None} == pytest.approx(want)
    # A null word counts for nothing; a null tag meets all words; a tag that only a null word has meets none.
    one = lambda words, tags: pa.array([[{"word": w, "tag": t} for w, t in zip(words, tags, strict=True)]], pa.list_(pa.struct([("word", pa.string()), ("tag", pa.string())])))
    match = lambda w, t, v, u: held.matched("NOUN", one(w, t), one(v, u)).to_pylist()
    assert match(["dog", None], ["x", "x"], ["dog"], ["x"]) == [1.0] and match(["dog"], [None], ["dog", "cat"], ["x", "y"]) == [1.0]
    assert match(["dog"], ["x"], [None, "dog"], ["x", "y"]) == [None] and match(["never", "dog"], ["x", "x"], ["dog"], ["x"]) == [0.5] and match([], [], ["dog"], ["x"]) == [None]


def test_whole_turns_are_scored(spark, tmp_path):
    """Texts that differ only after their first thousand characters have different scores, as in the SQL."""
    start = "green rivers carry stones " * 50
    turns = [(k, t, start + end) for k, ends in enumerate((("horses wander", "horses wander"), ("horses wander", "violet anchors"), ("", "pens"))) for t, end in enumerate(ends)]
    spark.createDataFrame(turns, "conv_id int, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    words = "green rivers carry stones horses wander violet anchors pens wonder mothers"
    spark.createDataFrame([(1, words)], "doc_id int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    for t in ("conversations", "documents"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = dict(duck.execute(ORACLES["analysed_scores"]).fetchall())
    found = {r["turn_key"]: r["score"] for r in model_queries.analysed_scores(spark, str(tmp_path)).collect()}
    assert found == pytest.approx(want, abs=1e-8) and len(set(found.values())) == len(found) == 3


# Tags


def test_tags_equal_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["the", "dog", "dogs", "barks", "barked", "loudly", "a", "of"]
    rows = [(s, p, rng.choice(vocabulary), rng.choice("DNVA")) for s in range(40) for p in range(rng.randrange(1, 7))] + [(99, 0, None, "D"), (99, 1, "x", None)]
    model = tagging.train(spark.createDataFrame(rows, "sentence int, place int, word string, tag string"))
    words = {r["word"]: r["word_scores"] for r in model.words.collect()}
    ends = {r["ending"]: r["ending_scores"] for r in model.endings.collect()}
    assert model.tags == ["A", "D", "N", "V"]

    def best(sentence):
        emitted = [words.get((w or "").lower()) or ends.get((w or "").lower()[-3:]) or model.other for w in sentence]
        n, t = len(sentence), len(model.tags)
        total = lambda path: model.first[path[0]] + sum(e[x] for e, x in zip(emitted, path, strict=True)) + sum(model.moves[a][b] for a, b in itertools.pairwise(path))
        # Of equal totals the one whose last tags sort first.
        return [model.tags[x] for x in max(itertools.product(range(t), repeat=n), key=lambda p: (total(p), [-x for x in reversed(p)]))]

    sentences = [[rng.choice([*vocabulary, "zzz", "hogs", "É", "The", None]) for _ in range(rng.randrange(1, 6))] for _ in range(60)]
    df = spark.createDataFrame([(k, s, "x") for k, s in enumerate([*sentences, [], None])], "id int, w array<string>, word string")
    got = {r["id"]: r["tags"] for r in tagging.tag(df, "w", model).collect()}
    assert got == {k: best(s) for k, s in enumerate(sentences)} | {60: [], 61: []}
    long = spark.createDataFrame([(["dog", "barks"] * 1500,)], "w array<string>")
    assert len(tagging.tag(long, "w", model).first()["tags"]) == 3000
    with pytest.raises(ValueError, match="none"):
        tagging.train(spark.createDataFrame([], "sentence int, place int, word string, tag string"))


def test_sentences_are_tagged_where_they_are_read(spark):
    rng = random.Random(5)
    draw = lambda: rng.choice(["dog", "dogs", "Barks", "of", "zzz", "hogs", None])
    model = tagging.train(spark.createDataFrame([(s, p, draw(), rng.choice("DNV")) for s in range(30) for p in range(5)], "sentence int, place int, word string, tag string"))
    df = spark.createDataFrame([(k, [draw() for _ in range(k % 9)]) for k in range(200)] + [(200, None), (201, ["dog"] * 2500)], "id int, w array<string>")
    held = tagging.tag(df, "w", model)
    assert "Exchange" not in held._jdf.queryExecution().executedPlan().toString()
    got, joined = ({r["id"]: r["tags"] for r in t.collect()} for t in (held, tagging.tag(df, "w", model, held=0)))
    assert got == joined and [len(got[k]) for k in (8, 200, 201)] == [8, 0, 2500]


# Entities


def test_decoding_equals_all_allowed_sequences():
    rng = np.random.default_rng(4)
    for n in range(1, 6):
        tagger = entities.Tagger(moves=rng.integers(-3, 4, (4, 3)).astype(float), bits=4)
        scores = rng.integers(-3, 4, (n, 3)).astype(float)
        ok = [p for p in itertools.product(range(3), repeat=n) if all(x != 1 or (k and p[k - 1] != 2) for k, x in enumerate(p))]
        total = lambda p: scores[range(n), p].sum() + tagger.moves[3, p[0]] + sum(tagger.moves[a, b] for a, b in itertools.pairwise(p))  # noqa: B023, E731
        path = tagger.path(scores)
        assert tuple(path) in ok and total(path) == max(map(total, ok))


def test_tagger_learns_and_is_the_same_each_time(spark):
    rng = random.Random(5)
    names, rest = [("heart", "failure"), ("asthma",), ("type", "two", "diabetes")], ["patients", "with", "and", "the", "trial", "of", "failure", "two"]

    def sentence():
        words, tags = [], []
        for _ in range(rng.randrange(1, 5)):
            part = rng.choice(names) if rng.random() < 0.5 else [rng.choice(rest)]
            words += part
            tags += ["B", *["I"] * (len(part) - 1)] if tuple(part) in names else ["O"]
        return words, tags

    data = [sentence() for _ in range(300)]
    df = spark.createDataFrame([*data[:200], (None, None), ([], [])], "words array<string>, tags array<string>")
    one, two = entities.train(df, shards=3, bits=12), entities.train(df.repartition(5), shards=3, bits=12)
    assert np.array_equal(one.weights, two.weights) and np.array_equal(one.moves, two.moves)
    held = spark.createDataFrame([(w, t) for w, t in data[200:]] + [([], []), (None, [])], "w array<string>, truth array<string>")
    rows = entities.tagged(held, "w", one).collect()
    right = sum(a == b for r in rows for a, b in zip(r["tags"], r["truth"], strict=True))
    assert right >= 0.95 * sum(len(r["truth"]) for r in rows)
    assert entities.allowed(["I", "I", "O", "I", "B", "I"]) == ["B", "I", "O", "B", "B", "I"]
    assert not entities.train(df.limit(0), bits=4).weights.any()


def test_conditions_from_tokens_to_selection(spark):
    tokens = [
        (1, 0, k, t, g) for k, (t, g) in enumerate([("Heart", "B"), ("failure", "I"), ("in", "O"), ("us", "B"), ("Asthma", "DISEASE")])
    ] + [(1, 1, 0, "asthma", "B"), (1, 1, 1, "Type", "B"), (1, 1, 2, "two", "I"), (2, 0, 0, "Gout", "B"), (3, 0, 0, "x", "B"), (5, 2, 0, "Gout", "B"), (5, 1, 0, "Lupus", "B")]
    df = spark.createDataFrame(tokens, "doc_id int, source int, place int, token string, tag string")
    docs = spark.createDataFrame([(k,) for k in range(1, 6)], "doc_id int")
    replies = spark.createDataFrame([(1, "ASTHMA, failure of two, none"), (2, "Flu , "), (3, "Gout"), (5, " , ")], "doc_id int, reply string")
    got = {r["doc_id"]: r["conditions"] for r in entities.conditions(docs, df, replies).collect()}
    assert got == {1: ["Asthma", "Heart failure"], 2: ["Flu"], 3: ["Not Specified"], 4: ["Not Specified"], 5: ["Not Specified"]}
    every = {r["doc_id"]: r["conditions"] for r in entities.conditions(docs, df).collect()}
    assert every[1] == ["Heart failure", "Asthma", "Type two"] and every[5] == ["Lupus", "Gout"] and every[4] == ["Not Specified"]


# Answers


def softmax(x):
    e = np.exp(np.array(x) - max(x))
    return e / e.sum()


@pytest.mark.parametrize("independent", [False, True])
def test_spans_equal_brute_force(spark, independent):
    rng = random.Random(6)
    rows = []
    for k in range(80):
        n = rng.randrange(1, 9)
        rows.append((k, [f"t{i}" for i in range(n)], [float(rng.randrange(-3, 4)) for _ in range(n)], [float(rng.randrange(-3, 4)) for _ in range(n)]))
    odd = [(100, [], [], []), (101, ["a"], None, [1.0]), (102, ["a", "b"], [1.0], [1.0, 2.0]), (103, ["a", "b"], [None, 1.0], [5.0, None])]
    df = spark.createDataFrame(rows + odd, "k int, window array<string>, starts array<double>, ends array<double>")
    got = {r["k"]: (r["answer"], r["score"]) for r in answers.window_answers(df, independent=independent).collect()}
    for k, tokens, s, e in rows:
        if independent:
            i, j = s.index(max(s)), e.index(max(e))
        else:
            i, j = max(((a, b) for b in range(len(s)) for a in range(b + 1)), key=lambda p: (s[p[0]] + e[p[1]], -p[1], -p[0]))
        want = (" ".join(tokens[i : j + 1]), (softmax(s)[i] + softmax(e)[j]) / 2) if j >= i else (None, None)
        assert got[k] == (want[0], pytest.approx(want[1])), k
    assert got[100] == got[101] == got[102] == (None, None)
    assert got[103][0] == (None if independent else "a") or not independent


def test_windows_merge_and_thresholds(spark):
    said = [(1, "minimum", 0, "18 or so", 0.6), (1, "minimum", 350, "no", 0.6), (1, "minimum", 700, "21", 0.5), (2, "minimum", 0, "20.5 yrs", 0.2), (3, "maximum", 0, "none", 0.9), (4, "minimum", 0, None, None)]
    df = spark.createDataFrame(said, "doc int, bound string, window_start int, answer string, score double")
    merged = answers.merged(df, ["doc", "bound"])
    assert {(r["doc"], r["answer"]) for r in merged.collect()} == {(1, "18 or so"), (2, "20.5 yrs"), (3, "none")}
    gold = spark.createDataFrame([(1, "minimum", "18 Years"), (2, "minimum", "21 Years"), (3, "maximum", "65 Years"), (4, "minimum", "nan"), (5, "minimum", None)], "doc int, bound string, gold string")
    found = {r["bound"]: (round(r["threshold"], 6), r["accuracy"]) for r in answers.calibrated(merged, gold, ("minimum", "maximum", "median"), ["doc"]).collect()}
    assert found == {"minimum": (0.1, 0.5), "maximum": (0.35, 0.0), "median": (0.35, 0.0)}
    thresholds = spark.createDataFrame([("minimum", 0.3)], "bound string, threshold double")
    out = {(r["doc"], r["bound"]): r["answer"] for r in answers.accepted_answers(gold, merged, thresholds, ["doc"]).collect()}
    assert out == {(1, "minimum"): "18 Years", (2, "minimum"): "Not Specified", (3, "maximum"): "none", (4, "minimum"): "Not Specified", (5, "minimum"): "Not Specified"}


# Calls


class Counting:
    """Replies that name the body; each call leaves a line in a file."""

    def __init__(self, path, fail=()):
        self.path, self.fail, self.seen = path, fail, {}

    def send(self, body):
        with open(self.path, "a") as f:
            f.write(json.dumps(body) + "\n")
        self.seen[body] = self.seen.get(body, 0) + 1
        for word, times in self.fail:
            if word in body and self.seen[body] <= times:
                raise TimeoutError(f"no answer to {word}")
        if "empty" in body:
            return '{"choices": [{"message": {"content": "  "}}]}'
        text = [{"type": "text", "text": "in "}, {"type": "image"}, {"type": "text", "text": "parts"}] if "parts" in body else f"reply to {body}"
        return json.dumps({"choices": [{"message": {"content": text}, "finish_reason": "stop"}], "usage": {"prompt_tokens": 1000, "output_tokens": 100, "reasoning_tokens": 7}})


def lines(path):
    return [json.loads(x) for x in open(path)] if path.exists() else []


def test_calls_are_made_once_and_resumed(spark, tmp_path):
    sent, store = tmp_path / "sent", f"{tmp_path}/store"
    bodies = [(k, f"body {k % 12}") for k in range(40)] + [(40, None), (41, "empty"), (42, "parts"), (43, "late"), (44, "never")]
    requests = spark.createDataFrame(bodies, "id int, body string").repartition(3)
    make = lambda: Counting(str(sent), (("late", 2), ("never", 99)))
    waits = spark.sparkContext.accumulator(0.0)
    waves = calls.run(requests, store, make, most=3, wave=4, senders=2, wait=lambda seconds: waits.add(seconds))
    assert waves == 4 and len(lines(sent)) == 12 + 1 + 3 * 3 and waits.value >= 6 * 1
    out = {r["id"]: r for r in calls.answered(requests, store).collect()}
    assert all(out[k]["reply"] == f"reply to body {k % 12}" and out[k]["attempts"] == 1 and out[k]["error"] == "" for k in range(40))
    assert out[0]["input_tokens"] == 1000 and out[0]["output_tokens"] == 100 and out[0]["reasoning_tokens"] == 7 and out[0]["cost_usd"] == pytest.approx(0.0045)
    assert out[42]["reply"] == "in parts" and out[43]["attempts"] == 3 and out[43]["reply"] == "reply to late"
    assert out[44]["reply"] is None and out[44]["error"] == "TimeoutError: no answer to never" and out[41]["error"] == "ValueError: empty content" and out[40]["error"] == "not sent"
    assert {r["id"] for r in calls.blank_replies(calls.answered(requests, store)).collect()} == {40, 41, 44}
    # A second run sends only what has no reply, a run over answered requests nothing.
    before = len(lines(sent))
    assert calls.run(requests, store, make, most=1, wait=lambda s: None) == 1
    assert sorted(lines(sent)[before:]) == ["empty", "never"]
    assert calls.run(requests.filter("id < 40"), store, make) == 0
    log = calls.log(spark, store).collect()
    assert len(log) == len(lines(sent)) and all(r["body"] for r in log if r["status"] == "success")


def test_waves_do_not_read_the_requests_again(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def said(k):
        seen.add(1)
        return f"body {k}"

    read = {}
    for wave in (4, 100):
        before, store = seen.value, f"{tmp_path}/store{wave}"
        waves = calls.run(spark.range(40).select(said("id").alias("body")), store, lambda: Counting(str(tmp_path / "sent")), wave=wave, senders=2)
        read[waves] = seen.value - before
        assert calls.replies(spark, store).count() == 40
    assert set(read) == {10, 1} and read[10] == read[1]


def test_a_killed_run_keeps_its_waves(spark, tmp_path):
    """A wave that fails as a whole leaves the waves before it in the store."""
    sent, store = tmp_path / "sent", f"{tmp_path}/store"
    requests = spark.createDataFrame([(f"body {k}",) for k in range(30)], "body string")

    class Dying(Counting):
        def send(self, body):
            if len(lines(tmp_path / "sent")) >= 12:
                raise KeyboardInterrupt
            return super().send(body)

    with pytest.raises(Exception, match="KeyboardInterrupt"):
        calls.run(requests, store, lambda: Dying(str(sent)), wave=5, senders=1)
    kept = calls.replies(spark, store).count()
    assert 0 < kept <= 12
    before = len(lines(sent))
    calls.run(requests, store, lambda: Counting(str(sent)), wave=5, senders=1)
    assert len(lines(sent)) - before == 30 - kept and calls.replies(spark, store).count() == 30


def test_requests_with_the_same_first_digits_fail_on_their_own(spark, tmp_path):
    """The requests of texts 487718 and 547725, and of 258465 and 636124, have the same first eight digits and go to the same sender."""
    ids = [487718, 547725, 258465, 636124]
    spark.createDataFrame([(k, f"text {k}", "en") for k in ids], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = {r[0]: r for r in duck.execute(ORACLES["call_runs"]).fetchall()}
    assert {k: tuple(r) for k, r in ((r["doc_id"], r) for r in model_queries.call_runs(spark, str(tmp_path)).collect())} == want
    assert [want[k][1] for k in ids] == [2, 2, 4, 4]


def test_request_bodies(spark):
    df = spark.createDataFrame([('say "x"\n',), (None,)], "text string")
    body = calls.request_body("m", F.lit("sys"), F.col("text"), "demographics", 50, {"effort": "low", "exclude": True}, True)
    found = [r[0] for r in df.select(body).collect()]
    got = json.loads(found[0])
    assert found[1] is None and got["model"] == "m" and got["temperature"] == 0 and got["max_tokens"] == 50 and got["reasoning"] == {"effort": "low", "exclude": True}
    assert got["messages"] == [{"role": "system", "content": "sys"}, {"role": "user", "content": 'say "x"\n'}]
    assert got["provider"] == {"require_parameters": True, "allow_fallbacks": True} and got["response_format"]["json_schema"]["strict"]


def test_http_connector():
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            body = self.rfile.read(int(self.headers["Content-Length"])).decode()
            self.send_response(int(body) if body.isdigit() else 200)
            self.end_headers()
            self.wfile.write(f"{self.headers['X-Key']} {body}".encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    own = calls.HttpConnector(f"http://127.0.0.1:{server.server_port}", lambda: {"X-Key": "k"}, 10)
    assert own.send("hello") == "k hello"
    for code, kind in (("429", "rate limited 429"), ("503", "server error 503"), ("400", "refused 400")):
        with pytest.raises(RuntimeError, match=kind):
            own.send(code)
    server.shutdown()
