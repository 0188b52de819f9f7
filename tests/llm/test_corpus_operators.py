"""Exact and near dedup, nearest neighbours, the codec and the pipeline against brute force."""

import hashlib
import random
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from textquarry.llm import ann, components, exact_dedup, near_dedup, quality, sentencepiece_codec

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def texts(seed=1, n=120):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    out = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 8, 40, 90]))) for _ in range(n)]
    for k in range(0, n, 4):
        t = out[k].split()
        for j in range(rng.choice([0, 1, 2, 6])):
            t[rng.randrange(len(t))] = "new" + str(j)
        out.append(" ".join(t))
    return [*out, out[0].upper(), out[3], out[3], "", None, " \n\t", "x" * 5000, "x" * 5000 + "y", "é" * 300]


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "en", f"s{k % 3}", k) for k, t in enumerate(rows)], DOCS)


# Exact dedup


@pytest.mark.parametrize("size", [4, 256])
def test_exact_dedup_equals_brute_force(spark, size):
    rows = texts()
    got = exact_dedup.exact_dedup(frame(spark, rows), size=size).collect()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    norm = [(t or "").translate(lower) for t in rows]
    groups = {}
    for k, t in enumerate(norm):
        groups.setdefault(t, []).append(k)
    assert len(got) == len(rows)
    for r in got:
        group = groups[norm[r["doc_id"]]]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(group), len(group), r["doc_id"] == max(group))
        assert r["text_sha256"] == hashlib.sha256(norm[r["doc_id"]].encode()).hexdigest()


def test_exact_dedup_of_repeated_ids_and_clashing_names(spark, tmp_path):
    rows = [(1, "a", 0), (1, "a", 0), (None, "A", 1), (2, "b", 2), (None, None, 3), (None, "", 4)]
    spark.createDataFrame(rows, "doc_id long, text string, Name int").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    kept = exact_dedup.keep_one(df)
    assert kept.columns == df.columns and kept.count() == 3
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [1, 2]
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0 and exact_dedup.keep_one(df.limit(0)).count() == 0


def test_blocks_with_one_hash_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    got = {r["doc_id"]: r["keep_id"] for r in exact_dedup.exact_dedup(frame(spark, ["abcd", "abce", "ABCD", "abcdabce"]), size=4).collect()}
    assert got == {0: 2, 1: 1, 2: 2, 3: 3}


# Near dedup


def brute_components(rows, words, percent):
    sets = []
    for t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [len(s) for s in sets], [find(k) for k in range(len(rows))]


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_near_dedup_equals_brute_force(spark, words, percent):
    rows = texts(seed=words)
    sizes, comps = brute_components(rows, words, percent)
    got = {r["doc_id"]: r for r in near_dedup.near_dedup(frame(spark, rows), words, percent).collect()}
    assert [got[k]["n_shingles"] for k in range(len(rows))] == sizes
    assert [got[k]["component_id"] for k in range(len(rows))] == comps
    assert all(got[k]["kept"] == (comps[k] == k) for k in range(len(rows)))


def test_near_dedup_finds_chains_across_a_bucket(spark):
    """A chain of edits: neighbours are linked, ends are not, so a bucket's smallest id alone does not link them all."""
    rng = random.Random(2)
    base = [f"v{rng.randrange(10**6)}" for _ in range(200)]
    rows = []
    for k in range(30):
        base = list(base)
        for j in range(6):
            base[(k * 6 + j) % 200] = f"c{k}x{j}"
        rows.append(" ".join(base))
    rng.shuffle(rows)
    _, comps = brute_components(rows, 3, 85)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_dedup(frame(spark, rows), 3, 85).collect()}
    assert [got[k] for k in range(len(rows))] == comps and len(set(comps)) == 1


def test_near_dedup_of_nulls_and_repeats(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (4, None), (2, "A B C D E")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, Component_Id int")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_dedup(df).collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (None, None, True), (4, 4, True), (2, 1, False)], key=str)
    assert near_dedup.keep_one(df).count() == 4 and near_dedup.near_dedup(df.limit(0)).count() == 0


def test_near_dedup_joins_the_sets_of_a_repeated_id(spark):
    """Document 1 has two texts; one is near document 2's, the other near document 3's, so all are one component."""
    one, two = (" ".join(f"{c}{k}" for k in range(60)) for c in "ab")
    rows = [(1, one), (1, two), (2, one + " more"), (3, two + " more"), (4, " ".join(f"c{k}" for k in range(60))), (1, None)]
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(1, 1), (2, 1), (3, 1), (4, 4)}
    assert sorted(r["n_shingles"] for r in got if r["doc_id"] == 1) == [0, 58, 58]


def test_words_across_chunks_and_very_long_texts(spark, monkeypatch):
    rng = random.Random(4)
    text = "".join(rng.choice(["ab", "B", " ", "\t", "ü", "x" * 40, "\n"]) for _ in range(3000))
    whole = near_dedup.shingles(text, 3)
    words = text.lower().encode().split()
    assert len(whole) == len({tuple(words[k : k + 3]) for k in range(len(words) - 2)})
    for size in (1, 7, 64):
        monkeypatch.setattr(near_dedup, "CHUNK", size)
        assert np.array_equal(near_dedup.shingles(text, 3), whole)
    monkeypatch.undo()
    long = "".join(f"w{k} " for k in range(6_000_000))[:50_000_000]
    df = spark.createDataFrame([(1, long), (2, long + "end"), (3, "x" * 3_000_000)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_dedup(df).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_estimate_is_near_the_similarity(spark):
    a, b = np.arange(1, 1001, dtype=np.uint64), np.arange(101, 1101, dtype=np.uint64)
    sig = [near_dedup.packed(near_dedup.minima(near_dedup._mix(x))).tolist() for x in (a, b, a)]
    df = spark.createDataFrame([(sig[0], sig[1]), (sig[0], sig[2])], "a array<long>, b array<long>")
    near, same = (r[0] for r in df.select(near_dedup.estimate(F.col("a"), F.col("b"))).collect())
    assert same == 1.0 and abs(near - 900 / 1100) < 0.12


def test_components(spark):
    links = [(1, 2), (2, 3), (10, 11), (12, 11), (20, 20), (3, None), *[(100 + k, 101 + k) for k in range(40)]]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 12: 10, **{100 + k: 100 for k in range(41)}}


# Nearest neighbours


def test_neighbours_recall_and_scores(spark):
    rng = np.random.RandomState(0)
    m = rng.randn(1500, 16).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(m)] + [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, [1.0]), (9005, []), (None, [1.0] * 16), (9006, [1.0, None] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.search(df, df.filter("vec_id % 100 = 0")).collect()
    assert len(got) == 150 and not {r["vec_id"] for r in got} & set(range(9001, 9007))
    hits = 0
    for q in range(0, 1500, 100):
        d = np.sqrt(((m.astype(float) - m[q].astype(float)) ** 2).sum(axis=1))
        d[q] = np.inf
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11))
        assert [r["score"] for r in mine] == pytest.approx([d[r["vec_id"]] for r in mine], rel=1e-12)
        assert [(r["score"], r["vec_id"]) for r in mine] == sorted((r["score"], r["vec_id"]) for r in mine)
        hits += len({r["vec_id"] for r in mine} & set(np.argsort(d, kind="stable")[:10].tolist()))
    assert hits / 150 >= 0.9


def test_neighbours_with_ties_repeats_and_few_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r["rank"], r["vec_id"], round(r["score"], 6)) for r in ann.search(df, df.filter("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(1, 1, 0.0), (2, 2, 0.0), (3, 3, 1.414214)]
    assert ann.search(df.limit(0), df).count() == 0 and ann.search(df, df.limit(0)).count() == 0


def test_walk_meets_cells_in_order_of_summed_distance():
    rng = np.random.RandomState(1)
    a, b = rng.rand(7), rng.rand(5)
    cells = ann.walk(a, b, np.ones(35, int), 35)
    sums = [a[c // 5] + b[c % 5] for c in cells]
    assert sums == sorted(sums) and len(set(cells)) == 35
    assert len(ann.walk(a, b, np.ones(35, int), 4)) == 4


# The codec

TABLE = [("<unk>", 0.0, 2)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] + [(p, float(-k), 1) for k, p in enumerate(["▁the", "▁", "th", "he", "e", "t", "h", "▁t", "cat", "c", "a", "at", "▁▁", "ca", "s"])]


def best_total(word, model):
    """The highest total over all segmentations, by trying each."""
    if not word:
        return 0.0
    out = []
    for n in range(1, len(word) + 1):
        piece = word[:n]
        if piece in model.scores:
            out.append(model.scores[piece][1] + best_total(word[n:], model))
        elif n == 1:
            out.append(model.unknown_score + best_total(word[1:], model))
    return max(out)


@pytest.mark.parametrize("merges", [False, True])
def test_codec(spark, merges):
    model = sentencepiece_codec.make_model(TABLE, merges=merges)
    rows = ["the cat sat", None, "", "  the  cat", "thecat\nzß日", "▁the", "s" * 200, "the cat sat", "the \ncat\n sat", "cat " * 9, " ", "\n", "the,cat the,,cat 1.2"]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(rows)], "doc_id long, text string, Ids string")
    for most in (10_000, 2, 0):
        full = sentencepiece_codec.encode(df, model, exact_col="exact", most=most).orderBy("doc_id")
        assert full.columns == ["doc_id", "text", "Ids", "_ids", "exact"]
        out = full.drop("Ids").withColumnRenamed("_ids", "ids").collect()
        assert all(r["exact"] for r in out) and [len(r["ids"]) == 0 for r in out] == [not t for t in rows]
        for r in out:
            want = [i for w in __import__("re").findall(model.pattern, " " + r["text"]) for i in sentencepiece_codec.encode_word(w, model)] if r["text"] else []
            assert r["ids"] == want
    back = sentencepiece_codec.decode(spark.createDataFrame(out), model).collect()
    assert all(r["decoded"] == (r["text"] or "") for r in back)
    assert sentencepiece_codec.encode(df.select("doc_id", "text").limit(0), model).count() == 0


def test_viterbi_finds_the_best_total():
    model = sentencepiece_codec.make_model(TABLE)
    for word in (" thecat", "  the", "cathe", "scat the", "zcat"):
        path = sentencepiece_codec.viterbi(word, model)
        assert "".join(word[start:end] for start, end in path) == word
        total = sum(model.scores.get(word[start:end], (0, model.unknown_score))[1] for start, end in path)
        assert total == pytest.approx(best_total(word, model))


def test_merges_equal_the_library_for_the_public_model():
    import os

    from textquarry.llm.queries import MODEL_PATH

    if not os.path.exists(MODEL_PATH):
        pytest.skip("no model file")
    sentencepiece = pytest.importorskip("sentencepiece")
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL_PATH)
    model = sentencepiece_codec.load_model(MODEL_PATH)
    cut = __import__("re").compile(model.pattern).findall
    for text in ["Hello world!  Two spaces,\ttab\nline", "Éaile ñandú über 日本 𝒳 ﬁ", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "https://x.y/z?a=1&b=2", "''\"\"--==", "x" * 300, " lead", "trail "]:
        ids = [i for w in cut(model.prefix + text) for i in sentencepiece_codec.encode_word(w, model)]
        assert ids == library.encode(text) and sentencepiece_codec.decode_ids(ids, model) == text


# The pipeline


def test_pipeline_equals_its_stages_by_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(4)
    words = [f"k{n}" for n in range(500)]
    good = [" ".join(rng.choice(words) for _ in range(60)) + "." for _ in range(60)]
    rows = [(k, t, "en", f"s{k % 4}", len(t)) for k, t in enumerate([*good, *[g.upper() for g in good[:5]], *[g + " tail" for g in good[5:12]], *["BUY!! GO!! " * 20 + str(k) for k in range(30)]])]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(k, int(k < 72), 0) for k in range(len(rows)) if k % 5]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        kept.append(sorted(r["doc_id"] for r in docs.select("doc_id").collect()))
    text = dict((r[0], r[1]) for r in rows)
    model_rows = {r["doc_id"]: r["score"] for r in quality.with_scores(spark.read.parquet(str(tmp_path / "documents.parquet")), spark.read.parquet(str(tmp_path / "labels.parquet"))).collect()}
    assert kept[0] == sorted(k for k, s in model_rows.items() if s >= 0.5) and set(range(60)) <= set(kept[0])
    groups = {}
    for k in kept[0]:
        groups.setdefault(text[k].lower(), []).append(k)
    assert kept[1] == sorted(max(g) for g in groups.values())
    _, comps = brute_components([text[k] for k in kept[1]], 5, 80)
    assert kept[2] == [k for n, k in enumerate(kept[1]) if comps[n] == n]
    assert set(kept[3]) <= set(kept[2]) and kept[4] == kept[3]
    assert corpus_pipeline.run(spark, str(tmp_path)).filter("NOT round_trip").count() == 0


# Queries against their SQL


@pytest.mark.parametrize("name", ["op6_exact_dedup", "op8_chat_format", "op9_mixing"])
def test_queries_against_sql(spark, name):
    from tests.test_queries import SMALL, TABLES, rows
    from textquarry.llm import queries

    duckdb = pytest.importorskip("duckdb")
    if not Path(SMALL).is_dir():
        pytest.skip("no tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    assert rows(queries.queries()[name](spark, SMALL).toPandas()) == rows(con.execute(queries.oracle_sql()[name]).df())


def test_keep_one_when_files_are_split_otherwise_on_a_second_scan(spark, tmp_path, monkeypatch):
    rows = [(k, f"text {k % 50}", "en", "s", k) for k in range(200)]
    spark.createDataFrame(rows, DOCS).repartition(8, "doc_id").write.parquet(str(tmp_path / "docs"))
    plain, names = exact_dedup.exact_dedup, ("spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes", "spark.sql.files.minPartitionNum")
    old = {n: spark.conf.get(n, None) for n in names}

    def then_split_otherwise(*args, **kwargs):
        found = plain(*args, **kwargs)
        for n, v in zip(names, ("1", "1000000", "1"), strict=True):
            spark.conf.set(n, v)
        return found

    monkeypatch.setattr(exact_dedup, "exact_dedup", then_split_otherwise)
    try:
        spark.conf.set(names[0], "100000000")
        got = exact_dedup.keep_one(spark.read.parquet(str(tmp_path / "docs"))).collect()
    finally:
        for n, v in old.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)
    assert sorted(r["doc_id"] for r in got) == list(range(150, 200))
