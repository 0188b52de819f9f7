"""WARC archives, Elkan clustering and phrase mining against brute force."""

import gzip
import hashlib
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from textquarry.llm import elkan, phrases, warc
from textquarry.llm.queries import OP5_SQL, OP11_SQL, OP12_SQL, OP13_SQL

# WARC archives

LONG = "<p>" + "x" * 120 + "</p>"
PAGES = [
    (5, "http://a/1", LONG), (3, "http://a/2", LONG), (9, None, LONG), (None, "http://a/3", LONG), (3, "http://a/4", LONG),
    (1, "http://b\r\nX: y", "short"), (2, "http://b", "short"), (4, "http://c", None), (6, "http://c", ""), (7, "http://d", "é" * 99 + "\r\n\r\n" + "z" * 50),
    (8, "http://e", LONG + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"), (10, "", "\r\n" * 70), (11, "http://f", "\r\n" * 70),
    (12, "http://g", "y" * 3_000_000), (13, "http://h", "WARC/1.0\r\n" * 20),
]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "a", "b") for r in rows], "page_id long, url string, html string, uid string, Digest string")


def told(rows):
    """(id, bytes, digest, type, refers_to) by brute force."""
    texts = [(i, (t or "").encode()) for i, _, t in rows]
    first, out = {}, []
    for k in sorted(range(len(rows)), key=lambda k: (texts[k][0] is None, texts[k][0] or 0, k)):
        i, t = texts[k]
        own = first.setdefault(t, k)
        again = own != k and len(t) >= 100
        out.append((i, len(t), hashlib.sha256(t).hexdigest(), "revisit" if again else "response", texts[own][0] if again else None))
    return sorted(out, key=str)


def test_archives_equal_brute_force(spark):
    found = warc.archived(pages(spark)).collect()
    assert sorted((tuple(r) for r in found), key=str) == told(PAGES)
    assert warc.archived(pages(spark).limit(0)).count() == 0


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_payloads_come_back_from_archives_cut_anywhere(spark, tmp_path, compression):
    rng = random.Random(4)
    parts = ["\r\n", "\r", "\n", "\r\n\r\n", "WARC/1.", "WARC/1.1\r\n", "a", "é", "Content-Length: 5\r\n"]
    rows = [(k, f"http://x/{k % 7}", "".join(rng.choice(parts) for _ in range(rng.choice([0, 3, 40, 60])))) for k in range(300)]
    rows += [(k, "http://y", rows[k % 9][2]) for k in range(300, 330)]
    path = f"{tmp_path}/{compression}"
    df = pages(spark, rows).repartition(3)
    warc.write(warc.resolved(warc.from_pages(df)), path, compression=compression)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        back = warc.restored(warc.read(spark, path))
        assert {r["id"]: bytes(r["payload"]).decode() for r in back.collect()} == {i: t for i, _, t in rows}
        assert back.count() == len(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_headers_of_what_is_written(spark, tmp_path):
    path = f"{tmp_path}/plain"
    warc.write(warc.resolved(warc.from_pages(pages(spark, PAGES[:7]).coalesce(1))), path, date="2024-01-02T03:04:05Z", compression="none")
    text = "".join(p.read_bytes().decode() for p in (tmp_path / "plain").glob("part-*"))
    assert text.count("WARC/1.1\r\n") == 7 and text.count("WARC-Type: revisit") == 4
    ids = re.findall(r"WARC-Record-ID: (<urn:uuid:[0-9a-f-]{36}>)", text)
    assert len(set(ids)) == 7 and set(re.findall(r"WARC-Refers-To: (\S+)", text)) < set(ids)
    assert "http://b%0D%0AX: y" in text and "WARC-Date: 2024-01-02T03:04:05Z" in text
    for head, rest in re.findall(r"(WARC/1\.1\r\n.*?)\r\n\r\n(.*?)\r\n\r\n(?=WARC/1|\Z)", text, re.S):
        assert int(re.search(r"Content-Length: (\d+)", head)[1]) == len(rest.encode()) + (4 if rest.endswith("html; charset=utf-8") else 0)


def test_foreign_archives_are_resolved(spark, tmp_path):
    """Other versions, records compressed one by one, digests of another kind, and a revisit before its original."""

    def record(kind, body, *more):
        lines = ["WARC/1.0", f"WARC-Type: {kind}", "WARC-Record-ID: <urn:x>", *more, f"content-length: {len(body)}"]
        return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n")

    http = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n"
    digest = hashlib.sha256(b"\xff\xfe" * 80).hexdigest().upper()
    parts = [
        record("warcinfo", b"software: x"),
        record("revisit", http, "Content-Type: application/http", f"WARC-Payload-Digest: sha256:{digest.lower()}", "X-Page-Id: 2"),
        record("response", http + b"\xff\xfe" * 80, "Content-Type: application/http; msgtype=response", "WARC-Payload-Digest: sha1:ABC", "X-Page-Id: 1"),
        record("resource", b"plain", "Content-Type: text/plain", "X-Page-Id: 3"),
        record("revisit", http, "Content-Type: application/http", "WARC-Payload-Digest: sha1:GONE", "WARC-Refers-To: <urn:y>", "X-Page-Id: 4"),
    ]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc.gz").write_bytes(b"".join(parts))
    records = warc.read(spark, f"{tmp_path}/in")
    kinds = {r["id"]: r["record_type"] for r in records.collect()}
    assert kinds == {None: "warcinfo", 1: "response", 2: "revisit", 3: "resource", 4: "revisit"}
    full = {r["id"]: r["payload"] and bytes(r["payload"]) for r in warc.restored(records.filter("id IS NOT NULL")).collect()}
    assert full == {1: b"\xff\xfe" * 80, 2: b"\xff\xfe" * 80, 3: b"plain", 4: None}
    warc.write(warc.resolved(records.filter("id IS NOT NULL")), f"{tmp_path}/out")
    again = {r["id"]: (r["record_type"], r["size"], r["refers_to"]) for r in warc.read(spark, f"{tmp_path}/out").collect()}
    assert again[1][:2] == ("response", 160) and again[2][:2] == ("revisit", None) and again[3][:2] == ("response", 5) and again[4] == ("revisit", None, "<urn:y>")


# Elkan clustering


def vectors(seed=3, n=400, dims=64):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, dims))
    rows = [(k, [float(np.float32(x)) for x in centres[k % 9] * 0.4 + rng.normal(size=dims) * 0.15]) for k in range(n)]
    rows += [(n + k, [round(x * 4) / 256 for x in rows[k][1]]) for k in range(60)]  # few integers: many ties
    rows += [(7, rows[7][1]), (8, rows[2][1]), (None, rows[5][1])]
    bad = [(9001, None), (9002, []), (9003, [0.0] * 63), (9004, [0.0] * 63 + [None]), (9005, [0.0] * 63 + [float("nan")]), (9006, [0.0] * 63 + [float("inf")])]
    return rows, bad


def lloyd(rows, k, rounds, seed):
    """Every distance in every round, in Python integers."""
    ints = [[int(np.floor(256 * x)) for x in v] for _, v in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, hashlib.sha256(f"{seed}:{rows[i][0]}".encode()).hexdigest(), ints[i]))
    centroids = [ints[i] for i in order[:k]]
    gap = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    near = lambda v: min(range(len(centroids)), key=lambda c: (gap(v, centroids[c]), c))
    for _ in range(rounds):
        found = [near(v) for v in ints]
        for c in range(len(centroids)):
            own = [v for v, x in zip(ints, found, strict=True) if x == c]
            if own:
                centroids[c] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    found = [near(v) for v in ints]
    distance = [gap(v, centroids[c]) for v, c in zip(ints, found, strict=True)]
    inertia = Counter()
    for c, d in zip(found, distance, strict=True):
        inertia[c] += d
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, inertia[c], sum(distance), names[c]) for (i, _), c, d in zip(rows, found, distance, strict=True)), key=str)


@pytest.mark.parametrize(("k", "rounds"), [(40, 5), (3, 4), (1, 1), (600, 2)])
def test_clusters_equal_brute_force(spark, k, rounds):
    rows, bad = vectors()
    if k == 600:  # more than there are vectors
        rows = rows[:30]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows + bad], "vec_id long, embedding array<double>, cluster int, V int").repartition(5)
    out = elkan.clustered(df, k, rounds).collect()
    assert sorted((tuple(r)[:6] for r in out), key=str) == lloyd(rows, k, rounds, 2)
    if k == 40:
        taken = sum(r["computed"] for r in out)
        assert taken < 0.7 * len(rows) * k * (rounds + 1), "bounds must save distances"


def test_clusters_of_nothing(spark):
    _, bad = vectors()
    df = spark.createDataFrame(bad, "vec_id long, embedding array<float>")
    assert elkan.clustered(df).count() == 0 and elkan.clustered(df.limit(0)).count() == 0


def test_bounds_never_pass_the_truth():
    rng = random.Random(5)
    exact = [0, 1, 2, 3, 2**53 - 1, 2**53 + 1, 2**60 + 7, 2**62 - 1] + [rng.randrange(2 ** rng.randrange(1, 62)) for _ in range(2000)]
    up, down = elkan.above(np.array(exact)), elkan.below(np.array(exact))
    for x, u, d in zip(exact, up.tolist(), down.tolist(), strict=True):
        assert Fraction(u) ** 2 >= x >= Fraction(d) ** 2
    points = np.array([[2**27, -(2**27)], [5, 7]])
    assert elkan.squared(points, points).tolist() == [[0, (2**27 - 5) ** 2 + (2**27 + 7) ** 2], [(2**27 - 5) ** 2 + (2**27 + 7) ** 2, 0]]


# Phrases


def mined(rows, least, top, longest):
    """Counts of all phrases, and the rules as they stand."""
    counts, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, c in counts.items():
        candidates = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in candidates.items():
            inside = [q for q, b in candidates.items() if len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if not inside:
                cut = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-cut[0], -a, " ".join(p).encode(), c[p[: cut[1]]], c[p[cut[1] :]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def prose(seed=6, n=160):
    rng = random.Random(seed)
    common = ["The", "of", "a", "big", "dog", "été", "x\x01y", "日本", "to", "Be", "or", "not"]
    runs = ["big red dog", "to be or not to be", "a a a a a a", "new  york\tcity hall now", "of the"]
    rows = []
    for k in range(n):
        parts = [rng.choice(runs) if rng.random() < 0.4 else rng.choice(common) for _ in range(rng.choice([0, 1, 5, 40]))]
        rows.append((rng.choice(["en", "en", None, "und", "fr"]), "".join(p + rng.choice([" ", " ", "\t", "  ", ". ", ",", "\n", "\r\n"]) for p in parts)))
    return [*rows, ("en", None), ("fr", ""), ("de", "only few words"), ("en", "big red dog " * 300), ("en", "word" * 5000), *[rows[3]] * 30]


@pytest.mark.parametrize(("least", "bits"), [(12, 22), (12, 8), (300, 14)])
def test_phrases_equal_brute_force(spark, least, bits):
    rows = prose()
    df = spark.createDataFrame([(*r, 0, 1.0) for r in rows], "lang string, text string, rank int, Score double").repartition(4)
    for top in (2000, 4) if bits == 22 else (2000,):
        found = phrases.collocations(df, least, top, bits=bits).collect()
        assert sorted(tuple(r) for r in found) == mined(rows, least, top, 5)
    assert any(r["phrase"].count(" ") == 4 for r in found) or least == 300


def test_no_phrases(spark):
    df = spark.createDataFrame([("en", "a b c")], "lang string, text string")
    assert phrases.collocations(df).count() == 0 and phrases.collocations(df.limit(0)).count() == 0


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_windows_count_each_phrase_once(size):
    rng = random.Random(9)
    texts = ["".join(rng.choice(["a ", "bb ", "  ", "ccc\t", "\n", "d" * 30 + " "]) for _ in range(80)).encode() for _ in range(5)] + [b"", b"e " * 200, b"f" * 300]
    for k in range(1, 6):
        want, found = Counter(), Counter()
        for text in texts:
            for piece in text.split(b"\n"):
                words = re.findall(rb"[^ \t]+", piece)
                want.update(b" ".join(words[i : i + k]) for i in range(len(words) - k + 1))
        for data, again in phrases.windows(texts, 5, size):
            w = phrases.Words(data, 1)
            fits, _ = w.grams(k)
            found.update(w.phrases(np.flatnonzero(fits & (np.arange(len(fits)) + k > again)), k))
        assert found == want


@pytest.mark.parametrize(("name", "sql"), [("op5_near_dedup", OP5_SQL), ("op11_warc", OP11_SQL), ("op12_clusters", OP12_SQL), ("op13_phrases", OP13_SQL)])
def test_registered_queries_equal_their_sql(spark, name, sql):
    import duckdb

    from textquarry.llm import queries

    folder = "/root/testdata/sf0.001"
    found = queries.queries()[name](spark, folder)
    db = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    columns = sorted(found.columns)
    want = db.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in found.select(*[F.col(c) for c in columns]).collect())
