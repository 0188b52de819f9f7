"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat_format, elkan, exact_dedup, html_extract, mixing, near_dedup, phrases, quality, secret_scan, sentencepiece_codec, url_filter, warc
from .common import table

#: The piece table of the registered queries; a file on the driver, of a public tokenizer.
MODEL_PATH = os.environ.get("SENTENCEPIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "copies", "taken")


OP9_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    CAST('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, '')))), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496.0::DOUBLE AS coin
  FROM documents),
per_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, 3 * source_size AS cap,
    [5, 2, 1][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT]::BIGINT AS weight
  FROM per_source),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(weight) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level
  FROM weighed),
targets AS (
  SELECT source, source_size, least(cap::DOUBLE, (SELECT max(level) FROM levels WHERE level * weight <= cap) * weight) AS target FROM levels),
rated AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, s.coin, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, copies, size * copies AS taken
FROM (SELECT *, floor(rate)::BIGINT + (coin < rate - floor(rate))::BIGINT AS copies FROM rated)
"""


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def encoded(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_ids, ids, round_trip of each row."""
    model = sentencepiece_codec.load_model(MODEL_PATH)
    rows = sentencepiece_codec.encode(docs.select("doc_id", "text"), model, exact_col="round_trip")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", "round_trip")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(spark, table(spark, sf_dir, "documents"))


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.filter("vec_id % 100 = 0"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"), words=3, percent=85)


OP5_SQL = r"""
WITH RECURSIVE
cut AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM cut),
sizes AS MATERIALIZED (SELECT doc_id, len(s)::BIGINT AS n FROM sets),
shingles AS MATERIALIZED (SELECT doc_id, unnest(s) AS x FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
near AS (SELECT a, b FROM shared JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 100 * inter >= 85 * (s.n + t.n - inter)),
links AS MATERIALIZED (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sizes UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM sizes JOIN least USING (doc_id)
"""


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).drop("uid")


OP6_SQL = """
WITH n AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)
"""


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"), secret_scan.labelled_findings(spark))
    return found.select("doc_id", "start", F.char_length("value").alias("length"), F.sha2("value", 256).alias("value_sha256"), "score", "secret")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = chat_format.rotate(table(spark, sf_dir, "conversations"))
    spans = F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["stop"].cast("string")))
    return parts.select(
        "conv_id", "perspective", "part", "n_turns", F.char_length("text").alias("n_chars"), "text", F.array_join(spans, ",").alias("spans")
    )


def _encoded(name: str) -> str:
    for c in chat_format.ENCODED:
        name = f"replace({name}, chr({ord(c)}), '%{ord(c):02X}')"
    return name


OP8_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|', '<||') || '<|end|>' || chr(10) AS body FROM conversations WHERE conv_id IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, speaker, body) - 1 AS rk FROM turns),
parted AS (SELECT *, rk // 64 AS part, false AS again FROM ranked),
openers AS (
  SELECT conv_id, turn, speaker, body, rk FROM parted p WHERE speaker = 'system' AND part = 0 AND rk < (SELECT min(q.rk) FROM ranked q WHERE q.conv_id = p.conv_id AND q.speaker <> 'system')),
every AS (SELECT * FROM parted UNION ALL SELECT o.*, l.part, true FROM openers o JOIN (SELECT DISTINCT conv_id, part FROM parted WHERE part > 0) l USING (conv_id)),
views AS (SELECT DISTINCT conv_id, speaker AS perspective FROM turns WHERE speaker <> 'system'),
said AS (
  SELECT r.conv_id, v.perspective, rk, part, again, body, speaker = perspective AS mine,
    CASE WHEN speaker = perspective THEN '<|assistant|>' WHEN speaker <> 'system' THEN '<|user name=' || {_encoded("speaker")} || '|>' ELSE '<|system|>' END || chr(10) AS head
  FROM every r JOIN views v USING (conv_id)),
placed AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective, part ORDER BY rk) AS stop FROM said)
SELECT conv_id, perspective, part::INT AS part, count_if(NOT again)::INT AS n_turns, sum(length(head) + length(body))::INT AS n_chars,
  string_agg(head || body, '' ORDER BY rk) AS text,
  coalesce(string_agg(CASE WHEN mine THEN (stop - length(body))::BIGINT || '-' || stop::BIGINT END, ',' ORDER BY rk), '') AS spans
FROM placed GROUP BY conv_id, perspective, part
"""


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.shipped_labels(spark))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.with_scores(docs, table(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archived(table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")


OP11_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
placed AS (
  SELECT *, payload_bytes >= 100 AND row_number() OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST) > 1 AS again,
    first_value(page_id) OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST) AS original
  FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN original END AS refers_to
FROM placed
"""


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elkan.clustered(table(spark, sf_dir, "embeddings"), k=40, rounds=5, seed=2).drop("computed")


def _op12_sql(k: int = 40, rounds: int = 5) -> str:
    """Plain rounds: every distance, the least of them, sums by cluster and component."""
    nearest = """
assigned_{r} AS MATERIALIZED (
  SELECT rid, v, struct_extract(best, 'c') AS cluster, struct_extract(best, 'd') AS distance
  FROM (
    SELECT p.rid, first(p.v) AS v, min(struct_pack(d := list_sum(list_transform(list_zip(p.v, m.v), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT, c := m.c)) AS best
    FROM points p, centroids_{r} m GROUP BY p.rid)),"""
    update = """
sums_{r} AS (
  SELECT cluster, d, sum(x)::BIGINT AS s, count(*)::BIGINT AS n
  FROM (SELECT cluster, unnest(v) AS x, unnest(range(1, 65)) AS d FROM assigned_{r}) GROUP BY cluster, d),
moved_{r} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY d) AS v FROM sums_{r} GROUP BY cluster),
centroids_{t} AS MATERIALIZED (SELECT c.c, coalesce(m.v, c.v) AS v FROM centroids_{r} c LEFT JOIN moved_{r} m ON m.cluster = c.c),"""
    steps = "".join((nearest + update).format(r=r, t=r + 1) for r in range(rounds)) + nearest.format(r=rounds)
    return f"""
WITH points AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
centroids_0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c, v FROM points ORDER BY sha256('2:' || vec_id), v LIMIT {k}),{steps}
named AS (SELECT c, sha256(array_to_string(v, ',')) AS centroid_sha256 FROM centroids_{rounds})
SELECT p.vec_id, a.cluster::INT AS cluster, a.distance, sum(a.distance) OVER (PARTITION BY a.cluster)::BIGINT AS cluster_inertia,
  sum(a.distance) OVER ()::BIGINT AS inertia, n.centroid_sha256
FROM assigned_{rounds} a JOIN points p USING (rid) JOIN named n ON n.c = a.cluster
"""


OP12_SQL = _op12_sql()


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (SELECT unnest(range(1, 6)) AS k) ks WHERE len(w) >= k)),
frequent AS MATERIALIZED (SELECT lang, k, phrase, count(*)::BIGINT AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
longer AS (
  SELECT lang, phrase, max(f) AS longer
  FROM (SELECT lang, f, unnest([array_to_string(string_split(phrase, ' ')[1:k - 1], ' '), array_to_string(string_split(phrase, ' ')[2:k], ' ')]) AS phrase FROM frequent WHERE k > 1)
  GROUP BY lang, phrase),
cuts AS (
  SELECT lang, phrase, f AS a, c, array_to_string(string_split(phrase, ' ')[1:c], ' ') AS head, array_to_string(string_split(phrase, ' ')[c + 1:k], ' ') AS rest
  FROM (SELECT *, unnest(range(1, k)) AS c FROM frequent WHERE k > 1)),
scored AS (
  SELECT c.lang, c.phrase, c.a, h.f AS l, t.f AS r, n, ((1000::HUGEINT * c.a * n) // (h.f::HUGEINT * t.f))::BIGINT AS score, c
  FROM cuts c JOIN frequent h ON h.lang = c.lang AND h.phrase = c.head JOIN frequent t ON t.lang = c.lang AND t.phrase = c.rest JOIN totals n ON n.lang = c.lang),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) AS place FROM scored),
ranked AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM best b LEFT JOIN longer g ON g.lang = b.lang AND g.phrase = b.phrase WHERE place = 1 AND (g.longer IS NULL OR 100 * g.longer < 100 * a))
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_extract": op1_html_extract,
        "op2_secret_scan": op2_secret_scan,
        "op3_sentencepiece": op3_sentencepiece,
        "op4_ann": op4_ann,
        "op5_near_dedup": op5_near_dedup,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_url_filter": op7_url_filter,
        "op8_chat_format": op8_chat_format,
        "op9_mixing": op9_mixing,
        "op10_quality": op10_quality,
        "op11_warc": op11_warc,
        "op12_clusters": op12_clusters,
        "op13_phrases": op13_phrases,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_near_dedup": OP5_SQL,
        "op6_exact_dedup": OP6_SQL,
        "op8_chat_format": OP8_SQL,
        "op9_mixing": OP9_SQL,
        "op11_warc": OP11_SQL,
        "op12_clusters": OP12_SQL,
        "op13_phrases": OP13_SQL,
    }
