"""Registered queries of the plans around models: taxonomies, tags, entities, answers, calls."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scores import EMPTY_VERBS
from ..operators.generators import token_windows
from ..operators.relations import shared_path, written
from . import answers, artifacts, calls, classifier, entities, sections, tagging, taxonomy, training
from .queries import hashed, hashed_sql, key_of, query, read

# A taxonomy of the documents' words: a word is under its first letters and under its last ones, these under fewer.

TAXONOMY = """
seen AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS word FROM documents WHERE text IS NOT NULL),
counted AS (SELECT word, count(*) AS n FROM seen GROUP BY word),
links AS (
  SELECT DISTINCT l.concept, l.parent FROM (SELECT unnest([
    {'concept': word, 'parent': 'p:' || word[1:3]}, {'concept': 'p:' || word[1:3], 'parent': 'p:' || word[1:1]}, {'concept': 'p:' || word[1:1], 'parent': 'root'},
    {'concept': word, 'parent': 's:' || right(word, 2)}, {'concept': 's:' || right(word, 2), 'parent': 'root'}]) AS l FROM counted)),
senses AS (SELECT word, word AS concept FROM counted UNION ALL SELECT word, 's:' || right(word, 2) FROM counted),
reach AS (
  SELECT concept, concept AS ancestor FROM (SELECT concept FROM links UNION SELECT parent FROM links)
  UNION SELECT r.concept, l.parent FROM reach r JOIN links l ON l.concept = r.ancestor),
info AS (
  SELECT r.ancestor AS concept, sum(c.n)::BIGINT AS n, ln((SELECT sum(n) FROM counted)::DOUBLE / sum(c.n)::DOUBLE) AS information
  FROM reach r JOIN counted c ON c.word = r.concept GROUP BY r.ancestor),
profile AS (
  SELECT s.word, i.information AS own, r.ancestor, u.information AS shared
  FROM senses s JOIN info i USING (concept) JOIN reach r USING (concept) JOIN info u ON u.concept = r.ancestor)
"""


def word_taxonomy(spark: SparkSession, sf_dir: str) -> taxonomy.Taxonomy:
    words = read(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("word"))
    counted = written(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    first = lambda n: F.concat(F.lit("p:"), F.substring("word", 1, n))
    last = F.concat(F.lit("s:"), F.expr("right(word, 2)"))
    steps = ((F.col("word"), first(3)), (first(3), first(1)), (first(1), F.lit("root")), (F.col("word"), last), (last, F.lit("root")))
    links = counted.select(F.explode(F.array(*[F.struct(c.alias("concept"), p.alias("parent")) for c, p in steps])).alias("l")).select("l.*").distinct()
    senses = counted.select("word", F.explode(F.array(F.struct(F.col("word").alias("concept"), F.lit(1).alias("rank")), F.struct(last.alias("concept"), F.lit(2).alias("rank")))).alias("s"))
    senses = senses.select("word", "s.*").select("word", F.explode(F.array(*[F.lit(p) for p in ("NOUN", "VERB")])).alias("pos"), "concept", "rank")
    ancestors = taxonomy.closure(links)
    return taxonomy.Taxonomy(senses, ancestors, taxonomy.information(ancestors, counted.select(F.col("word").alias("concept"), "n")))


@query(f"WITH RECURSIVE {TAXONOMY} SELECT concept, n, round(information, 9) AS information FROM info")
def concept_information(spark, sf_dir):
    return word_taxonomy(spark, sf_dir).information.select("concept", "n", F.round("information", 9).alias("information"))


@query(
    f"""WITH RECURSIVE {TAXONOMY},
    adjacent AS (SELECT regexp_extract_all(lower(text), '[a-z]+') AS w FROM conversations WHERE text IS NOT NULL),
    pairs AS (SELECT DISTINCT w[i] AS a, w[i + 1] AS b FROM (SELECT w, unnest(range(1, len(w))) AS i FROM adjacent))
    SELECT a, b, round(coalesce(max(2 * x.shared / (x.own + y.own)), 0.0), 9) AS similarity
    FROM pairs LEFT JOIN profile x ON x.word = a LEFT JOIN profile y ON y.word = b AND y.ancestor = x.ancestor GROUP BY a, b"""
)
def word_similarities(spark, sf_dir):
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    turns = read(spark, sf_dir, "conversations").select(words.alias("w"))
    n = F.greatest(F.size("w") - 1, F.lit(0))
    pairs = turns.select(F.explode(F.arrays_zip(F.slice("w", F.lit(1), n).alias("a"), F.slice("w", F.lit(2), n).alias("b"))).alias("x")).select("x.a", "x.b", F.lit("NOUN").alias("pos")).distinct()
    return word_taxonomy(spark, sf_dir).similarity(pairs).select("a", "b", F.round("similarity", 9).alias("similarity"))


VERBS = ", ".join(f"'{v}'" for v in EMPTY_VERBS)
MISSING = "lower(trim({0})) IN ('', 'not specified', 'nan')"


@query(
    f"""WITH RECURSIVE {TAXONOMY},
    turns AS (SELECT conv_id || ':' || turn AS k, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
    sides AS (SELECT k, before, text, regexp_extract_all(lower(before), '[a-z]+') AS l, regexp_extract_all(lower(text), '[a-z]+') AS r FROM turns WHERE before IS NOT NULL AND text IS NOT NULL),
    token AS (SELECT k, 'l' AS side, unnest(l) AS word FROM sides UNION ALL SELECT k, 'r', unnest(r) FROM sides),
    kind AS (SELECT k, side, word, ['NOUN', 'VERB', 'X'][1 + length(word) % 3] AS pos FROM token),
    kept AS (
      SELECT k, side, word, pos, CASE pos WHEN 'VERB' THEN word[1:1] ELSE '' END AS tag, count(*) AS n FROM kind
      WHERE (pos = 'NOUN' AND length(word) > 2) OR (pos = 'VERB' AND word NOT IN ({VERBS})) GROUP BY ALL),
    met AS (
      SELECT l.k, l.pos, l.word AS a, l.tag, l.n, r.word AS b FROM kept l JOIN kept r ON r.k = l.k AND r.pos = l.pos AND l.side = 'l' AND r.side = 'r'
      WHERE r.tag = l.tag OR NOT EXISTS (SELECT 1 FROM kept x WHERE x.k = l.k AND x.pos = l.pos AND x.side = 'r' AND x.tag = l.tag)),
    sims AS (
      SELECT a, b, coalesce(max(2 * x.shared / (x.own + y.own)), 0.0) AS similarity FROM (SELECT DISTINCT a, b FROM met)
      LEFT JOIN profile x ON x.word = a LEFT JOIN profile y ON y.word = b AND y.ancestor = x.ancestor GROUP BY a, b),
    best AS (SELECT k, pos, a, tag, n, max(similarity) AS s FROM met JOIN sims USING (a, b) GROUP BY ALL),
    matched AS (SELECT k, max(m) FILTER (pos = 'NOUN') AS nouns, max(m) FILTER (pos = 'VERB') AS verbs FROM (SELECT k, pos, sum(n * s) / sum(n) AS m FROM best GROUP BY k, pos) GROUP BY k),
    listed AS (SELECT k, before, text, list_filter(l, lambda x: length(x) > 2) AS a, list_filter(r, lambda x: length(x) > 2) AS b FROM sides),
    paired AS (SELECT *, list_transform(range(1, len(a)), lambda i: a[i] || ' ' || a[i + 1]) AS aa, list_transform(range(1, len(b)), lambda i: b[i] || ' ' || b[i + 1]) AS bb FROM listed),
    overlap AS (
      SELECT k, before, text, CASE WHEN len(a) > 0 AND len(b) > 0 THEN
        0.6 * (len(list_intersect(a, b))::DOUBLE / greatest(len(list_distinct(a)), len(list_distinct(b)))) + 0.4 * (len(list_intersect(aa, bb))::DOUBLE / greatest(len(aa), len(bb), 1)) ELSE 0.0 END AS o FROM paired),
    parts AS (SELECT k, before, text, pow(coalesce(nouns, 0.0), 0.6) AS x, pow(coalesce(verbs, 0.0) + o, 0.24) AS y FROM overlap LEFT JOIN matched USING (k))
    SELECT k AS turn_key, round(CASE WHEN {MISSING.format("before")} OR {MISSING.format("text")} THEN 0.0 ELSE greatest(0.0, least(1.0, (x + y) / (1 + x))) END, 8) AS score FROM parts"""
)
def analysed_scores(spark, sf_dir):
    """Turns against the ones before, with tokens by length and the taxonomy of the documents' words."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.lag("text").over(order).alias("before"))
    # A turn's words are found once, for itself and for the next one.
    turns = turns.withColumn("words", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).withColumn("words_before", F.lag("words").over(order))
    turns = turns.filter("before IS NOT NULL AND text IS NOT NULL").select(key_of("conv_id", "turn").alias("turn_key"), "text", "before", "words", "words_before")

    def tokens(words):
        n = lambda w: F.char_length(w)
        pos = lambda w: F.when(n(w) % 3 == 0, "NOUN").when(n(w) % 3 == 1, "VERB").otherwise("X")
        return F.transform(words, lambda w: F.struct(w.alias("lemma"), pos(w).alias("pos"), F.substring(w, 1, 1).alias("tag"), (n(w) <= 2).alias("stop"), F.lit(True).alias("alpha")))

    rows = turns.withColumns({"left": tokens(F.col("words_before")), "right": tokens(F.col("words"))})
    return taxonomy.text_scores(rows, "turn_key", "before", "text", "left", "right", word_taxonomy(spark, sf_dir)).select("turn_key", F.round("score", 8).alias("score"))


TAGGING = r"""
tokens AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word, generate_subscripts(regexp_extract_all(lower(text), '[a-z]+'), 1) AS place FROM benchmark),
tagged AS (SELECT item_id, place, word, right(word, 3) AS ending, ['A', 'B', 'C'][1 + (length(word) + coalesce(length(lag(word) OVER w), 0)) % 3] AS tag FROM tokens WINDOW w AS (PARTITION BY item_id ORDER BY place)),
tags AS (SELECT tag, count(*) AS n, row_number() OVER (ORDER BY tag) - 1 AS t FROM tagged GROUP BY tag),
kinds AS (SELECT (SELECT count(DISTINCT word) + 1 FROM tagged) AS words, (SELECT count(DISTINCT ending) + 1 FROM tagged) AS endings, (SELECT count(*) FROM tags) AS tags, (SELECT count(*) FROM tagged) AS everything),
follow AS (SELECT lag(tag) OVER (PARTITION BY item_id ORDER BY place) AS before, tag FROM tagged),
befores AS (SELECT tag AS before FROM tags UNION ALL SELECT NULL),
moves AS (
  SELECT bt.t AS b, ts.t, round(ln(((SELECT count(*) FROM follow f WHERE f.before IS NOT DISTINCT FROM b.before AND f.tag = ts.tag) + 1.0::DOUBLE)
    / ((SELECT count(*) FROM follow f WHERE f.before IS NOT DISTINCT FROM b.before) + k.tags::DOUBLE)) * 1000000)::BIGINT AS m
  FROM befores b CROSS JOIN tags ts CROSS JOIN kinds k LEFT JOIN tags bt ON bt.tag = b.before),
word_scores AS (
  SELECT w.word, list(round(ln((coalesce(c.n, 0) + 1.0::DOUBLE) / (t.n + k.words::DOUBLE)) * 1000000)::BIGINT ORDER BY t.t) AS e
  FROM (SELECT DISTINCT word FROM tagged) w CROSS JOIN tags t CROSS JOIN kinds k LEFT JOIN (SELECT word, tag, count(*) AS n FROM tagged GROUP BY word, tag) c ON c.word = w.word AND c.tag = t.tag GROUP BY w.word),
ending_scores AS (
  SELECT w.ending, list(round(ln((coalesce(c.n, 0) + 1.0::DOUBLE) / (t.n + k.endings::DOUBLE)) * 1000000)::BIGINT ORDER BY t.t) AS e
  FROM (SELECT DISTINCT ending FROM tagged) w CROSS JOIN tags t CROSS JOIN kinds k LEFT JOIN (SELECT ending, tag, count(*) AS n FROM tagged GROUP BY ending, tag) c ON c.ending = w.ending AND c.tag = t.tag GROUP BY w.ending),
other AS (SELECT list(round(ln((t.n + 1.0::DOUBLE) / (k.everything + k.tags::DOUBLE)) * 1000000)::BIGINT ORDER BY t.t) AS e FROM tags t CROSS JOIN kinds k),
split AS (SELECT doc_id, string_split_regex(text, '[.!?\n]+') AS s FROM documents WHERE text IS NOT NULL),
sentences AS (SELECT doc_id, unnest(list_transform(s, lambda x: regexp_extract_all(lower(x), '[a-z]+'))) AS w, generate_subscripts(s, 1) - 1 AS i FROM split),
said AS (SELECT doc_id, i, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM sentences),
emitted AS MATERIALIZED (
  SELECT s.doc_id, s.i, s.place, coalesce(ws.e, es.e, o.e) AS e FROM said s CROSS JOIN other o LEFT JOIN word_scores ws USING (word) LEFT JOIN ending_scores es ON es.ending = right(s.word, 3)),
walk AS (
  SELECT x.doc_id, x.i, x.place, t.t, x.e[t.t + 1] + m.m AS total, t.tag AS path FROM emitted x CROSS JOIN tags t JOIN moves m ON m.b IS NULL AND m.t = t.t WHERE x.place = 1
  UNION ALL
  SELECT x.doc_id, x.i, x.place, t.t, max(v.total + m.m) + any_value(x.e[t.t + 1]), arg_max(v.path, {'s': v.total + m.m, 'b': -v.t}) || any_value(t.tag)
  FROM walk v JOIN emitted x ON x.doc_id = v.doc_id AND x.i = v.i AND x.place = v.place + 1 CROSS JOIN tags t JOIN moves m ON m.b = v.t AND m.t = t.t GROUP BY x.doc_id, x.i, x.place, t.t)
"""


@query(
    f"""WITH RECURSIVE {TAGGING}, ends AS (SELECT doc_id, i, arg_max(path, {{'p': place, 's': total, 't': -t}}) AS path FROM walk GROUP BY doc_id, i)
    SELECT doc_id, s.i::INT AS sentence, len(s.w)::INT AS words, coalesce(path, '') AS tags FROM sentences s LEFT JOIN ends USING (doc_id, i)"""
)
def sentence_tags(spark, sf_dir):
    words = lambda text: F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))
    tokens = read(spark, sf_dir, "benchmark").select("item_id", F.posexplode(words(F.col("text"))).alias("place", "word"))
    before = F.lag("word").over(Window.partitionBy("item_id").orderBy("place"))
    kind = (F.char_length("word") + F.coalesce(F.char_length(before), F.lit(0))) % 3
    model = tagging.train(tokens.withColumn("tag", F.when(kind == 0, "A").when(kind == 1, "B").otherwise("C")), "item_id")
    sentences = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", r"[.!?\n]+")).alias("sentence", "s")).select("doc_id", "sentence", words(F.col("s")).alias("w"))
    return tagging.tag(sentences, "w", model).select("doc_id", "sentence", F.size("w").alias("words"), F.array_join("tags", "").alias("tags"))


ENTITIES = f"""
split AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents WHERE text IS NOT NULL),
tokens AS (SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS place FROM split),
tags AS (SELECT *, least(place // 40, 2) AS source, {hashed_sql("doc_id || ':' || place", "tag")} AS h FROM tokens),
tagged AS (SELECT *, CASE WHEN h < 0.1 THEN 'B' WHEN h < 0.25 THEN 'I' WHEN h < 0.27 THEN 'DISEASE' ELSE 'O' END AS tag FROM tags),
isl AS (SELECT *, sum(CASE WHEN tag = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, source ORDER BY place ROWS UNBOUNDED PRECEDING) AS island FROM tagged WHERE tag <> 'DISEASE'),
heads AS (SELECT *, first_value(tag) OVER (PARTITION BY doc_id, source, island ORDER BY place) AS head FROM isl),
spans AS (SELECT doc_id, source, min(place) AS begin_at, string_agg(token, ' ' ORDER BY place) AS span FROM heads WHERE head = 'B' GROUP BY doc_id, source, island
  UNION ALL SELECT doc_id, source, place, token FROM tagged WHERE tag = 'DISEASE'),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(span) ORDER BY source, begin_at) AS n FROM spans WHERE length(span) >= 3) WHERE n = 1),
listed AS (SELECT doc_id, list(span ORDER BY source, begin_at) AS c FROM once GROUP BY doc_id),
replies AS (SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN concat_ws(', ', w[5], lower(w[6]), w[7] || ' ' || w[8]) END AS reply FROM split),
named AS (SELECT d.doc_id, c, reply, list_filter(list_transform(string_split(reply, ','), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS names FROM documents d LEFT JOIN listed USING (doc_id) LEFT JOIN replies USING (doc_id)),
picked AS (SELECT *, list_filter(list_transform(names, lambda n: coalesce(list_filter(c, lambda x: lower(x) = lower(n))[1],
  list_filter(c, lambda x: list_has_any(string_split_regex(lower(x), '\\s+'), string_split_regex(lower(n), '\\s+')))[1])), lambda x: x IS NOT NULL) AS p FROM named)
"""


@query(
    f"""WITH {ENTITIES} SELECT doc_id, array_to_string(CASE WHEN coalesce(len(c), 0) = 0 THEN ['Not Specified'] WHEN reply IS NULL THEN c WHEN len(p) > 0 THEN p WHEN len(names) > 0 THEN names ELSE ['Not Specified'] END, '|') AS conditions FROM picked"""
)
def entity_conditions(spark, sf_dir):
    """Tagged tokens to spans, to candidates, to a selector's picks."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("w"))
    tokens = docs.select("doc_id", F.posexplode("w").alias("place", "token")).withColumn("h", hashed(key_of("doc_id", "place"), "tag"))
    kind = F.when(F.col("h") < 0.1, "B").when(F.col("h") < 0.25, "I").when(F.col("h") < 0.27, "DISEASE").otherwise("O")
    tokens = tokens.select("doc_id", F.least(F.floor(F.col("place") / 40), F.lit(2)).alias("source"), "place", "token", kind.alias("tag"))
    word = lambda k: F.get("w", F.lit(k - 1))
    reply = F.when(F.col("doc_id") % 3 > 0, F.concat_ws(", ", word(5), F.lower(word(6)), F.concat(word(7), F.lit(" "), word(8))))
    found = entities.conditions(docs.select("doc_id"), tokens, docs.select("doc_id", reply.alias("reply")))
    return found.select("doc_id", F.array_join("conditions", "|").alias("conditions"))


@query()
def entity_tags(spark, sf_dir):
    """A tagger trained on the benchmark's words, tagged by a rule, over all turns of the conversations."""
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))
    items = read(spark, sf_dir, "benchmark").select(words.alias("words"))
    long, after = lambda w: F.char_length(w) >= 8, lambda ws, k: F.char_length(F.get(ws, k - 1)) >= 8
    rule = F.transform("words", lambda w, k: F.when(long(w) & F.coalesce(after(F.col("words"), k), F.lit(False)), "I").when(long(w), "B").otherwise("O"))
    tagger = entities.train(items.withColumn("tags", rule), rounds=4)
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", words.alias("words"))
    return entities.tagged(turns, "words", tagger).select("conv_id", "turn", F.size("tags").alias("words"), F.array_join("tags", "").alias("tags"))


ANSWERS = f"""
split AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents WHERE text IS NOT NULL),
counted AS (SELECT doc_id, w, CASE WHEN len(w) > 400 THEN ceil((len(w) - 400) / 350.0::DOUBLE)::INT + 1 ELSE 1 END AS k FROM split),
windows AS (SELECT doc_id, w, unnest(range(k)) * 350 AS ws FROM counted),
scored AS (SELECT doc_id, ws, unnest(w[ws + 1:ws + 400]) AS token, generate_subscripts(w[ws + 1:ws + 400], 1) - 1 AS j FROM windows),
logits AS (SELECT *, {hashed_sql("doc_id || ':' || (ws + j)", "start")} * 9 AS s, {hashed_sql("doc_id || ':' || (ws + j)", "end")} * 9 AS e FROM scored),
best AS (SELECT *, max(s) OVER (PARTITION BY doc_id, ws ORDER BY j) AS ms, max(s) OVER p AS tops, max(e) OVER p AS tope FROM logits WINDOW p AS (PARTITION BY doc_id, ws)),
shares AS (SELECT doc_id, ws, sum(exp(s - tops)) AS sums, sum(exp(e - tope)) AS sume FROM best GROUP BY doc_id, ws),
ends AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, ws ORDER BY ms + e DESC, j) AS n FROM best) WHERE n = 1),
spans AS (
  SELECT e.doc_id, e.ws, (exp(e.ms - e.tops) / sums + exp(e.e - e.tope) / sume) / 2 AS score, e.j AS last, (SELECT min(f.j) FROM best f WHERE f.doc_id = e.doc_id AND f.ws = e.ws AND f.s = e.ms) AS first
  FROM ends e JOIN shares USING (doc_id, ws)),
merged AS (
  SELECT doc_id, score, array_to_string(w[ws + first + 1:ws + last + 1], ' ') AS answer
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ws) AS n FROM spans) JOIN split USING (doc_id) WHERE n = 1),
normal AS (SELECT *, CASE WHEN regexp_matches(answer, '\\d') THEN floor(regexp_extract(answer, '\\d+(?:\\.\\d+)?')::DOUBLE)::BIGINT || ' Years' ELSE trim(answer) END AS said FROM merged),
gold AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'minimum' ELSE 'maximum' END AS bound, CASE doc_id % 5 WHEN 0 THEN said WHEN 1 THEN 'Not Specified' ELSE '18 Years' END AS gold FROM documents LEFT JOIN normal USING (doc_id))
"""


def span_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_windows(read(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("tokens")).filter("tokens IS NOT NULL"), "tokens")
    place = lambda k: F.concat_ws(":", F.col("doc_id").cast("string"), (F.col("window_start") + k).cast("string"))
    logits = lambda salt: F.transform("window", lambda _, k: hashed(place(k), salt) * 9)
    found = answers.window_answers(rows.withColumns({"starts": logits("start"), "ends": logits("end")}))
    return answers.merged(found, ["doc_id"])


@query(f"WITH {ANSWERS} SELECT doc_id, md5(answer) AS answer_md5, round(score, 9) AS score FROM merged")
def best_answers(spark, sf_dir):
    return span_answers(spark, sf_dir).select("doc_id", F.md5("answer").alias("answer_md5"), F.round("score", 9).alias("score"))


@query(
    f"""WITH {ANSWERS}, swept AS (
      SELECT bound, t AS threshold, avg((CASE WHEN coalesce(score, 0) > t THEN coalesce(said, '') ELSE 'Not Specified' END = gold)::INT) AS accuracy
      FROM gold LEFT JOIN normal USING (doc_id), (SELECT unnest([{", ".join(f"{t!r}::DOUBLE" for t in answers.THRESHOLDS)}]) AS t) WHERE NOT ({MISSING.format("gold")}) GROUP BY ALL),
    top AS (SELECT bound, arg_max(threshold, {{'a': accuracy, 't': -threshold}}) AS threshold, max(accuracy) AS accuracy FROM swept GROUP BY bound)
    SELECT q.bound, round(CASE WHEN coalesce(accuracy, 0) > 0 THEN threshold ELSE {answers.DEFAULT} END, 6) AS threshold, round(coalesce(accuracy, 0.0), 9) AS accuracy
    FROM (SELECT unnest(['minimum', 'maximum', 'median']) AS bound) q LEFT JOIN top USING (bound)"""
)
def answer_thresholds(spark, sf_dir):
    found, i = span_answers(spark, sf_dir), F.col("doc_id") % 5
    bound = F.when(F.col("doc_id") % 2 == 0, "minimum").otherwise("maximum")
    docs = read(spark, sf_dir, "documents").select("doc_id", bound.alias("bound"))
    gold = docs.join(found, "doc_id", "left").select("doc_id", "bound", F.when(i == 0, answers.normal_age(F.col("answer"))).when(i == 1, "Not Specified").otherwise("18 Years").alias("gold"))
    out = answers.calibrated(found.join(docs, "doc_id"), gold, ("minimum", "maximum", "median"), ["doc_id"])
    return out.select("bound", F.round("threshold", 6).alias("threshold"), F.round("accuracy", 9).alias("accuracy"))


class Flaky:
    """An offline connector: a request fails 0 to 3 times first by its hash, one in 17 always; replies are made of the hash."""

    def __init__(self):
        self.tried: dict[bytes, int] = {}

    def send(self, body: str) -> str:
        key = hashlib.sha256(body.encode())
        h = int(key.hexdigest()[:8], 16)
        # By the whole hash: among some hundred thousand requests, two begin with the same eight digits.
        self.tried[key.digest()] = self.tried.get(key.digest(), 0) + 1
        if h % 17 == 0 or self.tried[key.digest()] <= h % 4:
            raise RuntimeError(f"rate limited {h % 4}")
        usage = {"prompt_tokens": len(body), "completion_tokens": h % 50}
        return json.dumps({"choices": [{"message": {"content": f'{{"label": {h % 7}}}'}, "finish_reason": "stop"}], "usage": usage})


PROMPT = "Answer with a label."


def _rest_of_body() -> str:
    """What every body of the query ends with, after its messages."""
    return ', "max_tokens": 180, "provider": {"require_parameters": true}}'


@query(
    f"""WITH bodies AS (SELECT doc_id, '{{"model":"offline","messages":[{{"role":"system","content":"{PROMPT}"}},{{"role":"user","content":"' || coalesce(lang, 'none') || ' ' || md5(coalesce(text, ''))
      || '"}}],"temperature": 0{_rest_of_body()[:-1]}}}' AS body FROM documents),
    h AS (SELECT doc_id, length(body) AS n, CAST('0x' || substr(sha256(body), 1, 8) AS BIGINT) AS h FROM bodies)
    SELECT doc_id, CASE WHEN h % 17 = 0 THEN 5 ELSE h % 4 + 1 END::INT AS attempts, CASE WHEN h % 17 <> 0 THEN '{{"label": ' || h % 7 || '}}' END AS reply,
      CASE WHEN h % 17 = 0 THEN 'RuntimeError: rate limited ' || h % 4 ELSE '' END AS error, CASE WHEN h % 17 <> 0 THEN n END::INT AS input_tokens, CASE WHEN h % 17 <> 0 THEN h % 50 END::INT AS output_tokens,
      round(CASE WHEN h % 17 = 0 THEN 0.0 ELSE n / 1e6 * 3.0 + (h % 50) / 1e6 * 15.0 END, 9) AS cost_usd FROM h"""
)
def call_runs(spark, sf_dir):
    """Requests of all documents, sent once each by an offline connector, with their attempts."""
    docs = read(spark, sf_dir, "documents")
    user = F.concat_ws(" ", F.coalesce("lang", F.lit("none")), F.md5(F.coalesce("text", F.lit(""))))
    requests = docs.select("doc_id", calls.request_body("offline", F.lit(PROMPT), user).alias("body"))
    store = shared_path(spark)
    calls.run(requests, store, Flaky, wait=lambda seconds: None)
    found = calls.answered(requests, store)
    return found.select("doc_id", "attempts", "reply", "error", "input_tokens", "output_tokens", F.round("cost_usd", 9).alias("cost_usd"))


@query(
    """WITH x AS (SELECT label, vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS d, CASE WHEN vec_id % 3 = 0 THEN 0 ELSE 1 END AS m FROM embeddings),
    means AS (SELECT label, d, sum(v::DOUBLE * m) / greatest(sum(m), 1e-9) AS mean FROM x GROUP BY label, d)
    SELECT label, count(*)::INT AS dims, round(sqrt(sum(mean * mean)), 6) AS length, round(sum(mean * d), 5) AS weighed FROM means GROUP BY label"""
)
def pooled_vectors(spark, sf_dir):
    """Each label's vectors as token vectors of one text, every third one masked."""
    rows = read(spark, sf_dir, "embeddings").groupBy("label").agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("x"))
    mask = F.transform("x", lambda t: F.when(t["vec_id"] % 3 == 0, 0).otherwise(1))
    found = rows.select("label", sections.pooled(F.transform("x", lambda t: t["embedding"]), mask).alias("v"))
    total = lambda f: F.aggregate(F.transform("v", f), F.lit(0.0), lambda s, x: s + x)
    length, weighed = F.sqrt(total(lambda x: x * x)), total(lambda x, k: x * (k + 1))
    return found.select("label", F.size("v").alias("dims"), F.round(length, 6).alias("length"), F.round(weighed, 5).alias("weighed"))


def section_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of the documents as sections, titled by their first words, every fourth one untitled."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", r"\n+")).alias("section_index", "text"))
    title = F.when(F.col("section_index") % 4 == 3, "").otherwise(F.array_join(F.slice(F.split("text", " "), 1, 3), " "))
    return docs.select("doc_id", "section_index", title.alias("title"), "text", F.split("text", r"\. ").alias("paragraphs"))


@query()
def section_views(spark, sf_dir):
    """Every section's scores by title, opening, body and best paragraph, through the offline encoder, and its rank."""
    scored = sections.view_scores(section_rows(spark, sf_dir), "who may take part in the study")
    ranked = sections.ranked_sections(scored)
    return ranked.select("doc_id", "section_index", "rank", *[F.round(c, 9).alias(c) for c in ("title_score", "opening_score", "body_score", "paragraph_score")])


@query(
    r"""WITH gold AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'nan' ELSE 'asthma, gout' END AS conditions, CASE WHEN quality = 1 THEN 'observational' END AS study_type, CASE WHEN toxic = 1 THEN 'Not Specified' ELSE 'all' END AS sex,
      '18 Years' AS minimum_age, CASE WHEN quality = 1 THEN '65 Years' ELSE '' END AS maximum_age, CASE WHEN quality = 1 THEN 'adults' ELSE 'NAN' END AS eligibility_criteria FROM labels),
    rows AS (SELECT g.*, coalesce(d.text, '') AS abstract FROM gold g JOIN documents d USING (doc_id)),
    told AS (SELECT doc_id, lower(abstract) AS low, unnest([minimum_age, maximum_age]) AS gold FROM rows WHERE trim(abstract) <> ''),
    asked AS (SELECT doc_id, low, regexp_extract(gold, '\d+') AS number FROM told WHERE lower(trim(gold)) NOT IN ('', 'nan', 'not specified')),
    pieces AS (SELECT *, row_number() OVER () AS r, regexp_split_to_array(low, '\b' || number || '\b') AS p FROM asked),
    hits AS (SELECT r, low, number, unnest(range(1, len(p))) AS k, p FROM pieces),
    placed AS (SELECT r, low, number, list_sum(list_transform(p[1:k], lambda x: length(x))) + (k - 1) * length(number) AS at0 FROM hits),
    near AS (SELECT DISTINCT r FROM placed WHERE regexp_matches(low[greatest(at0 - 29, 1)::INT:(at0 + length(number) + 30)::INT], 'year|yr|age|old'))
    SELECT 'ages' AS name, count(*) AS n FROM near UNION ALL SELECT 'study_type', count(*) FROM rows WHERE study_type IS NOT NULL UNION ALL SELECT 'sex', count(*) FROM rows WHERE sex = 'all'
    UNION ALL SELECT 'conditions', count(*) FROM rows WHERE conditions <> 'nan' UNION ALL SELECT 'generator', count(*) FROM rows WHERE eligibility_criteria = 'adults' AND trim(abstract) <> ''"""
)
def training_counts(spark, sf_dir):
    """The rows of the trainings' tables that need no model; answers stand in from the labels."""
    labels, none = read(spark, sf_dir, "labels"), F.lit(None).cast("string")
    good = F.col("quality") == 1
    gold = labels.select(
        "doc_id", F.when(F.col("doc_id") % 3 == 0, "nan").otherwise("asthma, gout").alias("conditions"), F.when(good, "observational").alias("study_type"),
        F.when(F.col("toxic") == 1, "Not Specified").otherwise("all").alias("sex"), F.lit("18 Years").alias("minimum_age"), F.when(good, "65 Years").otherwise("").alias("maximum_age"),
        F.when(good, "adults").otherwise("NAN").alias("eligibility_criteria"),
    )
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("title"), F.col("text").alias("abstract"))
    names = labels.select("doc_id", F.array(F.lit("asthma")).alias("candidates"))
    rows = training.joined(docs, gold, docs.select("doc_id", none.alias("candidate_text")))
    found = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("name"), "n") for k, t in training.tables(rows, names).items()]
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


@query()
def text_classes(spark, sf_dir):
    """A classifier of quality, trained on all labelled documents, over all documents; kept and loaded as an artifact."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rows = docs.join(read(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("label")), "doc_id")
    store = shared_path(spark)
    found = classifier.fit(rows, "text", "label", "quality", bits=14, rounds=15)
    if found is not None:
        artifacts.keep(spark, found, store)
        found = artifacts.load(spark, store, "quality")
    return classifier.predicted(docs, "text", found).select("doc_id", "label", F.round("probability", 6).alias("probability"))
