"""Further registered queries: layouts, filters, joins and answers over stand-in columns, with the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import annotations as an
from ..functions import replies as rp
from ..functions import scores as sc
from ..functions import submission as sub
from ..functions import text as tx
from ..operators import generators as gen
from ..operators import relations as rel
from ..sources import tables
from . import analysis, labelling, local, models, retrieval, routing
from .queries import ALL_WORDS, ANNOTATED, BLOCKS, PATHS, RESOLVED, ROUTED, SYSTEMS, UNIFIED, annotated, hashed, key_of, query, read, routed_blocks, routed_texts, scored_blocks, system, system_scores

PATH_SQL = "CASE {0} % 8 " + " ".join("WHEN {} THEN '{}'".format(k, " > ".join(p).replace("'", "''")) for k, p in enumerate(PATHS)) + " END"


def path_of(key: Column) -> Column:
    paths = F.array(*[F.array(*[F.lit(x) for x in p]) for p in PATHS])
    return F.element_at(paths, (key % 8 + 1).cast("int"))


def picked(key: Column, *values: str | None) -> Column:
    """The value whose place the key's remainder names."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


def picked_sql(key: str, *values: str | None) -> str:
    quoted = ["NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values]
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(quoted)) + " END"


# Structure.

SECTIONS = """
sections AS (SELECT doc_id, block_index AS "order", doc_id || '::s' || block_index AS section_id,
  CASE WHEN block_index % 4 = 0 THEN NULL ELSE doc_id || '::s' || (block_index - block_index % 4) END AS parent_id FROM blocks)
"""


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("block_index")
    name = lambda k: F.concat(F.col("doc_id").cast("string"), F.lit("::s"), k.cast("string"))
    return gen.line_blocks(read(spark, sf_dir, "documents")).select("doc_id", i.alias("order"), name(i).alias("section_id"), F.when(i % 4 != 0, name(i - i % 4)).alias("parent_id"))


@query(
    f"""WITH {BLOCKS}, {SECTIONS} SELECT doc_id, section_id, CASE WHEN parent_id IS NOT NULL THEN lag(section_id) OVER w END AS prev_sibling_id,
    CASE WHEN parent_id IS NOT NULL THEN lead(section_id) OVER w END AS next_sibling_id FROM sections WINDOW w AS (PARTITION BY doc_id, parent_id ORDER BY "order")"""
)
def sibling_sections(spark, sf_dir):
    return rel.with_sibling_sections(sections(spark, sf_dir)).select("doc_id", "section_id", "prev_sibling_id", "next_sibling_id")


@query(f"WITH {BLOCKS}, {SECTIONS} SELECT doc_id, parent_id, string_agg(section_id, ',' ORDER BY \"order\") AS children FROM sections WHERE parent_id IS NOT NULL GROUP BY doc_id, parent_id")
def section_children(spark, sf_dir):
    found = rel.child_ids(sections(spark, sf_dir), "parent_id", "order", "section_id", ["doc_id"])
    return found.select("doc_id", "parent_id", F.array_join("children", ",").alias("children"))


@query(
    f"WITH {BLOCKS} SELECT doc_id, block_index, lag(block_index) OVER w AS before, lead(block_index) OVER w AS after FROM blocks WINDOW w AS (PARTITION BY doc_id, block_index // 10 ORDER BY block_index)"
)
def section_block_links(spark, sf_dir):
    blocks = gen.line_blocks(read(spark, sf_dir, "documents")).withColumn("section", F.floor(F.col("block_index") / 10))
    return rel.with_links(blocks, ["doc_id", "section"], "block_index", "block_index", "before", "after").select("doc_id", "block_index", "before", "after")


@query(
    f"""WITH {BLOCKS}, {SECTIONS}, b AS (SELECT doc_id, block_index, CASE WHEN block_index % 3 = 0 THEN 'Own' END AS own, parent_id AS section_id FROM blocks JOIN sections ON sections.doc_id = blocks.doc_id AND "order" = block_index)
    SELECT doc_id, block_index, coalesce(own, CASE WHEN section_id IS NOT NULL THEN 'Section ' || (block_index - block_index % 4) END, '') AS path
    FROM (SELECT blocks.doc_id, blocks.block_index, CASE WHEN blocks.block_index % 3 = 0 THEN 'Own' END AS own, s.parent_id AS section_id FROM blocks JOIN sections s ON s.doc_id = blocks.doc_id AND s."order" = blocks.block_index)"""
)
def section_paths(spark, sf_dir):
    rows = sections(spark, sf_dir)
    none = F.array().cast("array<string>")
    blocks = rows.select("doc_id", F.col("order").alias("block_index"), F.col("parent_id").alias("section_id"), F.when(F.col("order") % 3 == 0, F.array(F.lit("Own"))).otherwise(none).alias("section_path"))
    known = rows.filter("parent_id IS NOT NULL").select("doc_id", F.col("parent_id").alias("section_id"), F.array(F.concat(F.lit("Section "), (F.col("order") - F.col("order") % 4).cast("string"))).alias("path")).distinct()
    return tables.with_section_paths(blocks, known).select("doc_id", "block_index", tx.path_text(F.col("section_path")).alias("path"))


# Layouts.

CLEANED = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


@query(
    f"""WITH t AS (SELECT item_id, {PATH_SQL.format("item_id")} AS path, CASE WHEN item_id % 3 = 0 THEN NULL ELSE 'table' END AS kind, text FROM benchmark)
    SELECT item_id, md5('Section path: ' || path || chr(10) || 'Block type: ' || coalesce(kind, 'text') || chr(10) || 'Text: ' || {CLEANED}) AS embedded,
    md5('Section: ' || path || chr(10) || text || chr(10)) AS piece, md5('Section: ' || path || chr(10) || 'Text: ' || trim(text)) AS training,
    md5('[Block ' || item_id || ']' || chr(10) || 'Section: ' || CASE WHEN item_id % 5 = 0 THEN 'Unknown section' ELSE path END || chr(10) || text) AS routed FROM t"""
)
def layouts(spark, sf_dir):
    i, text = F.col("item_id"), F.col("text")
    path, none = path_of(i), F.array().cast("array<string>")
    return read(spark, sf_dir, "benchmark").select(
        "item_id",
        F.md5(tx.embedding_text(path, F.when(i % 3 != 0, "table"), text)).alias("embedded"),
        F.md5(tx.context_piece(path, text)).alias("piece"),
        F.md5(tx.training_text(tx.path_text(path), text)).alias("training"),
        F.md5(tx.routed_piece(i, F.when(i % 5 == 0, none).otherwise(path), text)).alias("routed"),
    )


@query(
    """SELECT doc_id, md5('Title:' || chr(10) || CASE WHEN doc_id % 3 = 0 THEN 'Not provided' ELSE 'On ' || lang END || chr(10) || chr(10) || 'Abstract:' || chr(10) || coalesce(source, 'Not provided')
    || chr(10) || chr(10) || 'Keywords:' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN lang || ', ' || 'two words' ELSE 'Not provided' END
    || chr(10) || chr(10) || 'Evidence:' || chr(10) || CASE WHEN doc_id % 5 = 0 THEN 'None.' ELSE 'n ' || n_chars END) AS context_md5 FROM documents"""
)
def headed_contexts(spark, sf_dir):
    i = F.col("doc_id")
    title = F.when(i % 3 != 0, F.concat(F.lit(" On  "), "lang"))
    keywords = F.when(i % 2 == 0, F.array(F.col("lang"), F.lit(" "), F.lit("two \n words")))
    body = F.when(i % 5 != 0, F.concat(F.lit("n "), F.col("n_chars").cast("string")))
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(tx.headed_context(title, F.col("source"), keywords, body, "Evidence", "Not provided", "None.")).alias("context_md5"))


@query(
    """SELECT p_partkey::VARCHAR AS pmcids, '[' || '''' || p_name || ''', ''' || p_brand || ''']' AS conditions, CASE WHEN p_partkey % 5 = 0 THEN 'OBSERVATIONAL' ELSE 'INTERVENTIONAL' END AS study_type,
    CASE WHEN p_partkey % 7 = 0 THEN 'Other' ELSE 'FEMALE' END AS sex, CASE WHEN p_partkey % 3 = 0 OR p_partkey % 7 = 0 THEN 'Not Specified' ELSE p_size || ' Years' END AS minimum_age, 'Not Specified' AS maximum_age,
    'Inclusion Criteria: ' || CASE WHEN p_partkey % 4 = 0 THEN '* Not Specified.' ELSE '* ' || p_type || '; * ' || p_name || '.' END || ' Exclusion Criteria: * ' || p_brand || '.' AS eligibility_criteria FROM part"""
)
def submission_rows(spark, sf_dir):
    i, none = F.col("p_partkey"), F.lit(None).cast("string")
    cond = F.struct(F.concat("p_name", F.lit(" ; • "), "p_brand").alias("conditions"), F.when(i % 5 != 0, "INTERVENTIONAL").alias("study_type"))
    demo = F.struct(F.lit("FEMALE").alias("sex"), F.when(i % 3 == 0, " ").otherwise(F.concat(F.col("p_size").cast("string"), F.lit(" Years"))).alias("minimum_age"), none.alias("maximum_age"))
    listed = F.when(i % 4 != 0, F.array(F.concat("p_type", F.lit(". ;")), F.lit(" "), F.col("p_name")))
    elig = F.struct(listed.alias("inclusion_criteria"), F.array(F.concat(F.lit(" "), "p_brand", F.lit("."))).alias("exclusion_criteria"))
    rows = read(spark, sf_dir, "part").select(F.concat(F.lit("PMC"), i.cast("string")).alias("doc_id"), cond.alias("cond"), F.when(i % 7 != 0, demo).alias("demo"), elig.alias("elig"))
    return sub.submission(rows)


@query(f"WITH {ROUTED} SELECT doc_id, field, string_agg(block_index::VARCHAR, ',' ORDER BY block_index) AS blocks FROM routed GROUP BY doc_id, field")
def routed_serialised(spark, sf_dir):
    rows = routed_blocks(spark, sf_dir).withColumns({"block_id": F.col("block_index").cast("string"), "section_path": F.array().cast("array<string>")})
    return routing.serialised(rows).select("doc_id", "field", F.array_join(F.transform("blocks", lambda b: b["block_id"]), ",").alias("blocks"))


ASKED_SQL = "CASE field " + " ".join(f"WHEN '{f}' THEN '{t}'" for f, t in routing.ASKED.items()) + " END"


@query(f"WITH {ROUTED} SELECT doc_id, block_index, field, md5({ASKED_SQL} || chr(10) || chr(10) || 'Evidence follows:' || chr(10) || chr(10) || text) AS prompt_md5 FROM routed")
def field_prompts(spark, sf_dir):
    rows = routing.prompts(routed_texts(spark, sf_dir).withColumnRenamed("text", "context"))
    return rows.select("doc_id", "block_index", "field", F.md5("prompt").alias("prompt_md5"))


# Filters and texts.

SAID = ("", " nan ", "None", "Not Specified", "['Not Specified']", "18 Years", None, " NaN ", "NOT SPECIFIED\n")


@query(
    f"""WITH t AS (SELECT event_id, {picked_sql("event_id", *SAID)} AS a), u AS (SELECT event_id, regexp_replace(coalesce(a, ''), '^[\\s\\x{{A0}}\\x{{2003}}]+|[\\s\\x{{A0}}\\x{{2003}}]+$', '', 'g') AS s FROM t)
    SELECT event_id, upper(s) IN ('', 'NOT SPECIFIED', 'NAN') AS narrow, lower(s) IN ('', 'nan', 'none', 'not specified', '[''not specified'']', '["not specified"]') AS wide FROM u""".replace("AS a)", "AS a FROM events)")
)
def missing_answers(spark, sf_dir):
    answer = picked(F.col("event_id"), *SAID)
    return read(spark, sf_dir, "events").select("event_id", tx.missing(answer).alias("narrow"), tx.missing_wide(answer).alias("wide"))


@query("SELECT doc_id::VARCHAR AS pmcids FROM labels WHERE NOT (doc_id % 3 = 0 AND (doc_id * 2) % 5 >= 2)")
def comparable_rows(spark, sf_dir):
    rows = system(spark, sf_dir, 0).withColumn("pmcids", F.concat(F.lit("PMC"), F.col("pmcids").cast("string")))
    return analysis.comparable(rows).select("pmcids")


@query(
    r"""WITH t AS (SELECT p_partkey, p_size::VARCHAR AS n, 'no ' || p_size || ' in ' || repeat('x ', 20) || 'of ' || (p_size * 3) || ', ' || p_size || ' and ' || p_size || CASE WHEN p_partkey % 3 = 0 THEN ' items' ELSE ' years' END AS t FROM part),
    h AS (SELECT p_partkey, n, t, i FROM t, LATERAL (SELECT unnest(range(1, length(t) + 1)) AS i) WHERE substr(t, i, length(n)) = n AND NOT regexp_matches(substr(' ' || t, i, 1), '\w') AND NOT regexp_matches(substr(t || ' ', i + length(n), 1), '\w'))
    SELECT p_partkey, (min(i) - 1)::INT AS answer_start FROM h WHERE regexp_matches(substr(t, greatest(i - 30, 1), i + length(n) + 30 - greatest(i - 30, 1)), '(?i)year|yr|age|old') GROUP BY p_partkey"""
)
def age_spans(spark, sf_dir):
    size = F.col("p_size").cast("string")
    unit = F.when(F.col("p_partkey") % 3 == 0, " items").otherwise(" years")
    text = F.concat(F.lit("no "), size, F.lit(" in " + "x " * 20 + "of "), (F.col("p_size") * 3).cast("string"), F.lit(", "), size, F.lit(" and "), size, unit)
    return gen.age_spans(read(spark, sf_dir, "part").select("p_partkey", size.alias("n"), text.alias("t")), "t", "n").select("p_partkey", "answer_start")


@query(
    """SELECT item_id, md5('x ' || chr(10) || text) AS stripped, md5('x ' || replace(text, chr(10), ' ')) AS cleaned, md5(chr(160) || 'x ' || replace(text, chr(10), ' ') || chr(8195)) AS cleaned_ascii
    FROM (SELECT item_id, trim(regexp_replace(text, '[ \\t-\\r]+', ' ', 'g')) AS text FROM benchmark)"""
)
def stripped_texts(spark, sf_dir):
    inner = F.concat(F.lit("x \n"), tx.clean_ascii(F.col("text")))
    text = F.concat(F.lit(" "), inner, F.lit(" "))
    return read(spark, sf_dir, "benchmark").select("item_id", F.md5(tx.strip(text)).alias("stripped"), F.md5(tx.clean(text)).alias("cleaned"), F.md5(tx.clean_ascii(text)).alias("cleaned_ascii"))


NAMES = ("Condition", "condition-and study type", "Condition & Study Type", " study_type ", "Demographic", "Eligibility Criteria", "overall irrelevant", "Else-where", "demographics")
MEANT = ("condition_study_type", "condition_study_type", "condition_study_type", "condition_study_type", "demographics", "eligibility", "irrelevant", "else_where", "demographics")


@query(f"SELECT event_id, {picked_sql('event_id', *MEANT)} AS field FROM events")
def field_names(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", sub.field_name(picked(F.col("event_id"), *NAMES)).alias("field"))


AGES = ("18.7 Years", " 6 Months ", " adult ", None, "from 21 to 65", "")


@query(
    f"""WITH t AS (SELECT event_id, coalesce({picked_sql("event_id", *AGES)}, '') AS a FROM events)
    SELECT event_id, CASE WHEN regexp_matches(a, '\\d') THEN floor(regexp_extract(a, '\\d+(\\.\\d+)?')::DOUBLE)::BIGINT || ' Years' ELSE trim(a) END AS age FROM t"""
)
def normal_ages(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", sc.normal_age(picked(F.col("event_id"), *AGES)).alias("age"))


@query(
    f"""WITH {BLOCKS}, p AS (SELECT doc_id, block_index, text, len(string_split_regex(text, ' ')) >= 15 AS wordy FROM blocks)
    SELECT doc_id, count(*) AS paragraphs, count_if(doc_id % 2 = 0 OR wordy)::BIGINT AS kept FROM p GROUP BY doc_id"""
)
def wordy_paragraphs(spark, sf_dir):
    lists = scored_blocks(spark, sf_dir).groupBy("doc_id").agg(F.collect_list("text").alias("p"))
    title = F.when(F.col("doc_id") % 2 == 0, "Methods").otherwise(" ")
    return lists.select("doc_id", F.size("p").cast("long").alias("paragraphs"), F.size(tx.wordy_paragraphs(title, F.col("p"))).cast("long").alias("kept"))


@query("SELECT item_id, len(list_filter(string_split(text, ' '), lambda x: length(x) > 2))::INT AS entities FROM benchmark")
def long_entities(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", F.size(tx.long_entities(F.split("text", " "))).alias("entities"))


# Joins, unions, reports.


@query(
    """SELECT s.doc_id::VARCHAR AS sample_id FROM labels s WHERE NOT (s.doc_id % 5 <> 0 AND (s.doc_id % 3 <> 0) AND s.doc_id % 7 <> 0)"""
)
def pending_samples(spark, sf_dir):
    i = F.col("doc_id")
    samples = read(spark, sf_dir, "labels").select("doc_id", i.cast("string").alias("sample_id"))
    done = samples.filter(i % 5 != 0).select(
        "sample_id", F.when(i % 3 == 0, "no label").otherwise("Demographics").alias("haiku_label"), F.when(i % 7 == 0, "timeout").when(i % 2 == 0, " ").alias("haiku_error")
    )
    return labelling.pending(samples, done, "haiku").select("sample_id")


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN upper(p_name) WHEN p_partkey % 4 = 1 AND list_has_any(string_split(lower(p_name), ' '), ['big', 'widget']) THEN p_name
    WHEN p_partkey % 4 = 2 THEN p_brand END AS choice FROM part""".replace("upper(p_name)", "p_name")
)
def fuzzy_selection(spark, sf_dir):
    said = F.when(F.col("p_partkey") % 4 == 0, F.upper("p_name")).when(F.col("p_partkey") % 4 == 1, "a Big  WIDGET").when(F.col("p_partkey") % 4 == 2, F.lower("p_brand")).otherwise("nothing of these")
    return read(spark, sf_dir, "part").select("p_partkey", gen.fuzzy_pick(F.array("p_name", "p_brand"), said).alias("choice"))


@query("SELECT round(avg((e.vec_id IS NOT NULL)::INT), 9) AS hit_rate FROM documents d LEFT JOIN (SELECT vec_id FROM embeddings WHERE vec_id % 3 <> 0) e ON e.vec_id = d.doc_id")
def cache_hit_rate(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings").filter("vec_id % 3 <> 0").select(F.col("vec_id").alias("doc_id"), "vec_id")
    found = rel.hit_rate(read(spark, sf_dir, "documents").select("doc_id").join(vectors, "doc_id", "left"), "vec_id")
    return found.select(F.round("hit_rate", 9).alias("hit_rate"))


@query(
    """WITH t AS (SELECT (quality + doc_id % 2)::INT AS p, (toxic + quality)::INT AS t FROM labels), c AS (SELECT DISTINCT t AS c FROM t),
    f AS (SELECT c, (SELECT count(*) FROM t WHERE t = c) AS n, (SELECT count(*) FROM t WHERE p = c) AS said, (SELECT count(*) FROM t WHERE p = c AND t = c) AS hit FROM c)
    SELECT round((SELECT avg((p = t)::INT) FROM t), 9) AS accuracy, round(sum(n * CASE WHEN hit > 0 THEN 2.0 * hit / (said + n) ELSE 0 END) / sum(n), 9) AS weighted_f1 FROM f"""
)
def class_report(spark, sf_dir):
    rows = read(spark, sf_dir, "labels").select((F.col("quality") + F.col("doc_id") % 2).cast("int").alias("p"), (F.col("toxic") + F.col("quality")).cast("int").alias("t"))
    return rel.classification_report(rows, "p", "t").select(F.round("accuracy", 9).alias("accuracy"), F.round("weighted_f1", 9).alias("weighted_f1"))


@query(
    f"""WITH {BLOCKS}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, block_index) AS best FROM scored), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block_index) AS n FROM r WHERE best > 1)
    SELECT r.doc_id, 'age' AS query, md5(any_value(r.text)) AS positive, coalesce(md5(string_agg(o.text, '|' ORDER BY o.block_index)), md5('')) AS negatives FROM r LEFT JOIN o ON o.doc_id = r.doc_id AND o.n <= 4 WHERE r.best = 1 GROUP BY r.doc_id"""
)
def ranker_examples(spark, sf_dir):
    scored = scored_blocks(spark, sf_dir).withColumnRenamed("block_index", "section_index")
    found = models.ranker_examples(scored, "age")
    return found.select("doc_id", "query", F.md5("positive").alias("positive"), F.md5(F.array_join("negatives", "|")).alias("negatives"))


@query("SELECT doc_id, lang, NULL::INT AS quality FROM documents UNION ALL SELECT doc_id, NULL, quality FROM labels")
def resumed_union(spark, sf_dir):
    old = read(spark, sf_dir, "documents").select("doc_id", "lang")
    new = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("quality"))
    return rel.resumed(old, new)


@query("SELECT coalesce(doc_id, page_id) AS doc_id, length(text)::INT AS old_chars, length(html)::INT AS new_chars FROM documents FULL JOIN pages ON page_id = doc_id")
def context_sizes(spark, sf_dir):
    old = read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("context"))
    new = read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("context"))
    return analysis.context_lengths(old, new)


@query(f"WITH {BLOCKS} SELECT doc_id, (length(any_value(lang)) + coalesce(length(any_value(source)), 0) + sum(char_count))::BIGINT AS article_chars FROM scored JOIN documents USING (doc_id) GROUP BY doc_id")
def article_lengths(spark, sf_dir):
    lists = scored_blocks(spark, sf_dir).groupBy("doc_id").agg(F.collect_list("text").alias("sections"))
    rows = read(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(lists, "doc_id")
    return rows.select("doc_id", analysis.article_chars(F.col("lang"), F.col("source"), F.col("sections")).alias("article_chars"))


# Scores and answers.

COSINE = """
(SELECT list_sum(list_transform(list_distinct(a), lambda w: len(list_filter(a, lambda x: x = w)) * len(list_filter(b, lambda x: x = w)))) AS d,
  list_sum(list_transform(list_distinct(a), lambda w: len(list_filter(a, lambda x: x = w)) ** 2)) AS m, list_sum(list_transform(list_distinct(b), lambda w: len(list_filter(b, lambda x: x = w)) ** 2)) AS n)
"""


@query(
    f"""WITH turns AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN ' nan' ELSE text END AS text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
    w AS (SELECT conv_id, turn, text, {ALL_WORDS.format("before")} AS a, {ALL_WORDS.format("trim(text)")} AS b FROM turns WHERE before IS NOT NULL)
    SELECT conv_id, turn, round(CASE WHEN turn % 5 = 4 OR len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE d / (sqrt(m) * sqrt(n)) END, 9) AS score FROM w, LATERAL {COSINE}"""
)
def semantic_similarity(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = read(spark, sf_dir, "conversations").withColumn("before", F.lag("text").over(w)).filter("before IS NOT NULL")
    a, b = F.col("before"), F.when(F.col("turn") % 5 == 4, " nan").otherwise(F.col("text"))
    return turns.select("conv_id", "turn", F.round(sc.gated(a, b, sc.word_cosine(a, b)), 9).alias("score"))


@query(
    """WITH t AS (SELECT doc_id AS pmcids, CASE doc_id % 3 WHEN 0 THEN 1 / sqrt(3) WHEN 1 THEN 1 ELSE 0 END::DOUBLE AS c, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END::DOUBLE AS a, CASE WHEN doc_id % 4 = 0 THEN 1 / sqrt(2) ELSE 0 END::DOUBLE AS e FROM labels)
    SELECT pmcids, round(c, 9) AS score_conditions, a AS score_minimum_age, round(e, 9) AS score_eligibility_criteria, round(0.15 * c + 0.10 * 1 + 0.05 * 1 + 0.10 * a + 0.10 * 1 + 0.50 * e, 9) AS score_overall FROM t"""
)
def fast_scores(spark, sf_dir):
    i, none = F.col("doc_id"), F.lit("Not Specified")
    rows = lambda c, low, e: read(spark, sf_dir, "labels").select(
        i.alias("pmcids"), c.alias("conditions"), F.lit("trial").alias("study_type"), none.alias("sex"), low.alias("minimum_age"), none.alias("maximum_age"), e.alias("eligibility_criteria")
    )
    said = rows(picked(i, "asthma in adults", "Asthma", "Not Specified"), F.when(i % 2 == 0, "eighteen").otherwise(none), F.when(i % 4 == 0, "adults only").otherwise("none"))
    scored = analysis.scores(analysis.paired(said, rows(F.lit("asthma"), F.lit("18 Years"), F.lit("adults"))), fast=True)
    return scored.select("pmcids", *[F.round(f"score_{f}", 9).alias(f"score_{f}") for f in ("conditions", "minimum_age", "eligibility_criteria", "overall")])


REPLIES = (
    '```json\n{"label": "Demographics", "overall_relevance": 4, "reason": " says an age "}\n```', '{"label": "Else", "overall_relevance": 4, "reason": "x"}',
    '{"label": "Demographics", "overall_relevance": 9, "reason": "x"}', '{"label": "Demographics", "overall_relevance": true, "reason": "x"}', '{"label": "Demographics", "overall_relevance": 2, "reason": " "}',
    "no JSON", '["label"]', 'json {"label": "x"}', None,
)


@query(
    f"""SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'Demographics' END AS label, CASE WHEN event_id % 9 = 0 THEN 4 END::INT AS relevance, CASE WHEN event_id % 9 = 0 THEN 'says an age' END AS reason,
    {picked_sql("event_id", None, "invalid label", "invalid relevance", "invalid relevance", "no reason", "not JSON", "not an object", "not JSON", "not JSON")} AS error FROM events"""
)
def label_replies(spark, sf_dir):
    good, error = rp.label_reply(picked(F.col("event_id"), *REPLIES))
    rows = read(spark, sf_dir, "events").select("event_id", good.alias("g"), error.alias("error"))
    return rows.select("event_id", "g.label", F.col("g.overall_relevance").alias("relevance"), "g.reason", "error")


ANSWERS = ("['a b', 'c']", '["x", "it\'s"]', "a, b ,,c", "", "['broken", None, "one")


@query(f"SELECT event_id, {picked_sql('event_id', 'a b|c', 'x|it' + chr(39) + 's', 'a|b|c', '', '[' + chr(39) + 'broken', '', 'one')} AS items, {picked_sql('event_id', 'a b, c', 'x, it' + chr(39) + 's', 'a, b, c', '', '[' + chr(39) + 'broken', '', 'one')} AS flat FROM events")
def answer_lists(spark, sf_dir):
    items = rp.listed_answer(picked(F.col("event_id"), *ANSWERS))
    return read(spark, sf_dir, "events").select("event_id", F.array_join(items, "|").alias("items"), rp.flat_answer(items).alias("flat"))


@query(
    """SELECT event_id, event_id % 50 AS input_tokens, CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 20 END AS output_tokens, CASE WHEN event_id % 4 < 2 THEN 7 ELSE 0 END AS reasoning_tokens FROM events"""
)
def token_usage(spark, sf_dir):
    i = F.col("event_id")
    usage = F.struct(
        (i % 50).cast("int").alias("prompt_tokens"), F.when(i % 3 != 0, (i % 20).cast("int")).alias("completion_tokens"),
        F.when(i % 4 == 0, F.struct(F.lit(7).alias("reasoning_tokens"))).alias("completion_tokens_details"), F.when(i % 4 == 1, F.lit(7)).alias("reasoning_tokens"),
    )
    found = rp.usage(rp.json_text(F.struct(usage.alias("usage"))))
    rows = read(spark, sf_dir, "events").select("event_id", found.alias("u"))
    return rows.select("event_id", *[F.col(f"u.{c}").cast("long").alias(c) for c in ("input_tokens", "output_tokens")], F.col("u.reasoning_tokens").alias("reasoning_tokens"))


# Runs.


@query(
    f"""WITH {RESOLVED}, g AS (SELECT DISTINCT doc_id FROM resolved), k AS (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id::VARCHAR || ':42'), doc_id) AS rk, count(*) OVER () AS n FROM g)
    SELECT r.sample_id, r.final_labels, r.resolution_method, md5('Section: s' || r.doc_id || chr(10) || 'Text: t') AS input_md5,
    CASE WHEN rk <= floor(0.8::DOUBLE * n) THEN 'train' WHEN rk <= floor(0.8::DOUBLE * n) + floor(0.5::DOUBLE * (n - floor(0.8::DOUBLE * n))) THEN 'validation' ELSE 'test' END AS split
    FROM resolved r JOIN k USING (doc_id)"""
)
def prepared_training(spark, sf_dir):
    rows = annotated(spark, sf_dir).withColumns({"block_id": F.col("sample_id"), "section_path": F.concat(F.lit(" s"), F.col("sample_id")), "text": F.lit("t\n")})
    found = labelling.prepared(rows)
    return found.select("sample_id", "final_labels", "resolution_method", F.md5("model_input").alias("input_md5"), "split")


@query(
    f"""WITH {BLOCKS}, c AS (SELECT doc_id, block_index, similarity, left(text, 600) || chr(10) AS chunk FROM scored WHERE similarity >= 0.2),
    r AS (SELECT *, sum(length(chunk)) OVER (PARTITION BY doc_id ORDER BY similarity DESC, block_index ROWS UNBOUNDED PRECEDING) AS run FROM c)
    SELECT doc_id, md5(string_agg(chunk, '' ORDER BY similarity DESC, block_index)) AS body_md5 FROM r WHERE run <= 5000 GROUP BY doc_id"""
)
def local_bodies(spark, sf_dir):
    rows = scored_blocks(spark, sf_dir).select("doc_id", F.col("block_index").alias("section_index"), F.lit(None).cast("string").alias("title"), "text", F.col("similarity").alias("score"))
    return local.bodies(rows).select("doc_id", F.md5("body").alias("body_md5"))


@query(f"WITH {UNIFIED} SELECT doc_id, block_index, char_count FROM (SELECT *, row_number() OVER (ORDER BY block_index) AS n FROM chosen WHERE doc_id = 5) WHERE n <= 20")
def inspected(spark, sf_dir):
    blocks = scored_blocks(spark, sf_dir).filter("doc_id = 5").withColumns(
        {"doc_id": F.col("doc_id").cast("string"), "block_id": F.col("block_index").cast("string"), "section_path": F.array().cast("array<string>"), "block_type": F.lit("text")}
    )
    docs = read(spark, sf_dir, "documents").filter("doc_id = 5").select(F.col("doc_id").cast("string").alias("doc_id"))
    documents = retrieval.unified_documents(docs, retrieval.unified(blocks), retrieval.unified_stats(blocks))
    return retrieval.inspect(documents, "5").select(F.col("doc_id").cast("long").alias("doc_id"), "block_index", "char_count")


@query("SELECT doc_id, source, lang, 'none' AS label FROM documents")
def defaulted_columns(spark, sf_dir):
    """Columns that a table lacks get defaults, those it has stay; then a fixed order, optional ones only where they are."""
    rows = rel.with_defaults(read(spark, sf_dir, "documents"), {"lang": F.lit("unknown"), "label": F.lit("none")})
    rel.check_columns(rows, ("doc_id", "source", "lang", "label"))
    return rel.chosen_columns(rows, ("doc_id", "source"), ("lang", "label", "absent"))


@query(
    f"""WITH {SYSTEMS}, d AS (SELECT pmcids, round(n.overall - o.overall, 9) AS gain FROM scored_systems o JOIN scored_systems n USING (pmcids) WHERE o.s = 0 AND n.s = 1)
    SELECT pmcids, gain, row_number() OVER (ORDER BY gain DESC, pmcids) AS place FROM d"""
)
def gains(spark, sf_dir):
    """Every document's gain of one system over another, and its place, the greatest gain first."""
    deltas = analysis.compared(system_scores(spark, sf_dir, 0), system_scores(spark, sf_dir, 1), fields=("overall",))
    rows = deltas.select("pmcids", F.round("delta_overall", 9).alias("gain"))
    return rel.placed(rows, [F.desc("gain"), F.asc("pmcids")], "place")
