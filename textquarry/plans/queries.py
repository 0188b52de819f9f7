"""Registered queries over the driver's tables, and the same in DuckDB's SQL.

Stand-ins for model outputs are numbers from md5 of ids (``hashed``), so that both engines agree on them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import annotations as an
from ..functions import scores as sc
from ..functions.replies import EXTRACTION_PRICE, count_of, price, salvage
from ..functions.submission import article_id, conditions, criteria, id_order, listed
from ..functions.text import clean_ascii, mentions_age, normal_path, path_text, prior
from ..operators import generators as gen
from ..operators import relations as rel
from ..operators import selection as sel
from ..sources import pages as page_source
from . import analysis, retrieval

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hashed(key: Column, salt: str) -> Column:
    """A number in [0, 1) from 32 bits of md5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{salt}:"), key)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def hashed_sql(key: str, salt: str) -> str:
    return f"(CAST('0x' || substr(md5('{salt}:' || {key}), 1, 8) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE)"


def key_of(*columns: str) -> Column:
    return F.concat_ws(":", *[F.col(c).cast("string") for c in columns])


def scored_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = gen.line_blocks(read(spark, sf_dir, "documents"))
    return blocks.withColumn("similarity", hashed(key_of("doc_id", "block_index"), "sim"))


BLOCKS = r"""
raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS block_index FROM documents WHERE text IS NOT NULL),
blocks AS (SELECT * FROM (SELECT doc_id, block_index::INT AS block_index, trim(regexp_replace(line, '[ \t-\r]+', ' ', 'g')) AS text FROM raw) WHERE text <> ''),
scored AS (SELECT *, length(text)::INT AS char_count, """ + hashed_sql("doc_id || ':' || block_index", "sim") + """ AS similarity FROM blocks)
"""


@query(f"WITH {BLOCKS} SELECT doc_id, block_index, md5(text) AS text_md5, char_count FROM scored")
def blocks_explode(spark, sf_dir):
    return scored_blocks(spark, sf_dir).select("doc_id", "block_index", F.md5("text").alias("text_md5"), "char_count")


@query(
    f"WITH {BLOCKS} SELECT doc_id, doc_id || '::block_' || block_index AS block_id, lag(doc_id || '::block_' || block_index) OVER w AS prev_global_id,"
    " lead(doc_id || '::block_' || block_index) OVER w AS next_global_id FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY block_index)"
)
def block_links(spark, sf_dir):
    blocks = gen.line_blocks(read(spark, sf_dir, "documents")).withColumn("block_id", F.concat(F.col("doc_id").cast("string"), F.lit("::block_"), F.col("block_index").cast("string")))
    return rel.with_links(blocks, ["doc_id"], "block_index", "block_id", "prev_global_id", "next_global_id").select("doc_id", "block_id", "prev_global_id", "next_global_id")


@query(
    r"""SELECT lang, count(*) AS documents, sum(length(text))::BIGINT AS raw_chars, sum(length(trim(regexp_replace(text, '[ \t-\r]+', ' ', 'g'))))::BIGINT AS clean_chars
    FROM documents GROUP BY lang"""
)
def clean_text_stats(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return docs.groupBy("lang").agg(
        F.count(F.lit(1)).alias("documents"), F.sum(F.char_length("text").cast("long")).alias("raw_chars"), F.sum(F.char_length(clean_ascii(F.col("text"))).cast("long")).alias("clean_chars")
    )


SIMILAR = """
protos AS (SELECT embedding::DOUBLE[] AS p FROM embeddings WHERE vec_id IN (0, 1)),
sims AS (SELECT vec_id, label, round(max(list_sum(list_transform(list_zip(embedding::DOUBLE[], p), lambda x: x[1] * x[2]))), 6) AS similarity
  FROM embeddings, protos GROUP BY vec_id, label)
"""


def similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    found = gen.prototype_similarity(vectors, vectors.filter("vec_id IN (0, 1)"))
    return found.select("vec_id", "label", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {SIMILAR} SELECT label, rank::INT AS rank, vec_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id) AS rank FROM sims) WHERE rank <= 5")
def embed_topk_per_group(spark, sf_dir):
    return sel.top_k(similarities(spark, sf_dir), ["label"], "similarity", "vec_id", 5).select("label", "rank", "vec_id", "similarity")


PATHS = (
    ("Methods", "Study Design"), ("References",), ("Results", "Participants"), ("Acknowledgments",), ("Inclusion criteria", "Patients"),
    ("Ethical  approval",), ("Background",), ("Authors' contributions", "Supplementary data"),
)


def _prior_oracle() -> str:
    from ..functions.text import LOWERED, RAISED, SECTION_SPELLINGS

    path = "CASE vec_id % 8 " + " ".join("WHEN {} THEN '{}'".format(k, " > ".join(p).replace("'", "''")) for k, p in enumerate(PATHS)) + " END"
    text = f"trim(regexp_replace(lower({path}), '\\s+', ' ', 'g'))"
    for old, new in SECTION_SPELLINGS:
        text = "replace({}, '{}', '{}')".format(text, old.replace("'", "''"), new)
    up = ", ".join(f"CASE WHEN contains(path, '{t}') THEN {f}::DOUBLE ELSE 1.0::DOUBLE END" for t, f in RAISED["eligibility"].items())
    down = ", ".join(f"CASE WHEN contains(path, '{t}') THEN {f}::DOUBLE ELSE 1.0::DOUBLE END" for t, f in LOWERED.items())
    return f"""WITH {SIMILAR}, placed AS (SELECT *, {text} AS path FROM sims),
    final AS (SELECT label, vec_id, path, greatest({up}) * least({down}) AS metadata_multiplier, similarity FROM placed),
    ranked AS (SELECT *, round(similarity * metadata_multiplier, 6) AS final_score FROM final)
    SELECT label, rank::INT AS rank, vec_id, path, metadata_multiplier, final_score
    FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY final_score DESC, vec_id) AS rank FROM ranked) WHERE rank <= 40"""


@query(_prior_oracle())
def prior_rerank(spark, sf_dir):
    paths = F.array(*[F.array(*[F.lit(x) for x in p]) for p in PATHS])
    rows = similarities(spark, sf_dir).withColumn("path", normal_path(F.element_at(paths, (F.col("vec_id") % 8 + 1).cast("int"))))
    rows = rows.withColumn("metadata_multiplier", prior(F.col("path"), "eligibility")).withColumn("final_score", F.round(F.col("similarity") * F.col("metadata_multiplier"), 6))
    return sel.top_k(rows, ["label"], "final_score", "vec_id", 40).select("label", "rank", "vec_id", "path", "metadata_multiplier", "final_score")


UNIFIED = f"""
{BLOCKS},
budget AS (SELECT *, sum(char_count) OVER (PARTITION BY doc_id) AS total_chars, row_number() OVER r AS rk, sum(char_count) OVER (r ROWS UNBOUNDED PRECEDING) - char_count AS spent
  FROM scored WINDOW r AS (PARTITION BY doc_id ORDER BY similarity DESC, block_index)),
chosen AS (SELECT * FROM budget WHERE spent < greatest(1, ceil(0.3::DOUBLE * total_chars)) OR rk <= 8),
stats AS (SELECT doc_id, any_value(num_blocks)::BIGINT AS num_blocks, any_value(total_chars)::BIGINT AS total_chars, count(*) AS num_candidates, sum(char_count)::BIGINT AS selected_chars,
    max(similarity) AS top_score, min(similarity) AS lowest_selected_score
  FROM chosen JOIN (SELECT doc_id, count(*) AS num_blocks FROM scored GROUP BY doc_id) USING (doc_id) GROUP BY doc_id)
"""


@query(
    f"WITH {UNIFIED} SELECT doc_id, num_blocks, num_candidates, total_chars, ceil(0.3::DOUBLE * total_chars)::BIGINT AS target_chars, selected_chars,"
    " selected_chars / total_chars::DOUBLE AS selected_char_fraction, top_score, lowest_selected_score FROM stats"
)
def unified_prefix(spark, sf_dir):
    blocks = scored_blocks(spark, sf_dir)
    stats = retrieval.unified_stats(blocks)
    columns = ("doc_id", "num_blocks", "num_candidates", "total_chars", "target_chars", "selected_chars", "selected_char_fraction", "top_score", "lowest_selected_score")
    return stats.select(*columns)


@query(f"WITH {UNIFIED} SELECT doc_id, block_index, rk::INT AS rank, char_count FROM chosen")
def unified_blocks(spark, sf_dir):
    return retrieval.unified(scored_blocks(spark, sf_dir)).select("doc_id", "block_index", "rank", "char_count")


@query(
    f"""WITH {UNIFIED}, s AS (SELECT *, selected_chars / total_chars::DOUBLE AS f FROM stats)
    SELECT count(*) AS documents, round(avg(num_blocks), 6) AS mean_num_blocks, median(num_blocks)::DOUBLE AS median_num_blocks, max(num_candidates) AS most_num_candidates,
    round(avg(f), 6) AS mean_fraction, round(median(f), 6) AS median_fraction, count_if(selected_chars < ceil(0.3::DOUBLE * total_chars))::BIGINT AS below_target FROM s"""
)
def unified_run_stats(spark, sf_dir):
    blocks = scored_blocks(spark, sf_dir)
    s = retrieval.run_stats(retrieval.unified_stats(blocks))
    return s.select(
        "documents", F.round("mean_num_blocks", 6).alias("mean_num_blocks"), "median_num_blocks", "most_num_candidates",
        F.round("mean_selected_char_fraction", 6).alias("mean_fraction"), F.round("median_selected_char_fraction", 6).alias("median_fraction"), "below_target",
    )


@query(
    f"""WITH RECURSIVE {BLOCKS},
    cand AS (SELECT doc_id, rk, block_index, char_count::BIGINT AS chars, similarity FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, block_index) AS rk FROM scored) WHERE rk <= 40),
    walk AS (
      SELECT doc_id, 0::BIGINT AS rk, 0.0::DOUBLE AS score, 0::BIGINT AS chars, 0::BIGINT AS n, false AS done, ''::VARCHAR AS taken FROM (SELECT DISTINCT doc_id FROM cand)
      UNION ALL
      SELECT w.doc_id, c.rk, CASE WHEN t THEN w.score + c.similarity ELSE w.score END, CASE WHEN t THEN w.chars + c.chars ELSE w.chars END, w.n + t::BIGINT,
        w.done OR (t AND w.score + c.similarity >= 2.5 AND w.chars + c.chars >= 3000), CASE WHEN t THEN w.taken || ',' || c.block_index ELSE w.taken END
      FROM (SELECT w.*, c.rk AS crk FROM walk w JOIN cand c ON w.doc_id = c.doc_id AND c.rk = w.rk + 1) w
      JOIN cand c ON c.doc_id = w.doc_id AND c.rk = w.crk, LATERAL (SELECT NOT w.done AND (w.chars + c.chars <= 8000 OR w.n = 0) AS t))
    SELECT doc_id, max_by(n, rk) AS n_taken, max_by(chars, rk) AS taken_chars, substr(max_by(taken, rk), 2) AS taken FROM walk GROUP BY doc_id"""
)
def greedy_pack(spark, sf_dir):
    best = sel.top_k(scored_blocks(spark, sf_dir), ["doc_id"], "similarity", "block_index", 40)
    packs = sel.pack(best, ["doc_id"], "similarity", "block_index", "block_index", "char_count", F.lit(2.5), F.lit(3000), F.lit(8000))
    total = F.aggregate("taken", F.lit(0).cast("long"), lambda s, x: s + x["chars"])
    ids = F.array_join(F.transform("taken", lambda x: x["id"].cast("string")), ",")
    return packs.select("doc_id", F.size("taken").cast("long").alias("n_taken"), total.alias("taken_chars"), ids.alias("taken"))


@query(
    f"WITH {BLOCKS} SELECT doc_id, block_index, running_chars::BIGINT AS running_chars FROM (SELECT *, sum(least(char_count, 600) + 1) OVER (PARTITION BY doc_id ORDER BY similarity DESC, block_index"
    " ROWS UNBOUNDED PRECEDING) AS running_chars FROM scored WHERE similarity >= 0.2) WHERE running_chars <= 5000"
)
def prefix_overflow(spark, sf_dir):
    blocks = scored_blocks(spark, sf_dir).filter(F.col("similarity") >= sel.SECTION_THRESHOLD)
    blocks = blocks.withColumn("chunk_chars", F.least("char_count", F.lit(sel.SECTION_CHARS)) + 1)
    return sel.prefix_to_overflow(blocks, ["doc_id"], "similarity", "block_index", "chunk_chars").select("doc_id", "block_index", "running_chars")


ROUTED = f"""
{BLOCKS},
p AS (SELECT doc_id, block_index, text, field, thr, mn, pow({hashed_sql("doc_id || ':' || block_index || ':' || field", "p")}, 4) AS p
  FROM scored, (VALUES ('condition_study_type', 0.33::DOUBLE, 2), ('demographics', 0.03::DOUBLE, 2), ('eligibility', 0.05::DOUBLE, 3)) v(field, thr, mn)),
routed AS (SELECT *, p >= thr AS above FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, field ORDER BY p DESC, block_index) AS rk FROM p) WHERE p >= thr OR rk <= mn)
"""


def routed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = F.explode(F.array(*[F.lit(f) for f in sel.FIELDS]))
    rows = scored_blocks(spark, sf_dir).withColumn("field", fields)
    rows = rows.withColumn("p", F.pow(hashed(key_of("doc_id", "block_index", "field"), "p"), F.lit(4))).drop("text")
    return sel.route(rows, ["doc_id", "field"], "p", "block_index", sel.by_field(sel.THRESHOLDS, F.col("field")), sel.by_field(sel.FALLBACK_BLOCKS, F.col("field")))


def routed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routed blocks with their texts, joined after the ranking."""
    return routed_blocks(spark, sf_dir).join(scored_blocks(spark, sf_dir).select("doc_id", "block_index", "text"), ["doc_id", "block_index"])


@query(f"WITH {ROUTED} SELECT doc_id, field, block_index, above, round(p, 9) AS p FROM routed")
def route_threshold_fallback(spark, sf_dir):
    return routed_blocks(spark, sf_dir).select("doc_id", "field", "block_index", "above", F.round("p", 9).alias("p"))


@query(
    f"WITH {ROUTED} SELECT doc_id, count_if(field = 'condition_study_type')::BIGINT AS condition_study_type, count_if(field = 'demographics')::BIGINT AS demographics,"
    " count_if(field = 'eligibility')::BIGINT AS eligibility FROM routed GROUP BY doc_id"
)
def field_block_counts(spark, sf_dir):
    return routed_blocks(spark, sf_dir).groupBy("doc_id").pivot("field", list(sel.FIELDS)).count().fillna(0)


@query(
    f"WITH {ROUTED} SELECT doc_id, field, md5(string_agg('Section: ' || chr(10) || text || chr(10), chr(10) || chr(10) ORDER BY block_index)) AS context_md5 FROM routed GROUP BY doc_id, field"
)
def context_concat(spark, sf_dir):
    piece = F.concat(F.lit("Section: \n"), F.col("text"), F.lit("\n"))
    lists = routed_texts(spark, sf_dir).groupBy("doc_id", "field").agg(F.array_sort(F.collect_list(F.struct("block_index", piece.alias("piece")))).alias("l"))
    return lists.select("doc_id", "field", F.md5(F.array_join(F.transform("l", lambda x: x["piece"]), "\n\n")).alias("context_md5"))


@query(
    f"""WITH RECURSIVE {BLOCKS},
    cand AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY block_index) AS rk, text FROM scored),
    walk AS (
      SELECT doc_id, 1::BIGINT AS rk, CASE WHEN length(text) <= 300 THEN text ELSE rtrim(left(text, 300)) END AS t, false AS stopped FROM cand WHERE rk = 1
      UNION ALL
      SELECT w.doc_id, c.rk, CASE WHEN 300 - length(w.t) - 2 <= 0 THEN w.t WHEN length(c.text) <= 300 - length(w.t) - 2 THEN w.t || chr(10) || chr(10) || c.text
        ELSE w.t || chr(10) || chr(10) || rtrim(left(c.text, 300 - length(w.t) - 2)) END, 300 - length(w.t) - 2 <= 0
      FROM walk w JOIN cand c ON c.doc_id = w.doc_id AND c.rk = w.rk + 1 WHERE NOT w.stopped)
    SELECT doc_id, max_by(length(t), rk)::INT AS context_chars, md5(max_by(t, rk)) AS context_md5 FROM walk GROUP BY doc_id"""
)
def truncating_concat(spark, sf_dir):
    lists = scored_blocks(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("block_index", "text"))).alias("l"))
    text = sel.truncated_concat(F.transform("l", lambda x: x["text"]), 300)
    return lists.select("doc_id", F.char_length(text).alias("context_chars"), F.md5(text).alias("context_md5"))


# Annotations: two annotators' labels stand in from the table of labels.

ANNOTATED = """
annotated AS (
  SELECT doc_id, doc_id::VARCHAR AS sample_id, l[1 + ((quality + doc_id) % 4)::INT] AS haiku_label, l[1 + ((toxic + doc_id * 7) % 4)::INT] AS gemini_label,
    CASE WHEN doc_id % 11 = 0 THEN 'n/a' ELSE (1 + doc_id % 5)::VARCHAR END AS haiku_overall_relevance, (1 + (doc_id * 3) % 5)::VARCHAR AS gemini_overall_relevance,
    CASE WHEN doc_id % 17 = 0 THEN 'timeout' ELSE '' END AS haiku_error, CASE WHEN doc_id % 2 = 0 THEN NULL ELSE '' END AS gemini_error
  FROM labels, (SELECT ['Condition & Study Type', 'Demographics', 'Eligibility Criteria', 'No Useful Evidence'] AS l))
"""


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in an.LABELS])
    at = lambda n: F.element_at(names, (n % 4 + 1).cast("int"))
    i = F.col("doc_id")
    return read(spark, sf_dir, "labels").select(
        "doc_id",
        i.cast("string").alias("sample_id"),
        at(F.col("quality") + i).alias("haiku_label"),
        at(F.col("toxic") + i * 7).alias("gemini_label"),
        F.when(i % 11 == 0, "n/a").otherwise((1 + i % 5).cast("string")).alias("haiku_overall_relevance"),
        (1 + (i * 3) % 5).cast("string").alias("gemini_overall_relevance"),
        F.when(i % 17 == 0, "timeout").otherwise("").alias("haiku_error"),
        F.when(i % 2 == 0, None).otherwise("").alias("gemini_error"),
    )


COMPARED = f"""
{ANNOTATED},
compared AS (SELECT *, haiku_label = gemini_label AS models_agree, haiku_label <> gemini_label AS label_disagreement,
  abs(TRY_CAST(haiku_overall_relevance AS DOUBLE) - TRY_CAST(gemini_overall_relevance AS DOUBLE)) AS relevance_difference FROM annotated),
reviewed AS (SELECT *, label_disagreement OR coalesce(relevance_difference >= 2, false) OR haiku_error <> '' OR coalesce(gemini_error, '') <> '' AS needs_review FROM compared)
"""


@query(f"WITH {COMPARED} SELECT sample_id, models_agree, label_disagreement, relevance_difference, needs_review FROM reviewed")
def label_compare(spark, sf_dir):
    return an.with_comparison(annotated(spark, sf_dir)).select("sample_id", "models_agree", "label_disagreement", "relevance_difference", "needs_review")


@query(f"WITH {COMPARED} SELECT count(*) AS rows, count(*) AS both_valid, round(avg(models_agree::INT), 9) AS agreement_rate, count_if(needs_review)::BIGINT AS needs_review FROM reviewed")
def agreement_summary(spark, sf_dir):
    from .labelling import summary

    return summary(an.with_comparison(annotated(spark, sf_dir))).withColumn("agreement_rate", F.round("agreement_rate", 9))


RESOLVED = f"""
{ANNOTATED},
pos AS (SELECT *, CASE WHEN haiku_label = gemini_label THEN (CASE WHEN haiku_label = 'No Useful Evidence' THEN [] ELSE [haiku_label] END)
  ELSE list_filter(['Condition & Study Type', 'Demographics', 'Eligibility Criteria'], lambda x: x = haiku_label OR x = gemini_label) END AS ls FROM annotated),
resolved AS (SELECT doc_id, sample_id, haiku_label, gemini_label,
  CASE WHEN haiku_label = 'No Useful Evidence' AND gemini_label = haiku_label THEN 'both_no_useful_evidence' WHEN gemini_label = 'No Useful Evidence' THEN 'kept_haiku_useful_label'
    WHEN haiku_label = 'No Useful Evidence' THEN 'kept_gemini_useful_label' WHEN haiku_label = gemini_label THEN 'agreed_useful_label' ELSE 'combined_two_useful_labels' END AS resolution_method,
  CASE WHEN len(ls) = 0 THEN 'No Useful Evidence' ELSE array_to_string(ls, ' | ') END AS final_labels,
  CASE WHEN len(ls) = 0 THEN '[]' ELSE '["' || array_to_string(ls, '", "') || '"]' END AS final_labels_json, len(ls)::INT AS number_of_positive_labels,
  (len(ls) > 1)::INT AS is_multilabel, (len(ls) = 0)::INT AS is_no_useful_evidence, list_contains(ls, 'Condition & Study Type')::INT AS target_condition_study_type,
  list_contains(ls, 'Demographics')::INT AS target_demographics, list_contains(ls, 'Eligibility Criteria')::INT AS target_eligibility_criteria FROM pos)
"""
RESOLVED_COLUMNS = (
    "sample_id", "resolution_method", "final_labels", "final_labels_json", "number_of_positive_labels", "is_multilabel", "is_no_useful_evidence", *an.TARGETS.values()
)


@query(f"WITH {RESOLVED} SELECT {', '.join(RESOLVED_COLUMNS)} FROM resolved")
def label_resolve(spark, sf_dir):
    return an.with_targets(annotated(spark, sf_dir)).select(*RESOLVED_COLUMNS)


@query(f"WITH {RESOLVED} SELECT resolution_method, count(*) AS count FROM resolved GROUP BY resolution_method")
def resolution_counts(spark, sf_dir):
    return an.with_targets(annotated(spark, sf_dir)).groupBy("resolution_method").count()


@query(
    f"""WITH {ANNOTATED}, names AS (SELECT unnest(['Condition & Study Type', 'Demographics', 'Eligibility Criteria', 'No Useful Evidence']) AS n),
    grid AS (SELECT a.n AS a, b.n AS b FROM names a, names b WHERE a.n <> b.n), counts AS (SELECT haiku_label AS a, gemini_label AS b, count(*) AS c FROM annotated GROUP BY 1, 2),
    g AS (SELECT grid.a, grid.b, coalesce(c, 0) AS c, sum(coalesce(c, 0)) OVER () AS total FROM grid LEFT JOIN counts USING (a, b))
    SELECT a || ' → ' || b AS combination, a AS haiku_label, b AS gemini_label, c AS count,
      CASE WHEN total > 0 THEN round_even(c / total::DOUBLE * 100, 2) ELSE 0.0 END AS percentage_of_disagreements FROM g"""
)
def disagreement_matrix(spark, sf_dir):
    from .labelling import disagreements

    return disagreements(annotated(spark, sf_dir))


SPLIT = """
groups AS (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL),
ranked AS (SELECT source, row_number() OVER (ORDER BY md5(source || ':42'), source) AS rk, count(*) OVER () AS n FROM groups),
dealt AS (SELECT source, CASE WHEN rk <= floor(0.8::DOUBLE * n) THEN 'train' WHEN rk <= floor(0.8::DOUBLE * n) + floor(0.5::DOUBLE * (n - floor(0.8::DOUBLE * n))) THEN 'validation' ELSE 'test' END AS split FROM ranked)
"""


@query(f"WITH {SPLIT} SELECT doc_id, source, split FROM documents JOIN dealt USING (source)")
def group_split(spark, sf_dir):
    return rel.group_split(read(spark, sf_dir, "documents").select("doc_id", "source"), "source")


@query(f"WITH {SPLIT} SELECT split, count(*) AS rows, count(DISTINCT source) AS groups, sum(n_chars)::BIGINT AS n_chars FROM documents JOIN dealt USING (source) GROUP BY split")
def split_summary(spark, sf_dir):
    return rel.split_summary(rel.group_split(read(spark, sf_dir, "documents").select("source", "n_chars"), "source"), "source", ("n_chars",))


@query(f"WITH {SPLIT} SELECT source, count(DISTINCT split) AS splits FROM documents JOIN dealt USING (source) GROUP BY source HAVING count(DISTINCT split) > 1")
def leaking_groups(spark, sf_dir):
    return rel.leaking_groups(rel.group_split(read(spark, sf_dir, "documents").select("source"), "source"), "source")


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def resume_antijoin(spark, sf_dir):
    return rel.remaining(read(spark, sf_dir, "documents").select("doc_id", "lang"), read(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id, md5(doc_id::VARCHAR || ':42') AS h FROM documents ORDER BY 2, 1 LIMIT 41")
def seeded_sample(spark, sf_dir):
    rows = rel.seeded_sample(read(spark, sf_dir, "documents").select("doc_id"), "doc_id", 41)
    return rows.withColumn("h", F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":42"))))


@query(
    """SELECT event_type, count(*) AS calls, sum(tin)::BIGINT AS input_tokens, round(sum(coalesce(TRY_CAST(raw AS DOUBLE), 0)), 4) AS output_tokens,
    round(sum(tin / 1000000.0::DOUBLE * 3.0 + (event_id % 300) / 1000000.0::DOUBLE * 15.0), 6) AS cost_usd
    FROM (SELECT *, event_id % 1000 AS tin, CASE WHEN event_id % 7 = 0 THEN 'n/a' ELSE (event_id % 300)::VARCHAR END AS raw FROM events) GROUP BY event_type"""
)
def cost_summary(spark, sf_dir):
    i = F.col("event_id")
    calls = read(spark, sf_dir, "events").select("event_type", (i % 1000).alias("tin"), (i % 300).alias("tout"), F.when(i % 7 == 0, "n/a").otherwise((i % 300).cast("string")).alias("raw"))
    return calls.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("tin").alias("input_tokens"),
        F.round(F.sum(count_of(F.col("raw"))), 4).alias("output_tokens"),
        F.round(F.sum(price(F.col("tin"), F.col("tout"), EXTRACTION_PRICE)), 6).alias("cost_usd"),
    )


UNITS_SQL = "[" + ", ".join(f"'{w}'" for w in sc.UNITS) + "]"
TENS_SQL = "[" + ", ".join(f"'{w}'" for w in sc.TENS) + "]"
#: Distinct numbers of a text, in digits and in runs of up to five words below a hundred.
NUMBERS = (
    r"list_distinct(list_concat(list_transform(regexp_extract_all({0}, '\b\d+(?:\.\d+)?\b'), lambda x: x::DOUBLE), "
    r"list_filter(list_transform(flatten(list_transform(range(1, 6), lambda k: list_transform(range(1, len(string_split_regex(lower(trim({0})), '\s+')) - k + 2), "
    r"lambda i: list_transform(string_split_regex(lower(trim({0})), '\s+')[i:i + k - 1], lambda w: CASE WHEN list_contains(UNITS, trim(w, '.,;:()')) THEN list_position(UNITS, trim(w, '.,;:()')) - 1 "
    r"WHEN list_contains(TENS, trim(w, '.,;:()')) THEN 10 * (list_position(TENS, trim(w, '.,;:()')) + 1) ELSE -1000000 END)))), lambda l: list_sum(l)::DOUBLE), lambda x: x >= 0)))"
).replace("UNITS", UNITS_SQL).replace("TENS", TENS_SQL)
SET_SIMILARITY = "CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0::DOUBLE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(a, b)) / greatest(len(a), len(b))::DOUBLE END"


@query(
    f"""WITH t AS (SELECT p_partkey, {NUMBERS.format("p_name || ' ' || CASE WHEN p_partkey % 4 = 0 THEN '18 Years' ELSE p_size || ' to ' || (p_size + p_partkey % 3) || ' or 25' END")} AS a, {NUMBERS.format("CASE WHEN p_partkey % 4 = 0 THEN 'eighteen years old' WHEN p_partkey % 4 = 1 THEN 'Twenty five to sixty, or ' || p_size ELSE p_size || ' years' END")} AS b FROM part)
    SELECT p_partkey, {SET_SIMILARITY} AS similarity FROM t"""
)
def number_similarity(spark, sf_dir):
    size, turn = F.col("p_size").cast("string"), F.col("p_partkey") % 4
    span = F.concat(size, F.lit(" to "), (F.col("p_size") + F.col("p_partkey") % 3).cast("string"), F.lit(" or 25"))
    text = F.concat("p_name", F.lit(" "), F.when(turn == 0, "18 Years").otherwise(span))
    gold = F.when(turn == 0, "eighteen years old").when(turn == 1, F.concat(F.lit("Twenty five to sixty, or "), size)).otherwise(F.concat(size, F.lit(" years")))
    return read(spark, sf_dir, "part").select("p_partkey", sc.number_similarity(text, gold).alias("similarity"))


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = read(spark, sf_dir, "conversations").withColumn("before", F.lag("text").over(w)).filter("before IS NOT NULL")
    return turns.select("conv_id", "turn", sc.words(F.col("before"), sc.SCORED_CHARS).alias("a"), sc.words(F.col("text"), sc.SCORED_CHARS).alias("b"))


ALL_WORDS = r"list_filter(string_split_regex(lower({}), '[^\p{{L}}]+'), lambda x: x <> '')"
WORDS = r"list_filter(string_split_regex(lower(left({}, 1000)), '[^\p{{L}}]+'), lambda x: x <> '')"
OVERLAP = f"""
turns AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
w AS (SELECT conv_id, turn, {WORDS.format("before")} AS a, {WORDS.format("text")} AS b FROM turns WHERE before IS NOT NULL),
g AS (SELECT *, list_transform(list_zip(a[1:len(a)-1], a[2:len(a)]), lambda x: x[1] || ' ' || x[2]) AS ba, list_transform(list_zip(b[1:len(b)-1], b[2:len(b)]), lambda x: x[1] || ' ' || x[2]) AS bb FROM w),
overlap AS (SELECT conv_id, turn, CASE WHEN len(a) > 0 AND len(b) > 0 THEN 0.6::DOUBLE * (len(list_intersect(a, b)) / greatest(len(list_distinct(a)), len(list_distinct(b)))::DOUBLE)
  + 0.4::DOUBLE * (len(list_intersect(ba, bb)) / greatest(len(ba), len(bb), 1)::DOUBLE) ELSE 0.0::DOUBLE END AS overlap FROM g)
"""


@query(f"WITH {OVERLAP} SELECT conv_id, turn, round(overlap, 9) AS overlap FROM overlap")
def word_overlap(spark, sf_dir):
    return turn_pairs(spark, sf_dir).select("conv_id", "turn", F.round(sc.word_order_overlap(F.col("a"), F.col("b")), 9).alias("overlap"))


SYSTEMS = """
gold AS (SELECT doc_id AS pmcids, CASE WHEN quality = 1 THEN '18 Years' ELSE 'Not Specified' END AS minimum_age, CASE WHEN toxic = 1 THEN '65 Years' ELSE 'Not Specified' END AS maximum_age FROM labels),
systems AS (SELECT doc_id AS pmcids, s, CASE (doc_id + s) % 3 WHEN 0 THEN 'Not Specified' WHEN 1 THEN '18 Years' ELSE 'eighteen years old' END AS minimum_age, CASE WHEN (doc_id * (s + 2)) % 5 < 2 THEN '60 to 65 years' ELSE 'Not Specified' END AS maximum_age
  FROM labels, (VALUES (0), (1)) v(s)),
sets AS (SELECT s, pmcids, """ + NUMBERS.format("p.minimum_age") + " AS a1, " + NUMBERS.format("g.minimum_age") + " AS b1, " + NUMBERS.format("p.maximum_age") + " AS a2, " + NUMBERS.format("g.maximum_age") + """ AS b2
  FROM systems p JOIN gold g USING (pmcids)),
scored_systems AS (SELECT s, pmcids, s1, s2, 0.05 * 1.0 + 0.10 * s1 + 0.10 * s2 AS overall FROM (SELECT s, pmcids, """ + SET_SIMILARITY.replace("(a", "(a1").replace("(b", "(b1").replace(", b", ", b1") + " AS s1, " + SET_SIMILARITY.replace("(a", "(a2").replace("(b", "(b2").replace(", b", ", b2") + """ AS s2 FROM sets))
"""


def system(spark: SparkSession, sf_dir: str, s: int) -> DataFrame:
    i = F.col("doc_id")
    low = F.when((i + s) % 3 == 0, "Not Specified").when((i + s) % 3 == 1, "18 Years").otherwise("eighteen years old")
    high = F.when((i * (s + 2)) % 5 < 2, "60 to 65 years").otherwise("Not Specified")
    none = F.lit("Not Specified")
    return read(spark, sf_dir, "labels").select(
        i.alias("pmcids"), none.alias("conditions"), none.alias("study_type"), none.alias("sex"), low.alias("minimum_age"), high.alias("maximum_age"), none.alias("eligibility_criteria")
    )


def system_scores(spark: SparkSession, sf_dir: str, s: int) -> DataFrame:
    none = F.lit("Not Specified")
    low, high = F.when(F.col("quality") == 1, "18 Years").otherwise(none), F.when(F.col("toxic") == 1, "65 Years").otherwise(none)
    gold = read(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("pmcids"), none.alias("conditions"), none.alias("study_type"), none.alias("sex"), low.alias("minimum_age"), high.alias("maximum_age"), none.alias("eligibility_criteria")
    )
    return analysis.scores(analysis.paired(system(spark, sf_dir, s), gold))


@query(f"WITH {SYSTEMS} SELECT pmcids, s1 AS score_minimum_age, s2 AS score_maximum_age, round(overall, 9) AS score_overall FROM scored_systems WHERE s = 0")
def composite_score(spark, sf_dir):
    return system_scores(spark, sf_dir, 0).select("pmcids", "score_minimum_age", "score_maximum_age", F.round("score_overall", 9).alias("score_overall"))


@query(f"WITH {SYSTEMS} SELECT round(avg(s1), 9) AS minimum_age, round(avg(s2), 9) AS maximum_age, round(avg(overall), 9) AS overall FROM scored_systems WHERE s = 0")
def mean_scores(spark, sf_dir):
    means = analysis.mean_scores(system_scores(spark, sf_dir, 0))
    return means.select(*[F.round(c, 9).alias(c) for c in ("minimum_age", "maximum_age", "overall")])


@query(f"WITH {SYSTEMS} SELECT pmcids, round(overall, 9) AS score_overall FROM scored_systems WHERE s = 0 ORDER BY round(overall, 9), pmcids LIMIT 10")
def worst_k(spark, sf_dir):
    rows = system_scores(spark, sf_dir, 0).withColumn("score_overall", F.round("score_overall", 9))
    return analysis.drill_down(rows).select("pmcids", "score_overall")


@query(
    f"""WITH {SYSTEMS}, d AS (SELECT n.overall - o.overall AS d, n.s1 - o.s1 AS d1 FROM scored_systems o JOIN scored_systems n USING (pmcids) WHERE o.s = 0 AND n.s = 1)
    SELECT count_if(round(d, 9) > 0)::BIGINT AS wins, count_if(round(d, 9) = 0)::BIGINT AS ties, count_if(round(d, 9) < 0)::BIGINT AS losses, round(avg(d), 9) AS mean_delta_overall, round(avg(d1), 9) AS mean_delta_minimum_age FROM d"""
)
def pairwise_compare(spark, sf_dir):
    deltas = analysis.compared(system_scores(spark, sf_dir, 0), system_scores(spark, sf_dir, 1), fields=("minimum_age", "overall"))
    out = analysis.verdicts(deltas.withColumn("rounded", F.round("delta_overall", 9)), "rounded")
    return out.select("wins", "ties", "losses", F.round("mean_delta_overall", 9).alias("mean_delta_overall"), F.round("mean_delta_minimum_age", 9).alias("mean_delta_minimum_age"))


@query(
    """SELECT count(n_chars) AS n, round(avg(n_chars), 6) AS mean, min(n_chars) AS least, max(n_chars) AS most, """
    + ", ".join(f"round(quantile_cont(n_chars, {p}), 6) AS p{round(100 * p):02d}" for p in (0.25, 0.5, 0.75, 0.9, 0.95, 0.99))
    + " FROM documents"
)
def length_profile(spark, sf_dir):
    out = rel.profile(read(spark, sf_dir, "documents"), "n_chars")
    return out.select("n", F.round("mean", 6).alias("mean"), "least", "most", *[F.round(c, 6).alias(c) for c in out.columns if c[0] == "p"])


@query(
    """WITH e AS (SELECT min(n_chars)::DOUBLE AS lo, max(n_chars)::DOUBLE AS hi FROM documents),
    b AS (SELECT least(floor((n_chars - lo) / ((hi - lo) / 30)), 29)::INT AS bin, count(*) AS c FROM documents, e GROUP BY 1)
    SELECT g.bin::INT AS bin, round(lo + g.bin * ((hi - lo) / 30), 6) AS low, round(lo + (g.bin + 1) * ((hi - lo) / 30), 6) AS high, coalesce(c, 0) AS count
    FROM (SELECT unnest(range(30)) AS bin) g CROSS JOIN e LEFT JOIN b USING (bin)"""
)
def length_histogram(spark, sf_dir):
    out = rel.histogram(read(spark, sf_dir, "documents").select("n_chars"), "n_chars", 30)
    return out.select("bin", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "count")


@query(
    """WITH b AS (SELECT n_chars, CASE WHEN n_chars <= 20000 THEN n_chars ELSE least(20000, floor(0.5::DOUBLE * n_chars)) END::BIGINT AS budget,
    CASE WHEN n_chars <= 20000 THEN 'full' WHEN floor(0.5::DOUBLE * n_chars) >= 20000 THEN 'capped' ELSE 'adaptive' END AS kind FROM documents)
    SELECT kind AS budget_kind, count(*) AS documents, sum(budget)::BIGINT AS budget_chars, round(avg(CASE WHEN n_chars > 0 THEN budget / n_chars::DOUBLE ELSE 0 END), 9) AS mean_coverage FROM b GROUP BY kind"""
)
def budget_policy(spark, sf_dir):
    rows = analysis.budget_policy(read(spark, sf_dir, "documents").select("n_chars"), "n_chars")
    return rows.groupBy("budget_kind").agg(F.count(F.lit(1)).alias("documents"), F.sum("budget_chars").alias("budget_chars"), F.round(F.avg("coverage"), 9).alias("mean_coverage"))


THRESHOLDS = tuple(0.10 + 0.05 * k for k in range(15))
SWEEP = f"""
answers AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'minimum' ELSE 'maximum' END AS bound, CASE WHEN quality = 1 THEN '18 Years' ELSE 'Not Specified' END AS gold, '18 Years' AS answer,
  {hashed_sql("doc_id::VARCHAR", "qa")} AS score FROM labels),
sweep AS (SELECT bound, threshold, avg((CASE WHEN score > threshold THEN answer ELSE 'Not Specified' END = gold)::INT) AS accuracy
  FROM answers, (SELECT unnest([{", ".join(f"{t!r}::DOUBLE" for t in THRESHOLDS)}]) AS threshold) GROUP BY bound, threshold)
"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = F.when(F.col("quality") == 1, "18 Years").otherwise("Not Specified")
    bound = F.when(F.col("doc_id") % 2 == 0, "minimum").otherwise("maximum")
    return read(spark, sf_dir, "labels").select(bound.alias("bound"), gold.alias("gold"), F.lit("18 Years").alias("answer"), hashed(F.col("doc_id").cast("string"), "qa").alias("score"))


@query(f"WITH {SWEEP} SELECT bound, round(threshold, 6) AS threshold, round(accuracy, 9) AS accuracy FROM sweep")
def threshold_sweep(spark, sf_dir):
    rows = rel.threshold_sweep(answers(spark, sf_dir), "bound", "answer", "score", "gold", THRESHOLDS, "Not Specified")
    return rows.select("bound", F.round("threshold", 6).alias("threshold"), F.round("accuracy", 9).alias("accuracy"))


@query(f"WITH {SWEEP} SELECT bound, round(threshold, 6) AS threshold, round(accuracy, 9) AS accuracy FROM (SELECT *, row_number() OVER (PARTITION BY bound ORDER BY accuracy DESC, threshold) AS n FROM sweep) WHERE n = 1")
def best_threshold(spark, sf_dir):
    rows = rel.best_threshold(rel.threshold_sweep(answers(spark, sf_dir), "bound", "answer", "score", "gold", THRESHOLDS, "Not Specified"), "bound")
    return rows.select("bound", F.round("threshold", 6).alias("threshold"), F.round("accuracy", 9).alias("accuracy"))


ITEMS = r"""
items AS (SELECT p_partkey, list_filter(list_transform(string_split_regex(trim(t), '\s*(?:;|\n|•|\*)\s*'), lambda x: trim(regexp_replace(trim(x), '^[- ]+', ''))), lambda x: x <> '') AS l
  FROM (SELECT p_partkey, p_name || '; - ' || p_brand || ';* ' || p_type || '. ;' AS t FROM part))
"""


def item_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("p_name", F.lit("; - "), "p_brand", F.lit(";* "), "p_type", F.lit(". ;"))
    return read(spark, sf_dir, "part").select("p_partkey", listed(text).alias("items"))


@query(
    f"WITH {ITEMS} SELECT p_partkey, 'Inclusion Criteria: ' || array_to_string(list_transform(list_filter(list_transform(l, lambda x: rtrim(x, ' ;.')), lambda x: x <> ''), lambda x: '* ' || x), '; ') || '.' AS criteria,"
    " '[' || array_to_string(list_transform(l, lambda x: '''' || x || ''''), ', ') || ']' AS conditions FROM items"
)
def criteria_format(spark, sf_dir):
    return item_lists(spark, sf_dir).select("p_partkey", criteria("Inclusion Criteria", F.col("items")).alias("criteria"), conditions(F.col("items")).alias("conditions"))


@query(
    r"""WITH t AS (SELECT page_id, CASE WHEN regexp_matches(url, '\d') THEN regexp_extract(trim(url), '(?i)(?:PMC)?(\d+)', 1) ELSE trim(url) END AS article FROM pages)
    SELECT page_id, article, row_number() OVER (ORDER BY TRY_CAST(article AS DECIMAL(38, 0)) NULLS LAST, article, page_id) AS place FROM t"""
)
def article_order(spark, sf_dir):
    rows = read(spark, sf_dir, "pages").select("page_id", article_id(F.col("url")).alias("article"))
    return rel.placed(rows, [*id_order(F.col("article")), F.col("page_id").asc_nulls_first()], "place")


@query(
    """SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE TRY_CAST(json_extract_string(props, '$.' || k) AS VARCHAR) END AS value
    FROM events, (SELECT json_keys(props)[1] AS k FROM events WHERE props IS NOT NULL ORDER BY event_id LIMIT 1)"""
)
def json_salvage(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    first = events.filter("props IS NOT NULL").orderBy("event_id").select(F.json_object_keys("props")[0]).first()
    i = F.col("event_id") % 3
    reply = F.when(i == 0, F.col("props")).when(i == 1, F.concat(F.lit("Here it is: "), "props", F.lit(" as asked."))).otherwise(F.lit("no braces"))
    return events.select("event_id", salvage(reply, f"{first[0] if first else 'none'} string")[first[0] if first else "none"].alias("value"))


TAGS = """
tags AS (SELECT user_id, event_id, CASE event_id % 5 WHEN 0 THEN 'B' WHEN 1 THEN 'I' WHEN 2 THEN 'I' WHEN 3 THEN 'O' ELSE 'DISEASE' END AS tag, event_type AS token FROM events),
isl AS (SELECT *, sum(CASE WHEN tag = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS island FROM tags WHERE tag <> 'DISEASE'),
heads AS (SELECT *, first_value(tag) OVER (PARTITION BY user_id, island ORDER BY event_id) AS head FROM isl),
spans AS (SELECT user_id, min(event_id) AS begin_at, string_agg(token, ' ' ORDER BY event_id) AS span FROM heads WHERE head = 'B' GROUP BY user_id, island
  UNION ALL SELECT user_id, event_id, token FROM tags WHERE tag = 'DISEASE')
"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id") % 5
    tag = F.when(i == 0, "B").when(i.isin(1, 2), "I").when(i == 3, "O").otherwise("DISEASE")
    tags = read(spark, sf_dir, "events").select("user_id", "event_id", tag.alias("tag"), F.col("event_type").alias("token"))
    return rel.tag_spans(tags, ["user_id"], "event_id", "tag", "token")


@query(f"WITH {TAGS} SELECT user_id, begin_at, span FROM spans")
def span_merge(spark, sf_dir):
    return spans(spark, sf_dir)


@query(f"WITH {TAGS} SELECT user_id, begin_at, span FROM (SELECT *, row_number() OVER (PARTITION BY user_id, lower(span) ORDER BY begin_at) AS n FROM spans) WHERE n = 1")
def keep_first(spark, sf_dir):
    return rel.first_per_key(spans(spark, sf_dir), ["user_id", F.lower("span")], ["begin_at"])


@query(r"SELECT doc_id, regexp_matches(coalesce(text, ''), '\b1[5-9]\b|\b[2-9]\d\b') AS mentions_age FROM documents")
def age_mentions(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", mentions_age(F.col("text")).alias("mentions_age"))


@query(
    f"""WITH {SYSTEMS}, lost AS (SELECT pmcids, g.minimum_age AS gold FROM systems s JOIN gold g USING (pmcids) WHERE s = 0 AND s.minimum_age = 'Not Specified')
    SELECT gold AS minimum_age_gold, age_in_text, count(*) AS count FROM lost
    LEFT JOIN (SELECT doc_id AS pmcids, regexp_matches(text, '\\b1[5-9]\\b|\\b[2-9]\\d\\b') AS age_in_text FROM documents) USING (pmcids) GROUP BY 1, 2"""
)
def missing_ages(spark, sf_dir):
    articles = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("pmcids"), "text")
    return analysis.missing_ages(system_scores(spark, sf_dir, 0), articles)


@query(
    """WITH t AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents),
    n AS (SELECT doc_id, w, CASE WHEN len(w) > 400 THEN ceil((len(w) - 400) / 350.0::DOUBLE)::INT + 1 ELSE 1 END AS k FROM t),
    x AS (SELECT doc_id, w, unnest(range(k)) * 350 AS s FROM n)
    SELECT doc_id, s::INT AS window_start, len(w[s + 1:s + 400])::INT AS tokens, md5(array_to_string(w[s + 1:s + 400], ' ')) AS window_md5 FROM x"""
)
def token_windows(spark, sf_dir):
    rows = gen.token_windows(read(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("tokens")), "tokens")
    return rows.select("doc_id", "window_start", F.size("window").alias("tokens"), F.md5(F.array_join("window", " ")).alias("window_md5"))


@query("SELECT 'repeated user_id' AS rule, user_id::VARCHAR AS detail, count(*) AS count FROM events GROUP BY user_id HAVING count(*) > 1 UNION ALL SELECT 'invalid event_type', event_type, count(*) FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY event_type")
def constraint_violations(spark, sf_dir):
    return rel.violations(read(spark, sf_dir, "events"), "user_id", ("event_id",), {"event_type": ("click", "view")})


@query("SELECT lang, source, count(*) AS count FROM documents GROUP BY lang, source")
def pair_counts(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy("lang", "source").count()


@query("SELECT d.doc_id, d.lang FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM labels) AND d.doc_id IN (SELECT vec_id FROM embeddings)")
def valid_ids(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang")
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return docs.join(read(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").join(vectors, "doc_id", "left_semi")


@query()
def html_blocks(spark, sf_dir):
    rows = page_source.blocks(read(spark, sf_dir, "pages"))
    return rows.select("page_id", "block_index", "block_type", path_text(F.col("section_path")).alias("section_path"), F.char_length("text").alias("char_count"))


# Sentence ends are marked first, as the engine has no look-behind; pieces are merged in lists of lists.
@query(
    r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    cut AS (SELECT doc_id, text, string_split_regex(text, '\n\s*\n+') AS b, string_split(regexp_replace(text, '([.;:])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS e FROM t),
    tidy AS (SELECT doc_id, text, list_filter(list_transform(b, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS b, list_filter(list_transform(e, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS e FROM cut),
    parts AS (SELECT doc_id, text, CASE WHEN len(b) > 1 THEN b ELSE e END AS p FROM tidy),
    merged AS (SELECT doc_id, CASE WHEN len(p) = 0 THEN [text] ELSE list_reduce(list_transform(p, lambda x: [x]), lambda acc, x: CASE WHEN length(acc[len(acc)]) < 80 THEN acc[1:len(acc) - 1] || [acc[len(acc)] || ' ' || x[1]] ELSE acc || x END) END AS m FROM parts)
    SELECT doc_id, len(m)::INT AS paragraphs, list_max(list_transform(m, lambda x: length(x)))::INT AS longest FROM merged"""
)
def paragraph_merge(spark, sf_dir):
    parts = sel.paragraphs(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.size(parts).alias("paragraphs"), F.array_max(F.transform(parts, lambda p: F.char_length(p))).alias("longest"))


@query(f"SELECT item_id, len({NUMBERS.format("'twenty one of ' || text")})::INT AS n, round(list_sum({NUMBERS.format("'twenty one of ' || text")}), 6) AS total FROM benchmark")
def word_numbers(spark, sf_dir):
    found = read(spark, sf_dir, "benchmark").select("item_id", sc.numbers(F.concat(F.lit("twenty one of "), "text")).alias("numbers"))
    return found.select("item_id", F.size("numbers").alias("n"), F.round(F.aggregate("numbers", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


EMPTY_VERBS_SQL = "[" + ", ".join(f"'{v}'" for v in sc.EMPTY_VERBS) + "]"
CONTENT = f"list_filter(list_distinct({{}}), lambda v: NOT list_contains({EMPTY_VERBS_SQL}, v))"
GATED = "lower(trim(text)) IN ('', 'not specified', 'nan') OR lower(trim(before)) IN ('', 'not specified', 'nan')"


@query(
    f"""WITH {OVERLAP}, c AS (SELECT conv_id, turn, {GATED} AS gated, {CONTENT.format(WORDS.format("before"))} AS a, {CONTENT.format(WORDS.format("text"))} AS b FROM turns WHERE before IS NOT NULL),
    s AS (SELECT *, CASE WHEN len(a) > 0 AND len(b) > 0 THEN pow(len(list_intersect(a, b)) / len(a)::DOUBLE, 0.6) ELSE 0.0 END AS x, pow(overlap, 0.24) AS y FROM c JOIN overlap USING (conv_id, turn))
    SELECT conv_id, turn, round(CASE WHEN gated THEN 0.0 ELSE greatest(0.0, least(1.0, (x + y) / (1 + x))) END, 9) AS score FROM s"""
)
def text_scores(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = read(spark, sf_dir, "conversations").withColumn("before", F.lag("text").over(w)).filter("before IS NOT NULL")
    return turns.select("conv_id", "turn", F.round(sc.text_score(F.col("before"), F.col("text")), 9).alias("score"))


@query()
def routed_submission(spark, sf_dir):
    """Pages to blocks, fields, contexts, replies and a submission, with the offline models."""
    from . import routing

    pages = read(spark, sf_dir, "pages")
    blocks = page_source.blocks(pages).withColumnRenamed("page_id", "doc_id")
    blocks = blocks.withColumn("block_id", F.concat(F.col("doc_id").cast("string"), F.lit("::block_"), F.col("block_index").cast("string")))
    none = F.lit(None)
    docs = pages.select(F.col("page_id").alias("doc_id"), none.cast("string").alias("title"), none.cast("string").alias("abstract"), none.cast("array<string>").alias("keywords"))
    contexts = routing.contexts(routing.routed(routing.probabilities(blocks)), docs, blocks)
    results, _ = routing.predictions(contexts)
    return routing.submit(results)


from . import column_queries as _more  # noqa: E402, F401  further queries, which use those above
from . import model_queries as _models  # noqa: E402, F401
from . import source_queries as _sources  # noqa: E402, F401


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
