"""Registered queries of sources and sinks: tables written and read back, articles made of the documents and parsed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relations import shared_path
from ..sources import articles, sheets, tables
from .queries import query, read

DOCUMENTS = "SELECT doc_id, lang, source, n_chars, md5(coalesce(text, '')) AS text_md5 FROM documents"


def summed(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "lang", "source", "n_chars", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


@query(DOCUMENTS)
def sheet_rows(spark, sf_dir):
    """All documents as workbooks and back."""
    path = shared_path(spark)
    tables.write_excel(read(spark, sf_dir, "documents"), path, "Train", 5_000)
    return summed(sheets.read_written(spark, path, "Train", "doc_id long, text string, lang string, source string, n_chars long"))


@query(DOCUMENTS)
def csv_rows(spark, sf_dir):
    """All documents as CSV, columns in another order, and back."""
    path = shared_path(spark)
    tables.write_csv(read(spark, sf_dir, "documents"), path, ("text", "doc_id", "n_chars", "source", "lang"))
    return summed(tables.read_csv(spark, path, "doc_id long, text string, lang string, source string, n_chars long"))


@query(DOCUMENTS)
def json_rows(spark, sf_dir):
    """All documents as lines of JSON in folders by hash, and back."""
    path = shared_path(spark)
    tables.write_documents(read(spark, sf_dir, "documents"), path, 8)
    return summed(spark.read.schema("doc_id long, text string, lang string, source string, n_chars long").json(path))


@query("SELECT 'lang' AS kind, lang AS name, count(*)::VARCHAR AS n, NULL::VARCHAR AS note FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*)::VARCHAR, NULL FROM documents GROUP BY source")
def log_rows(spark, sf_dir):
    """A log of two appends whose columns differ from the log's."""
    path, docs = shared_path(spark), read(spark, sf_dir, "documents")
    for kind in ("lang", "source"):
        counted = docs.groupBy(F.col(kind).alias("name")).agg(F.count(F.lit(1)).cast("string").alias("n"))
        tables.append_log(counted.select(F.lit(kind).alias("kind"), "name", "n", F.lit(1).alias("other")), path, ("kind", "name", "n", "note"))
    return spark.read.parquet(path)


@query("SELECT lang AS split, count(*) AS rows, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY lang")
def split_files(spark, sf_dir):
    """A folder for each part."""
    path = shared_path(spark)
    tables.write_by_split(read(spark, sf_dir, "documents").withColumn("split", F.col("lang")), path)
    return spark.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.sum("n_chars").alias("chars"))


@query(
    """SELECT doc_id::VARCHAR AS doc_id, 'b' || k AS block_id, CASE WHEN k = 0 THEN len(embedding) END::INT AS dims
    FROM (SELECT doc_id, embedding, unnest([0, 1]) AS k FROM documents LEFT JOIN embeddings ON vec_id = doc_id)"""
)
def cached_vector_rows(spark, sf_dir):
    """Two blocks a document, of which one's text is as it was when its vector was cached."""
    path, docs = shared_path(spark), read(spark, sf_dir, "documents")
    key = F.col("doc_id").cast("string").alias("doc_id")
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding").join(docs, "doc_id")
    cached = vectors.select(key, F.explode(F.array(F.lit("b0"), F.lit("b1"))).alias("block_id"), F.lit("m").alias("model"), "text", "embedding")
    tables.write_vectors(cached.withColumn("text_hash", F.sha2("text", 256)), path)
    now = docs.select(key, F.explode(F.array(F.lit("b0"), F.lit("b1"))).alias("block_id"), "text")
    now = now.select("doc_id", "block_id", F.lit("m").alias("model"), F.when(F.col("block_id") == "b1", F.concat("text", F.lit(" changed"))).otherwise(F.col("text")).alias("text"))
    found = tables.cached_vectors(now, spark.read.parquet(path))
    return found.select("doc_id", "block_id", F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("dims"))


# Articles of the documents' lines: three to a section, the third one in an untitled subsection.

LINES = """
raw AS (SELECT doc_id, lang, source, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(regexp_replace(x, '[^A-Za-z0-9 .,]', '', 'g'), ' +', ' ', 'g'))), lambda x: x <> '') AS l FROM documents),
lines AS (SELECT doc_id, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS i, len(l) AS n FROM raw)
"""


def article_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, xml) of all documents."""
    tidy = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "[^A-Za-z0-9 .,]", ""), " +", " "))
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), tidy), lambda x: x != "")
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", lines.alias("l"))
    line = lambda k: F.get("l", k)
    given = lambda k, head, tail: F.when(k < F.size("l"), F.concat(F.lit(head), line(k), F.lit(tail))).otherwise("")
    section = lambda s: F.concat(
        F.lit("<sec><title>Part "), s.cast("string"), F.lit("</title>"), given(3 * s, "<p>", "</p>"), given(3 * s + 2, "<sec><title> </title><p>", "</p></sec>"), given(3 * s + 1, "<list><list-item>", "</list-item></list>"), F.lit("</sec>")
    )
    sections = F.when(F.size("l") > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.size("l") - 1) / 3).cast("int")), section), "")).otherwise("")
    front = F.concat(F.lit("<front><article-title>On <i>"), "lang", F.lit("</i></article-title><kwd>"), "source", F.lit("</kwd><kwd/><abstract><p>"), F.coalesce(line(F.lit(0)), F.lit("")), F.lit("</p></abstract></front>"))
    xml = F.concat(F.lit("<article>"), front, F.lit("<body>"), sections, F.lit("</body></article>"))
    return docs.select(F.concat(F.lit("PMC"), F.col("doc_id").cast("string")).alias("doc_id"), xml.alias("xml"))


@query(
    f"""WITH {LINES}, placed AS (SELECT *, i // 3 AS s, i % 3 AS k FROM lines),
    ordered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS o FROM placed)
    SELECT 'PMC' || doc_id AS doc_id, 'PMC' || doc_id || '::block_' || o AS block_id, o::INT AS block_order, CASE k WHEN 1 THEN 'list' ELSE 'paragraph' END AS block_type, md5(text) AS text_md5,
      'PMC' || doc_id || '::sec_' || (2 * s + CASE WHEN k = 2 THEN 1 ELSE 0 END) AS parent_section_id, 'Part ' || s || CASE WHEN k = 2 THEN ' > Untitled Section' ELSE '' END AS path FROM ordered"""
)
def article_blocks(spark, sf_dir):
    """Blocks of all articles: a section's own before those of its subsections, which stand between them."""
    rows = articles.blocks(articles.trees(article_files(spark, sf_dir)))
    return rows.select("doc_id", "block_id", F.col("order").alias("block_order"), "block_type", F.md5("text").alias("text_md5"), "parent_section_id", F.array_join("section_path", " > ").alias("path"))


@query(
    f"""WITH {LINES}, parts AS (SELECT doc_id, i // 3 AS s, max(i % 3) AS k FROM lines GROUP BY doc_id, i // 3),
    every AS (SELECT doc_id, 2 * s AS o, 'Part ' || s AS title, 1 AS level, NULL AS parent FROM parts UNION ALL SELECT doc_id, 2 * s + 1, 'Untitled Section', 2, 2 * s FROM parts WHERE k = 2)
    SELECT 'PMC' || doc_id AS doc_id, 'PMC' || doc_id || '::sec_' || o AS section_id, title, level::INT AS level, 'PMC' || doc_id || '::sec_' || parent AS parent_id, o::INT AS section_order FROM every"""
)
def article_sections(spark, sf_dir):
    """The section trees of all articles, in preorder."""
    rows = articles.sections(articles.trees(article_files(spark, sf_dir)))
    return rows.select("doc_id", "section_id", "title", "level", "parent_id", F.col("order").alias("section_order"))


@query(
    f"""WITH {LINES} SELECT 'PMC' || doc_id AS doc_id, 'On ' || lang AS title, coalesce(l[1], '') AS abstract, CASE WHEN source = '' THEN [] ELSE [source] END AS keywords,
      (len(l) // 3 * 2 + CASE WHEN len(l) % 3 > 0 THEN 1 ELSE 0 END)::INT AS sections, md5(array_to_string(list_filter(l, lambda x, k: (k - 1) % 3 <> 1), '|')) AS paragraphs_md5 FROM raw"""
)
def flat_articles(spark, sf_dir):
    """Heads and flat sections of all articles; a flat section has its own paragraphs only."""
    found = article_files(spark, sf_dir).select("doc_id", articles.flat(F.col("xml")).alias("a"))
    paragraphs = F.flatten(F.transform("a.sections", lambda s: s["paragraphs"]))
    return found.select("doc_id", F.regexp_replace("a.title", " +", " ").alias("title"), "a.abstract", F.filter("a.keywords", lambda k: k != "").alias("keywords"), F.size("a.sections").alias("sections"), F.md5(F.array_join(paragraphs, "|")).alias("paragraphs_md5"))


@query(
    """WITH names AS (SELECT doc_id, unnest(CASE doc_id % 4 WHEN 0 THEN ['b/' || doc_id || '.xml', 'a/PMC' || doc_id || '.xml'] WHEN 1 THEN [doc_id || '.nxml', 'PMC' || doc_id || '.nxml'] WHEN 2 THEN ['z/' || doc_id || '.xml', 'y/' || doc_id || '.xml'] ELSE ['notes/' || doc_id || '.txt'] END) AS path FROM documents),
    ranked AS (SELECT *, CASE WHEN path LIKE '%PMC%.nxml' THEN 0 WHEN path LIKE '%.nxml' THEN 1 WHEN path LIKE '%PMC%' THEN 2 ELSE 3 END AS o FROM names WHERE path NOT LIKE '%.txt')
    SELECT 'pmc' || doc_id AS pmcids, (SELECT arg_min(path, {'o': o, 'p': path}) FROM ranked r WHERE r.doc_id = l.doc_id) AS path FROM labels l"""
)
def article_lookup(spark, sf_dir):
    """Every labelled document's file among several names."""
    n = F.col("doc_id").cast("string")
    name = lambda head, tail: F.concat(F.lit(head), n, F.lit(tail))
    i = F.col("doc_id") % 4
    paths = F.when(i == 0, F.array(name("b/", ".xml"), name("a/PMC", ".xml"))).when(i == 1, F.array(name("", ".nxml"), name("PMC", ".nxml"))).when(i == 2, F.array(name("z/", ".xml"), name("y/", ".xml"))).otherwise(F.array(name("notes/", ".txt")))
    files = read(spark, sf_dir, "documents").select(F.explode(paths).alias("path"), F.col("text").alias("xml"))
    keys = read(spark, sf_dir, "labels").select(name("pmc", "").alias("pmcids"))
    return articles.lookup(keys, files).select("pmcids", "path")
