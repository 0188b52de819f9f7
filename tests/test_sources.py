import pytest
from pyspark.sql import functions as F

from textquarry.operators.relations import with_links
from textquarry.sources import articles, pages, tables

ARTICLE = """<article><front><article-meta><title-group><article-title>A <i>short</i> title</article-title></title-group>
<abstract><p>About the abstract.</p></abstract><kwd-group><kwd>diabetes</kwd><kwd>randomized trial</kwd></kwd-group></article-meta></front>
<body><p>lost</p><sec><title>Methods</title><p>Aged 18 to 65.</p><p>No  prior
disease.</p><sec><title/><list><list-item><p>one</p></list-item></list></sec><p>late</p></sec>
<sec><title>Results</title><p>120 patients.</p><fig><label>F</label><caption><p>cap</p></caption></fig><disp-formula>x</disp-formula></sec></body></article>"""


def test_flat(spark):
    df = spark.createDataFrame([(1, ARTICLE), (2, "<broken"), (3, None)], "i int, x string")
    got = {r["i"]: r["a"] for r in df.select("i", articles.flat(F.col("x")).alias("a")).collect()}
    assert got[2] is None and got[3] is None
    one = got[1]
    assert "short" in one["title"] and "abstract" in one["abstract"] and one["keywords"] == ["diabetes", "randomized trial"]
    assert [s["title"] for s in one["sections"]] == ["Methods", "Results"] and one["sections"][0]["paragraphs"][0] == "Aged 18 to 65."


def test_tree(spark):
    df = spark.createDataFrame([("d", ARTICLE), ("bad", "<x")], "doc_id string, xml string")
    parsed = articles.trees(df).cache()
    sections = articles.sections(parsed).orderBy("order").collect()
    assert [(s["section_id"], s["title"], s["level"], s["parent_id"]) for s in sections] == [
        ("d::sec_0", "Methods", 1, None), ("d::sec_1", "Untitled Section", 2, "d::sec_0"), ("d::sec_2", "Results", 1, None),
    ]
    blocks = articles.blocks(parsed).orderBy("order")
    assert [(b["block_type"], b["text"]) for b in blocks.collect()] == [
        ("paragraph", "Aged 18 to 65."), ("paragraph", "No prior disease."), ("paragraph", "late"), ("list", "one"), ("paragraph", "120 patients."), ("figure_caption", "cap"),
    ]
    linked = with_links(blocks, ["doc_id"], "order", "block_id", "prev", "next").orderBy("order").collect()
    assert [r["next"] for r in linked][:2] == ["d::block_1", "d::block_2"] and linked[-1]["next"] is None
    assert [r["candidate_file"] for r in articles.failures(parsed).collect()] == ["bad"]


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "PMC5.nxml").write_text(ARTICLE)
    (tmp_path / "sub" / "5.nxml").write_text("<other/>")
    keys = spark.createDataFrame([("PMC5",), ("5",), ("6",)], "pmcids string")
    got = {r["pmcids"]: r["path"] for r in articles.lookup(keys, articles.read_files(spark, str(tmp_path))).collect()}
    assert got["PMC5"].endswith("/PMC5.nxml") and got["5"] == got["PMC5"] and got["6"] is None


def test_pages():
    html = "<html><head><title>t</title></head><body><nav><p>menu</p></nav><h1>One</h1><p>a &amp; b<br>c<h2>Two</h2><ul><li>x<li>y</ul><h1>Three</h1>tail</body>"
    assert pages.page_blocks(html) == [("paragraph", ["One"], "a & b c"), ("list", ["One", "Two"], "x"), ("list", ["One", "Two"], "y"), ("paragraph", ["Three"], "tail")]
    assert pages.page_blocks(None) == []


def test_tables(spark, tmp_path):
    rows = spark.createDataFrame([("1", 'a "q"\nb', "train"), ("2", None, "test")], "sample_id string, text string, split string")
    tables.write_csv(rows, str(tmp_path / "csv"), ("text", "sample_id"), one_file=True)
    back = tables.read_csv(spark, str(tmp_path / "csv"), tables.SAMPLES)
    assert sorted((r["sample_id"], r["text"] or None, r["label"]) for r in back.collect()) == [("1", 'a "q"\nb', None), ("2", None, None)]
    tables.write_by_split(rows, str(tmp_path / "split"))
    assert spark.read.parquet(str(tmp_path / "split" / "split=test")).count() == 1
    tables.append_log(rows, str(tmp_path / "log"), ("sample_id", "error"))
    tables.append_log(rows, str(tmp_path / "log"), ("sample_id", "error"))
    assert spark.read.parquet(str(tmp_path / "log")).columns == ["sample_id", "error"] and spark.read.parquet(str(tmp_path / "log")).count() == 4
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.json").write_text('{"doc_id": "a",\n "blocks": [{"id": "b1", "text": "t"}, {"text": "u", "section_id": "s"}]}')
    (tmp_path / "j" / "_skip.json").write_text('{"doc_id": "no"}')
    docs = tables.read_json_documents(spark, str(tmp_path / "j"), tables.PARSED_DOCUMENT)
    found = tables.document_blocks(docs)
    assert [(r["block_id"], r["block_type"]) for r in found.orderBy("block_index").collect()] == [("b1", "text"), ("block_1", "text")]
    sections = spark.createDataFrame([("a", "s", ["Methods"])], "doc_id string, section_id string, path array<string>")
    assert [r["section_path"] for r in tables.with_section_paths(found, sections).orderBy("block_index").collect()] == [[], ["Methods"]]
    with pytest.raises(Exception):
        tables.read_excel(spark, str(tmp_path / "none.xlsx"))


def test_vector_cache(spark, tmp_path):
    blocks = spark.createDataFrame([("d", "b", "m", "text")], "doc_id string, block_id string, model string, text string")
    made = blocks.withColumn("text_hash", F.sha2("text", 256)).withColumn("embedding", F.array(F.lit(1.0).cast("float")))
    tables.write_vectors(made, str(tmp_path / "v"))
    cache = spark.read.parquet(str(tmp_path / "v"))
    assert tables.cached_vectors(blocks, cache).first()["embedding"] == [1.0]
    assert tables.cached_vectors(blocks.withColumn("text", F.lit("new")), cache).first()["embedding"] is None
