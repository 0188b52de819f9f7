"""Tables in files: readers with fixed schemas, and the writers that go with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sheets

#: The columns of gold and prediction sheets, and of labelling samples.
GOLD = "pmcids string, conditions string, study_type string, sex string, minimum_age string, maximum_age string, eligibility_criteria string"
SAMPLES = "sample_id string, doc_id string, block_id string, section_path string, text string, label string"
CANDIDATE = "struct<doc_id:string,block_id:string,block_index:int,similarity:double,final_score:double,section_path:array<string>,block_type:string,text:string,char_count:int>"
CANDIDATE_DOCUMENT = f"doc_id string, title string, abstract string, keywords array<string>, num_blocks int, candidates array<{CANDIDATE}>"
#: A parsed document in any of its shapes: a list of blocks under either name; keys may be missing.
BLOCK = "struct<block_id:string,id:string,block_type:string,type:string,text:string,section_path:array<string>,section_id:string,parent_section_id:string>"
PARSED_DOCUMENT = f"doc_id string, title string, abstract string, keywords array<string>, flat_blocks array<{BLOCK}>, blocks array<{BLOCK}>"


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV with header whose cells may hold line breaks and quotes; a byte-order mark in front is dropped.

    Columns are taken by name: those of ``schema`` that the file lacks are null.
    """
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("inferSchema", schema is None)
    found = reader.csv(path)
    found = found.toDF(*[c.lstrip("﻿") for c in found.columns])
    if schema is None:
        return found
    wanted = spark.createDataFrame([], schema).schema
    return found.select(*[(F.col(f"`{f.name}`") if f.name in found.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])


def read_excel(spark: SparkSession, path: str, sheet: str = "Train", schema: str | None = None) -> DataFrame:
    """One sheet of the workbooks at ``path``, as strings unless a schema casts them; read by executors."""
    return sheets.read(spark, path, sheet, schema)


def write_excel(df: DataFrame, path: str, sheet: str = "Train", rows: int = sheets.ROWS) -> None:
    """Workbooks of at most ``rows`` rows, committed together; a rerun replaces them."""
    sheets.write(df, path, sheet, rows)


def read_json_documents(spark: SparkSession, path: str, schema: str = CANDIDATE_DOCUMENT) -> DataFrame:
    """One JSON document a file; names that begin with an underscore or a dot are not read."""
    return spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)


def document_blocks(parsed: DataFrame) -> DataFrame:
    """The blocks of documents in any shape: doc_id, block_index, block_id, block_type, section_path, text."""
    listed = F.coalesce(F.col("flat_blocks"), F.col("blocks"))
    rows = parsed.select("doc_id", F.posexplode(listed).alias("block_index", "b"))
    return rows.select(
        "doc_id",
        "block_index",
        F.coalesce("b.block_id", "b.id", F.concat(F.lit("block_"), F.col("block_index").cast("string"))).alias("block_id"),
        F.coalesce("b.block_type", "b.type", F.lit("text")).alias("block_type"),
        F.coalesce("b.section_path", F.array().cast("array<string>")).alias("section_path"),
        F.coalesce("b.section_id", "b.parent_section_id").alias("section_id"),
        F.coalesce("b.text", F.lit("")).alias("text"),
    )


def with_section_paths(blocks: DataFrame, sections: DataFrame) -> DataFrame:
    """Blocks without a path take that of their section; without one, the empty path."""
    paths = sections.select("doc_id", "section_id", F.col("path").alias("_path"))
    found = blocks.join(paths, ["doc_id", "section_id"], "left")
    own = F.when(F.size("section_path") > 0, F.col("section_path"))
    return found.withColumn("section_path", F.coalesce(own, "_path", F.array().cast("array<string>"))).drop("_path")


def cached_vectors(blocks: DataFrame, cache: DataFrame) -> DataFrame:
    """Blocks with the cached vector of the same text and model, null where there is none."""
    keyed = blocks.withColumn("text_hash", F.sha2("text", 256))
    return keyed.join(cache.select("doc_id", "block_id", "model", "text_hash", "embedding"), ["doc_id", "block_id", "model", "text_hash"], "left")


# Writers. Spark commits a job's files together, so a failed write leaves no half file to be taken for a whole one.


def write_csv(df: DataFrame, path: str, columns: tuple[str, ...] | None = None, one_file: bool = False) -> None:
    """A CSV with header; ``columns`` fixes names and order. ``one_file`` is for results that a person reads."""
    out = df.select(*columns) if columns else df
    out = out.coalesce(1) if one_file else out
    out.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def write_by_split(df: DataFrame, path: str, column: str = "split") -> None:
    df.write.mode("overwrite").partitionBy(column).parquet(path)


def append_log(df: DataFrame, path: str, columns: tuple[str, ...]) -> None:
    """Rows appended to a log of fixed columns; others are dropped, missing ones null."""
    df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns]).write.mode("append").parquet(path)


def append_failures(df: DataFrame, path: str) -> None:
    """Dead letters as lines of JSON."""
    df.write.mode("append").json(path)


def write_documents(df: DataFrame, path: str, buckets: int = 16) -> None:
    """One line of JSON a document, dealt to folders by hash of its id."""
    key = F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")
    df.withColumn("bucket", key).write.mode("overwrite").partitionBy("bucket").json(path)


def write_vectors(df: DataFrame, path: str) -> None:
    """The cache that ``cached_vectors`` reads."""
    df.select("doc_id", "block_id", "model", "text_hash", "embedding").write.mode("append").parquet(path)
