"""Articles in XML: flat and hierarchical parsing, from files or strings, into tables of documents, sections and blocks."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _I, _LIST = T.StringType(), T.IntegerType(), T.ArrayType(T.StringType())


def _struct(**types: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in types.items()])


FLAT = _struct(title=_S, abstract=_S, keywords=_LIST, sections=T.ArrayType(_struct(title=_S, text=_S, paragraphs=_LIST)))
SECTION = _struct(section_id=_S, title=_S, path=_LIST, level=_I, parent_id=_S, order=_I)
BLOCK = _struct(block_id=_S, block_type=_S, text=_S, parent_section_id=_S, section_path=_LIST, order=_I)
TREE = _struct(title=_S, abstract=_S, keywords=_LIST, sections=T.ArrayType(SECTION), blocks=T.ArrayType(BLOCK))
#: Children of a section that make blocks, with their block types.
BLOCK_TYPES = {"p": "paragraph", "list": "list", "table-wrap": "table", "fig": "figure_caption"}


def local(element: ET.Element) -> str:
    """A tag without its namespace."""
    return element.tag.rpartition("}")[2] if isinstance(element.tag, str) else ""


def joined(element: ET.Element | None) -> str:
    """All text pieces of an element, a space between them, trimmed."""
    return "" if element is None else " ".join(element.itertext()).strip()


def tidy(element: ET.Element | None) -> str:
    """As ``joined``, white space collapsed."""
    return " ".join(joined(element).split())


def parse_flat(data: str | bytes | None) -> dict | None:
    """Title, abstract, keywords and every section at any depth with its own paragraphs; None if it cannot be parsed."""
    try:
        root = ET.fromstring(data)
    except (ET.ParseError, TypeError, ValueError):
        return None
    sections = []
    for sec in root.iter("sec"):
        title, paragraphs = joined(sec.find("title")), [x for x in map(joined, sec.findall("p")) if x]
        if title or paragraphs:
            sections.append({"title": title, "text": " ".join(paragraphs), "paragraphs": paragraphs})
    return {
        "title": joined(root.find(".//article-title")),
        "abstract": " ".join(map(joined, root.iter("abstract"))),
        "keywords": [joined(k) for k in root.iter("kwd")],
        "sections": sections,
    }


@dataclass
class _Walk:
    doc_id: str
    sections: list[dict] = field(default_factory=list)
    blocks: list[dict] = field(default_factory=list)

    def section(self, sec: ET.Element, parent: str | None, path: list[str]) -> None:
        title = tidy(next((c for c in sec if local(c) == "title"), None))
        path = [*path, title or "Untitled Section"]
        number = len(self.sections)
        sid = f"{self.doc_id}::sec_{number}"
        self.sections.append({"section_id": sid, "title": path[-1], "path": path, "level": len(path), "parent_id": parent, "order": number})
        for child in sec:
            kind = BLOCK_TYPES.get(local(child))
            if kind == "figure_caption":
                child = next((x for x in child.iter() if local(x) == "caption"), None)
            text = tidy(child) if kind else ""
            if text:
                n = len(self.blocks)
                self.blocks.append({"block_id": f"{self.doc_id}::block_{n}", "block_type": kind, "text": text, "parent_section_id": sid, "section_path": path, "order": n})
        for child in sec:
            if local(child) == "sec":
                self.section(child, sid, path)


def parse_tree(data: str | bytes, doc_id: str) -> dict:
    """The section tree under the body, in preorder, with its blocks; a section's blocks come before its subsections'."""
    root = ET.fromstring(data)
    walk, body = _Walk(doc_id), root.find(".//body")
    for child in body if body is not None else ():
        if local(child) == "sec":
            walk.section(child, None, [])
    return {
        "title": tidy(root.find(".//article-title")),
        "abstract": " ".join(x for x in map(tidy, root.iter("abstract")) if x),
        "keywords": [x for x in map(tidy, root.iter("kwd")) if x],
        "sections": walk.sections,
        "blocks": walk.blocks,
    }


def flat(data: Column) -> Column:
    """``FLAT`` of a column of XML, null where it cannot be parsed."""

    @F.udf(FLAT, useArrow=True)
    def parse(x):
        return parse_flat(x)

    return parse(data)


def trees(articles: DataFrame, id_col: str = "doc_id", xml_col: str = "xml") -> DataFrame:
    """(doc_id, doc, error): ``TREE`` of each article, or the reason why there is none."""
    schema = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("doc", TREE), T.StructField("error", T.StringType())])

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, xml in zip(batch["doc_id"], batch["xml"], strict=True):
                try:
                    rows.append((doc_id, parse_tree(xml, doc_id), None))
                except Exception as e:  # whatever a document does, it must not end the job
                    rows.append((doc_id, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["doc_id", "doc", "error"])

    return articles.select(F.col(id_col).cast("string").alias("doc_id"), F.col(xml_col).alias("xml")).mapInPandas(parse, schema)


def documents(parsed: DataFrame) -> DataFrame:
    return parsed.filter("doc IS NOT NULL").select("doc_id", "doc.title", "doc.abstract", "doc.keywords")


def sections(parsed: DataFrame) -> DataFrame:
    return parsed.filter("doc IS NOT NULL").select("doc_id", F.inline("doc.sections"))


def blocks(parsed: DataFrame) -> DataFrame:
    return parsed.filter("doc IS NOT NULL").select("doc_id", F.inline("doc.blocks"))


def failures(parsed: DataFrame) -> DataFrame:
    """Dead letters: one row for each article without a tree."""
    kind = F.substring_index("error", ":", 1)
    return parsed.filter("doc IS NULL").select(F.col("doc_id").alias("candidate_file"), F.lit("parse").alias("stage"), kind.alias("error_type"), "error")


def read_files(spark: SparkSession, path: str, pattern: str = "*.nxml") -> DataFrame:
    """(doc_id, path, xml) of every matching file below ``path``; the id is the file's stem."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return files.select(stem.alias("doc_id"), "path", F.col("content").cast("string").alias("xml"))


def lookup(keys: DataFrame, files: DataFrame, key_col: str = "pmcids") -> DataFrame:
    """``keys`` with each one's file: the best of the names an id can have, PMC and number first; null where none is.

    Names in order: ``PMC{n}.nxml``, ``{n}.nxml``, ``PMC{n}.xml``, ``{n}.xml``; of equals the first path.
    """
    number = F.regexp_replace(F.upper(F.trim(F.col(key_col).cast("string"))), "^PMC", "")
    base = F.regexp_extract("path", r"([^/]+)$", 1)
    named = files.withColumn("_n", F.regexp_extract(base, r"^(?:PMC)?([^.]+)\.n?xml$", 1))
    order = F.when(base.rlike(r"^PMC.*\.nxml$"), 0).when(base.endswith(".nxml"), 1).when(base.startswith("PMC"), 2).otherwise(3)
    best = named.filter(F.col("_n") != "").groupBy("_n").agg(F.min(F.struct(order.alias("o"), "path", "xml")).alias("_f"))
    joined_ = keys.withColumn("_k", number).join(best, F.col("_k") == F.col("_n"), "left")
    return joined_.select(*[keys[c] for c in keys.columns], F.col("_f.path").alias("path"), F.col("_f.xml").alias("xml"))
