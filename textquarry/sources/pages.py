"""Web pages as section and block tables: headings open sections, paragraphs, lists and tables make blocks."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCKS = "page_id long, block_index int, block_type string, section_path array<string>, text string"
#: Tags that make blocks, and tags whose text nobody reads.
KINDS = {"p": "paragraph", "li": "list", "td": "table", "th": "table", "figcaption": "figure_caption"}
SKIPPED = frozenset(("script", "style", "nav", "footer", "head", "aside", "form"))


class _Blocks(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.path: list[tuple[int, str]] = []
        self.found: list[tuple[str, list[str], str]] = []
        self.kind, self.parts, self.skip = None, [], 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text and self.kind and self.kind[0] == "h" and self.kind[1:].isdigit():
            level = int(self.kind[1:])
            self.path = [x for x in self.path if x[0] < level] + [(level, text)]
        elif text:
            self.found.append((KINDS.get(self.kind or "", "paragraph"), [t for _, t in self.path], text))
        self.parts, self.kind = [], None

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.flush()
            self.skip += 1
        elif tag in KINDS or (tag[0] == "h" and tag[1:].isdigit()):
            self.flush()
            self.kind = tag
        elif tag in ("div", "article", "section", "main", "table", "ul", "ol", "blockquote"):
            self.flush()
        elif tag == "br":
            self.parts.append(" ")

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.parts, self.kind = [], None
            self.skip = max(0, self.skip - 1)
        elif tag in KINDS or tag in ("div", "article", "section", "main", "table", "ul", "ol", "blockquote") or (tag[0] == "h" and tag[1:].isdigit()):
            self.flush()

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data)


def page_blocks(html: str | None) -> list[tuple[str, list[str], str]]:
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.found


def blocks(pages: DataFrame) -> DataFrame:
    """One row per block of each page, in page order."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, k, *b) for i, html in zip(batch["page_id"], batch["html"], strict=True) for k, b in enumerate(page_blocks(html))]
            yield pd.DataFrame(rows, columns=["page_id", "block_index", "block_type", "section_path", "text"])

    return pages.select(F.col("page_id").cast("long"), "html").mapInPandas(cut, BLOCKS)
