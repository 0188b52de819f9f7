"""Spreadsheets (xlsx) read and written by executors, in any store that Spark reaches.

A workbook is a zip archive of XML. Each file is read by one task, which takes the asked sheet row by row; files are as many
tasks as there are. For writing, each task packs its rows into a workbook row by row, holding only what is compressed, and
Spark's text writer commits the files: a workbook ends in a comment of one byte, which is the line break that the writer adds.

Defined cases: cells come as text, numbers as they are written in the file, dates as their serial numbers, errors and empty
cells as null; a sheet's first row names the columns; columns that a schema asks for and the sheet lacks are null, further
ones are not read; a workbook without the sheet gives no rows; a table without rows writes no workbook; characters that XML
cannot hold are written as the format's escapes and come back.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a workbook; the format ends at 2 ** 20 with the header's.
ROWS = 500_000
#: Rows that a reader passes on at a time.
BATCH = 2_000
# Fixed values of the format.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
KIND = "application/vnd.openxmlformats-officedocument.spreadsheetml"

_ESCAPED = re.compile("_x([0-9A-Fa-f]{4})_")


def _tag(name: str) -> str:
    return f"{{{MAIN}}}{name}"


def _text(element: ElementTree.Element) -> str:
    """The text of a string item, its runs joined; phonetic hints are none of it."""
    parts = [t.text or "" for t in element.findall(_tag("t")) + [t for r in element.findall(_tag("r")) for t in r.findall(_tag("t"))]]
    return _ESCAPED.sub(lambda m: chr(int(m[1], 16)), "".join(parts))


def _column(reference: str) -> int:
    """The number of a cell's column from 0, from a reference such as AB12."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n - 1


def sheet_rows(content: bytes, sheet: str) -> Iterator[list[str | None]]:
    """The rows of one sheet as lists of cells; rows without cells are left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = book.namelist()
        listed = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(_tag("sheet"))
        ids = {s.get("name"): s.get(f"{{{LINKS}}}id") for s in listed}
        if sheet not in ids:
            return
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        target = targets[ids[sheet]]
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            with book.open("xl/sharedStrings.xml") as source:
                for _, element in ElementTree.iterparse(source):
                    if element.tag == _tag("si"):
                        shared.append(_text(element))
                        element.clear()
        with book.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as source:
            rows = ElementTree.iterparse(source, ("start", "end"))
            data = None
            for event, element in rows:
                if event == "start":
                    data = element if element.tag == _tag("sheetData") else data
                    continue
                if element.tag != _tag("row"):
                    continue
                cells: list[str | None] = []
                for cell in element.findall(_tag("c")):
                    at = _column(cell.get("r")) if cell.get("r") else len(cells)
                    cells += [None] * (at + 1 - len(cells))
                    cells[at] = _value(cell, shared)
                if cells:
                    yield cells
                # Rows that are done are freed, so a sheet is never held as a whole.
                if data is not None:
                    data.clear()


def _value(cell: ElementTree.Element, shared: list[str]) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        held = cell.find(_tag("is"))
        return _text(held) if held is not None else None
    value = cell.find(_tag("v"))
    if value is None or value.text is None or kind == "e":
        return None
    if kind == "s":
        return shared[int(value.text)]
    if kind == "b":
        return "true" if value.text == "1" else "false"
    return _ESCAPED.sub(lambda m: chr(int(m[1], 16)), value.text) if kind == "str" else value.text


def read(spark: SparkSession, path: str, sheet: str = "Train", schema: str | None = None) -> DataFrame:
    """One sheet of every workbook under ``path``; columns are strings named by the first sheet's header unless a schema casts them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", True).load(path).select("content")
    return _read(spark, files, sheet, schema)


def read_written(spark: SparkSession, path: str, sheet: str = "Train", schema: str | None = None) -> DataFrame:
    """What ``write`` has put out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return _read(spark, files, sheet, schema)


def _read(spark: SparkSession, files: DataFrame, sheet: str, schema: str | None) -> DataFrame:
    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                names = next(sheet_rows(content, sheet), None)
                if names:
                    yield pd.DataFrame({"names": [[n or "" for n in names]]})

    if schema is None:
        first = files.mapInPandas(heads, "names array<string>").first()
        wanted = T.StructType([T.StructField(n or f"column_{k}", T.StringType()) for k, n in enumerate(first["names"] if first else [])])
    else:
        wanted = spark.createDataFrame([], schema).schema
    columns = [f.name for f in wanted]
    if not columns:
        return spark.createDataFrame([], wanted)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                found = sheet_rows(content, sheet)
                names = next(found, None) or []
                places = [next((k for k, n in enumerate(names) if (n or f"column_{k}") == c), None) for c in columns]
                held = []
                for cells in found:
                    held.append([cells[k] if k is not None and k < len(cells) else None for k in places])
                    if len(held) == BATCH:
                        yield pd.DataFrame(held, columns=columns, dtype="object")
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=columns, dtype="object")

    strings = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return files.mapInPandas(rows, strings).select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in wanted])


def _held(text: str) -> str:
    """Text as XML holds it, with the format's escapes for what XML cannot."""
    text = _ESCAPED.sub(lambda m: f"_x005F_x{m[1]}_", text)
    return escape(re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f\r￾￿]", lambda m: f"_x{ord(m[0]):04X}_", text))


def _cell(value) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, int | float):
        return f"<c><v>{value!r}</v></c>" if value == value and abs(value) != float("inf") else "<c/>"
    return f'<c t="inlineStr"><is><t xml:space="preserve">{_held(value)}</t></is></c>'


def workbook(rows: Iterator[list], names: list[str], sheet: str) -> bytes:
    """A workbook of one sheet, without the last byte of its comment."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr(
            "[Content_Types].xml",
            f'<?xml version="1.0"?><Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
            f'<Override PartName="/xl/workbook.xml" ContentType="{KIND}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{KIND}.worksheet+xml"/></Types>',
        )
        link = f'<?xml version="1.0"?><Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{LINKS}/{{}}" Target="{{}}"/></Relationships>'
        book.writestr("_rels/.rels", link.format("officeDocument", "xl/workbook.xml"))
        book.writestr("xl/_rels/workbook.xml.rels", link.format("worksheet", "worksheets/sheet1.xml"))
        name = escape(sheet, {'"': "&quot;"})
        book.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{MAIN}" xmlns:r="{LINKS}"><sheets><sheet name="{name}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        with book.open("xl/worksheets/sheet1.xml", "w") as part:
            part.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{MAIN}"><sheetData>'.encode())
            part.write(("<row>" + "".join(map(_cell, names)) + "</row>").encode())
            for row in rows:
                part.write(("<row>" + "".join(map(_cell, row)) + "</row>").encode())
            part.write(b"</sheetData></worksheet>")
        book.comment = b"\n"
    return out.getvalue()[:-1]


def write(df: DataFrame, path: str, sheet: str = "Train", rows: int = ROWS) -> None:
    """Workbooks of at most ``rows`` rows under ``path``, each a file of its own; other types than numbers and booleans as text."""
    kept = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)
    plain = df.select(*[F.col(f"`{f.name}`") if isinstance(f.dataType, kept) else F.col(f"`{f.name}`").cast("string").alias(f.name) for f in df.schema])
    names = plain.columns

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (list(row) for b in batches for row in zip(*[c.to_pylist() for c in b.columns], strict=True))
        while (first := next(stream, None)) is not None:

            def some(first=first) -> Iterator[list]:
                yield first
                for _, row in zip(range(rows - 1), stream, strict=False):
                    yield row

            yield pa.RecordBatch.from_arrays([pa.array([workbook(some(), names, sheet)], pa.binary())], names=["content"])

    books = plain.mapInArrow(packed, "content binary")
    books.select(F.col("content").cast("string").alias("value")).write.mode("overwrite").option("maxRecordsPerFile", 1).option("lineSep", "\n").text(path)
