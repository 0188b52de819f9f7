"""Spreadsheets: what is written comes back, and workbooks of other writers are read."""

import io
import random
import zipfile
from xml.etree import ElementTree

import pytest

from textquarry.sources import sheets, tables


def book(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


MAIN, REL = sheets.MAIN, sheets.LINKS
FOREIGN = {
    "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets><sheet name="Other" sheetId="1" r:id="rId1"/><sheet name="Train" sheetId="2" r:id="rId9"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="x"><Relationship Id="rId1" Target="worksheets/one.xml"/><Relationship Id="rId9" Target="/xl/worksheets/two.xml"/></Relationships>',
    "xl/sharedStrings.xml": f'<sst xmlns="{MAIN}"><si><t>pmcids</t></si><si><t>sex</t></si><si><r><t>AL</t></r><r><t>L</t></r><rPh><t>no</t></rPh></si><si><t>a_x000A_b</t></si></sst>',
    "xl/worksheets/one.xml": f'<worksheet xmlns="{MAIN}"><sheetData><row><c t="s"><v>0</v></c></row><row><c><v>7</v></c></row></sheetData></worksheet>',
    "xl/worksheets/two.xml": f'<worksheet xmlns="{MAIN}"><cols><col/></cols><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="2"><c r="A2"><v>12</v></c><c r="C2" t="s"><v>2</v></c></row>'
    '<row r="3"/><row r="4"><c r="C4" t="s"><v>3</v></c></row><row r="5"><c r="A5" t="e"><v>#N/A</v></c><c r="B5" t="b"><v>1</v></c><c r="C5" t="str"><v>f</v></c><c r="AB5"><v>9</v></c></row></sheetData></worksheet>',
}


def test_foreign_workbooks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xlsx").write_bytes(book(FOREIGN))
    (tmp_path / "in" / "note.txt").write_text("no workbook")
    got = tables.read_excel(spark, str(tmp_path / "in"))
    assert got.columns == ["pmcids", "column_1", "sex"]
    assert [tuple(r) for r in got.collect()] == [("12", None, "ALL"), (None, None, "a\nb"), (None, "true", "f")]
    typed = tables.read_excel(spark, str(tmp_path / "in" / "a.xlsx"), schema="sex string, pmcids long, conditions string")
    assert [tuple(r) for r in typed.collect()] == [("ALL", 12, None), ("a\nb", None, None), ("f", None, None)]
    assert tables.read_excel(spark, str(tmp_path / "in"), "Other").collect()[0]["pmcids"] == "7"
    assert tables.read_excel(spark, str(tmp_path / "in"), "None").count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        tables.read_excel(spark, str(tmp_path / "none.xlsx")).count()


def test_round_trip(spark, tmp_path):
    rng = random.Random(7)
    odd = ["", " a ", "<&>\"'", "é日\U0001f600", "line\nbreak\r\n", "\x01\x0b\x1f", "_x0041_", "x" * 40_000, None, "1", "true"]
    rows = [(k, rng.choice([None, 1.5, -2e300, float(k)]), rng.choice([True, False, None]), odd[k % len(odd)], f"d{k}") for k in range(2300)]
    df = spark.createDataFrame(rows, "n long, x double, b boolean, `a b` string, d string").repartition(3)
    tables.write_excel(df, str(tmp_path / "out"), "Gold & <more>", rows=400)
    back = sheets.read_written(spark, str(tmp_path / "out"), "Gold & <more>", "n long, x double, b boolean, `a b` string, d string")
    assert sorted(map(tuple, back.collect()), key=lambda r: r[0]) == rows
    files = sorted((tmp_path / "out").glob("part-*"))
    assert len(files) >= 6
    for path in files:
        with zipfile.ZipFile(path) as z:
            assert z.testzip() is None and z.comment == b"\n"
            for name in z.namelist():
                ElementTree.fromstring(z.read(name))
            assert 1 < z.read("xl/worksheets/sheet1.xml").count(b"<row>") <= 401
    tables.write_excel(df.limit(0), str(tmp_path / "out"))
    assert not list((tmp_path / "out").glob("part-*")) or sheets.read_written(spark, str(tmp_path / "out")).count() == 0
