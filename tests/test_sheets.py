"""Workbooks: what other programs write into them, many files, and what is written here."""

import zipfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from tidewheel.sources import sheets


def book(path, parts):
    """A workbook of two sheets in the manner of other programs: shared strings, styles, gaps, errors."""
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as out:
        out.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Notes" sheetId="1" r:id="rId1"/><sheet name="Data" sheetId="2" r:id="rId2"/></sheets></workbook>')
        out.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="x"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{rel}/worksheet" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        out.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>Plant</t></si><si><t>MW</t></si><si><r><t>Rio </t></r><r><t>Grande &amp; Co</t></r><rPh><t>no</t></rPh></si><si><t>Date</t></si></sst>')
        out.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><numFmts><numFmt numFmtId="164" formatCode="dd&quot;d&quot;/mm"/><numFmt numFmtId="165" formatCode="0.0&quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>')
        out.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c></row></sheetData></worksheet>')
        out.writestr("xl/worksheets/sheet2.xml", f'<worksheet xmlns="{main}"><sheetData>{parts}</sheetData></worksheet>')


HEAD = '<row r="3"><c r="A3" t="s"><v>3</v></c><c r="C3" t="s"><v>0</v></c><c r="D3" t="s"><v>1</v></c></row>'


def test_cells_of_every_kind(spark, tmp_path):
    rows = '<row r="1"><c r="A1" t="inlineStr"><is><t>Title</t></is></c></row>' + HEAD
    rows += '<row r="4"><c r="A4" s="1"><v>36526</v></c><c r="C4" t="s"><v>2</v></c><c r="D4"><v>12.5</v></c></row>'
    rows += '<row r="6"><c r="A6" s="2"><v>36527.5</v></c><c r="C6" t="str"><f>A1</f><v>x</v></c><c r="D6" t="e"><v>#N/A</v></c></row>'
    rows += '<row r="7"><c r="A7" s="3"><v>3.0</v></c><c r="C7" t="b"><v>1</v></c><c r="AB7"><v>9</v></c></row><row r="8"/>'
    book(tmp_path / "a.xlsx", rows)
    raw = sheets.sheet_rows(spark, str(tmp_path / "a.xlsx"), "Data").orderBy("row").collect()
    assert [(r.row, r.cells) for r in raw[2:4]] == [(3, ["2000-01-01", None, "Rio Grande & Co", "12.5"]), (5, ["2000-01-02 12:00:00", None, "x", None])]
    assert raw[4].cells[:3] == ["3", None, "true"] and len(raw[4].cells) == 28 and raw[4].cells[27] == "9" and raw[5].cells == []
    got = sheets.read_sheet(spark, str(tmp_path / "a.xlsx"), {"Plant": "string", "MW": "double", "Date": "date", "Other": "int"}, "Data", 2)
    assert sorted(map(tuple, got.collect()), key=str) == [("Rio Grande & Co", 12.5, date(2000, 1, 1), None), ("true", None, None, None), ("x", None, date(2000, 1, 2), None)]
    at = sheets.read_sheet(spark, str(tmp_path / "a.xlsx"), {"p": "string", "v": "double"}, 1, 2, {"p": 2, "v": 3})
    assert {tuple(r) for r in at.collect()} == {("Rio Grande & Co", 12.5), ("x", None), ("true", None)}
    with pytest.raises(Exception, match="no sheet"):
        sheets.sheet_rows(spark, str(tmp_path / "a.xlsx"), "None").collect()


def test_each_file_has_its_own_header(spark, tmp_path):
    book(tmp_path / "a.xlsx", HEAD + '<row r="4"><c r="C4" t="s"><v>2</v></c><c r="D4"><v>1</v></c></row>')
    book(tmp_path / "b.xlsx", '<row r="3"><c r="A3" t="s"><v>1</v></c><c r="B3" t="s"><v>0</v></c></row><row r="4"><c r="A4"><v>2</v></c><c r="B4" t="inlineStr"><is><t> y </t></is></c></row>')
    got = sheets.read_sheet(spark, str(tmp_path / "*.xlsx"), {"Plant": "string", "MW": "int"}, "Data", 2)
    assert {tuple(r) for r in got.collect()} == {("Rio Grande & Co", 1), ("y", 2)}


def test_written_workbooks_are_read_again(spark, tmp_path, monkeypatch):
    df = spark.range(40).select("id", (F.col("id") / 3).alias("x"), F.when(F.col("id") % 4 > 0, F.concat(F.lit("a<&>\"'\n é "), "id")).alias("s"), (F.col("id") % 2 == 0).alias("b"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    path = str(tmp_path / "out")
    for parts in (5, 3):  # the second write takes the place of the first
        sheets.write_sheets(df.repartition(parts), path)
    assert len(list((tmp_path / "out").iterdir())) == 3
    got = sheets.read_sheet(spark, path + "/*.xlsx", {"id": "bigint", "x": "double", "s": "string", "b": "boolean", "d": "date"}, "Data")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))
    monkeypatch.setattr(sheets, "SHEET_ROWS", 11)
    made = sheets.Writer(str(tmp_path / "many"), ["a"], "Data", True)
    import pyspark

    class Task:
        partitionId = taskAttemptId = staticmethod(lambda: 0)

    monkeypatch.setattr(pyspark.TaskContext, "get", staticmethod(Task))
    made.commit([made.write(iter([(i,) for i in range(25)]))])
    assert sheets.read_sheet(spark, str(tmp_path / "many"), {"a": "int"}).count() == 25 and len(list((tmp_path / "many").iterdir())) == 3
