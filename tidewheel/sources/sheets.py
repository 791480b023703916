"""Excel workbooks (.xlsx) as tables (SRC-5, SRC-6, SNK-2), many files at a time, by the published layout of the format.

Files come by Spark's binary reader, so from any file system, and a task reads one workbook row by row; names, positions and
types are chosen in Spark. Sheets of many rows are written as several workbooks, one for each partition.
"""

from __future__ import annotations

import io
import os
import posixpath
import re
import zipfile
from collections.abc import Iterator, Mapping
from datetime import datetime, timedelta
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from tidewheel.functions.nulls import nan_to_null

#: Rows of a sheet at most, by the format.
SHEET_ROWS = 1_048_576
#: Numbers of the built-in formats that show dates or times.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
_SHEET_TYPE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def _tag(element: ElementTree.Element) -> str:
    return element.tag.rpartition("}")[2]


def _text(element: ElementTree.Element) -> str:
    """The text of a string item, of one or several runs; phonetic hints are left out."""
    return "".join(t.text or "" for part in element if _tag(part) in ("t", "r") for t in ([part] if _tag(part) == "t" else part) if _tag(t) == "t")


def _column(reference: str) -> int:
    """The number of the column in a reference such as AB12, from 0."""
    out = 0
    for c in re.match("[A-Z]+", reference)[0]:
        out = out * 26 + ord(c) - 64
    return out - 1


class Workbook:
    """One file: its sheets by name, and their rows as text."""

    def __init__(self, raw: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(raw))
        book = ElementTree.fromstring(self.zip.read("xl/workbook.xml"))
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
        place = lambda target: target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")
        self.sheets = {s.get("name"): place(links[s.get(f"{{{_SHEET_TYPE}}}id")]) for s in book.iter() if _tag(s) == "sheet"}
        self.late = any(_tag(p) == "workbookPr" and p.get("date1904") in ("1", "true") for p in book.iter())
        names = set(self.zip.namelist())
        self.strings = [_text(s) for s in ElementTree.fromstring(self.zip.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        self.dates = self._date_styles() if "xl/styles.xml" in names else set()

    def _date_styles(self) -> set[int]:
        """Cell styles whose number format has a day, month, year or hour."""
        root = ElementTree.fromstring(self.zip.read("xl/styles.xml"))
        shown = {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.iter() if _tag(f) == "numFmt"}
        own = {n for n, code in shown.items() if re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code.lower()))}
        styles = next((e for e in root if _tag(e) == "cellXfs"), [])
        return {k for k, x in enumerate(styles) if int(x.get("numFmtId", 0)) in DATE_FORMATS | own}

    def _value(self, cell: ElementTree.Element) -> str | None:
        kind = cell.get("t", "n")
        if kind == "inlineStr":
            return next((_text(e) for e in cell if _tag(e) == "is"), None)
        value = next((e.text for e in cell if _tag(e) == "v"), None)
        if value is None or kind == "e":
            return None
        if kind == "s":
            return self.strings[int(value)]
        if kind == "b":
            return "true" if value == "1" else "false"
        if kind == "n" and int(cell.get("s", 0)) in self.dates:
            at = datetime(1904, 1, 1) if self.late else datetime(1899, 12, 30)
            at += timedelta(seconds=round(float(value) * 86_400))
            return at.date().isoformat() if at.time() == datetime.min.time() else at.isoformat(" ")
        if kind == "n" and re.fullmatch(r"-?\d+\.0+", value):
            return value.partition(".")[0]
        return value

    def rows(self, sheet: str | int) -> Iterator[tuple[int, list[str | None]]]:
        """(number from 0, cells) of each row that the sheet has; empty cells and errors are None."""
        names = list(self.sheets)
        name = names[sheet] if isinstance(sheet, int) and sheet < len(names) else sheet
        if name not in self.sheets:
            raise ValueError(f"no sheet {sheet!r}, only {names}")
        number = -1
        with self.zip.open(self.sheets[name]) as file:
            for _, element in ElementTree.iterparse(file):
                if _tag(element) != "row":
                    continue
                number = int(element.get("r", number + 2)) - 1
                cells: list[str | None] = []
                for cell in element:
                    at = _column(cell.get("r")) if cell.get("r") else len(cells)
                    cells += [None] * (at - len(cells)) + [self._value(cell)]
                yield number, cells
                element.clear()


def sheet_rows(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """(path, row from 0, cells: array of text) of a sheet of each workbook that the path (or pattern) names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"path": pa.string(), "row": pa.int32(), "cells": pa.list_(pa.string())}
        for batch in batches:
            for file in batch.to_pylist():
                held: list[tuple] = []
                for number, cells in Workbook(file["content"]).rows(sheet):
                    held.append((file["path"], number, cells))
                    if len(held) == 5_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds.values(), strict=True)], names=list(kinds))
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds.values(), strict=True)], names=list(kinds))

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, row int, cells array<string>")


def read_sheet(spark: SparkSession, path: str, columns: Mapping[str, str], sheet: str | int = 0, header: int | None = 0, positions: Mapping[str, int] | None = None) -> DataFrame:
    """SRC-5, SRC-6: named and typed columns (name: type) of a sheet, from the rows after the header row (from 0).

    Columns are found by the header of each file, wherever it has them, or by given positions; one that a file lacks is missing
    there, and so is a value that isn't of the type. NaN is NULL. Rows without any of the columns are left out.
    """
    rows = sheet_rows(spark, path, sheet)
    if positions is None:
        if header is None:
            raise ValueError("without a header, give positions")
        names = rows.where(F.col("row") == header).select("path", F.transform("cells", F.trim).alias("_names"))  # a row for each file
        rows = rows.join(names, "path")
        place = {c: F.array_position("_names", c) for c in columns}
    else:
        place = {c: F.lit(positions[c] + 1) for c in columns}
    rows = rows.where(F.col("row") > (-1 if header is None else header))
    value = {c: F.when(place[c] > 0, F.get("cells", (place[c] - 1).cast("int"))) for c in columns}
    found = rows.select(*(F.trim(v).try_cast(columns[c]).alias(c) for c, v in value.items()))
    return nan_to_null(found.dropna(how="all"))


_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_FIXED = {
    "[Content_Types].xml": _HEAD + '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": f'{_HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{_SHEET_TYPE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/_rels/workbook.xml.rels": f'{_HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{_SHEET_TYPE}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}


def _cell(value: object) -> str:
    if value is None or value != value:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f"<c><v>{value!r}</v></c>"
    text = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", value if isinstance(value, str) else str(value))
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


class Writer(DataSourceWriter):
    """Each task writes workbooks beside the target and the driver moves them in when all are there."""

    def __init__(self, path: str, names: list[str], sheet: str, overwrite: bool):
        self.path, self.names, self.sheet, self.overwrite = path, names, sheet, overwrite

    def write(self, rows: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        context = TaskContext.get()
        os.makedirs(self.path, exist_ok=True)
        made, row, turn = Files(), next(rows, None), 0
        while row is not None:
            name = f"part-{context.partitionId():05d}-{turn:03d}"
            there = os.path.join(self.path, f".{name}-{context.taskAttemptId()}")
            with zipfile.ZipFile(there, "w", zipfile.ZIP_DEFLATED) as book:
                for place, text in _FIXED.items():
                    book.writestr(place, text)
                book.writestr("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_SHEET_TYPE}"><sheets><sheet name="{escape(self.sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>')
                with book.open("xl/worksheets/sheet1.xml", "w") as sheet:
                    put = lambda cells: sheet.write(f"<row>{''.join(map(_cell, cells))}</row>".encode())  # noqa: B023, E731
                    sheet.write(f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetData>'.encode())
                    put(self.names)
                    for _ in range(SHEET_ROWS - 1):
                        put(row)
                        row = next(rows, None)
                        if row is None:
                            break
                    sheet.write(b"</sheetData></worksheet>")
            made.files.append((there, os.path.join(self.path, f"{name}.xlsx")))
            turn += 1
        return made

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        if self.overwrite:
            for name in os.listdir(self.path) if os.path.isdir(self.path) else ():
                if re.fullmatch(r"part-.*\.xlsx", name):
                    os.remove(os.path.join(self.path, name))
        for there, name in (f for m in messages if m for f in m.files):
            os.replace(there, name)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        for there, _ in (f for m in messages if m for f in m.files):
            os.remove(there)


class Files(WriterCommitMessage):
    def __init__(self) -> None:
        self.files: list[tuple[str, str]] = []


class Sheets(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sheets"

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"].removeprefix("file://"), schema.names, self.options.get("sheet", "Data"), overwrite)


def write_sheets(df: DataFrame, path: str, sheet: str = "Data") -> None:
    """SNK-2: a folder (mounted on all machines) of workbooks, at least one for each partition with rows and each SHEET_ROWS of
    them; dates and other values that Excel has no plain type for are written as text. Workbooks of an earlier write go."""
    df.sparkSession.dataSource.register(Sheets)
    df.write.format(Sheets.name()).mode("overwrite").option("sheet", sheet).save(path)
