"""XLSX workbooks with the standard library: read on the executors through Spark's own file source, written on the driver.

A workbook is a zip archive of XML parts. Spark reads the bytes (any file system, many workbooks at
once) and each task parses its workbooks into rows of (text, kind) cells, a batch of rows at a time: of a sheet
no more than a batch stands in memory, beside the workbook's shared strings.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from io import BytesIO
from itertools import batched, chain
from typing import BinaryIO
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from growthlab.operators.annotate import KIND

MAX_ROWS = 1_048_576
#: Rows of a sheet that are parsed and passed on at once.
BATCH_ROWS = 4096
#: The columns that a reader adds to those of a sheet.
PATH, ROW = "_path", "_row"
# XML namespaces, and the texts of cells that count as missing.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


class SheetNotFound(ValueError):
    """The workbook has no sheet of that name."""


@dataclass(frozen=True)
class Sheet:
    """A sheet as a table: _row and its columns, and _path where several workbooks were read; headers as the
    sheet has them, in the order of names. Nothing is kept: each action parses anew, unless the caller persists df."""

    df: DataFrame
    headers: list[object]
    names: list[str]

    def release(self) -> None:
        self.df.unpersist()


def _sheets(book: zipfile.ZipFile) -> dict[str, str]:
    """Names of sheets and of their parts, in order."""
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    found = {}
    for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
        target = targets[sheet.get(f"{_REL}id")]
        found[sheet.get("name")] = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    return found


def _text(node: ElementTree.Element) -> str:
    """Text of a string item, of its runs too but not of phonetic hints."""
    return "".join(t.text or "" for part in node if part.tag != f"{_MAIN}rPh" for t in part.iter(f"{_MAIN}t"))


def _column(reference: str) -> int:
    out = 0
    for letter in re.match(r"[A-Z]+", reference)[0]:
        out = 26 * out + ord(letter) - 64
    return out - 1


def _shared(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    with book.open("xl/sharedStrings.xml") as part:
        for _, node in ElementTree.iterparse(part):
            if node.tag == f"{_MAIN}si":
                out.append(_text(node))
                node.clear()
    return out


def _part(book: zipfile.ZipFile, sheet: str | None) -> str | None:
    sheets = _sheets(book)
    return next(iter(sheets.values())) if sheet is None else sheets.get(sheet)


def sheets_of(file: BinaryIO) -> list[str]:
    """Names of a workbook's sheets, in order."""
    with zipfile.ZipFile(file) as book:
        return list(_sheets(book))


def cells_of(file: BinaryIO, sheet: str | None) -> Iterator[tuple[int, list[dict | None]]]:
    """(row number, cells) from the first row to the last that holds something; kinds: n number, b boolean, s text.
    Rows are parsed as they are asked for. None of a workbook without the sheet."""
    with zipfile.ZipFile(file) as book:
        if (name := _part(book, sheet)) is None:
            return
        shared, last, number, table = _shared(book), 0, 0, None
        with book.open(name) as part:
            for event, node in ElementTree.iterparse(part, ("start", "end")):
                if event == "start":
                    table = node if node.tag == f"{_MAIN}sheetData" else table
                    continue
                if node.tag != f"{_MAIN}row":
                    continue
                number, cells = int(node.get("r", number + 1)), []
                for cell in node.iter(f"{_MAIN}c"):
                    at = _column(cell.get("r")) if cell.get("r") else len(cells)
                    kind, value = cell.get("t", "n"), cell.find(f"{_MAIN}v")
                    text = None if value is None else value.text
                    if kind == "s" and text is not None:
                        text = shared[int(text)]
                    elif kind == "inlineStr":
                        text = _text(cell.find(f"{_MAIN}is"))
                    elif kind == "e":
                        text = None
                    cells += [None] * (at + 1 - len(cells))
                    if text is not None and text.strip() not in MISSING:
                        cells[at] = {"text": text, "kind": kind if kind in "nb" else "s"}
                table.clear()  # what has been parsed
                if any(cells):
                    yield from ((blank, []) for blank in range(last + 1, number))
                    yield number, cells
                    last = number


def described(file: BinaryIO, sheet: str | None, header_row: int) -> tuple[list[dict | None], list[str]] | None:
    """The cells of the header row and, for each column, the kinds of the cells below it, as b, n and s in this order. None
    of a workbook without the sheet."""
    with zipfile.ZipFile(file) as book:
        if _part(book, sheet) is None:
            return None
    head, kinds = [], []
    for number, cells in cells_of(file, sheet):
        if number == header_row:
            head, kinds = cells, [set() for _ in cells]
        elif number > header_row:
            for found, cell in zip(kinds, cells, strict=False):
                if cell:
                    found.add(cell["kind"])
    return head, ["".join(sorted(k)) for k in kinds]


def refuse_old_format(path: str) -> None:
    if str(path).lower().endswith(".xls"):
        raise ValueError("the old binary format .xls can't be read; save the workbook as .xlsx")


CELL = pa.struct([("text", pa.string()), ("kind", pa.string())])
_DDL = {pa.string(): "string", pa.int64(): "bigint", pa.bool_(): "boolean", pa.list_(pa.string()): "array<string>", pa.list_(CELL): "array<struct<text: string, kind: string>>"}


def _parsed(spark: SparkSession, path: str, rows_of: Callable[[BinaryIO], Iterable[dict]], **fields: pa.DataType) -> DataFrame:
    """path and the fields that rows_of gives of each workbook, a batch of rows at a time."""
    refuse_old_format(path)
    types = pa.schema({"path": pa.string(), **fields})

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                for rows in batched(rows_of(BytesIO(content.as_buffer())), BATCH_ROWS, strict=False):
                    yield pa.RecordBatch.from_pylist([{"path": path.as_py(), **row} for row in rows], types)

    return spark.read.format("binaryFile").load(str(path)).select("path", "content").mapInArrow(each, ", ".join(f"{f.name} {_DDL[f.type]}" for f in types))


def sheet_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the sheets of the first workbook at path."""
    return list(_parsed(spark, path, lambda file: [{"names": sheets_of(file)}], names=pa.list_(pa.string())).orderBy("path").first()["names"])


def read_rows(spark: SparkSession, path: str, sheet: str | None = None, optional: bool = False) -> DataFrame:
    """path, _row and cells (array of text and kind) of a sheet, by default the first, of every workbook at
    path. A workbook without the sheet is an error, or if it is optional has no rows."""
    if sheet is not None and not optional:
        names = _parsed(spark, path, lambda file: [{"names": sheets_of(file)}], names=pa.list_(pa.string()))
        if lacks := names.where(~F.array_contains("names", sheet)).orderBy("path").first():
            raise SheetNotFound(f"no sheet {sheet!r} in {lacks['path']}; there are {list(lacks['names'])}")
    return _parsed(spark, path, lambda file: ({"_row": row, "cells": cells} for row, cells in cells_of(file, sheet)), _row=pa.int64(), cells=pa.list_(CELL))


def read_headers(spark: SparkSession, path: str, sheet: str | None = None, header_row: int = 1) -> DataFrame:
    """path and cells (array of text and kind) of the header row of every workbook at path: a row for each, whose cells are null where
    there is no such sheet. No row below the headers is parsed."""

    def head(file: BinaryIO) -> list[dict]:
        with zipfile.ZipFile(file) as book:
            if _part(book, sheet) is None:
                return [{"cells": None}]
        return [{"cells": next((cells for row, cells in cells_of(file, sheet) if row == header_row), [])}]

    return _parsed(spark, path, head, cells=pa.list_(CELL))


def headers_and_names(cells: Sequence) -> tuple[list[object], list[str]]:
    """The headers as the sheet has them, and a name for each column: no two alike, nor like a column that the reader adds.
    A header that stands again gets the next number behind it that makes no other header."""
    headers = [f"Unnamed: {i}" if cell is None else float(cell["text"]) if cell["kind"] == "n" else cell["text"] for i, cell in enumerate(cells)]
    plain = [str(int(h)) if isinstance(h, float) and h.is_integer() else str(h) for h in headers]
    names, taken, again = [], {PATH, ROW, *plain}, {PATH: 1, ROW: 1}
    for name in plain:
        number = again.get(name, 0)
        while number and f"{name}.{number}" in taken:
            number += 1
        again[name] = number + 1
        names.append(f"{name}.{number}" if number else name)
        taken.add(names[-1])
    return headers, names


def read_sheet(spark: SparkSession, path: str, sheet: str | None = None, header_row: int = 1) -> Sheet:
    """A sheet whose headers stand in header_row, with the rows below it.

    A column of numbers is double, one of booleans boolean; one with any text is string, and beside it
    stands a column with the kind of each cell. Spark keeps no order: _row is the row of the sheet. Several
    workbooks at path are one table if their headers are the same; else that is an error. One pass over the
    workbooks, which brings a row for each to the next step, finds headers and kinds.
    """

    def describe(file: BinaryIO) -> list[dict]:
        found = described(file, sheet, header_row)
        return [{"there": found is not None, "names": sheets_of(file), "head": found and found[0], "kinds": found and found[1]}]

    books = _parsed(spark, path, describe, there=pa.bool_(), names=pa.list_(pa.string()), head=pa.list_(CELL), kinds=pa.list_(pa.string())).persist()
    try:
        if lacks := books.where("not there").orderBy("path").first():
            raise SheetNotFound(f"no sheet {sheet!r} in {lacks['path']}; there are {list(lacks['names'])}")
        heads = books.groupBy("head").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("n")).orderBy("path").limit(2).collect()
        if len(heads) > 1:
            raise ValueError(f"workbooks at {path} have different headers: " + " and ".join(h["path"] for h in heads))
        each = books.select(F.posexplode("kinds").alias("at", "kinds")).groupBy("at").agg(F.array_join(F.collect_set("kinds"), "").alias("kinds")).collect()  # a row a column
    finally:
        books.unpersist()
    headers, names = headers_and_names(heads[0]["head"] if heads else [])
    kinds = {r["at"]: set(r["kinds"]) for r in each}
    cell = lambda i, part: F.get("cells", F.lit(i))[part]
    columns = []
    for i, name in enumerate(names):
        if "s" in kinds[i]:
            columns += [cell(i, "text").alias(name), cell(i, "kind").alias(KIND + name)]
        elif kinds[i] == {"b"}:
            columns.append((cell(i, "text") == "1").alias(name))
        else:
            columns.append(cell(i, "text").try_cast("double").alias(name))
    several = [F.col("path").alias(PATH)] if heads and heads[0]["n"] > 1 else []
    return Sheet(read_rows(spark, path, sheet, optional=True).where(F.col(ROW) > header_row).select(*several, ROW, *columns), headers, names)


def cell_xml(value: object) -> str:
    """A cell; it has no reference, so it is the next of its row."""
    if value is None or value != value:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)) and abs(value) != float("inf"):
        return f"<c><v>{value!r}</v></c>"
    text = escape(re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]", "", str(value)), {"\r": "&#13;"})
    return f'<c t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>'


def row_xml(values: Iterable[object]) -> str:
    return f"<row>{''.join(map(cell_xml, values))}</row>"


_XML = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
#: What stands before and after the rows of a sheet.
SHEET_HEAD, SHEET_TAIL = f'{_XML}<worksheet xmlns="{_MAIN.strip("{}")}"><sheetData>', "</sheetData></worksheet>"


def sheet_part(number: int) -> str:
    """The name of a workbook's part for its sheet of that number, from 1."""
    return f"xl/worksheets/sheet{number}.xml"


def book_parts(names: Sequence[str]) -> list[tuple[str, str]]:
    """The parts of a workbook of sheets of these names, but for the sheets themselves."""
    main, office = _MAIN.strip("{}"), _REL.strip("{}")
    package = "http://schemas.openxmlformats.org/package/2006"
    kinds = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    sheets = list(enumerate(names, 1))
    parts = "".join(f'<Override PartName="/{sheet_part(n)}" ContentType="{kinds}.worksheet+xml"/>' for n, _ in sheets)
    listed = "".join(f'<sheet name={quoteattr(name)} sheetId="{n}" r:id="rId{n}"/>' for n, name in sheets)
    links = "".join(f'<Relationship Id="rId{n}" Type="{office}/worksheet" Target="worksheets/sheet{n}.xml"/>' for n, _ in sheets)
    return [
        ("[Content_Types].xml", f'{_XML}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kinds}.sheet.main+xml"/>{parts}</Types>'),
        ("_rels/.rels", f'{_XML}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>'),
        ("xl/workbook.xml", f'{_XML}<workbook xmlns="{main}" xmlns:r="{office}"><sheets>{listed}</sheets></workbook>'),
        ("xl/_rels/workbook.xml.rels", f'{_XML}<Relationships xmlns="{package}/relationships">{links}</Relationships>'),
    ]


def write_xlsx(file: str | BinaryIO, sheets: Sequence[tuple[str, Sequence[str], Iterable[Sequence[object]]]]) -> None:
    """A workbook of (name, headers, rows) sheets, whose rows the caller has; rows are streamed. A sheet can't hold
    more than MAX_ROWS."""
    with zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as book:
        for name, xml in book_parts([name for name, _, _ in sheets]):
            book.writestr(name, xml)
        for n, (name, headers, rows) in enumerate(sheets, 1):
            with book.open(sheet_part(n), "w") as part:
                part.write(SHEET_HEAD.encode())
                for r, row in enumerate(chain([headers], rows), 1):
                    if r > MAX_ROWS:
                        raise too_many_rows(name)
                    part.write(row_xml(row).encode())
                part.write(SHEET_TAIL.encode())


def too_many_rows(name: str) -> ValueError:
    return ValueError(f"sheet {name} has more than {MAX_ROWS} rows; write its table as Parquet")
