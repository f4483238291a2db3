"""Workbooks as a data source of Spark: ``format("xlsx")``, after ``register(spark)``.

Options for reading: ``sheet`` (by default the first) and ``header_row`` (1). There is one partition for each workbook, which a task
parses in batches of rows. Without a schema the workbooks are looked through for headers and kinds of cells as the query is
planned; a given schema spares that: its columns are found by their headers, and ``_row``, ``_path`` and ``_kind_`` with a header are
the row of the sheet, the workbook and the kind of each cell. For writing: ``sheet``, the name of the one sheet. Tasks write
rows as XML into a hidden folder, and the commit joins the parts of those that finished into one workbook, in the order of
partitions: sort the rows before. ``_row``, ``_path`` and kinds are left out.

Files are opened by pyarrow: local ones and file:, hdfs:, s3: and gs: URLs. ``read_sheet`` and ``write_workbook`` reach whatever Spark itself
reaches.
"""

from __future__ import annotations

import os
import re
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from fnmatch import fnmatchcase
from itertools import batched

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import BooleanType, DataType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType

from growthlab.operators.annotate import KIND
from growthlab.sources.xlsx import BATCH_ROWS, MAX_ROWS, PATH, ROW, SHEET_HEAD, SHEET_TAIL, SheetNotFound, book_parts, cells_of, described, headers_and_names, refuse_old_format, row_xml, sheet_part, sheets_of, too_many_rows

_TYPES = {StringType(): pa.string(), DoubleType(): pa.float64(), FloatType(): pa.float32(), LongType(): pa.int64(), IntegerType(): pa.int32(), BooleanType(): pa.bool_()}


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"(?!file:)[A-Za-z][A-Za-z0-9+.-]*://", path):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(re.sub("^file:/*(?=/)", "", path))


def _workbooks(path: str) -> list[str]:
    """The workbooks at a path: a file, those in a folder, or those whose names fit a pattern."""
    refuse_old_format(path)
    system, place = _opened(path)
    prefix = path.rpartition("/")[0] if re.match(r"(?!file:)[A-Za-z][A-Za-z0-9+.-]*://", path) else None
    kind = system.get_file_info(place).type
    if kind == fs.FileType.File:
        return [path]
    folder, pattern = (place, "*.xlsx") if kind == fs.FileType.Directory else place.rsplit("/", 1)
    names = sorted(f.path for f in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if f.type == fs.FileType.File and fnmatchcase(f.base_name, pattern) and f.base_name[0] not in "._")
    if not names:
        raise FileNotFoundError(f"no workbook at {path}")
    if prefix is None:
        return names
    return [f"{path.rstrip('/') if kind == fs.FileType.Directory else prefix}/{name.rpartition('/')[2]}" for name in names]


def _described(path: str, sheet: str | None, header_row: int) -> tuple[list, list[str]]:
    system, place = _opened(path)
    with system.open_input_file(place) as file:
        if (found := described(file, sheet, header_row)) is None:
            raise SheetNotFound(f"no sheet {sheet!r} in {path}; there are {sheets_of(file)}")
    return found


def _inferred(paths: Sequence[str], sheet: str | None, header_row: int) -> StructType:
    """The schema of the workbooks' rows; different headers are an error."""
    head, kinds = _described(paths[0], sheet, header_row)
    for path in paths[1:]:
        other, more = _described(path, sheet, header_row)
        if other != head:
            raise ValueError(f"workbooks have different headers: {paths[0]} and {path}")
        kinds = [a + b for a, b in zip(kinds, more, strict=True)]
    fields = [StructField(PATH, StringType())] if len(paths) > 1 else []
    fields.append(StructField(ROW, LongType()))
    for name, kind in zip(headers_and_names(head)[1], kinds, strict=True):
        if "s" in kind:
            fields += [StructField(name, StringType()), StructField(KIND + name, StringType())]
        else:
            fields.append(StructField(name, BooleanType() if set(kind) == {"b"} else DoubleType()))
    return StructType(fields)


def _value(cell: dict | None, kind: DataType) -> object:
    """A cell as a value of the column's type; null where it is none."""
    if cell is None:
        return None
    text = cell["text"]
    if isinstance(kind, StringType):
        return text
    if isinstance(kind, BooleanType):
        return text == "1" if cell["kind"] == "b" else None
    try:
        number = float(text)
    except ValueError:
        return None
    return number if isinstance(kind, (DoubleType, FloatType)) else int(number) if number.is_integer() else None


@dataclass
class Workbook(InputPartition):
    path: str


class XlsxReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.sheet, self.header_row, self.schema = options["path"], options.get("sheet"), int(options.get("header_row", 1)), schema
        if wrong := [f.name for f in schema if f.dataType not in _TYPES]:
            raise ValueError(f"columns of a type that a cell can't have: {wrong}")

    def partitions(self) -> Sequence[InputPartition]:
        return [Workbook(path) for path in _workbooks(self.path)]

    def read(self, partition: Workbook) -> Iterator[pa.RecordBatch]:
        types = pa.schema([(f.name, _TYPES[f.dataType]) for f in self.schema])
        system, place = _opened(partition.path)
        with system.open_input_file(place) as file:
            rows = cells_of(file, self.sheet)
            head = next((cells for number, cells in rows if number == self.header_row), None)
            if head is None and self.sheet is not None and self.sheet not in sheets_of(file):
                raise SheetNotFound(f"no sheet {self.sheet!r} in {partition.path}; there are {sheets_of(file)}")
            at = {name: i for i, name in enumerate(headers_and_names(head or [])[1])}
            own = {ROW, PATH, *at, *(KIND + name for name in at)}
            if lacks := [f.name for f in self.schema if f.name not in own]:
                raise ValueError(f"no columns {lacks} in {partition.path}; there are {list(at)}")
            for batch in batched(rows, BATCH_ROWS, strict=False):
                yield pa.RecordBatch.from_arrays([pa.array(self._column(f, at, batch, partition.path), t.type) for f, t in zip(self.schema, types, strict=True)], schema=types)

    @staticmethod
    def _column(field: StructField, at: dict[str, int], rows: Sequence, path: str) -> list:
        name = field.name
        if name in at:
            i = at[name]
            return [_value(cells[i] if i < len(cells) else None, field.dataType) for _, cells in rows]
        if name == ROW:
            return [number for number, _ in rows]
        if name == PATH:
            return [path] * len(rows)
        i = at[name.removeprefix(KIND)]
        return [cells[i] and cells[i]["kind"] if i < len(cells) else None for _, cells in rows]


@dataclass
class Part(WriterCommitMessage):
    number: int
    path: str
    rows: int


class XlsxWriter(DataSourceWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.path, self.sheet, self.overwrite = options["path"], options.get("sheet", "Sheet1"), overwrite
        self.at = [i for i, name in enumerate(schema.names) if name not in (ROW, PATH) and not name.startswith(KIND)]
        self.headers = [schema.names[i] for i in self.at]
        folder, slash, name = self.path.rpartition("/")
        self.staged = f"{folder}{slash}.{name}-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        from pyspark import TaskContext

        number, rows = TaskContext.get().partitionId(), 0
        system, folder = _opened(self.staged)
        system.create_dir(folder)
        path = f"{folder}/{number}-{uuid.uuid4().hex}"
        with system.open_output_stream(path) as out:
            for row in iterator:
                out.write(row_xml(row[i] for i in self.at).encode())
                rows += 1
        return Part(number, path, rows)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        parts = sorted((m for m in messages if m), key=lambda m: m.number)
        system, place = _opened(self.path)
        try:
            if sum(p.rows for p in parts) >= MAX_ROWS:
                raise too_many_rows(self.sheet)
            if not self.overwrite and system.get_file_info(place).type != fs.FileType.NotFound:
                raise FileExistsError(f"there is a workbook at {self.path}; rows can't be added to one, but mode overwrite replaces it")
            folder = _opened(self.staged)[1]
            system.create_dir(folder)
            with system.open_output_stream(f"{folder}/book") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
                for name, xml in book_parts([self.sheet]):
                    book.writestr(name, xml)
                with book.open(sheet_part(1), "w") as sheet:
                    sheet.write((SHEET_HEAD + row_xml(self.headers)).encode())
                    for part in parts:
                        with system.open_input_stream(part.path) as own:
                            while data := own.read(1 << 20):
                                sheet.write(data)
                    sheet.write(SHEET_TAIL.encode())
            system.move(f"{folder}/book", place)
        finally:
            self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, folder = _opened(self.staged)
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)


class XlsxDataSource(DataSource):
    """``spark.read.format("xlsx")`` and ``df.write.format("xlsx")``."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> StructType:
        return _inferred(_workbooks(self.options["path"]), self.options.get("sheet"), int(self.options.get("header_row", 1)))

    def reader(self, schema: StructType) -> XlsxReader:
        return XlsxReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> XlsxWriter:
        return XlsxWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    """Makes format("xlsx") known to a session."""
    spark.dataSource.register(XlsxDataSource)
