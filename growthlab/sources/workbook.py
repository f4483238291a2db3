"""Workbooks written by Spark: executors write the rows of each sheet as XML, and the driver joins the parts.

Rows become XML within the plan, sorted by range, and Spark's own committer keeps only what finished tasks wrote. The driver's JVM
copies the parts, in the order of tasks, into one archive beside the workbook's place, and renames it: no row passes through
Python, no sheet stands in memory, and a job that fails leaves nothing. Rows are counted as they are written.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from pathlib import Path
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from growthlab.sources.files import staging
from growthlab.sources.xlsx import MAX_ROWS, SHEET_HEAD, SHEET_TAIL, book_parts, row_xml, sheet_part, too_many_rows

#: Characters that XML can't hold.
_NO_XML = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{FFFE}\x{FFFF}]"


@dataclass(frozen=True)
class Tab:
    """A sheet to be: its name, and the table whose columns it takes, by their places, under these headers. order: columns of the
    table to sort by; instead: headers and a row for a table without rows; marked: a column whose texts that aren't empty are counted; above: rows over the headers, such as a title. No headers: rows alone."""

    name: str
    table: DataFrame
    headers: dict[int, str]
    order: Sequence[str]
    instead: tuple[list[str], list[object]] | None = None
    marked: str | None = None
    above: Sequence[Sequence[object]] = ()
    with_headers: bool = True


class Counts(NamedTuple):
    """Rows of a sheet below its headers, and those of them that are marked."""

    rows: int
    marked: int


def _cell(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BooleanType):
        xml = F.concat(F.lit('<c t="b"><v>'), value.cast("int").cast("string"), F.lit("</v></c>"))
    elif isinstance(kind, T.NumericType):
        text = value.cast("string")
        infinite = F.concat(F.lit('<c t="inlineStr"><is><t>'), F.when(value.cast("double") > 0, "inf").otherwise("-inf"), F.lit("</t></is></c>"))
        xml = F.when(F.isnan(value.cast("double")), None).when(F.abs(value.cast("double")) == float("inf"), infinite).otherwise(F.concat(F.lit("<c><v>"), text, F.lit("</v></c>")))
    else:
        marks = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#13;"))
        text = reduce(lambda t, m: F.replace(t, F.lit(m[0]), F.lit(m[1])), marks, F.regexp_replace(value.cast("string"), _NO_XML, ""))
        xml = F.concat(F.lit('<c t="inlineStr"><is><t xml:space="preserve">'), text, F.lit("</t></is></c>"))
    return F.coalesce(xml, F.lit("<c/>"))


def _lines(tab: Tab, seen: Observation) -> DataFrame:
    """A line of XML for each row, in order. Rows are counted after the sort, as the last stage writes them."""
    names = [f"c{i}" for i in range(len(tab.table.columns))]
    by_place = tab.table.toDF(*names)  # no two names of a sheet need differ by more than case
    kinds = [f.dataType for f in by_place.schema]
    named = lambda c: names[tab.table.columns.index(c)]
    marked = F.col(named(tab.marked)) != "" if tab.marked else F.lit(False)
    row = F.concat(F.lit("<row>"), *(_cell(F.col(names[i]), kinds[i]) for i in tab.headers), F.lit("</row>"))
    ordered = by_place.orderBy(*map(named, tab.order)) if tab.order else by_place
    return ordered.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(marked).alias("marked")).select(row.alias("value"))


def write_workbook(spark: SparkSession, path: str | Path, tabs: Sequence[Tab]) -> list[Counts]:
    """A workbook of these sheets, in place of an older one, and the counts of each. One job for each sheet."""
    with staging(spark, path) as stage:
        files, counts = stage.files, []
        for n, tab in enumerate(tabs):
            seen = Observation()
            _lines(tab, seen).write.text(f"{stage.folder}/{n}")
            counts.append(Counts(*(seen.get.get(c) or 0 for c in Counts._fields)))
            if counts[-1].rows + len(tab.above) + tab.with_headers > MAX_ROWS:
                raise too_many_rows(tab.name)
        book = f"{stage.folder}/book"
        out = files.jvm.java.util.zip.ZipOutputStream(files.system.create(files.at(book)))
        try:
            def part(name: str, text: str) -> None:
                out.putNextEntry(files.jvm.java.util.zip.ZipEntry(name))
                out.write(bytearray(text.encode()))

            for name, text in book_parts([tab.name for tab in tabs]):
                part(name, text)
            for n, (tab, count) in enumerate(zip(tabs, counts, strict=True)):
                headers, rows = (list(tab.headers.values()), []) if count.rows or not tab.instead else (tab.instead[0], [tab.instead[1]])
                top = [*tab.above, *([headers] if tab.with_headers else []), *rows]
                part(sheet_part(n + 1), SHEET_HEAD + "".join(map(row_xml, top)))
                for file in files.parts(f"{stage.folder}/{n}"):
                    files.append(file, out)
                out.write(bytearray(SHEET_TAIL.encode()))
        finally:
            out.close()
        files.move(book, path)
    return counts
