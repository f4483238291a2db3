"""From a wide sheet as read to clean rows: grp, mouse and a double for each day."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from growthlab.functions import day_of_column, header_day, normalized_id, number

BASELINE_DAY = 0
#: The columns that a sheet has beside its days.
REQUIRED = ("Group", "mouse")
_NO_BASELINE = "Missing required Day 0 column."
#: Excluded ids beyond so many are joined and not listed in the filter.
LISTED_IDS = 1000


class GrowthError(Exception):
    """The sheet can't be analysed."""


class MissingColumns(GrowthError, ValueError):
    """Required columns are not there."""


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    """Case-sensitive, unlike Spark's own resolution."""
    if missing := sorted(set(names) - set(df.columns)):
        raise MissingColumns(f"Missing required columns: {missing}")


def header_issues(headers: DataFrame, required: Iterable[str] = REQUIRED) -> DataFrame:
    """headers with issue in place of cells: why a sheet with such headers can't be analysed, as the analysis itself would say; null if
    it can. cells: an array of text and kind (n: a number), null where there is no sheet. Any number of sheets is looked at in one
    pass, and none stops the others."""
    cells, own = F.col("cells"), [c for c in headers.columns if c != "cells"]
    there = lambda name: F.coalesce(F.exists(cells, lambda c: c["text"] == name), F.lit(False))
    missing = F.concat_ws(", ", *(F.when(~there(name), F.lit(repr(name))) for name in sorted(set(required))))
    baseline = F.coalesce(F.exists(cells, lambda c: header_day(c["text"], c["kind"]) == BASELINE_DAY), F.lit(False))
    issue = (
        F.when(cells.isNull(), F.lit("Missing sheet."))
        .when(missing != "", F.concat(F.lit("Missing required columns: ["), missing, F.lit("]")))
        .when(~baseline, F.lit(_NO_BASELINE))
    )
    return headers.select(*own, issue.alias("issue"))


def by_place(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns named by their places, and the new name of each old one: names that differ by case only, or that
    an operator uses itself, can't clash. Of columns of the very same name the first is meant."""
    names = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*names), dict(reversed(list(zip(df.columns, names, strict=True))))


def day_columns(headers: Sequence[object], names: Sequence[str] | None = None) -> list[tuple[int, str]]:
    """(day, column name) by day. Of two columns for a day the last counts; a column for day 0 is required.

    headers: as the sheet has them, numbers or text; names: the DataFrame's names for them.
    """
    found = {day: name for header, name in zip(headers, names or headers, strict=True) if (day := day_of_column(header)) is not None}
    if BASELINE_DAY not in found:
        raise GrowthError(_NO_BASELINE)
    return sorted(found.items())


def clean_wide(df: DataFrame, days: Sequence[tuple[int, str]], excluded: Sequence[str | None] = ()) -> DataFrame:
    """_path and _row (if there), grp, mouse and one double for each day, named by it. Rows without group or id and excluded
    ids go. Names are case-sensitive: columns whose names differ by case only are columns of their own.

    excluded: normalised ids; nulls among them are ignored.
    """
    require_columns(df, [*REQUIRED, *(name for _, name in days)])
    placed, at = by_place(df)
    cell = lambda name: F.col(at[name])
    rows = placed.dropna("any", subset=[at["Group"], at["mouse"]])
    text = cell("Group").cast("string")
    group = F.trim(F.when(text.rlike(r"^-?[0-9]+[.]0$"), F.regexp_replace(text, r"[.]0$", "")).otherwise(text))
    own = [cell(c).alias(c) for c in ("_path", "_row") if c in at]
    values = [number(cell(name)).alias(str(day)) for day, name in days]
    clean = rows.select(*own, group.alias("grp"), normalized_id(cell("mouse")).alias("mouse"), *values)
    return exclude(clean, excluded)


def exclude(df: DataFrame, excluded: Sequence[str | None]) -> DataFrame:
    """df without the rows of the given ids."""
    ids = sorted({x for x in excluded if x is not None})
    if len(ids) <= LISTED_IDS:
        return df.where(~F.col("mouse").isin(ids)) if ids else df
    return df.join(df.sparkSession.createDataFrame([(x,) for x in ids], "mouse string"), "mouse", "left_anti")


def exclude_by_book(wide: DataFrame, excluded: DataFrame) -> DataFrame:
    """wide without the rows that excluded (_path, mouse: normalised) names for their own workbook."""
    return wide.join(excluded.distinct(), ["_path", "mouse"], "left_anti").select(*wide.columns)
