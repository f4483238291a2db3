"""Volumes and errors beside the rows of a measurement sheet. Narrow: no shuffle, and it works on streams."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from growthlab.functions import missing_to_null, tumor_volume
from growthlab.operators.clean import by_place, require_columns

#: A text column may have a companion of this name and the column's, with the kind of each cell (n: a number).
KIND = "_kind_"


@dataclass(frozen=True)
class Dialect:
    """Names and texts of a kind of sheet. keeps: whether existing result columns are kept where a row is bad."""

    volume: str
    missing: str
    wrong_type: str | None
    too_wide: str
    keeps: bool


# The texts of both kinds of sheet.
DIALECTS = {
    "day04": Dialect("T.V.", "Missing length or width value.", "Length and width must be numbers.", "Width cannot be greater than length.", True),
    "day02": Dialect("T.V", "Missing value", None, "W > L", False),
}


def _side(df: DataFrame, at: dict[str, str], name: str) -> tuple[Column, Column]:
    """(the number or null, whether the cell holds anything)"""
    kind, column = df.schema[at[name]].dataType.typeName(), F.col(at[name])
    if kind == "string":
        is_number = F.col(at[KIND + name]) == "n" if KIND + name in at else F.lit(False)
        return missing_to_null(F.when(is_number, column.try_cast("double"))), column.isNotNull()
    value = missing_to_null(column.cast("double"))
    return value, value.isNotNull()


def annotate_volume(df: DataFrame, dialect: str = "day04") -> DataFrame:
    """df with the volume of each row's L and W, and the first error that applies to it ("": none).

    In order: a missing side; a side that isn't a number (day04; for day02 that fails the query);
    a width above the length. Names are case-sensitive: a column l beside L, or error beside Error, is a column like any
    other and stays as it is, and so does every column that isn't a result.
    """
    d = DIALECTS[dialect]
    require_columns(df, ["L", "W"])
    placed, at = by_place(df)
    (length, has_length), (width, has_width) = _side(placed, at, "L"), _side(placed, at, "W")
    wrong_type = F.lit(d.wrong_type) if d.wrong_type else F.raise_error(F.lit("L and W must be numbers")).cast("string")
    error = (
        F.when(~has_length | ~has_width, d.missing)
        .when(length.isNull() | width.isNull(), wrong_type)
        .when(width > length, d.too_wide)
        .otherwise("")
    )
    before = F.col(at[d.volume]).try_cast("double") if d.keeps and d.volume in at else F.lit(None).cast("double")
    found = placed.withColumn("error", error).withColumn("volume", F.when(F.col("error") == "", tumor_volume(length, width)).otherwise(before))
    results = {d.volume: "volume", "Error": "error"}
    if d.keeps:  # an existing column stays where it was
        places = [(n, results.get(n, c) if at[n] == c else c) for n, c in zip(df.columns, placed.columns, strict=True)]
        places += [(n, c) for n, c in results.items() if n not in at]
    else:
        places = [*((n, c) for n, c in zip(df.columns, placed.columns, strict=True) if n not in results), *results.items()]
    return found.select(*(c for _, c in places)).toDF(*(n for n, _ in places))


def any_error(annotated: DataFrame) -> DataFrame:
    """One row: has any row an error?"""
    placed, at = by_place(annotated)
    return placed.agg(F.coalesce(F.bool_or(F.col(at["Error"]) != ""), F.lit(False)).alias("errors_found"))
