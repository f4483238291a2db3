"""Cells of a sheet: missing values, numbers, ids, and days in headers."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Text that counts as a number. Spark's own cast also takes a type suffix, as in 12d.
NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
#: Of those, whole numbers that are exact beyond a double's 53 bits.
WHOLE = r"^[+-]?[0-9]{1,18}$"
INFINITE = r"(?i)^[+-]?inf(inity)?$"


def missing_to_null(value: Column) -> Column:
    """NaN is a missing value."""
    return F.when(~F.isnan(value), value)


def number(text: Column) -> Column:
    """A cell as a double; text that is no number is missing."""
    trimmed = F.trim(text.cast("string"))
    infinite = F.when(trimmed.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(trimmed.rlike(NUMBER), trimmed.try_cast("double")).when(trimmed.rlike(INFINITE), infinite)


def normalized_id(value: Column) -> Column:
    """28, 28.0, "28" and "028" are one id, 28; other numbers are written as doubles, other text is trimmed."""
    text = F.trim(value.cast("string"))
    x = text.try_cast("double")
    whole = (F.floor(x) == x) & (F.abs(x) < 2.0**63)
    return (  # in this order most ids cost one search
        F.when(value.cast("string").isNull() | (text == "NaN"), F.lit(None))
        .when(text.rlike(WHOLE), text.try_cast("bigint").cast("string"))
        .when(~text.rlike(NUMBER), text)
        .when(whole, x.try_cast("bigint").cast("string"))
        .otherwise(x.cast("string"))
    )


def header_day(text: Column, kind: Column) -> Column:
    """``day_of_column`` of a header's cell, as a column; kind: n for a number. Days beyond 18 digits are none."""
    x = text.try_cast("double")
    spelt = F.regexp_extract(F.replace(F.lower(text), F.lit("day"), F.lit("")), r"(?U)^\s*(-?[0-9]{1,18})\s*$", 1)
    return F.when(kind == "n", F.when(F.abs(x) < 1e18, x.cast("bigint"))).otherwise(spelt.try_cast("bigint"))


def day_of_column(name: object) -> int | None:
    """The day that a header names: a number (its whole part), or text such as "3", "Day 3" or "-1"; else None."""
    if isinstance(name, (int, float)) and not isinstance(name, bool):
        return int(name) if math.isfinite(name) else None
    text = str(name).lower().replace("day", "").strip()
    return int(text) if re.fullmatch(r"-?[0-9]+", text) else None
