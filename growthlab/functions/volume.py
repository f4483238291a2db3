"""Tumour volume from two diameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tumor_volume(length: Column, width: Column) -> Column:
    """width squared times length, halved; null where a side is missing. Both are doubles without NaN."""
    return width * width * length / 2


def tumor_volume_strict(length: Column, width: Column) -> Column:
    """As tumor_volume, but a width greater than the length fails the query."""
    wrong = F.raise_error(F.lit("Width cannot be greater than length.")).cast("double")
    return F.when(width > length, wrong).otherwise(tumor_volume(length, width))
