"""Aggregates that are defined for one value too."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Values of at most ten places behind the point, and eighteen before it, are summed exactly.
EXACT = "decimal(28,10)"


def mean(value: str) -> Column:
    """Mean of a column of doubles; null for no value. Where all values are short decimals, as measurements are, their sum is exact
    and rounded once, so no order of rows or partitions changes the mean. Others are summed as doubles."""
    exact = F.col(value).try_cast(EXACT)
    short = F.count_if(exact.cast("double") == F.col(value)) == F.count(value)
    return F.coalesce(F.when(short, F.try_divide(F.try_sum(exact).cast("double"), F.count(value))), F.avg(value))


def sd(value: str) -> Column:
    """Sample standard deviation; 0 for one value, null for none."""
    return F.when(F.count(value) == 1, F.lit(0.0)).otherwise(F.stddev_samp(value))


def sem(value: str) -> Column:
    """Standard error of the mean; 0 for one value, null for none."""
    n = F.count(value)
    return F.when(n == 1, F.lit(0.0)).when(n > 1, F.stddev_samp(value) / F.sqrt(n))
