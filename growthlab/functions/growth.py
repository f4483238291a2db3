"""Growth of one subject between its baseline and its last measurement."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_THRESHOLD = 50.0


def change(initial: Column, final: Column) -> Column:
    return final - initial


def percent_growth(initial: Column, final: Column, on_zero_baseline: str = "error") -> Column:
    """100 times the change by the baseline. A baseline of 0 fails the query, or gives null for "issue"."""
    if on_zero_baseline not in ("error", "issue"):
        raise ValueError("on_zero_baseline is error or issue")
    ratio = F.try_divide(change(initial, final), initial)
    if on_zero_baseline == "error":
        zero = F.raise_error(F.lit("Division by zero: the baseline volume is 0.")).cast("double")
        ratio = F.when(initial == 0, zero).otherwise(ratio)
    return ratio * 100


def classify_response(percent: Column, threshold: float | Column = DEFAULT_THRESHOLD) -> Column:
    """Responder up to the threshold and at it, Non-responder above, Unclassified where growth is missing."""
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    missing = percent.isNull() | F.isnan(percent)  # first: NaN is greater than any number
    return F.when(missing, "Unclassified").when(percent <= limit, "Responder").otherwise("Non-responder")


def responder_percent(responders: Column, total: Column) -> Column:
    """Percentage to two places, half to even; null for no subjects."""
    return F.bround(F.try_divide(100 * responders, total), 2)
