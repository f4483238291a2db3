"""Column functions; all are built-in expressions, so they stay within whole-stage code generation."""

from growthlab.functions.calculators import bmi, bmi_category, bmi_error, dilution, dilution_error
from growthlab.functions.cells import day_of_column, header_day, missing_to_null, normalized_id, number
from growthlab.functions.growth import change, classify_response, percent_growth, responder_percent
from growthlab.functions.register import register_functions
from growthlab.functions.stats import mean, sd, sem
from growthlab.functions.volume import tumor_volume, tumor_volume_strict

__all__ = [
    "bmi", "bmi_category", "bmi_error", "change", "classify_response", "day_of_column", "dilution", "dilution_error", "header_day", "mean", "missing_to_null",
    "normalized_id", "number", "percent_growth", "register_functions", "responder_percent", "sd", "sem", "tumor_volume", "tumor_volume_strict",
]
