"""Operators: DataFrame in, DataFrame out. Columns: grp, mouse, day, tv; _row is a sheet's row."""

from growthlab.operators.annotate import annotate_volume, any_error
from growthlab.operators.clean import REQUIRED, GrowthError, MissingColumns, by_place, clean_wide, day_columns, exclude, exclude_by_book, header_issues, require_columns
from growthlab.operators.growth import (
    general_summary, growth_and_errors, growth_from_long, growth_from_wide, growth_states, means_in_order, merged_states, outcome_counts, outcomes_from_long,
    outcomes_from_states, outcomes_from_wide, responder_tv_summary, responder_tv_summary_from_wide, response_summary, to_long,
)

__all__ = [
    "REQUIRED", "GrowthError", "MissingColumns", "annotate_volume", "any_error", "by_place", "clean_wide", "day_columns", "exclude", "exclude_by_book", "general_summary", "growth_and_errors",
    "growth_from_long", "growth_from_wide", "growth_states", "header_issues", "means_in_order", "merged_states", "outcome_counts", "outcomes_from_long", "outcomes_from_states", "outcomes_from_wide",
    "require_columns", "responder_tv_summary", "responder_tv_summary_from_wide", "response_summary", "to_long",
]
