"""Whole analyses, from a workbook to a report."""

from growthlab.plans.analysis import Manifest, analyze, annotate_workbook, read_experiment, read_experiments, read_growth, read_growths, sheet_issues, tables
from growthlab.plans.experiment import ExperimentConfig, excluded_by_book, experiment_of, settings, settings_of_books, with_thresholds

__all__ = [
    "ExperimentConfig", "Manifest", "analyze", "annotate_workbook", "excluded_by_book", "experiment_of", "read_experiment", "read_experiments", "read_growth", "read_growths",
    "settings", "settings_of_books", "sheet_issues", "tables", "with_thresholds",
]
