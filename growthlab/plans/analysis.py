"""The longitudinal analysis and the annotation of workbooks."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from growthlab.functions import normalized_id
from growthlab.operators import REQUIRED, annotate_volume, clean_wide, day_columns, exclude, exclude_by_book, general_summary, growth_and_errors, header_issues, outcomes_from_wide, require_columns, responder_tv_summary_from_wide, response_summary, to_long
from growthlab.plans.experiment import ExperimentConfig, excluded_by_book, experiment_of, settings_of_books, with_thresholds
from growthlab.sources import SheetNotFound, annotated_path, bar_chart, line_chart, read_headers, read_rows, read_sheet, within, write_annotated, write_report, write_text

TV_SHEET, EXPERIMENT_SHEET = "TV", "experiment data"
TV_HEADER_ROW = 2
#: Most points of a chart: what may come to the driver to be drawn. More are an error.
MAX_POINTS = 100_000


@dataclass(frozen=True)
class Manifest:
    """What an analysis made: paths, or URLs as text. A chart's path is given also where there was nothing to draw."""

    output_excel: Path | str
    mean_tv_graph: Path | str
    responder_graph: Path | str
    num_mice_analyzed: int
    num_errors: int


def _points(rows: DataFrame, what: str) -> list:
    found = rows.limit(MAX_POINTS + 1).collect()
    if len(found) > MAX_POINTS:
        raise ValueError(f"{what} has more than {MAX_POINTS} points")
    return found


def read_experiment(spark: SparkSession, path: str) -> ExperimentConfig:
    """The settings of a workbook; the defaults where it has no sheet for them."""
    try:
        rows = read_rows(spark, path, EXPERIMENT_SHEET)
    except SheetNotFound:
        return ExperimentConfig()
    return experiment_of(rows)


def read_experiments(spark: SparkSession, path: str) -> DataFrame:
    """_path, control_group, threshold and excluded of each workbook at path that has a sheet for settings."""
    return settings_of_books(read_rows(spark, path, EXPERIMENT_SHEET, optional=True))


def sheet_issues(spark: SparkSession, path: str) -> DataFrame:
    """_path and issue of each workbook at path: why its sheet of volumes can't be analysed, or null. Only headers are parsed."""
    return header_issues(read_headers(spark, path, TV_SHEET, TV_HEADER_ROW).withColumnRenamed("path", "_path"))


def _wide(spark: SparkSession, path: str) -> tuple[DataFrame, list[int]]:
    """(clean wide rows, days); the headers of sheet TV stand in its second row."""
    sheet = read_sheet(spark, path, TV_SHEET, TV_HEADER_ROW)
    require_columns(sheet.df, REQUIRED)
    days = day_columns(sheet.headers, sheet.names)
    return clean_wide(sheet.df, days), [d for d, _ in days]


def _without_excluded(wide: DataFrame, config: ExperimentConfig) -> DataFrame:
    ids = wide.sparkSession.createDataFrame([(x,) for x in config.excluded], "id string")
    return exclude(wide, [r["id"] for r in ids.select(normalized_id(F.col("id")).alias("id")).collect()]) if config.excluded else wide


def read_growth(spark: SparkSession, path: str) -> tuple[DataFrame, list[int], ExperimentConfig]:
    """(clean wide rows, days, settings) of a workbook."""
    (wide, days), config = _wide(spark, path), read_experiment(spark, path)
    return _without_excluded(wide, config), days, config


def read_growths(spark: SparkSession, path: str) -> tuple[DataFrame, list[int]]:
    """(clean wide rows with the column threshold, days) of the workbooks at path, each of which has its own settings: its
    exclusions have left its rows, and its threshold stands beside them. Of several workbooks _path tells rows apart."""
    wide, days = _wide(spark, path)
    if "_path" in wide.columns:
        config = read_experiments(spark, path)
        return with_thresholds(exclude_by_book(wide, excluded_by_book(config)), config), days
    config = read_experiment(spark, path)
    return _without_excluded(wide, config).withColumn("threshold", F.lit(float(config.threshold))), days


def tables(wide: DataFrame, days: list[int], threshold: float | Column, on_zero_baseline: str = "error") -> dict[str, DataFrame]:
    """The five tables of the report."""
    growth, errors = growth_and_errors(outcomes_from_wide(wide, days, threshold, on_zero_baseline))
    return {
        "general_summary": general_summary(to_long(wide, days)),
        "growth": growth,
        "response_summary": response_summary(growth),
        "responder_tv_summary": responder_tv_summary_from_wide(wide, days, threshold, on_zero_baseline),
        "errors": errors,
    }


def _labels(rows: list) -> list[str]:
    """A group's name, or of several workbooks the workbook's and the group's."""
    return [r["grp"] if "_path" not in r else f"{r['_path'].rpartition('/')[2]}: {r['grp']}" for r in rows]


def analyze(spark: SparkSession, path: str, output_dir: str = "output", on_zero_baseline: str = "error") -> Manifest:
    """Reads the workbooks at path, writes one report and the charts, and says what there is. Each workbook is an experiment with its own
    settings; of several the report has a column that names the workbook. Input and output may be on any file system of Spark's."""
    wide, days = read_growths(spark, path)
    wide = wide.persist()
    try:
        found = tables(wide, days, F.col("threshold"), on_zero_baseline)
        excel, lines, bars = (within(output_dir, name) for name in ("tumor_growth_results.xlsx", "mean_tumor_volume_sem.svg", "responder_percentage_by_group.svg"))
        counts = write_report(found, excel)
        book = [c for c in ("_path",) if c in wide.columns]
        means = _points(found["general_summary"].orderBy(*book, "grp", "day"), "the chart of means")
        shares = _points(found["response_summary"].orderBy(*book, "grp"), "the chart of responders")
    finally:
        wide.unpersist()
    if drawn := line_chart([(label, r["day"], r["mean_tv"], r["sem"]) for label, r in zip(_labels(means), means, strict=True)]):
        write_text(spark, lines, drawn)
    if drawn := bar_chart([(label, r["responder_percent"]) for label, r in zip(_labels(shares), shares, strict=True)]):
        write_text(spark, bars, drawn)
    return Manifest(excel, lines, bars, counts["growth"], counts["errors"])


def annotate_workbook(spark: SparkSession, path: str, dialect: str = "day04") -> tuple[Path | str, bool]:
    """(the annotated workbook beside the input, whether any row has an error). One workbook at a time: of several it could not be said
    beside which the result belongs."""
    sheet = read_sheet(spark, path)
    if "_path" in sheet.df.columns:
        raise ValueError(f"more than one workbook at {path}; annotate them one by one, or their table by annotate_volume")
    out = annotated_path(path, dialect)
    return out, write_annotated(annotate_volume(sheet.df, dialect), out) > 0
