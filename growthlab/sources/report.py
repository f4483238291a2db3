"""Reports: the five-sheet workbook, the same tables as Parquet, and annotated sheets."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame

from growthlab.operators.annotate import DIALECTS, KIND
from growthlab.sources.files import beside
from growthlab.sources.workbook import Tab, write_workbook
from growthlab.sources.xlsx import PATH, ROW

# Sheets in order, with the columns of each, their headers, and the order of rows.
SHEETS = (
    ("General_Summary", "general_summary", {"grp": "Group", "day": "Day", "mean_tv": "Mean TV", "sd": "SD", "n": "n", "sem": "SEM"}, ("grp", "day")),
    ("Mouse_Growth", "growth", {"grp": "Group", "mouse": "Mouse", "initial_tv": "Initial TV", "final_tv": "Final TV", "final_day": "Final Day", "change": "Change", "percent_growth": "Percent Growth", "response": "Response"}, ("_row",)),
    ("Response_Summary", "response_summary", {"grp": "Group", "responders": "Responders", "non_responders": "Non-responders", "total": "Total", "responder_percent": "Responder %"}, ("grp",)),
    ("Responder_TV_Summary", "responder_tv_summary", {"grp": "Group", "response": "Response", "day": "Day", "mean_tv": "Mean TV", "sd": "SD", "n": "n", "sem": "SEM"}, ("grp", "response", "day")),
    ("Errors", "errors", {"grp": "Group", "mouse": "Mouse", "issue": "Issue"}, ("_row",)),
)
NO_ERRORS = "No errors found."
#: The header of the column that names the workbook, where there are several.
WORKBOOK = "Workbook"


def _columns(df: DataFrame, columns: dict[str, str]) -> dict[str, str]:
    return ({PATH: WORKBOOK} if PATH in df.columns else {}) | columns


def _order(df: DataFrame, columns: dict[str, str], order: tuple[str, ...]) -> list[str]:
    """The columns to sort by: the workbook first; without rows of a sheet the first two columns."""
    own = [c for c in order if c in df.columns] or list(columns)[:2]
    return [*([PATH] if PATH in df.columns else []), *own]


def report_tabs(tables: dict[str, DataFrame]) -> list[Tab]:
    """The sheets of the report. Without errors the last has one column, which says so."""
    out = []
    for sheet, name, columns, order in SHEETS:
        df = tables[name]
        headers = {df.columns.index(c): header for c, header in _columns(df, columns).items()}
        out.append(Tab(sheet, df, headers, _order(df, columns, order), (["Issue"], [NO_ERRORS]) if name == "errors" else None))
    return out


def write_report(tables: dict[str, DataFrame], path: str | Path) -> dict[str, int]:
    """The five sheets of a workbook; the number of rows of each table, counted as they were written."""
    counts = write_workbook(tables["growth"].sparkSession, path, report_tabs(tables))
    return {name: n.rows for (_, name, _, _), n in zip(SHEETS, counts, strict=True)}


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """The five tables as Parquet, a folder for each: for results that no sheet can hold."""
    for sheet, name, columns, _ in SHEETS:
        tables[name].select(*_columns(tables[name], columns)).write.mode("overwrite").parquet(f"{path}/{sheet}")


def annotated_path(path: str | Path, dialect: str = "day04") -> Path | str:
    """name_TV beside the input: with its extension, or for day02 always .xlsx. Text for a URL."""

    def renamed(name: str) -> str:
        own = Path(name)
        return f"{own.stem}_TV{own.suffix if DIALECTS[dialect].keeps else '.xlsx'}"

    return beside(path, renamed)


def write_annotated(annotated: DataFrame, path: str | Path) -> int:
    """An annotated sheet in the order of its rows; replaces an older one. The number of rows with an error, counted as they are written."""
    headers = {i: c for i, c in enumerate(annotated.columns) if c != ROW and not c.startswith(KIND)}
    return write_workbook(annotated.sparkSession, path, [Tab("Sheet1", annotated, headers, [ROW], marked="Error")])[0].marked
