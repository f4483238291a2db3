"""Workbooks in and reports out."""

from growthlab.sources.charts import bar_chart, line_chart
from growthlab.sources.datasource import XlsxDataSource, register
from growthlab.sources.files import beside, scratch, within, write_text
from growthlab.sources.report import annotated_path, report_tabs, write_annotated, write_report, write_tables
from growthlab.sources.workbook import Tab, write_workbook
from growthlab.sources.xlsx import Sheet, SheetNotFound, read_headers, read_rows, read_sheet, sheet_names, write_xlsx

__all__ = [
    "Sheet", "SheetNotFound", "Tab", "XlsxDataSource", "annotated_path", "bar_chart", "beside", "line_chart", "read_headers", "read_rows", "read_sheet", "register", "report_tabs",
    "scratch", "sheet_names", "within", "write_annotated", "write_report", "write_tables", "write_text", "write_workbook", "write_xlsx",
]
