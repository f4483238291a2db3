from __future__ import annotations

import pytest
from pyspark.errors import PySparkException

from growthlab import operators as O
from growthlab.cli import main
from growthlab.plans import ExperimentConfig, analyze, annotate_workbook, experiment_of, read_experiment, read_growth, tables
from growthlab.plans import analysis
from growthlab.sources import SheetNotFound, annotated_path, read_sheet, sheet_names, write_tables, write_xlsx


def content(spark, path, sheet=None):
    found = read_sheet(spark, str(path), sheet)
    names = [c for c in found.df.columns if c != "_row" and not c.startswith("_kind_")]
    return names, [tuple(r) for r in found.df.orderBy("_row").select(*(f"`{c}`" for c in names)).collect()]


def test_round_trip(spark, tmp_path):
    rows = [(1, 2.5, "a & <b>", True), (None, float("nan"), " x\n", False), (3, 1e300, None, None)]
    write_xlsx(tmp_path / "a.xlsx", [("One", ["i", "f", "s", "b"], rows), ("Two & more", ["x"], [])])
    assert sheet_names(spark, str(tmp_path / "a.xlsx")) == ["One", "Two & more"]
    names, got = content(spark, tmp_path / "a.xlsx")
    assert names == ["i", "f", "s", "b"]
    assert got == [(1.0, 2.5, "a & <b>", True), (None, None, " x\n", False), (3.0, 1e300, None, None)]
    assert content(spark, tmp_path / "a.xlsx", "Two & more") == (["x"], [])
    with pytest.raises(SheetNotFound, match="Three"):
        read_sheet(spark, str(tmp_path / "a.xlsx"), "Three")
    with pytest.raises(ValueError, match="xls"):
        read_sheet(spark, str(tmp_path / "a.xls"))


def sheet(path, lengths, widths, **more):
    columns = {"Mouse ID": range(1, len(lengths) + 1), "L": lengths, "W": widths, **more}
    write_xlsx(path, [("Sheet1", list(columns), list(zip(*columns.values(), strict=True)))])
    return path


def test_annotated_workbook(spark, tmp_path):
    path = sheet(tmp_path / "Measurements.xlsx", [10, 6, 10.5], [5, 6, 5.2])
    before = path.read_bytes()
    out, errors = annotate_workbook(spark, str(path))
    assert (out.name, errors, path.read_bytes()) == ("Measurements_TV.xlsx", False, before)
    names, rows = content(spark, out)
    assert names == ["Mouse ID", "L", "W", "T.V.", "Error"]
    assert [r[3] for r in rows] == [125.0, 108.0, pytest.approx(141.96)] and not any(r[4] for r in rows)


def test_bad_rows_go_on(spark, tmp_path):
    path = sheet(tmp_path / "m.xlsx", [10, 5, 8, None, "7", 7], [5, 10, 4, 1, 2, True])
    out, errors = annotate_workbook(spark, str(path))
    _, rows = content(spark, out)
    assert errors
    assert [r[3] for r in rows] == [125.0, None, 64.0, None, None, 3.5]
    assert [r[4] for r in rows] == [None, "Width cannot be greater than length.", None, "Missing length or width value.", "Length and width must be numbers.", None]


def test_blank_rows_are_missing(spark, tmp_path):
    out, errors = annotate_workbook(spark, str(sheet(tmp_path / "m.xlsx", [10, None, 8], [5, None, 4])))
    assert errors and [r[4] for r in content(spark, out)[1]] == [None, "Missing length or width value.", None]


def test_stale_volumes(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0, 9.0, "old", "x"), (1, 2.0, 1.0, 9.0, "old", "y")], "_row long, L double, W double, `T.V.` double, Error string, more string")
    kept = O.annotate_volume(df)
    assert kept.columns == df.columns
    assert [tuple(r)[3:] for r in kept.orderBy("_row").collect()] == [(9.0, "Width cannot be greater than length.", "x"), (1.0, "", "y")]
    reset = O.annotate_volume(df.withColumnRenamed("T.V.", "T.V"), "day02")
    assert [tuple(r)[3:] for r in reset.orderBy("_row").collect()] == [("x", None, "W > L"), ("y", 1.0, "")]


def test_day02(spark):
    df = spark.createDataFrame([(1.0, None), (5.0, 10.0), (10.0, 5.0), (float("nan"), 1.0)], "L double, W double")
    assert [tuple(r)[2:] for r in O.annotate_volume(df, "day02").collect()] == [(None, "Missing value"), (None, "W > L"), (125.0, ""), (None, "Missing value")]
    with pytest.raises(PySparkException, match="must be numbers"):
        O.annotate_volume(spark.createDataFrame([("a", 1.0)], "L string, W double"), "day02").collect()
    with pytest.raises(ValueError, match="W"):
        O.annotate_volume(df.withColumnRenamed("W", "w"))


def test_paths():
    assert annotated_path("/a/b.c.xlsx").name == "b.c_TV.xlsx"
    assert annotated_path("/a/b.xlsm").name == "b_TV.xlsm"
    assert annotated_path("/a/b.xlsm", "day02").name == "b_TV.xlsx"


def settings_of(spark, rows):
    cells = [(n, [None if c is None else (c, "s") for c in row]) for n, row in enumerate(rows)]
    return experiment_of(spark.createDataFrame(cells, "_row long, cells array<struct<text: string, kind: string>>").repartition(3))


def test_settings(spark):
    rows = [["Control group", " G1 ", None], ["RESPONDER threshold", "30"], ["Excluded mice", "28, 30", "4.0"], [None, "x"], [], ["Note", "responder"]]
    assert settings_of(spark, rows) == ExperimentConfig("G1", 30.0, ("28", "30", "4.0"))
    assert settings_of(spark, [*rows, ["exclude"], ["control group"], ["responder threshold"]]) == ExperimentConfig("G1", 30.0, ())
    both = settings_of(spark, [*rows, ["control group of responder threshold, exclude", "12"]])  # one row may name several
    assert both == ExperimentConfig("12", 12.0, ("12",))
    assert settings_of(spark, []) == ExperimentConfig()
    with pytest.raises(ValueError, match="high"):
        settings_of(spark, [["responder threshold", "high"], ["responder threshold", "3"]])


def test_settings_after_many_rows(spark):
    rows = spark.range(30_000).selectExpr("id AS _row", "array(named_struct('text', if(id = 29999, 'Excluded mice', 'note'), 'kind', 's'), named_struct('text', '28', 'kind', 's')) AS cells")
    assert experiment_of(rows).excluded == ("28",)


def experiment(path, settings=True):
    tv = [("Tumour volumes",), ("Group", "mouse", 0, "Day 3", 6, "notes"), ("B", 1, 100, 120, 140, "x"), ("A", 2, 100, 160, 180), ("A", "3", None, 5, 5), ("A", 4, 100, None, "12d"), (None, 9, 1, 1, 1), ("A", 28, 1, 1, 1), ("A ", "30A", 10, 12, None)]
    sheets = [("TV", tv[0], tv[1:])]
    if settings:
        sheets.append(("experiment data", ("Control group", "A"), [("Responder threshold (%)", 60), ("Exclude mice", "28, 31")]))
    write_xlsx(path, sheets)
    return str(path)


def test_reading(spark, tmp_path):
    wide, days, config = read_growth(spark, experiment(tmp_path / "e.xlsx"))
    assert (days, config.threshold, config.control_group) == ([0, 3, 6], 60.0, "A")
    assert [(r["grp"], r["mouse"]) for r in wide.orderBy("_row").collect()] == [("B", "1"), ("A", "2"), ("A", "3"), ("A", "4"), ("A", "30A")]
    assert read_experiment(spark, experiment(tmp_path / "f.xlsx", False)) == ExperimentConfig()


def test_analysis(spark, tmp_path):
    made = analyze(spark, experiment(tmp_path / "e.xlsx"), str(tmp_path / "out" / "deep"))
    assert (made.num_mice_analyzed, made.num_errors) == (3, 2)
    assert sheet_names(spark, str(made.output_excel)) == ["General_Summary", "Mouse_Growth", "Response_Summary", "Responder_TV_Summary", "Errors"]
    names, rows = content(spark, made.output_excel, "Mouse_Growth")
    assert names == ["Group", "Mouse", "Initial TV", "Final TV", "Final Day", "Change", "Percent Growth", "Response"]
    assert [(r[0], r[1], r[7]) for r in rows] == [("B", "1", "Responder"), ("A", "2", "Non-responder"), ("A", "30A", "Responder")]
    assert content(spark, made.output_excel, "Response_Summary")[1] == [("A", 1.0, 1.0, 2.0, 50.0), ("B", 1.0, 0.0, 1.0, 100.0)]
    assert [r[1] for r in content(spark, made.output_excel, "Errors")[1]] == ["3", "4"]
    assert [r[:2] for r in content(spark, made.output_excel, "General_Summary")[1]] == [("A", 0.0), ("A", 3.0), ("A", 6.0), ("B", 0.0), ("B", 3.0), ("B", 6.0)]
    assert "<svg" in made.mean_tv_graph.read_text() and "Group A" in made.mean_tv_graph.read_text() and "120" in made.responder_graph.read_text()


def test_without_errors_or_mice(spark, tmp_path):
    write_xlsx(tmp_path / "e.xlsx", [("TV", ("title",), [("Group", "mouse", 0, 3)])])
    made = analyze(spark, str(tmp_path / "e.xlsx"), str(tmp_path / "out"))
    assert (made.num_mice_analyzed, made.num_errors) == (0, 0)
    assert content(spark, made.output_excel, "Errors") == (["Issue"], [("No errors found.",)])
    assert not made.mean_tv_graph.exists() and not made.responder_graph.exists()


def test_tables_as_parquet(spark, tmp_path):
    wide, days, config = read_growth(spark, experiment(tmp_path / "e.xlsx"))
    write_tables(tables(wide, days, config.threshold), f"file://{tmp_path}/t")
    assert spark.read.parquet(f"file://{tmp_path}/t/Errors").count() == 2


def test_command_line(spark, tmp_path, capsys):
    path = sheet(tmp_path / "m.xlsx", [10], [5])
    assert main(["volume", "10", "5"]) == 0 and main(["volume", "5", "10"]) == 1
    assert main(["annotate", f" {path} "]) == 0
    assert main(["growth", experiment(tmp_path / "e.xlsx"), "--output-dir", str(tmp_path / "o")]) == 0
    assert main(["bmi", "70", "1.75"]) == 0 and main(["bmi", "0", "1.75"]) == 1
    assert main(["dilution", "--v1", "2", "--c2", "3", "--v2", "4"]) == 0 and main(["dilution", "--c1", "1"]) == 1
    said = capsys.readouterr().out
    for text in ("Tumor volume is: 125.0", "Width cannot", "no errors", "num_mice_analyzed: 3", "Your BMI: 22.86", "positive", "C1 = 6.0", "exactly one"):
        assert text in said
    for bad in (["volume", "x", "1"], ["annotate", str(tmp_path / "none.xlsx")], ["annotate", "a.txt"], ["annotate", "a.xls"], ["annotate", " "]):
        with pytest.raises(SystemExit):
            main(bad)


def test_no_silent_bounds(spark, tmp_path, monkeypatch):
    """Points beyond the bound of a chart are an error, not left out."""
    path = str(tmp_path / "bounds.xlsx")
    write_xlsx(path, [("TV", ["title"], [["Group", "mouse", "0", "3"], ["A", 1, 100.0, 120.0], ["B", 2, 100.0, 130.0]])])
    analysis.analyze(spark, path, str(tmp_path / "out"))
    monkeypatch.setattr(analysis, "MAX_POINTS", 3)
    with pytest.raises(ValueError, match="chart of means"):
        analysis.analyze(spark, path, str(tmp_path / "out"))


def test_several_workbooks(spark, tmp_path):
    """Workbooks of the same headers are one table; others, and workbooks without the sheet, are an error."""
    for n in (1, 2):
        sheet(tmp_path / f"m{n}.xlsx", [10 * n, "x"], [5, 1])
    found = read_sheet(spark, str(tmp_path / "m*.xlsx"))
    rows = sorted((r["_path"][-7:], r["_row"], r["L"], r["W"]) for r in found.df.collect())
    assert rows == [("m1.xlsx", 2, "10", 5.0), ("m1.xlsx", 3, "x", 1.0), ("m2.xlsx", 2, "20", 5.0), ("m2.xlsx", 3, "x", 1.0)]
    found.release()
    write_xlsx(tmp_path / "m3.xlsx", [("Sheet1", ["L", "Mouse ID", "W"], [(1, 2, 3)])])
    with pytest.raises(ValueError, match="different headers"):
        read_sheet(spark, str(tmp_path / "m*.xlsx"))
    write_xlsx(tmp_path / "m4.xlsx", [("Other", ["L"], [])])
    with pytest.raises(SheetNotFound, match="m4.xlsx"):
        read_sheet(spark, str(tmp_path / "m*.xlsx"), "Sheet1")


def test_volume_from_standard_input(spark, monkeypatch, capsys):
    answers = iter(["10", "5"])
    monkeypatch.setattr("builtins.input", lambda _: next(answers))
    assert main(["volume"]) == 0
    assert "Tumor volume is: 125.0" in capsys.readouterr().out
