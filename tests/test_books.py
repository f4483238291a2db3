"""Several workbooks as several experiments, sinks on any file system, and names that clash."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from growthlab import functions as G
from growthlab import operators as O
from growthlab.cli import main
from growthlab.plans import analyze, annotate_workbook, read_experiments, read_growth, read_growths, sheet_issues, tables
from growthlab.sources import Tab, annotated_path, read_sheet, sheet_names, within, write_text, write_workbook, write_xlsx

TV = {
    "a": [("B", 1, 100, 120, 140), ("A", 2, 100, 160, 180), ("A", "3", None, 5, 5), ("A", 28, 1, 1, 1), ("A", 28, 2, 9, None)],
    "b": [("B", 1, 100, 120, 170), ("A", 2, 100, 160, 180), ("A", 28, 1, 1, 1), ("C", 5, 7, None, None)],
    "c": [("A", 2, 10, 16, 18)],
}
SETTINGS = {"a": [("Responder threshold (%)", 10), ("Exclude mice", "28, 31")], "b": [("x",)] * 5 + [("Responder threshold (%)", 70), ("Exclude mice", "2")]}


def book(folder, name):
    sheets = [("TV", ("Tumour volumes",), [("Group", "mouse", 0, "Day 3", 6), *TV[name]])]
    if name in SETTINGS:
        sheets.append(("experiment data", ("Control group", "A"), SETTINGS[name]))
    path = folder / f"{name}.xlsx"
    write_xlsx(path, sheets)
    return path


def content(spark, path, sheet):
    df = read_sheet(spark, str(path), sheet).df
    return [tuple(r) for r in df.orderBy("_row").drop("_row", *(c for c in df.columns if c.startswith("_kind_"))).collect()]


def test_settings_of_each_workbook(spark, tmp_path):
    for name in TV:
        book(tmp_path, name)
    found = {r["_path"].rpartition("/")[2]: tuple(r)[1:] for r in read_experiments(spark, str(tmp_path / "*.xlsx")).collect()}
    assert found == {"a.xlsx": ("A", 10.0, ["28", "31"]), "b.xlsx": ("A", 70.0, ["2"])}
    wide, days = read_growths(spark, str(tmp_path / "*.xlsx"))
    rows = sorted((r["_path"].rpartition("/")[2], r["grp"], r["mouse"], r["threshold"]) for r in wide.collect())
    assert days == [0, 3, 6]
    assert rows == [("a.xlsx", "A", "2", 10.0), ("a.xlsx", "A", "3", 10.0), ("a.xlsx", "B", "1", 10.0), ("b.xlsx", "A", "28", 70.0), ("b.xlsx", "B", "1", 70.0), ("b.xlsx", "C", "5", 70.0), ("c.xlsx", "A", "2", 50.0)]
    SETTINGS["c"] = [("responder threshold", "high")]
    try:
        book(tmp_path, "c")
        with pytest.raises(PySparkException, match="c.xlsx is no number: high"):
            read_growths(spark, str(tmp_path / "*.xlsx"))[0].collect()
    finally:
        del SETTINGS["c"]


WRONG = {
    "ok": ("TV", ("Group", "mouse", "Day 0", "3")), "no_group": ("TV", ("group", "mouse", 0)), "neither": ("TV", ("Mouse", "Day 0")), "no_day": ("TV", ("mouse", "Group", "Day 3", "days 0 1")),
    "both": ("TV", ("Group", "Day 3")), "no_sheet": ("tv", ("Group", "mouse", 0)), "empty": ("TV", ()), "number": ("TV", ("Group", None, "mouse", 0.5)),
}


def test_what_keeps_sheets_from_analysis(spark, tmp_path, capsys):
    """Each workbook's issue is what its own analysis says; of several at once none stops the others."""
    for name, (sheet, headers) in WRONG.items():
        write_xlsx(tmp_path / f"{name}.xlsx", [(sheet, ("Title",), [headers, tuple(range(len(headers)))])])
    path = str(tmp_path / "*.xlsx")
    found = {Path(r["_path"]).stem: r["issue"] for r in sheet_issues(spark, path).collect()}
    assert found.keys() == WRONG.keys() and {n for n, issue in found.items() if issue is None} == {"ok", "number"}
    assert found["no_sheet"] == "Missing sheet." and found["both"] == "Missing required columns: ['mouse']" and found["no_day"] == "Missing required Day 0 column."
    for name in WRONG.keys() - {"no_sheet", "ok", "number"}:
        with pytest.raises(O.GrowthError) as error:
            read_growth(spark, str(tmp_path / f"{name}.xlsx"))
        assert str(error.value) == found[name]
    assert main(["check", path]) == 1
    said = capsys.readouterr().out
    assert f"no_group.xlsx: {found['no_group']}" in said and "6 workbooks" in said
    assert main(["check", str(tmp_path / "ok.xlsx")]) == 0
    assert sheet_issues(spark, path).where("_path like 'none'").collect() == []


def test_days_of_headers(spark):
    """Days of headers as columns are those found one by one."""
    headers = ["Day 3", "day-1", " 7 ", "DAY", "3 days", "", "--3", "1.5", "Tag 1", "\u00a05\n", "dayday 4", "4day", "+3", "Day 0", "-0", "\u0663", None]
    numbers = [0.0, 2.9, -0.5, -3.0, 1e17, float("inf"), float("nan")]
    rows = [(t, "s", G.day_of_column("x" if t is None else t)) for t in headers] + [(repr(x), "n", G.day_of_column(x)) for x in numbers]
    table = spark.createDataFrame(rows, "text string, kind string, day long")
    assert table.where(~G.header_day(F.col("text"), F.col("kind")).eqNullSafe(F.col("day"))).collect() == []


def test_several_workbooks_give_what_single_runs_give(spark, tmp_path):
    single, counts = {}, [0, 0]
    for name in TV:
        made = analyze(spark, str(book(tmp_path, name)), str(tmp_path / f"out-{name}"))
        counts = [counts[0] + made.num_mice_analyzed, counts[1] + made.num_errors]
        for sheet in sheet_names(spark, str(made.output_excel)):
            rows = content(spark, made.output_excel, sheet)
            single.setdefault(sheet, []).extend((f"{name}.xlsx", *map(str, r)) for r in rows if r != ("No errors found.",))
    made = analyze(spark, str(tmp_path / "*.xlsx"), str(tmp_path / "out"))
    assert [made.num_mice_analyzed, made.num_errors] == counts == [5, 2]
    for sheet, rows in single.items():
        assert [(r[0].rpartition("/")[2], *map(str, r[1:])) for r in content(spark, made.output_excel, sheet)] == rows, sheet
    assert "a.xlsx: A" in made.mean_tv_graph.read_text() and "c.xlsx: A" in made.responder_graph.read_text()


def test_annotation_takes_one_workbook(spark, tmp_path):
    for name in "ab":
        write_xlsx(tmp_path / f"{name}.xlsx", [("S", ["L", "W"], [(2, 1)])])
    with pytest.raises(ValueError, match="one by one"):
        annotate_workbook(spark, str(tmp_path / "*.xlsx"))


@pytest.mark.parametrize("threshold", [10.0, "column"])
def test_responders_without_a_join(spark, threshold):
    """Equal to the join, also where a mouse is listed several times with other responses, or can't be classified."""
    rows = [("b", n, g, m, *v, t) for n, (g, m, v, t) in enumerate([
        ("A", "1", (100.0, 120.0, 140.0), 50.0), ("A", "1", (100.0, 180.0, None), 50.0), ("A", "1", (100.0, 190.0, 5.0), 50.0), ("A", "2", (None, 1.0, 2.0), 50.0), ("A", "2", (5.0, None, None), 50.0),
        ("B", "1", (1.0, 2.0, float("nan")), 150.0), ("B", "3", (1.0, float("inf"), float("nan")), 1.0), ("B", "4", (float("inf"), float("inf"), None), 1.0), ("B", "4", (1.0, 1.0, None), 1.0),
    ])]
    wide = spark.createDataFrame(rows + [("c", *r[1:]) for r in rows[:4]], "_path string, _row long, grp string, mouse string, `0` double, `3` double, `6` double, threshold double").repartition(3)
    given = F.col("threshold") if threshold == "column" else threshold
    days = [0, 3, 6]
    plain = O.responder_tv_summary(O.to_long(wide, days), O.growth_from_wide(wide, days, given)[0])
    found = O.responder_tv_summary_from_wide(wide, days, given)
    key = lambda df: sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.collect())
    assert found.columns == plain.columns and key(found) == key(plain) and found.count() > 8
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("LogicalRDD") == 1


def test_states_of_months(spark):
    rows = [(str(m), d, None if (m + d) % 5 == 0 else float(m * d % 7 + 1)) for m in range(12) for d in range(0, 40, 3)] + [("0", 39, 9.0), ("0", 39, 2.0), ("gone", 3, None), ("gone", 33, float("nan"))]
    long = spark.createDataFrame([("A", *r) for r in rows], "grp string, mouse string, day int, tv double")
    key = lambda df: sorted(map(str, df.collect()))
    months = [O.growth_states(long.where(c)) for c in ("day < 15", "day between 15 and 30", "day > 30")]
    whole = O.outcomes_from_long(long, on_zero_baseline="issue")
    merged = O.merged_states(O.merged_states(*months[:2]), months[2])
    assert key(merged) == key(O.growth_states(long)) and key(O.outcomes_from_states(merged, on_zero_baseline="issue")) == key(whole)
    assert [r["final_tv"] for r in whole.where("mouse = '0'").collect()] == [9.0] and whole.where("mouse = 'gone'").first()["issue"] == O.growth.NO_BASELINE


@pytest.mark.parametrize("dialect", ["day04", "day02"])
def test_columns_that_an_operator_uses_itself(spark, dialect):
    df = spark.createDataFrame([(10.0, 5.0, "mine", 7.0, 8.0, "e", "x")], "L double, W double, _error string, _volume double, l double, error string, `a.b` string")
    found = O.annotate_volume(df, dialect)
    volume = "T.V." if dialect == "day04" else "T.V"
    assert found.columns == [*df.columns, volume, "Error"] and tuple(found.first()) == (10.0, 5.0, "mine", 7.0, 8.0, "e", "x", 125.0, "")
    again = O.annotate_volume(found, dialect)
    assert again.columns == found.columns and tuple(again.first()) == tuple(found.first()) and not O.any_error(again).first()[0]


def test_headers_that_differ_by_case(spark, tmp_path):
    write_xlsx(tmp_path / "m.xlsx", [("S", ["Mouse ID", "L", "l", "W"], [(1, 10, "x", 5), (2, 1, 3, 2)])])
    out, errors = annotate_workbook(spark, str(tmp_path / "m.xlsx"))
    assert errors and content(spark, out, None) == [(1.0, 10.0, "x", 5.0, 125.0, None), (2.0, 1.0, "3", 2.0, None, "Width cannot be greater than length.")]
    write_xlsx(tmp_path / "e.xlsx", [("TV", ("t",), [("Group", "group", "mouse", "MOUSE", 0, 3, "GRP"), ("A", "x", 1, "y", 100, 120, "z")])])
    made = analyze(spark, str(tmp_path / "e.xlsx"), str(tmp_path / "out"))
    assert made.num_mice_analyzed == 1 and content(spark, made.output_excel, "Mouse_Growth")[0][:2] == ("A", "1")


def test_paths_of_urls():
    assert annotated_path("hdfs://a/b/c.xlsx") == "hdfs://a/b/c_TV.xlsx" and annotated_path("s3a://x/y.z.xlsm", "day02") == "s3a://x/y.z_TV.xlsx"
    assert within("s3a://x/y/", "f") == "s3a://x/y/f" and within("/x/y", "f") == Path("/x/y/f") and annotated_path("file:/a/b.xlsx") == "file:/a/b_TV.xlsx"


@pytest.fixture
def store(spark, tmp_path):
    """A scheme that only Hadoop's interface knows, over a folder."""
    conf = spark._jsc.hadoopConfiguration()
    (tmp_path / "store").mkdir()
    conf.set("fs.viewfs.mounttable.books.link./in", f"file://{tmp_path}/store")
    yield "viewfs://books/in"
    conf.unset("fs.viewfs.mounttable.books.link./in")


def test_output_on_another_file_system(spark, tmp_path, store, monkeypatch):
    monkeypatch.chdir(tmp_path)
    book(tmp_path / "store", "a")
    before = {p for p in tmp_path.rglob("*") if "store" not in p.parts}
    made = analyze(spark, f"{store}/a.xlsx", f"{store}/out/deep")
    assert made.output_excel == f"{store}/out/deep/tumor_growth_results.xlsx" and (made.num_mice_analyzed, made.num_errors) == (2, 1)
    assert sorted(p.name for p in (tmp_path / "store/out/deep").iterdir() if p.suffix != ".crc") == ["mean_tumor_volume_sem.svg", "responder_percentage_by_group.svg", "tumor_growth_results.xlsx"]
    assert len(content(spark, made.output_excel, "Mouse_Growth")) == 2
    write_xlsx(tmp_path / "store/m.xlsx", [("S", ["L", "W"], [(10, 5)])])
    out, errors = annotate_workbook(spark, f"{store}/m.xlsx")
    assert (out, errors) == (f"{store}/m_TV.xlsx", False) and content(spark, tmp_path / "store/m_TV.xlsx", None) == [(10.0, 5.0, 125.0, None)]
    assert {p for p in tmp_path.rglob("*") if "store" not in p.parts} == before


def test_files_appear_whole_or_not_at_all(spark, tmp_path):
    bad = spark.range(0, 100, 1, 4).selectExpr("id", "if(id = 90, raise_error('lost'), id) AS x")
    for path in (tmp_path / "a.xlsx", f"file://{tmp_path}/a.xlsx"):
        with pytest.raises(PySparkException, match="lost"):
            write_workbook(spark, path, [Tab("S", bad, {1: "x"}, ["id"])])
        assert list(tmp_path.iterdir()) == []
    write_text(spark, f"file://{tmp_path}/new/t.svg", "first")
    write_text(spark, tmp_path / "new/t.svg", "é")
    assert [(p.name, p.read_text()) for p in (tmp_path / "new").iterdir()] == [("t.svg", "é")]
    (tmp_path / "new/t.svg").write_text("changed by others")
    assert spark.read.text(f"file://{tmp_path}/new/t.svg").first()[0] == "changed by others"


def test_sheets_made_by_executors(spark, tmp_path, monkeypatch):
    table = spark.range(0, 20_000, 1, 9).selectExpr("(id * 7919) % 20000 AS n", "concat('a<', id, '>&\r\n', char(7), '\"') AS t", "id / 3 AS d", "id % 2 = 0 AS b", "if(id % 2 = 0, double('inf'), double('nan')) AS odd", "cast(id AS decimal(10, 2)) AS dec")
    none = table.where("false")
    counts = write_workbook(spark, tmp_path / "b.xlsx", [Tab("All", table, dict(enumerate(table.columns)), ["n"]), Tab("None", none, {0: "n"}, []), Tab("Else", none, {0: "n"}, ["n"], (["Issue"], ["no rows"])), Tab("Marked", table, {0: "n"}, ["n"], marked="t")])
    assert [tuple(c) for c in counts] == [(20_000, 0), (0, 0), (0, 0), (20_000, 20_000)]
    rows = content(spark, tmp_path / "b.xlsx", "All")
    by_n = {(i * 7919) % 20000: i for i in range(20_000)}
    assert rows == [(float(n), f"a<{(i := by_n[n])}>&\r\n\"", i / 3, i % 2 == 0, "inf" if i % 2 == 0 else None, float(i)) for n in range(20_000)]
    assert content(spark, tmp_path / "b.xlsx", "Else") == [("no rows",)] and sorted(p.name for p in tmp_path.iterdir()) == ["b.xlsx"]
    monkeypatch.setattr("growthlab.sources.workbook.MAX_ROWS", 20_000)
    with pytest.raises(ValueError, match="more than"):
        write_workbook(spark, tmp_path / "c.xlsx", [Tab("All", table, {0: "n"}, ["n"])])
    assert sorted(p.name for p in tmp_path.iterdir()) == ["b.xlsx"]


def test_caches_are_released(spark, tmp_path, monkeypatch):
    path = book(tmp_path, "a")
    held = lambda: spark._jsc.getPersistentRDDs().size()
    before = held()
    analyze(spark, str(path), str(tmp_path / "out"))
    monkeypatch.setattr("growthlab.plans.analysis.MAX_POINTS", 1)
    with pytest.raises(ValueError, match="points"):
        analyze(spark, str(path), str(tmp_path / "out"))
    assert held() == before


def test_tables_of_a_wide_sheet(spark):
    wide = spark.createDataFrame([(0, "A", "1", 100.0, 120.0)], "_row long, grp string, mouse string, `0` double, `3` double")
    assert {name: df.count() for name, df in tables(wide, [0, 3], 50.0).items()} == {"general_summary": 2, "growth": 1, "response_summary": 1, "responder_tv_summary": 2, "errors": 0}


def test_command_line_takes_a_pattern(spark, tmp_path, capsys):
    for name in "ab":
        book(tmp_path, name)
    assert main(["growth", str(tmp_path / "*.xlsx"), "--output-dir", str(tmp_path / "out")]) == 0
    assert "num_mice_analyzed: 4" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["growth", str(tmp_path / "none*.xlsx")])
