from __future__ import annotations

import math
from functools import reduce
from operator import add

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from growthlab import operators as O
from growthlab.operators.growth import NO_BASELINE, NO_FOLLOW_UP, ZERO_BASELINE

WIDE = "_row long, grp string, mouse string, `-3` double, `0` double, `3` double, `6` double"
DAYS = [-3, 0, 3, 6]


def wide(spark, *rows):
    return spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], WIDE)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_day_columns():
    assert O.day_columns(["Group", "mouse", 0, "Day 3", "notes"], ["Group", "mouse", "0", "Day 3", "notes"]) == [(0, "0"), (3, "Day 3")]
    assert O.day_columns([3, "day 3", 0], ["3", "day 3", "0"]) == [(0, "0"), (3, "day 3")]
    with pytest.raises(O.GrowthError, match="Day 0"):
        O.day_columns(["Group", "3"])


def test_long_skips_missing(spark):
    long = O.to_long(wide(spark, ("A", "1", None, 100.0, 120.0, float("nan"))), DAYS)
    assert rows(long, "grp", "mouse", "day", "tv") == [("A", "1", 0, 100.0), ("A", "1", 3, 120.0)]


@pytest.mark.parametrize("values", [(0.1, 0.2, 0.3), (0.3, 0.2, 0.1), (1e17, 0.01, -1e17), (0.1, None, 0.2, 0.3, None), (None, None), (5,)])
def test_means_in_order(spark, values):
    there = [v for v in values if v is not None]
    expected = reduce(add, there, 0.0) / len(there) if there else None  # sum would compensate
    events = [(k, n, float(v) if v is not None else None) for k in ("a", None) for n, v in enumerate(values)]
    df = spark.createDataFrame(events[::-1], "k string, n long, v double").repartition(7)
    assert {(r["k"], r["v"]) for r in O.means_in_order(df, ["k"], "v", "n").collect()} == {("a", expected), (None, expected)}


def test_means_of_rows_without_an_order(spark):
    df = spark.createDataFrame([("a", None, 0.3), ("a", None, 0.1), ("a", 1, 0.2)], "k string, n long, v double")
    assert O.means_in_order(df, ["k"], "v", "n").collect() == [("a", (0.1 + 0.3 + 0.2) / 3)]


def test_growth(spark):
    found = wide(spark, ("A", "1", None, 100.0, 120.0, 140.0), ("A", "2", None, 100.0, 160.0, 180.0), ("A", "3", None, 100.0, 150.0, None))
    growth, errors = O.growth_from_wide(found, DAYS)
    assert rows(growth, "mouse", "final_tv", "final_day", "change", "percent_growth", "response") == [
        ("1", 140.0, 6, 40.0, pytest.approx(40.0), "Responder"),
        ("2", 180.0, 6, 80.0, pytest.approx(80.0), "Non-responder"),
        ("3", 150.0, 3, 50.0, pytest.approx(50.0), "Responder"),
    ]
    assert errors.isEmpty()


def test_errors_in_order(spark):
    found = wide(spark, ("A", "1", 1.0, None, 120.0, None), ("A", "2", None, 100.0, None, None), ("A", "3", None, None, None, None))
    growth, errors = O.growth_from_wide(found, DAYS)
    assert rows(errors, "_row", "issue") == [(0, NO_BASELINE), (1, NO_FOLLOW_UP), (2, NO_BASELINE)]
    assert growth.isEmpty()


def test_a_negative_day_is_a_follow_up(spark):
    growth, _ = O.growth_from_wide(wide(spark, ("A", "1", 90.0, 100.0, None, None)), DAYS)
    assert rows(growth, "final_day", "percent_growth", "response") == [(0, 0.0, "Responder")]


def test_zero_baseline(spark):
    found = wide(spark, ("A", "1", None, 0.0, 120.0, None))
    with pytest.raises(PySparkException, match="baseline"):
        O.growth_from_wide(found, DAYS)[0].collect()
    growth, errors = O.growth_from_wide(found, DAYS, on_zero_baseline="issue")
    assert growth.isEmpty() and rows(errors, "issue") == [(ZERO_BASELINE,)]


def test_wide_and_long_agree(spark):
    found = wide(spark, ("A", "1", 1.0, 2.0, 3.0, None), ("A", "2", None, 5.0, None, 4.0), ("B", "3", None, None, 1.0, None), ("B", "4", None, 1.0, None, None))
    a, b = O.growth_from_wide(found, DAYS), O.growth_from_long(O.to_long(found, DAYS))
    for x, y in zip(a, b, strict=True):
        assert x.columns == y.columns and rows(x, *y.columns) == rows(y, *y.columns)


def test_long_form_keeps_every_subject(spark):
    """A result for each row of the sheet: also where nothing was measured, and for a mouse listed twice."""
    long = spark.createDataFrame([(0, "A", "1", 0, None), (0, "A", "1", 3, float("nan")), (1, "A", "2", 0, 1.0), (1, "A", "2", 3, 2.0), (2, "A", "2", 0, 2.0), (2, "A", "2", 3, None)], "_row long, grp string, mouse string, day int, tv double")
    growth, errors = O.growth_from_long(long)
    assert rows(growth, "_row", "final_day", "change") == [(1, 3, 1.0)] and rows(errors, "_row", "issue") == [(0, NO_BASELINE), (2, NO_FOLLOW_UP)]
    assert tuple(O.outcome_counts(O.outcomes_from_long(long)).first()) == (1, 2)


def test_general_summary(spark):
    long = spark.createDataFrame([("A", 0, 100.0), ("A", 0, 120.0), ("A", 3, 7.0)], "grp string, day int, tv double")
    assert rows(O.general_summary(long), "grp", "day", "mean_tv", "sd", "n", "sem") == [("A", 0, 110.0, pytest.approx(math.sqrt(200)), 2, pytest.approx(10.0)), ("A", 3, 7.0, 0.0, 1, 0.0)]


def test_response_summary(spark):
    growth = spark.createDataFrame([("A", "Responder"), ("A", "Non-responder"), ("B", "Responder"), ("B", "Responder"), ("C", "Unclassified")], "grp string, response string")
    assert rows(O.response_summary(growth), "grp", "responders", "non_responders", "total", "responder_percent") == [("A", 1, 1, 2, 50.0), ("B", 2, 0, 2, 100.0), ("C", 0, 0, 0, None)]


def test_a_mouse_listed_twice_multiplies(spark):
    found = wide(spark, ("A", "1", None, 100.0, 120.0, None), ("A", "1", None, 100.0, 120.0, None))
    summary = O.responder_tv_summary(O.to_long(found, DAYS), O.growth_from_wide(found, DAYS)[0])
    assert rows(summary, "response", "day", "n") == [("Responder", 0, 4), ("Responder", 3, 4)]


def test_clean(spark):
    sheet = spark.createDataFrame([(2, " A ", "28.0", "12d"), (3, "A", "29", " 7 "), (4, None, "1", "1"), (5, "B", None, "1"), (6, " ", "x ", "inf"), (7, "1.0", "030", "")], "_row long, Group string, mouse string, `0` string")
    clean = O.clean_wide(sheet, [(0, "0")], ["29", None])
    assert rows(clean, "_row", "grp", "mouse", "0") == [(2, "A", "28", None), (6, "", "x", float("inf")), (7, "1", "30", None)]
    many = O.clean_wide(sheet, [(0, "0")], [str(n) for n in range(29, 2000)])
    assert rows(many, "_row") == [(2,), (6,)]
    with pytest.raises(O.MissingColumns, match="mouse"):
        O.clean_wide(sheet.withColumnRenamed("mouse", "Mouse"), [(0, "0")])


def test_empty(spark):
    empty = wide(spark)
    growth, errors = O.growth_from_wide(empty, DAYS)
    for df in (growth, errors, O.general_summary(O.to_long(empty, DAYS)), O.response_summary(growth), O.responder_tv_summary(O.to_long(empty, DAYS), growth)):
        assert df.isEmpty() and df.columns


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.tuples(st.integers(0, 5), st.sampled_from(DAYS)), st.floats(-1e6, 1e6), max_size=20))
def test_unpivot_of_pivot(spark, values):
    long = spark.createDataFrame([("A", str(m), d, v) for (m, d), v in values.items()], "grp string, mouse string, day int, tv double")
    back = O.to_long(long.groupBy("grp", "mouse").pivot("day", DAYS).agg(F.first("tv")), DAYS)
    assert rows(back, "mouse", "day", "tv") == rows(long, "mouse", "day", "tv")


def test_growth_from_wide_needs_no_shuffle(spark):
    growth, _ = O.growth_from_wide(wide(spark, ("A", "1", None, 1.0, 2.0, None)), DAYS)
    assert "Exchange" not in growth._jdf.queryExecution().toString()
