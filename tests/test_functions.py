from __future__ import annotations

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from growthlab import functions as G


def one(spark, column, **values):
    columns = {k: F.lit(v) for k, v in values.items()}
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items()), F.lit(0).alias("_")).select(column).first()[0]


@pytest.mark.parametrize(("length", "width", "volume"), [(10, 5, 125.0), (6, 6, 108.0), (10.5, 5.2, 141.96), (3, -2, 6.0), (0, 0, 0.0)])
def test_volume(spark, length, width, volume):
    got = one(spark, G.tumor_volume_strict(F.col("l").cast("double"), F.col("w").cast("double")), l=length, w=width)
    assert got == pytest.approx(volume)


def test_volume_refuses_a_width_above_the_length(spark):
    with pytest.raises(PySparkException, match="Width cannot be greater"):
        one(spark, G.tumor_volume_strict(F.col("l"), F.col("w")), l=5.0, w=10.0)


@pytest.mark.parametrize(("values", "sem", "sd"), [([100.0, 120.0], 10.0, math.sqrt(200)), ([100.0], 0.0, 0.0), ([], None, None), ([100.0, None, 120.0], 10.0, math.sqrt(200))])
def test_sem_and_sd(spark, values, sem, sd):
    row = spark.createDataFrame([(v,) for v in values], "v double").agg(G.sem("v"), G.sd("v")).first()
    assert tuple(row) == (pytest.approx(sem), pytest.approx(sd))


@pytest.mark.parametrize(
    ("values", "mean"),
    [
        ([0.1, 0.2, 0.3], 0.6 / 3), ([0.3, 0.2, 0.1], 0.6 / 3), ([0.1, 0.7, None], 0.8 / 2), ([-1e17, 0.01, 1e17], 0.01 / 3), ([None], None), ([], None),
        ([1e-20, 3e-20], (1e-20 + 3e-20) / 2), ([1e300, 3e300], 2e300), ([1.0, math.inf], math.inf),
    ],
)
def test_mean(spark, values, mean):
    assert spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).agg(G.mean("v")).first()[0] == mean


def test_mean_of_nan(spark):
    assert math.isnan(spark.createDataFrame([(1.0,), (math.nan,)], "v double").agg(G.mean("v")).first()[0])


@pytest.mark.parametrize(("percent", "response"), [(50.0, "Responder"), (51.0, "Non-responder"), (float("nan"), "Unclassified"), (None, "Unclassified"), (float("inf"), "Non-responder")])
def test_classify(spark, percent, response):
    assert one(spark, G.classify_response(F.col("p").cast("double")), p=percent) == response


@pytest.mark.parametrize(
    ("cell", "id_"),
    [(28.0, "28"), ("28", "28"), ("28A", "28A"), ("007", "7"), (" 28.0 ", "28"), (28.5, "28.5"), (" x y ", "x y"), (None, None), (float("nan"), None), ("1e2", "100"), ("+5", "5"), ("-0", "0"), ("9007199254740993", "9007199254740993"), ("12d", "12d")],
)
def test_normalized_id(spark, cell, id_):
    kind = "double" if isinstance(cell, float) else "string"
    assert spark.createDataFrame([(cell,)], f"c {kind}").select(G.normalized_id(F.col("c"))).first()[0] == id_


@pytest.mark.parametrize(("cell", "value"), [(" 12 ", 12.0), ("1e3", 1000.0), ("12d", None), ("1,000", None), ("0x1F", None), ("1_0", None), ("inf", float("inf")), ("-inf", -float("inf")), (".5", 0.5), ("5.", 5.0), ("", None), (None, None)])
def test_number(spark, cell, value):
    assert one(spark, G.number(F.col("c").cast("string")), c=cell) == value


@pytest.mark.parametrize(("header", "day"), [(0, 0), (3.5, 3), ("Day 3", 3), ("day-1", -1), ("3", 3), ("3.0", None), ("3 days", None), ("D3", None), ("--3", None), ("notes", None), (float("nan"), None), (True, None), ("", None)])
def test_day_of_column(header, day):
    assert G.day_of_column(header) == day


@pytest.mark.parametrize(("responders", "total", "percent"), [(1, 2, 50.0), (2, 2, 100.0), (0, 0, None), (1, 3, 33.33), (1, 800, 0.12)])
def test_responder_percent(spark, responders, total, percent):
    assert one(spark, G.responder_percent(F.col("r"), F.col("t")), r=responders, t=total) == percent


def test_zero_baseline(spark):
    assert one(spark, G.percent_growth(F.col("a"), F.col("b"), "issue"), a=0.0, b=1.0) is None
    with pytest.raises(PySparkException, match="baseline"):
        one(spark, G.percent_growth(F.col("a"), F.col("b")), a=0.0, b=1.0)
    with pytest.raises(ValueError, match="on_zero_baseline"):
        G.percent_growth(F.col("a"), F.col("b"), "other")


@pytest.mark.parametrize(("kg", "m", "bmi", "category"), [(70.0, 1.75, 22.86, "Normal weight"), (50.0, 1.8, 15.43, "Underweight"), (81.0, 1.8, 25.0, "Overweight"), (97.2, 1.8, 30.0, "Obese"), (80.987, 1.8, 25.0, "Overweight"), (0.0, 1.8, None, None), (70.0, -1.0, None, None)])
def test_bmi(spark, kg, m, bmi, category):
    value = G.bmi(F.col("kg"), F.col("m"))
    got = spark.createDataFrame([(kg, m)], "kg double, m double").select(value, G.bmi_category(value), G.bmi_error(F.col("kg"), F.col("m")).isNull()).first()
    assert tuple(got) == (bmi, category, bmi is not None)


@pytest.mark.parametrize(("choice", "value", "error"), [(1, 6.0, None), (2, 12.0, None), (3, 0.5, None), (4, 2 / 3, None), (5, None, None)])
def test_dilution(spark, choice, value, error):
    given = [F.lit(x) for x in (choice, 1.0, 2.0, 3.0, 4.0)]
    assert tuple(spark.range(1).select(G.dilution(*given), G.dilution_error(*given)).first()) == (value, error)


@pytest.mark.parametrize(("choice", "name"), [(1, "V1"), (2, "C1"), (3, "V2"), (4, "C2")])
def test_dilution_by_zero(spark, choice, name):
    given = [F.lit(x) for x in (choice, -0.0, 0.0, -0.0, 0.0)]
    assert tuple(spark.range(1).select(G.dilution(*given), G.dilution_error(*given)).first()) == (None, f"Error: {name} cannot be zero, run again.")


def test_sql_functions(spark):
    G.register_functions(spark)
    row = spark.sql("SELECT tumor_volume(10, 5), classify_response(50, 50), classify_response(double('nan'), 50), sem_of(sqrt(200), 2), sem_of(NULL, 1), bmi(70, 1.75), bmi_category(bmi(70, 1.75))").first()
    assert tuple(row) == (125.0, "Responder", "Unclassified", pytest.approx(10.0), 0.0, 22.86, "Normal weight")
