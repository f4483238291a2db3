"""The functions for use in SQL, as SQL functions that Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

_FUNCTIONS = (
    "tumor_volume(len DOUBLE, wid DOUBLE) RETURNS DOUBLE RETURN wid * wid * len / 2",
    "classify_response(pct DOUBLE, threshold DOUBLE) RETURNS STRING RETURN CASE WHEN pct IS NULL OR isnan(pct) THEN 'Unclassified' WHEN pct <= threshold THEN 'Responder' ELSE 'Non-responder' END",
    "sem_of(sd DOUBLE, n BIGINT) RETURNS DOUBLE RETURN CASE WHEN n = 1 THEN 0.0D WHEN n > 1 THEN sd / sqrt(n) END",
    "bmi(kg DOUBLE, m DOUBLE) RETURNS DOUBLE RETURN CASE WHEN kg > 0 AND m > 0 THEN bround(kg / (m * m), 2) END",
    "bmi_category(v DOUBLE) RETURNS STRING RETURN CASE WHEN v < 18.5 THEN 'Underweight' WHEN v < 25 THEN 'Normal weight' WHEN v < 30 THEN 'Overweight' WHEN v IS NOT NULL THEN 'Obese' END",
)


def register_functions(spark: SparkSession) -> None:
    """Registers tumor_volume, classify_response, sem_of, bmi and bmi_category for the session."""
    for definition in _FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {definition}")
