"""Small tables, shared by the tests of this folder."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from samples import SCHEMA, texts


@pytest.fixture(scope="session")
def docs(spark, tmp_path_factory):
    """Written, so that row ids of a scan are stable; with columns whose names operators use themselves."""
    path = f"file://{tmp_path_factory.mktemp('docs')}/documents.parquet"
    rows = [(i, t, lang, source, len(t or ""), "r", "s", 7, "h") for i, t, lang, source in texts()]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.where(F.lit(False))
