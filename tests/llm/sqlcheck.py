"""Spark rows against DuckDB SQL over small tables."""

from __future__ import annotations

import math

import duckdb


def _sorted(columns, found):
    def value(v):
        return None if v is None or (isinstance(v, float) and math.isnan(v)) else round(v, 6) if isinstance(v, float) else v

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(value(r[i]) for i in order) for r in found), key=lambda r: tuple((v is None, str(v)) for v in r))


def compare_rows(spark, df, sql, **tables):
    con = duckdb.connect()
    for name, table in tables.items():
        con.register(f"_{name}", table.toArrow())
        con.execute(f"create table {name} as select * from _{name}")
    expected = con.execute(sql)
    assert _sorted(df.columns, [tuple(r) for r in df.collect()]) == _sorted([d[0] for d in expected.description], expected.fetchall())
