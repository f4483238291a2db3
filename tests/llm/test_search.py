from __future__ import annotations

import math
import random

import pytest

from growthlab.llm import queries, search
from sqlcheck import compare_rows

SCHEMA = "vec_id long, embedding array<float>, label int, score string, vector string"


def brute(rows, k):
    whole = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, w in whole:
        if q % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(w, v, strict=False)), i) for i, v in whole if i != q)
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def found(spark, rows, k=20):
    table = search.quantised(spark.createDataFrame([(i, v, 1, "s", "v") for i, v in rows], SCHEMA))
    return sorted(tuple(r) for r in search.top_k(table, table.where("vec_id % 20 = 0"), k).select("query_id", "rank", "vec_id", "score").collect())


@pytest.mark.parametrize("blocks", [8192, 7])
def test_against_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(search, "BLOCK_ROWS", blocks if blocks > 7 else 40)
    monkeypatch.setattr(search, "BLOCK_QUERIES", blocks)
    rng = random.Random(3)
    rows = [(i, [rng.choice([0.0, 0.5, -0.25, 1 / 64, rng.uniform(-1, 1)]) for _ in range(8)]) for i in range(200)]
    rows += [(i, [0.5] * 8) for i in range(300, 360)]  # many ties
    rows += [(400, None), (401, [None] * 8), (402, [math.nan] * 8), (403, [math.inf] + [0.0] * 7), (None, [0.5] * 8), (404, [0.5, 0.5]), (405, []), (406, [0.0] * 8)]
    rows += [(300, [0.5] * 8), (20, [9.0] * 8)]
    assert found(spark, rows) == brute([(i, v and [x if x is None else struct_float(x) for x in v]) for i, v in rows], 20)


def struct_float(x):
    import struct

    return struct.unpack("f", struct.pack("f", x))[0]


def test_few_and_none(spark):
    assert found(spark, [(0, [1.0]), (1, [2.0])]) == [(0, 1, 1, 64 * 128)]
    assert found(spark, [(0, [1.0])]) == [] and found(spark, []) == []


def test_large_values_are_exact(spark):
    rows = [(0, [2.0**40, 1.0]), (1, [2.0**10, 1.0]), (2, [2.0**10, 2.0]), (3, [2.0**100, 0.0])]
    assert found(spark, rows) == [(0, 1, 3, 2**63 - 1), (0, 2, 2, 2**62 + 2 * 64 * 64), (0, 3, 1, 2**62 + 64 * 64)]


def test_repeated_ids_are_rows_of_their_own(spark):
    assert found(spark, [(0, [1.0]), (1, [3.0]), (1, [2.0])]) == [(0, 1, 1, 64 * 192), (0, 2, 1, 64 * 128)]
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), *((1 + n % 3, [float(n), 1.0]) for n in range(40)), *[(50, [2.0, 2.0])] * 30]
    assert found(spark, rows) == brute(rows, 20)


def test_against_sql(spark):
    rows = [(n % 60, [((7 * n + k) % 13) / 8 - 0.5 for k in range(4)], 1, "s", "v") for n in range(61)] + [(61, None, 1, "s", "v"), (62, [math.nan] * 4, 1, "s", "v")]
    rows = [r for r in rows if r[0] != 0] + [(0, [0.25, -0.5, 1.0, 3.0], 1, "s", "v")]
    table = spark.createDataFrame(rows, SCHEMA)
    vectors = search.quantised(table)
    compare_rows(spark, search.top_k(vectors, vectors.where("vec_id % 20 = 0")), queries.ORACLE_SQL["op3_exact_top_k_search"], embeddings=table)


def test_blocks_of_long_vectors(spark, monkeypatch):
    """Blocks are cut by bytes, and columns with names of the operator's own are not in the way."""
    rows = [(n, [((3 * n + k) % 7) / 64 for k in range(40)]) for n in range(90)]
    monkeypatch.setattr(search, "BLOCK_BYTES", 8 * 40 * 10)
    table = search.quantised(spark.createDataFrame([(i, v, 1, "s", "v") for i, v in rows], SCHEMA))
    assert search._blocks(table, 8192) == 9 and search._blocks(table, 5) == 18 and search._blocks(table.limit(0), 5) == 1
    assert found(spark, rows) == brute(rows, 20)
    odd = spark.createDataFrame([(i, v, 1, 2, 3, "x") for i, v in rows], "vec_id long, embedding array<float>, row int, b int, q int, asks string")
    vectors = search.quantised(odd)
    got = sorted(tuple(r) for r in search.top_k(vectors, vectors.where("vec_id % 20 = 0")).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute(rows, 20)
