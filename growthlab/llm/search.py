"""Exact top-k search by exhaustive term-at-a-time accumulation, in blocks.

A vector's components are terms and their values weights. A task has one block of rows and one block of
queries. For each term it has the rows' postings (row, value), and every query that holds the term
scatters its weight times the postings into its dense array of scores. Partition selection then takes each
query's best rows of the block, and the blocks' lists are merged. Each pair of blocks meets in one task, so
tasks have a fixed size; nothing is broadcast, and work grows with queries times rows, as exact search must.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 20
SCALE = 64
BLOCK_ROWS, BLOCK_QUERIES = 8192, 8192
#: Bytes of a block's vectors, as doubles.
BLOCK_BYTES = 1 << 25
#: Queries whose score arrays are filled together.
TOGETHER = 32
#: A term with postings for more than this share of the rows is held for all rows, with zeros.
DENSE = 0.25


def quantised(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id and vector: floor(scale * x) for each component, as doubles.

    Rows without an id, without a vector or with a null or non-finite component are left out. Rows with one id
    are rows of their own.
    """
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("x")).where("vec_id is not null and x is not null")
    rows = rows.where(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    floor = lambda c: F.when(F.abs(c) < 2.0**52, F.floor(c).cast("double")).otherwise(c)  # noqa: E731  larger ones are whole
    return rows.select("vec_id", F.transform("x", lambda c: floor(c * scale)).alias("vector"))


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    """Rows of vectors; shorter ones end in zeros."""
    lengths = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(vectors), int(lengths.max(initial=0))))
    out[np.arange(out.shape[1]) < lengths[:, None]] = vectors.flatten().to_numpy()
    return out


def _best(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[list, list, list]:
    """(places of queries, ids, scores) of each query's k best rows, ties to the smaller id. ids are sorted."""
    terms = min(rows.shape[1], queries.shape[1])
    rows, queries = rows[:, :terms], queries[:, :terms]
    bound = float(np.abs(rows).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(terms, 1)
    kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else object  # all sums are whole numbers, and exact
    exact = (lambda a: np.vectorize(int, otypes=[object])(a) if a.size else a.astype(object)) if kind is object else lambda a: a.astype(kind)
    postings = []
    for term in range(terms):
        own = np.flatnonzero(rows[:, term])
        postings.append((slice(None) if len(own) > DENSE * len(ids) else own, exact(rows[:, term] if len(own) > DENSE * len(ids) else rows[own, term])))
    weights, found = exact(queries), ([], [], [])
    own_first, own_last = np.searchsorted(ids, query_ids), np.searchsorted(ids, query_ids, "right")
    for low in range(0, len(query_ids), TOGETHER):
        part = weights[low : low + TOGETHER]
        scores = np.zeros((len(part), len(ids)), kind)
        for term, (own, values) in enumerate(postings):
            holders = np.flatnonzero(part[:, term])
            if len(values) and len(holders) == len(part):
                scores[:, own] += part[:, term, None] * values
            elif len(values):
                for q in holders:
                    scores[q, own] += part[q, term] * values
        for q, score in enumerate(scores):
            other = np.ones(len(ids), bool)
            other[own_first[low + q] : own_last[low + q]] = False
            allowed = np.flatnonzero(other)
            score = score[allowed]
            if len(score) > k:
                least = np.partition(score, len(score) - k)[len(score) - k]
                above = np.flatnonzero(score > least)
                chosen = np.concatenate([above, np.flatnonzero(score == least)[: k - len(above)]])
            else:
                chosen = np.arange(len(score))
            found[0].extend([low + q] * len(chosen))
            found[1].extend(ids[allowed[chosen]])
            found[2].extend(max(-(2**63), min(2**63 - 1, int(s))) for s in score[chosen])
    return found


def _blocks(vectors: DataFrame, most_rows: int) -> int:
    """The number of blocks of so many rows at most, fewer where vectors are long: a block's matrix takes about BLOCK_BYTES at most."""
    n, width = vectors.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    return max(1, -(-n // max(1, min(most_rows, BLOCK_BYTES // (8 * max(width or 0, 1))))))


def top_k(rows: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k rows with the highest inner products.

    rows and queries: vec_id (whole number) and vector. Rows with one id are found each, and queries with one id
    have a list each; a row is not found for a query of its own id. Missing components of a shorter vector are
    zeros. Ties go to the smaller id. Products beyond a long's range are held at its ends.
    """
    row_blocks, query_blocks = _blocks(rows, BLOCK_ROWS), _blocks(queries, BLOCK_QUERIES)
    block = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows, queries = (df.select(F.monotonically_increasing_id().alias("row"), "vec_id", "vector") for df in (rows, queries))
    left = rows.select(block(row_blocks).alias("b"), every(query_blocks).alias("q"), F.lit(False).alias("asks"), "row", "vec_id", "vector")
    right = queries.select(every(row_blocks).alias("b"), block(query_blocks).alias("q"), F.lit(True).alias("asks"), "row", "vec_id", "vector")

    def meet(table: pa.Table) -> pa.Table:
        asks = table["asks"].to_numpy()
        vectors = _matrix(table["vector"].combine_chunks() if table["vector"].num_chunks != 1 else table["vector"].chunk(0))
        ids, numbers = table["vec_id"].to_numpy(), table["row"].to_numpy()
        own = np.flatnonzero(~asks)
        own = own[np.argsort(ids[own], kind="stable")]
        query, row, score = _best(ids[own], vectors[own], ids[asks], vectors[asks], k)
        query = np.array(query, np.int64)
        return pa.table({"query": pa.array(numbers[asks][query]), "query_id": pa.array(ids[asks][query]), "vec_id": pa.array(row, pa.int64()), "score": pa.array(score, pa.int64())})

    best = left.unionByName(right).groupBy("b", "q").applyInArrow(meet, "query long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
