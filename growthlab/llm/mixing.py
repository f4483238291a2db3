"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

The documents of a source are dealt by hash into at most ``BLOCKS`` blocks, and a source's target of
words becomes an exact quota of its permuted blocks: whole rounds of all blocks, then the first blocks of
the permutation that the rest of the target holds, and of the next block the part that a second hash cuts off. Where a
long document stands at the cut of a small source, so that more than ``SLACK`` of its target is missing, later blocks that fit
fill that gap. A binary tree over the output shards splits the quotas: at each node the left half's blocks of each source are a multivariate
hypergeometric draw from the node's, so every shard gets its exact share of a random deal. A shard takes
the next blocks of each source's permutation, so that shards are disjoint, and shuffles its rows.

Only one row for each source goes through the driver; sources are checked to be ``MAX_SOURCES`` at
most. Blocks stay in Spark, and a document finds its shards from its own block.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from growthlab.llm.store import written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
SHARDS = 16
BLOCKS = 1024
MAX_SOURCES = 100_000
SEED = 20_240_229
#: A gap of more than this share of a source's target, left by one long document, is filled by later blocks.
SLACK = 0.01
#: Largest number of blocks of all sources that are sent to every executor; more are joined by a shuffle.
BROADCAST_BLOCKS = 200_000
#: Rows that are shuffled together within a shard.
CHUNK_ROWS = 50_000


def targets(sizes: Sequence[int], weights: Sequence[float], max_repeats: float = MAX_REPEATS) -> list[float]:
    """The sum of sizes shared by weight; a share stops at max_repeats times its size and the excess is shared again."""
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if unit * weights[i] > max_repeats * sizes[i]}
        for i in full or open_:
            out[i] = float(max_repeats * sizes[i]) if full else unit * weights[i]
        left -= sum(out[i] for i in full)
        open_ = open_ - full if full else set()
    return out


def split(quotas: Sequence[int], shards: int, seed: int = SEED) -> np.ndarray:
    """[shard, source] blocks: the quotas dealt out among shards as equal as can be, by the splitting tree."""
    rng, out = np.random.default_rng(seed), np.zeros((shards, len(quotas)), np.int64)

    def descend(low: int, high: int, own: np.ndarray) -> None:
        if high - low == 1:
            out[low] = own
            return
        middle = (low + high) // 2
        left = rng.multivariate_hypergeometric(own, int(own.sum()) * (middle - low) // (high - low), method="marginals")
        descend(low, middle, left)
        descend(middle, high, own - left)

    descend(0, shards, np.asarray(quotas, np.int64))
    return out


def _source() -> Column:
    """Sources in order of code points, null last."""
    return F.coalesce(F.concat(F.lit("0"), "source"), F.lit("1"))


def _keyed(rows: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """rows with _source, _block and _cut (the place in the block) from the source and the id."""
    bits = F.xxhash64(doc_id, F.lit(SEED))
    return rows.withColumns({"_source": _source(), "_block": F.pmod(bits, F.lit(BLOCKS)).cast("int"), "_cut": F.pmod(F.shiftrightunsigned(bits, 20), F.lit(BLOCKS)).cast("int")})


def size(text: str) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


_ROUND = "_source string, _block int, place long, words long, source_size long, target double, rounds int, blocks long, whole boolean, cut_here boolean, open double"


def _prefix(own: pd.DataFrame) -> pd.DataFrame:
    """The round of a source that isn't whole: the first of its permuted blocks (BLOCKS at most) that the rest of the
    target holds are whole, and the next is cut, with what is then open."""
    own = own.sort_values(["place", "_block"], ignore_index=True)
    upto, rest = own["words"].cumsum(), float(own["rest"].iloc[0])
    whole = (upto <= rest).to_numpy()
    first = int(whole.sum())
    left = rest - (float(upto.iloc[first - 1]) if first else 0.0)
    own["whole"], own["cut_here"], own["open"] = whole, (np.arange(len(own)) == first) & (left > 0), left
    return own.drop(columns="rest")


def _filled(own: pd.DataFrame) -> pd.DataFrame:
    """The blocks of _prefix with nth, their place among the copies; a gap takes, in the order of the permutation, each
    later block that fits, and then the smallest other is cut."""
    own = own.sort_values(["place", "_block"], ignore_index=True)
    gap, whole, cut = float(own["gap"].iloc[0]), own["whole"].to_numpy(bool, copy=True), own["cut_here"].to_numpy(bool)
    again = np.zeros(len(own), bool)
    for i in np.flatnonzero(~whole & ~cut):
        if 0 < own["words"].iloc[i] <= gap:
            whole[i] = True
            gap -= own["words"].iloc[i]
    others = own["words"].where(~whole & ~cut & (own["words"] > 0)).dropna()
    if gap > 0 and len(others):
        again[others.idxmin()] = True
    own["whole"], own["cut_here"], own["again"], own["open"] = whole, cut, again, gap
    own = own.iloc[np.lexsort((np.arange(len(own)), ~again, ~cut, ~whole))]
    return own.assign(nth=np.arange(len(own), dtype=np.int32))[[f.split()[0] for f in _FILLED.split(", ")]]


_FILLED = "_source string, _block int, source_size long, target double, rounds int, blocks long, whole boolean, cut_here boolean, again boolean, open double, nth int"


def _cuts(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """_source, _block, cut (the greatest _cut within the block that is taken) and taken (its words) for the blocks to be cut:
    edges, _source, _block, open and target, a row for each source at most. What would end nearer to the target by going
    beyond it is taken too, if it is SLACK of the target at most."""
    inside = rows.join(F.broadcast(edges), ["_source", "_block"]).groupBy("_source", "_block", "_cut", "open", "target").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("_source", "_block").orderBy("_cut").rowsBetween(Window.unboundedPreceding, 0))
    nearer = (F.col("upto") - F.col("words") / 2 <= F.col("open")) & (F.col("words") <= 2 * SLACK * F.col("target"))
    fitting = inside.withColumn("upto", upto).where((F.col("upto") <= F.col("open")) | nearer)
    return fitting.groupBy("_source", "_block").agg(F.max("_cut").alias("cut"), F.max("upto").alias("taken"))


def _plan(rows: DataFrame, weights: Sequence[float], shards: int) -> DataFrame:
    """_source, _block, source_size, target, shards (of its copies in order) and last: the greatest _cut
    that the last of the copies takes (null: all). rows: _source, _block, _cut, size."""
    spark = rows.sparkSession
    by_block = written(rows.groupBy("_source", "_block").agg(F.sum("size").alias("words")), "mix-blocks")
    sources = by_block.groupBy("_source").agg(F.sum("words").alias("size"), F.count(F.lit(1)).alias("blocks"))
    found = sorted(sources.limit(MAX_SOURCES + 1).collect())  # one row for each source
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    goal = targets([r["size"] for r in found], [weights[i % len(weights)] for i in range(len(found))])
    rounds = [int(t // r["size"]) if r["size"] else 0 for t, r in zip(goal, found, strict=True)]
    goals = spark.createDataFrame(
        [(r["_source"], r["size"], r["blocks"], t, n, t - n * r["size"]) for r, t, n in zip(found, goal, rounds, strict=True)],
        "_source string, source_size long, blocks long, target double, rounds int, rest double",
    )
    permuted = by_block.join(F.broadcast(goals), "_source").withColumn("place", F.xxhash64("_source", "_block", F.lit(SEED)))
    permuted = permuted.select("_source", "_block", "place", "words", "source_size", "target", "rounds", "blocks", "rest")
    permuted = written(permuted.groupBy("_source").applyInPandas(_prefix, _ROUND), "mix-prefixes")

    edges = permuted.where("cut_here").select("_source", "_block", "open", "target")
    first = written(_cuts(rows, edges), "mix-cuts")
    gaps = edges.join(first, ["_source", "_block"], "left").select("_source", (F.col("open") - F.coalesce("taken", F.lit(0))).alias("gap"))
    gap = F.when(F.col("gap") > SLACK * F.col("target"), F.col("gap")).otherwise(F.lit(0.0))
    filled = permuted.join(F.broadcast(gaps), "_source", "left").withColumn("gap", gap).groupBy("_source").applyInPandas(_filled, _FILLED)
    permuted = written(filled, "mix-permuted", permuted, by_block)
    cuts = first.drop("taken").unionByName(_cuts(rows, permuted.where("again").select("_source", "_block", "open", "target")).drop("taken"))

    taken = permuted.withColumn("cut_here", F.col("cut_here") | F.col("again")).withColumn("copies", F.col("rounds") + (F.col("whole") | F.col("cut_here")).cast("int"))
    quota = {r["_source"]: r["n"] for r in taken.groupBy("_source").agg(F.sum("copies").alias("n")).collect()}
    ends = split([quota[r["_source"]] for r in found], shards).cumsum(axis=0) if found else np.zeros((shards, 0), np.int64)
    ends = spark.createDataFrame([(r["_source"], ends[:, i].tolist()) for i, r in enumerate(found)], "_source string, ends array<long>")
    drawn = taken.join(F.broadcast(ends), "_source").join(F.broadcast(cuts), ["_source", "_block"], "left")
    position = lambda k: k.cast("long") * F.col("blocks") + F.col("nth")
    shard = F.transform(F.expr("if(copies > 0, sequence(0, copies - 1), cast(array() AS array<int>))"), lambda k: F.size(F.filter("ends", lambda end: end <= position(k))))
    last = F.when(F.col("cut_here"), F.coalesce("cut", F.lit(-1)))
    return drawn.select("_source", "_block", "source_size", "target", shard.alias("shards"), last.alias("last"))


def _dealt(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows (with _source, _block, _cut) with source_size, target and the shards of each row's own copies."""
    plan = written(plan, "mix-plan")
    if plan.count() <= BROADCAST_BLOCKS:
        plan = F.broadcast(plan)
    copies = F.size("shards") - F.coalesce((F.col("_cut") > F.col("last")).cast("int"), F.lit(0))
    return rows.join(plan, ["_source", "_block"]).withColumn("shards", F.slice("shards", F.lit(1), copies))


def deal(docs: DataFrame, weights: Sequence[float] = WEIGHTS, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, source_size, target, taken and shards (one for each copy), a row for each row of docs.

    A null text has no words, a null source is a source, the last in order. Repeated rows are dealt alike.
    Columns other than doc_id, text and source are not read. No rows: no result rows.
    """
    rows = written(_keyed(docs.select("doc_id", "source", size("text").alias("size"))).drop("source"), "mix-sizes")
    out = _dealt(rows, _plan(rows, weights, shards))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"), "shards")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, shards: int = SHARDS, shard_as: str | None = None) -> DataFrame:
    """The mixed rows: docs' columns, each row as often as it is taken, shuffled within its shard.

    shard_as names a further column with the shard.
    """
    row = docs.select(F.struct("*").alias("_row")).select("_row", "_row.source")  # no name can clash
    keyed = _keyed(row, "_row.doc_id").drop("source")
    rows = written(keyed.select("_source", "_block", "_cut", size("_row.text").alias("size")), "mix-sizes")
    copies = _dealt(keyed, _plan(rows, weights, shards)).select("_row", F.posexplode("shards").alias("_copy", "_shard"))
    chunks = rows.count() // (shards * CHUNK_ROWS) + 1
    placed = copies.withColumn("_place", F.xxhash64("_row.doc_id", "_copy", F.lit(SEED)))
    local = placed.repartition("_shard", F.pmod("_place", F.lit(chunks))).sortWithinPartitions("_shard", "_place")
    return local.select("_row.*", *([F.col("_shard").alias(shard_as)] if shard_as else []))
