"""Shards by a hierarchical weighted hash tree: regions hold racks, racks hold shards.

A document descends the tree level by level. At each it takes the child with the least draw: an exponential
value whose rate is the child's weight, the sum of the weights below it, fixed by the document's id and the
child's name. So each level shares its documents in proportion to weight, and a document costs as many draws as
the nodes on its way have children, not as many as there are shards.

Where weights grow, what a change adds is a tree of its own, its *generation*: beside the regions of older generations
stand its own, with the added weight, and a document that one of them wins descends within that generation only, to the
shards that grew. Draws of older generations stay as they are, so no document moves between old shards, and a
new shard takes documents only into itself. A weight that falls is taken from its shard's latest generation;
documents then leave or change places only in the subtree that holds it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import zip_longest
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from growthlab.llm.store import numbered, written

SHARDS_PER_RACK, RACKS_PER_REGION = 4, 2
#: Fixed value: a draw is made of so many hexadecimal digits of an MD5 sum.
DIGITS = 13


class Node(NamedTuple):
    """A node of one level (0 regions, 1 racks, 2 shards) of a generation; parent: its place among those of the level above."""

    level: int
    place: int
    parent: int
    number: int
    name: str
    weight: float


def generations(history: Sequence[Sequence[float]]) -> list[dict[int, float]]:
    """What each change of weights added to each shard, as far as later ones left it. history: the weights of
    shards 0, 1, ... at first and after each change."""
    out: list[dict[int, float]] = []
    for weights in history:
        added, before = {}, range(max([0, *(s + 1 for g in out for s in g)]))
        for shard, (weight, _) in enumerate(zip_longest(weights, before, fillvalue=0)):
            have = sum(g.get(shard, 0.0) for g in out)
            if weight > have:
                added[shard] = weight - have
            for g in reversed(out):
                less = min(g.get(shard, 0.0), max(have - weight, 0.0))
                have -= less
                g[shard] = g.get(shard, 0.0) - less
        out.append(added)
    return [{s: w for s, w in g.items() if w > 0} for g in out]


def nodes(history: Sequence[Sequence[float]]) -> list[Node]:
    """The nodes of all generations' trees. Every top node has the place of none, -1, as its parent."""
    weight: dict[tuple, float] = {}
    for g, added in enumerate(generations(history)):
        for shard, w in added.items():
            rack, region = shard // SHARDS_PER_RACK, shard // SHARDS_PER_RACK // RACKS_PER_REGION
            for at in ((0, g, region), (1, g, region, rack), (2, g, region, rack, shard)):
                weight[at] = weight.get(at, 0.0) + w
    if not weight:
        raise ValueError("no shard has a positive weight")
    out, place = [], {}
    for at, w in sorted(weight.items()):
        level, g, *path = at
        place[at] = sum(n.level == level for n in out)
        parent = place[(level - 1, g, *path[:-1])] if level else -1
        out.append(Node(level, place[at], parent, path[-1], f"{('region', 'rack', 'shard')[level]} {path[-1]} of {g}", w))
    return out


def _draw(key: Column, node: Node) -> Column:
    """A draw from the exponential distribution of the node's weight, fixed by key and name."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(node.name + "|"), key)), 1, DIGITS), 16, 10).cast("double")
    return -F.log((bits + 0.5) / F.lit(16.0**DIGITS)) / F.lit(node.weight)


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once."""
    return F.transform(F.array(value), then)[0]


def place(key: Column, *history: Sequence[float]) -> Column:
    """struct<region, rack, shard> of a key among the shards of the last weights of history.

    A shard of weight 0 takes nothing. A null key is an empty one.
    """
    levels = [[n for n in nodes(history) if n.level == level] for level in range(3)]

    def child(level: int, parent: Column, text: Column) -> Column:
        """The place of the child that the key takes; only the children of the parent that it came to are drawn."""
        chosen, families = None, sorted({n.parent for n in levels[level]})
        for family in families:
            own = [n for n in levels[level] if n.parent == family]
            drawn = [F.struct(_draw(text, n).alias("draw"), F.lit(n.place).alias("place")) for n in own]
            best = F.array_min(F.array(*drawn))["place"] if len(own) > 1 else F.lit(own[0].place)
            chosen = F.when(parent == family, best) if chosen is None else chosen.when(parent == family, best)
        return chosen

    def number(level: int, at: Column) -> Column:
        return F.element_at(F.array(*(F.lit(n.number) for n in levels[level])), at + 1)

    def found(region: Column, rack: Column, shard: Column) -> Column:
        return F.struct(number(0, region).alias("region"), number(1, rack).alias("rack"), number(2, shard).alias("shard"))

    descend = lambda text: _once(child(0, F.lit(-1), text), lambda a: _once(child(1, a, text), lambda b: _once(child(2, b, text), lambda c: found(a, b, c))))
    return _once(F.coalesce(key.cast("string"), F.lit("")), descend)


def assign(docs: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, region, rack, shard, slot and, for the weights after a change, grown_shard.

    size: UTF-8 bytes of the text plus 1; a null text has none, and the checksum of nothing. Repeated rows
    go to one shard and have slots of their own. Slots are gapless from 0 in every shard, by doc_id. Columns other
    than doc_id and text are not read.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        place(F.col("doc_id"), weights).alias("at"),
        (place(F.col("doc_id"), weights, grown)["shard"] if grown else F.lit(None).cast("int")).alias("grown_shard"),
    )
    rows = written(rows.select("doc_id", "size", "text_crc32", "at.*", "grown_shard"), "shards")
    found = numbered(rows, ["shard"], ["doc_id", "text_crc32", "size"], "slot")
    return found.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "region", "rack", "shard", "slot", "grown_shard")


def write(docs: DataFrame, weights: Sequence[float], path: str) -> None:
    """The rows of docs as Parquet, a folder for each region, rack and shard; no shuffle."""
    docs.withColumn("_at", place(F.col("doc_id"), weights)).select(*docs.columns, "_at.*").write.partitionBy("region", "rack", "shard").parquet(path)
