"""Near-duplicate documents: HyperMinHash sketches, banding, estimation and verification on full sets.

A document's set are its 64-bit hashed word shingles. The top bits of a hash choose one of ``BUCKETS``
registers, which keeps the least of the other bits as its number of leading zeros and ``MANTISSA`` bits
after them: 16 bits. An empty register takes the value of another, by probes that are alike for
all documents, so that each register of two documents agrees with the probability of their similarity.

Documents with equal sets form a class; only the least id of a class goes on. The registers of a class
are cut into bands, and classes that agree in a band share a bucket. A pair at the least similarity of 0.8
misses all ``BANDS`` bands with a probability of 2e-9. Links within a bucket are found without all its
pairs. Every member is held against a centre of the bucket, the one that meets most others in all its buckets: of a text
and its copies with few words changed that is the text itself, to which all are nearest. Those links give components. Members still in
different components of a bucket are then looked up by their rarest shingles (prefix filtering), which
loses no link and does not pair those that differ too much. All pairs pass an estimate of the
similarity, corrected for registers that agree by chance, with a margin of 8 standard errors; of each class
the best is verified first, on full sets in the JVM, and then the best between components that are left.
So every link counts or is implied. Buckets, centres and nodes that hold a large share of the rows are dealt
out over several tasks in every join (``spread_join``).
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from growthlab.llm.store import give_back, possibly, remove, slices, spread_join, written

BUCKETS = 256
MANTISSA = 10
BANDS, BAND_REGISTERS = 51, 5
LEAST_PERCENT = 80
#: Words in a shingle.
SHINGLE = 2
MARGIN = 8.0
#: Entries of a task's cache of word hashes before it starts afresh: some 5 MB.
CACHE_ENTRIES = 50_000

_HASH_BITS, _BUCKET_BITS = 64, 8
_PROBES = np.stack([np.random.default_rng(j).permutation(BUCKETS) for j in range(BUCKETS)])
_MIX = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


def shingles(data: bytes, size: int, hash_of: _WordHashes) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles of so many words; with fewer words, of all its words."""
    words = data.lower().split()  # bytes: only A-Z, and only ASCII white space
    if not words:
        return np.empty(0, np.uint64)
    size = min(size, len(words))
    hashes = np.fromiter(map(hash_of.__getitem__, words), np.uint64, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        out = (out ^ hashes[k : len(words) - size + 1 + k]) * _MIX[0]
        out = (out ^ (out >> np.uint64(30))) * _MIX[1]
        out = (out ^ (out >> np.uint64(27))) * _MIX[2]
        out ^= out >> np.uint64(31)
    return np.unique(out)


def registers(hashes: np.ndarray) -> bytes:
    """The sketch of sorted hashes: BUCKETS little-endian 16-bit registers. Of no hashes: all zero."""
    out = np.zeros(BUCKETS, np.uint16)
    if len(hashes):
        rest = _HASH_BITS - _BUCKET_BITS
        bucket = (hashes >> np.uint64(rest)).astype(np.int64)
        first = np.flatnonzero(np.diff(bucket, prepend=-1))  # the least of each bucket, as hashes are sorted
        least = hashes[first] & np.uint64(2**rest - 1)
        bits = np.frexp((least >> np.uint64(3)).astype(np.float64))[1] + 3  # 53 bits: exact
        zeros = np.minimum(rest - bits, rest - MANTISSA - 1).astype(np.uint64)
        after = (least << (zeros + np.uint64(1))) & np.uint64(2**rest - 1)
        out[bucket[first]] = (zeros << np.uint64(MANTISSA)) + (after >> np.uint64(rest - MANTISSA)) + np.uint64(1)
        empty = np.flatnonzero(out == 0)
        if empty.size:
            probes = _PROBES[empty]
            out[empty] = out[probes[np.arange(len(empty)), (out != 0)[probes].argmax(axis=1)]]
    return out.tobytes()


def sketches(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, set_hash (128 bits) and registers of each row of docs."""
    fields = [docs.select("doc_id").schema[0], T.StructField("n_shingles", T.LongType()), T.StructField("set_hash", T.BinaryType()), T.StructField("registers", T.BinaryType())]

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hash_of = _WordHashes()
        for batch in slices(batches):
            sizes, sets, sketch = [], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                own = shingles(text or b"", size, hash_of)
                sizes.append(len(own))
                sets.append(xxhash.xxh3_128_digest(own.tobytes()))
                sketch.append(registers(own))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary()), pa.array(sketch, pa.binary())], [f.name for f in fields])
        del hash_of
        give_back()

    return docs.select("doc_id", "text").mapInArrow(each, T.StructType(fields))


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node that it reaches) for all nodes of edges (a, b), by alternating stars.

    Each round is aggregations and joins over the edges, until they are one edge from every node to the
    least; no group of neighbours is gathered, and the edges of a node that has very many are dealt out.
    """
    edges = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges, number = written(edges, "edges"), F.count(F.lit(1)).alias("n")
    while not _is_stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), number), "least")
        joined = spread_join(both, least.select("a", "m"), "a", "b", counts=least)
        large = written(joined.where("b > a and b <> m").select(F.col("m").alias("a"), "b"), "large-stars")
        centre = large.groupBy("b").agg(F.min("a").alias("m"), number)
        small = spread_join(large, centre.select("b", "m"), "b", "a", counts=centre).where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        edges = written(small.unionByName(centre.select(F.col("m").alias("a"), "b")).distinct(), "edges", edges, least, large)
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component"))


def _is_stars(edges: DataFrame) -> bool:
    """Whether each node of edges (a < b) is either a centre or has one centre: then centres are the least nodes."""
    sides = edges.select(F.col("a").alias("node"), F.lit(0).alias("n")).unionByName(edges.select(F.col("b").alias("node"), F.lit(1).alias("n")))
    other = sides.groupBy("node").agg(F.sum("n").alias("centres"), F.min("n").alias("least")).where("centres > 1 or (centres = 1 and least = 0)")
    return not other.limit(1).count()


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The share of registers that agree by chance in the sketches of sets of so many hashes without a common one.

    With r hashes a bucket, a register's least hash x has the density r * exp(-r * x) for the unit interval. At k leading
    zeros a register stands for a cell as wide as 2**-(k + 1 + MANTISSA), and two agree if they meet in one cell.
    """
    r, s = (np.maximum(np.asarray(x, float) / BUCKETS, 1.0)[..., None] for x in (n, m))  # an empty register has another's value
    k = np.arange(_HASH_BITS - _BUCKET_BITS - MANTISSA)
    met = np.exp(-(r + s) * 0.5 ** (k + 1)) - np.exp(-(r + s) * 0.5**k)
    return (0.5 ** (k + 1 + MANTISSA) * r * s / (r + s) * met).sum(axis=-1)


@F.arrow_udf(T.DoubleType())
def _estimate(a: pa.Array, b: pa.Array, n: pa.Array, m: pa.Array) -> pa.Array:
    """The similarity of two sets by their registers, less the share that agrees by chance."""
    left, right = (np.frombuffer(b"".join(x.to_pylist()), "<u2").reshape(-1, BUCKETS) for x in (a, b))
    by_chance = chance(n.to_numpy(zero_copy_only=False), m.to_numpy(zero_copy_only=False))
    return pa.array(((left == right).mean(axis=1) - by_chance) / (1 - by_chance))


def _least_estimate(n: Column, m: Column, least_percent: int) -> Column:
    """MARGIN standard errors below the least similarity: fewer registers have hashes of their own in small sets."""
    filled = F.greatest(BUCKETS * -F.expm1(-F.least(n, m) / BUCKETS), F.lit(1.0))
    j = least_percent / 100
    return j - MARGIN * F.sqrt(j * (1 - j) / filled)


def _similar_size(n: Column, m: Column, least_percent: int) -> Column:
    return 100 * F.least(n, m) >= least_percent * F.greatest(n, m)


def _sets(docs: DataFrame, needed: DataFrame, size: int) -> DataFrame:
    """id, set: the full sets of the rows of docs whose ids (doc_id) are needed."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hash_of = _WordHashes()
        for batch in slices(batches):
            sets = [shingles(t or b"", size, hash_of).view(np.int64) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*sets, np.empty(0, np.int64)])))], ["id", "set"])
        del hash_of
        give_back()

    id_type = docs.schema["doc_id"].dataType.simpleString()
    maybe, _ = possibly(docs.select("doc_id", "text"), "doc_id", needed)
    return maybe.join(needed, "doc_id", "left_semi").mapInArrow(each, f"id {id_type}, set array<long>")


def _with_sides(pairs: DataFrame, sides: DataFrame, how: str = "inner") -> DataFrame:
    """pairs (a, b and more; written) with the columns of sides (id and others) for a and for b, named x_a and x_b."""
    side = lambda c: sides.select(*(F.col(x).alias(c if x == "id" else f"{x}_{c}") for x in sides.columns))
    number = F.count(F.lit(1)).alias("n")
    first = spread_join(pairs, side("a"), "a", "b", how, pairs.groupBy("a").agg(number))
    return spread_join(first, side("b"), "b", "a", how, pairs.groupBy("b").agg(number))


def _likely(pairs: DataFrame, classes: DataFrame, least_percent: int) -> DataFrame:
    """a, b, estimate, most: those of the pairs (a, b, most) of class ids whose sketches may belong to a link."""
    judged = _with_sides(pairs, classes.select(F.col("rep").alias("id"), "n", "registers"))
    judged = judged.withColumn("estimate", _estimate("registers_a", "registers_b", "n_a", "n_b"))
    judged = judged.where(F.col("estimate") >= _least_estimate(F.col("n_a"), F.col("n_b"), least_percent))
    return judged.groupBy("a", "b").agg(F.max("estimate").alias("estimate"), F.max("most").alias("most"))


def _verified(pairs: DataFrame, sets: DataFrame, least_percent: int) -> DataFrame:
    """Of the pairs (a, b; written) of class ids, those that are links. sets: id, set."""
    shared = F.size(F.array_intersect("set_a", "set_b"))
    link = 100 * shared >= least_percent * (F.size("set_a") + F.size("set_b") - shared)
    return _with_sides(pairs.select("a", "b"), sets).where(link).select("a", "b")


def _best(likely: DataFrame) -> DataFrame:
    """The pair with the highest estimate of each class."""
    both = likely.select(F.col("a").alias("x"), "a", "b", "estimate").unionByName(likely.select(F.col("b").alias("x"), "a", "b", "estimate"))
    return both.groupBy("x").agg(F.max(F.struct("estimate", "a", "b")).alias("best")).select("best.a", "best.b").distinct()


def _between(likely: DataFrame, found: DataFrame) -> DataFrame:
    """Of the likely pairs between components of found (node, component), the best for each two components,
    and those that had a bucket to themselves; _rest covers all others."""
    both = _with_sides(likely, found.withColumnRenamed("node", "id"), "left").withColumns({"c_a": F.coalesce("component_a", "a"), "c_b": F.coalesce("component_b", "b")})
    both = written(both.where("c_a <> c_b"), "between")
    best = both.groupBy(F.least("c_a", "c_b"), F.greatest("c_a", "c_b")).agg(F.max(F.struct("estimate", "a", "b")).alias("best"))
    return written(best.select("best.a", "best.b").union(both.where("most = 2").select("a", "b")).distinct(), "between-best", both)


def _edges(found: DataFrame) -> DataFrame:
    return found.select(F.col("component").alias("a"), F.col("node").alias("b"))


def _size_class(n: Column) -> Column:
    """Sizes within a tenth of each other, or in the next class."""
    return F.floor(F.log(n) / math.log(1.1)).cast("int")


def _rest(others: DataFrame, sets: DataFrame, least_percent: int) -> DataFrame:
    """Pairs (a, b) that may be links between different components of a bucket. others: key, rep, n, component.

    A link needs a common shingle among the rarest of both sets, at places that leave room for the overlap: such a place bounds the
    other set's size, so members are looked up by shingle and class of sizes, and where no size is possible not at all.
    Members outside the largest component of a bucket are looked up with such shingles among all its
    members: the many that differ too much have no rare shingle in common, and are never paired.
    """
    counts = others.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"))
    largest = counts.groupBy("key").agg(F.max(F.struct("c", "component")).alias("most"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    apart = spread_join(others, largest, "key", "rep").groupBy("rep").agg(F.min("component").alias("component"), F.max(F.col("component") != F.col("most.component")).alias("odd"))
    apart = written(apart, "apart")
    tokens = written(sets.join(apart, F.col("id") == F.col("rep"), "left_semi").select("id", F.xxhash64("set").alias("of"), F.size("set").alias("n"), F.explode("set").alias("token")), "apart-tokens")
    number = written(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "apart-common")
    ranked = spread_join(tokens, number.select("token", F.col("n").alias("df")), "token", "id", counts=number).groupBy("id", "of", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("shared"))  # one document's
    placed = ranked.select("id", "n", F.size("shared").alias("size"), F.posexplode("shared.token").alias("i", "token"))
    own = placed.join(apart, F.col("id") == F.col("rep")).withColumn("place", F.col("n") - F.col("size") + F.col("i"))  # a token of its own comes first
    own = own.where(100 * (F.col("n") - F.col("place")) >= least_percent * F.col("n"))
    own = written(own.select("token", "rep", "n", "component", "odd", "place"), "apart-prefixes", tokens, number)
    least, most = F.ceil(least_percent * F.col("n") / 100), F.floor((100 + least_percent) * (F.col("n") - F.col("place")) / least_percent) - F.col("n")
    side = lambda df, c: df.select("token", "class", *(F.col(x).alias(f"{x}_{c}") for x in ("rep", "n", "component", "place")))
    overlap = F.least(F.col("n_x") - F.col("place_x"), F.col("n_y") - F.col("place_y"))
    room = (100 + least_percent) * overlap >= least_percent * (F.col("n_x") + F.col("n_y"))
    odd = own.where(F.col("odd") & (least <= most)).withColumn("class", F.explode(F.sequence(_size_class(least), _size_class(most))))
    all_ = own.where(least <= most).withColumn("class", _size_class(F.col("n")))
    pairs = side(odd, "x").join(side(all_, "y"), ["token", "class"]).where((F.col("component_x") != F.col("component_y")) & room)
    return written(pairs.select(F.least("rep_x", "rep_y").alias("a"), F.greatest("rep_x", "rep_y").alias("b")).distinct(), "apart-pairs", own, apart)


def groups(docs: DataFrame, size: int = SHINGLE, least_percent: int = LEAST_PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs.

    A text without words, or null, has an empty set and no links. A document with fewer words than a shingle
    has all its words as one. Rows with one doc_id are one document: the links of each of its texts count.
    Rows without an id are not linked, have no component and are kept. n_shingles counts 64-bit hashes, not the
    shingles themselves. Only doc_id and text are read.
    """
    rows = written(sketches(docs, size), "sketches")
    full = rows.where("n_shingles > 0 and doc_id is not null")
    number = F.count(F.lit(1)).alias("n")
    classes = full.groupBy("set_hash").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers"), F.count(F.lit(1)).alias("copies"))
    classes = written(classes, "classes")
    own = F.when(F.col("n_shingles") > 0, F.col("set_hash"))
    rep = classes.select("set_hash", "rep")
    at = spread_join(rows.select("doc_id", "n_shingles", own.alias("set_hash")), rep, "set_hash", "doc_id", "left", classes.select("set_hash", F.col("copies").alias("n")))
    at = written(at.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("rep")).alias("rep")), "class-of-rows", rows)

    key = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring("registers", i * 2 * BAND_REGISTERS + 1, F.lit(2 * BAND_REGISTERS))))
    bands = classes.select("rep", "n", F.explode(key).alias("key"))
    shared = written(bands.groupBy("key").agg(number).where("n > 1"), "shared-bands")
    met = F.sum("members").over(Window.partitionBy("rep"))  # BANDS rows at most
    maybe, _ = possibly(bands, "key", shared)
    members = written(spread_join(maybe, shared.withColumnRenamed("n", "members"), "key", "rep", counts=shared).withColumn("met", met), "members")
    met_reps = written(members.select(F.col("rep").alias("doc_id")).distinct(), "met")
    sketched = written(possibly(classes.select("rep", "n", "registers"), "rep", members)[0], "met-classes", classes)
    centres = members.groupBy("key").agg(F.max(F.struct("met", F.xxhash64("rep").alias("place"), "rep", "n")).alias("centre"))
    stars = spread_join(members, centres, "key", "rep", counts=shared).where((F.col("rep") != F.col("centre.rep")) & _similar_size(F.col("n"), F.col("centre.n"), least_percent))
    pairs = written(stars.select(F.least("rep", "centre.rep").alias("a"), F.greatest("rep", "centre.rep").alias("b"), "members").groupBy("a", "b").agg(F.max("members").alias("most")), "pairs")
    sets = written(_sets(docs, met_reps, size), "sets")
    likely = written(_likely(pairs, sketched, least_percent), "likely-pairs", pairs, shared, met_reps)
    split = at.where("rep is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("a", "b")  # ids with several texts
    best = written(_best(likely), "best-pairs")
    found = components(written(_verified(best, sets, least_percent), "links", best).unionByName(split))
    between = _between(likely, found)
    links = written(_verified(between, sets, least_percent), "links", between, likely)
    found = _joined(found, links)
    others = members.where("members > 2").join(found, F.col("rep") == F.col("node"), "left")
    others = written(others.select("key", "rep", "n", F.coalesce("component", "rep").alias("component")), "others", members)
    rest = _rest(others, sets, least_percent)
    rest = written(_likely(rest.withColumn("most", F.lit(0)), sketched, least_percent), "likely-rest", rest, others)
    final = _joined(found, written(_verified(rest, sets, least_percent), "links", sketched, rest))
    remove(sets)

    out = spread_join(at, final.withColumnRenamed("node", "rep"), "rep", "doc_id", "left")
    component = F.when(F.col("rep").isNotNull(), F.coalesce("component", "rep")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """The components of found (node, component) with more links (a, b)."""
    return components(_edges(found).unionByName(links)) if links.limit(1).count() else found


def deduplicate(docs: DataFrame, size: int = SHINGLE, least_percent: int = LEAST_PERCENT) -> DataFrame:
    """The rows of docs, with their columns as they are, of which one for each group of near-duplicates stays:
    that of the least id. Of rows with that id one stays; rows without an id stay."""
    judged = groups(docs, size, least_percent).where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max("kept").alias("_kept"), F.count(F.lit(1)).alias("n"))
    touched = written(judged.where("not _kept or n > 1"), "touched")  # all other rows stay as they are, and where they are
    row = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"))  # no name can clash
    maybe, stay = possibly(row, "_id", touched)
    found = spread_join(maybe, touched.withColumnRenamed("n", "_rows"), "_id", "_row", "left", touched)
    once = stay.unionByName(found.where("_rows is null").select("_row", "_id")).select("_row")
    if touched.where("_kept").limit(1).count():  # the text of a repeated id is only read where there is one
        first = found.where("_kept").groupBy("_id").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
        once = once.unionByName(first.select("_row"))
    return once.select("_row.*")
