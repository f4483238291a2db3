"""Tables written in the cluster's shared folder, so that a lost executor costs no upstream work; and joins,
numbering and batches that no common key and no long text makes larger than a task can hold."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A key with more rows than this, and than a HOT_SHARE-th of all, is dealt out over several tasks in a join.
HOT_ROWS, HOT_SHARE = 1000, 10_000
#: Bits of the bitmap of keys that all executors get, and of a page of it.
BITMAP_BITS, PAGE_BITS = 1 << 26, 1 << 15
#: Bytes of text that a Python worker takes from a batch at once.
SLICE_BYTES = 4_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Unset, a local master gets a temporary folder of its own;
    on a cluster that would lose data with its machine, so it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="growthlab-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, name: str, *used_up: DataFrame) -> DataFrame:
    """df, written as Parquet in the shared folder and read again. Tables of earlier calls that nothing
    else reads are named as used_up: their files are removed."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/growthlab/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    remove(*used_up)
    return out


def remove(*tables: DataFrame) -> None:
    """Removes the files of tables that ``written`` returned. Other DataFrames have none, and are left alone."""
    for table in tables:
        if path := getattr(table, "written_to", None):
            spark = table.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def hot_parts(counts: DataFrame, key: str) -> DataFrame | None:
    """_key and _parts of each key that has more rows (n) than the greater of HOT_ROWS and a HOT_SHARE-th of all
    that have more than HOT_ROWS: 2 * HOT_SHARE parts at most. None: there is no such key."""
    total, most = counts.where(F.col("n") > HOT_ROWS).agg(F.coalesce(F.sum("n"), F.lit(0)), F.max("n")).first()
    limit = max(HOT_ROWS, total // HOT_SHARE)
    if most is None or most <= limit:
        return None
    return written(counts.where(F.col("n") > limit).select(F.col(key).alias("_key"), F.ceil(F.col("n") / limit).cast("int").alias("_parts")), "hot-keys")


def dealt_join(many: DataFrame, one: DataFrame, key: str, deal_by: str, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """many joined to one by a key that is unique in one. Rows of many with a hot key are dealt into its parts by the hash of
    ``deal_by``, and one has a hot key's row once for each part. Only hot keys and numbers of parts are sent to all executors."""
    if hot is None:
        return many.join(one, key, how)
    parted = lambda df: df.join(F.broadcast(hot), F.col(key) == F.col("_key"), "left")
    dealt = parted(many).withColumn("_part", F.coalesce(F.pmod(F.xxhash64(deal_by), "_parts").cast("int"), F.lit(0))).drop("_key", "_parts")
    copies = parted(one).withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts") - 1, F.lit(0))))).drop("_key", "_parts")
    return dealt.join(copies, [key, "_part"], how).drop("_part")


def spread_join(many: DataFrame, one: DataFrame, key: str, deal_by: str, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """many joined to one by a key that is unique in one and may be that of any share of many's rows (``dealt_join``).
    counts, if known: the key and n, its number of rows in many; else they are counted."""
    if counts is None:
        counts = many.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return dealt_join(many, one, key, deal_by, hot_parts(counts, key), how)


def possibly(rows: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the rows whose key may be one of keys, the others): a row whose key is one of them is never among the others, as is a null key always.

    keys has a column of that name. They are hashed into a bitmap of BITMAP_BITS, 8 MB whatever there is, which all executors get. So rows
    that a join would drop, or leave as they are, needn't be shuffled for it. The more keys, the fuller the bitmap: far beyond its
    bits all rows may be among them, and the join that follows decides alone.
    """
    place = lambda c: F.pmod(F.xxhash64(F.lit(17), F.col(c)), F.lit(BITMAP_BITS))
    bits = keys.where(F.col(key).isNotNull()).select(place(key).alias("p")).groupBy(F.floor(F.col("p") / PAGE_BITS).alias("_page"))
    pages = written(bits.agg(F.expr(f"bitmap_construct_agg(p % {PAGE_BITS})").alias("_bits")), "key-bitmap")  # 4 KB a page
    at = F.col("_p") % PAGE_BITS
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = rows.withColumn("_p", place(key)).withColumn("_page", F.floor(F.col("_p") / PAGE_BITS)).join(F.broadcast(pages), "_page", "left")
    maybe = F.coalesce(F.col(key).isNotNull() & (F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(1) == 1), F.lit(False))
    return tuple(found.where(c).select(*rows.columns) for c in (maybe, ~maybe))


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """rows with ``name``: the place from 0 within equal keys, in the order given; rows that tie have any order.

    A sort by range deals any key and any number of ties out over tasks; only a count for each task goes to
    all executors. The first places of hot keys are found by aggregation and joined by ``spread_join``.
    """
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    sorted_ = tied.repartitionByRange(*keys, *order, "_tie").sortWithinPartitions(*keys, *order, "_tie").drop("_tie").withColumn("_id", F.monotonically_increasing_id())
    sorted_ = written(sorted_, "in-order").withColumns({"_task": F.shiftright("_id", 33), "_in": F.col("_id").bitwiseAND(2**33 - 1)})
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    counts = sorted_.groupBy("_task").agg(F.count(F.lit(1)).alias("_n"))  # a row for each task of the sort
    starts = counts.select("_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = sorted_.join(F.broadcast(starts), "_task").withColumn("_at", F.col("_before") + F.col("_in"))
    whole = placed.withColumn("_whole", F.struct(*keys))
    first = whole.groupBy("_whole").agg(F.min("_at").alias("_first"))
    return spread_join(whole, first, "_whole", "_at").withColumn(name, F.col("_at") - F.col("_first")).select(*rows.columns, name)


def running(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """rows with ``name``: the sum of a value (none below 0) of the rows before it within equal keys, in the order given, in which
    no rows tie. As in ``numbered``, a sort by range deals any key out over tasks."""
    sorted_ = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_id", F.monotonically_increasing_id())
    sorted_ = written(sorted_, "in-order").withColumn("_task", F.shiftright("_id", 33))
    so_far = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sorted_.groupBy("_task").agg(F.sum(value).alias("_n"))  # a row for each task of the sort
    starts = sums.select("_task", so_far(Window.orderBy("_task")).alias("_before"))
    placed = sorted_.withColumn("_n", F.col(value)).withColumn("_in", so_far(Window.partitionBy("_task").orderBy("_id"))).join(F.broadcast(starts), "_task")
    whole = placed.select(*rows.columns, (F.col("_before") + F.col("_in")).alias("_at"), F.struct(*keys).alias("_whole"))
    first = whole.groupBy("_whole").agg(F.min("_at").alias("_first"))
    return spread_join(whole, first, "_whole", "_at").withColumn(name, F.col("_at") - F.col("_first")).select(*rows.columns, name)


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of batches in turn, in parts of about so many bytes of text: one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text).cast(pa.large_binary())), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes) // most
        ends = np.append(np.flatnonzero(np.diff(part)) + 1, len(batch))
        low = 0
        for end in ends.tolist():
            if end > low:
                yield batch.slice(low, end - low)
            low = end


def give_back() -> None:
    """Returns what a Python worker has freed to the system: workers outlive their tasks and share an executor's memory."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
        trim(0)


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all other characters as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

