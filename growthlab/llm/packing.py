"""Best-two-fit packing of documents into sequences of at most ``capacity`` tokens.

A document's pieces are at most ``capacity`` long, so the corpus enters the packing as ``capacity``
counts, one for each length: a histogram whose size does not depend on the corpus. Best-two-fit runs
on the counts, one *pattern* of lengths at a time, each used as often as the counts allow, and
gives the same bins as running it over all pieces. A pattern uses up some length, so there are a few
thousand patterns at most. Then each piece finds its sequence from its length and its number among the
pieces of its length: an arithmetic step in the executors. Neither a piece nor a document goes through
the driver, and no group of pieces meets in one task, whatever length is common.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from growthlab.llm.bpe import encoder
from growthlab.llm.store import give_back, slices, written

CAPACITY = 1024
END_ID = 2
#: Largest number of (task, length) counts that are sent to every executor; more are joined by a shuffle.
BROADCAST_COUNTS = 1_000_000


def tokenise(docs: DataFrame, tokenizer: str, end_id: int = END_ID, capacity: int = CAPACITY, keep_ids: bool = True, added_tokens: bool = True) -> DataFrame:
    """Pieces of at most ``capacity`` ids: doc_id, piece, start, length, ids_crc32 and, if kept, ids.

    A document is the ids of its whole text and then ``end_id``. Only a longer one is cut, into pieces of
    exactly ``capacity`` of which the first may be shorter. A null text is empty: one piece, the end id.
    Ids are those of ``tokenizers``: an added token of the file in a text is its own id. Without ``added_tokens`` it is
    text like any other.
    ``task`` and ``nth`` number the pieces of each length within the task that made them.
    """
    fields = [docs.select("doc_id").schema[0], *(T.StructField(n, t, False) for n, t in (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("task", T.IntegerType()), ("nth", T.LongType())))]
    if keep_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType(), False), False))
    schema, end = T.StructType(fields), end_id.to_bytes(4, "little")

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cached = encoder(tokenizer)
        encode, task, seen = cached.encode_added if added_tokens else cached.encode, TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in slices(batches):
            rows: list[tuple] = []
            for doc, text in enumerate(batch.column("text").to_pylist()):
                data = encode(text or "") + end
                stop, total = 0, len(data) // 4
                for piece in range(-(-total // capacity)):
                    start, stop = stop, stop + (capacity if piece else (total - 1) % capacity + 1)
                    own, length = data[4 * start : 4 * stop], stop - start
                    rows.append((doc, piece, start, length, zlib.crc32(own), seen[length], own if keep_ids else None))
                    seen[length] += 1
            doc, piece, start, length, crc, nth, own = zip(*rows, strict=True) if rows else [()] * 7
            out = [batch.column("doc_id").take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([task] * len(doc), pa.int32()), pa.array(nth, pa.int64())]
            if keep_ids:
                ends = np.concatenate([[0], np.cumsum(length, dtype=np.int32)]).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(own), np.int32))))
            yield pa.RecordBatch.from_arrays(out, [f.name for f in fields])
        cached.clear()
        give_back()

    return docs.select("doc_id", "text").mapInArrow(pieces, schema)


def best_two_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Patterns ({length: copies}, times) that pack ``counts[length]`` pieces of each length.

    A bin takes the longest piece that fits until none does. Then its shortest piece is exchanged for the
    two unpacked pieces with the largest sum that the gap and the place of the shortest can hold, if that
    sum is larger than the shortest.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    lengths, out = np.arange(capacity + 1), []
    while left.any():
        free, bin_, gap = left.copy(), Counter(), capacity
        while gap and (fits := np.flatnonzero(free[: gap + 1])).size:
            longest = int(fits[-1])
            copies = min(gap // longest, int(free[longest]))
            bin_[longest] += copies
            free[longest] -= copies
            gap -= copies * longest
        if gap and bin_.total() > 1:
            shortest = min(bin_)
            room = gap + shortest
            some = np.maximum.accumulate(np.where(free > 0, lengths, 0))  # the longest that is left up to a length
            first = np.flatnonzero(free[: room + 1])
            second = some[np.minimum(first, room - first)]
            second = np.where((second == first) & (free[first] < 2), some[np.maximum(second - 1, 0)], second)
            sums = np.where(second > 0, first + second, 0)
            if sums.size and sums.max() > shortest:
                best = int(sums.argmax())
                bin_ = bin_ - Counter([shortest]) + Counter([int(first[best]), int(second[best])])
        times = int(min(left[length] // copies for length, copies in bin_.items()))
        for length, copies in bin_.items():
            left[length] -= times * copies
        out.append((dict(bin_), times))
    return out


def _runs(patterns: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, number of the first piece, first sequence, copies in a sequence, offset of the first
    copy), sorted: which sequences the pieces of a length go to."""
    rows, packed, sequence = [], Counter(), 0
    for pattern, times in patterns:
        offset = 0
        for length in sorted(pattern, reverse=True):
            rows.append((length, packed[length], sequence, pattern[length], offset))
            packed[length] += times * pattern[length]
            offset += length * pattern[length]
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with sequence_id and offset (gapless from 0 in each sequence), in as few sequences as
    best-two-fit finds for the whole table. Other columns stay. No pieces: no rows."""
    pieces = written(pieces, "pieces")
    counts = written(pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("_n")), "piece-counts")
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # capacity rows at most
    runs = _runs(best_two_fit(totals, capacity))
    low = np.zeros(capacity + 2, np.int64)
    np.cumsum(np.bincount(runs[:, 0], minlength=capacity + 1), out=low[1:])

    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("task", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    if counts.count() <= BROADCAST_COUNTS:
        starts = F.broadcast(starts)

    @F.arrow_udf("struct<sequence_id: bigint, offset: bigint>")
    def place(length: pa.Array, number: pa.Array) -> pa.Array:
        length, number = length.to_numpy(zero_copy_only=False).astype(np.int64), number.to_numpy(zero_copy_only=False)
        run = np.empty(len(length), np.int64)
        for each in np.unique(length):
            own = length == each
            run[own] = low[each] + np.searchsorted(runs[low[each] : low[each + 1], 1], number[own], "right") - 1
        nth = number - runs[run, 1]
        sequence = runs[run, 2] + nth // runs[run, 3]
        offset = runs[run, 4] + nth % runs[run, 3] * length
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], ["sequence_id", "offset"])

    placed = pieces.join(starts, ["task", "length"]).withColumn("_at", place("length", F.col("_start") + F.col("nth")))
    return placed.select(*(c for c in pieces.columns if c not in ("task", "nth")), "_at.sequence_id", "_at.offset")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = True, added_tokens: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids (if kept), sequence_id, offset for every document.

    Repeated rows are packed each; columns other than doc_id and text are not read.
    """
    return pack(tokenise(docs, tokenizer, end_id, capacity, keep_ids, added_tokens), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The token sequences themselves: sequence_id, ids, and the documents in them in order."""
    members = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))  # capacity pieces at most
    return packed.groupBy("sequence_id").agg(members.alias("m")).select("sequence_id", F.flatten("m.ids").alias("ids"), F.col("m.doc_id").alias("doc_ids"))
