"""Cross-tokenizer alignment: two tokenizers' tokens of one text, linked where their bytes overlap.

The texts of a batch lie one after another, and each tokenizer's token ends are marked in a packed bitset over their bytes. The AND
of both are the bytes at which both end a token: shared cuts, which part a text into groups. Rank, a running count of the words'
populations and that within one word, maps a cut to the number of tokens before it, so cuts become ranges of tokens. The OR of
both are the ends of the stretches that belong to one token of each side: one stretch for each pair of overlapping tokens, whose
tokens are again ranks. So groups and links of all texts expand together, without a loop over tokens.

An id pair counts the documents that hold it linked. Documents stand in blocks; a block's distinct pairs are counted
first, so the shuffle carries one row for each pair of a block, and a pair that all documents hold is no larger than the number of
blocks. The counts go back to the blocks that asked for them, and each block adds them up: no table of all pairs is sent anywhere.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from itertools import pairwise
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from growthlab.llm.bpe import byte_of_char, encoder
from growthlab.llm.store import give_back, slices, spread_join, written
from growthlab.llm.tokens import batches_by_bytes, has_word_pieces, safe_parts

#: Bytes of text that are aligned at once, and distinct links of a block of documents.
SLICE, BLOCK_LINKS = 1_000_000, 1_000_000
_SPACE = "▁"


class ByteLevel:
    """Tokens of space + text by a byte-level BPE file; its special tokens in a text are text like any other."""

    def __init__(self, path: str):
        self.encoder = encoder(path)
        if not self.encoder.plain:
            raise ValueError(f"not a plain byte-level file: {path}")
        byte, vocabulary = byte_of_char(), json.loads(Path(path).read_text())["model"]["vocab"]
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(byte[c] for c in token) if set(token) <= byte.keys() else token.encode()

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(self.encoder.encode(" " + t), "<u4").astype(np.int64) for t in texts]

    def clear(self) -> None:
        self.encoder.clear()


class Pieces:
    """Tokens of a text by a sentencepiece model, which puts the space before it."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.splits = has_word_pieces(self.model)
        self.bytes = [self._bytes(i) for i in range(self.model.get_piece_size())]

    def _bytes(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        return bytes([int(piece[1:-1], 16)]) if self.model.is_byte(i) else piece.replace(_SPACE, " ").encode()

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        parts, first = [], [0]
        for text in texts:
            own = safe_parts(text) if self.splits else [text]
            parts += [p[n > 0 :] for n, p in enumerate(own)]  # a part's space is the one that the model adds
            first.append(len(parts))
        found = []
        for low, high in batches_by_bytes(np.array([len(p.encode()) for p in parts], np.int64)):
            found += [np.array(ids, np.int64) for ids in self.model.encode(parts[low:high], num_threads=1)]
        return [np.concatenate([np.empty(0, np.int64), *found[a:b]]) for a, b in pairwise(first)]

    def clear(self) -> None: ...


_loaded: dict[str, ByteLevel | Pieces] = {}


def side(path: str) -> ByteLevel | Pieces:
    """The worker's tokenizer of a file, kept between tasks that reuse the worker."""
    if path not in _loaded:
        _loaded[path] = (Pieces if Path(path).suffix == ".model" else ByteLevel)(path)
    return _loaded[path]


class Bits:
    """A set of places in a packed bitset, with rank and select."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def of(cls, places: np.ndarray, size: int) -> Bits:
        marks = np.zeros(64 * (size // 64 + 1), bool)  # a bit more than size: rank(size) is asked for
        marks[places] = True
        return cls(np.packbits(marks, bitorder="little").view("<u8"))

    def __and__(self, other: Bits) -> Bits:
        return Bits(self.words & other.words)

    def __or__(self, other: Bits) -> Bits:
        return Bits(self.words | other.words)

    def rank(self, place: np.ndarray) -> np.ndarray:
        """How many members are less than each place."""
        word, bit = place >> 6, (place & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def select(self) -> np.ndarray:
        """All members in order."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


class Alignment:
    """Groups and links of texts that lie one after another, each of which both tokenizers' tokens (a and b: ids of all
    texts; their lengths in bytes) cover to its last byte. stops: the texts' ends."""

    def __init__(self, a: np.ndarray, b: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray, stops: np.ndarray):
        size = int(stops[-1]) if len(stops) else 0
        ends_a, ends_b = Bits.of(np.cumsum(a_sizes) - 1, size), Bits.of(np.cumsum(b_sizes) - 1, size)
        shared, either = ends_a & ends_b, ends_a | ends_b
        cut, stretch = shared.select(), either.select()
        self.a, self.b = a, b
        #: the tokens of each side before the end of each group
        self.group_a, self.group_b = ends_a.rank(cut + 1), ends_b.rank(cut + 1)
        #: the token of each side of each link
        self.link_a, self.link_b = ends_a.rank(stretch), ends_b.rank(stretch)
        #: groups, links and tokens before the end of each text
        self.groups, self.links = shared.rank(stops), either.rank(stops)
        self.tokens_a, self.tokens_b = ends_a.rank(stops), ends_b.rank(stops)

    def written_out(self, n_a: int) -> np.ndarray:
        """Numbers of what stands in ``a1,a2|b1;a3|b2,b3;``, in order: 2 * id, or 2 * (n_a + id) on the other side, and 1
        more for the last of a group on its side."""
        sizes_a, sizes_b = np.diff(self.group_a, prepend=0), np.diff(self.group_b, prepend=0)
        last = lambda ends, n: np.bincount(ends - 1, minlength=n)
        out = np.empty(len(self.a) + len(self.b), np.int64)
        out[np.arange(len(self.a)) + np.repeat(self.group_b - sizes_b, sizes_a)] = 2 * self.a + last(self.group_a, len(self.a))
        out[np.arange(len(self.b)) + np.repeat(self.group_a, sizes_b)] = 2 * (n_a + self.b) + last(self.group_b, len(self.b))
        return out


_ROW = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


class _Aligner:
    """Aligns texts by two files; keeps the tables of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = side(path_a), side(path_b)
        self.sizes_a, self.sizes_b = (np.array([len(t) for t in s.bytes], np.int64) for s in (self.a, self.b))
        self.out = [mark for side_, marks in ((self.a, ",|"), (self.b, ",;")) for i in range(len(side_.bytes)) for mark in (f"{i}{marks[0]}".encode(), f"{i}{marks[1]}".encode())]

    def _covered(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], list[int]]:
        """The ids of both sides of each text, and the bytes that they cover: none where either's don't join to space + text."""
        ids_a, ids_b, sizes = self.a.ids(texts), self.b.ids(texts), []
        for n, text in enumerate(texts):
            data = b" " + text.encode()
            if not text or any(b"".join(map(s.bytes.__getitem__, ids[n].tolist())) != data for s, ids in ((self.a, ids_a), (self.b, ids_b))):
                ids_a[n] = ids_b[n] = np.empty(0, np.int64)
                data = b""
            sizes.append(len(data))
        return ids_a, ids_b, sizes

    def rows(self, texts: list[str]) -> list[pa.Array]:
        """n_a, n_b, n_groups, n_links, groups_sha256, pairs (distinct; a's id << 32 | b's) and times of each text."""
        ids_a, ids_b, sizes = self._covered(texts)
        a, b = (np.concatenate([np.empty(0, np.int64), *x]) for x in (ids_a, ids_b))
        found = Alignment(a, b, self.sizes_a[a], self.sizes_b[b], np.cumsum(sizes))
        each = lambda upto: np.diff(upto, prepend=0)
        symbols, low, hashes = found.written_out(len(self.a.bytes)), 0, []
        for high in (found.tokens_a + found.tokens_b).tolist():
            hashes.append(hashlib.sha256(b"".join(map(self.out.__getitem__, symbols[low:high].tolist()))[:-1]).hexdigest() if high > low else "")
            low = high
        pair, text = a[found.link_a] << 32 | b[found.link_b], np.repeat(np.arange(len(texts)), each(found.links))
        order = np.lexsort((pair, text))
        pair, text = pair[order], text[order]
        first = np.flatnonzero(np.concatenate([np.ones(min(len(pair), 1), bool), (pair[1:] != pair[:-1]) | (text[1:] != text[:-1])]))
        ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(text[first], minlength=len(texts)))]).astype(np.int32))
        times = np.diff(np.append(first, len(pair))).astype(np.int32)
        lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (pair[first], times)]
        return [*(pa.array(each(x), pa.int64()) for x in (found.tokens_a, found.tokens_b, found.groups, found.links)), pa.array(hashes, pa.string()), *lists]


def links(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """block, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs and times (how often a pair is linked) of each row of docs."""
    schema = T.StructType([T.StructField("block", T.LongType(), False), docs.select("doc_id").schema[0], *T.DataType.fromDDL(f"{_ROW}, pairs array<long>, times array<int>")])

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner, block, held = _Aligner(path_a, path_b), TaskContext.get().partitionId() << 32, 0
        for batch in slices(batches, most=SLICE):
            out = aligner.rows([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(batch), pa.int64()), batch.column("doc_id"), *out], schema.names)
            held += len(out[-1].values)
            if held >= BLOCK_LINKS:
                block, held = block + 1, 0
        aligner.a.clear()
        give_back()

    return docs.select("doc_id", "text").mapInArrow(each, schema)


def _summed(rows: pa.Table, values: pa.Table) -> pa.Table:
    """doc_id, ..., n_best and count_sum of a block's rows. values: pair, n, best, once for each pair of the block."""
    order = np.argsort(values["pair"].to_numpy())
    pairs, n, best = (values[c].to_numpy()[order] for c in ("pair", "n", "best"))
    lists, times = (rows[c].combine_chunks() for c in ("pairs", "times"))
    at = np.searchsorted(pairs, lists.flatten().to_numpy())
    ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
    often = times.flatten().to_numpy().astype(np.int64)
    upto = lambda x: np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[ends]
    out = rows.drop_columns(["block", "pairs", "times"])
    out = out.append_column("n_best", pa.array(np.diff(upto(often * best[at])))).append_column("count_sum", pa.array(np.diff(upto(often * n[at]))))
    give_back()
    return out


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best and count_sum of each row of docs.

    a are the tokens of space + text, b those of the text by a model that puts the space there itself (either side takes either
    kind of file). Groups lie between bytes at which both end a token; links are all pairs of tokens of both whose bytes overlap. A pair
    of ids counts the rows of docs that hold it linked: repeated rows and rows of one doc_id count each. n_best are the links
    whose pair counts most of all pairs of its a, ties included; count_sum adds up the counts of all links. A text that is null or
    empty, or that either side's tokens don't join to (unusual white space marks), has no tokens: zeros, and an empty hash. An
    empty table gives no rows. Columns other than doc_id and text aren't read.
    """
    rows = written(links(docs, path_a, path_b), "alignments")
    held = written(rows.select("block", F.explode("pairs").alias("pair")).groupBy("block", "pair").agg(F.count(F.lit(1)).alias("n")), "block-pairs")
    counts = written(held.groupBy("pair").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("blocks")), "pair-counts")
    of_a = F.shiftright("pair", 32)
    most = counts.groupBy(of_a.alias("a")).agg(F.max("n").alias("most"))  # a row for each id of the vocabulary at most
    valued = counts.join(most, of_a == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    values = spread_join(held.select("block", "pair"), valued, "pair", "block", counts=counts.select("pair", F.col("blocks").alias("n")))
    names = [f for f in rows.columns if f not in ("block", "pairs", "times")]
    schema = T.StructType([*(rows.schema[f] for f in names), T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])
    return rows.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(_summed, schema)


def linked_pairs(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """a, b, n: every pair of ids that documents hold linked, and the number of rows that do."""
    found = links(docs, path_a, path_b).select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    return found.select(F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(2**32 - 1).cast("int").alias("b"), "n")
