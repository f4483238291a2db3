"""Fill-in-middle transformation by one numpy kernel over the UTF-8 buffers of a batch.

The bytes of all texts of a batch lie one after another in one Arrow buffer. A table gives each byte's class; a unit (line,
word or character) begins where the classes of two adjacent bytes say so, or where a text begins. The running
number of units, less that before each text, numbers the units of every text at once; searching this sum finds the bytes at
which all texts are cut. The parts are the same buffer with more offsets, so nothing is copied until the parts are joined in
their new order. No text becomes a Python string.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from growthlab.llm.store import give_back, slices

PREFIX, SUFFIX, MIDDLE = MARKS = "<P>", "<S>", "<M>"
SEED = 7
#: Of a hundred texts, how many are transformed, and of a hundred of those how many take the form spm.
PERCENT, SPM_PERCENT = 100, 50

_OTHER, _INSIDE, _SPACE, _NEWLINE = range(4)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[0x80:0xC0] = _INSIDE  # a byte within a character
_CLASS[[0x20, *range(0x09, 0x0E)]] = _SPACE
_CLASS[0x0A] = _NEWLINE


def _begins() -> dict[str, np.ndarray]:
    """For each kind of unit, whether one begins between two bytes of such classes."""
    before, after = np.indices((4, 4))
    space = lambda c: c >= _SPACE
    return {"line": before == _NEWLINE, "word": space(before) & ~space(after), "char": after != _INSIDE}


#: A line ends with its line feed, a word with the white space after it (that before the first word is a unit of its own).
UNITS = _begins()


def cuts(data: np.ndarray, ends: np.ndarray, first: np.ndarray, second: np.ndarray, unit: str) -> tuple[np.ndarray, ...]:
    """For texts whose bytes lie in data up to ends (one more than texts, from 0): the number of units of each, the byte
    of its two cuts, and the characters before the first and between both. first and second are draws: a text of n units is cut
    after the smaller and the larger of them modulo n + 1."""
    starts, stops = ends[:-1], ends[1:]
    of = _CLASS[data]
    begins = np.zeros(len(data), bool)
    begins[1:] = UNITS[unit][of[:-1], of[1:]]
    begins[starts[starts < stops]] = True
    begun = np.concatenate([[0], np.cumsum(begins)])  # units that begin before each byte
    n = begun[stops] - begun[starts]
    after = np.sort(np.stack([first % (n + 1), second % (n + 1)]), axis=0)
    # the byte where the next unit begins, or the text's end
    low, high = np.minimum(np.searchsorted(begun[1:], begun[starts] + after + 1), stops)
    characters = np.concatenate([[0], np.cumsum(of != _INSIDE)])
    return n, low, high, characters[low] - characters[starts], characters[high] - characters[low]


def _text_buffers(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The texts (null: empty) in a buffer of their own, its bytes, and the ends of the texts in it, from 0."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1] if ends else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data and data.size else np.empty(0, np.uint8)
    return texts, data, ends - ends[0]


def fill_in_middle(texts: pa.Array, draws: np.ndarray, unit: str, percent: int, spm_percent: int) -> list[pa.Array]:
    """n, form, prefix_chars, middle_chars and output of all texts of an array. draws: four numbers a text ([4, texts])."""
    texts, data, ends = _text_buffers(texts)
    first, second, whether, which = draws
    n, low, high, before, between = cuts(data, ends, first, second, unit)
    marked = np.any([pc.match_substring(texts, mark).to_numpy(zero_copy_only=False) for mark in MARKS], axis=0)
    plain = (ends[:-1] == ends[1:]) | marked | (whether % 100 >= percent)
    bounds = np.append(np.stack([ends[:-1], low, high], axis=1).ravel(), ends[-1])
    parts = pa.LargeStringArray.from_buffers(3 * len(texts), pa.py_buffer(bounds), pa.py_buffer(data))
    prefix, middle, suffix = (parts.take(pa.array(np.arange(k, 3 * len(texts), 3))) for k in range(3))
    form = pc.if_else(pa.array(plain), "plain", pc.if_else(pa.array(which % 100 < spm_percent), "spm", "psm"))
    joined = lambda *p: pc.binary_join_element_wise(*(pa.scalar(x, pa.large_string()) if isinstance(x, str) else x for x in p), pa.scalar("", pa.large_string()))
    psm, spm = joined(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle), joined(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)
    output = pc.if_else(pa.array(plain), texts, pc.if_else(pc.equal(form, "spm"), spm, psm))
    return [pa.array(n, pa.int64()), form, pa.array(before, pa.int64(), mask=plain), pa.array(between, pa.int64(), mask=plain), output.cast(pa.string())]


def restored(output: Column, form: Column) -> Column:
    """The text that a form of it came from: no part holds a mark, so the marks show where the parts lie."""
    part = lambda k: F.get(F.split(output, "<[PSM]>", -1), F.lit(k))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)


def draws(seed: int, doc_id: str = "doc_id") -> Column:
    """Four numbers below 2**32: the first four groups of eight digits of the hex SHA-256 of ``seed:doc_id``."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    return F.array(*(F.conv(F.substring(key, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)))


def transform(docs: DataFrame, unit: str = "line", seed: int = SEED, percent: int = PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (code points; null if plain) and output for each row of docs.

    psm is the prefix, the suffix and the middle, each after its mark, spm the suffix first. A text that is empty, null, holds a mark
    or isn't drawn stays as it is: plain. A null doc_id draws as the empty one. Rows of one doc_id draw alike, repeated rows are
    rows each; an empty table gives no rows. Columns other than doc_id and text aren't read.
    """
    if unit not in UNITS:
        raise ValueError(f"a unit is one of {', '.join(UNITS)}: {unit}")
    types = (("n", T.LongType(), False), ("form", T.StringType(), False), ("prefix_chars", T.LongType(), True), ("middle_chars", T.LongType(), True), ("output", T.StringType(), False))
    schema = T.StructType([docs.select("doc_id").schema[0], *(T.StructField(*t) for t in types)])

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            drawn = batch.column("draws").flatten().to_numpy(zero_copy_only=False).reshape(-1, 4).T
            out = fill_in_middle(batch.column("text"), drawn, unit, percent, spm_percent)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *out], schema.names)
        give_back()

    return docs.select("doc_id", "text", draws(seed).alias("draws")).mapInArrow(each, schema)
