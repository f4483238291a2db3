"""Token counts of whole texts by public tokenizers, in Arrow functions that return lengths only.

A text is taken apart at safe boundaries first: single spaces between two ASCII letters or digits, where neither the
splitting rule of the file nor one of its tokens reaches across, so that the parts' tokens are those of the whole. The parts
of all texts at hand are then dealt into batches of about equal bytes, encoded a batch at a time, and only the number of
tokens is kept. So neither one long text nor many texts of one batch of Arrow stand in a worker as tokens at once. A
file whose rule isn't known to break at such spaces gets its texts whole.
"""

from __future__ import annotations

import base64
import json
import os
import re
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from growthlab.llm.bpe import PATTERN, is_plain
from growthlab.llm.store import give_back, slices

#: Characters after which a text is cut at the next safe boundary, and bytes encoded at once.
PART_CHARS, BATCH_BYTES = 32_768, 262_144
LIMIT = 512

_SAFE = re.compile("(?<=[0-9A-Za-z]) (?=[0-9A-Za-z])")
#: Fixed value: the splitting pattern of the public word-level BPE files, which takes no white space.
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def safe_parts(text: str, most: int = PART_CHARS) -> list[str]:
    """The text in parts that begin with a safe boundary's space, but for the first. A part has so many characters
    and what follows up to the next boundary."""
    out, start = [], 0
    while len(text) - start > most and (found := _SAFE.search(text, start + most)):
        out.append(text[start : found.start()])
        start = found.start()
    return [*out, text[start:]]


def batches_by_bytes(sizes: np.ndarray, most: int = BATCH_BYTES) -> list[tuple[int, int]]:
    """Ranges of consecutive parts of about equal bytes, as many as hold ``most`` each on average."""
    total = int(sizes.sum())
    if not len(sizes):
        return []
    number = -(-total // most) or 1
    batch = (np.cumsum(sizes) - sizes) * number // max(total, 1)
    ends = [*(np.flatnonzero(np.diff(batch)) + 1).tolist(), len(sizes)]
    return list(zip([0, *ends[:-1]], ends, strict=True))


class Lengths:
    """``of(parts)``: the number of tokens of each; ``splits``: whether texts may be cut; ``drops_space``: whether
    a part's own first space is left out, as the library puts one before each text."""

    def __init__(self, of: Callable[[list[str]], Iterable[int]], splits: bool, drops_space: bool = False):
        self.of, self.splits, self.drops_space = of, splits, drops_space

    def counts(self, texts: list[str]) -> np.ndarray:
        parts, owner = [], []
        for n, text in enumerate(texts):
            own = safe_parts(text) if self.splits else [text]
            if self.drops_space:
                own[1:] = [p[1:] for p in own[1:]]
            parts += own
            owner += [n] * len(own)
        out, sizes = np.zeros(len(texts), np.int64), np.array([len(p.encode()) for p in parts], np.int64)
        for low, high in batches_by_bytes(sizes):
            np.add.at(out, owner[low:high], np.fromiter(self.of(parts[low:high]), np.int64, high - low))
        return out


def _breaks_at_spaces(file: dict) -> bool:
    """Whether no token of a tokenizer's JSON reaches across a safe boundary."""
    splitter, normalizer = file.get("pre_tokenizer") or {}, file.get("normalizer")
    if any(_SAFE.search(t["content"]) for t in file.get("added_tokens", [])):
        return False
    if splitter.get("type") == "Sequence":
        first = splitter["pretokenizers"][0]
        words = first.get("type") == "Split" and first["pattern"].get("Regex") == _WORD_PATTERN and first["behavior"] == "Removed" and first["invert"]
        steps = (normalizer or {}).get("normalizers", [normalizer] if normalizer else [])
        return words and all(s["type"] in ("NFC", "Lowercase") or (s["type"] == "Replace" and s["pattern"] == {"Regex": r"\s+"} and s["content"] == " ") for s in steps)
    return is_plain(file)


def _of_json(path: str) -> Lengths:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return Lengths(lambda parts: map(len, tokenizer.encode_batch_fast(parts, add_special_tokens=False)), _breaks_at_spaces(json.loads(Path(path).read_text())))


def has_word_pieces(model) -> bool:
    """Whether a sentencepiece model leaves texts as they are, puts a space before each, and has no piece in which a
    space follows anything but a space: then its pieces never reach across a single space."""
    identity = b"\n\x08identity" in model.serialized_model_proto()[-64:]  # the normaliser is the last field but for small ones
    pieces = map(model.id_to_piece, range(model.get_piece_size()))
    return identity and model.encode("a", out_type=str)[0].startswith("▁") and not any(re.search("[^▁]▁", p) for p in pieces)


def _of_model(path: str) -> Lengths:
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return Lengths(lambda parts: map(len, model.encode(parts, num_threads=1)), has_word_pieces(model), drops_space=True)


def _of_ranks(path: str) -> Lengths:
    from tiktoken import Encoding

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, Path(path).read_bytes().splitlines())}
    encoding = Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return Lengths(lambda parts: map(len, encoding.encode_ordinary_batch(parts, num_threads=1)), True)


_KINDS = {".json": _of_json, ".model": _of_model, ".tiktoken": _of_ranks}
_loaded: dict[str, Lengths] = {}


def lengths(path: str) -> Lengths:
    """The worker's counter for a file: ``tokenizers`` for .json, ``sentencepiece`` for .model, ``tiktoken`` for .tiktoken.
    Kept between tasks that reuse the worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has its core, and no more
    if path not in _loaded:
        kind = Path(path).suffix
        if kind not in _KINDS:
            raise ValueError(f"a tokenizer's file ends in {', '.join(_KINDS)}: {path}")
        _loaded[path] = _KINDS[kind](path)
    return _loaded[path]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of each row of docs.

    Tokens are those of the file's own library in its default setting, without begin, end or other tokens that it would add;
    special strings within a text are what the library makes of them. A null text is empty: no bytes, no tokens. A null
    doc_id stays, repeated rows are rows each, an empty table gives no rows. Columns other than doc_id and text aren't read.
    """
    id_field = docs.select("doc_id").schema[0]
    schema = T.StructType([id_field, T.StructField("n_bytes", T.LongType(), False), T.StructField("n_tokens", T.LongType(), False)])

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = lengths(tokenizer)
        for batch in slices(batches):
            n = counter.counts([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n)], schema.names)
        give_back()

    rows = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(counted, schema).withColumn("over_limit", F.col("n_tokens") > limit)
