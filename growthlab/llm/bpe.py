"""Token ids of whole texts from a public byte-level BPE file, fast on repeated words.

Byte-level BPE never merges across the pieces that its splitting pattern finds, and a single space
between two non-space characters always starts a new piece. So a text is cut at such spaces with
``str.split``, a frequent chunk is encoded once per task, and the text's ids are the
joined bytes of its chunks. Texts with any other run of white space are encoded whole.

The vocabulary is read from the JSON file by ``tokenizers``; the merges run in ``tiktoken``, whose
ids are the same (tests compare them) at a fraction of the cost for short pieces. Texts that hold an
added token of the file, such as ``<|endoftext|>``, are left to ``tokenizers``, which gives its own id; so
are all texts if the file has another splitter, a normaliser, or merges in another order than its ids.
"""

from __future__ import annotations

import json
from array import array
from pathlib import Path

import tiktoken
from tokenizers import Tokenizer

#: Fixed value: the splitting pattern of the public byte-level BPE files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Entries of a task's cache before it starts afresh: some 10 MB.
CACHE_ENTRIES = 50_000


def byte_of_char() -> dict[str, int]:
    """Byte-level BPE writes printable bytes as themselves and the others from U+0100 upwards."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + n): b for n, b in enumerate(others)}


class _Unsplittable(Exception):
    """The chunk touches other white space, so its text must be encoded whole."""


def is_plain(file: dict) -> bool:
    """Whether a tokenizer's JSON is byte-level BPE as this module runs it."""
    splitter, model = file.get("pre_tokenizer") or {}, file["model"]
    if file.get("normalizer") or model.get("type") != "BPE" or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        return False
    if splitter.get("type") != "ByteLevel" or splitter.get("add_prefix_space") or not splitter.get("use_regex", True):
        return False
    ids = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    return ids == sorted(ids)


class Encoder(dict):
    """``encode(text)``: the text's ids as little-endian unsigned 32-bit bytes, where an added token of the file
    is text like any other; ``encode_added(text)``: the ids of ``tokenizers`` in its default setting.

    As a dict: those of a chunk that follows a space (the space belongs to it).
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.plain = is_plain(json.loads(Path(path).read_text()))
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        byte, vocabulary = byte_of_char(), self.tokenizer.get_vocab(with_added_tokens=False)
        ranks = {bytes(map(byte.__getitem__, token)): i for token, i in vocabulary.items() if set(token) <= byte.keys()}
        ranks = {token: i for token, i in ranks.items() if token != b"<|endoftext|>"}
        encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.ids, self.piece = encoding.encode_ordinary, encoding._core_bpe.encode_single_piece
        self.marks = {mark: array("I", self.ids(mark)).tobytes() for mark in ",."}

    def __missing__(self, chunk: str) -> bytes:
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise _Unsplittable
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        if chunk.isalpha():  # letters alone are one piece of the pattern
            out = array("I", self.piece(b" " + chunk.encode())).tobytes()
        elif chunk[-1] in self.marks and chunk[:-1].isalpha():
            out = self[chunk[:-1]] + self.marks[chunk[-1]]
        else:
            out = array("I", self.ids(" " + chunk)).tobytes()
        self[chunk] = out
        return out

    def encode(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        try:
            if rest and first and first[-1].isspace():
                raise _Unsplittable
            tail = b"".join(map(self.__getitem__, rest))
        except _Unsplittable:
            first, tail = text, b""
        return array("I", self.ids(first)).tobytes() + tail

    def encode_added(self, text: str) -> bytes:
        if not self.plain or any(token in text for token in self.added):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return self.encode(text)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file, with an empty cache; kept between tasks that reuse the worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    _encoders[path].clear()
    return _encoders[path]
