from __future__ import annotations

import json
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from growthlab.llm import packing, queries
from growthlab.llm.bpe import PATTERN, Encoder, is_plain

PATH = public_tokenizers.path("byte_bpe_50k.json")


_TOKENIZER = Tokenizer.from_file(PATH)
_CACHED = Encoder(PATH)


def plain(text):
    return _TOKENIZER.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(["<|endoftext|>", *" \n\t.,'sdtlve0aÄ\x1c\x85\u00a0\u3000"]), st.characters(exclude_categories=["Cs"])), max_size=40).map("".join))
def test_ids_are_the_tokenizers(text):
    for _ in range(2):  # the second time from the cache
        assert np.frombuffer(_CACHED.encode_added(text), "<u4").tolist() == plain(text)


def test_added_tokens_of_the_query(spark, tmp_path):
    """op1 against a Tokenizer in its default setting: an added token in a text is one id."""
    default = Tokenizer.from_file(PATH)
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>\n x", "a <|endoftext| > b", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in queries.op1_best_two_fit_packing(spark, str(tmp_path)).collect()}
    for n, text in enumerate(texts):
        ids = [*default.encode(text or "", add_special_tokens=False).ids, 2]
        assert got[n] == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert got[0][0] == 5


def test_pattern():
    assert PATTERN == public_tokenizers.PATTERN


def test_every_document_is_packed_whole(docs):
    packed = packing.pack_documents(docs, PATH)
    got = packed.collect()
    expected = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = [*plain(r["text"] or ""), 2]
        start = 0
        for piece in range(-(-len(ids) // 1024)):
            stop = start + (1024 if piece else (len(ids) - 1) % 1024 + 1)
            expected[r["doc_id"], piece, start, zlib.crc32(np.array(ids[start:stop], "<u4").tobytes()), tuple(ids[start:stop])] += 1
            start = stop
    assert Counter((r["doc_id"], r["piece"], r["start"], r["ids_crc32"], tuple(r["ids"])) for r in got) == expected
    sequences = defaultdict(list)
    for r in got:
        assert r["length"] == len(r["ids"])
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        place = 0
        for offset, length in sorted(own):
            assert offset == place
            place += length
        assert place <= 1024
    total = sum(r["length"] for r in got)
    assert len(sequences) <= -(-total // 1024) + 2
    assert sum(len(r["ids"]) for r in packing.sequences(packed).collect()) == total


def test_no_documents(nothing):
    assert packing.pack_documents(nothing, PATH, keep_ids=False).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 50), max_size=25))
def test_patterns_use_each_piece_once(counts):
    used = Counter()
    for pattern, times in packing.best_two_fit(counts, 60):
        assert times > 0 and sum(length * n for length, n in pattern.items()) <= 60
        for length, n in pattern.items():
            used[length] += times * n
    assert used == Counter(counts)


def one_by_one(counts, capacity):
    """Best-two-fit over single pieces."""
    left, bins = sorted(Counter(counts).elements()), []
    while left:
        own, gap = [], capacity
        while any(x <= gap for x in left):
            x = max(x for x in left if x <= gap)
            left.remove(x)
            own.append(x)
            gap -= x
        if gap and len(own) > 1:
            small = min(own)
            pairs = [(a + b, a, b) for i, a in enumerate(left) for b in left[i + 1 :] if small < a + b <= gap + small]
            if pairs:
                best = max(p[0] for p in pairs)
                _, a, b = max((p for p in pairs if p[0] == best), key=lambda p: -max(p[1:]))
                own.remove(small)
                left.remove(a)
                left.remove(b)
                left = sorted([*left, small])
                own += [a, b]
        bins.append(sorted(own))
    return bins


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 6), max_size=12))
def test_patterns_are_those_of_single_pieces(counts):
    patterns = sum(times for _, times in packing.best_two_fit(counts, 30))
    assert abs(patterns - len(one_by_one(counts, 30))) <= 1  # equal sums may be exchanged by other pairs


def test_exchange_fills_a_gap():
    assert packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10) == [({6: 1, 2: 2}, 1), ({3: 1}, 1)]


def test_other_files_are_left_to_the_library(tmp_path):
    file = json.loads(Path(PATH).read_text())
    assert is_plain(file) and _CACHED.plain
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}):
        path = tmp_path / "other.json"
        path.write_text(json.dumps(file | change))
        for text in ("Some Words, and MORE  of them", "", "x<|endoftext|>Y"):
            assert np.frombuffer(Encoder(str(path)).encode_added(text), "<u4").tolist() == Tokenizer.from_file(str(path)).encode(text, add_special_tokens=False).ids


def test_types_of_the_query(nothing):
    assert dict(packing.pack_documents(nothing, PATH, keep_ids=False).dtypes) | {"doc_id": ""} == {"doc_id": "", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"}
