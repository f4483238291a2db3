"""Alignment against loops over all pairs of tokens."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from growthlab.llm import align
from samples import prose, texts

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
_A, _B = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
_A.encode_special_tokens = True


def _unit(c):
    """The byte that a character of a byte-level token stands for."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return ord(c) if ord(c) in printable else [b for b in range(256) if b not in printable][ord(c) - 0x100]


def _spans(ids, data):
    ends = np.cumsum([len(d) for d in data]).tolist()
    return list(zip(ids, [0, *ends[:-1]], ends, strict=True))


def brute_one(text):
    """n_a, n_b, n_groups, n_links, groups_sha256, links of a text"""
    none = (0, 0, 0, 0, "", [])
    if not text:
        return none
    a, b = _A.encode(" " + text, add_special_tokens=False).ids, _B.encode(text)
    bytes_a = [bytes(map(_unit, _A.id_to_token(i))) for i in a]
    bytes_b = [bytes([int(p[3:5], 16)]) if _B.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [_B.id_to_piece(i)]]
    if not b"".join(bytes_a) == b"".join(bytes_b) == b" " + text.encode():
        return none
    a, b = _spans(a, bytes_a), _spans(b, bytes_b)
    cuts = sorted({e for *_, e in a} & {e for *_, e in b})
    groups, low = [], 0
    for cut in cuts:
        groups.append("|".join(",".join(str(i) for i, s, e in side if low <= s and e <= cut) for side in (a, b)))
        low = cut
    links = [(i, j) for i, s, e in a for j, t, f in b if s < f and t < e]
    return len(a), len(b), len(cuts), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest(), links


def brute(rows):
    one = [(doc, *brute_one(text)) for doc, text in rows]
    counts = Counter(pair for *_, links in one for pair in set(links))
    most = Counter()
    for (i, _), n in counts.items():
        most[i] = max(most[i], n)
    return [(*r[:6], sum(counts[p] == most[p[0]] for p in r[6]), sum(counts[p] for p in r[6])) for r in one]


AWKWARD = [
    "a  b", "  a", "a ", "a\nb\n", "▁", "a ▁b", "<|endoftext|>", "<s> a</s> <unk> <0x41>", "\x00\x01", "\U0001f600 \U0001f468‍\U0001f469", "中文字 abc", "é é ﬁ ①", "don't can't 1234567",
    "ภาษาไทย", "ĠĊ", "x" * 300, " " * 40, "a" + " " * 20 + "b", "\r\n\t", "internationalization antidisestablishmentarianism",
]


@pytest.mark.parametrize("block_links", [1_000_000, 300])
def test_every_row(spark, monkeypatch, block_links):
    monkeypatch.setattr(align, "BLOCK_LINKS", block_links)
    monkeypatch.setattr(align, "SLICE", 2000)
    rng = random.Random(6)
    rows = [(i, t) for i, t, *_ in texts() if not t or len(t) < 3000] + [(1000 + n, t) for n, t in enumerate([*AWKWARD, *(prose(rng, rng.randrange(9)) for _ in range(40))])]
    docs = spark.createDataFrame([(i, t, 7, "mine") for i, t in rows], "doc_id long, text string, block int, pairs string").repartition(5)
    found = align.align(docs, A, B).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum").collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, brute(rows)))
    assert {(r["n_a"] > 0) for r in found} == {True, False}


def test_long_text_and_pairs(spark):
    rng = random.Random(2)
    rows = [(1, prose(rng, 12_000)), (2, "of and to in"), (2, "of and to in"), (None, "of and"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {(r["doc_id"], r["n_links"]): r for r in align.align(docs, A, B).collect()}
    text = rows[0][1]
    a, b = _A.encode(" " + text, add_special_tokens=False).ids, _B.encode(text)
    assert [align.side(path).ids([text])[0].tolist() for path in (A, B)] == [a, b]  # in parts, and by repeated chunks
    long_ = next(r for (i, _), r in whole.items() if i == 1)
    assert (long_["n_a"], long_["n_b"]) == (len(a), len(b)) and long_["n_links"] == len(a) + len(b) - long_["n_groups"]
    pairs = {(r["a"], r["b"]): r["n"] for r in align.linked_pairs(docs, A, B).collect()}
    of = (_A.encode(" of").ids[0], _B.encode("of")[0])
    assert pairs[of] == 4 and long_["count_sum"] >= long_["n_links"]


def test_nothing_and_ids_of_another_type(spark, nothing):
    assert align.align(nothing, A, B).collect() == []
    rows = [("x", "two words"), (None, "")]
    found = align.align(spark.createDataFrame(rows, "doc_id string, text string"), A, B).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum").collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, brute(rows)))
    assert {r["n_best"] for r in align.align(spark.createDataFrame([(1, None)], "doc_id long, text string"), A, B).collect()} == {0}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("ab c▁é"), st.characters(codec="utf-8")), max_size=25), max_size=6))
def test_any_text(made):
    aligner = align._Aligner(A, B)
    *values, pairs, times = (x.to_pylist() for x in aligner.rows(made)) if made else ([],) * 7
    for n, text in enumerate(made):
        *expected, links = brute_one(text)
        assert [v[n] for v in values] == expected
        assert dict(zip(pairs[n], times[n], strict=True)) == Counter(i << 32 | j for i, j in links)


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 300)), st.integers(301, 400))
def test_rank_and_select(members, size):
    bits = align.Bits.of(np.array(sorted(members), np.int64), size)
    assert bits.select().tolist() == sorted(members)
    assert bits.rank(np.arange(size + 1)).tolist() == [sum(m < p for m in members) for p in range(size + 1)]


def test_other_sides(spark):
    """Either side takes either kind of file."""
    docs = spark.createDataFrame([(1, "some words, internationalised"), (2, "more")], "doc_id long, text string")
    there, back = ({r["doc_id"]: r for r in align.align(docs, x, y).collect()} for x, y in ((A, B), (B, A)))
    assert all((there[i]["n_a"], there[i]["n_links"], there[i]["n_groups"]) == (back[i]["n_b"], back[i]["n_links"], back[i]["n_groups"]) for i in (1, 2))
    same = align.align(docs, A, A).collect()
    assert all(r["n_a"] == r["n_links"] == r["n_groups"] == r["n_best"] for r in same)
