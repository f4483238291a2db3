"""Token counts against the libraries on whole texts."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from growthlab.llm import tokens
from samples import prose, texts

FILES = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken")]


def brute(path):
    """The number of tokens of one whole text."""
    if path.endswith(".model"):
        model = SentencePieceProcessor(model_file=path)
        return lambda text: len(model.encode(text))
    tokenizer = Tokenizer.from_file(path.replace(".tiktoken", ".json"))
    tokenizer.encode_special_tokens = path.endswith(".tiktoken")
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


def awkward():
    rng = random.Random(3)
    return [
        prose(rng, 30_000), "x" * 100_000, " " * 5000, "a  b " * 9000, "a<|endoftext|>b <|startoftext|> c" * 2000, "é à " * 12_000, "don't we'll 12 3 a1 b2 " * 6000, "Á e ́x " * 4000,
        "中文 中 ▁a ▁" * 5000, "line one\nline two \n\n three " * 4000, "\U0001f600 a \U0001f600" * 2000, "a b\x00c \x1c d" * 3000, "<s> </s> <unk> <0x41>" * 500,
    ]


@pytest.mark.parametrize("path", FILES)
def test_parts_have_the_tokens_of_the_whole(path, monkeypatch):
    monkeypatch.setattr(tokens, "PART_CHARS", 1)
    monkeypatch.setattr(tokens.safe_parts, "__defaults__", (1,))
    counter, count = tokens.lengths(path), brute(path)
    assert counter.splits
    made = [t[:20_000] for t in awkward()]
    assert counter.counts(made).tolist() == [count(t) for t in made]


@pytest.mark.parametrize("path", FILES)
@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("aB9 é'.\n▁́Σ"), st.characters(codec="utf-8")), max_size=40), max_size=5))
def test_any_text_in_small_parts(path, made):
    counter, count = tokens.lengths(path), brute(path)
    whole = tokens.safe_parts
    tokens.safe_parts = lambda text: whole(text, 1)
    try:
        assert counter.counts(made).tolist() == [count(t) for t in made]
    finally:
        tokens.safe_parts = whole


def test_safe_parts():
    text = prose(random.Random(1), 20_000)
    parts = tokens.safe_parts(text, 1000)
    assert "".join(parts) == text and len(parts) > 90 and all(p[0] == " " for p in parts[1:]) and max(map(len, parts)) < 1100
    assert tokens.safe_parts("") == [""] and tokens.safe_parts("x" * 100_000) == ["x" * 100_000]


def test_batches_are_balanced_by_bytes():
    sizes = np.random.default_rng(2).integers(0, 30_000, 900)
    found = tokens.batches_by_bytes(sizes, 200_000)
    assert [a for a, _ in found] == [0, *(b for _, b in found[:-1])] and found[-1][1] == 900
    of = [int(sizes[a:b].sum()) for a, b in found]
    assert max(of) <= 230_000 and min(of) >= 140_000
    assert tokens.batches_by_bytes(np.array([], np.int64)) == [] and tokens.batches_by_bytes(np.array([0, 0])) == [(0, 2)] and tokens.batches_by_bytes(np.array([9**9, 1])) == [(0, 1), (1, 2)]


def test_a_file_that_is_not_known_to_break_at_spaces_gets_texts_whole(tmp_path):
    plain = Tokenizer.from_file(FILES[0])
    plain.add_special_tokens(["of course"])
    plain.save(str(path := tmp_path / "own.json"))
    counter = tokens.lengths(str(path))
    assert not counter.splits and counter.counts(["it is of course so " * 4000]).tolist() == [brute(str(path))("it is of course so " * 4000)]


def test_an_unknown_kind_of_file_is_an_error():
    with pytest.raises(ValueError, match="ends in"):
        tokens.lengths("/tmp/own.bin")


@pytest.mark.parametrize("path", FILES[:3])
def test_every_row_is_counted(spark, docs, nothing, path):
    count = brute(path)
    more = spark.createDataFrame([(900 + n, t) for n, t in enumerate(awkward())], "doc_id long, text string")
    found = tokens.token_counts(docs.unionByName(more, allowMissingColumns=True).repartition(3), path)
    expected = [(i, t or "") for i, t, *_ in texts()] + [(900 + n, t) for n, t in enumerate(awkward())]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted(map(tuple, found.collect()), key=key) == sorted(((i, len(t.encode()), n := count(t), n > 512) for i, t in expected), key=key)
    assert tokens.token_counts(nothing, path).collect() == []


def test_ids_of_another_type(spark):
    rows = spark.createDataFrame([("x", "two words"), (None, None)], "doc_id string, text string")
    assert {tuple(r) for r in tokens.token_counts(rows, FILES[0], limit=1).collect()} == {("x", 9, 2, True), (None, 0, 0, False)}
