from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from samples import lowered
from growthlab.llm import ctw


def kt(zeros, ones):
    out = 0.0
    for k in range(zeros):
        out += math.log((k + 0.5) / (k + 1))
    for k in range(ones):
        out += math.log((k + 0.5) / (zeros + k + 1))
    return out


def block_probability(counts, context, place, depth):
    """log of the weighted probability of the decisions at a place, in all contexts that begin so; counts: (context, place) -> [0s, 1s]."""
    own = [c for (ctx, p), c in counts.items() if p == place and ctx[: len(context)] == context]
    here = kt(sum(c[0] for c in own), sum(c[1] for c in own))
    if len(context) == depth:
        return here
    below = sum(block_probability(counts, context + (b,), place, depth) for b in sorted({ctx[len(context)] for (ctx, p) in counts if p == place and ctx[: len(context)] == context}))
    return np.logaddexp(math.log(0.5) + here, math.log(0.5) + below)


def brute(train, texts, depth):
    """log10 of each text's probability: for each bit, the tree's probability with it by that without it."""

    def decisions(text):
        data = b"\xff" * depth + text + b"\xff"
        for i in range(depth, len(data)):
            context = tuple(reversed(data[i - depth : i]))
            for k in range(8):
                yield context, 1 << k | data[i] >> (8 - k), data[i] >> (7 - k) & 1

    counts = {}
    for text in train:
        for context, place, bit in decisions(text):
            counts.setdefault((context, place), [0, 0])[bit] += 1
    before = {}
    out = []
    for text in texts:
        total = 0.0
        for context, place, bit in decisions(text):
            if (context, place, bit) not in before:
                with_bit = dict(counts)
                zeros, ones = with_bit.get((context, place), (0, 0))
                with_bit[context, place] = [zeros + (bit == 0), ones + (bit == 1)]
                before[context, place, bit] = block_probability(with_bit, (), place, depth) - block_probability(counts, (), place, depth)
            total += before[context, place, bit]
        out.append(total / math.log(10))
    return out


@pytest.mark.parametrize(("depth", "group"), [(3, 100_000), (4, 100_000), (3, 2)])
def test_against_sequential_weighting(spark, monkeypatch, depth, group):
    monkeypatch.setattr(ctw, "GROUP_CODES", group)
    rows = [(1, "abracadabra"), (2, "Abra cad"), (3, "é!"), (4, None), (8, "zzz abra"), (9, "")]
    got = {r["doc_id"]: r for r in ctw.score(spark.createDataFrame(rows, "doc_id long, text string"), depth).collect()}
    train = [lowered(t) for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    assert 0 < len(train)
    for (i, text), expected in zip(rows, brute(train, [lowered(t) for _, t in rows], depth), strict=True):
        assert got[i]["score"] == pytest.approx(expected, rel=1e-9)
        assert got[i]["bits_per_byte"] == pytest.approx(-expected * math.log2(10) / (len(lowered(text)) + 1))


def test_base_model(docs):
    rows = docs.select("doc_id", "text").collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    count = Counter()
    for r in rows:
        if not held(r["doc_id"]):
            count.update([*lowered(r["text"]).split(), b""])
    n, v = sum(count.values()), len(count)
    expected = []
    for r in rows:
        tokens = [*lowered(r["text"]).split(), b""]
        base = sum(math.log10((count[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens)
        expected.append((str(r["doc_id"]), held(r["doc_id"]), len(tokens), sum(count[t] > 0 for t in tokens), n, round(base, 6)))
    got = ctw.score(docs, block_bytes=20_000).collect()  # several blocks
    key = lambda x: (x[0], x[2], x[5])
    found = [(str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got]
    assert sorted(found, key=key) == sorted(expected, key=key)
    one = {(r["doc_id"], r["n_tokens"]): r["score"] for r in ctw.score(docs).collect()}
    assert all(r["score"] == pytest.approx(one[r["doc_id"], r["n_tokens"]], rel=1e-9) for r in got)
    long_ = next(r for r in got if r["doc_id"] == 206)
    assert long_["bits_per_byte"] < 4


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    text = bytes(rng.choice(list(b"abcd \xc3\xa9"), 400).astype(np.uint8))
    code, n = ctw._distinct_codes([text], 3)
    levels = ctw._levels(code, n, 3, 0)
    for context in (code[5] >> 8, 0x616263, 0x7A7A7A):
        every = (context << 8) + np.arange(256)
        assert (10 ** ctw._score_codes(every, levels, [])).sum() == pytest.approx(1)


@pytest.mark.parametrize("at_once", [7, 10_000])
def test_one_row_again_and_again(spark, monkeypatch, at_once):
    """A row that is a third of the table, learnt from or held out, is one row of a block and scored as often as it stands there."""
    monkeypatch.setattr(ctw, "COPIES_AT_ONCE", at_once)
    learnt, kept_out = (next(i for i in range(100, 200) if (zlib.crc32(str(i).encode()) % 5 == 1) == held) for held in (False, True))
    rows = [(i, f"text {i} abra") for i in range(40)] + [(learnt, "again And again")] * 30 + [(kept_out, "held out")] * 25 + [(None, None)] * 60 + [(7, "same id"), (7, "same id")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    seen = []
    monkeypatch.setattr(ctw, "_with_copies", lambda d, c, m, own=ctw._with_copies: seen.append(own(d, c, m)) or seen[-1])
    key = lambda r: (str(r["doc_id"]), r["n_tokens"])
    got = sorted(ctw.score(table, 3, block_bytes=1000).collect(), key=key)
    one = seen[0][0].groupBy("doc_id", "text").count().where("text is null or text in ('again And again', 'held out')")
    assert seen[0][1] and [r["count"] for r in one.collect()] == [1, 1, 1]
    whole = sorted(ctw.score(table, 3).collect(), key=key)  # no row is large enough there
    assert not seen[1][1] and len(got) == len(whole) == len(rows)
    for a, b in zip(got, whole, strict=True):
        assert a["score"] == pytest.approx(b["score"], rel=1e-9) and a["base_score"] == pytest.approx(b["base_score"], rel=1e-9)
        assert all(a[c] == b[c] for c in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens"))


def test_lgamma():
    x = np.array([0.5, 1, 1.5, 7.25, 1e3, 1e9])
    assert ctw._lgamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-12, abs=1e-10)


def test_nothing(nothing):
    assert ctw.score(nothing).collect() == []
