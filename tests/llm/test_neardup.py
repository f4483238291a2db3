from __future__ import annotations

import random

import numpy as np
import pytest

from samples import lowered, prose
from growthlab.llm import neardup, store


def brute(rows):
    """(doc_id, n_shingles, component_id, kept) of rows (doc_id, text)."""
    sets = []
    for i, text in rows:
        words = lowered(text).split()
        sets.append((i, frozenset(zip(words, words[1:], strict=False)) if len(words) > 1 else frozenset(words)))
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[a + 1 :]:
            if s and t and None not in (i, j) and 100 * len(s & t) >= 80 * len(s | t):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [(i, len(s), i if i is None or not s else find(i), i is None or not s or find(i) == i) for i, s in sets]


def check(df, rows):
    got = [tuple(r) for r in neardup.groups(df).select("doc_id", "n_shingles", "component_id", "kept").collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute(rows)))


def test_groups(docs):
    check(docs, [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_families(spark):
    """Chains and families whose members are similar to some of the others only; and a passage that many share."""
    rng, rows = random.Random(7), []
    for family in range(12):
        words = prose(rng, rng.choice([6, 12, 40, 150])).split()
        for _ in range(25):
            own = list(words)
            for _ in range(rng.randrange(0, max(2, len(words) // 7))):
                own[rng.randrange(len(own))] = f"w{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(own)))
            if rng.random() < 0.3:
                words = own
    passage = prose(rng, 90)
    rows += [(len(rows) + k, f"{passage} {prose(rng, rng.randrange(10, 60))}") for k in range(60)]
    rows += [(len(rows) + k, passage) for k in range(20)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_rows_of_one_id_are_one_document(spark):
    rng = random.Random(8)
    a, b = prose(rng, 50), prose(rng, 50)
    rows = [(5, a), (9, a), (9, b), (7, b), (3, prose(rng, 50))]
    got = {(r["doc_id"], r["component_id"]) for r in neardup.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(5, 5), (9, 5), (7, 5), (3, 3)}


def test_deduplicate(docs):
    left = neardup.deduplicate(docs)
    assert left.schema == docs.schema
    groups = neardup.groups(docs).collect()
    expected = {r["doc_id"] for r in groups if r["kept"] and r["doc_id"] is not None}
    ids = [r["doc_id"] for r in left.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(expected) and ids.count(None) == 1
    assert 100 in expected and not expected & {101, 102, 210}


def test_nothing(nothing):
    assert neardup.groups(nothing).collect() == [] and neardup.deduplicate(nothing).collect() == []


def test_no_words(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (3, " ")], "doc_id long, text string")
    assert sorted(tuple(r) for r in neardup.groups(df).collect()) == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True)]


@pytest.mark.parametrize("n", [5, 60, 400, 3000])
def test_registers_agree_as_often_as_sets(n):
    rng, agree = np.random.default_rng(n), []
    for _ in range(60):
        both = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        cut = max(1, n // 10)
        a, b = np.sort(rng.permutation(both)[:-cut]), both
        r, s = (np.frombuffer(neardup.registers(x), "<u2") for x in (a, b))
        assert (r > 0).all()
        agree.append((r == s).mean() - len(a) / len(b))
    assert abs(np.mean(agree)) < 0.05


def test_registers_hold_zeros_and_mantissa():
    low = np.array([5 << 40, (1 << 56) + 1, (255 << 56) + (1 << 55) + (3 << 45)], np.uint64)
    r = np.frombuffer(neardup.registers(low), "<u2").astype(int)
    zeros = 56 - (5 << 40).bit_length()
    assert r[0] == (zeros << 10) + (((5 << 40) >> (55 - zeros - 10)) & 1023) + 1
    assert r[255] == 3 + 1
    assert not np.frombuffer(neardup.registers(np.empty(0, np.uint64)), "<u2").any()


def test_components(spark):
    edges = [(n, n + 1) for n in range(1, 60)] + [(100, 200), (200, 150), (7, 7)]
    got = {tuple(r) for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(n, 1) for n in range(2, 61)} | {(200, 100), (150, 100)}


def test_large_stars_are_dealt_out(spark, monkeypatch):
    """The same result where nearly every key counts as hot."""
    monkeypatch.setattr(store, "HOT_ROWS", 5)
    rng = random.Random(9)
    words = prose(rng, 120).split()
    rows = [(k, " ".join([*words[:k], f"own{k}", *words[k + 1 :]])) for k in range(60)] + [(100 + k, " ".join(words)) for k in range(30)] + [(200, prose(rng, 80)), (None, "x y"), (201, None)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)
    edges = [(n, 1000) for n in range(40)] + [(1000, n) for n in range(2000, 2040)] + [(3, 4), (5000, 5001)]
    got = {tuple(r) for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(n, 0) for n in [*range(1, 40), 1000, *range(2000, 2040)]} | {(5001, 5000)}


@pytest.mark.parametrize(("n", "m"), [(3000, 3000), (3000, 12000), (20000, 24000)])
def test_chance_of_disjoint_sets(n, m):
    rng, agree, trials = np.random.default_rng(n + m), 0, 1500
    for _ in range(trials):
        r, s = (np.frombuffer(neardup.registers(np.sort(rng.integers(0, 2**64, k, dtype=np.uint64))), "<u2") for k in (n, m))
        agree += int((r == s).sum())
    expected = float(neardup.chance(np.array([n]), np.array([m]))[0]) * trials * neardup.BUCKETS
    assert abs(agree - expected) < 5 * expected**0.5


def test_families_of_a_template(spark, monkeypatch):
    """Short texts of one template, no two of them links: few pairs are estimated, however many there are."""
    seen = {}
    real = neardup._likely

    def counted(pairs, *more):
        seen["pairs"] = seen.get("pairs", 0) + pairs.count()
        return real(pairs, *more)

    monkeypatch.setattr(neardup, "_likely", counted)
    rng = random.Random(11)
    words = [f"w{n}" for n in range(60)]
    for n in (500, 2000):
        rows = []
        for k in range(n):
            own = list(words)
            for place in rng.sample(range(60), 8):
                own[place] = f"own{k}-{place}"
            rows.append((k, " ".join(own)))
        seen.clear()
        got = neardup.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
        assert {r["component_id"] for r in got} == set(range(n))
        assert seen["pairs"] < 60 * n, (n, seen)


def test_possibly(spark):
    rows = spark.range(20_000).selectExpr("if(id = 7, null, id) AS k", "id AS v", "'x' AS _page")
    keys = spark.range(0, 20_000, 100).selectExpr("id AS k")
    maybe, others = store.possibly(rows.select("k", "v"), "k", keys)
    found, left = {r["k"] for r in maybe.collect()}, {r["k"] for r in others.collect()}
    assert found >= set(range(0, 20_000, 100)) and len(found) < 230 and found | left == {None, *range(20_000)} - {7} and not found & left
    assert [x.count() for x in store.possibly(rows.select("k", "v"), "k", keys.limit(0))] == [0, 20_000]
    monkey = store.BITMAP_BITS
    try:
        store.BITMAP_BITS = store.PAGE_BITS  # full
        maybe, others = store.possibly(rows.select("k", "v"), "k", spark.range(1_000_000).selectExpr("id AS k"))
        assert (maybe.count(), others.count()) == (19_999, 1)
    finally:
        store.BITMAP_BITS = monkey
