from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from growthlab.llm import quality


def counts(text):
    words = (text or "").encode().split()
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [line for line in (text or "").split("\n") if line.encode().split()]
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside)


def test_counts_and_verdicts(docs):
    text = {(r["doc_id"]): r["text"] for r in docs.collect()}
    got = quality.judge(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        own = tuple(r[c] for c in quality.COUNTS)
        assert own == counts(text[r["doc_id"]])
        assert r["base_failed"] == (own[0] < 50 or 100 * own[4] > 50 * own[0])
        assert not (r["base_failed"] and r["kept"])
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert all(kept[i] for i in range(60)) and kept[100]
    assert not kept[200] and not kept[208] and not kept[209]


def test_keep_returns_the_rows_as_they_are(docs):
    kept = quality.keep(docs)
    assert kept.schema == docs.schema
    judged = {r["doc_id"] for r in quality.judge(docs).where("kept").collect()}
    assert {r["doc_id"] for r in kept.collect()} == judged


def test_outliers_of_their_own_group(spark):
    """Each language has its own word length, and what is common in one is an outlier in the other."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(600):
        lang, longer = ("de", 9) if i % 2 else ("en", 4)
        if i in (100, 101):  # swapped
            longer = 13 - longer
        words = ["".join(rng.choice(list("abcdefgh"), longer + int(rng.integers(0, 2)))) for _ in range(200)]
        rows.append((i, " ".join(words), lang, "s", "x"))
    found = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _kept string"))
    assert {r["doc_id"] for r in found.where("not kept").collect()} == {100, 101}


def test_cells_of_single_rows_are_rows():
    """The search over cells of one row each is the search over rows, also with copies in one cell."""
    rng = np.random.default_rng(2)
    clean = rng.normal([5, 1.6, 0.1, 0.1, 0.1], [0.9, 0.3, 0.1, 0.1, 0.3], (500, 5))
    x = np.vstack([clean, rng.normal([9, 2.5, 0.9, 0.5, 0.5], 0.05, (100, 5)), np.tile([[9, 2.6, 0.9, 0.5, 0.5]], (80, 1))])
    cells, n = np.unique(x, axis=0, return_counts=True)
    sums, products = cells * n[:, None], np.column_stack([cells[:, i] * cells[:, j] * n for i, j in quality._PAIRS])
    centre, scatter, logdet = quality.least_determinant(n, sums, products)
    expected = plain_mcd(x)
    assert abs(logdet - expected[0]) < 0.05 and np.allclose(centre, expected[1], atol=0.08) and np.allclose(scatter, expected[2], atol=0.08)


def plain_mcd(x, starts=200):
    """(log-determinant, centre, scatter) of the half of x with the least determinant found from many random starts."""
    rng, best, floors, half = np.random.default_rng(0), None, np.diag(np.square(quality.FLOORS)), -(-len(x) // 2)
    for _ in range(starts):
        own = x[rng.choice(len(x), 8, replace=False)]
        for _ in range(30):
            centre, scatter = own.mean(0), np.cov(own.T, bias=True)
            away = x - centre
            nearest = np.argsort(np.einsum("ij,jk,ik->i", away, np.linalg.inv(scatter + floors), away), kind="stable")[:half]
            if len(own) == half and np.array_equal(own, x[nearest]):
                break
            own = x[nearest]
        found = np.linalg.slogdet(np.cov(own.T, bias=True) + floors)[1]
        if best is None or found < best[0]:
            best = found, own.mean(0), np.cov(own.T, bias=True)
    return best


def test_verdicts_are_those_of_a_plain_search(spark):
    """Estimates and verdicts against a minimum-covariance-determinant search from many starts, in two sources."""
    rng, rows = np.random.default_rng(8), []
    for source, centre, share in (("a", [5, 1.6, 0.05, 0.05, 0.1], 0.3), ("b", [7, 1.4, 0.3, 0.02, 0.3], 0.1)):
        clean = rng.normal(centre, [0.8, 0.1, 0.08, 0.1, 0.3], (600, 5))
        odd = rng.normal(np.add(centre, [3, 0.8, 0.6, 0.5, 0.5]), 0.1, (int(600 * share), 5))
        rows += [("en", source, *map(float, r)) for r in np.vstack([clean, odd])]
    table = spark.createDataFrame(rows, ["lang", "source", *quality.STATS])
    estimates = quality.fit(table)
    found = {r["_key"]: r for r in estimates.where("_level = 0").collect()}
    judged = quality.verdicts(table.select("lang", "source", F.lit(False).alias("_base_failed"), *(F.col(s).alias(f"_{s}") for s in quality.STATS)), estimates)
    verdict = {(r["source"], r["_log_words"]): r["_kept"] for r in judged.collect()}
    for source in "ab":
        x = np.array([r[2:] for r in rows if r[1] == source])
        logdet, centre, scatter = plain_mcd(x)
        own = found[f'["=en","={source}"]']
        assert abs(own["logdet"] - logdet) < 0.15
        away = x - centre
        distance2 = np.einsum("ij,jk,ik->i", away, np.linalg.inv(quality.CONSISTENCY * scatter + np.diag(np.square(quality.FLOORS))), away)
        for d, r in zip(distance2, x, strict=True):
            if abs(d - quality.MAX_DISTANCE2) > 0.25 * quality.MAX_DISTANCE2:
                assert verdict[source, r[0]] == (d <= quality.MAX_DISTANCE2)


def test_few_clean_rows_of_a_source_are_kept(spark):
    """A group of any size is judged by its own rows and its language's, without a switch between them."""
    rng, rows = np.random.default_rng(5), []
    for source, n in (("large", 400), ("small", 7), ("one", 1)):
        rows += [(len(rows) + i, " ".join("".join(rng.choice(list("abcdefgh"), int(rng.integers(3, 8)))) for _ in range(int(rng.integers(80, 400)))), "en", source) for i in range(n)]
    rows += [(1000, " ".join("$$$ abc" for _ in range(30)) + " " + " ".join(f"w{i}$" for i in range(100)), "en", "small")]
    got = {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i in range(400)) and sum(got[i] for i in range(400, 408)) == 8 and not got[1000]


def test_many_junk_copies_in_one_source(spark):
    """Identical copies that are 35 to 40 % of a source, and of all rows, leave the estimate to the others."""
    rng = np.random.default_rng(3)
    for share in (0.35, 0.4):
        rows = [(i, " ".join("".join(rng.choice(list("abcdefgh"), int(rng.integers(3, 8)))) for _ in range(int(rng.integers(80, 400))))) for i in range(300)]
        junk = " ".join(f"{w}{'$#&'[n % 3] * 3}" for n, w in enumerate(rows[0][1].split()))
        rows += [(1000 + i, junk) for i in range(round(300 * share / (1 - share)))]
        table = spark.createDataFrame([(*r, "en", "s") for r in rows], "doc_id long, text string, lang string, source string")
        got = quality.judge(table).collect()
        assert not any(r["base_failed"] for r in got)
        assert {r["doc_id"] for r in got if r["kept"]} == set(range(300))


def test_reasons(spark):
    """Each rejection names the base rules, or the statistic with the largest part in the distance."""
    rng = np.random.default_rng(12)
    rows = [(i, " ".join("".join(rng.choice(list("abcdefgh"), int(rng.integers(3, 8)))) for _ in range(int(rng.integers(80, 400))))) for i in range(300)]
    rows += [(400, "few words"), (401, " ".join(f"{'z' * 40}{n}" for n in range(100))), (402, " ".join(f"ab{n}$$$" for n in range(100))), (403, " ".join(f"a{n}b" for n in range(60_000)))]
    table = spark.createDataFrame([(*r, "en", "s") for r in rows], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in quality.judge(table).collect()}
    assert [got[i]["reason"] for i in (400, 401, 402, 403)] == ["base", "log_word_length", "symbol_root", "log_words"]
    assert all((r["reason"] == "") == r["kept"] for r in got.values()) and all(got[i]["kept"] for i in range(300))
    # the parts by numpy
    stats = {r["doc_id"]: r for r in quality.with_statistics(table).collect()}
    estimate = quality.judges(quality._fitted(quality.with_statistics(table))).first()
    inverse = np.array(estimate["inverse"]).reshape(5, 5)
    for i in (401, 402, 403):
        away = np.array([stats[i][f"_{s}"] for s in quality.STATS]) - estimate["centre"]
        assert quality.STATS[int((away * (inverse @ away)).argmax())] == got[i]["reason"] and abs(away @ inverse @ away - got[i]["distance2"]) < 1e-6 * got[i]["distance2"]


def test_nothing(nothing):
    assert quality.judge(nothing).collect() == [] and quality.keep(nothing).collect() == []


def test_all_fail(spark):
    few = spark.createDataFrame([(1, "a b", "en", "s"), (2, None, None, None)], "doc_id long, text string, lang string, source string")
    assert [r["kept"] for r in quality.judge(few).collect()] == [False, False]
    assert quality.keep(few.withColumn("_row", F.lit(1))).collect() == []
