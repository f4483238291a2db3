"""Fill-in-middle against plain Python, row by row."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from growthlab.llm import fim
from samples import prose, texts

PATTERN = {"line": r"[^\n]*\n|[^\n]+", "word": r"^[ \t-\r]+|[^ \t-\r]+[ \t-\r]*", "char": r"(?s)."}


def brute(doc, text, unit="line", seed=7, percent=100, spm=50):
    """n, form, prefix_chars, middle_chars, output"""
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    units = re.findall(PATTERN[unit], text)
    n = len(units)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(m in text for m in fim.MARKS) or h3 % 100 >= percent:
        return n, "plain", None, None, text
    if h4 % 100 < spm:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def _rows():
    rng = random.Random(8)
    lines = ["\n".join(prose(rng, rng.randrange(6)) for _ in range(rng.randrange(30))) for _ in range(60)]
    special = ["\n", "\n\n\n", "a\n", "\na", "a\r\nb\r\n", "é\nß\n\U0001f600\n中", "x<P>y\nz", "<S>", "a <M>\n", "<p>\n<s>", "< P>\n", "a b\x85c\nd", "x" * 200_000 + "\n" + "y" * 100, "\n" * 50_000]
    return [(i, t) for i, t, *_ in texts()] + [(1000 + n, t) for n, t in enumerate([*lines, *special])]


@pytest.mark.parametrize("unit", ["line", "word", "char"])
def test_every_row(spark, unit):
    rows = _rows()
    docs = spark.createDataFrame([(i, t, "mine", 5) for i, t in rows], "doc_id long, text string, output string, n int").repartition(4)
    made = fim.transform(docs, unit)
    found = made.withColumn("restored", fim.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: str(r)
    assert sorted((tuple(r)[:6] for r in found), key=key) == sorted(((i, *brute(i, t, unit)) for i, t in rows), key=key)
    assert sorted(((r["doc_id"], r["restored"]) for r in found), key=key) == sorted(((i, t or "") for i, t in rows), key=key)
    assert {r["form"] for r in found} == {"plain", "psm", "spm"}


def test_shares(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a\nb\nc").alias("text"))
    found = {r["form"]: r["count"] for r in fim.transform(docs, seed=1, percent=40, spm_percent=25).groupBy("form").count().collect()}
    assert abs(found["plain"] - 1800) < 120 and abs(found["spm"] - 300) < 80
    rows = fim.transform(docs, seed=1, percent=40, spm_percent=25).collect()
    assert all(tuple(r)[1:] == brute(r["doc_id"], "a\nb\nc", seed=1, percent=40, spm=25) for r in rows)


def test_nothing_and_ids_of_another_type(spark, nothing):
    assert fim.transform(nothing).collect() == []
    rows = spark.createDataFrame([("x", "a\nb"), (None, None), (None, "c\n")], "doc_id string, text string")
    assert {tuple(r) for r in fim.transform(rows).collect()} == {(i, *brute(i, t)) for i, t in (("x", "a\nb"), (None, None), (None, "c\n"))}
    with pytest.raises(ValueError, match="unit"):
        fim.transform(rows, "page")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("ab \n\té\U0001f600<P>"), max_size=12)), max_size=8), st.sampled_from(["line", "word", "char"]), st.integers(0, 3))
def test_the_kernel_on_slices_of_arrays(made, unit, skip):
    draws = np.array([[int(hashlib.sha256(f"7:{n}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for n in range(len(made))] for k in range(4)], np.int64).reshape(4, -1)
    array = pa.array(["before\n"] * skip + made, pa.string())[skip:]
    out = fim.fill_in_middle(array, draws, unit, 100, 50)
    assert list(zip(*(x.to_pylist() for x in out), strict=True)) == [brute(n, t, unit) for n, t in enumerate(made)]
