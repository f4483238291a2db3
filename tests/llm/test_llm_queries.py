"""The registered queries over the smallest tables, against SQL where there is some; and the pipeline."""

from __future__ import annotations

import os
import subprocess
import sys
import zlib
from array import array
from collections import Counter, defaultdict
from itertools import accumulate, pairwise
from pathlib import Path

import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from growthlab.llm import mixing, quality, queries
from growthlab.plans import queries as own
from samples import lowered
from sqlcheck import compare_rows

DATA = os.environ.get("TESTDATA", "/root/testdata/sf0.001")
ROOT = Path(__file__).resolve().parents[2]


def test_one_query_for_each_operator():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    tables = {t: spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "embeddings", "pages", "conversations")}
    compare_rows(spark, queries.QUERIES[name](spark, DATA), queries.ORACLE_SQL[name], **tables)


def test_pipeline_stages(spark, docs):
    assert len(corpus_pipeline.STAGES) == 4
    now, rows = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, now = now, stage(spark, now, DATA)
        assert now.schema == before.schema
        now = spark.createDataFrame(now.collect(), docs.schema)
        rows.append([r["doc_id"] for r in now.collect()])
    judged, single, mixed = rows
    assert not {200, 203, 208, 209} & set(judged) and {0, 1, 2, 100, 101, 102} <= set(judged)
    assert set(single) <= set(judged) and 100 in single and not {101, 102, 210} & set(single)
    assert set(mixed) <= set(single)
    packed = corpus_pipeline.STAGES[-1][1](spark, now, DATA).collect()
    assert sum(r["piece"] == 0 for r in packed) == len(mixed)


def test_pipeline_takes_shingles_of_five_words(spark, docs):
    """A pair at 0.82 by shingles of two words and 0.59 by those of five is no pair of near-duplicates."""
    words = [f"word{n}" for n in range(100)]
    edited = [f"{w}x" if n % 20 == 10 else w for n, w in enumerate(words)]
    rows = spark.createDataFrame([(n, " ".join(w)) for n, w in enumerate((words, edited, words))], "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, rows, DATA).collect()} == {0, 1}


def _reduced(rows, share=80, size=5):
    """The least id of each group of texts that shingles of so many words link, by all pairs."""
    sets = []
    for i, text in rows:
        words = lowered(text).split()
        size_ = min(size, len(words))
        sets.append((i, {tuple(words[k : k + size_]) for k in range(len(words) - size_ + 1)} if words else set()))
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, s) in enumerate(sets):
        for j, t in sets[n + 1 :]:
            if s and t and 100 * len(s & t) >= share * len(s | t):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i for i in parent if find(i) == i}


def test_pipeline_against_plain_computation(spark):
    """The rows of run(): quality's verdicts, then all pairs, targets by source, ids and places, each computed in its own way."""
    packed = corpus_pipeline.run(spark, DATA).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    verdicts = {r["doc_id"]: r["kept"] for r in quality.judge(spark.read.parquet(f"{DATA}/documents.parquet")).collect()}
    passed = [i for i, kept in verdicts.items() if kept]
    assert len(passed) > 0.6 * len(docs) and all(len(lowered(docs[i]["text"]).split()) >= 50 for i in passed)
    single = _reduced([(i, docs[i]["text"]) for i in passed])
    assert len(single) < len(passed)

    copies = Counter(r["doc_id"] for r in packed if r["piece"] == 0)
    assert set(copies) <= single and max(copies.values()) <= mixing.MAX_REPEATS
    words = {i: len(lowered(docs[i]["text"]).split()) for i in single}
    sources = sorted({docs[i]["source"] for i in single}, key=lambda s: (s is None, s))
    sizes = [sum(w for i, w in words.items() if docs[i]["source"] == s) for s in sources]
    for source, size, goal in zip(sources, sizes, mixing.targets(sizes, [mixing.WEIGHTS[n % 3] for n in range(len(sources))]), strict=True):
        own = [w for i, w in words.items() if docs[i]["source"] == source]
        taken = sum(n * words[i] for i, n in copies.items() if docs[i]["source"] == source)
        assert abs(taken - goal) <= max(own) and taken <= 3 * size

    tokenizer = Tokenizer.from_file(corpus_pipeline.TOKENIZER)
    pieces, places = defaultdict(list), defaultdict(list)
    for r in packed:
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, n in copies.items():
        ids = array("I", [*tokenizer.encode(docs[i]["text"], add_special_tokens=False).ids, 2])
        first, expected = (len(ids) - 1) % 1024 + 1, []
        for piece, (low, high) in enumerate(pairwise([0, *range(first, len(ids) + 1, 1024)])):
            expected.append((piece, low, high - low, zlib.crc32(ids[low:high].tobytes())))
        assert sorted(pieces[i]) == sorted(expected * n)
    for own in places.values():
        assert [o for o, _ in sorted(own)] == [0, *accumulate(n for _, n in sorted(own))][:-1] and sum(n for _, n in own) <= 1024
    assert len(places) <= 1.1 * sum(r["length"] for r in packed) / 1024 + 1


def test_pipeline_of_nothing(spark, tmp_path):
    spark.read.parquet(f"{DATA}/documents.parquet").where("false").write.parquet(f"file://{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").collect() == []


def test_entry_without_these_folders(tmp_path):
    """The other queries work where this subpackage and the pipeline are missing."""
    (tmp_path / "growthlab").mkdir()
    for p in (ROOT / "growthlab").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "growthlab" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    code = "import sys; sys.path.insert(0, sys.argv[1]); import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') or n == 'pipeline' for n in e.queries()))"
    said = subprocess.run([sys.executable, "-c", code, str(tmp_path)], capture_output=True, text=True, cwd=tmp_path, check=True).stdout.split()
    assert said == [str(len(own.QUERIES)), "False"]
