from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from samples import lowered
from growthlab.llm import license_texts, licenses, queries
from sqlcheck import compare_rows

TEXTS = [
    "Released under the MIT License.", "under the\nMIT-license under  the mit license", "Apache License, Version 2.0", "apache licence version 2", "CC BY-NC cc by nc cc-by-nc", "cc by ncé",
    "This work is licensed under the GNU General Public License, version 3.", "licensed under the GNU very General Public License version 3", "licensed under the gnu",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this fine software and associated documentation files", "permission is hereby granted",
    "", None, "mit", "a b", "x " * 30000 + "under the mit license", "redistribution and use in source and binary forms with or without any modification are permitted provided that the following conditions are met",
    "licensed under the apache license version 2 0 " * 50, "\u212aelvin under the mit license \u0130", "---", "licensed under cc by nc 4 0",
]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('licenses')}/t"
    rows = [(n, t, "r", "w", 1) for n, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, row string, words string, n_words int").write.parquet(path)
    return spark.read.parquet(path)


def test_base(table):
    got = {r["doc_id"]: r for r in licenses.label(table).collect()}
    assert len(got) == len(TEXTS)
    for n, text in enumerate(TEXTS):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text).decode())
        places = [(k, label) for label, phrase in licenses.PHRASES for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        r = got[n]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(words), len(places), ",".join(sorted({label for _, label in places}))), text
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_labels_of_the_method(table):
    labels = {r["doc_id"]: r["labels"] for r in licenses.label(table).collect()}
    assert labels[6] == "gpl-3" and labels[7] == labels[8] == "" and labels[9] == "mit" and labels[10] == "" and labels[16] == "bsd" and labels[5] == ""


HEADER = "This {} is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."


def test_related_licenses(spark):
    """Headers that differ in a word or two get the label of their own license only."""
    texts = [
        ("gpl-3", HEADER.format("program", "General Public License", "3")), ("gpl-2", HEADER.format("program", "General Public License", "2")),
        ("agpl-3", HEADER.format("program", "Affero General Public License", "3")), ("lgpl-2.1", HEADER.format("library", "Lesser General Public License", "2.1")),
        ("gpl-2", "Licensed under the GNU General Public License, version 2"), ("agpl-3", "x " * 60 + HEADER.format("program", "Affero General Public License", "3")),
        ("gpl-2,gpl-3", "Licensed under the GNU General Public License version 2. Licensed under the GNU General Public License version 3"),
    ]
    table = spark.createDataFrame([(n, t) for n, (_, t) in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in licenses.label(table).collect()}
    assert [got[n] for n in range(len(texts))] == [label for label, _ in texts]


def test_whole_texts(spark):
    """Every license text gets its own label only, also with words changed here and there, and not for half of it."""
    def changed(text, every):
        return " ".join("other" if n % every == every - 1 else w for n, w in enumerate(text.split()))

    rows = [(label, "Preface. " + text.upper() + " More words") for label, text in license_texts.TEXTS]
    rows += [(label, changed(text, 40)) for label, text in license_texts.TEXTS if len(text.split()) > 80]
    rows += [("", " ".join(text.split()[len(text.split()) // 2 :])) for label, text in license_texts.TEXTS if label in ("mit", "bsd", "isc", "zlib")]
    table = spark.createDataFrame([(n, t) for n, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in licenses.label(table).collect()}
    assert [got[n] for n in range(len(rows))] == [label for label, _ in rows]


def test_against_sql(spark, table):
    compare_rows(spark, licenses.label(table), queries.ORACLE_SQL["op10_license_diagonals"], documents=table.select("doc_id", "text"))


def test_related_licenses_against_sql(spark, monkeypatch):
    """The SQL chooses among overlapping notices as the operator does; templates too large to be sent are joined by a shuffle."""
    texts = [HEADER.format(w, n, v) for w, n, v in (("program", "General Public License", "2"), ("program", "Affero General Public License", "3"), ("library", "Lesser General Public License", "2.1"))]
    texts += ["Licensed under the GNU General Public License, version 2 and the GNU Lesser General Public License version 3. Apache License, Version 2.0, under the MIT license"]
    small = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "doc_id long, text string")
    compare_rows(spark, licenses.label(small), queries.ORACLE_SQL["op10_license_diagonals"], documents=small)
    monkeypatch.setattr(licenses, "BROADCAST_WORDS", 10)
    compare_rows(spark, licenses.label(small), queries.ORACLE_SQL["op10_license_diagonals"], documents=small)


def test_repeated_rows(table):
    twice = table.unionByName(table)
    assert licenses.label(twice).count() == 2 * len(TEXTS)


def test_spans(table):
    texts, spans = licenses.scan(table)
    found = spans.join(texts, "row").where("doc_id = 9 and not base").first()
    assert (found["label"], found["first"], found["last"]) == ("mit", 0, 20) and found["share"] < 1


def test_templates(spark):
    with pytest.raises(ValueError, match="fewer"):
        licenses.template_windows(spark, [("x", "a b")], [])


def test_nothing_and_native(table):
    assert licenses.label(table.where(F.lit(False))).collect() == []
    plan = licenses.label(table)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
