"""License scans by diagonal voting, in DataFrame functions only.

Every window of ``K`` words of a text is joined to the same windows of the license templates, by hash and
then by the words themselves. A hit at word p of the text and word t of the template votes for the diagonal
p - t: where the template would start. A template that stands in the text unchanged has all its windows on
one diagonal; one with a few words added or lost has them on neighbouring diagonals, which are merged.
A span is verified by its share of the template's windows and by its length. Notices of related licenses
differ in a word or two, so of verified notices that overlap the one with the largest share stays.

The templates here are a small fixed table, so they are broadcast whatever the corpus; the texts are never
shuffled, only one row for each text and one for each hit. Templates of more than BROADCAST_WORDS are joined by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from growthlab.llm.license_texts import TEXTS
from growthlab.llm.store import lower_ascii, written

K = 3
#: Diagonals so many words apart belong to one span.
MAX_SHIFT = 2
#: Least share of a template's windows in a verified span, and its greatest length in template lengths.
LEAST_SHARE, MAX_STRETCH = 0.8, 1.5
#: Templates of so many words together are sent to every executor; more are joined by a shuffle of the windows.
BROADCAST_WORDS = 100_000
#: Overlapping spans meet in stretches of so many words.
STRETCH = 64

# Labels with the phrases that give them wherever they stand, then the wording of notices.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
NOTICES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international"),
    ("cc-by", "creative commons attribution 4 0 international"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-2", "gnu general public license version 2"),
    ("agpl-3", "gnu affero general public license version 3"),
    ("lgpl-2.1", "gnu lesser general public license version 2 1"),
    ("lgpl-3", "gnu lesser general public license version 3"),
    *((label, f"this {what} is free software you can redistribute it and or modify it under the terms of the gnu {name} as published by the free software foundation either version {version} of the license or at your option any later version") for label, what, name, version in (
        ("gpl-2", "program", "general public license", "2"),
        ("gpl-3", "program", "general public license", "3"),
        ("agpl-3", "program", "affero general public license", "3"),
        ("lgpl-2.1", "library", "lesser general public license", "2 1"),
        ("lgpl-3", "library", "lesser general public license", "3"),
    )),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    *TEXTS,
)
_NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str) -> Column:
    """Runs of digits, letters a-z and characters beyond ASCII, after A-Z is lower-cased; null: none."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(F.col(text), F.lit(""))), _NO_WORD), "")


def windows(words: str) -> Column:
    """All windows of K words, joined by spaces, in order."""
    at = lambda i: F.concat_ws(" ", *(F.get(words, i + k) for k in range(K)))
    return F.when(F.size(words) >= K, F.transform(F.sequence(F.lit(0), F.size(words) - K), at))


def template_windows(spark: SparkSession, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """hash, window, template, label, base, grams (windows of the template), t (the window's place)."""
    rows = []
    for n, (label, phrase) in enumerate((*phrases, *notices)):
        own = phrase.split()
        if len(own) < K:
            raise ValueError(f"a template of fewer than {K} words: {phrase}")
        rows += [(" ".join(own[t : t + K]), n, label, n < len(phrases), len(own) - K + 1, t) for t in range(len(own) - K + 1)]
    table = spark.createDataFrame(rows, "window string, template int, label string, base boolean, grams int, t int")
    return table.select(F.xxhash64("window").alias("hash"), "*")


def _best(spans: DataFrame) -> DataFrame:
    """spans without those notices that overlap a notice of another label with a larger share, or with the same
    share of more windows. Spans are compared within stretches of a text, so there are few pairs."""
    key, values = ["row", "template", "span"], ["label", "first", "end", "share", "hits"]
    at = F.explode(F.sequence(F.floor(F.col("first") / STRETCH), F.floor(F.col("end") / STRETCH))).alias("at")
    notices = spans.where("not base").select(*key, *values, at)
    rivals = notices.select("row", "at", *(F.col(c).alias(f"r_{c}") for c in values))
    better = (F.col("r_share") > F.col("share")) | ((F.col("r_share") == F.col("share")) & (F.col("r_hits") > F.col("hits")))
    overlap = (F.col("first") < F.col("r_end")) & (F.col("r_first") < F.col("end"))
    lost = notices.join(rivals, ["row", "at"]).where((F.col("label") != F.col("r_label")) & overlap & better)
    return spans.join(lost.select(*key).distinct().withColumn("lost", F.lit(True)), key, "left").where("lost is null").drop("lost")


def scan(docs: DataFrame, phrases=PHRASES, notices=NOTICES) -> tuple[DataFrame, DataFrame]:
    """(texts, spans): a row for each row of docs with doc_id and n_words; and every base phrase and
    verified notice, with its row, label, first and last word, share and whether it is a base phrase.

    A null text has no words. Repeated rows are rows of their own. Only doc_id and text are read.
    """
    split = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words("text").alias("words"))
    rolled = split.select("row", "doc_id", F.size("words").alias("n_words"), F.posexplode_outer(windows("words")).alias("p", "window"))
    hashed = rolled.withColumn("hash", F.xxhash64("window"))
    template = template_windows(docs.sparkSession, phrases, notices)
    if sum(len(p.split()) for _, p in (*phrases, *notices)) <= BROADCAST_WORDS:
        template = F.broadcast(template)
    joined = hashed.join(template, ["hash", "window"], "left")
    found = written(joined.where("t is not null or p = 0 or p is null").drop("hash", "window"), "license-hits")

    votes = found.where("t is not null").groupBy("row", "template", "label", "base", "grams", (F.col("p") - F.col("t")).alias("diagonal")).agg(F.collect_set("t").alias("ts"), F.min("p").alias("low"), (F.max("p") + K).alias("high"))
    apart = F.col("diagonal") - F.lag("diagonal").over(Window.partitionBy("row", "template").orderBy("diagonal"))
    starts = votes.withColumn("starts", F.when(F.col("base") | apart.isNull() | (apart > MAX_SHIFT), 1).otherwise(0))
    upto = Window.partitionBy("row", "template").orderBy("diagonal").rowsBetween(Window.unboundedPreceding, 0)
    spans = (
        starts.withColumn("span", F.sum("starts").over(upto))
        .groupBy("row", "template", "label", "base", "grams", "span")
        .agg(F.min("low").alias("first"), F.max("high").alias("end"), F.size(F.array_distinct(F.flatten(F.collect_list("ts")))).alias("hits"))
        .withColumn("share", F.col("hits") / F.col("grams"))
    )
    long_ = F.col("end") - F.col("first") > MAX_STRETCH * (F.col("grams") + K - 1)
    spans = spans.where(F.when(F.col("base"), F.col("share") == 1).otherwise((F.col("share") >= LEAST_SHARE) & ~long_))
    spans = _best(written(spans, "license-spans"))
    texts = found.select("row", "doc_id", "n_words").distinct()
    return texts, spans.select("row", "label", "base", "first", (F.col("end") - 1).alias("last"), "share")


def label(docs: DataFrame, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score for each row of docs."""
    texts, spans = scan(docs, phrases, notices)
    base = lambda c: F.when(F.col("base"), F.col(c))
    own = spans.groupBy("row").agg(
        F.count_if("base").alias("n_base"),
        F.min(base("first")).cast("long").alias("first_word"),
        F.max(base("first")).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(base("label"))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("share").alias("score"),
    )
    zero = {"n_base": 0, "base_labels": "", "labels": "", "score": 0.0}
    return texts.join(own, "row", "left").select("doc_id", F.col("n_words").cast("long"), "n_base", "first_word", "last_word", "base_labels", "labels", "score").fillna(zero)
