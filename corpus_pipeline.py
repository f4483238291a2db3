"""The corpus pipeline: quality rules, near-dedup, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet in the shared folder and read
again as the next one's docs. All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from growthlab.llm import mixing, neardup, packing, quality
from growthlab.llm.store import written

#: Words in a shingle of the near-dedup stage; two are op7's own.
SHINGLE = 5
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no base rule and no robust distance rejects."""
    return quality.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of the least id."""
    return neardup.deduplicate(docs, SHINGLE)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 tokens."""
    return packing.pack_documents(docs, TOKENIZER, keep_ids=False, added_tokens=True)


STAGES = [("quality rules", quality_rules), ("near-dedup", near_dedup), ("mixing", mix), ("packing", pack)]

#: Robust estimates, sketches and hash draws have no counterpart in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after another, over the whole of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
