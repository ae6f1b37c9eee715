"""From raw documents to token ids: quality rules, near-dedup, decontamination, secrets, byte-level BPE.

Each stage works on what the one before kept. All but the last return the columns of documents. Stages that drop rows drop
whole documents; the secret stage masks spans in texts. Nulls, empty and long texts, repeated rows and empty tables have
the results that the operators define.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graticule.llm import bpe, decontaminate, near_dup, quality_rules, secret_scan
from graticule.llm.common import materialise, table

#: Words of a shingle and least similarity in percent of near-duplicates; the rank file.
SHINGLE, SIMILARITY = 5, 80
RANKS = "byte_bpe_multi_50k.tiktoken"


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dup.deduplicate(docs, SHINGLE, SIMILARITY)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked."""
    return secret_scan.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids, their number, and whether they decode to the text."""
    # Executors' heaps are full of earlier stages by now: workers keep half of what they would remember alone.
    coded = bpe.verified(docs.select("doc_id", "text"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN, memory=0.5)
    return coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), "decodes")


STAGES = [("quality_rules", rules), ("near_dedup", near_duplicates), ("decontamination", decontamination), ("secret_scan", secrets), ("byte_bpe", tokens)]

#: The stages hash, sketch and encode beyond what SQL can express; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
