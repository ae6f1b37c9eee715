"""The corpus queries opN_<name> and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversation_repair, conversation_trie, cotrain, decontaminate, lang_id, near_dup, quality_rules, secret_scan, substring_dedup, token_store, url_filter, warc
from .common import materialise, shared_dir, table


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), size=2, percent=80).drop("node")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = warc.plan(table(spark, sf_dir, "pages", "page_id", "url", "html"), min_bytes=0)
    archives = materialise(warc.write(planned, shared_dir(spark, "warc")), "warc-files")
    return warc.scan(archives, archives.count()).drop("target_uri")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.withColumn("items_sha256", F.sha2(F.array_join("item_ids", ","), 256)).drop("item_ids")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_scan(table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrain.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.identify(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(bpe.round_trip(table(spark, sf_dir, "documents", "doc_id", "text"), path, public_tokenizers.PATTERN))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(substring_dedup.deduplicate(table(spark, sf_dir, "documents", "doc_id", "text")))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    files, n = token_store.store(table(spark, sf_dir, "documents", "doc_id", "text"), path, public_tokenizers.PATTERN)
    return token_store.read_summary(files, token_store.vocabulary_size(path), n)


#: Rules of op11: host, path, verdict.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge(table(spark, sf_dir, "pages", "page_id", "url"), rules)


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = conversation_trie.sequences(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    return conversation_trie.trie(conversation_trie.rebuilt(own))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversation_repair.damaged(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    return conversation_repair.digests(rows, materialise(conversation_repair.plan(rows), "plans"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_near_dedup, op2_warc, op3_decontamination, op4_secret_scan, op5_quality_classifier, op6_lang_id, op7_byte_bpe, op8_substring_dedup, op9_quality_rules, op10_token_store, op11_url_filter, op12_conversation_trie, op13_conversation_repair)}


def oracle_sql() -> dict[str, str]:
    from .sql import ORACLES

    return ORACLES
