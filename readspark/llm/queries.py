"""One thin query for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import decontaminate, language_id, lm_scoring, packing, quality_classifier, quality_rules, simhash, sql, substring_dedup, token_counts, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_archive(_table(spark, sf_dir, "pages"), least_bytes=1000)
    found = warc.read_archive(spark, index)
    return found.select(
        warc.page_of("record_id").alias("page_id"),
        F.col("size").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        "record_type",
        warc.page_of("refers_to").alias("refers_to"),
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(_table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), distance=4, shingle=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality_classifier.train(docs, _table(spark, sf_dir, "labels"), sample_rows=20_000)
    found = quality_classifier.score(docs.select("doc_id", "text"), model)
    return found.select("doc_id", quality_classifier.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=8)
    n_items = F.size("items").cast("long")
    return found.select("doc_id", "n_words", "n_hit", n_items.alias("n_items"), decontaminate.items_digest(F.col("items")).alias("items_sha256"), (n_items >= 2).alias("contaminated"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.select("doc_id", "n_bytes", "n_tokens", token_counts.over_limit(512).alias("over_limit"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(language_id.remainder("doc_id", 4) == 2, F.lit(True))
    profiles = language_id.train(docs.where(~held_out))
    found = language_id.predict(docs, profiles)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.deduplicate(_table(spark, sf_dir, "documents"), window=13)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_warc, op2_quality_rules, op3_lm_scoring, op4_packing, op5_simhash, op6_quality_classifier, op7_decontaminate, op8_token_counts, op9_language_id, op10_substring_dedup)}
ORACLE_SQL: dict[str, str] = dict(sql.ORACLE_SQL)
