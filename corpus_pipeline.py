"""From documents to packed training sequences: filter, deduplicate, decontaminate, pack.

Each stage takes the documents that the one before kept and returns documents with the
same columns; ``n_chars`` follows a changed text. The last returns packed pieces. ``run``
writes each stage's documents to the shared folder and reads them again.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readspark.llm import decontaminate, near_copies, packing, quality_classifier, substring_dedup
from readspark.llm._shared import free_name, quoted, stored
from readspark.session import ship

LEAST_QUALITY = 0.7
LEAST_SIMILARITY = 0.8
SIMHASH_BITS = 4


def _as_they_are(docs: DataFrame) -> list:
    return [F.col(quoted(c)) for c in docs.columns]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier scores below LEAST_QUALITY. Nulls and ties: see ``quality_classifier``."""
    labels = ship(spark).read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_classifier.train(docs, labels)
    score = free_name(docs, "score")
    return quality_classifier.score(docs, model, into=score).where(F.col(score) >= LEAST_QUALITY).select(*_as_they_are(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row with the smallest id of each group of near duplicates; rows with a null id stay.

    Near duplicates are texts at a Jaccard similarity of LEAST_SIMILARITY or more over words
    in fives. Links of SimHash fingerprints over these shingles (SIMHASH_BITS differing bits
    at most) are compared exactly; the similar pairs that lie further apart, most of them, are
    searched for after that without loss, so the groups are whole and exact. Rows are known by id and text: different texts under one id are documents of their own, of
    rows alike in both one stays.
    """
    ship(spark)
    found = stored(near_copies.near_copies(docs.select("doc_id", "text"), LEAST_SIMILARITY, shingle=5, distance=SIMHASH_BITS).where("doc_id is not null"), "groups")
    first = (F.col("doc_id") == F.col("component_id")) & (F.col("text_hash") == F.col("component_hash"))
    key = free_name(docs, "text_hash")
    keys = ["doc_id", key]
    own = docs.withColumn(key, F.xxhash64("text"))
    gone = stored(found.where(~first).select("doc_id", F.col("text_hash").alias(key)).distinct(), "gone")
    kept = own.join(gone, keys, "left_anti")
    repeated = stored(found.where(first).groupBy("doc_id", F.col("text_hash").alias(key)).count().where("count > 1").select(*keys), "repeated")
    if repeated.isEmpty():
        return kept.select(*_as_they_are(docs))
    whole = F.struct(*_as_they_are(docs))
    once = kept.join(repeated, keys, "left_semi").select(*keys, whole.alias("_whole")).groupBy(*keys).agg(F.min_by("_whole", F.to_json("_whole")).alias("_whole"))
    once = once.select(*[F.col(f"_whole.{quoted(c)}").alias(c) for c in docs.columns])
    return kept.join(repeated, keys, "left_anti").select(*_as_they_are(docs)).unionByName(once)


def remove_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut windows of 13 words that a document with a smaller id has; a document of which nothing is left goes.

    White space and all columns but ``text`` and ``n_chars`` stay. Nulls, ties and repeated
    ids: see ``substring_dedup``.
    """
    ship(spark)
    found = substring_dedup.deduplicate(docs, window=13).where("n_removed = 0 or n_removed < n_words")
    fields = {"doc_id": F.col("doc_id"), "text": F.col("text")} | {c: F.col(f"row.{quoted(c)}") for c in docs.columns if c not in ("doc_id", "text")}
    fields["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(fields["n_chars"])
    return found.select(*[fields[c].alias(c) for c in docs.columns])


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of test items; a document that is mostly such passages goes.

    All columns but ``text`` and ``n_chars`` stay; a null text stays null, repeated rows are
    judged each, and an empty benchmark changes nothing.
    """
    benchmark = ship(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    before = docs.withColumn("n_chars", F.struct(F.col("n_chars").alias("n"), F.length("text").cast("long").alias("was")))
    cut = decontaminate.remove_spans(before, benchmark, window=8)
    now = F.length("text").cast("long")
    return cut.withColumn("n_chars", F.when(now < F.col("n_chars.was"), now).otherwise(F.col("n_chars.n"))).select(*_as_they_are(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4096 tokens; null texts, repeated and null ids, ties: see ``packing``. Columns but the id and text are not read."""
    ship(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("substring dedup", remove_substrings),
    ("benchmark decontamination", remove_benchmark),
    ("best-fit packing", pack),
]
#: Stages need trained rules, SimHash and tokenisation, which SQL can't express; the tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, "stage-" + name.replace(" ", "-").lower())
    return docs
