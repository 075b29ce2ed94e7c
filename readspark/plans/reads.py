"""Reads derived from the documents: one symbol of each kind for every character of a whole text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _codes(texts: pa.Array) -> pa.Array:
    """``(acids, quals)`` of each text, from its code points."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    sizes = texts.buffers()[1]
    at = np.frombuffer(sizes, np.int64)[texts.offset : texts.offset + len(texts) + 1] if sizes else np.zeros(1, np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    heads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    offsets = heads[at - at[0]]
    points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int32)
    place = np.arange(len(points), dtype=np.int32) - np.repeat(offsets[:-1], np.diff(offsets)).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(x)) for x in (points % 5, (points * 7 + place) % 94)]
    return pa.StructArray.from_arrays(lists, ["acids", "quals"])


def reads_of(docs: DataFrame) -> DataFrame:
    """``(read_id, identifier, acids, quals, n)``; a text without characters is no read."""
    codes = F.arrow_udf(_codes, "acids array<int>, quals array<int>")
    held = docs.where(F.length("text") > 0).select(F.col("doc_id").alias("read_id"), F.length("text").alias("n"), codes("text").alias("codes"))
    return held.select(
        "read_id",
        F.concat(F.lit("DOC_"), F.col("read_id").cast("string")).alias("identifier"),
        F.col("codes.acids").alias("acids"),
        F.col("codes.quals").alias("quals"),
        "n",
    )


def spread(docs: DataFrame, each: int = 16 << 20) -> DataFrame:
    """A small table dealt out to all cores, as a file may be one task; a large one is left where it is."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return docs.repartition(cores, "doc_id") if size < each * cores else docs


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads_of(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))


def bases_of(reads: DataFrame) -> DataFrame:
    """``(read_id, pos, n, acid, q)``: a row for each symbol."""
    return reads.select("read_id", "n", F.posexplode(F.arrays_zip(F.col("acids").alias("acid"), F.col("quals").alias("q"))).alias("pos", "s")).select("read_id", "pos", "n", "s.acid", "s.q")


#: The same in DuckDB SQL.
BASES_SQL = """bases as (
  select read_id, cast(pos as int) as pos, cast(n as int) as n, cast(cp % 5 as int) as acid, cast((cp * 7 + pos) % 94 as int) as q
  from (select doc_id as read_id, unnest(range(0, length(text))) as pos, unicode(unnest(string_split(text, ''))) as cp, length(text) as n
        from documents where length(text) > 0))"""
