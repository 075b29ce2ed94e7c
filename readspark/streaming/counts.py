"""Context counts of a stream of reads.

Counts add up, so each micro-batch's counts are written beside the others, in a partition
with the batch's number; a batch that is run again replaces its own partition. ``totals``
sums over batches, and its rows are those that ``context_counts`` gives for all reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.keys import spec_of
from ..operators.models import context_counts

SCHEMA = "spec long, symbol int, n long, batch long"


def count_stream(reads: DataFrame, spec_name: str, kind: str, folder: str, trigger: dict | None = None) -> StreamingQuery:
    """Count a streaming DataFrame of reads (``acids``, ``quals``) into ``folder``."""

    def add(batch: DataFrame, number: int) -> None:
        counts = context_counts(batch, spec_of(spec_name), kind)
        counts.write.mode("overwrite").parquet(f"{folder}/counts/batch={number}")

    return reads.writeStream.foreachBatch(add).option("checkpointLocation", f"{folder}/progress").trigger(**(trigger or {"availableNow": True})).start()


def totals(spark: SparkSession, folder: str) -> DataFrame:
    """``(spec, symbol, n)`` over all batches so far."""
    return spark.read.schema(SCHEMA).parquet(f"{folder}/counts").groupBy("spec", "symbol").agg(F.sum("n").alias("n"))


def compact(spark: SparkSession, folder: str, target: str) -> None:
    """The totals as a table of their own."""
    totals(spark, folder).write.parquet(target)
