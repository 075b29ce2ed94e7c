"""Shares of symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.alphabet import BASES, FIRST_QUALITY, SIZES
from ..functions.keys import spec_of
from .models import context_counts


def symbol_stats(reads: DataFrame, kind: str) -> DataFrame:
    """``(symbol, label, n, pct)`` for every symbol of the alphabet, those that don't occur too.

    Each task counts its own reads; the alphabet's table is a handful of rows.
    """
    counts = context_counts(reads, spec_of("dummy"), kind).select("symbol", "n")
    domain = reads.sparkSession.range(SIZES[kind]).select(F.col("id").cast("int").alias("symbol"))
    label = F.substring(F.lit(BASES), F.col("symbol") + 1, F.lit(1)) if kind == "acids" else F.char(F.col("symbol") + FIRST_QUALITY)
    joined = domain.join(F.broadcast(counts), "symbol", "left").select("symbol", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    # A row for each symbol, so that the reads are counted once.
    total = F.sum("n").over(Window.partitionBy())
    pct = F.when(total > 0, F.round(F.col("n") * 100.0 / total, 6)).otherwise(F.lit(0.0))
    return joined.select("symbol", label.alias("label"), "n", pct.alias("pct"))


def report(stats: DataFrame) -> list[str]:
    """Lines such as ``A: 26.1868%``."""
    return [f"{r['label']}: {r['pct']:.4f}%" for r in stats.orderBy("symbol").collect()]
