"""Blocks of reads: packing, checksums and sums."""

from __future__ import annotations

import zlib
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import symbols
from ..functions.alphabet import fastq_size
from ..storage import stored

MAX_BLOCK = 4 << 20


class SequenceTooLong(ValueError):
    """A read is longer than half a block."""


def pack_blocks(reads: DataFrame, max_block: int = MAX_BLOCK, partitions: int = 1, any_length: bool = False) -> DataFrame:
    """``(read_id, n, block_index)``: a block ends before the read that would take it over ``max_block``.

    Which block a read is in depends on all reads before it; ranges of reads are packed side
    by side all the same (see ``_ranges``), so that no task takes all lengths. With more
    ``partitions``, each range starts a block; numbers then have the range in their upper
    half. A read of over half a block is an error, unless reads may have ``any_length``:
    one longer than a block is then a block alone.
    """
    room = max_block + 1
    lengths, entered = _ranges(reads, room, 0, partitions if partitions > 1 else None)
    longest = lengths.agg(F.max("n")).first()[0] if not any_length else None
    if longest is not None and longest > max_block // 2:
        raise SequenceTooLong(f"Sequence is too long: {longest} symbols, at most {max_block // 2}")

    def number(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("read_id")
        p, sizes = int(part["p"].iloc[0]), part["n"].to_numpy(np.int64)
        held, block, _ = entered[p] if partitions <= 1 else (room, (p << 32) - 1, None)
        total, after = _next(sizes, room, 0)
        begins, k = np.zeros(len(sizes), np.int64), int(np.searchsorted(total[1:], room - held))
        while 0 <= k < len(sizes):
            begins[k] = 1
            k = int(after[k])
        return part[["read_id", "n"]].assign(block_index=block + np.cumsum(begins))

    return lengths.groupBy("p").applyInPandas(number, "read_id long, n int, block_index long")


def _next(sizes: np.ndarray, room: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Running sums from 0, and the read at which the piece after that of each read begins, -1 for none.

    A piece ends with the read that brings it to ``room`` (``step`` 1), or before that
    read (0), if it isn't the piece's only one.
    """
    total = np.concatenate([[0], np.cumsum(sizes)])
    after = np.maximum(np.searchsorted(total[1:], total + room) + step, np.arange(len(total)) + 1)
    return total, np.where(after < len(sizes) + step, after, -1)


def _ranges(reads: DataFrame, room: int, step: int, partitions: int | None = None) -> tuple[DataFrame, dict[int, tuple[int, int, int | None]]]:
    """Lengths in ranges of reads ``p``, and what a walk over all reads enters each range with: symbols held, the number of the open piece, its first read.

    All that a range must know of the reads before it is how many symbols are held, which
    says at which of its reads the first piece begins: one of those within the first
    ``room`` symbols. So each range is summed up by a row for each such read (pieces begun,
    symbols held at the end), and the driver goes through these short lists.
    """
    n = partitions or max(reads.sparkSession.sparkContext.defaultParallelism, 1)
    ordered = reads.select("read_id", F.col("n").cast("int").alias("n")).repartitionByRange(n, "read_id").sortWithinPartitions("read_id")
    lengths = stored(ordered.withColumn("p", F.spark_partition_id()), "lengths")
    if partitions:
        return lengths, {}

    def summed(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("read_id")
        ids, sizes = part["read_id"].to_numpy(), part["n"].to_numpy(np.int64)
        total, after = _next(sizes, room, step)
        end = len(sizes)
        pieces, last = np.zeros(end + 1, np.int64), np.arange(end + 1)
        known = after < 0
        rows = []
        for at in range(int(np.searchsorted(total[1:], room)) + 1):
            if at == end:  # none begins
                rows.append((room << 1, 0, int(total[-1]), int(ids[0])))
            elif at == 0 or sizes[at]:
                path, k = [], at + step
                while not known[k]:
                    path.append(k)
                    k = int(after[k])
                for j in reversed(path):
                    pieces[j], last[j], known[j] = pieces[after[j]] + 1, last[after[j]], True
                k = int(last[at + step])
                rows.append((int(total[at + 1]), int(pieces[at + step]) + 1, int(total[-1] - total[k]), int(ids[k]) if k < end else None))
        out = pd.DataFrame(rows, columns=["upto", "pieces", "held", "first"]).assign(p=part["p"].iloc[0])
        return out.astype({"first": "Int64"})[["p", "upto", "pieces", "held", "first"]]

    found = lengths.groupBy("p").applyInPandas(summed, "p int, upto long, pieces long, held long, first long").orderBy("p", "upto").collect()
    entered: dict[int, tuple[int, int, int | None]] = {}
    # With step 0 the first read always begins a piece, as one that is full is before it.
    held, piece, first = (0, 0, None) if step else (room, -1, None)
    for p, rows in groupby(found, key=lambda r: r["p"]):
        entered[p] = held, piece, first
        row = next(r for r in rows if r["upto"] >= room - held)
        if row["pieces"]:
            held, piece, first = row["held"], piece + row["pieces"], row["first"]
        else:
            held, first = held + row["held"], row["first"] if first is None else first
    return lengths, entered


def _read_bytes(identifiers: pa.Array, acids: pa.Array, quals: pa.Array) -> pa.Array:
    """What a read adds to its block's checksum; nothing without an identifier."""
    (a, at), (q, other) = symbols.flat(acids), symbols.flat(quals)
    a, q = a.astype(np.uint8), q.astype(np.uint8)
    rows = zip(identifiers.to_pylist(), at[:-1], at[1:], other[:-1], other[1:], strict=True)
    return pa.array([None if i is None else i.encode() + a[s:e].tobytes() + q[t:f].tobytes() for i, s, e, t, f in rows], pa.binary())


def checksums(reads: DataFrame, blocks: DataFrame) -> DataFrame:
    """``(block_index, checksum)``: CRC32 over the block's reads in order; a block is bounded."""

    def crc(part: pd.DataFrame) -> pd.DataFrame:
        out = 0
        for data in part.sort_values("read_id")["data"]:
            out = zlib.crc32(data or b"", out)
        return pd.DataFrame({"block_index": part["block_index"].iloc[:1], "checksum": [out]})

    data = reads.select("read_id", F.arrow_udf(_read_bytes, "binary")("identifier", "acids", "quals").alias("data")).join(blocks.select("read_id", "block_index"), "read_id")
    return data.groupBy("block_index").applyInPandas(crc, "block_index long, checksum long")


def block_stats(reads: DataFrame, blocks: DataFrame) -> DataFrame:
    """``(block_index, n_reads, n_symbols, identifier_bytes, in_bytes)``."""
    rows = reads.select("read_id", "n", F.octet_length("identifier").cast("long").alias("id_bytes"), fastq_size(F.col("identifier"), F.col("n")).alias("size"))
    joined = rows.join(blocks.select("read_id", "block_index"), "read_id")
    return joined.groupBy("block_index").agg(F.count("*").alias("n_reads"), F.sum("n").cast("long").alias("n_symbols"), F.sum("id_bytes").cast("long").alias("identifier_bytes"), F.sum("size").cast("long").alias("in_bytes"))


def drop_identifiers(reads: DataFrame) -> DataFrame:
    """Reads without names; ``size`` stays that of the input."""
    return reads.withColumn("size", fastq_size(F.col("identifier"), F.col("n"))).withColumn("identifier", F.lit(""))


def compression_stats(blocks: DataFrame) -> DataFrame:
    """Sums and shares over the blocks of a container (see ``sources.container``)."""
    sums = [F.sum(c).cast("long").alias(c) for c in ("in_bytes", "out_bytes", "identifier_bytes", "acid_bytes", "quality_bytes", "n_symbols", "n_switches")]
    return blocks.agg(F.count("*").alias("n_blocks"), *sums).withColumns({"ratio": F.round(F.col("out_bytes") * 100.0 / F.col("in_bytes"), 4), "bits_per_value": F.round(F.col("out_bytes") * 8.0 / (F.col("n_symbols") * 2), 4)})


def format_bytes(n: float) -> str:
    """Such as ``1.50 kB``."""
    for unit in ("B", "kB", "MB", "GB"):
        if n < 1000:
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.2f} {unit}"
        n /= 1000
    return f"{n:.2f} TB"


def rechunk(reads: DataFrame, seq_length: int) -> DataFrame:
    """``(chunk, first_read, last_read, n)``: reads in order, put together until a chunk has ``seq_length`` symbols or more; a shorter rest goes."""
    room = max(seq_length, 1)
    lengths, entered = _ranges(reads, room, 1)

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("read_id")
        ids, sizes = part["read_id"].tolist(), part["n"].to_numpy(np.int64)
        held, chunk, first = entered[int(part["p"].iloc[0])]
        total, after = _next(sizes, room, 1)
        out, begin, k = [], 0, int(np.searchsorted(total[1:], room - held)) + 1
        while 0 <= k <= len(sizes):
            out.append((chunk, ids[begin] if first is None else first, ids[k - 1], held + int(total[k] - total[begin])))
            chunk, first, held, begin, k = chunk + 1, None, 0, k, int(after[k])
        return pd.DataFrame(out, columns=["chunk", "first_read", "last_read", "n"])

    return lengths.groupBy("p").applyInPandas(fold, "chunk long, first_read long, last_read long, n long")


def joined_chunks(reads: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(chunk, acids, quals, n)`` of ``rechunk``'s chunks, as reads without names."""
    owner = chunks.select("chunk", "first_read", "last_read")
    placed = reads.join(owner, F.col("read_id").between(F.col("first_read"), F.col("last_read")))
    parts = placed.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("read_id", "acids", "quals"))).alias("r"))
    flat = lambda f: F.flatten(F.transform("r", lambda x: x[f]))
    return parts.select("chunk", flat("acids").alias("acids"), flat("quals").alias("quals")).withColumn("n", F.size("acids"))


def pieces(chunks: DataFrame, size: int) -> DataFrame:
    """``chunks`` with the piece of ``size`` bytes that each falls in, by its place in the output."""
    before = F.sum(2 * F.col("n") + 6).over(Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    return chunks.withColumn("piece", F.floor(F.coalesce(before, F.lit(0)) / size).cast("long"))
