"""Packing of tokenised documents into sequences of fixed length, with certified bin counts.

Method: bound-certified repacking. The pieces of a partition are packed by best-fit
decreasing. Dual feasible functions give a lower bound on the partition's sequences;
where the bound is met the packing is certified and final. A partition with a gap keeps
its full sequences, gives up the documents of the others, and these documents meet in
new, fewer partitions, in which best-fit decreasing runs again. The rounds end when all
is certified, when one partition is left, after ``rounds``, or when a rerun takes more
sequences than the same documents had before: then what they had stays.

Each piece carries its certificate: ``partition_bins`` and ``partition_bound`` are the
sequences and the lower bound of the partition and round that made its sequence. Where
they are equal no packing of that partition has fewer; a difference is the most that
could be saved there.

A task holds about ``pieces_each`` pieces (a few numbers each), however large the input.

Defined cases: a null or empty text has the end token only; a longer document is cut into
full pieces and a rest; rows with a repeated or null ``doc_id`` are packed as documents
of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bpe import load
from ._shared import stored
from ._text import blocks, ragged, tidy

PIECES = "doc_id {id}, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every document's ids and the end id, cut at ``capacity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer_path)
        for batch in batches:
            for texts in blocks(batch.column(1)):
                start, length, offsets = bpe.lookup(texts)
                total = np.concatenate([[0], np.cumsum(length)])
                n_ids = total[offsets[1:]] - total[offsets[:-1]] + 1
                begin = np.cumsum(n_ids) - n_ids
                ids = np.full(int(n_ids.sum()), end_id, "<u4")
                body = np.ones(len(ids), bool)
                body[begin + n_ids - 1] = False
                ids[body] = bpe.ids[ragged(start, length)]
                count = -(-n_ids // capacity)
                doc = np.repeat(np.arange(len(texts)), count)
                piece = ragged(np.zeros(len(count), np.int64), count)
                at = piece * capacity
                size = np.minimum(n_ids[doc] - at, capacity)
                view = memoryview(ids).cast("B")
                crc = np.array([zlib.crc32(view[4 * a : 4 * b]) for a, b in zip((begin[doc] + at).tolist(), (begin[doc] + at + size).tolist(), strict=True)], np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(texts.first + doc)), pa.array(piece.astype(np.int32)), pa.array(at), pa.array(size), pa.array(crc)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    ids = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return ids.mapInArrow(tidy(run), PIECES.format(id=docs.schema[id_column].dataType.simpleString()))


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best bound on the number of bins of two families of dual feasible functions.

    For a threshold e, lengths over ``capacity - e`` count as full bins and those below
    e as nothing. For k, a length x counts ``floor((k + 1) x / capacity) / k`` of a bin,
    or ``x / capacity`` where ``(k + 1) x / capacity`` is whole.
    """
    if not len(lengths):
        return 0
    held = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    mass = held * np.arange(capacity + 1)
    e = np.arange(capacity // 2 + 1)
    upto, weight = np.cumsum(held), np.cumsum(mass)
    large = upto[capacity] - upto[capacity - e]
    below = np.where(e > 0, weight[e - 1], 0)
    best = int((large - (-(weight[capacity - e] - below) // capacity)).max())
    x = np.arange(capacity + 1)
    for k in range(1, 33):
        whole = (k + 1) * x % capacity == 0
        scaled = np.where(whole, k * x, (k + 1) * x // capacity * capacity)  # in units of 1 / (k * capacity)
        best = max(best, -(-int((held * scaled).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each length, and how much each bin holds.

    Bins of equal room are interchangeable: they wait in lists by room, and the bits of
    one integer say which rooms have a bin.
    """
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, room_of = 0, []
    order = np.argsort(-lengths, kind="stable")
    for k, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fit = rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            b = waiting[room].pop()
            if not waiting[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(room_of)
            room_of.append(capacity)
        bins[k], offsets[k] = b, capacity - room
        left = room - size
        room_of[b] = left
        if left:
            waiting[left].append(b)
            rooms |= 1 << left
    return bins, offsets, capacity - np.array(room_of, np.int64)


def pack(items: DataFrame, capacity: int, pieces_each: int = 250_000, rounds: int = 4) -> DataFrame:
    """``items`` (with a ``length``) and ``sequence_id``, ``offset``, ``partition_bins`` and ``partition_bound`` for each."""
    fields = items.schema
    columns = items.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", sequence_id long, offset long, partition_bins long, partition_bound long, open boolean"

    def run(number: int, last: bool):
        def fill(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            lengths = part["length"].to_numpy()
            bins, offsets, held = best_fit_decreasing(lengths, capacity)
            bound = lower_bound(lengths, capacity)
            gap = not last and len(held) > bound
            return part[columns].assign(sequence_id=(number << 58) + (int(key[0]) << 32) + bins, offset=offsets, partition_bins=len(held), partition_bound=bound, open=gap & (held[bins] < capacity))

        return fill

    def sequences(of: DataFrame) -> int:
        return of.select("sequence_id").distinct().count()

    done: list[DataFrame] = []
    rest, before = items, None
    for number in range(rounds):
        n = rest.count()
        parts = max(1, -(-n // pieces_each))
        last = parts == 1 or number == rounds - 1
        salted = rest.withColumn("_part", F.pmod(F.xxhash64(*[F.col(c) for c in columns], F.lit(number)), F.lit(parts)))
        packed = stored(salted.groupBy("_part").applyInPandas(run(number, last), schema), "packed")
        if before is not None and sequences(packed) > sequences(before):
            done.append(before.drop("open"))
            break
        done.append(packed.where("not open").drop("open"))
        if last:
            break
        before = packed.where("open")
        rest = before.select(*columns)
        if rest.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, pieces_each: int = 250_000, rounds: int = 4) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` of every piece of ``docs``, with its place and certificate as ``pack`` gives them."""
    return pack(stored(pieces(docs, tokenizer_path, capacity, end_id), "pieces"), capacity, pieces_each, rounds)
