"""Choosing models: coded sizes, ranks, medoids, and the best model for each read."""

from __future__ import annotations

from collections.abc import Iterator
from math import log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import symbols
from ..functions.information import SCALE_BITS
from ..functions.keys import KeySpec, key_array, spec_of
from ..storage import stored
from .models import COLUMN

#: Bytes of the mark that switches models.
SWITCH_BYTES = 2
#: Contexts of a model that is sent to all executors (a few hundred bytes each).
SENT = 50_000


def plain_frequency(p: Column, scale_bits: int = SCALE_BITS) -> Column:
    """A probability as a frequency, at least 1, without making the sum whole."""
    return F.greatest(F.lit(1), F.floor(p * (1 << scale_bits) + 0.5)).cast("long")


def coded_bytes(bits: Column) -> Column:
    """Bytes of a coder's output for so many bits: its state, and whole bytes."""
    return (F.floor(bits / 8 + 1e-9) + 4).cast("long")


def frequencies_of(model: DataFrame) -> DataFrame:
    """``(spec, symbol, freq)`` of a model's contexts (``spec``, ``symbol_prob``)."""
    return model.select("spec", F.posexplode("symbol_prob").alias("symbol", "p")).select("spec", "symbol", plain_frequency(F.col("p")).alias("freq"))


def read_sizes(reads: DataFrame, models: list[tuple[str, DataFrame]], kind: str, size: int) -> DataFrame:
    """``(read_id, model_idx, bytes)``: what each read takes under each model.

    ``models``: key type and contexts (``spec``, ``symbol_prob``). The bits of models of at
    most SENT contexts are sent to all executors, where a read's are summed up within its
    row; with a larger model, reads are taken apart and joined. A key without a context
    has uniform frequencies.
    """
    if not models:
        raise ValueError("at least one model is needed")
    uniform = SCALE_BITS - log2(max(1, int((1 << SCALE_BITS) / size + 0.5)))
    names = [f"b{i}" for i in range(len(models))]
    models = [(name, stored(found.select("spec", "symbol_prob"), "model")) for name, found in models]
    if all(symbols.fits(spec_of(name), kind) and found.limit(SENT + 1).count() <= SENT for name, found in models):
        sent = reads.sparkSession.sparkContext.broadcast([(spec_of(name), *_bits(found, size, uniform)) for name, found in models])
        sums = reads.select("read_id", "acids", "quals").mapInArrow(lambda batches: _summed(batches, sent.value, kind), ", ".join(["read_id long", *[f"{b} double" for b in names]]))
    else:
        keys = [key_array(spec_of(name), F.col("acids"), F.col("quals")).alias(f"k{i}") for i, (name, _) in enumerate(models)]
        sums = reads.select("read_id", F.inline(F.arrays_zip(F.col(COLUMN[kind]).alias("symbol"), *keys)))
        for i, (_, found) in enumerate(models):
            bits = frequencies_of(found).select(F.col("spec").alias(f"k{i}"), "symbol", (SCALE_BITS - F.log2("freq")).alias(names[i]))
            sums = sums.join(F.broadcast(bits) if found.limit(SENT + 1).count() <= SENT else bits, [f"k{i}", "symbol"], "left")
    sums = sums.groupBy("read_id").agg(*[F.sum(F.coalesce(b, F.lit(uniform))).alias(b) for b in names])
    return sums.select("read_id", F.inline(F.array(*[F.struct(F.lit(i).alias("model_idx"), coded_bytes(F.col(b)).alias("bytes")) for i, b in enumerate(names)])))


def _bits(found: DataFrame, size: int, uniform: float) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys, and the bits of each key's symbols; the last row is for a key without a context."""
    rows = sorted((r["spec"], r["symbol_prob"]) for r in found.collect())
    probs = np.array([p for _, p in rows], float).reshape(len(rows), size)
    bits = SCALE_BITS - np.log2(np.maximum(1, np.floor(probs * (1 << SCALE_BITS) + 0.5)))
    return np.array([k for k, _ in rows], np.int64), np.concatenate([bits, np.full((1, size), uniform)])


def _summed(batches: Iterator[pa.RecordBatch], models: list[tuple[KeySpec, np.ndarray, np.ndarray]], kind: str) -> Iterator[pa.RecordBatch]:
    """``read_id`` and each model's bits of reads that have symbols."""
    # Where keys are few, a table has each key's row.
    tables = []
    for _, keys, _ in models:
        top = int(keys[-1]) + 1 if len(keys) else 0
        tables.append(np.full(top + 1, len(keys), np.int32) if top <= 1 << 20 else None)
        if tables[-1] is not None:
            tables[-1][keys] = np.arange(len(keys))
    for batch in batches:
        reads = symbols.Reads(batch)
        sums = np.zeros((len(models), batch.num_rows))
        for window in reads.windows():
            first, held = window.read[0], window.symbols(kind)
            for out, table, (spec, keys, bits) in zip(sums, tables, models, strict=True):
                found = window.keys(spec)
                if table is not None:
                    row = table[np.minimum(found, len(table) - 1)]
                else:
                    place = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
                    row = np.where(keys[place] == found, place, len(keys))
                part = np.bincount(window.read - first, weights=bits[row, held])
                out[first : first + len(part)] += part
        some = np.flatnonzero(reads.lengths)
        yield pa.RecordBatch.from_arrays([batch.column("read_id").take(pa.array(some)), *[pa.array(x[some]) for x in sums]], ["read_id", *[f"b{i}" for i in range(len(models))]])


def ranking(sizes: DataFrame) -> DataFrame:
    """``(model_idx, score, place)``: the sum of a model's ranks over all reads; ties by model."""
    ranked = sizes.withColumn("rank", F.row_number().over(Window.partitionBy("read_id").orderBy("bytes", "model_idx")) - 1)
    score = ranked.groupBy("model_idx").agg(F.sum("rank").cast("long").alias("score"))
    # One row for each model.
    return score.select("model_idx", "score", F.row_number().over(Window.orderBy("score", "model_idx")).alias("place"))


def best_by_rank(sizes: DataFrame, k: int) -> DataFrame:
    return ranking(sizes).orderBy("score", "model_idx").limit(k).select("model_idx", "score")


def best_model(sizes: DataFrame) -> DataFrame:
    """``(read_id, model_idx, bytes)`` of the smallest size of each read; the first of equals."""
    least = sizes.groupBy("read_id").agg(F.min(F.struct("bytes", "model_idx")).alias("m"))
    return least.select("read_id", "m.model_idx", "m.bytes")


def best_with_switching(sizes: DataFrame, blocks: DataFrame) -> DataFrame:
    """``(block_index, read_id, model_idx, bytes)`` where changing the model has a price.

    Within a block, in the order of reads, a model other than the one before costs
    SWITCH_BYTES more; a block starts without one. ``blocks``: ``(read_id, block_index)``.
    A block's size is bounded, and so is what one task gathers at once.
    """
    joined = sizes.join(blocks.select("read_id", "block_index"), "read_id").select("block_index", "read_id", "model_idx", "bytes")

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["read_id", "model_idx"], ignore_index=True)
        ids, models, sizes = (part[c].tolist() for c in ("read_id", "model_idx", "bytes"))
        now, out, k = -1, [], 0
        while k < len(ids):
            end = k
            while end < len(ids) and ids[end] == ids[k]:
                end += 1
            _, now, least = min((sizes[j] + (0 if models[j] == now else SWITCH_BYTES), models[j], sizes[j]) for j in range(k, end))
            out.append((part["block_index"].iloc[0], ids[k], now, least))
            k = end
        return pd.DataFrame(out, columns=["block_index", "read_id", "model_idx", "bytes"])

    return joined.groupBy("block_index").applyInPandas(choose, joined.schema)


def _settled(costs: DataFrame, k: int, seed: int, most_rounds: int) -> tuple[list[int], list[int]]:
    """The places of ``k`` models in ``costs`` (``read_id``, ``cost``: an array), and how many reads each suits best.

    A round is one aggregation: for each of the models chosen, the sums of all models over its reads.
    """
    first = [r["cost"] for r in costs.orderBy(F.xxhash64("read_id", F.lit(seed)), "read_id").select("cost").limit(k).collect()]
    if not first:
        return [], []
    n = len(first[0])
    k = min(k, n)
    chosen: list[int] = []
    for line in [*first[:k], *first[:1] * (k - len(first[:k]))]:
        chosen.append(min((m for m in range(n) if m not in chosen), key=lambda m: (line[m], m)))
    for left in reversed(range(most_rounds + 1)):
        sums = costs.groupBy(_group(chosen).alias("c")).agg(F.count("*").alias("n"), *[F.sum(F.get("cost", F.lit(m))).alias(f"s{m}") for m in range(n)])
        groups = {r["c"]: r for r in sums.collect()}
        after: list[int] = []
        for c in range(k):
            free = [m for m in range(n) if m not in after]
            after.append(min(free, key=lambda m: (groups[c][f"s{m}"], m)) if c in groups else free[0])
        if after == chosen or not left:
            return chosen, [groups[c]["n"] if c in groups else 0 for c in range(k)]
        chosen = after
    raise AssertionError


def _group(chosen: list[int]) -> Column:
    """Which of the chosen models suits a read best, the first of equals."""
    return F.array_min(F.array(*[F.struct(F.get("cost", F.lit(m)).alias("cost"), F.lit(c).alias("c")) for c, m in enumerate(chosen)]))["c"]


def _costs(sizes: DataFrame) -> tuple[list[int], DataFrame]:
    """The models, and ``(read_id, cost)``: each read's bytes under them, in their order."""
    names = sorted(r[0] for r in sizes.select("model_idx").distinct().collect())
    if not names:
        return [], sizes.select("read_id", F.array().cast("array<bigint>").alias("cost"))
    costs = sizes.groupBy("read_id").agg(*[F.min(F.when(F.col("model_idx") == m, F.col("bytes"))).alias(f"m{m}") for m in names])
    return names, costs.select("read_id", F.array(*[F.col(f"m{m}") for m in names]).cast("array<bigint>").alias("cost"))


def medoid_sums(sizes: DataFrame, k: int, seed: int = 404, most_rounds: int = 50) -> list[tuple[int, int]]:
    """``k`` models and how many reads each suits best; as ``medoids``, for any number of reads."""
    names, costs = _costs(stored(sizes, "sizes"))
    chosen, n = _settled(stored(costs, "costs"), k, seed, most_rounds)
    return [(names[m], x) for m, x in zip(chosen, n, strict=True)]


def medoids(sizes: DataFrame, k: int, seed: int = 404, most_rounds: int = 50) -> list[tuple[int, list[int]]]:
    """``k`` models and the reads that each suits best, by rounds of assigning and choosing anew.

    The reads' numbers are collected, so that ``sizes`` are those of a block; ``medoid_sums``
    is for more. The first models are the cheapest free ones of ``k`` reads in the order of
    a hash. Ties go to the lower model.
    """
    names, costs = _costs(stored(sizes, "sizes"))
    costs = stored(costs, "costs")
    chosen, _ = _settled(costs, k, seed, most_rounds)
    if not chosen:
        return []
    groups = {r["c"]: sorted(r["reads"]) for r in costs.groupBy(_group(chosen).alias("c")).agg(F.collect_list("read_id").alias("reads")).collect()}
    return [(names[m], groups.get(c, [])) for c, m in enumerate(chosen)]


def file_level_count(quality: int) -> int:
    """How many models of each kind a file gets at a quality from 1 to 9."""
    if not 1 <= quality <= 9:
        raise ValueError("quality must be from 1 to 9")
    return (quality + 1) // 2


def choose_models(sizes: DataFrame, quality: int = 7, fast: bool = False) -> list[int]:
    """The models of a file: by rank at quality 1 (and in fast mode), else by medoids."""
    k = file_level_count(1 if fast else quality)
    found = [r[0] for r in sizes.select("model_idx").distinct().limit(2).collect()]
    if len(found) <= 1:
        return found
    if k == 1 and (fast or quality == 1):
        return [r["model_idx"] for r in best_by_rank(sizes, k).collect()]
    return [m for m, _ in medoids(sizes, k)]
