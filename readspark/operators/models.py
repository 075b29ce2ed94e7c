"""Conditional-frequency models: what symbol follows which context."""

from __future__ import annotations

import hashlib
import struct
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import symbols
from ..functions.alphabet import SIZES
from ..functions.information import LEAST, entropy, uniform
from ..functions.keys import KeySpec, key_array, spec_of
from ..storage import stored

COLUMN = {"acids": "acids", "q_scores": "quals"}
TOO_BIG_RATE = 1_000_000.0


def keyed(reads: DataFrame, spec: KeySpec, *columns: str) -> DataFrame:
    """A row for each symbol: its context's key ``spec`` and the given arrays' elements, and the given scalars."""
    arrays = [c for c in columns if c in ("acids", "quals")]
    zipped = F.arrays_zip(key_array(spec, F.col("acids"), F.col("quals")).alias("spec"), *[F.col(c) for c in arrays])
    return reads.select(*[c for c in columns if c not in arrays], F.inline(zipped))


def context_counts(reads: DataFrame, spec: KeySpec, kind: str) -> DataFrame:
    """``(spec, symbol, n)``: one exchange, of each task's counts."""
    if not symbols.fits(spec, kind):
        return keyed(reads, spec, COLUMN[kind]).groupBy("spec", F.col(COLUMN[kind]).alias("symbol")).agg(F.count("*").alias("n"))
    return _set_counts(reads, [(spec, kind)]).groupBy("spec", "symbol").agg(F.sum("n").alias("n"))


def _set_counts(reads: DataFrame, sets: list[tuple[KeySpec, str]]) -> DataFrame:
    """``(set, spec, symbol, n)``: counts of each task. Symbols are counted as arrays, so that no row is made for a symbol."""
    return reads.select("acids", "quals").mapInArrow(lambda batches: symbols.counted(batches, sets), "set int, spec long, symbol int, n long")


def all_counts(reads: DataFrame, specs: list[KeySpec], kinds: tuple[str, ...] = ("acids", "q_scores")) -> DataFrame:
    """``(model_type, spec_type, spec, symbol, n)`` of every kind and key type, from one scan of the reads.

    A row says by one small number which set it is of, so that the aggregation's keys have
    a fixed width.
    """
    sets = [(s, kind) for s in specs for kind in kinds]
    if not all(symbols.fits(*s) for s in sets):
        parts = [context_counts(reads, s, kind).select(F.lit(kind).alias("model_type"), F.lit(s.name).alias("spec_type"), "spec", "symbol", "n") for s, kind in sets]
        return reduce(DataFrame.unionByName, parts)
    counts = _set_counts(reads, sets).groupBy("set", "spec", "symbol").agg(F.sum("n").alias("n"))
    name = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("set") + 1)
    return counts.select(name([kind for _, kind in sets]).alias("model_type"), name([s.name for s, _ in sets]).alias("spec_type"), "spec", "symbol", "n")


def rates(counts: DataFrame, limit: int | None = None) -> DataFrame:
    """``(model_type, spec_type, n_contexts, rate)`` from ``all_counts``.

    With ``limit``, a variant of that many contexts or more has the rate TOO_BIG_RATE
    and the limit in place of its number of contexts.
    """
    keys = ["model_type", "spec_type"]
    # One exchange, by context: the counts of a context meet once for its total and its entropy.
    of_context = counts.groupBy(*keys, "spec").agg(F.sum("n").alias("n_ctx"), F.collect_list("n").alias("ns"))
    bits = F.aggregate("ns", F.lit(0.0), lambda a, n: a + F.when(n / F.col("n_ctx") >= LEAST, -(n / F.col("n_ctx")) * F.log2(n / F.col("n_ctx"))).otherwise(F.lit(0.0)))
    per = of_context.select(*keys, "n_ctx", (bits * F.col("n_ctx")).alias("bits")).groupBy(*keys).agg(F.count("*").alias("n_contexts"), (F.sum("bits") / F.sum("n_ctx")).alias("rate"))
    if limit is not None:
        big = F.col("n_contexts") >= limit
        per = per.select(*keys, F.when(big, F.lit(limit).cast("long")).otherwise(F.col("n_contexts")).alias("n_contexts"), F.when(big, F.lit(TOO_BIG_RATE)).otherwise(F.col("rate")).alias("rate"), big.alias("too_big"))
    return per


def contexts(counts: DataFrame, size: int) -> DataFrame:
    """``(spec, context_prob, symbol_prob)`` from ``context_counts``; ``symbol_prob`` has all ``size`` symbols.

    The counts are stored, as they are read twice and come from all reads.
    """
    counts = stored(counts, "counts")
    of_context = counts.groupBy("spec").agg(F.sum("n").alias("n_ctx"), F.map_from_entries(F.collect_list(F.struct("symbol", "n"))).alias("m"))
    total = F.broadcast(counts.agg(F.sum("n").alias("total")).withColumn("one", F.lit(1)))
    probs = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda s: F.coalesce(F.element_at("m", s), F.lit(0).cast("long")) / F.col("n_ctx"))
    return of_context.withColumn("one", F.lit(1)).join(total, "one").select("spec", (F.col("n_ctx") / F.col("total")).alias("context_prob"), probs.alias("symbol_prob"))


def assemble(found: DataFrame) -> DataFrame:
    """Contexts with one key each as ``(specs, ctx_id, context_prob, symbol_prob)``, numbered in the order of their keys."""
    one = found if "specs" in found.columns else found.withColumn("specs", F.array("spec"))
    # A model has 65 536 contexts at most (see ``check``), so its numbering is small.
    order = Window.orderBy("specs")
    return one.select("specs", (F.row_number().over(order) - 1).alias("ctx_id"), "context_prob", "symbol_prob")


def spec_map(model: DataFrame) -> DataFrame:
    """``(spec, ctx_id)``."""
    return model.select(F.explode("specs").alias("spec"), "ctx_id")


def as_contexts(contexts_: DataFrame, map_: DataFrame) -> DataFrame:
    """The inverse of ``spec_map``."""
    return map_.groupBy("ctx_id").agg(F.sort_array(F.collect_list("spec")).alias("specs")).join(contexts_.select("ctx_id", "context_prob", "symbol_prob"), "ctx_id")


def model_rate(model: DataFrame) -> DataFrame:
    """``(rate)``: the bits that a value takes on average."""
    return model.agg(F.coalesce(F.sum(F.col("context_prob") * entropy(F.col("symbol_prob"))), F.lit(0.0)).alias("rate"))


def with_default(rows: DataFrame, model: DataFrame, kind: str) -> DataFrame:
    """``rows`` (with a ``spec``) joined to their contexts' probabilities; a key that the model lacks has the uniform ones."""
    known = spec_map(model).join(model.select("ctx_id", "symbol_prob"), "ctx_id").select("spec", "symbol_prob")
    return rows.join(known, "spec", "left").withColumn("symbol_prob", F.coalesce("symbol_prob", uniform(SIZES[kind])))


def check(model: DataFrame, limit: int = 65_536) -> DataFrame:
    n = model.count()
    if n > limit:
        raise ValueError(f"the model has {n} contexts; a coder takes {limit} at most")
    return model


def empty(spark: SparkSession) -> DataFrame:
    """A model without contexts: everything is coded as uniform."""
    return spark.createDataFrame([], "specs array<bigint>, ctx_id int, context_prob double, symbol_prob array<double>")


def identifier(rows: list, kind: str, spec_name: str) -> bytes:
    """SHA3-256 of a model's kind, key type, probabilities and map, in order of contexts and keys."""
    h = hashlib.sha3_256()
    h.update(bytes([0 if kind == "acids" else 1]) + spec_name.encode())
    pairs = []
    for r in sorted(rows, key=lambda r: r["ctx_id"]):
        h.update(np.asarray(r["symbol_prob"], ">f4").tobytes())
        pairs += [(s, r["ctx_id"]) for s in r["specs"]]
    for s, c in sorted(pairs):
        h.update(struct.pack(">II", s, c))
    return h.digest()


def save(model: DataFrame, path: str, kind: str, spec_name: str) -> bytes:
    """Append the model to a directory of models; its identifier."""
    rows = check(model).collect()
    name = identifier(rows, kind, spec_name)
    fixed = model.select("*", F.lit(kind).alias("model_type"), F.lit(spec_name).alias("spec_type"), F.lit(name.hex()).alias("model_id"))
    fixed.write.mode("append").partitionBy("model_id").parquet(path)
    return name


def load(spark: SparkSession, path: str) -> DataFrame:
    """All models of a directory; filters on ``model_id`` read only those models."""
    return spark.read.parquet(path)


def verify(models: DataFrame, model_id: str) -> DataFrame:
    """One model, whose identifier is computed again."""
    own = models.where(F.col("model_id") == model_id)
    rows = own.collect()
    if not rows or identifier(rows, rows[0]["model_type"], rows[0]["spec_type"]).hex() != model_id:
        raise ValueError(f"model {model_id} is missing or damaged")
    return own


def missing(wanted: DataFrame, models: DataFrame) -> DataFrame:
    """Of ``wanted`` (model_id), those that aren't there."""
    return wanted.join(models.select("model_id").distinct(), "model_id", "left_anti")


def build(reads: DataFrame, spec_name: str, kind: str) -> DataFrame:
    return assemble(contexts(context_counts(reads, spec_of(spec_name), kind), SIZES[kind]))
