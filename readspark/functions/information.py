"""Entropy, mixing and cost of contexts, and whole-number frequencies for coding."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Smaller probabilities add nothing to an entropy.
LEAST = 1e-6
SCALE_BITS = 14


def entropy(probs: Column) -> Column:
    return F.aggregate(probs, F.lit(0.0), lambda a, p: a + F.when(p >= LEAST, -p * F.log2(p)).otherwise(F.lit(0.0)))


def uniform(size: int) -> Column:
    return F.array_repeat(F.lit(1.0 / size), size)


def merged_probs(p: Column, left: Column, q: Column, right: Column) -> Column:
    """The mean of two distributions, weighted by the contexts' own probabilities."""
    whole = F.least(p + q, F.lit(1.0))
    return F.zip_with(left, right, lambda x, y: F.when(whole > 0, F.least(F.least(x * p + y * q, F.lit(1.0)) / whole, F.lit(1.0))).otherwise(F.lit(0.0)))


def merge_cost(p: Column, left: Column, q: Column, right: Column) -> Column:
    """How many bits a value more, over the whole input, one context in place of two takes."""
    return F.least(p + q, F.lit(1.0)) * entropy(merged_probs(p, left, q, right)) - (p * entropy(left) + q * entropy(right))


def format_rate(rate: Column) -> Column:
    return F.format_string("%.4fbpv", rate)


def entropy_np(probs: np.ndarray) -> np.ndarray:
    p = np.where(probs >= LEAST, probs, 1.0)
    return -(p * np.log2(p)).sum(-1)


def merge_np(p: float, left: np.ndarray, q: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``merged_probs``, of one context with many."""
    whole = np.minimum(p + q, 1.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = np.minimum(np.minimum(left * p + right * np.asarray(q)[..., None], 1.0) / np.asarray(whole)[..., None], 1.0)
    return whole, np.nan_to_num(mean, nan=0.0)


def cumulative_frequencies(probs: np.ndarray, scale_bits: int = SCALE_BITS) -> np.ndarray:
    """Exclusive running sums of frequencies that add up to ``2 ** scale_bits``, none of them 0.

    Running sums are rounded half away from zero in single precision; what raising
    zeros to 1 takes is taken back, one at a time and in turn from the first symbol, from
    frequencies over 1.
    """
    total, n = 1 << scale_bits, len(probs)
    if total <= n:
        raise ValueError("too many symbols for the scale")
    scaled = np.asarray(probs, np.float32) * np.float32(total)
    before = np.zeros(n + 1, np.float32)
    for k in range(n):
        before[k + 1] = before[k] + scaled[k]
    cuts = np.floor(before[:-1] + np.float32(0.5)).astype(np.int64)
    freq = np.diff(np.append(cuts, total))
    debt = int((freq <= 0).sum() - freq[freq < 0].sum())
    freq = np.maximum(freq, 1)
    while debt:
        can = np.flatnonzero(freq > 1)
        if debt < len(can):
            can = can[:debt]
        freq[can] -= 1
        debt -= len(can)
    return np.cumsum(freq) - freq


def frequencies(cumulative: np.ndarray, scale_bits: int = SCALE_BITS) -> np.ndarray:
    return np.diff(np.append(cumulative, 1 << scale_bits))
