"""A quality classifier made of few readable rules.

Method: sparse rule ensemble. Shallow trees are grown on statistics of labelled texts;
every path from a root becomes a conjunctive rule; a logistic model with a lasso penalty
gives most rules the weight zero. The rules that are left are compiled into one Spark
column expression, so all documents are scored without Python.

The trees and weights are fitted on the driver to ``sample_rows`` labelled rows at most
(chosen by a hash of the id): the only bound, and the size of what is sent anywhere.

Defined cases: a null text counts as an empty one, which has statistics of zero and a
score like any other; labels that are not 0 or 1, or have a null id, are left out;
several labels of one document count as its largest; rows with a null ``doc_id`` are
scored (and held out, as their remainder is unknown), as are rows with a repeated one;
without labels of both kinds every score is the share of label 1 (0.5 if there is none);
other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality_rules import SPACES, SYMBOLS, _let, _without

FEATURES = ["words", "symbol_share", "pipe_share", "exclaim_share", "upper_share", "digit_share", "stop_share", "distinct_share", "mean_word", "dup_line_share"]


def statistics(text: Column) -> Column:
    """A struct of FEATURES."""
    text = F.coalesce(text, F.lit(""))
    count = lambda t, signs: (F.octet_length(t) - F.octet_length(_without(t, signs))).cast("double")

    def of(t: Column) -> Column:
        size = F.greatest(F.length(_without(t, SPACES)), F.lit(1)).cast("double")
        lines = F.filter(F.split(t, "\n"), lambda x: F.length(_without(x, SPACES)) > 0)
        words = F.array_remove(F.split(t, r"[ \t-\r]+"), "")
        # The letters A-Z are what lower-casing changes among ASCII: what is left without them is shorter.
        upper = (F.octet_length(t) - F.octet_length(F.regexp_replace(t, "[A-Z]+", ""))).cast("double")
        digit = (F.octet_length(t) - F.octet_length(F.regexp_replace(t, "[0-9]+", ""))).cast("double")
        by_word = _let(words, lambda w: F.struct(F.size(w).cast("double").alias("n"), F.size(F.array_distinct(w)).cast("double").alias("d")))
        by_line = _let(lines, lambda x: F.when(F.size(x) > 0, (F.size(x) - F.size(F.array_distinct(x))) / F.size(x)).otherwise(F.lit(0.0)))
        return F.struct(by_word.alias("w"), by_line.alias("l"), size.alias("s"), upper.alias("u"), digit.alias("g"), count(t, SYMBOLS).alias("y"), count(t, "|").alias("p"), count(t, "!").alias("e"), count(t, ".,").alias("c"))

    def shares(x: Column) -> Column:
        n = F.greatest(x["w"]["n"], F.lit(1.0))
        return F.struct(
            x["w"]["n"].alias("words"),
            (x["y"] / x["s"]).alias("symbol_share"),
            (x["p"] / x["s"]).alias("pipe_share"),
            (x["e"] / x["s"]).alias("exclaim_share"),
            (x["u"] / x["s"]).alias("upper_share"),
            (x["g"] / x["s"]).alias("digit_share"),
            (x["c"] / x["s"]).alias("stop_share"),
            (x["w"]["d"] / n).alias("distinct_share"),
            (x["s"] / n).alias("mean_word"),
            x["l"].alias("dup_line_share"),
        )

    return _let(_let(text, of), shares)


Condition = tuple[int, bool, float]  # feature, whether at most (else above), threshold


@dataclass
class RuleEnsemble:
    """Rules with weights: the log odds of label 1."""

    bias: float = 0.0
    rules: list[tuple[tuple[Condition, ...], float]] = field(default_factory=list)

    def score(self, features: Column) -> Column:
        odds = F.lit(float(self.bias))
        for conditions, weight in self.rules:
            met = F.lit(True)
            for f, low, at in conditions:
                x = features[FEATURES[f]]
                met = met & (x <= F.lit(float(at)) if low else x > F.lit(float(at)))
            odds = odds + F.when(met, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))

    def describe(self) -> list[str]:
        return [f"{w:+.3f} if " + " and ".join(f"{FEATURES[f]} {'<=' if low else '>'} {at:.4g}" for f, low, at in c) for c, w in sorted(self.rules, key=lambda r: -abs(r[1]))]


def _paths(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, least: int, path: tuple[Condition, ...] = ()) -> list[tuple[Condition, ...]]:
    """All paths of a tree grown by Gini impurity on some of the features at each node."""
    if depth == 0 or len(y) < 2 * least or y.min() == y.max():
        return []
    best, total = None, y.sum()
    for f in rng.choice(x.shape[1], size=min(5, x.shape[1]), replace=False):
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        n = np.arange(1, len(y))
        ok = (v[1:] > v[:-1]) & (n >= least) & (len(y) - n >= least)
        if ok.any():
            a, b = ones[:-1], total - ones[:-1]
            impurity = a * (n - a) / n + b * (len(y) - n - b) / (len(y) - n)
            k = int(np.flatnonzero(ok)[impurity[ok].argmin()])
            if best is None or impurity[k] < best[0]:
                best = impurity[k], int(f), float((v[k] + v[k + 1]) / 2)
    if best is None:
        return []
    _, f, at = best
    left = x[:, f] <= at
    out = []
    for low, part in ((True, left), (False, ~left)):
        own = (*path, (f, low, at))
        out += [own, *_paths(x[part], y[part], rng, depth - 1, least, own)]
    return out


def _lasso(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 600) -> tuple[float, np.ndarray]:
    """Logistic weights with an L1 penalty, by accelerated proximal gradient steps."""
    n, m = r.shape
    full = np.hstack([np.ones((n, 1)), r])
    v = np.ones(m + 1)
    for _ in range(30):  # the largest curvature
        v = full.T @ (full @ v)
        top = float(np.linalg.norm(v))
        v /= top
    rate = 4 * n / top
    w = z = np.zeros(m + 1)
    t = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(full @ z, -30, 30)))
        new = z - rate * (full.T @ (p - y) / n)
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * penalty, 0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        z = new + (before - 1) / t * (new - w)
        w = new
    return float(w[0]), w[1:]


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, penalty: float = 0.0005, seed: int = 11) -> RuleEnsemble:
    """Rules and weights from statistics ``x`` and labels ``y``; the same for the same rows in the same order."""
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        return RuleEnsemble(float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    found: dict[tuple[Condition, ...], None] = {}
    for _ in range(trees):
        rows = rng.integers(0, len(y), min(len(y), 4000))
        for p in _paths(x[rows], y[rows], rng, depth, max(5, len(rows) // 400)):
            found[p] = None
    rules = list(found)
    met = np.ones((len(y), len(rules)))
    for k, conditions in enumerate(rules):
        for f, low, at in conditions:
            met[:, k] *= x[:, f] <= at if low else x[:, f] > at
    share = met.mean(0)
    _, first = np.unique(met, axis=1, return_index=True)
    use = np.array(sorted(k for k in first if 0 < share[k] < 1), int)
    bias, weights = _lasso(met[:, use], y, penalty)
    return RuleEnsemble(bias, [(rules[k], float(w)) for k, w in zip(use, weights, strict=True) if abs(w) > 1e-6])


def held_out(id_column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, id_column: str = "doc_id", text_column: str = "text") -> RuleEnsemble:
    """Fit on labelled rows that aren't held out."""
    chosen = labels.where(~held_out(id_column) & F.col("quality").isin(0, 1)).groupBy(id_column).agg(F.max("quality").alias("_quality"))
    chosen = chosen.orderBy(F.xxhash64(id_column), id_column).limit(sample_rows)
    # sample_rows ids and labels at most: small enough to send.
    rows = docs.select(id_column, F.col(text_column).alias("_text")).join(F.broadcast(chosen), id_column)
    rows = rows.select(id_column, "_quality", statistics(F.col("_text")).alias("f")).select(id_column, "_quality", *[F.col(f"f.{x}").alias(x) for x in FEATURES])
    # Of documents with a repeated id, as many rows as ids.
    table = rows.orderBy(id_column, *FEATURES).limit(sample_rows).toPandas()
    return fit(table[FEATURES].to_numpy(float), table["_quality"].to_numpy(float))


def score(docs: DataFrame, model: RuleEnsemble, text_column: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with a column of scores (0 to 1, higher: label 1 is likelier)."""
    return docs.withColumn(into, _let(statistics(F.col(text_column)), model.score))
