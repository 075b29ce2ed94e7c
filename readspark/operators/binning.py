"""Merging of contexts into fewer, by the least loss of bits."""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.information import entropy_np, merge_cost, merge_np

#: All pairs of contexts are held on the driver: a model with more has to be folded (``most``) by the caller.
MOST = 5000


def pre_bin(found: DataFrame, most: int) -> DataFrame:
    """``(specs, context_prob, symbol_prob)``: the ``most - 1`` likeliest contexts, and the rest as one.

    ``found`` has single keys (``spec``). Ranks come from the ``most`` likeliest alone, so
    no window runs over all contexts; the rest is summed up in partial aggregates.
    """
    single = found.select(F.col("spec"), "context_prob", "symbol_prob")
    if most < 1:
        raise ValueError("at least one context must be left")
    top = single.orderBy(F.desc("context_prob"), "spec").limit(most - 1)
    if most > 1 and single.limit(most + 1).count() <= most:
        return single.select(F.array("spec").alias("specs"), "context_prob", "symbol_prob")
    top = top.withColumn("head", F.lit(True))
    rest = single.join(F.broadcast(top.select("spec")), "spec", "left_anti")
    flat = rest.select("spec", "context_prob", F.posexplode("symbol_prob").alias("s", "p"))
    by_symbol = flat.groupBy("s").agg(F.sum(F.col("p") * F.col("context_prob")).alias("w"))
    probs = by_symbol.agg(F.transform(F.sort_array(F.collect_list(F.struct("s", "w"))), lambda x: x["w"]).alias("ws"))
    folded = rest.agg(F.sort_array(F.collect_list("spec")).alias("specs"), F.sum("context_prob").alias("context_prob"))
    tail = folded.withColumn("one", F.lit(1)).join(probs.withColumn("one", F.lit(1)), "one").where(F.size("specs") > 0)
    share = F.transform("ws", lambda w: F.when(F.col("context_prob") > 0, F.least(w / F.col("context_prob"), F.lit(1.0))).otherwise(F.lit(0.0)))
    tail = tail.select("specs", F.least("context_prob", F.lit(1.0)).alias("context_prob"), share.alias("symbol_prob"))
    return top.select(F.array("spec").alias("specs"), "context_prob", "symbol_prob").unionByName(tail)


def pair_costs(found: DataFrame) -> DataFrame:
    """``(left_spec, right_spec, cost)`` of all pairs of a model's contexts (a theta join of a bounded table)."""
    cols = ["spec", "context_prob", "symbol_prob"]
    a = found.select(*[F.col(c).alias(f"l_{c}") for c in cols])
    b = found.select(*[F.col(c).alias(f"r_{c}") for c in cols])
    pairs = a.join(F.broadcast(b), F.col("l_spec") < F.col("r_spec"))
    return pairs.select(F.col("l_spec").alias("left_spec"), F.col("r_spec").alias("right_spec"), merge_cost(F.col("l_context_prob"), F.col("l_symbol_prob"), F.col("r_context_prob"), F.col("r_symbol_prob")).alias("cost"))


@dataclass
class Tree:
    """Leaves, then a node for each merge; the root is last."""

    specs: list[list[int]]
    probs: list[float]
    symbols: list[np.ndarray]
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    cost: list[float] = field(default_factory=list)

    @property
    def leaves(self) -> int:
        return (len(self.probs) + 1) // 2

    def specs_under(self, node: int) -> list[int]:
        out, todo = [], [node]
        while todo:
            k = todo.pop()
            if self.left[k] < 0:
                out += self.specs[k]
            else:
                todo += [self.left[k], self.right[k]]
        return sorted(out)

    def cut(self, k: int, order: str = "min_cost") -> list[int]:
        """The nodes of at most ``k`` contexts: the root, and then nodes taken apart until there are ``k``.

        ``min_cost``: the node of least cost is taken apart first; ``max_cost``: the
        node of greatest cost, which loses fewer bits.
        """
        if not self.probs:
            return []
        if order not in ("min_cost", "max_cost"):
            raise ValueError(f"unknown order {order}")
        sign = 1 if order == "min_cost" else -1
        heap, out = [(sign * self.cost[-1], len(self.probs) - 1)], []
        while heap and len(heap) + len(out) < k:
            _, node = heapq.heappop(heap)
            if self.left[node] < 0:
                out.append(node)
                continue
            for child in (self.left[node], self.right[node]):
                heapq.heappush(heap, (sign * self.cost[child], child))
        return sorted(out + [n for _, n in heap])

    def rate(self, nodes: list[int]) -> float:
        return float(sum(self.probs[n] * entropy_np(self.symbols[n]) for n in nodes))

    def rows(self) -> list[tuple]:
        return [(k, self.left[k], self.right[k], self.cost[k], float(self.probs[k]), [float(x) for x in self.symbols[k]], self.specs_under(k)) for k in range(len(self.probs))]


def build_tree(specs: list[list[int]], probs: np.ndarray, symbols: np.ndarray) -> Tree:
    """Merge the cheapest pair again and again; of equal costs, that of the lower nodes.

    Each live node remembers its cheapest later partner, so a step is linear in most cases.
    """
    n = len(probs)
    total = max(2 * n - 1, 0)
    p, s = np.zeros(total), np.zeros((total, symbols.shape[1] if n else 0))
    p[:n], s[:n] = probs, symbols
    weighted = np.zeros(total)
    weighted[:n] = p[:n] * entropy_np(s[:n]) if n else 0
    tree = Tree([list(x) for x in specs], [], [], [-1] * n, [-1] * n, [0.0] * n)
    live = np.zeros(total, bool)
    live[:n] = True
    best, partner = np.full(total, np.inf), np.full(total, -1)

    def costs(a: int, b: np.ndarray) -> np.ndarray:
        whole, mean = merge_np(p[a], s[a], p[b], s[b])
        return whole * entropy_np(mean) - (weighted[a] + weighted[b])

    def search(a: int, upto: int) -> None:
        """Cheapest partner among the live nodes after ``a``."""
        b = a + 1 + np.flatnonzero(live[a + 1 : upto])
        best[a], partner[a] = np.inf, -1
        if len(b):
            c = costs(a, b)
            k = int(c.argmin())
            best[a], partner[a] = c[k], b[k]

    for a in range(n):
        search(a, n)
    for new in range(n, total):
        a = int(np.where(live[:new], best[:new], np.inf).argmin())
        b = int(partner[a])
        cost = float(best[a])
        whole, mean = merge_np(p[a], s[a], p[b : b + 1], s[b : b + 1])
        p[new], s[new] = whole[0], mean[0]
        weighted[new] = p[new] * float(entropy_np(s[new]))
        live[[a, b]] = False
        tree.left.append(a)
        tree.right.append(b)
        tree.cost.append(cost)
        tree.specs.append([])
        older = np.flatnonzero(live[:new])
        if len(older):
            c = costs(new, older)
            better = c < best[older]
            best[older[better]], partner[older[better]] = c[better], new
            for k in older[np.isin(partner[older], [a, b])]:
                search(int(k), new)
                if (c_new := c[np.searchsorted(older, k)]) < best[k]:
                    best[k], partner[k] = c_new, new
        live[new] = True
    tree.probs, tree.symbols = p.tolist(), list(s)
    return tree


def tree_of(found: DataFrame, most: int | None = None) -> Tree:
    """The merge tree of a model's contexts (``spec``, ``context_prob``, ``symbol_prob``), all of them or with the rest beyond ``most`` as one."""
    if most is None:
        most = MOST
        if found.limit(most + 1).count() > most:
            raise ValueError(f"more than {MOST} contexts: name how many to keep")
    if "specs" in found.columns:
        if found.where(F.size("specs") != 1).limit(1).count():
            raise ValueError("contexts must have one key each")
        found = found.withColumn("spec", F.get("specs", F.lit(0)))
    rows = pre_bin(found, most).orderBy(F.size("specs") > 1, F.desc("context_prob"), "specs").collect()
    symbols = np.array([r["symbol_prob"] for r in rows]) if rows else np.zeros((0, 1))
    return build_tree([r["specs"] for r in rows], np.array([r["context_prob"] for r in rows]), symbols)


def binned(spark: SparkSession, tree: Tree, k: int, order: str = "min_cost") -> DataFrame:
    """The model of ``k`` contexts: ``(specs, ctx_id, context_prob, symbol_prob)``."""
    rows = [(tree.specs_under(n), float(tree.probs[n]), [float(x) for x in tree.symbols[n]]) for n in tree.cut(k, order)]
    out = spark.createDataFrame(rows, "specs array<bigint>, context_prob double, symbol_prob array<double>")
    return out.select("specs", (F.row_number().over(Window.orderBy("specs")) - 1).alias("ctx_id"), "context_prob", "symbol_prob")


def steps(size: int, num: int | None = None) -> list[int]:
    """Numbers of contexts of a sweep, from 1 to ``size - 1``."""
    num = size - 1 if num is None else num
    return list(range(1, size)) if num >= size - 1 else [i * (size - 1) // num + 1 for i in range(num)]


def sweep(spark: SparkSession, tree: Tree, num: int | None = None, order: str = "min_cost") -> DataFrame:
    """``(n_contexts, rate)`` for each number of contexts: one tree, many cuts."""
    rows = [(k, tree.rate(tree.cut(k, order))) for k in steps(tree.leaves, num)]
    return spark.createDataFrame(rows, "n_contexts int, rate double")


def tree_table(spark: SparkSession, tree: Tree) -> DataFrame:
    return spark.createDataFrame(tree.rows(), "node_id int, left int, right int, merge_cost double, context_prob double, symbol_prob array<double>, specs array<bigint>")
