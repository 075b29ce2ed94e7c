"""Keys, information measures, models and their merging: fixed values, and plain Python on small tables."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from readspark.functions import information as info
from readspark.functions.keys import KEY_TYPES, decode, key_array, key_column, spec_of
from readspark.operators import binning, models, select, stats
from readspark.plans.reads import bases_of

BASES = "NACTG"
RNG = random.Random(1337)
READS = [
    (0, "r0", [RNG.randrange(5) for _ in range(40)], [RNG.randrange(94) for _ in range(40)]),
    (1, "r1", [RNG.randrange(2) for _ in range(70)], [RNG.randrange(3) for _ in range(70)]),
    (2, "", [1], [93]),
    (3, "r3", [], []),
    (4, "r4", [4] * 9, [0] * 9),
]


@pytest.fixture(scope="module")
def reads(spark):
    df = spark.createDataFrame(READS, "read_id long, identifier string, acids array<int>, quals array<int>")
    return df.withColumn("n", F.size("acids"))


def keys_by_hand(name, acids, quals):
    """By queues that are shifted one symbol at a time."""
    s = spec_of(name)
    a = q = 0
    out = []
    for i, (x, y) in enumerate(zip(acids, quals, strict=True)):
        key = (q << s.acid_bits) | a
        out.append((key << s.pb) | (i * 2**s.pb // len(acids)) if s.pb else key)
        if s.light:
            x, y = (x - 1, y * s.qm // 94) if x > 0 and y > 0 else (0, 0)
        a = a % s.base_digits ** (s.ao - 1) * s.base_digits + x if s.ao else 0
        q = q % s.quality_digits ** (s.qo - 1) * s.quality_digits + y if s.qo else 0
    return out


def keys_of(spark, name, acids, quals):
    df = spark.createDataFrame([(acids, quals)], "acids array<int>, quals array<int>")
    return df.select(key_array(spec_of(name), F.col("acids"), F.col("quals"))).first()[0]


def test_fixed_keys(spark):
    # Fixed values.
    assert keys_of(spark, "generic_ao2_qo1_pb0", [2, 4, 0], [0, 92, 0])[2] == 0xB8E
    assert keys_of(spark, "generic_ao2_qo1_pb3", [1] * 3 + [2, 4, 0, 0, 0], [0] * 4 + [92, 0, 0, 0])[5] == 0x5C75
    assert keys_of(spark, "generic_ao0_qo0_pb2", [1] * 7, [1] * 7) == [0, 0, 1, 1, 2, 2, 3]
    light = keys_of(spark, "light_ao2_qo2_pb4_qm16", [1, 0, 1, 1, 2, 2, 1, 1], [0, 0, 93, 93, 93, 93, 0, 0])
    assert light[:7] == [0, 2, 4, 0xF06, 0xFF08, 0xFF1A, 0xFF5C]


def test_fifty_key_types(spark, reads):
    """All types, as arrays and as windows, against queues."""
    assert len(KEY_TYPES) == 50 and max(s.bits for s in KEY_TYPES.values()) == 31
    got = reads.select("read_id", *[key_array(s, F.col("acids"), F.col("quals")).alias(n) for n, s in KEY_TYPES.items()]).collect()
    for r in got:
        _, _, acids, quals = READS[r["read_id"]]
        for name in KEY_TYPES:
            assert r[name] == keys_by_hand(name, acids, quals), name
    names = ["dummy", "generic_ao4_qo1_pb2", "light_ao3_qo5_pb4_qm16"]
    rows = bases_of(reads).select("read_id", "pos", *[key_column(spec_of(n)).alias(n) for n in names]).orderBy("read_id", "pos").collect()
    for name in names:
        assert [r[name] for r in rows] == [k for _, _, a, q in READS for k in keys_by_hand(name, a, q)]


def test_decoded_keys(spark):
    df = spark.createDataFrame([(0xB8E,)], "k long")
    assert df.select(decode(spec_of("generic_ao2_qo1_pb0"), F.col("k"))).first()[0].startswith("CG, }")
    assert df.select(decode(spec_of("generic_ao0_qo0_pb2"), F.lit(3).cast("long"))).first()[0].endswith("3/4")


def test_rates_of_all_types(spark, reads):
    """Counts, contexts and rates of both kinds of symbols for every type."""
    got = {(r.model_type, r.spec_type): (r.n_contexts, r.rate) for r in models.rates(models.all_counts(reads, list(KEY_TYPES.values()))).collect()}
    assert len(got) == 100
    for name in KEY_TYPES:
        for kind, which in (("acids", 2), ("q_scores", 3)):
            of = defaultdict(Counter)
            for r in READS:
                for key, symbol in zip(keys_by_hand(name, r[2], r[3]), r[which], strict=True):
                    of[key][symbol] += 1
            total = sum(sum(c.values()) for c in of.values())
            bits = sum(-n * math.log2(n / sum(c.values())) for c in of.values() for n in c.values())
            assert got[kind, name] == (len(of), pytest.approx(bits / total, abs=1e-9))


def test_size_limit(spark, reads):
    got = {r.spec_type: r for r in models.rates(models.all_counts(reads, [spec_of("dummy"), spec_of("generic_ao2_qo0_pb0")], ("acids",)), limit=2).collect()}
    assert not got["dummy"].too_big and got["generic_ao2_qo0_pb0"].too_big
    assert got["generic_ao2_qo0_pb0"].rate == 1_000_000 and got["generic_ao2_qo0_pb0"].n_contexts == 2


def test_model_of_five_symbols(spark):
    # Five symbols under two keys.
    counts = spark.createDataFrame([(1, 0, 2), (2, 0, 1), (2, 1, 2)], "spec long, symbol int, n long")
    got = {r.spec: (r.context_prob, r.symbol_prob) for r in models.contexts(counts, 3).collect()}
    assert got[1] == (0.4, [1.0, 0.0, 0.0])
    assert got[2][0] == 0.6 and got[2][1] == pytest.approx([1 / 3, 2 / 3, 0])


def test_information(spark):
    # Fixed values.
    row = spark.sql("select array(.25d, .25d, .125d, .375d) p, array(0d, .5d, .3d, .2d) l, array(.5d, .1d, .1d, .3d) r, array(.25d, .5d, .125d, .125d) t")
    p, q = F.lit(0.75), F.lit(0.25)
    got = row.select(info.entropy(F.col("p")), info.merged_probs(p, F.col("l"), q, F.col("r")), info.merge_cost(p, F.col("l"), q, F.col("t"))).first()
    assert got[0] == pytest.approx(1.905639, abs=1e-6)
    assert got[1] == pytest.approx([0.125, 0.4, 0.25, 0.225])
    assert got[2] == pytest.approx(0.14835548, abs=1e-6)
    zero = row.select(info.merged_probs(F.lit(0.0), F.col("l"), F.lit(0.0), F.col("r"))).first()[0]
    assert zero == [0, 0, 0, 0]


def test_cumulative_frequencies():
    # Fixed values.
    assert info.cumulative_frequencies([0, 0, 0.333, 0.333, 0.334], 8).tolist() == [0, 1, 2, 86, 170]
    assert info.cumulative_frequencies([0.05, 0.10, 0.125, 0.125, 0.30, 0.03, 0.07, 0.05, 0.12, 0.03], 10).tolist() == [0, 51, 154, 282, 410, 717, 748, 819, 870, 993]
    assert info.cumulative_frequencies([0.01, 0.01, 0.49, 0.49], 4).tolist() == [0, 1, 2, 9]
    assert info.cumulative_frequencies([0.25] * 4, 4).tolist() == [0, 4, 8, 12]
    rng = np.random.default_rng(2)
    for size in (5, 94):
        for _ in range(50):
            p = rng.dirichlet(np.full(size, 0.05))
            f = info.frequencies(info.cumulative_frequencies(p))
            assert f.sum() == 1 << 14 and f.min() >= 1
    with pytest.raises(ValueError):
        info.cumulative_frequencies([0.25] * 4, 2)


# Eight contexts of four symbols, and the merges of their tree (left, right, cost).
EIGHT = [
    (0.27, [0.1, 0.8, 0.0, 0.1]), (0.03, [0.4, 0.1, 0.2, 0.3]), (0.21, [0.0, 0.2, 0.7, 0.1]), (0.02, [0.5, 0.0, 0.0, 0.5]),
    (0.08, [0.3, 0.2, 0.2, 0.3]), (0.21, [0.2, 0.2, 0.5, 0.1]), (0.03, [0.5, 0.3, 0.2, 0.0]), (0.15, [0.2, 0.5, 0.0, 0.3]),
]
MERGES = [(1, 4, 0.001480), (3, 8, 0.012127), (5, 6, 0.015100), (0, 7, 0.029733), (9, 10, 0.040356), (2, 12, 0.092793), (11, 13, 0.331311)]


def tree8():
    return binning.build_tree([[k + 1] for k in range(8)], np.array([p for p, _ in EIGHT]), np.array([s for _, s in EIGHT]))


def test_tree_of_eight():
    tree = tree8()
    assert [(left, right) for left, right in zip(tree.left[8:], tree.right[8:], strict=True)] == [m[:2] for m in MERGES]
    assert tree.cost[8:] == pytest.approx([m[2] for m in MERGES], abs=1e-6)
    assert tree.symbols[-1] == pytest.approx([0.160, 0.403, 0.280, 0.157], abs=1e-6)
    # Cuts by either order.
    assert [tree.cut(k) for k in (2, 3, 4, 5)] == [[11, 13], [0, 7, 13], [0, 2, 7, 12], [0, 2, 7, 9, 10]]
    assert [round(tree.rate(tree.cut(k)), 4) for k in (2, 3, 4, 5)] == [1.5537, 1.5240, 1.4312, 1.3908]
    assert [round(tree.rate(tree.cut(k, "max_cost")), 4) for k in (3, 4)] == [1.4609, 1.4205]
    assert tree.specs_under(12) == [2, 4, 5, 6, 7]


def test_tree_against_all_pairs():
    """The cheapest pair at every step, found by trying all."""
    rng = np.random.default_rng(9)
    n = 24
    p, s = rng.dirichlet(np.ones(n)), rng.dirichlet(np.full(6, 0.4), n)
    tree = binning.build_tree([[k] for k in range(n)], p, s)
    live = {k: (p[k], s[k]) for k in range(n)}
    h = lambda x: float(info.entropy_np(np.asarray(x)))
    for new in range(n, 2 * n - 1):
        best = None
        for a in live:
            for b in live:
                if a < b:
                    w = live[a][0] + live[b][0]
                    mean = (live[a][0] * live[a][1] + live[b][0] * live[b][1]) / w
                    cost = w * h(mean) - live[a][0] * h(live[a][1]) - live[b][0] * h(live[b][1])
                    if best is None or cost < best[0] - 1e-12:
                        best = cost, a, b, w, mean
        assert (tree.left[new], tree.right[new]) == best[1:3] and tree.cost[new] == pytest.approx(best[0], abs=1e-9)
        del live[best[1]], live[best[2]]
        live[new] = best[3:]


def test_pre_binning(spark):
    # Fixed values.
    found = spark.createDataFrame([(1, 0.4, [1.0, 0.0, 0.0, 0.0]), (2, 0.3, [1.0, 0.0, 0.0, 0.0]), (3, 0.3, [0.25] * 4)], "spec long, context_prob double, symbol_prob array<double>")
    tree = binning.tree_of(found, 2)
    assert tree.specs[:2] == [[1], [2, 3]] and tree.probs == pytest.approx([0.4, 0.6, 1.0])
    assert tree.symbols[1] == pytest.approx([0.625, 0.125, 0.125, 0.125]) and tree.cost[2] == pytest.approx(0.19653243, abs=1e-6)
    assert binning.tree_of(found, 10).leaves == 3
    one = binning.tree_of(found, 1)
    assert one.leaves == 1 and one.specs[0] == [1, 2, 3]
    with pytest.raises(ValueError):
        binning.tree_of(spark.createDataFrame([([1, 2], 1.0, [1.0])], "specs array<bigint>, context_prob double, symbol_prob array<double>"))


def test_sweep_and_tables(spark):
    tree = tree8()
    assert binning.steps(8) == list(range(1, 8)) and binning.steps(9, 4) == [1, 3, 5, 7]
    rows = binning.sweep(spark, tree, order="max_cost").collect()
    assert [r.n_contexts for r in rows] == list(range(1, 8))
    assert all(a.rate >= b.rate - 1e-9 for a, b in zip(rows, rows[1:], strict=False))
    assert binning.tree_table(spark, tree).count() == 15
    model = binning.binned(spark, tree, 3)
    assert sorted(x for r in model.collect() for x in r.specs) == list(range(1, 9))
    assert models.model_rate(model).first()[0] == pytest.approx(tree.rate(tree.cut(3)), abs=1e-9)


def test_saved_models(spark, reads, tmp_path):
    path = f"file://{tmp_path}/models"
    a = models.save(models.build(reads, "generic_ao1_qo0_pb0", "acids"), path, "acids", "generic_ao1_qo0_pb0")
    b = models.save(models.build(reads, "generic_ao0_qo1_pb0", "q_scores"), path, "q_scores", "generic_ao0_qo1_pb0")
    assert len(a) == 32 and a != b
    table = models.load(spark, path)
    assert models.verify(table, a.hex()).count() == 5
    with pytest.raises(ValueError):
        models.verify(table, "00" * 32)
    wanted = spark.createDataFrame([(a.hex(),), ("11" * 32,)], "model_id string")
    assert [r[0] for r in models.missing(wanted, table).collect()] == ["11" * 32]
    own = models.verify(table, a.hex())
    back = models.as_contexts(own, models.spec_map(own)).orderBy("ctx_id").collect()
    assert [r.specs for r in back] == [[0], [1], [2], [3], [4]]
    with pytest.raises(ValueError):
        models.check(own, limit=3)
    # A key that the model lacks is uniform, and so is everything under an empty model.
    symbols = spark.createDataFrame([(99, 1)], "spec long, symbol int")
    for model in (own.select("specs", "ctx_id", "context_prob", "symbol_prob"), models.empty(spark)):
        assert models.with_default(symbols, model, "acids").first()["symbol_prob"] == [0.2] * 5


def test_stats_of_reads_without_symbols(spark, reads):
    none = stats.symbol_stats(reads.where("n = 0"), "acids").collect()
    assert [(r.label, r.n, r.pct) for r in none] == [(b, 0, 0.0) for b in BASES]
    assert stats.report(stats.symbol_stats(reads, "q_scores"))[0].endswith("%")


SIZES = [(0, 0, 10), (0, 1, 9), (1, 0, 5), (1, 1, 5), (2, 0, 20), (2, 1, 11), (3, 0, 7), (3, 1, 8)]


def test_choice_of_models(spark):
    sizes = spark.createDataFrame(SIZES, "read_id long, model_idx int, bytes long")
    assert [(r.model_idx, r.score) for r in select.ranking(sizes).orderBy("place").collect()] == [(0, 2), (1, 2)]
    assert [r.model_idx for r in select.best_by_rank(sizes, 1).collect()] == [0]
    assert [(r.read_id, r.model_idx) for r in select.best_model(sizes).orderBy("read_id").collect()] == [(0, 1), (1, 0), (2, 1), (3, 0)]
    # A switch costs 2 bytes: read 1 stays with model 1, and so does read 3, in its own block only.
    same = spark.createDataFrame([(k, 0) for k in range(4)], "read_id long, block_index long")
    two = spark.createDataFrame([(k, k // 3) for k in range(4)], "read_id long, block_index long")
    assert [r.model_idx for r in select.best_with_switching(sizes, same).orderBy("read_id").collect()] == [1, 1, 1, 1]
    assert [r.model_idx for r in select.best_with_switching(sizes, two).orderBy("read_id").collect()] == [1, 1, 1, 0]


def test_medoids_settle(spark):
    rng = random.Random(4)
    cost = {(r, m): rng.randrange(10, 99) for r in range(30) for m in range(6)}
    sizes = spark.createDataFrame([(*k, v) for k, v in cost.items()], "read_id long, model_idx int, bytes long")
    groups = select.medoids(sizes, 3)
    chosen = [m for m, _ in groups]
    assert len(set(chosen)) == 3 and sorted(r for _, g in groups for r in g) == list(range(30))
    for m, group in groups:
        for r in group:
            assert cost[r, m] == min(cost[r, c] for c in chosen)
    assert [select.file_level_count(q) for q in (1, 2, 7, 9)] == [1, 1, 4, 5]
    with pytest.raises(ValueError):
        select.file_level_count(0)
