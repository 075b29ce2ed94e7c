"""op3, op5, op7, op10: against brute force on whole tables."""

import hashlib
import math
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash

from readspark.llm import _components, decontaminate, lm_scoring, queries, simhash, substring_dedup
from readspark.llm._codec import pack

from .conftest import AWKWARD, DATA, PASSAGE, documents, rows_of, write

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def remainder(doc_id, k):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % k


# --- op3 ---


def lm_by_hand(rows):
    docs = [(r["doc_id"], remainder(r["doc_id"], 7) in (2, None), [*WORD.findall(lower(r["text"])), None]) for r in rows]
    train = [t for _, held, t in docs if not held]
    uni, bi, tri, ctx, kinds = Counter(), Counter(), Counter(), Counter(), defaultdict(set)
    for t in train:
        for a, b in zip(["<s>", *t], t, strict=False):
            uni[b] += 1
            bi[a, b] += 1
            ctx[a] += 1
            kinds[a].add(b)
        tri.update(zip(["<s>", *t], t, t[1:], strict=False))
    total, distinct = sum(uni.values()), len(uni)
    once, twice = sum(n == 1 for n in bi.values()), sum(n == 2 for n in bi.values())
    d = once / (once + 2 * twice) if once and twice else 0.5
    root = lambda w: (uni[w] + 1) / (total + distinct + 1)
    out = []
    for doc_id, held, t in docs:
        base = score = 0.0
        for z, a, b in zip([None, "<s>", *t], ["<s>", *t], t, strict=False):
            base += math.log10(root(b))
            p = root(b)
            if ctx[a]:
                p = max(bi[a, b] - d, 0) / ctx[a] + d * len(kinds[a]) / ctx[a] * root(b)
            if z is not None:
                p = (tri[z, a, b] + lm_scoring.PRIOR * p) / (bi[z, a] + lm_scoring.PRIOR)
            score += math.log10(p)
        out.append((str(doc_id), held, len(t), sum(uni[w] > 0 for w in t), total, base, score))
    return out


@pytest.mark.parametrize("folder", ["plain", "odd"])
def test_op3(spark, request, folder):
    folder = request.getfixturevalue(folder)
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in queries.op3_lm_scoring(spark, folder).collect())
    want = sorted(lm_by_hand(rows_of(folder)))
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)


def test_op3_memory_of_a_block():
    """Beside the block itself; a worker deals out blocks of more than a million tokens."""
    rng = np.random.default_rng(1)
    vocab = np.unique(rng.integers(0, 1 << 63, 30_000).astype(np.uint64))
    tokens = (rng.zipf(1.3, 300_000) % len(vocab)).astype(np.uint32)
    block = lm_scoring.Block(pack(np.zeros(500, np.uint8)), pack(np.full(500, 600, np.uint32)), pack(vocab, ascending=True), pack(tokens))
    tracemalloc.start()
    block.deal(np.zeros(0, np.uint64), 16)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak <= 60 * len(tokens)  # bytes; 44 measured, 112 before arrays were narrowed and freed


def test_op3_probabilities_sum_to_one(spark, tmp_path):
    """After any word, the probabilities of all words that can follow (and of one unknown) sum to 1: scores differ by the last word only."""
    texts = ["a b c a b d", "a c b", "b b a", "c a a b"]
    ids = [i for i in range(1, 100) if remainder(i, 7) != 2][: len(texts)]
    free = [i for i in range(1000, 2000) if remainder(i, 7) == 2]
    probes = {i: t for i, t in zip(free, ["a a", "a b", "a c", "a d", "a unknown", "a"], strict=False)}
    rows = [*zip(ids, texts, strict=True), *probes.items()]
    folder = write(tmp_path, pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "lang": ["en"] * len(rows), "source": ["w"] * len(rows)}))
    by = {p["text"]: p["score"] for p in queries.op3_lm_scoring(spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"), "doc_id").collect()}
    by_hand = dict(zip([r[1] for r in rows], [x[-1] for x in lm_by_hand([{"doc_id": a, "text": b} for a, b in rows])], strict=True))
    for t in probes.values():
        assert by[t] == pytest.approx(by_hand[t], abs=1e-9)


# --- op5 ---


def fingerprint(text):
    w = WORD.findall(lower(text))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def least_reachable(fps):
    """By comparing all pairs of distinct fingerprints."""
    ids = defaultdict(list)
    for doc, fp in fps:
        ids[fp].append(doc)
    distinct = list(ids)
    root = {fp: fp for fp in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    least = defaultdict(lambda: math.inf)
    for fp in distinct:
        least[find(fp)] = min([least[find(fp)], *[d for d in ids[fp] if d is not None]])
    return sorted((str(doc), f"{fp:016x}", None if (m := least[find(fp)]) == math.inf else m) for doc, fp in fps)


@pytest.mark.parametrize("folder", ["plain", "odd"])
def test_op5(spark, request, folder):
    folder = request.getfixturevalue(folder)
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in queries.op5_simhash(spark, folder).collect())
    assert got == least_reachable([(r["doc_id"], fingerprint(r["text"])) for r in rows_of(folder)])


def test_op5_links_of_planted_fingerprints(spark):
    """Chains, dense clusters larger than a cell's limits, and distances right at and beyond the limit."""
    import random

    rng = random.Random(7)
    flip = lambda fp, k: fp ^ sum(1 << b for b in rng.sample(range(64), k))
    fps = [rng.getrandbits(64) for _ in range(500)]
    for _ in range(60):
        fps += [flip(rng.choice(fps), k) for k in range(1, 7)]
    core = rng.getrandbits(64)
    fps += [flip(core, rng.randint(1, 4)) for _ in range(1500)]  # one large cell
    walk = rng.getrandbits(64)
    for _ in range(50):  # a chain
        walk = flip(walk, 4)
        fps.append(walk)
    fps = list(dict.fromkeys(fps))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    nodes = spark.createDataFrame([(signed(fp), i) for i, fp in enumerate(fps)], "fp long, node long")
    edges = simhash.links(nodes, 4, 16)
    pairs = edges.collect()
    assert all((fps[r.a] ^ fps[r.b]).bit_count() <= 4 for r in pairs)
    found = {r.node: r.root for r in _components.components(edges).collect()}
    got = sorted((str(i), f"{fp:016x}", found.get(i, i)) for i, fp in enumerate(fps))
    assert got == least_reachable(list(enumerate(fps)))


def test_op5_counts_bound_the_distance():
    """Manhattan distances of segment counts, by hand, and never above the Hamming distance; cells lose no near pair."""
    import random

    rng = random.Random(3)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 9)))
        per = lambda x: [(x >> 2 * i & 3).bit_count() for i in range(32)]
        by_hand = sum(abs(x - y) for x, y in zip(per(a), per(b), strict=True))
        ca, cb = (int(simhash.counts_of(np.array([x], np.uint64))[0]) for x in (a, b))
        assert (ca ^ cb).bit_count() == by_hand <= (a ^ b).bit_count()
        for g in (5, 7, 9):
            same = sum(all(ca >> 2 * i & 3 == cb >> 2 * i & 3 for i in range(32) if i * g // 32 == k) for k in range(g))
            assert by_hand > 4 or same >= g - 4
    assert [simhash.groups_for(n, 4) for n in (10, 10**5, 10**7, 10**10)] == sorted(simhash.groups_for(n, 4) for n in (10, 10**5, 10**7, 10**10))


# --- op7 ---


def decontaminated_by_hand(rows, items, window=8):
    where = defaultdict(set)
    for it in items:
        w = ITEM_WORD.findall(lower(it["text"]))
        if it["item_id"] is None or not w:
            continue
        size = min(window, len(w))
        for i in range(len(w) - size + 1):
            where[tuple(w[i : i + size])].add(str(it["item_id"]))
    sizes = {len(k) for k in where}
    out = []
    for r in rows:
        w = ITEM_WORD.findall(lower(r["text"]))
        hit, found = set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if (got := where.get(tuple(w[i : i + size]))) is not None:
                    hit |= set(range(i, i + size))
                    found |= got
        out.append((str(r["doc_id"]), len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2))
    return sorted(out)


BENCH = [
    (1, " ".join(f"passage{i}" for i in range(10, 30))),
    (2, " ".join(f"Passage{i}" for i in range(20, 40))),
    (10, "mixed case"),
    (11, "WORD"),
    (12, ""),
    (13, None),
    (14, "!!! ---"),
    (None, "two words"),
    (15, "the same the same the same the same"),
    (16, "the same the"),
    (17, "日本語 🙂🙂"),
    (17, "a b c d e f g h i j"),
    (18, "c d e f g h i j"),
    (19, "123"),
]


@pytest.mark.parametrize("folder", ["plain", "odd"])
def test_op7(spark, request, folder, tmp_path):
    folder = request.getfixturevalue(folder)
    items = rows_of(folder, "benchmark") + [{"item_id": a, "text": b} for a, b in BENCH]
    docs = pq.read_table(f"{folder}/documents.parquet")
    bench = pa.table({"item_id": pa.array([i["item_id"] for i in items], pa.int64()), "text": pa.array([i["text"] for i in items], pa.string()), "doc_id": ["clash"] * len(items)})
    folder = write(tmp_path, docs, benchmark=bench)
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in queries.op7_decontaminate(spark, folder).collect())
    assert got == decontaminated_by_hand(rows_of(folder), items)
    # The same in several passes over groups of items.
    table, bench = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    many = decontaminate.find_items(table, bench, 8, shard_words=60).selectExpr("cast(doc_id as string) as doc_id", "n_words", "n_hit", "size(items) as n")
    assert sorted((str(r[0]), *r[1:]) for r in many.collect()) == sorted(x[:4] for x in got)


def test_automaton_against_all_stretches():
    import random

    rng = random.Random(1)
    for _ in range(40):
        seqs = [[rng.randrange(3) for _ in range(rng.randrange(1, 12))] for _ in range(4)]
        auto = decontaminate.SuffixAutomaton()
        for s in seqs:
            auto.add(s)
        known = {tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        text = [rng.randrange(3) for _ in range(30)]
        want = [max([0, *[k for k in range(1, i + 1) if tuple(text[i - k : i]) in known]]) for i in range(1, len(text) + 1)]
        assert auto.lengths(text) == want


@pytest.mark.parametrize("shard_words", [2_000_000, 1])
def test_remove_spans_cuts_only_hits(spark, shard_words):
    """With all items in one search, and with a search for each item."""
    docs = spark.createDataFrame([(1, f"Before it. {PASSAGE}, after it: " + "clean words here " * 60, "x"), (2, PASSAGE, "x"), (3, None, "x"), (4, "untouched\n text ", "x")], "doc_id long, text string, items string")
    bench = spark.createDataFrame([(1, PASSAGE.upper()), (2, "an item that no document here has at all")], "item_id long, text string")
    got = {r.doc_id: r.text for r in decontaminate.remove_spans(docs, bench, shard_words=shard_words).collect()}
    assert got == {1: "Before it. , after it: " + "clean words here " * 60, 3: None, 4: "untouched\n text "}


# --- op10 ---


def deduplicated_by_hand(rows, window=13, history=()):
    least = {}
    for t in history:
        w = WORD.findall(t or "")
        least |= {tuple(w[i : i + window]): -math.inf for i in range(len(w) - window + 1)}
    words = {k: WORD.findall(r["text"] or "") for k, r in enumerate(rows)}
    for k, r in enumerate(rows):
        if r["doc_id"] is not None:
            for i in range(len(words[k]) - window + 1):
                key = tuple(words[k][i : i + window])
                least[key] = min(least.get(key, math.inf), r["doc_id"])
    out = []
    for k, r in enumerate(rows):
        w, gone = words[k], set()
        for i in range(len(w) - window + 1):
            if r["doc_id"] is not None and least[tuple(w[i : i + window])] < r["doc_id"]:
                gone |= set(range(i, i + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((str(r["doc_id"]), len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("folder", ["plain", "odd"])
def test_op10(spark, request, folder):
    folder = request.getfixturevalue(folder)
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in queries.op10_substring_dedup(spark, folder).collect())
    assert got == deduplicated_by_hand(rows_of(folder))


def test_op10_runs_of_few_windows(spark, plain, monkeypatch):
    """The same where a task writes many runs, and where a shard holds few hashes."""
    monkeypatch.setattr(substring_dedup, "RUN_WINDOWS", 500)
    docs = spark.read.parquet(f"{plain}/documents.parquet")
    got = substring_dedup.deduplicate(docs.repartition(7), 13, shards=5).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == deduplicated_by_hand(rows_of(plain))


def test_op10_index_over_batches(spark, plain):
    """Batches against the runs of history, before and after compaction."""
    rows = rows_of(plain)
    index = substring_dedup.FingerprintIndex(spark, shards=6)
    docs = spark.read.parquet(f"{plain}/documents.parquet")
    seen = []
    for k in range(3):
        part = [r for r in rows if r["doc_id"] % 3 == k]
        got = index.add(docs.where(f"doc_id % 3 = {k}")).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
        assert sorted((str(r[0]), *r[1:]) for r in got) == deduplicated_by_hand(part, history=[r["text"] for r in seen])
        seen += part
        if k == 1:
            before = index.history().count()
            index.compact()
            assert len(index.paths) == 1 and index.history().count() <= before


def test_op10_keeps_texts_and_columns(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    got = substring_dedup.deduplicate(docs).where("n_removed = 0").select("doc_id", "text", "row.*")
    assert set(got.columns) == set(docs.columns)
    assert got.join(docs.select("doc_id", "text").distinct(), ["doc_id", "text"], "left_anti").where("doc_id is not null and text is not null").count() == 0


def test_empty_tables(spark, bare):
    for f in (queries.op3_lm_scoring, queries.op5_simhash, queries.op7_decontaminate, queries.op10_substring_dedup):
        assert f(spark, bare).collect() == []


def test_awkward_rows_are_in_the_tables():
    assert len(AWKWARD) == len({r[0] for r in AWKWARD}) and documents().num_rows == pq.read_table(f"{DATA}/documents.parquet").num_rows + len(AWKWARD)


def test_op10_rows_of_a_repeated_id(spark):
    """Rows under one id with different texts are judged each by its own."""
    a, b = (" ".join(f"{x}{i}" for i in range(20)) for x in "ab")
    rows = [{"doc_id": 1, "text": a}, {"doc_id": 2, "text": a}, {"doc_id": 2, "text": b}, {"doc_id": 2, "text": b}, {"doc_id": 3, "text": b + "\n" + a + "\n tail"}]
    docs = spark.createDataFrame([(r["doc_id"], r["text"], "x", 1) for r in rows], "doc_id long, text string, `my col` string, `a-b` int")
    got = substring_dedup.deduplicate(docs, shards=3).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == deduplicated_by_hand(rows)
    assert [r.text for r in got if r.doc_id == 3] == ["tail"] and all(r["row"]["my col"] == "x" and r["row"]["a-b"] == 1 for r in got)


def test_op10_keeps_white_space(spark):
    a = " ".join(f"a{i}" for i in range(20))
    docs = spark.createDataFrame([(1, a), (2, f" first\n\nsecond\t{a}\n third\n")], "doc_id long, text string")
    assert [r.text for r in substring_dedup.deduplicate(docs, shards=2).where("doc_id = 2").collect()] == [" first\n\nsecond\tthird\n"]


@pytest.mark.parametrize("batches", [1, 3, 6])
def test_op10_batches_runs_and_split_shards(spark, odd, batches, monkeypatch):
    """Any number of batches gives the same, also where runs are merged and shards are split on the way."""
    monkeypatch.setattr(substring_dedup.FingerprintIndex.__init__, "__defaults__", (None, 13, 64, 2, 20_000))
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    got = substring_dedup.deduplicate(docs, batches=batches, shards=3).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == deduplicated_by_hand(rows_of(odd))


def test_op10_reads_its_history(spark, tmp_path):
    """Files of runs are what decides: without a run's file the second batch fails, and with it both batches agree."""
    import glob
    import os

    a = " ".join(f"a{i}" for i in range(20))
    index = substring_dedup.FingerprintIndex(spark, f"file://{tmp_path}", shards=2)
    first, second = (spark.createDataFrame([(i, a)], "doc_id long, text string") for i in (1, 2))
    assert [r.n_removed for r in index.add(first).collect()] == [0]
    assert [r.n_removed for r in index.add(second).collect()] == [20]
    for f in glob.glob(f"{tmp_path}/*.run"):
        os.remove(f)
    with pytest.raises(Exception, match="No such file|not exist|FileNotFound"):
        index.add(second).collect()
