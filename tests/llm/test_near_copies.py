"""The pipeline's near duplicates against all pairs of sets of five words."""

import random

import corpus_pipeline
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from readspark.llm import near_copies

from .conftest import rows_of, write
from .test_documents import WORD, lower


def shingles(text):
    w = WORD.findall(lower(text))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def groups_by_hand(rows):
    """The number of each row's group."""
    sets = [shingles(r["text"]) for r in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(a & b)
            if group[i] != group[j] and (a == b or both * 5 >= 4 * (len(a) + len(b) - both)):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return group


def by_hand(rows):
    group, least = groups_by_hand(rows), {}
    for r, g in zip(rows, group, strict=True):
        if r["doc_id"] is not None:
            least[g] = min(least.get(g, r["doc_id"]), r["doc_id"])
    return sorted((str(r["doc_id"]), str(least.get(g))) for r, g in zip(rows, group, strict=True))


def fingerprint(text):
    w = WORD.findall(lower(text))
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 5]).encode(), 42) for i in range(max(1, len(w) - 4))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def connected(items, pairs):
    """The least item that chains of pairs reach, for each item."""
    root = {x: x for x in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in items}


def planted():
    """Copies with words changed, on both sides of the limit, a large family, and texts that share a passage."""
    rng = random.Random(5)
    text = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]

    def changed(words, k):
        out = list(words)
        for i in rng.sample(range(len(out)), k):
            out[i] = f"new{rng.randrange(10**9)}"
        return out

    out, passage = [], text(40)
    for n in (8, 20, 60, 200, 1500):
        for _ in range(4):
            base = text(n)
            out += [base, base[: max(n - n // 6, 1)], *[changed(base, k) for k in {1, n // 60, n // 50, n // 45, n // 30, n // 10} if k]]
    family = text(150)
    out += [changed(family, rng.randint(1, 3)) for _ in range(120)]
    out += [text(60) + passage + text(60) for _ in range(60)]
    rng.shuffle(out)
    return [{"doc_id": 3 * i + 1, "text": " ".join(w)} for i, w in enumerate(out)]


@pytest.mark.parametrize("chunk", [7, 256])
def test_near_copies_of_planted_texts(spark, monkeypatch, chunk):
    monkeypatch.setattr(near_copies, "CHUNK", chunk)
    rows = planted()
    docs = spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id long, text string").repartition(3)
    got = sorted((str(r.doc_id), str(r.component_id)) for r in near_copies.near_copies(docs).collect())
    assert got == by_hand(rows)


def test_near_copies_of_large_groups(spark, monkeypatch):
    """Groups in slices of 12, cells of common shingles in pieces of 5, clusters in chunks of 7: what large groups take, on a small table."""
    for name, size in (("GROUP", 12), ("PIECE", 5), ("CHUNK", 7)):
        monkeypatch.setattr(near_copies, name, size)
    rows = planted()
    docs = spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id long, text string").repartition(3)
    sizes = []
    sliced = near_copies._slices
    monkeypatch.setattr(near_copies, "_slices", lambda groups: (found := sliced(groups), sizes.append(found[1].count()))[0])
    got = sorted((str(r.doc_id), str(r.component_id)) for r in near_copies.near_copies(docs).collect())
    assert got == by_hand(rows)
    assert sizes[0] > 0


@pytest.mark.parametrize("folder", ["plain", "odd"])
def test_near_copies_of_tables(spark, request, folder):
    folder = request.getfixturevalue(folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = sorted((str(r.doc_id), str(r.component_id)) for r in near_copies.near_copies(docs).collect())
    assert got == by_hand(rows_of(folder))


def test_stage_drops_copies_beyond_four_bits(spark, tmp_path):
    """Of 200 words 4 changed: similar at 0.8 or more, and further apart than op5's limit."""
    rows = planted()
    table = pa.table({"doc_id": [r["doc_id"] for r in rows], "text": [r["text"] for r in rows], "n_chars": [len(r["text"]) for r in rows]})
    folder = write(tmp_path, table)
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).collect()
    assert {str(r.doc_id) for r in kept} == {d for d, least in by_hand(rows) if d == least}


def test_stage_tells_rows_of_a_repeated_id_apart(spark, tmp_path):
    """A copy under a repeated id goes alone; different texts under one id stay, copies of one text once."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(100)) for x in "abcd")
    rows = [(1, a), (2, a + " more"), (2, b), (3, c), (3, d), (3, d + " end"), (4, c), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("x"))
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(got) == 5
    assert {(1, a), (2, b), (3, c), (None, a)} < set(got) and len({(3, d), (3, d + " end")} & set(got)) == 1


def test_stage_links_simhash_fingerprints(spark, monkeypatch):
    """The stage compares the texts that SimHash links, all within 4 bits, and drops the similar ones without any other search."""
    rows = planted()
    a, b = (" ".join(f"{x}{i % 7}" for i in range(200)) for x in "xy")
    rows += [{"doc_id": 9000 + k, "text": t} for k, t in enumerate([a, a + " " + a, b + " end", b, "", None])]
    docs = spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id long, text string").repartition(3)
    text = {r["doc_id"]: r["text"] for r in rows}
    ids = {}
    for r in near_copies._described(docs, 5).collect():
        ids[r.node] = min(r.doc_id, ids.get(r.node, r.doc_id))
    compared = []
    confirmed = near_copies._confirmed
    monkeypatch.setattr(near_copies, "_confirmed", lambda pairs, *rest: (compared.append([(ids[r.a], ids[r.b]) for r in pairs.collect()]), confirmed(pairs, *rest))[1])
    monkeypatch.setattr(near_copies, "_groups", lambda *_: spark.createDataFrame([], "anchor long, node long"))
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    kept = {r.doc_id for r in kept.collect()}

    # Rows of equal sets are one; of the others, SimHash connects whatever is within 4 bits.
    sets = {}
    for d, t in sorted(text.items()):
        sets.setdefault(shingles(t), []).append(d)
    fps = [(fingerprint(text[d]), own[0]) for s, own in sets.items() if s for d in own]
    within = [(x, y) for i, (f, x) in enumerate(fps) for g, y in fps[:i] if (f ^ g).bit_count() <= 4]
    first = [own[0] for own in sets.values()]
    assert connected(first, compared[0]) == connected(first, within)
    similar = lambda x, y: 5 * len(x & y) >= 4 * len(x | y)
    alike = [(x, y) for x, y in compared[0] if similar(shingles(text[x]), shingles(text[y]))]
    assert 3 < len(alike) < len(compared[0])
    assert kept == {x for x, least in connected(first, alike).items() if x == least}


def test_near_copies_of_any_simhash_distance(spark):
    """What SimHash links, and whether its links are similar, changes nothing in the groups."""
    rows = planted()
    docs = spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id long, text string").repartition(3)
    for distance in (0, 8):
        got = sorted((str(r.doc_id), str(r.component_id)) for r in near_copies.near_copies(docs, distance=distance).collect())
        assert got == by_hand(rows)
