"""Near duplicates by SimHash fingerprints.

Method: segment-popcount embedding. A fingerprint is mapped to the counts of set bits in
its 32 segments of two bits. The Manhattan distance of two such vectors is never more than
the Hamming distance of the fingerprints, so a range join over a grid of the vectors finds
every link. The 32 coordinates are in ``g`` groups; vectors within a distance of
``distance`` agree in ``g - distance`` groups at least, so for each choice of that many
groups a fingerprint stands in one cell of the grid, that of its counts in these groups
(cells are one count wide). ``g`` follows the number of fingerprints: more groups are more
cells of fewer fingerprints. Within a cell, all candidates pass the Manhattan bound over
the whole vector and are then compared exactly. (Wider segments choose too weakly: with
eight bits, a hundredth of unrelated fingerprints lies within a distance of 4.)

Only distinct fingerprints are compared, and a cell gives the edges of a spanning forest,
at most one fewer than it has fingerprints. A large cell is dealt out again by its other
coordinates, and parts that are already connected are skipped. No pairs of documents are made.

Defined cases: a bit set in just half of the shingles is 0; a very long text is handled
whole, alone in its block; a text without words (a null too) has the fingerprint zero and is linked
like any other; rows with a repeated ``doc_id`` are documents of their own; rows with a
null ``doc_id`` link like others, and their component is null where no other row is
reached; ids are below 2**62; other columns are not read; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._codec import pack, unpack
from ._components import components
from ._shared import shards_for, stored
from ._text import LOWER, Texts, blocks, mix, ragged, release, tidy, words

SEED = 42
#: Six blocks of the 64 bits, as masks.
#: Segments have two bits.
SEGMENTS, PAIRS = 32, np.uint64(0x5555555555555555)
#: A cell with more fingerprints is dealt out again.
SMALL, LARGE = 32, 1024
#: Nodes without an id begin here.
NO_ID = 1 << 62


def fingerprints_of(texts: Texts, shingle: int) -> np.ndarray:
    """The SimHash of each text."""
    texts = Texts(LOWER[texts.data], texts.offsets, texts.first)
    w = words(texts)
    sizes = w.ends - w.starts
    at = np.cumsum(sizes + 1) - sizes - 1
    joined = np.full(int((sizes + 1).sum()), 0x20, np.uint8)
    joined[ragged(at, sizes)] = texts.data[ragged(w.starts, sizes)]
    n = w.counts()
    count = np.where(n > 0, np.maximum(n - shingle + 1, 1), 0)
    first = ragged(w.offsets[:-1], count)
    last = first + np.repeat(np.minimum(shingle, np.maximum(n, 1)) - 1, count)
    raw, digest = joined.tobytes(), xxhash.xxh64_digest
    hashes = b"".join([digest(raw[a:b], SEED) for a, b in zip(at[first].tolist(), (at[last] + sizes[last]).tolist(), strict=True)])
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
    out = np.zeros(len(texts), np.uint64)
    if (full := np.flatnonzero(count)).size:
        sums = np.add.reduceat(bits, (np.cumsum(count) - count)[full], axis=0, dtype=np.int32)
        out[full] = np.packbits(sums * 2 > count[full, None], axis=1).view(">u8").ravel()
    return out


def fingerprints(docs: DataFrame, shingle: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, fp)``; one narrow stage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0, np.uint64), *[fingerprints_of(t, shingle) for t in blocks(batch.column(1), 1 << 20)]]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(found).view(np.int64))], ["doc_id", "fp"])

    ids = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return ids.mapInArrow(tidy(run), f"doc_id {docs.schema[id_column].dataType.simpleString()}, fp long")


class Forest:
    """Disjoint sets over the places 0 .. n - 1, and the edges that joined them."""

    def __init__(self, n: int) -> None:
        self.parent = list(range(n))
        self.edges: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
            self.edges.append((a, b))


def counts_of(fps: np.ndarray) -> np.ndarray:
    """The count of each segment in unary (0, 1, 3), so that differing bits are the Manhattan distance of the counts."""
    other = fps >> np.uint64(1)
    return (fps | other) & PAIRS | (fps & other & PAIRS) << np.uint64(1)


def groups_for(n: int, distance: int) -> int:
    """The number of groups with the least work for n fingerprints: dealing out cells, and comparing within them."""

    def work(g: int) -> float:
        equal = 0.375 ** (SEGMENTS * (g - distance) / g)  # two counts of random bits agree with 3/8
        return comb(g, distance) * (30 + n * equal)

    return min(range(distance + 1, min(distance + 9, SEGMENTS) + 1), key=work)


def _near(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    """Whether the Manhattan bound and then the Hamming distance is at most ``distance``."""
    found = np.bitwise_count(counts_of(a) ^ counts_of(b)) <= distance
    found[found] = np.bitwise_count(a[found] ^ b[found]) <= distance
    return found


def _link(fps: np.ndarray, at: np.ndarray, forest: Forest, distance: int) -> None:
    """Join what is near among the distinct fingerprints at the places ``at``."""
    if len(at) < 2 or len({forest.root(x) for x in at.tolist()}) == 1:
        return
    own = fps[at]
    counts = counts_of(own)
    differ = int(np.bitwise_or.reduce(counts ^ counts[0]))
    places = [i for i in range(64) if differ >> i & 1]
    if len(at) <= LARGE or len(places) <= distance:
        for i in range(len(at) - 1):
            for j in np.flatnonzero(_near(own[i + 1 :], np.broadcast_to(own[i], len(own) - i - 1), distance)).tolist():
                forest.join(int(at[i]), int(at[i + 1 + j]))
        return
    for k in range(distance + 1):  # the counts in one of these parts are equal in two near fingerprints
        key = counts & np.uint64(sum(1 << i for i in places[k :: distance + 1]))
        order = np.argsort(key, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
            _link(fps, at[part], forest, distance)


def links(nodes: DataFrame, distance: int = 4, shards: int = 64, groups: int | None = None) -> DataFrame:
    """Edges ``(a, b)`` between the nodes of distinct fingerprints ``(fp, node)`` that connect whatever is near."""
    if not 0 <= distance <= 8:
        raise ValueError("distance must be from 0 to 8")
    groups = groups or groups_for(nodes.count(), distance)
    masks = [sum(3 << 2 * s for s in range(SEGMENTS) if s * groups // SEGMENTS in chosen) for chosen in combinations(range(groups), groups - distance)]

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def deal(fps: np.ndarray, nodes: np.ndarray) -> pa.RecordBatch:
            counts = counts_of(fps)
            keys = np.concatenate([mix((counts & np.uint64(m)) ^ mix(np.full(len(fps), k + 1, np.uint64))) for k, m in enumerate(masks)])
            owner = np.tile(np.arange(len(fps)), len(masks))
            shard = (keys % np.uint64(shards)).astype(np.int32)
            order = np.lexsort((keys, shard))
            keys, owner, shard = keys[order], owner[order], shard[order]
            at = np.searchsorted(shard, np.arange(shards + 1))
            full = np.flatnonzero(np.diff(at))
            cut = lambda x, **o: [pack(x[at[s] : at[s + 1]], **o) for s in full]
            return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(cut(keys, ascending=True), pa.binary()), pa.array(cut(fps[owner]), pa.binary()), pa.array(cut(nodes[owner]), pa.binary())], ["shard", "keys", "fps", "nodes"])

        # About as many cells at once, whatever the number of groups.
        most = max(1, 2_000_000 // len(masks))
        held, n = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()))
            n += batch.num_rows
            if n >= most:
                yield deal(*map(np.concatenate, zip(*held, strict=True)))
                held, n = [], 0
        if n:
            yield deal(*map(np.concatenate, zip(*held, strict=True)))

    def join(part: pd.DataFrame) -> pd.DataFrame:
        keys, fps, nodes = (np.concatenate([unpack(x) for x in part[c]]) for c in ("keys", "fps", "nodes"))
        distinct, first, place = np.unique(fps, return_index=True, return_inverse=True)
        nodes = nodes[first]
        order = np.argsort(keys, kind="stable")
        keys, place = keys[order], place[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(starts, len(keys)))
        forest = Forest(len(distinct))
        small = np.repeat(sizes <= SMALL, sizes) & np.repeat(sizes > 1, sizes)
        keys_s, place_s = keys[small], place[small]
        for d in range(1, SMALL):
            a = np.flatnonzero(keys_s[d:] == keys_s[:-d])
            if not len(a):
                break
            x, y = place_s[a], place_s[a + d]
            near = _near(distinct[x], distinct[y], distance)
            for i, j in zip(x[near].tolist(), y[near].tolist(), strict=True):
                forest.join(i, j)
        for k in np.flatnonzero(sizes > SMALL):
            _link(distinct, place[starts[k] : starts[k] + sizes[k]], forest, distance)
        edges = np.array(forest.edges, np.int64).reshape(-1, 2)
        release()
        return pd.DataFrame({"a": nodes[edges[:, 0]], "b": nodes[edges[:, 1]]})

    dealt = nodes.select("fp", "node").mapInArrow(tidy(cells), "shard int, keys binary, fps binary, nodes binary")
    return dealt.groupBy("shard").applyInPandas(join, "a long, b long")


def near_duplicates(docs: DataFrame, distance: int = 4, shingle: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, fp, component_id)`` of every document."""
    found = stored(fingerprints(docs, shingle, id_column, text_column), "fingerprints")
    # A fingerprint of null ids alone has a node above all ids, so that it is never a root while there is an id.
    without = F.xxhash64("fp").bitwiseAND(F.lit(NO_ID - 1)).bitwiseOR(F.lit(NO_ID))
    nodes = stored(found.groupBy("fp").agg(F.min("doc_id").cast("long").alias("node")).withColumn("node", F.coalesce("node", without)), "nodes")
    roots = components(links(nodes, distance, shards_for(docs)))
    least = F.coalesce("root", "node")
    where = stored(nodes.join(roots, "node", "left").select("fp", F.when(least < NO_ID, least).alias("component_id")), "components")
    return found.join(where, "fp").select("doc_id", "fp", "component_id")
