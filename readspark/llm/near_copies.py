"""Near duplicates by SimHash and the Jaccard similarity of word shingles, complete and exact.

SimHash comes first: fingerprints over the shingles, linked at ``distance`` bits by the grid
of ``simhash``, and the two texts of each link are compared exactly. What these links connect
isn't looked for again. A distance that is small enough to search for misses most pairs at a
similarity near 0.8 (their fingerprints differ in 10 bits and more), so the pairs that
SimHash leaves apart are searched for by filters that lose none:

* prefixes: put in one order, the first ``n - ceil(least * n) + 1`` shingles of two similar
  sets share one, and in the smaller set it is among the first
  ``n - ceil(2 * least / (1 + least) * n) + 1``. The order is by the number of documents of
  a sample that have a shingle (rare first), then by hash; any order is right, this one
  keeps cells small;
* sizes: the smaller set has ``least`` of the larger one's size at least;
* parity fingerprints: each shingle flips one of 2 to 4 bits for each shingle of the set, so
  two fingerprints differ in no more bits than the sets differ in shingles. Folding one onto
  half its length makes fingerprints of different lengths comparable.

The sets of a cell (a shared prefix shingle) go to its anchor, the least of them: cells of
the same copies have the same anchor, so a fingerprint is sent once for each anchor and not
for each shared shingle. Within an anchor's group those whose fingerprints are near are
joined to a forest of pairs, and the two texts of each pair are compared exactly. A group
in which every pair of its forest is confirmed is done. The others (and groups of more than
GROUP sets, which are dealt out in slices, each with the anchor) are looked at once more:
what is near and not yet connected is brought together in clusters, of which all pairs are
compared; a cluster of more than CHUNK sets is dealt out by pairs of chunks.

Equal sets are one node, named by 64 bits of its shingles' hashes; shingles are compared by
64-bit hashes. A fingerprint counts repeated shingles, so a node may have several; it is
linked by each. Defined cases: words are lowercased as in ``simhash``; a text of fewer words
than a shingle is one shingle; texts without words (nulls too) equal each other; a very long
text is handled whole, alone in its block; ties in the order of shingles are broken by hash;
rows with a repeated or null ``doc_id`` are documents of their own, known by id and
``text_hash``; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType

from ._codec import pack, unpack
from ._components import components
from ._shared import shards_for, stored
from ._text import LOWER, Texts, blocks, mix, ragged, release, tidy, word_hashes, words
from .simhash import Forest, fingerprints_of, links

#: Documents of the sample that orders shingles, and how many of them have a common one.
SAMPLE, COMMON, MOST_COMMON = 20_000, 4, 200_000
LEAST_BITS = 512
#: Sets of an anchor's group that are looked at together, and of a cluster that are compared with each other.
GROUP, CHUNK = 4096, 256
#: Nodes of a common shingle that one task joins.
PIECE = 500_000
#: Shingles that a task gathers before it deals them out.
HELD = 1_000_000


def shingle_sets(texts: Texts, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text as hashes, ascending in each, and where each text's begin."""
    w = words(Texts(LOWER[texts.data], texts.offsets, texts.first))
    n = w.counts()
    count = np.where(n > 0, np.maximum(n - shingle + 1, 1), 0)
    first, owner = ragged(w.offsets[:-1], count), np.repeat(np.arange(len(texts)), count)
    size = np.minimum(shingle, n)[owner]
    h, out = word_hashes(w), np.zeros(len(first), np.uint64)
    for k in range(shingle):
        more = np.flatnonzero(size > k)
        out[more] = mix(out[more] * np.uint64(0x9E3779B97F4A7C15) + h[first[more] + k] + np.uint64(k + 1))
    order = np.lexsort((out, owner))
    out, owner = out[order], owner[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    out, owner = out[new], owner[new]
    return out, np.searchsorted(owner, np.arange(len(texts) + 1))


def _nodes(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(sets ^ np.uint64(0xD6E8FEB86659FD93)), dtype=np.uint64)])
    return mix((sums[at[1:]] - sums[at[:-1]]) ^ mix(np.diff(at).astype(np.uint64))).view(np.int64)


def _bits(n: np.ndarray) -> np.ndarray:
    """Bits of the fingerprint of n shingles: the power of two from 2 n on."""
    return np.maximum(LEAST_BITS, 1 << np.ceil(np.log2(np.maximum(2 * n, 2))).astype(np.int64))


def _parities(sets: np.ndarray, at: np.ndarray) -> list[bytes]:
    """The parity fingerprint of each set."""
    size = np.diff(at)
    bits = _bits(size)
    ends = np.cumsum(bits)
    place = np.repeat(ends - bits, size) + (mix(sets) & np.repeat(bits - 1, size).astype(np.uint64)).astype(np.int64)
    raw = np.packbits((np.bincount(place, minlength=int(ends[-1]) if len(ends) else 0) & 1).astype(np.uint8)).tobytes()
    return [raw[b - n : b] for b, n in zip((ends // 8).tolist(), (bits // 8).tolist(), strict=True)]


def _prefix(n: np.ndarray, share: Fraction) -> np.ndarray:
    """The first ``n - ceil(share * n) + 1`` of n."""
    return np.where(n > 0, n - -(-n * share.numerator // share.denominator) + 1, 0)


def _common(docs: DataFrame, shingle: int, every: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, of shingles that several documents of a sample have, and how many have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in blocks(batch.column(0), 1 << 20):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_sets(texts, shingle)[0].view(np.int64))], ["h"])

    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select("text")
    found = sample.mapInArrow(tidy(run), "h long").groupBy("h").count().where(F.col("count") >= COMMON)
    rows = found.orderBy(F.desc("count"), "h").limit(MOST_COMMON).toPandas()
    h, n = rows["h"].to_numpy(np.int64).view(np.uint64), rows["count"].to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def _described(docs: DataFrame, shingle: int) -> DataFrame:
    """``(doc_id, text_hash, node, n, fp, sketch)`` of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in blocks(batch.column(2), 1 << 20):
                sets, at = shingle_sets(texts, shingle)
                own = [batch.column(k).slice(texts.first, len(texts)) for k in (0, 1)]
                fps = fingerprints_of(texts, shingle).view(np.int64)
                yield pa.RecordBatch.from_arrays([*own, pa.array(_nodes(sets, at)), pa.array(np.diff(at).astype(np.int64)), pa.array(fps), pa.array(_parities(sets, at), pa.binary())], ["doc_id", "text_hash", "node", "n", "fp", "sketch"])

    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return keyed.mapInArrow(tidy(run), keyed.select("doc_id", "text_hash").schema.add("node", LongType()).add("n", LongType()).add("fp", LongType()).add("sketch", BinaryType()))


def _linked(described: DataFrame, distance: int, shards: int) -> DataFrame:
    """``(a, b)``: pairs that connect the nodes whose SimHash fingerprints differ in ``distance`` bits at most."""
    own = stored(described.where("n > 0").select("fp", "node").distinct(), "fingerprints")
    first = stored(own.groupBy("fp").agg(F.min("node").alias("node"), F.count("*").alias("nodes")), "first")
    equal = own.join(first.where("nodes > 1").select("fp", F.col("node").alias("a")), "fp").select("a", F.col("node").alias("b"))
    return equal.unionByName(links(first, distance, shards)).where("a <> b").distinct()


def _groups(docs: DataFrame, shingle: int, least: Fraction, shards: int) -> DataFrame:
    """``(anchor, node)``: whatever shares a prefix shingle is in one group at least, of the least node that has it."""
    every = max(1, docs.count() // SAMPLE)
    heavy = docs.sparkSession.sparkContext.broadcast(_common(docs, shingle, every))
    p, q = least.numerator, least.denominator
    first = Fraction(2 * p, p + q)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = heavy.value
        pieces = -(-counts * every // PIECE)  # of a cell that very many nodes have

        def out(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            h, node, size, salt = map(np.concatenate, zip(*held, strict=True))
            shard = (np.where(salt > 0, mix(h + salt), h) % np.uint64(shards)).astype(np.int32)
            order = np.lexsort((node, h, salt, shard))
            h, node, size, salt, shard = (x[order] for x in (h, node, size, salt, shard))
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (node[1:] != node[:-1]) | (shard[1:] != shard[:-1])
            h, node, size, salt, shard = (x[new] for x in (h, node, size, salt, shard))
            cut = np.flatnonzero(np.concatenate([[True], (shard[1:] != shard[:-1]) | (salt[1:] != salt[:-1])]))
            ends = np.append(cut[1:], len(h))
            packed = lambda x, **o: pa.array([pack(x[a:b], **o) for a, b in zip(cut, ends, strict=True)], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(shard[cut]), pa.array(salt[cut].astype(np.int64)), packed(h, ascending=True), packed(node), packed(size)], ["shard", "piece", "cells", "nodes", "sizes"])

        held, n = [], 0
        for batch in batches:
            for texts in blocks(batch.column(0), 1 << 20):
                sets, at = shingle_sets(texts, shingle)
                size = np.diff(at)
                owner = np.repeat(np.arange(len(size)), size)
                rank, split = np.zeros(len(sets), np.int64), np.ones(len(sets), np.int64)
                if len(hashes):
                    place = np.minimum(np.searchsorted(hashes, sets), len(hashes) - 1)
                    known = hashes[place] == sets
                    rank, split = np.where(known, counts[place], 0), np.where(known, pieces[place], 1)
                order = np.lexsort((sets, rank, owner))
                length = _prefix(size, least)
                pick = order[ragged(at[:-1], length)]
                who = owner[pick]
                early = ragged(np.zeros(len(size), np.int64), length) < _prefix(size, first)[who]
                node = _nodes(sets, at)[who]
                salt = np.where(split[pick] > 1, 1 + (mix(node.view(np.uint64)) % np.maximum(split[pick], 1).astype(np.uint64)).astype(np.int64), 0)
                held.append((sets[pick], node, (2 * size[who] + early).astype(np.uint32), salt.astype(np.uint64)))
                n += len(pick)
                if n >= HELD:
                    yield out(held)
                    held, n = [], 0
        if n:
            yield out(held)

    def join(part: pd.DataFrame) -> pd.DataFrame:
        cells, anchors, nodes = [], [], []
        for piece, own in part.groupby("piece"):
            h, node, size = (np.concatenate([unpack(x) for x in own[c]]) for c in ("cells", "nodes", "sizes"))
            n, early = (size >> 1).astype(np.int64), (size & 1).astype(bool)
            order = np.lexsort((node, n, h))
            h, node, n, early = h[order], node[order], n[order], early[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (node[1:] != node[:-1])
            h, node, n, early = h[new], node[new], n[new], early[new]
            same = h[1:] == h[:-1]
            if not piece:
                # A node stays if it is an early one with a larger (or equal) one of the cell near in size, or the other of such two.
                after = np.append(same & (n[1:] * p <= n[:-1] * q), False) & early
                begin = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), np.arange(len(h)), 0))
                last = np.concatenate([[-1], np.maximum.accumulate(np.where(early, np.arange(len(h)), -1))[:-1]])
                keep = after | (last >= begin) & (n * p <= n[np.maximum(last, 0)] * q)
                h, node, n = h[keep], node[keep], n[keep]
                same = (h[1:] == h[:-1]) & (n[1:] * p <= n[:-1] * q)
            if not len(h):
                continue
            starts = np.flatnonzero(np.concatenate([[True], ~same]))
            anchor = np.repeat(np.minimum.reduceat(node, starts), np.diff(np.append(starts, len(h))))
            if piece:
                cells.append(h.view(np.int64))
            else:
                order = np.lexsort((node, anchor))
                anchor, node = anchor[order], node[order]
                new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (node[1:] != node[:-1])])
                anchor, node = anchor[new], node[new]
                cells.append(np.zeros(len(node), np.int64))
            anchors.append(anchor)
            nodes.append(node)
        release()
        none = [np.zeros(0, np.int64)]
        return pd.DataFrame({"cell": np.concatenate(cells or none), "anchor": np.concatenate(anchors or none), "node": np.concatenate(nodes or none)})

    dealt = docs.select("text").mapInArrow(tidy(deal), "shard int, piece long, cells binary, nodes binary, sizes binary")
    # The pieces of a common shingle's cell (0: any other) have anchors of their own; the least of them is the cell's.
    found = stored(dealt.groupBy("shard").applyInPandas(join, "cell long, anchor long, node long"), "cells")
    pieces = found.where("cell <> 0")
    least_of = pieces.groupBy("cell").agg(F.min("anchor").alias("least"))
    whole = pieces.join(least_of, "cell").select(F.col("least").alias("anchor"), "node")
    return found.where("cell = 0").select("anchor", "node").unionByName(whole).distinct()


def _forest(n: np.ndarray, sketches: list[bytes], component: np.ndarray, least: Fraction) -> list[tuple[int, int]]:
    """Pairs of places, ascending in n, that connect what passes the bounds of sizes and fingerprints and isn't in one component."""
    p, q = least.numerator, least.denominator
    bits, label = _bits(n), np.arange(len(n))
    level: dict[int, tuple[int, np.ndarray]] = {}
    for m in np.unique(bits).tolist():
        a, b, c = np.searchsorted(bits, [m, m + 1, 2 * m + 1])
        rows = np.frombuffer(b"".join(sketches[a:b]), np.uint64).reshape(b - a, -1)
        if c > b:
            wide = np.frombuffer(b"".join(sketches[b:c]), np.uint64).reshape(c - b, 2, -1)
            rows = np.concatenate([rows, wide[:, 0] ^ wide[:, 1]])
        level[m] = a, rows
    edges, reach = [], np.searchsorted(n, n * q // p, "right")
    for i in range(len(n) - 1):
        j = i + 1 + np.flatnonzero((label[i + 1 : reach[i]] != label[i]) & (component[i + 1 : reach[i]] != component[i]))
        if not len(j):
            continue
        start, rows = level[int(bits[i])]
        # The sets differ in (q - p) / (q + p) of both sizes at most.
        near = j[np.bitwise_count(rows[j - start] ^ rows[i - start]).sum(1, dtype=np.int64) * (q + p) <= (q - p) * (n[i] + n[j])]
        if len(near):
            labels, at = np.unique(label[near], return_index=True)
            edges += [(i, int(j)) for j in near[at]]
            label[np.isin(label, labels)] = label[i]
            if (label == label[i]).all():
                break
    return edges


def _candidates(groups: DataFrame, known: DataFrame, least: Fraction, shards: int) -> DataFrame:
    """``(anchor, a, b)``: pairs that connect what is near in each part of a group (anchor, i, j, node, label)."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["anchor", "i", "j", "n", "node"], ignore_index=True)
        keys, n, label, node = part[["anchor", "i", "j"]].to_numpy(), part["n"].to_numpy(), part["label"].to_numpy(), part["node"].to_numpy()
        cut = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)]))
        sketches, out = part["sketch"].tolist(), []
        for a, b in zip(cut.tolist(), np.append(cut[1:], len(n)).tolist(), strict=True):
            out += [(keys[a, 0], node[a + x], node[a + y]) for x, y in _forest(n[a:b], sketches[a:b], label[a:b], least)]
        release()
        return pd.DataFrame(np.array(out, np.int64).reshape(-1, 3), columns=["anchor", "a", "b"])

    dealt = groups.join(known, "node").withColumn("shard", F.pmod(F.xxhash64("anchor", "i", "j"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(run, "anchor long, a long, b long")


def _labelled(groups: DataFrame, roots: DataFrame) -> DataFrame:
    """``groups`` with the component (label) of each node."""
    return groups.join(roots, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")


def _slices(groups: DataFrame) -> DataFrame:
    """Groups in slices of about GROUP nodes, each with its anchor; and how many there are."""
    sizes = groups.groupBy("anchor").count().where(F.col("count") > GROUP).select("anchor", F.ceil(F.col("count") / GROUP).cast("int").alias("parts"))
    sizes = stored(sizes, "large")
    own = groups.join(sizes, "anchor", "left").select("anchor", "node", F.coalesce(F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"), F.lit(0)).alias("i"))
    hubs = sizes.select("anchor", F.col("anchor").alias("node"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"))
    return own.unionByName(hubs).distinct().select("anchor", "i", F.lit(0).alias("j"), "node"), sizes


def _unsettled(groups: DataFrame, anchors: DataFrame, roots: DataFrame) -> DataFrame:
    """The parts of ``anchors``' groups in which nodes of different components (node, root) meet, each two of them in one part at least."""
    own = stored(_labelled(groups.join(anchors, "anchor", "left_semi"), roots), "unsettled")
    of = own.groupBy("anchor", "label").count().groupBy("anchor").agg(F.sum("count").alias("all"), F.max_by("label", F.struct("count", "label")).alias("main"), F.max("count").alias("most"))
    share = lambda n: F.greatest(F.lit(1), F.ceil(n / GROUP)).cast("int")
    of = of.where(F.col("all") > F.col("most")).select("anchor", "main", share(F.col("all")).alias("parts"), share(F.col("all") - F.col("most")).alias("others"))
    own = own.join(of, "anchor")
    up_to = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    everyone = own.select("anchor", "node", "label", place("parts").alias("i"), F.explode(up_to("others")).alias("j"))
    minor = own.where("label <> main").select("anchor", "node", "label", F.explode(up_to("parts")).alias("i"), place("others").alias("j"))
    return everyone.unionByName(minor).distinct().select("anchor", "i", "j", "node", "label")


def _texts(docs: DataFrame, described: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, packed)``: one document's text for each node, compressed."""

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([codec.compress((x or "").encode()) for x in batch.column(1).to_pylist()], pa.binary())], ["node", "packed"])

    first = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "text_hash")).alias("first")
    rows = described.select("doc_id", "text_hash", "node").join(nodes, "node").groupBy("node").agg(first).select("node", "first.doc_id", "first.text_hash").alias("r")
    own = docs.withColumn("text_hash", F.xxhash64("text")).alias("d")
    found = own.join(rows, (F.col("d.text_hash") == F.col("r.text_hash")) & F.col("d.doc_id").eqNullSafe(F.col("r.doc_id"))).select("node", "text")
    return found.mapInArrow(tidy(squeeze), "node long, packed binary").dropDuplicates(["node"])


def _confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, least: Fraction) -> DataFrame:
    """The pairs (a, b) of nodes whose texts are similar."""
    p, q = least.numerator, least.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = zstandard.ZstdDecompressor()

        def sets_of(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            raw = [codec.decompress(x) for x in packed]
            texts = Texts(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64), 0)
            sets, at = shingle_sets(texts, shingle)
            return sets, np.repeat(np.arange(len(raw)), np.diff(at))

        for batch in batches:
            right = []
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                (left, who), (other, whose) = (sets_of(part.column(c).to_pylist()) for c in (2, 3))
                h, owner = np.concatenate([left, other]), np.concatenate([who, whose])
                order = np.lexsort((h, owner))
                h, owner = h[order], owner[order]
                both = np.bincount(owner[1:][(h[1:] == h[:-1]) & (owner[1:] == owner[:-1])], minlength=part.num_rows)
                right.append(both * q >= p * (np.bincount(owner, minlength=part.num_rows) - both))
            keep = pa.array(np.concatenate(right) if right else np.zeros(0, bool))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in (0, 1)], ["a", "b"])

    # The hubs' texts (a) are joined last, so they are not dealt out with every pair.
    rows = pairs.join(texts.select(F.col("node").alias("b"), F.col("packed").alias("of_b")), "b")
    rows = rows.join(texts.select(F.col("node").alias("a"), F.col("packed").alias("of_a")), "a")
    return rows.select("a", "b", "of_a", "of_b").mapInArrow(tidy(run), "a long, b long")


def _similar(sets: list[np.ndarray], left: np.ndarray, least: Fraction) -> list[tuple[int, int]]:
    """A forest of the pairs that are similar, of which one at least is in ``left``."""
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, name = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(name, kind="stable")
    having, starts = owner[order], np.searchsorted(name[order], np.arange(name.max() + 2))
    ends = np.cumsum(size)
    forest = Forest(len(sets))
    for i in left.tolist():
        own = name[ends[i] - size[i] : ends[i]]
        shared = np.bincount(having[ragged(starts[own], starts[own + 1] - starts[own])], minlength=len(sets))
        for j in np.flatnonzero(shared * least.denominator >= least.numerator * (size + size[i] - shared)).tolist():
            if j != i:
                forest.join(i, j)
    return forest.edges


def _compared(texts: DataFrame, clusters: DataFrame, shingle: int, least: Fraction, shards: int) -> DataFrame:
    """Edges ``(a, b)`` that connect the nodes of a cluster (node, root) whose texts are similar, of all its pairs."""

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        codec, out = zstandard.ZstdDecompressor(), []
        for (_, i, j), own in part.groupby(["root", "i", "j"]):
            nodes = own["node"].to_numpy()
            left = np.flatnonzero(own["chunk"].to_numpy() == i) if i != j else np.arange(len(own))
            sets = [shingle_sets(next(blocks(pa.array([codec.decompress(x).decode()]))), shingle)[0] for x in own["packed"]]
            out += [(nodes[a], nodes[b]) for a, b in _similar(sets, left, least)]
        release()
        return pd.DataFrame(np.array(out, np.int64).reshape(-1, 2), columns=["a", "b"])

    parts = F.ceil(F.col("count") / CHUNK).cast("int")
    sizes = clusters.groupBy("root").count().select("root", parts.alias("parts"))
    sets = texts.join(clusters.join(sizes, "root"), "node")
    chunk = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    dealt = sets.withColumn("chunk", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.withColumn("i", F.least("chunk", "other")).withColumn("j", F.greatest("chunk", "other"))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("root", "i", "j"), F.lit(shards)))
    return dealt.select("shard", "root", "i", "j", "chunk", "node", "packed").groupBy("shard").applyInPandas(compare, "a long, b long")


def _nodes_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def near_copies(docs: DataFrame, least: float = 0.8, shingle: int = 5, distance: int = 4) -> DataFrame:
    """``(doc_id, text_hash, root, component_id, component_hash)`` of every document (doc_id, text).

    ``component_id`` and ``component_hash`` name the document with the least id (of equal
    ids, the least ``text_hash``) that chains of similar texts reach; they are null where no
    document with an id is reached. ``distance`` is that of the SimHash links; it decides by
    which way a pair is found, not which pairs are.
    """
    if not 0.5 <= least <= 1 or shingle < 1:
        raise ValueError("least must be from 0.5 to 1, shingle 1 or more")
    share = Fraction(str(least))
    docs, shards = docs.select("doc_id", "text"), shards_for(docs)
    described = stored(_described(docs, shingle), "described")
    linked = stored(_linked(described, distance, shards), "linked")
    near = stored(_confirmed(linked, stored(_texts(docs, described, _nodes_of(linked)), "texts"), shingle, share), "near")
    groups = stored(_groups(docs, shingle, share, shards), "groups")
    known = described.join(groups.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    known = stored(known, "sketches")
    slices, large = _slices(groups)
    found = stored(_candidates(_labelled(slices, components(near)), known, share, shards), "candidates")
    pairs = stored(found.select("a", "b").distinct(), "pairs")
    edges = stored(_confirmed(pairs, stored(_texts(docs, described, _nodes_of(pairs)), "texts"), shingle, share), "confirmed").unionByName(near)
    # A forest with a pair that isn't similar may have taken the place of pairs that are; slices don't meet each other.
    again = stored(found.join(edges, ["a", "b"], "left_anti").select("anchor").unionByName(large.select("anchor")).distinct(), "again")
    if not again.isEmpty():
        rest = stored(_candidates(_unsettled(groups, again, components(edges)), known, share, shards), "rest")
        tied = components(rest.select("a", "b"))
        clusters = stored(tied.unionByName(tied.select(F.col("root").alias("node"), "root").distinct()), "clusters")
        texts = stored(_texts(docs, described, clusters.select("node")), "texts")
        edges = edges.unionByName(_compared(texts, clusters, shingle, share, shards))
    placed = described.select("doc_id", "text_hash", "node").join(components(edges), "node", "left")
    placed = stored(placed.select("doc_id", "text_hash", F.coalesce("root", "node").alias("root")), "placed")
    firsts = placed.where("doc_id is not null").groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    return placed.join(firsts, "root", "left").select("doc_id", "text_hash", "root", F.col("first.doc_id").alias("component_id"), F.col("first.text_hash").alias("component_hash"))
