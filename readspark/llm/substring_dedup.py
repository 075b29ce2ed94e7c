"""Substring deduplication with a log-structured index of window hashes.

Method: every window of ``window`` words has a 64-bit hash and 16 more check bits. A task
writes the windows of its documents as sorted runs, one for each range of hashes (a
shard). A shard's task merge-joins the runs of the new batch with the shard's runs of
history, which are sorted immutable files in the shared folder that it alone reads, and
finds the least document that has each window. Windows that a smaller document (or any
document of history) has are sent back to their documents, where the words that they cover
go. The shard's distinct new windows are one more run of history. ``compact`` merges the
runs of each shard into one, and splits shards that have grown beyond ``shard_windows``.

``deduplicate`` takes a table in batches of ascending ids, so that history is what smaller
ids have, and removes what all batches found in one pass over the texts.

Equality is that of 80 bits (64 and the check bits, from independent mixes of two
hashes): at 10^13 windows about 40 pairs of different windows would agree by chance, at
10^10 none is expected.

Within its run, a task keeps only the least document of each window (with all places in it); the others are known
to repeat and go straight back to their documents. So a window that very many documents
have is one entry for each run, and a shard stays a bounded share of all windows.

Defined cases: a null text has no words; a text of fewer than ``window`` words has no
window; a very long text is handled whole, alone in its block; windows that repeat within
one document do not count against it, nor do those of other rows with the same ``doc_id``;
rows that repeat a ``doc_id`` are judged each by its own text; rows with a null ``doc_id``
are kept whole and count for nobody; other columns are not read; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from ._codec import pack, unpack
from ._shared import file_system, new_path, quoted, shards_for, stored
from ._text import Texts, Words, blocks, mix, ragged, release, span_hashes, tidy, words

#: Windows that a task gathers before it writes runs.
RUN_WINDOWS = 1_500_000
RUN = "shard int, bucket int, hashes binary, checks binary, docs binary, keys binary, places binary, path string"
MERGED = "shard int, bucket int, docs binary, keys binary, places binary, path string, windows long"


def window_hashes(w: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, check bits and first word of each window."""
    per = np.maximum(w.counts() - window + 1, 0)
    first = ragged(w.offsets[:-1], per)
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint16), first
    words_h = span_hashes(w.data, w.starts, w.ends)
    h = np.zeros(len(words_h) - window + 1, np.uint64)
    c = h.copy()
    for j in range(window):
        part = words_h[j : len(words_h) - window + 1 + j]
        h = h * np.uint64(0x9E3779B97F4A7C15) + part
        c = c * np.uint64(0xC2B2AE3D27D4EB4F) + (part ^ part >> np.uint64(29))
    return mix(h[first]), (mix(c[first]) >> np.uint64(48)).astype(np.uint16), first


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Equal ranges of hashes, so that sorted hashes have sorted shards."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)


def _bucket(docs: np.ndarray, keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(docs.view(np.uint64) ^ mix(keys.view(np.uint64))) % np.uint64(buckets)).astype(np.int32)


def _removals(docs: np.ndarray, keys: np.ndarray, places: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """Bucket, documents, their keys and first words of windows to remove."""
    b = _bucket(docs, keys, buckets)
    order = np.lexsort((places, keys, docs, b))
    docs, keys, places, b = docs[order], keys[order], places[order], b[order]
    at = np.searchsorted(b, np.arange(buckets + 1))
    for k in np.flatnonzero(np.diff(at)):
        own = slice(at[k], at[k + 1])
        yield int(k), pack(docs[own], ascending=True), pack(keys[own]), pack(places[own])


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text and others) with a ``key``, zero but for rows that repeat a ``doc_id``: there a hash of the text tells them apart."""
    repeated = stored(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit(True).alias("_repeated")), "repeated-ids")
    if repeated.isEmpty():
        return docs.withColumn("key", F.lit(0).cast("long"))
    return docs.join(repeated, "doc_id", "left").withColumn("key", F.when(F.col("_repeated"), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))).drop("_repeated")


def runs(docs: DataFrame, window: int, shards: int, buckets: int) -> DataFrame:
    """Sorted runs of the windows of ``docs`` (doc_id, key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        n = 0

        def sort_out() -> pa.RecordBatch:
            hashes, checks, docs, keys, places = map(np.concatenate, zip(*held, strict=True))
            order = np.argsort(hashes, kind="stable")
            hashes, checks, docs, keys, places = hashes[order], checks[order], docs[order], keys[order], places[order]
            equal = hashes[1:] == hashes[:-1]
            twice = np.flatnonzero(np.concatenate([[False], equal]) | np.concatenate([equal, [False]]))
            twice = twice[np.lexsort((docs[twice], checks[twice], hashes[twice]))]
            again = np.concatenate([[False], (hashes[twice][1:] == hashes[twice][:-1]) & (checks[twice][1:] == checks[twice][:-1])]) if len(twice) else np.zeros(0, bool)
            least = np.maximum.accumulate(np.where(again, 0, np.arange(len(twice)))) if len(twice) else twice
            more = twice[docs[twice] > docs[twice][least]]
            rows = [(k % shards, k, None, None, d, i, p, None) for k, d, i, p in _removals(docs[more], keys[more], places[more], buckets)]
            keep = np.ones(len(hashes), bool)
            keep[more] = False
            hashes, checks, docs, keys, places = hashes[keep], checks[keep], docs[keep], keys[keep], places[keep]
            at = np.searchsorted(shard_of(hashes, shards), np.arange(shards + 1))
            for k in np.flatnonzero(np.diff(at)):
                own = slice(at[k], at[k + 1])
                rows.append((int(k), None, pack(hashes[own], ascending=True), pack(checks[own]), pack(docs[own]), pack(keys[own]), pack(places[own]), None))
            kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5, pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["shard", "bucket", "hashes", "checks", "docs", "keys", "places", "path"])

        for batch in batches:
            ids, row_keys = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            for texts in blocks(batch.column(2)):
                w = words(texts)
                hashes, checks, first = window_hashes(w, window)
                if not len(hashes):
                    continue
                owner = w.owner()[first]
                held.append((hashes, checks, ids[texts.first + owner], row_keys[texts.first + owner], (first - w.offsets[owner]).astype(np.uint32)))
                n += len(hashes)
                if n >= RUN_WINDOWS:
                    yield sort_out()
                    held, n = [], 0
        if n:
            yield sort_out()

    return docs.where("doc_id is not null").select("doc_id", "key", "text").mapInArrow(tidy(run), RUN)


def write_run(folder: str, shard: int, hashes: np.ndarray, checks: np.ndarray) -> tuple[str, int]:
    """A sorted run as a file that no two attempts of a task share; its path, and its windows."""
    fs, path = file_system(folder)
    fs.create_dir(path, recursive=True)
    name, first = f"{shard}-{uuid.uuid4().hex}.run", pack(hashes, ascending=True)
    with fs.open_output_stream(f"{path}/{name}", compression=None) as f:
        f.write(struct.pack("<Q", len(first)) + first + pack(checks))
    return f"{folder}/{name}", len(hashes)


def read_run(uri: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, and check bits of a run."""
    fs, path = file_system(uri)
    with fs.open_input_stream(path, compression=None) as f:
        raw = f.read()
    cut = 8 + struct.unpack_from("<Q", raw)[0]
    return unpack(raw[8:cut]), unpack(raw[cut:])


def _merge(part: pd.DataFrame, shard: int, buckets: int, folder: str | None) -> Iterator[tuple]:
    """Rows of the two kinds: what to remove, by bucket of documents; and the shard's new run."""
    through = part[part["bucket"].notna()]
    if len(through):  # one row for each bucket, however many tasks sent some
        docs, keys, places = (np.concatenate([unpack(x) for x in through[c]]) for c in ("docs", "keys", "places"))
        for k, d, i, p in _removals(docs, keys, places, buckets):
            yield k, d, i, p, None, None
    fresh, history = part[part["hashes"].notna()], part["path"].dropna()
    if not len(fresh):
        return
    hashes, checks, docs, keys, places = (np.concatenate([unpack(x) for x in fresh[c]]) for c in ("hashes", "checks", "docs", "keys", "places"))
    order = np.lexsort((docs, checks, hashes))
    hashes, checks, docs, keys, places = hashes[order], checks[order], docs[order], keys[order], places[order]
    begins = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (checks[1:] != checks[:-1])])
    starts, group = np.flatnonzero(begins), np.cumsum(begins) - 1
    own, own_checks = hashes[starts], checks[starts]
    known = np.zeros(len(starts), bool)
    for path in history:
        h, c = read_run(path)
        lo, hi = np.searchsorted(h, own), np.searchsorted(h, own, "right")
        for step in range(int((hi - lo).max(initial=0))):  # equal hashes with other check bits are rare
            at = np.minimum(lo + step, max(len(h) - 1, 0))
            known |= (lo + step < hi) & (c[at] == own_checks)
    gone = (docs > docs[starts][group]) | known[group]
    for k, d, i, p in _removals(docs[gone], keys[gone], places[gone], buckets):
        yield k, d, i, p, None, None
    if folder is not None and not known.all():
        yield None, None, None, None, *write_run(folder, shard, own[~known], own_checks[~known])


def find_repeats(docs: DataFrame, window: int, shards: int, buckets: int, history: DataFrame | None = None, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """What to remove from a batch, packed by buckets; and its own runs ``(shard, path, windows)`` if there is a ``folder`` for them.

    ``history``: runs ``(shard, path)`` of what came before.
    """
    dealt = runs(docs, window, shards, buckets)
    if history is not None:
        empty = {f.split()[0]: F.lit(None).cast(f.split()[1]) for f in RUN.split(", ")}
        dealt = dealt.unionByName(history.select(*[(F.col(c) if c in ("shard", "path") else x).alias(c) for c, x in empty.items()]))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        shard = int(part["shard"].iloc[0])
        rows = list(_merge(part, shard, buckets, folder))
        out = pd.DataFrame(rows, columns=["bucket", "docs", "keys", "places", "path", "windows"])
        release()
        return out.assign(bucket=out["bucket"].astype("Int32"), windows=out["windows"].astype("Int64"), shard=shard)

    merged = stored(dealt.groupBy("shard").applyInPandas(run, MERGED), "repeats")
    return merged.where("bucket is not null").select("bucket", "docs", "keys", "places"), merged.where("path is not null").select("shard", "path", "windows")


def _covered(n: int, places: np.ndarray, window: int) -> np.ndarray:
    """Flags of the words in windows that start at ``places``."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, places, 1)
    np.add.at(edges, np.minimum(places + window, n), -1)
    return np.cumsum(edges[:n]) > 0


def _without(raw: bytes, window: int, places: np.ndarray) -> tuple[int, list[bytes], bytes]:
    """How many words ``raw`` has, those outside the windows, and the text of these with the white space behind each."""
    data = np.frombuffer(raw, np.uint8)
    w = words(Texts(data, np.array([0, len(raw)]), 0))
    keep = ~_covered(len(w.starts), places, window)
    flags = np.ones(len(raw), bool)
    flags[w.starts[0] :] = np.repeat(keep, np.diff(np.append(w.starts, len(raw))))
    return len(keep), [raw[a:b] for a, b in zip(w.starts[keep].tolist(), w.ends[keep].tolist(), strict=True)], data[flags].tobytes()


def _remove(base: DataFrame, repeats: DataFrame, buckets: int, window: int) -> DataFrame:
    """Rows (doc_id, key, text, row) without the windows of ``repeats``."""
    own = base.select("doc_id", "key", "row").schema
    dealt_schema = StructType([*own.fields]).add("bucket", "integer").add("text", "binary")
    result = StructType([own["row"], own["doc_id"]]).add("n_words", LongType()).add("n_removed", LongType()).add("kept_sha256", StringType()).add("text", StringType())

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts compressed before they are dealt out; a null ``doc_id`` goes anywhere."""
        codec = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids = np.arange(batch.num_rows, dtype=np.int64)
            if (there := np.flatnonzero(batch.column(0).is_valid().to_numpy(zero_copy_only=False))).size:
                ids[there] = batch.column(0).take(pa.array(there)).to_numpy(zero_copy_only=False)
            keys = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            texts = pa.array([None if x is None else codec.compress(x.encode()) for x in batch.column(3).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(_bucket(ids, keys, buckets)), texts], ["doc_id", "key", "row", "bucket", "text"])

    def clean(part: pa.Table, gone: pa.Table) -> pa.Table:
        docs, keys, places = (np.concatenate([np.zeros(0, t), *[unpack(x) for x in gone[c].to_pylist()]]) for c, t in (("docs", np.int64), ("keys", np.int64), ("places", np.uint32)))
        order = np.lexsort((keys, docs))
        docs, keys, places = docs[order], keys[order], places[order].astype(np.int64)
        codec, out = zstandard.ZstdDecompressor(), []
        for doc, key, packed in zip(part["doc_id"].to_pylist(), part["key"].to_pylist(), part["text"].to_pylist(), strict=True):
            raw = b"" if packed is None else codec.decompress(packed)
            text = None if packed is None else raw
            lo, hi = (0, 0) if doc is None else np.searchsorted(docs, [doc, doc + 1])
            a, b = lo + np.searchsorted(keys[lo:hi], key), lo + np.searchsorted(keys[lo:hi], key, "right")
            if a < b:
                n, kept, text = _without(raw, window, places[a:b])
            else:
                kept = raw.split()  # on ASCII white space, as for bytes
                n = len(kept)
            out.append((n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), None if text is None else text.decode()))
        release()
        columns = list(zip(*out, strict=True)) if out else [()] * 4
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
        arrays = [part["row"], part["doc_id"], *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]]
        return pa.table(arrays, ["row", "doc_id", "n_words", "n_removed", "kept_sha256", "text"])

    dealt = base.select("doc_id", "key", "row", "text").mapInArrow(tidy(squeeze), dealt_schema)
    return dealt.groupBy("bucket").cogroup(repeats.groupBy("bucket")).applyInArrow(clean, result)


def _rows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``(doc_id, text, row, key)``; ``row`` are the other columns."""
    others = [F.col(quoted(c)).alias(c) for c in docs.columns if c not in (id_column, text_column)]
    row = F.struct(*others) if others else F.struct(F.lit(1).alias("_"))
    return keyed(docs.select(F.col(quoted(id_column)).alias("doc_id"), F.col(quoted(text_column)).alias("text"), row.alias("row")))


class FingerprintIndex:
    """Runs of history in a folder: ``add`` deduplicates a batch against them and adds its runs.

    Beyond ``most_runs`` runs they are merged; beyond ``shard_windows`` windows in a shard,
    shards are split, so that a task's share stays bounded while history grows.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, window: int = 13, shards: int = 64, most_runs: int = 4, shard_windows: int = 20_000_000) -> None:
        self.spark, self.folder, self.window, self.shards = spark, folder or new_path(spark, "index"), window, shards
        self.buckets, self.most_runs, self.shard_windows = max(1, shards // 2), most_runs, shard_windows
        self.paths: list[str] = []  # of the tables that name the files of each run

    def history(self) -> DataFrame | None:
        """``(shard, path, windows)`` of all runs."""
        return self.spark.read.parquet(*self.paths) if self.paths else None

    def _named(self, run: DataFrame) -> str:
        path = f"{self.folder}/run-{uuid.uuid4().hex}"
        run.write.parquet(path)
        return path

    def find(self, docs: DataFrame, keep: bool = True) -> DataFrame:
        """What to remove from a batch (doc_id, key, text); its windows join history if ``keep``."""
        repeats, new = find_repeats(docs, self.window, self.shards, self.buckets, self.history(), self.folder if keep else None)
        if keep:
            self.paths.append(self._named(new))
            most = self.history().groupBy("shard").agg(F.sum("windows").alias("n")).agg(F.max("n")).first()[0] or 0
            if len(self.paths) > self.most_runs or most > self.shard_windows:
                self.compact(max(1, -(-most // self.shard_windows)))
        return repeats

    def add(self, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
        """``deduplicate`` of a batch, against its smaller ids and all of history."""
        base = _rows(docs, id_column, text_column)
        return stored(_remove(base, self.find(base), self.buckets, self.window), "batch")

    def compact(self, split: int = 1) -> None:
        """One run in place of all, in ``split`` times as many shards; the old ones stay until the new one is whole."""
        folder, shards = self.folder, self.shards * split

        def merge(part: pd.DataFrame) -> pd.DataFrame:
            hashes, checks = map(np.concatenate, zip(*[read_run(x) for x in part["path"]], strict=True))
            order = np.lexsort((checks, hashes))
            hashes, checks = hashes[order], checks[order]
            new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (checks[1:] != checks[:-1])])
            hashes, checks = hashes[new], checks[new]
            of = shard_of(hashes, shards)
            cut = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            rows = [(int(of[a]), *write_run(folder, int(of[a]), hashes[a:b], checks[a:b])) for a, b in zip(cut, np.append(cut[1:], len(of)), strict=True)]
            release()
            return pd.DataFrame(rows, columns=["shard", "path", "windows"])

        if self.paths and (split > 1 or len(self.paths) > 1):
            self.paths = [self._named(self.history().groupBy("shard").applyInPandas(merge, "shard int, path string, windows long"))]
            self.shards = shards


def deduplicate(docs: DataFrame, window: int = 13, batches: int = 2, shards: int | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(row, doc_id, n_words, n_removed, kept_sha256, text)`` of every row of ``docs``.

    ``row`` are the input's other columns; ``text`` is the input's, without the words that go
    (the white space behind a word goes with it). ``batches`` of about as many rows, by
    ascending id, go through an index of their own, each against the runs of those before.
    """
    base = _rows(docs, id_column, text_column)
    index = FingerprintIndex(docs.sparkSession, window=window, shards=int(shards or shards_for(docs, 16 << 20)))
    ids = base.select(F.col("doc_id").cast("double").alias("id"))
    borders = sorted({int(x) for x in ids.approxQuantile("id", [k / batches for k in range(1, batches)], 0.01)}) if batches > 1 else []
    repeats = None
    for k in range(len(borders) + 1):
        own = base
        if k:
            own = own.where(F.col("doc_id") > borders[k - 1])
        if k < len(borders):
            own = own.where(F.col("doc_id") <= borders[k])
        found = index.find(own, keep=k < len(borders))
        repeats = found if repeats is None else repeats.unionByName(found)
    return _remove(base, repeats, index.buckets, window)
