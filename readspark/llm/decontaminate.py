"""Benchmark decontamination by a generalised suffix automaton of the test items.

Method: the items' normalised words (lower-cased A-Z; letters, digits and all characters
beyond ASCII) go into one suffix automaton over word numbers. A document's words are
streamed through it; the automaton's state and match length say at each word how long
the longest stretch ending there is that some item holds. Where that reaches a window
(``window`` words, or the whole of a shorter item), the window is looked up by its
bytes, so a hit is exact. Runs of words that no item has are skipped in arrays.

The automaton is sent to all executors, at most ``shard_words`` words of items at once:
a benchmark beyond that is dealt with in several passes, whose results are joined.

Defined cases: a null text has no words; an item without words has no window; items with
a null ``item_id`` are left out; rows with a repeated ``item_id`` are one item; rows with
a null or repeated ``doc_id`` are each judged; other columns are not read; an empty
benchmark hits nothing; an empty document table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from ._shared import free_name, quoted, stored
from ._text import LOWER, Texts, blocks, span_hashes, tidy, words

Search = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
#: Bytes that no word has (after lower-casing).
BETWEEN = np.zeros(256, bool)
BETWEEN[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True


def lowered(texts: Texts) -> Texts:
    return Texts(LOWER[texts.data], texts.offsets, texts.first)


class SuffixAutomaton:
    """All stretches of a set of sequences of whole numbers."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _copy(self, p: int, q: int, symbol: int) -> int:
        clone = len(self.length)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, sequence: list[int]) -> None:
        last = 0
        for symbol in sequence:
            q = self.next[last].get(symbol)
            if q is not None:  # known from an earlier sequence
                last = q if self.length[q] == self.length[last] + 1 else self._copy(last, q, symbol)
                continue
            new = len(self.length)
            self.next.append({})
            self.link.append(0)
            self.length.append(self.length[last] + 1)
            p = last
            while p >= 0 and symbol not in self.next[p]:
                self.next[p][symbol] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][symbol]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._copy(p, q, symbol)
            last = new

    def lengths(self, sequence: list[int]) -> list[int]:
        """Of the longest known stretch that ends at each place."""
        out, state, n = [], 0, 0
        for symbol in sequence:
            while state and symbol not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if (to := self.next[state].get(symbol)) is not None:
                state, n = to, n + 1
            out.append(n)
        return out


class Items:
    """The windows of some test items, and the automaton that finds where they can be."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int) -> None:
        self.windows: dict[bytes, set[str]] = {}
        numbers: dict[bytes, int] = {}
        self.automaton = SuffixAutomaton()
        self.sizes = set()
        for item, w in items:
            size = min(window, len(w))
            if not size:
                continue
            self.sizes.add(size)
            for i in range(len(w) - size + 1):
                self.windows.setdefault(b" ".join(w[i : i + size]), set()).add(item)
            self.automaton.add([numbers.setdefault(x, len(numbers)) for x in w])
        raw = b"".join(numbers)
        ends = np.cumsum([len(x) for x in numbers], dtype=np.int64)
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        hashes = span_hashes(np.frombuffer(raw, np.uint8), starts, ends) if len(ends) else np.zeros(0, np.uint64)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The word numbers of hashes, or -1."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[place] == hashes, self.order[place], -1)

    def search(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[set[str]]]:
        """Hit flags, starts, ends and offsets of the words of lower-cased texts, and the items found in each text."""
        w = words(texts, BETWEEN)
        hit, found = np.zeros(len(w.starts), bool), [set() for _ in range(len(texts))]
        if self.sizes and len(w.starts):
            numbers = self.numbers(span_hashes(w.data, w.starts, w.ends))
            owner = w.owner()
            inside = numbers >= 0
            same = np.concatenate([[False], inside[1:] & inside[:-1] & (owner[1:] == owner[:-1])])
            begins = np.flatnonzero(inside & ~same)
            stops = np.flatnonzero(inside & ~np.append(same[1:], False)) + 1
            long = stops - begins >= min(self.sizes)
            for a, b in zip(begins[long].tolist(), stops[long].tolist(), strict=True):
                for i, n in enumerate(self.automaton.lengths(numbers[a:b].tolist()), a + 1):
                    for size in self.sizes:
                        if n >= size:
                            first = i - size
                            window = b" ".join([w.data[s:e].tobytes() for s, e in zip(w.starts[first:i], w.ends[first:i], strict=True)])
                            if (items := self.windows.get(window)) is not None:
                                hit[first:i] = True
                                found[owner[first]] |= items
        return hit, w.starts, w.ends, w.offsets, found


def _shards(benchmark: DataFrame, window: int, shard_words: int, item_column: str, text_column: str) -> Iterator[Items]:
    """The items, read one after the other, in groups of bounded size."""
    held: list[tuple[str, list[bytes]]] = []
    n, any_yet = 0, False
    for row in benchmark.where(F.col(item_column).isNotNull()).select(F.col(item_column).cast("string"), text_column).toLocalIterator():
        texts = lowered(next(blocks(pa.array([row[1] or ""]))))
        w = words(texts, BETWEEN)
        raw = texts.data.tobytes()
        held.append((row[0], [raw[a:b] for a, b in zip(w.starts, w.ends, strict=True)]))
        n += len(w.starts)
        if n >= shard_words:
            yield Items(held, window)
            held, n, any_yet = [], 0, True
    if held or not any_yet:
        yield Items(held, window)


def _searches(benchmark: DataFrame, window: int, shard_words: int, item_column: str, text_column: str) -> Iterator[Search]:
    """For each group of items a function over batches (doc_id, text) that adds what it finds."""
    for items in _shards(benchmark, window, shard_words, item_column, text_column):
        sent = benchmark.sparkSession.sparkContext.broadcast(pickle.dumps(items, pickle.HIGHEST_PROTOCOL))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = pickle.loads(sent.value)
            for batch in batches:
                n_words, n_hit, spans, names = [], [], [], []
                for texts in blocks(batch.column(1)):
                    hit, starts, ends, offsets, found = items.search(lowered(texts))
                    sums = np.concatenate([[0], np.cumsum(hit)])
                    n_words += np.diff(offsets).tolist()
                    counts = (sums[offsets[1:]] - sums[offsets[:-1]]).tolist()
                    n_hit += counts
                    names += [sorted(x) for x in found]
                    for i, n in enumerate(counts):
                        own = []
                        if n:
                            at = offsets[i] + np.flatnonzero(hit[offsets[i] : offsets[i + 1]])
                            breaks = np.flatnonzero(np.diff(at) > 1)
                            first, last = np.concatenate([at[:1], at[breaks + 1]]), np.concatenate([at[breaks], at[-1:]])
                            own = np.stack([starts[first] - texts.offsets[i], ends[last] - texts.offsets[i]], 1).tolist()
                        spans.append(own)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(n_hit, pa.int64()), pa.array(names, pa.list_(pa.string()))], ["doc_id", "text", "n_words", "spans", "n_hit", "items"])

        yield run


def _known_by(docs: DataFrame, id_column: str, text_column: str) -> tuple[DataFrame, StructType]:
    """``docs`` as (doc_id, text), and the columns of what a search finds in them."""
    ids = docs.select(F.col(quoted(id_column)).alias("doc_id"), F.col(quoted(text_column)).alias("text"))
    return ids, StructType([*ids.schema.fields]).add("n_words", "long").add("spans", ArrayType(ArrayType(LongType()))).add("n_hit", "long").add("items", ArrayType(StringType()))


def find_items(docs: DataFrame, benchmark: DataFrame, window: int = 8, shard_words: int = 2_000_000, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id") -> DataFrame:
    """``(doc_id, text, n_words, spans, n_hit, items)`` of every document.

    ``spans`` are pairs of byte places between which all words are hit; ``items`` the
    ids, sorted as strings, of the items with a window in the document.
    """
    ids, schema = _known_by(docs, id_column, text_column)
    return _found(ids, schema, list(_searches(benchmark, window, shard_words, item_column, text_column)))


def _found(ids: DataFrame, schema: StructType, searches: list[Search]) -> DataFrame:
    passes = [ids.mapInArrow(tidy(run), schema) for run in searches]
    if len(passes) == 1:
        return passes[0]
    return _together(passes, schema)


def _together(passes: list[DataFrame], schema: StructType) -> DataFrame:
    """The union of what several passes over the same documents found in each."""
    own = ["doc_id", "text"]
    rows = stored(passes[0].select(*own, "n_words", F.lit(1).alias("copies"), "spans", "items"), "pass")
    for more in passes[1:]:
        rows = rows.unionByName(stored(more.where("n_hit > 0").select(*own, "n_words", F.lit(0).alias("copies"), "spans", "items"), "pass"))
    merged = rows.groupBy(*own).agg(F.max("n_words").alias("n_words"), F.sum("copies").alias("copies"), F.flatten(F.collect_set("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, n_hit = [], []
            for text, all_spans in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                raw = (text or "").encode()
                marked = np.zeros(len(raw) + 1, bool)
                for a, b in all_spans:
                    marked[a:b] = True
                w = words(lowered(next(blocks(pa.array([text or ""])))), BETWEEN)
                hit = marked[w.starts] if len(w.starts) else np.zeros(0, bool)
                n_hit.append(int(hit.sum()))
                edges = np.flatnonzero(np.diff(np.concatenate([[False], marked, [False]])))
                spans.append([list(map(int, x)) for x in edges.reshape(-1, 2)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(n_hit, pa.int64()), batch.column(4)], ["doc_id", "text", "n_words", "spans", "n_hit", "items"])

    merged = merged.withColumn("copies", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return merged.select(*own, "n_words", "spans", "items").mapInArrow(tidy(run), schema)


def items_digest(items: Column) -> Column:
    return F.sha2(F.array_join(items, ",").cast("binary"), 256)


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = 8, most_coverage: float = 0.5, shard_words: int = 2_000_000, text_column: str = "text", item_column: str = "item_id") -> DataFrame:
    """``docs`` with the hit spans cut out of their texts; a document hit in more than ``most_coverage`` of its words goes.

    All columns of ``docs`` stay as they are, but for the text. Items that fit one search
    are searched and cut by the same Python worker.
    """
    row = free_name(docs, "row")
    packed = docs.withColumn(row, F.struct(*[F.col(quoted(c)).alias(c) for c in docs.columns]))
    ids, schema = _known_by(packed, row, text_column)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_hit = (batch.column(k).to_numpy() for k in (2, 4))
            batch = batch.filter(pa.array(n_hit <= n_words * most_coverage))
            texts, spans = batch.column(1), batch.column(3).to_pylist()
            if any(spans):
                out = texts.to_pylist()
                for k, own in enumerate(spans):
                    if own:
                        raw = out[k].encode()
                        keep = [0, *[x for span in own for x in span], len(raw)]
                        out[k] = b"".join(raw[a:b] for a, b in list(pairwise(keep))[::2]).decode()
                texts = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["row", "text"])

    after = StructType().add("row", packed.schema[row].dataType).add("text", "string")
    searches = list(_searches(benchmark, window, shard_words, item_column, text_column))
    if len(searches) == 1:
        kept = ids.mapInArrow(tidy(lambda batches: cut(searches[0](batches))), after)
    else:
        kept = _found(ids, schema, searches).mapInArrow(tidy(cut), after)
    return kept.select(*[F.col("text").alias(c) if c == text_column else F.col(f"row.{quoted(c)}").alias(c) for c in docs.columns])
