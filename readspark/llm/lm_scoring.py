"""Scoring texts with a smoothed n-gram model, as a weighted backoff automaton.

Method: the model is a word trigram, interpolated with a bigram as its prior, which is
interpolated with an add-one unigram by absolute discounting. Its automaton has a root,
a state for each word that was seen in training (and one for the start of a text), and a
state for each bigram seen. Arcs lead along the trigrams and bigrams seen, always to the
state of the longest context seen; a state without an arc for the next word takes its
failure arc, from a bigram to its second word and from a word to the root, each with the
weight that is left for words not seen there. The weight of a bigram that came n times is
prior / (n + prior): it needs no more than the bigram's own count. One traversal from
left to right carries the state and adds up log-probabilities; in arrays, all documents
of a block move on together.

Counts cover the whole corpus and no table of them is held in one place. Documents are
cut into blocks. A block sends each distinct bigram with its training count once, dealt
by context to shards; a shard sums over blocks and sends back, in the order received, the
sums that the block needs: the block's automaton is the part of the model that its own
texts can reach. Contexts that hold more than a share ``hot_share`` of a block are
candidates for heavy ones; at most ``1 / hot_share`` are, and their bigrams are dealt by
both words, with their totals summed apart. Trigrams are dealt by a hash of all three
words, so that no context gathers them.

Trigrams are known by their shard and 44 bits of a hash; a shard's share of the input is
bounded, so that two of its trigrams collide by chance only. Bigrams are known by 64 bits of the context's hash and 48 bits of the follower's; that
some of 10^9 followers of one context collide changes a count by chance only.

Defined cases: a null or empty text is the end token alone; rows with a null ``doc_id``
are scored and held out, as their remainder is unknown; rows with a repeated ``doc_id``
are texts of their own, in training too; without training rows every token has the same
probability; a very long text is scored whole, in one block, whose worker has to hold it;
nothing depends on ties; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._codec import pack, unpack
from ._shared import shards_for, stored
from ._text import LOWER, Texts, blocks, mix, release, span_hashes, tidy, words

BLOCK_TEXT = 8 << 20
#: Bytes of packed bigrams and trigrams that leave a worker at once.
SENT_BYTES = 1 << 20
PRIOR = 8.0  # of 0.5, 1, 2, 4, 8 and 32 the best for held-out texts of sf0.1
END, START = np.uint64(0x1F83D9ABFB41BD6B), np.uint64(0x5BE0CD19137E2179)
_44, _48 = np.uint64((1 << 44) - 1), np.uint64((1 << 48) - 1)


def held_out(id_column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 7 == 2, F.lit(True))


def tokenised(docs: DataFrame, held: Column, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Blocks of documents: ids, held-out flags, numbers of tokens, distinct word hashes and tokens as places in them."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[pa.Array] = []
        flags, counts, hashes, n = [], [], [], 0

        def block() -> pa.RecordBatch:
            vocab, tokens = np.unique(np.concatenate(hashes), return_inverse=True)
            all_ids = pa.concat_arrays(ids)
            values = pa.ListArray.from_arrays(pa.array([0, len(all_ids)], pa.int32()), all_ids)
            cells = [pack(np.concatenate(flags)), pack(np.concatenate(counts)), pack(vocab, ascending=True), pack(tokens.astype(np.uint32))]
            return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().int >> 65]), values, *[pa.array([c], pa.binary()) for c in cells]], ["block", "ids", "held", "counts", "vocab", "tokens"])

        for batch in batches:
            held_flags = batch.column(2).to_numpy(zero_copy_only=False).astype(np.uint8)
            for texts in blocks(batch.column(1)):
                w = words(Texts(LOWER[texts.data], texts.offsets, texts.first))
                n_words = w.counts()
                own = np.full(len(w.starts) + len(texts), END, np.uint64)
                body = np.ones(len(own), bool)
                body[np.cumsum(n_words + 1) - 1] = False
                own[body] = span_hashes(w.data, w.starts, w.ends)
                ids.append(batch.column(0).slice(texts.first, len(texts)))
                flags.append(held_flags[texts.first : texts.first + len(texts)])
                counts.append((n_words + 1).astype(np.uint32))
                hashes.append(own)
                n += len(texts.data)
                if n >= BLOCK_TEXT:
                    yield block()
                    ids, flags, counts, hashes, n = [], [], [], [], 0
        if ids:
            yield block()

    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(text_column, F.lit("")).alias("text"), held.alias("held"))
    return rows.mapInArrow(tidy(run), f"block long, ids array<{kind}>, held binary, counts binary, vocab binary, tokens binary")


def _begins(ordered: np.ndarray) -> np.ndarray:
    """Where each distinct value of an ordered array begins."""
    new = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    return np.flatnonzero(new)


def _numbered(begins: np.ndarray, length: int) -> np.ndarray:
    """For each place of an ordered array which distinct value is there."""
    return np.repeat(np.arange(len(begins), dtype=np.int32), np.diff(np.append(begins, length)))


class Block:
    """A block's tokens, and its distinct bigrams in the order in which shards get them."""

    def __init__(self, held: bytes, counts: bytes, vocab: bytes, tokens: bytes) -> None:
        self.held, self.counts = unpack(held).astype(bool), unpack(counts).astype(np.int64)
        words_h, self.tokens = unpack(vocab), unpack(tokens).astype(np.int32)
        self.start = len(words_h)  # the place of the start of a text
        self.hashes = np.append(words_h, START)
        self.ends = np.cumsum(self.counts)
        self.train = np.repeat(~self.held, self.counts)

    def previous(self) -> np.ndarray:
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[self.ends - self.counts] = self.start
        return before

    def hot(self, share: float) -> tuple[np.ndarray, np.ndarray]:
        """Contexts with a large share of the block's training tokens, and how many they have."""
        n = np.bincount(self.previous()[self.train], minlength=len(self.hashes))
        found = np.flatnonzero(n >= max(1, share * n.sum()))
        return self.hashes[found], n[found]

    def deal(self, heavy: np.ndarray, shards: int) -> None:
        """Sort the distinct bigrams by shard, context and follower, and the distinct trigrams by shard and hash."""
        # Arrays as long as the block are freed or narrowed as soon as they can be: they are most of a worker's memory.
        size = len(self.hashes)
        pair = self.previous().astype(np.int64)
        pair *= size
        pair += self.tokens
        order = np.argsort(pair)
        pair = pair[order]
        begins = _begins(pair)
        inverse = np.empty(len(order), np.int32)
        inverse[order] = _numbered(begins, len(order))
        del order
        pair = pair[begins]
        n = np.bincount(inverse[self.train], minlength=len(pair)).astype(np.int32)
        context, follower = (pair // size).astype(np.int32), (pair % size).astype(np.int32)
        del pair, begins
        h, f = self.hashes[context], mix(self.hashes[follower]) & _48
        shard = np.where(np.isin(h, heavy), mix(h ^ f), mix(h))
        shard = (shard % np.uint64(shards)).astype(np.int32)
        order = np.lexsort((f, h, shard)).astype(np.int32)
        self.bounds = np.searchsorted(shard[order], np.arange(shards + 1))
        del shard
        self.h, self.f = h[order], f[order]
        del h, f
        self.n, self.context, self.follower = n[order], context[order], follower[order]
        del n, context, follower
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        del order
        self.at = rank[inverse]  # the bigram that ends at each token
        del rank, inverse
        self._deal_trigrams(self.at, shards)

    def _deal_trigrams(self, at: np.ndarray, shards: int) -> None:
        """A trigram is two bigrams of ``at`` that overlap."""
        inner = np.ones(len(at), bool)
        inner[self.ends - self.counts] = False
        inner = np.flatnonzero(inner).astype(np.int32)
        place = mix(self.h ^ np.uint64(0x3C6EF372FE94F82B))[at[inner - 1]]
        place += (mix(self.h) * np.uint64(0xA54FF53A5F1D36F1) + self.f)[at[inner]]
        place = mix(place)
        shard = place >> np.uint64(44)
        shard %= np.uint64(shards)  # shards are 2^17 at most
        shard <<= np.uint64(44)
        place &= _44
        place |= shard
        del shard
        order = np.argsort(place).astype(np.int32)
        place = place[order]
        begins = _begins(place)
        place = place[begins]
        self.bounds3 = np.searchsorted(place >> np.uint64(44), np.arange(shards + 1, dtype=np.uint64))
        self.key3 = place & _44
        del place
        inner = inner[order]
        del order
        self.n3 = np.add.reduceat(self.train[inner], begins, dtype=np.int32) if len(begins) else begins.astype(np.int32)
        self.at3 = np.full(len(at), -1, np.int32)  # the trigram that ends at each token
        self.at3[inner] = _numbered(begins, len(inner))
        one = inner[begins]
        self.prefix, self.suffix = at[one - 1], at[one]

    def groups(self, shard: int) -> tuple[slice, np.ndarray]:
        """A shard's bigrams, and where each context of theirs begins."""
        own = slice(self.bounds[shard], self.bounds[shard + 1])
        h = self.h[own]
        return own, np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)


class Automaton:
    """States 0 (root), then words, then bigrams. Arcs are trigrams and bigrams, NaN where there is none; the root has one for every word.

    ``at3``, ``at`` and ``tokens`` say for each token which arc is its own from a bigram,
    from a word and from the root, so that none has to be searched for.
    """

    def __init__(self, tokens: np.ndarray, at: np.ndarray, at3: np.ndarray, weights: np.ndarray, weights3: np.ndarray, fail: np.ndarray, fail_to: np.ndarray, root: np.ndarray, root_to: np.ndarray) -> None:
        self.tokens, self.at, self.bigrams = tokens, at, len(root) + 1
        self.levels = [(self.bigrams, at3, weights3), (1, at, weights)]
        self.fail, self.fail_to, self.root, self.root_to = fail, fail_to, root, root_to

    def step(self, state: np.ndarray, here: np.ndarray) -> np.ndarray:
        """Log-probabilities of the tokens at ``here``; ``state`` moves on. Failure arcs are followed until an arc is there."""
        gain, searching = np.zeros(len(here)), np.ones(len(here), bool)
        for lowest, arcs, weights in self.levels:
            own = np.flatnonzero(searching & (state >= lowest))
            weight = weights[arcs[here[own]]]
            miss = np.isnan(weight)
            there, fallen = own[~miss], own[miss]
            gain[there] += weight[~miss]
            state[there] = self.at[here[there]] + self.bigrams
            searching[there] = False
            gain[fallen] += self.fail[state[fallen]]
            state[fallen] = self.fail_to[state[fallen]]
        rest = np.flatnonzero(searching)
        word = self.tokens[here[rest]]
        gain[rest] += self.root[word]
        state[rest] = self.root_to[word]
        return gain

    def score(self, starts: np.ndarray, counts: np.ndarray, start_state: int) -> np.ndarray:
        """The sum of log-probabilities of each text; all texts move on by one token at a time."""
        order = np.argsort(-counts, kind="stable")
        lengths, first = counts[order], starts[order]
        total, state = np.zeros(len(counts)), np.full(len(counts), start_state)
        for step in range(int(lengths[0]) if len(lengths) else 0):
            live = int(np.searchsorted(-lengths, -step, "left"))  # texts longer than step
            total[:live] += self.step(state[:live], first[:live] + step)
        out = np.empty_like(total)
        out[order] = total
        return out


def score(docs: DataFrame, held: Column | None = None, prior: float = PRIOR, hot_share: float = 0.002, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every document, by a model of those not held out."""
    kind = docs.schema[id_column].dataType.simpleString()
    shards = shards_for(docs, 16 << 20)
    table = stored(tokenised(docs, held_out(id_column) if held is None else held, id_column, text_column), "tokens")
    cells = ["block", "held", "counts", "vocab", "tokens"]

    def find_hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, *packed in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                block = Block(*packed)
                h, n = block.hot(hot_share)
                columns = [np.append(h, np.uint64(0)).view(np.int64), np.append(n, block.train.sum()), np.append(n * 0, (~block.held).sum())]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["context", "n", "texts"])

    # Context 0 is the sum over all.
    found = stored(table.select(*cells).mapInArrow(tidy(find_hot), "context long, n long, texts long").groupBy("context").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts")), "hot")
    whole = found.where("context = 0").first()
    tokens, texts = (whole["n"], whole["texts"]) if whole else (0, 0)
    # Each has a share of hot_share at least, so there are 1 / hot_share at most.
    heavy = np.array([r[0] for r in found.where((F.col("context") != 0) & (F.col("n") >= hot_share * tokens)).select("context").collect()], np.int64).view(np.uint64)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 4]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["shard", "block", "contexts", "sizes", "followers", "n"])

        for batch in batches:
            for i in range(len(batch)):
                name, *packed = (c[i].as_py() for c in batch.columns)
                block = Block(*packed)
                del packed
                block.deal(heavy, shards)
                rows, held_bytes = [], 0
                for s in range(shards):
                    own, begins = block.groups(s)
                    if len(begins):
                        sizes = np.diff(np.append(begins, own.stop - own.start))
                        rows.append((s, name, pack(block.h[own][begins], ascending=True), pack(sizes.astype(np.uint32)), pack(block.f[own]), pack(block.n[own].astype(np.uint32))))
                        held_bytes += sum(map(len, rows[-1][2:]))
                    own3 = slice(block.bounds3[s], block.bounds3[s + 1])
                    if own3.stop > own3.start:
                        rows.append((shards + s, name, None, None, pack(block.key3[own3], ascending=True), pack(block.n3[own3].astype(np.uint32))))
                        held_bytes += sum(map(len, rows[-1][4:]))
                    if held_bytes >= SENT_BYTES:
                        yield batch_of(rows)
                        rows, held_bytes = [], 0
                if rows:
                    yield batch_of(rows)
                del block, rows
                release()

    def add_up_trigrams(part: pd.DataFrame) -> pd.DataFrame:
        keys, n = ([unpack(x) for x in part[c]] for c in ("followers", "n"))
        cut = np.cumsum([len(x) for x in keys])[:-1]
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, np.concatenate(n), len(distinct)).astype(np.uint32)
        out = pd.DataFrame({"block": part["block"].astype("Int64"), "n": [pack(x) for x in np.split(total[place], cut)]})
        release()
        out = out.assign(kind=2, shard=part["shard"].iloc[0], sums=None, kinds=None, **{c: pd.array([None] * len(out), "Int64") for c in ("context", "a", "b", "c")})
        return out[["kind", "shard", "block", "n", "sums", "kinds", "context", "a", "b", "c"]]

    def add_up(part: pd.DataFrame) -> pd.DataFrame:
        if part["shard"].iloc[0] >= shards:
            return add_up_trigrams(part)
        contexts, sizes, f, n = ([unpack(x) for x in part[c]] for c in ("contexts", "sizes", "followers", "n"))
        groups = np.array([len(x) for x in contexts])
        lengths = np.array([len(x) for x in f])
        h = np.repeat(np.concatenate(contexts), np.concatenate(sizes))
        f, n = np.concatenate(f), np.concatenate(n).astype(np.int64)
        order = np.lexsort((f, h))
        new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (f[order][1:] != f[order][:-1])])
        at = np.flatnonzero(new)
        total = np.add.reduceat(n[order], at)
        everywhere = np.empty(len(n), np.int64)
        everywhere[order] = np.repeat(total, np.diff(np.append(at, len(n))))
        own_h = h[order][at]
        starts = np.flatnonzero(np.concatenate([[True], own_h[1:] != own_h[:-1]]))
        sums, kinds = np.add.reduceat(total, starts), np.add.reduceat((total > 0).astype(np.int64), starts)
        distinct = own_h[starts]
        place = np.searchsorted(distinct, np.concatenate(contexts))
        cut, cut_groups = np.cumsum(lengths)[:-1], np.cumsum(groups)[:-1]
        out = pd.DataFrame({
            "block": part["block"].astype("Int64"),
            "n": [pack(x.astype(np.uint32)) for x in np.split(everywhere, cut)],
            "sums": [pack(x) for x in np.split(sums[place], cut_groups)],
            "kinds": [pack(x) for x in np.split(kinds[place], cut_groups)],
        })
        release()
        hot = np.isin(distinct, heavy)
        known = int(((sums > 0) & ~hot & (distinct != START)).sum())
        totals = [(None, known, int((total == 1).sum()), int((total == 2).sum()))]
        totals += [(int(h_), s, k, 0) for h_, s, k in zip(distinct[hot].view(np.int64), sums[hot].tolist(), kinds[hot].tolist(), strict=True)]
        more = pd.DataFrame({c: pd.array(x, "Int64") for c, x in zip(("context", "a", "b", "c"), zip(*totals, strict=True), strict=True)})
        return pd.concat([out.assign(shard=part["shard"].iloc[0], kind=0), more.assign(shard=part["shard"].iloc[0], kind=1)]).reset_index(drop=True)[["kind", "shard", "block", "n", "sums", "kinds", "context", "a", "b", "c"]].astype({"block": "Int64", "context": "Int64", "a": "Int64", "b": "Int64", "c": "Int64"})

    sums_schema = "kind int, shard int, block long, n binary, sums binary, kinds binary, context long, a long, b long, c long"
    sent = table.select(*cells).mapInArrow(tidy(send), "shard int, block long, contexts binary, sizes binary, followers binary, n binary")
    summed = stored(sent.groupBy("shard").applyInPandas(add_up, sums_schema), "counts")
    totals = summed.where("kind = 1")
    seen = totals.where("context is null").agg(F.sum("a"), F.sum("b"), F.sum("c")).first()
    hot_rows = totals.where("context is not null").groupBy("context").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect()
    hot_h = np.array([r["context"] for r in hot_rows], np.int64).view(np.uint64)
    hot_n, hot_kinds = np.array([r["a"] for r in hot_rows], np.int64), np.array([r["b"] for r in hot_rows], np.int64)
    # Distinct training tokens: contexts but the start, and the end token.
    distinct = (seen[0] or 0) + int(((hot_n > 0) & (hot_h != START)).sum()) + (1 if texts else 0)
    once, twice = seen[1] or 0, seen[2] or 0
    discount = once / (once + 2 * twice) if once and twice else 0.5
    space = tokens + distinct + 1

    def finish(part: pa.Table, back: pa.Table) -> pa.Table:
        out = []
        order = np.argsort(back["shard"].to_numpy())
        both = back.take(pa.array(order))
        replies, trigrams = both.filter(pc.less(both["shard"], shards)), both.filter(pc.greater_equal(both["shard"], shards))
        for ids, *packed in zip(*[part[c].to_pylist() for c in ("ids", *cells[1:])], strict=True):
            block = Block(*packed)
            block.deal(heavy, shards)
            n = np.concatenate([unpack(x) for x in replies["n"].to_pylist()]).astype(np.int64)
            sums, kinds = (np.concatenate([unpack(x) for x in replies[c].to_pylist()]) for c in ("sums", "kinds"))
            first = np.concatenate([own.start + begins for own, begins in map(block.groups, range(shards))]).astype(np.int64)
            at = block.context[first]
            del block.h, block.f, block.n, block.key3, block.n3  # what only shards need
            count, follow = np.zeros(len(block.hashes), np.int64), np.zeros(len(block.hashes), np.int64)
            count[at], follow[at] = sums, kinds
            if len(hot_h):
                for h, a, b in zip(hot_h, hot_n.tolist(), hot_kinds.tolist(), strict=True):
                    k = int(np.searchsorted(block.hashes[:-1], h)) if h != START else block.start
                    if k <= block.start and block.hashes[k] == h:
                        count[k], follow[k] = a, b
            unigram = count.copy()
            end = int(np.searchsorted(block.hashes[:-1], END))
            unigram[end], unigram[block.start] = texts, 0
            root = (unigram + 1) / space
            with np.errstate(divide="ignore", invalid="ignore"):
                free = np.where(count > 0, discount * follow / count, 1.0)
            c, f = block.context, block.follower
            with np.errstate(divide="ignore", invalid="ignore"):
                p = np.where(n > 0, (n - discount) / count[c], 0.0) + free[c] * root[f]
            n3 = np.concatenate([unpack(x) for x in trigrams["n"].to_pylist()] or [np.zeros(0)]).astype(np.int64)
            prefix, suffix, size = block.prefix, block.suffix, len(root)
            weights3 = np.where(n3 > 0, np.log10((n3 + prior * p[suffix]) / (n[prefix] + prior)), np.nan)
            weights = np.where(n > 0, np.log10(p), np.nan)
            fail = np.concatenate([[0.0], np.log10(free), np.log10(prior / (n + prior))])
            fail_to = np.concatenate([np.zeros(size + 1, np.int64), f + 1])
            automaton = Automaton(block.tokens, block.at, block.at3, weights, weights3, fail, fail_to, np.log10(root), np.where(count > 0, np.arange(size) + 1, 0))
            del weights, weights3, p, n3
            starts = block.ends - block.counts
            scores = automaton.score(starts, block.counts, block.start + 1 if count[block.start] else 0)
            base = np.add.reduceat(np.log10(root)[block.tokens], starts)
            n_known = np.add.reduceat((unigram > 0)[block.tokens].astype(np.int64), starts)
            columns = [pa.array(ids, part.schema.field("ids").type.value_type), pa.array(block.held), pa.array(block.counts), pa.array(n_known), pa.array(np.full(len(ids), tokens)), pa.array(base), pa.array(scores)]
            out.append(pa.table(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]))
        release()
        if not out:
            kinds_ = [part.schema.field("ids").type.value_type, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            return pa.table([pa.array([], k) for k in kinds_], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
        return pa.concat_tables(out)

    replies = summed.where("kind != 1").select("block", "shard", "n", "sums", "kinds")
    return table.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(finish, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
