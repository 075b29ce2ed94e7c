"""Byte-pair encoding of many pre-tokens at once, by rank-synchronous array merging.

The symbols of all pre-tokens lie behind each other in one array. In each round every
pre-token merges all places of its own lowest-rank pair; pre-tokens without a pair that
can be merged are done and leave the arrays. This gives the ids that merging one place
at a time gives, because a pair that holds a merged symbol always has a higher rank
than the pair from which that symbol came.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import regex
from tokenizers import Tokenizer

from ._text import LOWER, Texts, ragged, span_hashes, words

_NONE = np.int32(2**31 - 1)
#: Distinct pieces of text that a worker remembers; beyond that it starts anew, with equal results.
REMEMBERED = 600_000


#: 1 letter, 2 digit, 3 other sign, 5 space; 4 needs the byte before, 9 needs the tokenizer's pattern.
_CLASS = np.full(256, 9, np.uint8)
_CLASS[0x21:0x7F] = 3
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3]] = 1
_CLASS[0x30:0x3A] = 2
_CLASS[0x20] = 5
_CLASS[[0x27, 0x3C]] = 9
_CLASS[0x80:0xC0] = 4


@lru_cache(1)
def byte_chars() -> list[str]:
    """The printable character that stands for each byte in the vocabulary files."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def merge(symbols: np.ndarray, owner: np.ndarray, keys: np.ndarray, ranks: np.ndarray, made: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The symbols that survive, and the pre-token of each, ordered by pre-token.

    ``keys`` (sorted) are ``left * size + right`` of the pairs that can be merged, with
    their ``ranks`` and the symbols ``made`` of them; ``owner`` ascends.
    """

    def found(at: np.ndarray, sym: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and place in ``keys`` of the pairs that start at ``at``."""
        pair = sym[at].astype(np.int64) * size + sym[at + 1]
        place = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
        hit = (keys[place] == pair) & (own[at] == own[at + 1])
        return np.where(hit, ranks[place], _NONE), place

    done_symbols, done_owner = [], []
    n = len(symbols)
    rank, place = np.full(n, _NONE, np.int32), np.zeros(n, np.int64)
    if n > 1:
        rank[:-1], place[:-1] = found(np.arange(n - 1), symbols, owner)
    while len(symbols):
        n = len(symbols)
        starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        least = np.minimum.reduceat(rank, starts)
        lengths = np.diff(np.append(starts, n))
        if (over := least == _NONE).any():
            gone = np.repeat(over, lengths)
            done_symbols.append(symbols[gone])
            done_owner.append(owner[gone])
            stay = ~gone
            symbols, owner, rank, place = symbols[stay], owner[stay], rank[stay], place[stay]
            least, lengths = least[~over], lengths[~over]
            n = len(symbols)
            if not n:
                break
        chosen = np.flatnonzero(rank == np.repeat(least, lengths))
        if len(chosen) > 1:  # of overlapping places, as in "aaa", every second one from the left
            fresh = np.concatenate([[True], np.diff(chosen) != 1])
            order = np.arange(len(chosen))
            chosen = chosen[(order - np.maximum.accumulate(np.where(fresh, order, 0))) % 2 == 0]
        symbols = symbols.copy()
        symbols[chosen] = made[place[chosen]]
        keep = np.ones(n, bool)
        keep[chosen + 1] = False
        where = np.cumsum(keep) - 1
        symbols, owner, rank, place = symbols[keep], owner[keep], rank[keep], place[keep]
        at = where[chosen]
        touched = np.zeros(len(symbols), bool)
        touched[at] = True
        touched[at[at > 0] - 1] = True
        at = np.flatnonzero(touched)
        last = at == len(symbols) - 1
        rank[at[last]] = _NONE
        at = at[~last]
        rank[at], place[at] = found(at, symbols, owner)
    if not done_symbols:
        return symbols, owner
    symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
    order = np.argsort(owner, kind="stable")
    return symbols[order], owner[order]


@dataclass
class Bpe:
    """A public vocabulary file of the BPE kind, applied by ``merge``.

    ``words``: pre-tokens are lower-cased words with an end mark, and white space is
    dropped; else they are byte-level pre-tokens with the space before them.
    """

    path: str
    words: bool = field(init=False)

    def __post_init__(self) -> None:
        with open(self.path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        self.words = bool(suffix)
        self.size = max(vocab.values()) + 1
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made[order]
        chars = byte_chars()
        self.first = np.array([vocab[c] for c in chars], np.int32)
        self.last = np.array([vocab[c + suffix] for c in chars], np.int32)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        # The file's own normaliser and pre-tokeniser: what is a letter is for the library to say.
        bare = spec | {"added_tokens": [], "post_processor": None, "model": model | {"vocab": {}, "merges": []}}
        self.library = Tokenizer.from_str(json.dumps(bare))
        self.byte_of = {c: k for k, c in enumerate(chars)}
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.known_start = np.zeros(0, np.int64)
        self.known_length = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.int32)

    def _pieces(self, text: str) -> list[bytes | int]:
        """Pre-tokens of a text, with the ids of special tokens in between."""
        out: list[bytes | int] = []
        for part in self.split.split(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                if self.library.normalizer is not None:
                    part = self.library.normalizer.normalize_str(part)
                out += [bytes(map(self.byte_of.__getitem__, x)) for x, _ in self.library.pre_tokenizer.pre_tokenize_str(part)]
        return out

    def _ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pre-tokens behind each other, and how many each has; ``fixed``: its only id, or -1."""
        _, first, inverse = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        sizes = (ends - starts)[first]
        symbols = data[ragged(starts[first], sizes)]
        ends_at = np.cumsum(sizes) - 1
        symbols, marks = self.first[symbols], self.last[symbols[ends_at]]
        symbols[ends_at] = marks
        ids, owner = merge(symbols, np.repeat(np.arange(len(first)), sizes), self.keys, self.ranks, self.made, self.size)
        count = np.bincount(owner, minlength=len(first))
        start = (np.cumsum(count) - count)[inverse]
        each = count[inverse]
        if (own := np.flatnonzero(fixed >= 0)).size:
            start, each = start.copy(), each.copy()
            start[own], each[own] = len(ids) + np.arange(len(own)), 1
            ids = np.concatenate([ids, fixed[own].astype(ids.dtype)])
        return ids[ragged(start, each)], each

    def encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all ``data[starts[k]:ends[k]]`` behind each other, and how many each has.

        Pieces of ASCII and common Latin letters are cut into pre-tokens by character
        class in arrays; all others by the library's pre-tokeniser.
        """
        sizes = ends - starts
        buf = data[ragged(starts, sizes)]
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        owner = np.repeat(np.arange(len(sizes)), sizes)
        kind = _CLASS[buf]
        after = np.concatenate([[False], buf[:-1] == 0xC3])
        tail = after & (buf >= 0x80) & (buf <= 0xBF) & (buf != 0x97) & (buf != 0xB7)
        kind[tail] = 1
        kind[after & ~tail] = 9
        kind[np.flatnonzero(kind == 4)] = 9
        begins = np.zeros(len(buf), bool)
        begins[bounds[:-1]] = True
        if self.words:
            kind[kind == 5] = 9
            change = begins.copy()
            change[1:] |= (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        else:
            kind[(kind == 5) & ~begins] = 9
            alone = np.flatnonzero(begins & (kind == 5))
            kind[alone[sizes[owner[alone]] == 1]] = 9
            change = begins.copy()
            change[1:] |= (kind[1:] != kind[:-1]) & (kind[:-1] != 5)
        odd = np.bincount(owner, kind == 9, minlength=len(sizes)) > 0
        if self.words:
            capital = tail & (buf <= 0x9E)
            buf = LOWER[buf]
            buf[capital] += 32
        cut = np.flatnonzero(change & ~odd[owner])
        spans = np.flatnonzero(np.append(change, True))
        stop = spans[np.searchsorted(spans, cut, "right")] if len(cut) else cut
        of, fixed = owner[cut], np.full(len(cut), -1, np.int64)
        if odd.any():  # by the library, behind the rest
            raw, extra, more_of, more_fixed = data.tobytes(), [], [], []
            for k in np.flatnonzero(odd):
                for x in self._pieces(raw[starts[k] : ends[k]].decode("utf-8", "replace")):
                    more_of.append(k)
                    more_fixed.append(x if isinstance(x, int) else -1)
                    extra.append(b"\0" if isinstance(x, int) else x)
            lengths = np.array([len(x) for x in extra], np.int64)
            at = len(buf) + np.cumsum(lengths) - lengths
            buf = np.concatenate([buf, np.frombuffer(b"".join(extra), np.uint8)])
            of, fixed = np.concatenate([of, np.array(more_of, np.int64)]), np.concatenate([fixed, np.array(more_fixed, np.int64)])
            order = np.argsort(of, kind="stable")
            cut, stop, of, fixed = np.concatenate([cut, at])[order], np.concatenate([stop, at + lengths])[order], of[order], fixed[order]
        if not len(cut):
            return np.zeros(0, np.int32), np.zeros(len(sizes), np.int64)
        ids, each = self._ids(buf, cut, stop, fixed)
        return ids, np.bincount(of, each, minlength=len(sizes)).astype(np.int64)

    def chunks(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and offsets by text of pieces that can be encoded one by one.

        For ``words`` these are runs without ASCII white space. Else a piece starts at a
        space between two characters neither of which can be white space (where that
        would take decoding to tell, the piece goes on).
        """
        data, offs = texts.data, texts.offsets
        n = len(data)
        if self.words:
            w = words(texts)
            return w.starts, w.ends, w.offsets
        cut = np.zeros(n + 1, bool)
        solid = data > 0x20
        lead = (data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3))
        before = solid & (data < 0x80)
        before[1:] |= (data[1:] >= 0x80) & (data[:-1] >= 0xC3) & (data[:-1] <= 0xDF)
        if n > 2:
            cut[1 : n - 1] = (data[1:-1] == 0x20) & before[:-2] & (solid & ~lead)[2:]
            inner = offs[(offs > 0) & (offs < n)]
            cut[inner - 1] = False  # a space that ends its text
        filled = offs[:-1][np.diff(offs) > 0]
        cut[filled] = True
        starts = np.flatnonzero(cut[:n])
        ends = np.append(starts[1:], n) if len(starts) else starts
        return starts, ends, np.searchsorted(starts, offs)

    def lookup(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each piece of ``chunks``: where its ids start in ``self.ids``, and how many; and the offsets by text."""
        starts, ends, offsets = self.chunks(texts)
        distinct, first, inverse = np.unique(span_hashes(texts.data, starts, ends), return_index=True, return_inverse=True)
        if len(self.known) + len(distinct) > REMEMBERED:
            self._forget()
        place = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), bool)
        if len(self.known):
            new = self.known[np.minimum(place, len(self.known) - 1)] != distinct
        if new.any():
            ids, lengths = self.encode(texts.data, starts[first[new]], ends[first[new]])
            begin = len(self.ids) + np.cumsum(lengths) - lengths
            self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
            at = place[new]
            self.known = np.insert(self.known, at, distinct[new])
            self.known_start = np.insert(self.known_start, at, begin)
            self.known_length = np.insert(self.known_length, at, lengths.astype(np.int32))
            place = np.searchsorted(self.known, distinct)
        return self.known_start[place][inverse], self.known_length[place][inverse].astype(np.int64), offsets

    def counts(self, texts: Texts) -> np.ndarray:
        """How many ids each text has."""
        _, length, offsets = self.lookup(texts)
        total = np.concatenate([[0], np.cumsum(length)])
        return total[offsets[1:]] - total[offsets[:-1]]


@lru_cache(2)
def load(path: str) -> Bpe:
    return Bpe(path)
