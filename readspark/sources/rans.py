"""Range asymmetric numeral systems, many reads at once.

The coder of the literature with 32-bit states and whole bytes: to push a symbol of
frequency f and start c at scale s, bytes leave the state while it is at least
``f << (23 - s + 8)``; the state becomes ``(x // f << s) + x % f + c``. Each read has its
own state and bytes, and all reads of a group take the same step together, so numpy does
a step for all of them; the more reads in a group, the less a symbol takes. Symbols go in backwards and come out forwards.
"""

from __future__ import annotations

import numpy as np

LOW = 1 << 23


def steps_of(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Reads from the longest to the shortest; how many of them have a symbol at each step; each symbol's place where steps lie one behind the other.

    So a step's symbols, and the states of the reads that take it, are slices.
    """
    order = np.argsort(-lengths, kind="stable")
    width = int(lengths.max(initial=0))
    live = len(lengths) - np.searchsorted(lengths[order][::-1], np.arange(width), "right")
    rank = np.empty(len(lengths), np.int64)
    rank[order] = np.arange(len(lengths))
    pos = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return order, live, (np.cumsum(live) - live)[pos] + np.repeat(rank, lengths)


def encode(freqs: np.ndarray, starts: np.ndarray, lengths: np.ndarray, scale: int) -> list[bytes]:
    """The bytes of each read. Row i of ``freqs`` and ``starts`` has read i's symbols, ``lengths[i]`` of them."""
    own = np.arange(freqs.shape[1]) < lengths[:, None]
    return encode_flat(freqs[own], starts[own], lengths, scale)


def encode_flat(freqs: np.ndarray, starts: np.ndarray, lengths: np.ndarray, scale: int) -> list[bytes]:
    """As ``encode``, with the symbols of all reads one behind the other."""
    if scale > 16:
        raise ValueError("more than two bytes may leave a state at once")
    order, live, place = steps_of(lengths)
    f, c = np.empty(len(place), np.int32), np.empty(len(place), np.int32)
    f[place], c[place] = freqs, starts
    # What leaves a state before a symbol goes in: up to two bytes, the low one first.
    low, used = np.empty(len(place), np.uint16), np.empty(len(place), np.uint8)
    state = np.full(len(lengths), LOW, np.int64)
    end = len(place)
    for m in live[::-1].tolist():
        at = slice(end - m, end)
        end -= m
        x, own = state[:m], f[at].astype(np.int64)
        limit = own << (23 - scale + 8)
        n = (x >= limit).view(np.uint8) + (x >= limit << 8)
        low[at] = x & 0xFFFF
        used[at] = n
        x = x >> (n << 3)
        q = x // own
        state[:m] = (q << scale) + (x - q * own) + c[at]
    low, used = low[place], used[place]
    both = np.stack([low >> 8, low & 0xFF], 1).astype(np.uint8)[np.stack([used == 2, used >= 1], 1)]
    ends = np.cumsum(used, dtype=np.int64)
    ends = np.concatenate([[0], ends])[np.cumsum(lengths)]
    states = np.empty(len(lengths), "<u4")
    states[order] = state
    data = both.tobytes()
    # The state, lowest byte first, and then what the first symbols need.
    return [states[i : i + 1].tobytes() + data[s:e] for i, (s, e) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True))]


class Decoder:
    """The states of some reads; ``slots`` says where each is in its symbols, and ``advance`` takes a symbol out."""

    def __init__(self, data: list[bytes], scale: int) -> None:
        self.scale = scale
        sizes = np.array([len(x) for x in data], np.int64)
        self.data = np.frombuffer(b"".join(data) + b"\0\0\0\0", np.uint8)
        self.at = np.cumsum(sizes) - sizes
        self.state = sum(self.data[np.minimum(self.at + i, len(self.data) - 1)].astype(np.int64) << (8 * i) for i in range(4)) if len(data) else np.zeros(0, np.int64)
        self.at += 4

    def slots(self, live: np.ndarray | slice) -> np.ndarray:
        return self.state[live] & ((1 << self.scale) - 1)

    def advance(self, live: np.ndarray | slice, freq: np.ndarray, start: np.ndarray) -> None:
        x = self.state[live]
        x = freq * (x >> self.scale) + (x & ((1 << self.scale) - 1)) - start
        at = self.at[live]
        for _ in range(2):  # two bytes at most leave a state at once
            low = x < LOW
            x = np.where(low, x << 8 | self.data.take(at, mode="clip"), x)
            at = at + low
        self.state[live], self.at[live] = x, at
