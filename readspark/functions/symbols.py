"""Symbols and context keys of many reads at once, as flat arrays of numpy.

The keys are those of ``keys.key_array``. Reads lie one behind the other, and are worked
on in windows of bounded size, whatever their lengths: a window has the digits before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .alphabet import N_BASES, N_QUALITIES, SIZES
from .keys import KeySpec

#: Symbols of a window.
WINDOW = 1 << 18


def fits(spec: KeySpec, kind: str) -> bool:
    """Whether a key and its symbol are one number of 63 bits."""
    return bound(spec, kind) < 1 << 62


def bound(spec: KeySpec, kind: str) -> int:
    """All codes (key times symbols, plus symbol) are less."""
    top = (spec.quality_digits**spec.qo - 1) << spec.acid_bits | (1 << spec.acid_bits) - 1
    return ((top + 1) << spec.pb) * SIZES[kind]


def flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The elements of a column of lists as small numbers, and the offsets of its rows; a null is an empty list."""
    offsets = np.zeros(len(column) + 1, np.int64)
    np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), out=offsets[1:])
    return column.flatten().to_numpy(zero_copy_only=False), offsets


class Reads:
    """The reads of a batch with the columns ``acids`` and ``quals``."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        acids, self.offsets = flat(batch.column("acids"))
        quals, other = flat(batch.column("quals"))
        if not np.array_equal(self.offsets, other):
            raise ValueError("a read has as many bases as qualities")
        for values, size, what in ((acids, N_BASES, "base"), (quals, N_QUALITIES, "quality")):
            if len(values) and not 0 <= values.min() <= values.max() < size:
                raise ValueError(f"a code of a {what} is not in 0 to {size - 1}")
        self.acids, self.quals = acids.astype(np.uint8), quals.astype(np.uint8)
        self.lengths = np.diff(self.offsets)
        self.digits: dict[tuple[str, int], np.ndarray] = {("a", 0): self.acids, ("q", 0): self.quals}

    def digit(self, spec: KeySpec, which: str) -> np.ndarray:
        """What each symbol adds to the queue of bases (``a``) or qualities (``q``)."""
        name = which, (spec.qm if which == "q" else 1) if spec.light else 0
        if name not in self.digits:
            acid, quality = np.divmod(np.arange(N_BASES * N_QUALITIES), N_QUALITIES)
            known = (acid > 0) & (quality > 0)
            table = np.where(known, acid - 1 if which == "a" else quality * spec.qm // N_QUALITIES, 0).astype(np.uint8)
            if ("both", 0) not in self.digits:
                self.digits["both", 0] = self.acids.astype(np.uint16) * np.uint16(N_QUALITIES) + self.quals
            self.digits[name] = table[self.digits["both", 0]]
        return self.digits[name]

    def windows(self, size: int = WINDOW) -> Iterator[Window]:
        for start in range(0, len(self.acids), size):
            yield Window(self, start, min(start + size, len(self.acids)))


class Window:
    """Some symbols in a row; ``read`` says of which read each is."""

    def __init__(self, reads: Reads, start: int, stop: int) -> None:
        self.reads, self.start, self.stop = reads, start, stop
        first, last = np.searchsorted(reads.offsets, [start, stop - 1], "right") - 1
        inside = np.clip(reads.offsets[first : last + 2], start, stop)
        self.read = np.repeat(np.arange(first, last + 1), np.diff(inside))
        self.pos = np.arange(start, stop) - reads.offsets[self.read]
        self.queues: dict[tuple, np.ndarray] = {}
        self.early: dict[int, np.ndarray] = {}
        self.parts: dict[int, np.ndarray] = {}

    def symbols(self, kind: str) -> np.ndarray:
        return (self.reads.acids if kind == "acids" else self.reads.quals)[self.start : self.stop]

    def _before(self, digits: np.ndarray, back: int) -> np.ndarray:
        """The digit ``back`` symbols before each, 0 before a read's first."""
        out = np.zeros(self.stop - self.start, np.int64)
        begin = max(self.start - back, 0)
        if self.stop - back > begin:
            out[begin + back - self.start :] = digits[begin : self.stop - back]
        if back not in self.early:
            self.early[back] = np.flatnonzero(self.pos < back)
        out[self.early[back]] = 0
        return out

    def queue(self, spec: KeySpec, which: str, order: int) -> np.ndarray | int:
        if not order:
            return 0
        size = spec.base_digits if which == "a" else spec.quality_digits
        name = which, spec.qm if which == "q" else spec.light, order
        if name not in self.queues:
            added = self._before(self.reads.digit(spec, which), order) * size ** (order - 1)
            self.queues[name] = self.queue(spec, which, order - 1) + added
        return self.queues[name]

    def part(self, pb: int) -> np.ndarray:
        """The position's share of the read, in ``2 ** pb`` steps."""
        if pb not in self.parts:
            # Exact: a quotient of whole numbers this small is never rounded up to the next whole one.
            self.parts[pb] = (self.pos * float(1 << pb) / self.reads.lengths[self.read]).astype(np.int64)
        return self.parts[pb]

    def keys(self, spec: KeySpec) -> np.ndarray:
        key = self.queue(spec, "q", spec.qo)
        key = key << spec.acid_bits | self.queue(spec, "a", spec.ao) if spec.ao else key
        key = key << spec.pb | self.part(spec.pb) if spec.pb else key
        return np.broadcast_to(np.asarray(key, np.int64), (self.stop - self.start,))

    def codes(self, spec: KeySpec, kind: str) -> np.ndarray:
        return self.keys(spec) * SIZES[kind] + self.symbols(kind)


class Tally:
    """How often each code came: a table if codes are few, else sorted runs, which ``full`` says are many."""

    #: Codes of a table; codes of a run before it is sorted; distinct codes held.
    TABLE, RUN, HELD = 1 << 22, 1 << 20, 1 << 23

    def __init__(self, top: int, share: int = 1) -> None:
        """``share``: how many of them a worker has."""
        self.run, self.held = max(self.RUN * 8 // max(share, 8), 1 << 16), max(self.HELD // share, 1 << 16)
        self.table = np.zeros(top, np.int64) if top <= self.TABLE else None
        self.kind = np.uint32 if top < 1 << 32 else np.int64
        self.raw: list[np.ndarray] = []
        self.n_raw = 0
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, codes: np.ndarray) -> None:
        if self.table is not None:
            np.add.at(self.table, codes, 1)
            return
        self.raw.append(codes.astype(self.kind))
        self.n_raw += len(codes)
        if self.n_raw >= self.run:
            self._sort()

    def _sort(self) -> None:
        if not self.raw:
            return
        codes = np.concatenate(self.raw)
        self.raw, self.n_raw = [], 0
        codes.sort()
        at = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        self.runs.append((codes[at], np.diff(np.append(at, len(codes)))))
        # Each run is more than twice as long as the next, so that a code is merged a few times only.
        while len(self.runs) > 1 and len(self.runs[-2][0]) < 2 * len(self.runs[-1][0]):
            (a, n), (b, m) = self.runs.pop(), self.runs.pop()
            self.runs.append(_merged(np.concatenate([b, a]), np.concatenate([m, n])))

    @property
    def full(self) -> bool:
        return sum(len(a) for a, _ in self.runs) > self.held

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        """All codes and their numbers, and none are left."""
        if self.table is not None:
            codes = np.flatnonzero(self.table)
            numbers = self.table[codes]
            self.table[codes] = 0
            return codes, numbers
        self._sort()
        runs, self.runs = self.runs, []
        if not runs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        codes, numbers = _merged(np.concatenate([r[0] for r in runs]), np.concatenate([r[1] for r in runs])) if len(runs) > 1 else runs[0]
        return codes.astype(np.int64), numbers


def _merged(codes: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes, numbers = codes[order], numbers[order]
    at = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[at], np.add.reduceat(numbers, at)


def counted(batches: Iterator[pa.RecordBatch], sets: list[tuple[KeySpec, str]], rows: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """``(set, spec, symbol, n)`` of reads, for each key type and kind of ``sets``; a task may give a row twice where it has more than it may hold."""
    tallies = [Tally(bound(*s), len(sets)) for s in sets]

    def given(j: int) -> Iterator[pa.RecordBatch]:
        codes, numbers = tallies[j].take()
        size = SIZES[sets[j][1]]
        for k in range(0, len(codes), rows):
            spec, symbol = np.divmod(codes[k : k + rows], size)
            columns = [pa.array(np.full(len(spec), j, np.int32)), pa.array(spec), pa.array(symbol.astype(np.int32)), pa.array(numbers[k : k + rows])]
            yield pa.RecordBatch.from_arrays(columns, ["set", "spec", "symbol", "n"])

    for batch in batches:
        for window in Reads(batch).windows():
            for j, (spec, kind) in enumerate(sets):
                tallies[j].add(window.codes(spec, kind))
                if tallies[j].full:
                    yield from given(j)
    for j in range(len(sets)):
        yield from given(j)
