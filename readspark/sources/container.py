"""A container of coded reads: blocks of slices, each with a checksum.

A block holds the reads' names (deflated), marks that switch models, and each read's
coded bases and qualities. Blocks are rows of a table, so they are written and read in
parallel; ``export_file`` and ``read_file`` turn the table into one file and back: a head
with magic and version, the models' identifiers, the blocks in order, and an empty block.

All numbers are big-endian. Slice 0: names (u32 length, u8 codec); 1: switch to a model
(u8 its place); 2: a read (u32 length of its bytes, u32 number of symbols), whose bytes
are the coded bases (u32 length before them) and the coded qualities. A block's head: u32
length, u32 CRC32 of its reads.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.alphabet import SIZES, base_text, quality_text
from ..functions.information import SCALE_BITS, cumulative_frequencies, frequencies
from ..functions.keys import KeySpec, spec_of
from ..functions.symbols import flat
from ..operators import blocks as packing
from ..operators import models as modelling
from ..operators import select
from ..storage import new_path
from . import rans
from .fastq import read_fastq, write_fastq

MAGIC, VERSION = b"RSPK", 1
DEFLATE = 0
#: Symbols of each kind that are coded side by side: blocks are gathered until they have as many.
GROUP = 4 << 20
#: When so few reads are left, they are decoded one by one.
ALONE = 12
BLOCKS = "block_index long, n_reads long, in_bytes long, out_bytes long, identifier_bytes long, acid_bytes long, quality_bytes long, n_symbols long, n_switches long, checksum long, payload binary"


class ContainerError(ValueError):
    """A container that can't be decoded."""


class InvalidVersion(ContainerError):
    def __init__(self, version: int) -> None:
        super().__init__(f"Invalid version: {version}")


class ChecksumMismatch(ContainerError):
    def __init__(self, found: int, expected: int) -> None:
        super().__init__(f"Block checksum mismatch: expected {expected:08x}, got {found:08x}")


class InvalidModelIndex(ContainerError):
    def __init__(self, k: int) -> None:
        super().__init__(f"Invalid model index: {k}")


class NoActiveModel(ContainerError):
    def __init__(self) -> None:
        super().__init__("A sequence comes before its models")


class UnknownModel(ContainerError):
    def __init__(self, name: str) -> None:
        super().__init__(f"Unknown model: {name}")


@dataclass
class Coder:
    """A model ready for coding: row 0 is the uniform context, which unknown keys have."""

    kind: str
    spec: KeySpec
    keys: np.ndarray
    rows: np.ndarray
    cumulative: np.ndarray
    freqs: np.ndarray
    name: bytes

    @classmethod
    def of(cls, model: DataFrame, kind: str, spec_name: str) -> Coder:
        """From ``(specs, ctx_id, context_prob, symbol_prob)``, which ``check`` bounds."""
        found = modelling.check(model).orderBy("ctx_id").collect()
        size = SIZES[kind]
        tables = [np.full(size, 1 / size), *[np.array(r["symbol_prob"]) for r in found]]
        cumulative = np.array([cumulative_frequencies(t) for t in tables])
        pairs = sorted((s, k + 1) for k, r in enumerate(found) for s in r["specs"])
        keys, rows = (np.array(x, np.int64) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2
        return cls(kind, spec_of(spec_name), keys, rows, cumulative, np.array([frequencies(c) for c in cumulative]), modelling.identifier(found, kind, spec_name))

    @cached_property
    def rows_of_keys(self) -> np.ndarray | None:
        """Each key's row, where keys are few; the last one is for keys beyond."""
        top = int(self.keys[-1]) + 1 if len(self.keys) else 0
        if top > 1 << 20:
            return None
        out = np.zeros(top + 1, np.int64)
        out[self.keys] = self.rows
        return out

    @cached_property
    def flat(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Frequencies and starts of all rows one behind the other, and where a row's slots begin with each symbol."""
        begins = (np.arange(len(self.cumulative))[:, None] << SCALE_BITS) + self.cumulative
        return self.freqs.ravel(), self.cumulative.ravel(), begins.ravel()

    @cached_property
    def of_slots(self) -> np.ndarray | None:
        """The symbol of each slot of each row, where rows are few."""
        if len(self.freqs) > 2048:
            return None
        return np.repeat(np.tile(np.arange(self.freqs.shape[1], dtype=np.uint8), len(self.freqs)), self.freqs.ravel())

    @cached_property
    def one_by_one(self) -> tuple:
        """The tables for one symbol at a time: row of a key, symbol of a slot, frequencies and starts."""
        size, begins = self.freqs.shape[1], array("q", self.flat[2].astype(np.int64).tobytes())
        slots = None if self.of_slots is None else self.of_slots.tobytes()
        find = (lambda row, slot: slots[(row << SCALE_BITS) + slot]) if slots else (lambda row, slot: bisect_right(begins, (row << SCALE_BITS) + slot) - 1 - row * size)
        freqs, starts = (array("i", x.astype(np.int32).tobytes()) for x in self.flat[:2])
        return dict(zip(self.keys.tolist(), self.rows.tolist(), strict=True)), find, freqs, starts

    def context(self, keys: np.ndarray) -> np.ndarray:
        if (table := self.rows_of_keys) is not None:
            return table[np.minimum(keys, len(table) - 1)]
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[place] == keys, self.rows[place], 0)

    def symbols(self, context: np.ndarray, slots: np.ndarray) -> np.ndarray:
        at = (context << SCALE_BITS) + slots
        if (table := self.of_slots) is not None:
            return table[at]
        return np.searchsorted(self.flat[2], at, "right") - 1 - context * self.freqs.shape[1]


def _digits(spec: KeySpec, acid: np.ndarray, quality: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not spec.light:
        return acid, quality
    known = (acid > 0) & (quality > 0)
    return np.where(known, acid - 1, 0), np.where(known, quality * spec.qm // 94, 0)


def _pack(spec: KeySpec, a: np.ndarray, q: np.ndarray, pos: np.ndarray, n: np.ndarray) -> np.ndarray:
    return ((q << spec.acid_bits | a) << spec.pb) | (pos << spec.pb) // n


def read_keys(spec: KeySpec, acids: np.ndarray, quals: np.ndarray) -> np.ndarray:
    """The key of each position of a read."""
    n = len(acids)
    a, q = _digits(spec, acids.astype(np.int64), quals.astype(np.int64))

    def queue(x: np.ndarray, order: int, size: int) -> np.ndarray:
        out = np.zeros(n, np.int64)
        for j in range(1, min(order, n) + 1):
            out[j:] += x[: n - j] * size ** (j - 1)
        return out

    return _pack(spec, queue(a, spec.ao, spec.base_digits), queue(q, spec.qo, spec.quality_digits), np.arange(n), np.full(n, max(n, 1)))


def _code(parts: list[tuple[Coder, np.ndarray, np.ndarray]]) -> list[bytes]:
    """The bytes of some reads' symbols of one kind, each with its coder, all of them side by side."""
    lengths = np.array([len(a) for _, a, _ in parts], np.int64)
    f, c = np.empty(int(lengths.sum()), np.int32), np.empty(int(lengths.sum()), np.int32)
    at = 0
    for coder, acids, quals in parts:
        freqs, starts, _ = coder.flat
        place = coder.context(read_keys(coder.spec, acids, quals)) * SIZES[coder.kind] + (acids if coder.kind == "acids" else quals)
        f[at : at + len(acids)], c[at : at + len(acids)] = freqs[place], starts[place]
        at += len(acids)
    return rans.encode_flat(f, c, lengths, SCALE_BITS)


def encode_block(rows: list[tuple[str, np.ndarray, np.ndarray, int, int]], coders: list[Coder]) -> tuple[bytes, dict[str, int]]:
    """The slices of a block of reads ``(name, acids, quals, base model, quality model)``, and sums."""
    return encode_blocks([rows], coders)[0]


def encode_blocks(blocks: list[list[tuple]], coders: list[Coder]) -> list[tuple[bytes, dict[str, int]]]:
    """As ``encode_block``, for some blocks side by side."""
    coded = iter(_code([(coders[r[which]], r[1], r[2]) for rows in blocks for r in rows for which in (3, 4)]))
    return [_sliced(rows, [(next(coded), next(coded)) for _ in rows]) for rows in blocks]


def _sliced(rows: list[tuple], coded: list[tuple[bytes, bytes]]) -> tuple[bytes, dict[str, int]]:
    crc, sums = 0, dict.fromkeys(("identifier_bytes", "acid_bytes", "quality_bytes", "n_symbols", "n_switches", "in_bytes"), 0)
    names = "\n".join(r[0] for r in rows).encode()
    out = []
    if names.strip(b"\n"):
        deflate = zlib.compressobj(wbits=-15)
        packed = deflate.compress(names) + deflate.flush()
        out.append(struct.pack(">BIB", 0, len(packed), DEFLATE) + packed)
        sums["identifier_bytes"] = len(packed)
    now = [-1, -1]
    for i, (name, acids, quals, *chosen) in enumerate(rows):
        for slot in (0, 1):
            if chosen[slot] != now[slot]:
                out.append(struct.pack(">BB", 1, chosen[slot]))
                now[slot] = chosen[slot]
                sums["n_switches"] += 1
        data = struct.pack(">I", len(coded[i][0])) + coded[i][0] + coded[i][1]
        out.append(struct.pack(">BII", 2, len(data), len(acids)) + data)
        for piece in (name.encode(), acids.astype(np.uint8).tobytes(), quals.astype(np.uint8).tobytes()):
            crc = zlib.crc32(piece, crc)
        sums["acid_bytes"] += len(coded[i][0])
        sums["quality_bytes"] += len(coded[i][1])
        sums["n_symbols"] += len(acids)
        sums["in_bytes"] += len(name.encode()) + 2 * len(acids) + 6
    payload = b"".join(out)
    return struct.pack(">II", len(payload), crc) + payload, sums


def _decode_reads(acid: Coder, quality: Coder, data: list[tuple[bytes, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Both kinds of symbols of some reads, all reads one symbol on at a time."""
    lengths = np.array([n for _, n in data], np.int64)
    order, live, place = rans.steps_of(lengths)
    both = [(raw[4 : 4 + cut], raw[4 + cut :]) for raw, cut in ((data[i][0], struct.unpack_from(">I", data[i][0])[0]) for i in order)]
    streams = [rans.Decoder([x[j] for x in both], SCALE_BITS) for j in (0, 1)]
    size = lengths[order]
    found = np.zeros((2, len(place)), np.uint8)
    queues = np.zeros((2, 2, len(data)), np.int64)  # by coder, by kind
    coders = (acid, quality)
    end = 0
    for step, m in enumerate(live.tolist()):
        got, now = [], slice(0, m)
        for which, (coder, stream) in enumerate(zip(coders, streams, strict=True)):
            spec = coder.spec
            key = queues[which, 1, :m] << spec.acid_bits | queues[which, 0, :m] if spec.qo else queues[which, 0, :m]
            context = coder.context(key << spec.pb | (step << spec.pb) // size[:m] if spec.pb else key)
            symbol = coder.symbols(context, stream.slots(now))
            freqs, starts, _ = coder.flat
            at = context * SIZES[coder.kind] + symbol
            stream.advance(now, freqs[at], starts[at])
            found[which, end : end + m] = symbol
            got.append(symbol.astype(np.int64))
        for which, coder in enumerate(coders):
            spec = coder.spec
            if spec.ao or spec.qo:
                for kind, (x, order_, digits) in enumerate(zip(_digits(spec, got[0], got[1]), (spec.ao, spec.qo), (spec.base_digits, spec.quality_digits), strict=True)):
                    if order_:
                        queues[which, kind, :m] = queues[which, kind, :m] % digits ** (order_ - 1) * digits + x if order_ > 1 else x
        end += m
        if m <= ALONE:
            break
    done = len(live) and step + 1
    at = np.cumsum(live) - live
    for lane in range(ALONE):
        if lane < len(size) and size[lane] > done:
            found[:, at[done : size[lane]] + lane] = _alone(coders, streams, queues[:, :, lane], lane, done, int(size[lane]))
    found = found[:, place]
    cuts = np.cumsum(lengths)[:-1]
    return list(zip(np.split(found[0], cuts), np.split(found[1], cuts), strict=True)) if len(data) else []


def _alone(coders: tuple[Coder, Coder], streams: list[rans.Decoder], queues: np.ndarray, lane: int, step: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The rest of a read, one symbol at a time: less work than steps of numpy that few reads take."""
    mask, out = (1 << SCALE_BITS) - 1, (bytearray(), bytearray())
    states = []
    for coder, stream, own in zip(coders, streams, queues.tolist(), strict=True):
        spec = coder.spec
        acids, quals = (digits ** max(order - 1, 0) for digits, order in ((spec.base_digits, spec.ao), (spec.quality_digits, spec.qo)))
        states.append([int(stream.state[lane]), int(stream.at[lane]), stream.data.tobytes(), *own, spec, acids, quals, *coder.one_by_one, SIZES[coder.kind]])
    for k in range(step, n):
        for which, s in enumerate(states):
            x, at, data, a, q, spec, _, _, rows, find, freqs, starts, size = s
            key = q << spec.acid_bits | a
            row = rows.get(key << spec.pb | (k << spec.pb) // n, 0)
            slot = x & mask
            symbol = find(row, slot)
            i = row * size + symbol
            x = freqs[i] * (x >> SCALE_BITS) + slot - starts[i]
            while x < rans.LOW and at < len(data):
                x = x << 8 | data[at]
                at += 1
            s[0], s[1] = x, at
            out[which].append(symbol)
        acid, quality = out[0][-1], out[1][-1]
        for s in states:
            spec = s[5]
            a, q = acid, quality
            if spec.light:
                a, q = (acid - 1, quality * spec.qm // 94) if acid and quality else (0, 0)
            if spec.ao:
                s[3] = s[3] % s[6] * spec.base_digits + a
            if spec.qo:
                s[4] = s[4] % s[7] * spec.quality_digits + q
    return tuple(np.frombuffer(x, np.uint8) for x in out)


def decode_block(block: bytes, coders: list[Coder]) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """The reads of a block; its checksum must agree."""
    return decode_blocks([block], coders)[0]


def decode_blocks(blocks: list[bytes], coders: list[Coder]) -> list[list[tuple[str, np.ndarray, np.ndarray]]]:
    """As ``decode_block``, for some blocks side by side."""
    parsed = [_slices(block, coders) for block in blocks]
    reads = [r for _, own in parsed for r in own]
    found: list = [None] * len(reads)
    for a, q in {r[:2] for r in reads}:
        own = [i for i, r in enumerate(reads) if r[:2] == (a, q)]
        for i, symbols in zip(own, _decode_reads(coders[a], coders[q], [reads[i][2:] for i in own]), strict=True):
            found[i] = symbols
    rest, out = iter(found), []
    for block, (names, own) in zip(blocks, parsed, strict=True):
        crc, expected = 0, struct.unpack_from(">I", block, 4)[0]
        out.append([(names[i] if i < len(names) else "", *next(rest)) for i in range(len(own))])
        for name, acids, quals in out[-1]:
            for piece in (name.encode(), acids.tobytes(), quals.tobytes()):
                crc = zlib.crc32(piece, crc)
        if crc != expected:
            raise ChecksumMismatch(crc, expected)
    return out


def _slices(block: bytes, coders: list[Coder]) -> tuple[list[str], list[tuple[int, int, bytes, int]]]:
    """A block's names, and its reads: both models, bytes and number of symbols."""
    (length,) = struct.unpack_from(">I", block)
    at, end = 8, 8 + length
    names, now, reads = [], {"acids": None, "q_scores": None}, []
    while at < end:
        kind = block[at]
        if kind == 0:
            size, codec = struct.unpack_from(">IB", block, at + 1)
            if codec != DEFLATE:
                raise ContainerError(f"Unknown codec: {codec}")
            names = zlib.decompress(block[at + 6 : at + 6 + size], wbits=-15).decode().split("\n")
            at += 6 + size
        elif kind == 1:
            k = block[at + 1]
            if k >= len(coders):
                raise InvalidModelIndex(k)
            now[coders[k].kind] = k
            at += 2
        elif kind == 2:
            size, n = struct.unpack_from(">II", block, at + 1)
            if None in now.values():
                raise NoActiveModel
            reads.append((now["acids"], now["q_scores"], block[at + 9 : at + 9 + size], n))
            at += 9 + size
        else:
            raise ContainerError(f"Unknown slice: {kind}")
    return names, reads


def compress(reads: DataFrame, packed: DataFrame, chosen: DataFrame, coders: list[Coder], identifiers: bool = True) -> DataFrame:
    """Rows of BLOCKS. ``packed``: ``(read_id, block_index)``; ``chosen``: ``(read_id, acid_model, quality_model)``, places in ``coders``.

    A block is bounded (4 MiB of symbols by default), and a task codes blocks of GROUP symbols at a time.
    """
    sent = reads.sparkSession.sparkContext.broadcast(coders)  # 65 536 contexts at most in each
    columns = [c.split()[0] for c in BLOCKS.split(", ")]

    def coded(blocks: list[tuple[int, list[tuple]]]) -> pa.RecordBatch:
        rows = []
        for (block, own), (data, sums) in zip(blocks, encode_blocks([own for _, own in blocks], sent.value), strict=True):
            rows.append({"block_index": block, "n_reads": len(own), "out_bytes": len(data), "checksum": struct.unpack_from(">II", data)[1], "payload": data, **sums})
        return pa.RecordBatch.from_pylist(rows, pa.schema([(c, pa.binary() if c == "payload" else pa.int64()) for c in columns]))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: list[tuple[int, list[tuple]]] = []
        held = 0
        for batch in batches:
            for block, name, acids, quals, m, k in zip(*[batch.column(c).to_pylist() for c in ("block_index", "identifier", "acids", "quals", "acid_model", "quality_model")], strict=True):
                if not blocks or blocks[-1][0] != block:
                    if held >= GROUP:
                        yield coded(blocks)
                        blocks, held = [], 0
                    blocks.append((block, []))
                blocks[-1][1].append((name if identifiers else "", np.frombuffer(acids, np.uint8), np.frombuffer(quals, np.uint8), m, k))
                held += len(acids)
        if blocks:
            yield coded(blocks)

    as_bytes = F.arrow_udf(_as_bytes, "binary")
    joined = reads.select("read_id", "identifier", as_bytes("acids").alias("acids"), as_bytes("quals").alias("quals")).join(packed.select("read_id", "block_index"), "read_id").join(chosen, "read_id")
    return joined.repartition("block_index").sortWithinPartitions("block_index", "read_id").mapInArrow(code, BLOCKS)


def _as_bytes(column: pa.Array) -> pa.Array:
    """Lists of small numbers as bytes, a fourth as much to move."""
    values, offsets = flat(column)
    return pa.BinaryArray.from_buffers(pa.binary(), len(column), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(values.astype(np.uint8).tobytes())])


def decompress(table: DataFrame, coders: list[Coder]) -> DataFrame:
    """``(block_index, place, identifier, acids, quals, n)``: every block on its own, and those of about GROUP symbols side by side."""
    sent = table.sparkSession.sparkContext.broadcast(coders)

    def decoded(blocks: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        rows = [(block, place, *r) for (block, _), own in zip(blocks, decode_blocks([data for _, data in blocks], sent.value), strict=True) for place, r in enumerate(own)]
        for k in range(0, len(rows), 500):
            ids, places, names, acids, quals = zip(*rows[k : k + 500], strict=True)
            sizes = np.array([len(a) for a in acids])
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x).astype(np.int32))) for x in (acids, quals)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places, pa.int64()), pa.array(names, pa.string()), *lists, pa.array(sizes.astype(np.int32))], ["block_index", "place", "identifier", "acids", "quals", "n"])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: list[tuple[int, bytes]] = []
        held = 0
        for batch in batches:
            for block, payload in zip(batch.column("block_index").to_pylist(), batch.column("payload"), strict=True):
                blocks.append((block, payload.as_py()))
                held += len(blocks[-1][1])
                if held >= GROUP:  # about a byte for a symbol
                    yield from decoded(blocks)
                    blocks, held = [], 0
        if blocks:
            yield from decoded(blocks)

    return table.select("block_index", "payload").mapInArrow(decode, "block_index long, place long, identifier string, acids array<int>, quals array<int>, n int")


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def export_file(table: DataFrame, coders: list[Coder], path: str) -> int:
    """One file, in the order of blocks, which pass through the driver one at a time; its size."""
    fs, at = _open(path)
    with fs.open_output_stream(at, compression=None) as sink:
        sink.write(MAGIC + struct.pack(">BB", VERSION, len(coders)))
        for c in coders:
            sink.write(c.name)
        for row in table.select("block_index", "payload").orderBy("block_index").toLocalIterator(prefetchPartitions=False):
            sink.write(bytes(row["payload"]))
        sink.write(struct.pack(">II", 0, 0))
    return fs.get_file_info(at).size


def read_file(spark: SparkSession, path: str, known: list[Coder]) -> DataFrame:
    """The reads of a file: a pass over the heads finds the blocks, then each is read and decoded on its own."""
    fs, at = _open(path)
    places, names = [], []
    with fs.open_input_file(at) as file:
        head = file.read_at(6, 0)
        if head[:4] != MAGIC:
            raise ContainerError("Not a container")
        if head[4] != VERSION:
            raise InvalidVersion(head[4])
        pos = 6
        for _ in range(head[5]):
            names.append(file.read_at(32, pos))
            pos += 32
        while (length := struct.unpack(">II", file.read_at(8, pos))[0]) > 0:
            places.append((len(places), pos, 8 + length))
            pos += 8 + length
    by_name = {c.name: c for c in known}
    for name in names:
        if name not in by_name:
            raise UnknownModel(name.hex()[:8])

    def fetch(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own_fs, own = _open(path)
        with own_fs.open_input_file(own) as file:
            for part in parts:
                yield part[["block_index"]].assign(payload=[file.read_at(int(n), int(p)) for p, n in zip(part["pos"], part["size"], strict=True)])

    rows = spark.createDataFrame(places, "block_index long, pos long, size long").repartition(max(1, len(places)))
    return decompress(rows.mapInPandas(fetch, "block_index long, payload binary"), [by_name[n] for n in names])


def coders_for(reads: DataFrame, acid_specs: list[str], quality_specs: list[str]) -> tuple[list[Coder], list[DataFrame]]:
    """Models learned from the reads themselves."""
    coders, found = [], []
    for kind, names in (("acids", acid_specs), ("q_scores", quality_specs)):
        for name in names:
            own = modelling.contexts(modelling.context_counts(reads, spec_of(name), kind), SIZES[kind])
            coders.append(Coder.of(modelling.assemble(own), kind, name))
            found.append(own)
    return coders, found


def coders_from(spark: SparkSession, path: str) -> tuple[list[Coder], list[DataFrame]]:
    """All models of a directory (see ``operators.models.save``), by identifier; each identifier is computed again."""
    table = modelling.load(spark, path)
    coders, found = [], []
    for row in table.select("model_id", "model_type", "spec_type").distinct().orderBy("model_type", "model_id").collect():
        own = modelling.verify(table, row["model_id"]).select("specs", "ctx_id", "context_prob", "symbol_prob")
        coders.append(Coder.of(own, row["model_type"], row["spec_type"]))
        found.append(own.select(F.explode("specs").alias("spec"), "symbol_prob"))
    return coders, found


def compress_with(reads: DataFrame, coders: list[Coder], found: list[DataFrame], max_block: int = packing.MAX_BLOCK, quality: int = 7, fast: bool = False, identifiers: bool = True) -> tuple[DataFrame, list[Coder]]:
    """Rows of BLOCKS and the models used: those that the first block chooses, and for each read the best of them."""
    packed = packing.pack_blocks(reads, max_block)
    first = reads.join(packed.where(F.col("block_index") == 0).select("read_id"), "read_id", "left_semi")
    chosen, kept = None, []
    for kind, column in (("acids", "acid_model"), ("q_scores", "quality_model")):
        places = [k for k, c in enumerate(coders) if c.kind == kind]
        if not places:
            raise ContainerError(f"No model for {kind}")
        own = [(coders[k].spec.name, found[k]) for k in places]
        use = (select.choose_models(select.read_sizes(first, own, kind, SIZES[kind]), quality, fast) or [0]) if len(own) > 1 else [0]
        if len(use) <= 1 or fast:
            best = reads.select("read_id", F.lit(len(kept)).alias(column))
        else:
            sizes = select.read_sizes(reads, [own[k] for k in use], kind, SIZES[kind])
            # A read without symbols has no size; it takes the first model.
            best = select.best_with_switching(sizes, packed).select("read_id", (F.col("model_idx") + len(kept)).alias(column))
            best = reads.select("read_id").join(best, "read_id", "left").select("read_id", F.coalesce(column, F.lit(len(kept))).alias(column))
        kept += [coders[places[k]] for k in use]
        chosen = best if chosen is None else chosen.join(best, "read_id")
    return compress(reads, packed, chosen, kept, identifiers), kept


def compress_reads(reads: DataFrame, acid_specs: list[str], quality_specs: list[str], **options) -> tuple[DataFrame, list[Coder]]:
    """``compress_with`` models that are learned from the reads themselves."""
    return compress_with(reads, *coders_for(reads, acid_specs, quality_specs), **options)


def _as_text(reads: DataFrame) -> DataFrame:
    return reads.select("read_id", "identifier", base_text(F.col("acids")).alias("acids"), quality_text(F.col("quals")).alias("quals"))


def _read_id(reads: DataFrame) -> DataFrame:
    """Reads whose names hold their numbers."""
    return reads.withColumn("read_id", F.substring_index("identifier", "_", -1).cast("long"))


def through_fastq(reads: DataFrame) -> DataFrame:
    path = new_path(reads.sparkSession, "fastq")
    write_fastq(reads, path)
    return _as_text(_read_id(read_fastq(reads.sparkSession, path)))


def through_container(reads: DataFrame) -> DataFrame:
    spark = reads.sparkSession
    table, coders = compress_reads(reads, ["generic_ao1_qo0_pb0", "generic_ao2_qo0_pb0", "light_ao0_qo3_pb0_qm4"], ["generic_ao0_qo1_pb0"], max_block=300_000)
    path = new_path(spark, "container")
    table.write.parquet(path)
    return _as_text(_read_id(decompress(spark.read.parquet(path), coders)))
