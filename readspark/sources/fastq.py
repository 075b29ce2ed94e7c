"""FASTQ files as a Spark data source, and back.

``spark.read.format("fastq").option("path", ...)``, after ``register``. A file is cut
into byte ranges; each range starts at the first record that begins in it and reads on to
the end of its last. Line i begins a record if it starts with ``@``, line i + 1 has bases
only, line i + 2 starts with ``+`` and line i + 3 is as long as line i + 1: in a
well-formed file this is so for titles and for nothing else. Files are opened through
Arrow's file systems, so any store that these reach will do.

A record: title, bases, a line that starts with ``+``, qualities. Lines of white space
before a title are passed over (their bytes count in ``size``). A record cut off by the
end of the file is dropped. An error names the first bad record.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.alphabet import BASES, FIRST_QUALITY, N_QUALITIES, base_text, quality_text

SCHEMA = "part long, place long, identifier string, acids array<int>, quals array<int>, size long"
_CODES = {c: k for k, c in enumerate(BASES.encode())}
_TO_CODES = bytes(_CODES.get(c, 255) for c in range(256))
_QUALITIES = bytes(range(FIRST_QUALITY, FIRST_QUALITY + N_QUALITIES))
#: Symbols of a batch of records.
BATCH = 1 << 20
_ONLY_BASES = re.compile(rb"[ACGTN]*")


class FastqError(ValueError):
    """A malformed record."""


class InvalidFormat(FastqError):
    def __init__(self) -> None:
        super().__init__("Invalid FASTQ format")


class InvalidAcid(FastqError):
    def __init__(self, c: str) -> None:
        super().__init__(f"Invalid acid: `{c}`")


class InvalidQualityScore(FastqError):
    def __init__(self, c: str) -> None:
        super().__init__(f"Invalid quality score: `{c}`")


class LengthMismatch(FastqError):
    def __init__(self) -> None:
        super().__init__("Length of acids and quality scores differs")


class _Lines:
    """Lines of a file from an offset, without their ends."""

    def __init__(self, file: pa.NativeFile, at: int, delimiter: bytes = b"\n", chunk: int = 1 << 20) -> None:
        self.file, self.at, self.delimiter, self.chunk = file, at, delimiter, chunk
        self.file.seek(at)
        self.held, self.pos = b"", 0

    def next(self) -> tuple[bytes, int] | None:
        """A line and how many bytes it took; None at the end."""
        while (end := self.held.find(self.delimiter, self.pos)) < 0:
            more = self.file.read(self.chunk)
            if not more:
                rest, self.held, self.pos = self.held[self.pos :], b"", 0
                return (rest, len(rest)) if rest else None
            self.held, self.pos = self.held[self.pos :] + more, 0
        line = self.held[self.pos : end]
        size = end + 1 - self.pos
        self.pos = end + 1
        return line.rstrip(self.delimiter), size


def parse(lines: _Lines, start: int, stop: int) -> Iterator[tuple[str, bytes, bytes, int]]:
    """The records that begin before ``stop`` (title, codes of bases, qualities as text, size), from a record's beginning (or white space before it)."""
    at = start
    while True:
        skipped = 0
        while True:
            if at >= stop:
                return
            got = lines.next()
            if got is None:
                return
            title, size = got
            if title.strip():
                break
            skipped += size
            at += size
        used = size
        rest = []
        for _ in range(3):
            got = lines.next()
            if got is None:
                got = (b"", 0) if len(rest) == 2 and rest[0] == b"" else None
            if got is None:
                if not title.startswith(b"@"):
                    raise InvalidFormat
                return  # cut off: dropped
            rest.append(got[0])
            used += got[1]
        at += used
        acids, mark, quals = rest
        if not title.startswith(b"@"):
            raise InvalidFormat
        if not _ONLY_BASES.fullmatch(acids):
            raise InvalidAcid(chr(next(c for c in acids if c not in _CODES)))
        if not mark.startswith(b"+"):
            raise InvalidFormat
        low, high = FIRST_QUALITY, FIRST_QUALITY + N_QUALITIES
        if quals.translate(None, _QUALITIES):
            raise InvalidQualityScore(chr(next(c for c in quals if not low <= c < high)))
        if len(acids) != len(quals):
            raise LengthMismatch
        yield title[1:].decode("utf-8", "replace").strip(), acids.translate(_TO_CODES), quals, used + skipped


def first_record(file: pa.NativeFile, at: int, delimiter: bytes = b"\n") -> int | None:
    """The offset of the first record that begins at ``at`` or later."""
    if at == 0:
        return 0
    lines = _Lines(file, at - 1, delimiter)
    got = lines.next()  # the rest of the line in which the offset lies
    if got is None:
        return None
    offset = at - 1 + got[1]
    window: list[tuple[bytes, int]] = []
    while True:
        while len(window) < 4 and (got := lines.next()) is not None:
            window.append(got)
        if len(window) < 3:
            return None
        a, b, c = (x[0] for x in window[:3])
        d = window[3][0] if len(window) > 3 else b""
        if a.startswith(b"@") and _ONLY_BASES.fullmatch(b) and c.startswith(b"+") and len(d) == len(b):
            return offset
        offset += window.pop(0)[1]


class _Range(InputPartition):
    def __init__(self, number: int, path: str, start: int, stop: int) -> None:
        self.number, self.path, self.start, self.stop = number, path, start, stop


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


class FastqReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.delimiter = options.get("delimiter", "\n").encode()
        self.split = int(options.get("splitbytes", 64 << 20))

    def partitions(self) -> list[_Range]:
        fs, path = _open(self.path)
        info = fs.get_file_info(path)
        files = [info] if info.type == pafs.FileType.File else sorted((f for f in fs.get_file_info(pafs.FileSelector(path)) if f.type == pafs.FileType.File and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        root = self.path.split(path)[0] if path in self.path else ""
        out: list[_Range] = []
        for f in files:
            for start in range(0, max(f.size, 1), self.split):
                out.append(_Range(len(out), root + f.path, start, min(start + self.split, f.size)))
        return out

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        fs, path = _open(partition.path)
        with fs.open_input_file(path) as file:
            begin = first_record(file, partition.start, self.delimiter)
            if begin is None or begin >= partition.stop:
                return
            rows, held, place = [], 0, 0
            for record in parse(_Lines(file, begin, self.delimiter), begin, partition.stop):
                rows.append(record)
                held += len(record[1])
                if held >= BATCH or len(rows) >= 10_000:
                    yield _batch(partition.number, place, rows)
                    rows, held, place = [], 0, place + len(rows)
            if rows:
                yield _batch(partition.number, place, rows)


def _batch(part: int, place: int, rows: list[tuple[str, bytes, bytes, int]]) -> pa.RecordBatch:
    """Records as a batch of SCHEMA."""
    titles, acids, quals, sizes = zip(*rows, strict=True)
    offsets = pa.array(np.concatenate([[0], np.cumsum([len(a) for a in acids])]).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(x), np.uint8).astype(np.int32) - low)) for x, low in ((acids, 0), (quals, FIRST_QUALITY))]
    columns = [pa.array(np.full(len(rows), part, np.int64)), pa.array(np.arange(place, place + len(rows))), pa.array(titles, pa.string()), *lists, pa.array(sizes, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["part", "place", "identifier", "acids", "quals", "size"])


class FastqSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FastqReader:
        return FastqReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FastqSource)


def read_fastq(spark: SparkSession, path: str, split_bytes: int | None = None, delimiter: str = "\n") -> DataFrame:
    """``(read_id, identifier, acids, quals, n, size)``; ``read_id`` is the place in the files' order.

    A first pass counts the records of each range; ids then need no shuffle of reads.
    """
    register(spark)
    source = spark.read.format("fastq").option("path", path).option("delimiter", delimiter)
    if split_bytes:
        source = source.option("splitBytes", str(split_bytes))
    rows = source.load()
    counts = sorted((r["part"], r["n"]) for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect())
    before, total = {}, 0
    for part, n in counts:
        before[part] = total
        total += n
    offset = F.lit(0).cast("long")
    if before:
        offset = F.element_at(F.create_map(*[F.lit(x).cast("long") for kv in before.items() for x in kv]), F.col("part"))
    return rows.select((offset + F.col("place")).alias("read_id"), "identifier", "acids", "quals", F.size("acids").alias("n"), "size")


def fastq_text(reads: DataFrame, title_with_separator: bool = False) -> DataFrame:
    """``(read_id, value)``: the four lines of each read."""
    mark = F.concat(F.lit("+"), F.col("identifier")) if title_with_separator else F.lit("+")
    return reads.select("read_id", F.concat_ws("\n", F.concat(F.lit("@"), F.col("identifier")), base_text(F.col("acids")), mark, quality_text(F.col("quals"))).alias("value"))


def write_fastq(reads: DataFrame, path: str, title_with_separator: bool = False, files: int | None = None) -> None:
    """A directory of FASTQ text in the order of reads: its files, by name, put one behind the other."""
    text = fastq_text(reads, title_with_separator)
    ordered = text.repartitionByRange(files, "read_id").sortWithinPartitions("read_id") if files else text.orderBy("read_id")
    ordered.select("value").write.option("lineSep", "\n").text(path)
