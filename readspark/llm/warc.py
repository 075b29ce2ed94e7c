"""WARC archives as seekable Zstandard bundles.

Method: a task writes the records of its rows to a bundle of its own. Records are grouped
into independent Zstandard frames of about ``frame_bytes``; a skippable frame at the end
holds a seek table with the compressed and uncompressed size of each frame, so any frame
can be found and read alone, and a plain decompressor reads the whole bundle as WARC. The
index table maps each record's identifier to bundle, frame, offset and length within the
uncompressed frame. Payloads that were written before are ``revisit`` records, which
refer to the record that holds the payload.

Bundles lie in the shared folder under names that no two attempts of a task share, and the
index, written when a task has ended, names those of the attempts that counted; so a lost
executor or a repeated task leaves files that nothing refers to.

Defined cases: a null html is an empty payload; equal payloads of at least
``least_bytes`` have the row with the largest page id as response (if rows share that id,
all of them are responses); rows with a null page id get records of their own and never
hold a payload for others, so they are responses where no other row has it; a null url
has an empty target; other columns are not read; an empty table gives an empty archive.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import file_system, new_path, stored
from ._text import tidy

SKIPPABLE, FOOTER = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "record_id string, bundle string, frame long, offset long, length long"
_EPOCH = datetime(1970, 1, 1, tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


class BundleWriter:
    """Frames, and the seek table behind them."""

    def __init__(self, sink: io.RawIOBase, frame_bytes: int, level: int = 3) -> None:
        self.sink, self.frame_bytes, self.size = sink, frame_bytes, 0
        self.codec = zstandard.ZstdCompressor(level=level)
        self.held, self.held_bytes, self.frames = [], 0, []

    def add(self, record: bytes) -> tuple[int, int]:
        """Frame of the record, and its offset in it."""
        if self.held_bytes and self.held_bytes + len(record) > self.frame_bytes:
            self._flush()
        place = len(self.frames), self.held_bytes
        self.held.append(record)
        self.held_bytes += len(record)
        return place

    def _flush(self) -> None:
        if self.held:
            packed = self.codec.compress(b"".join(self.held))
            self.sink.write(packed)
            self.frames.append((len(packed), self.held_bytes))
            self.size += len(packed)
            self.held, self.held_bytes = [], 0

    def finish(self) -> None:
        self._flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, FOOTER)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


class BundleReader:
    """Frames of a bundle by number, each read alone."""

    def __init__(self, uri: str) -> None:
        fs, path = file_system(uri)
        self.file = fs.open_input_file(path)
        end = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, end - 9))
        if magic != FOOTER:
            raise ValueError(f"{uri} has no seek table")
        width = 12 if flags & 0x80 else 8
        table = self.file.read_at(n * width, end - 9 - n * width)
        self.frames, at = [], 0
        for k in range(n):
            packed, plain = struct.unpack_from("<II", table, k * width)
            self.frames.append((at, packed, plain))
            at += packed

    def frame(self, k: int) -> bytes:
        at, packed, plain = self.frames[k]
        return zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, at), max_output_size=plain)

    def record(self, frame: int, offset: int, length: int) -> bytes:
        return self.frame(frame)[offset : offset + length]

    def close(self) -> None:
        self.file.close()


def make_record(record_id: str, url: str, payload: bytes, digest: str, size: int, refers_to: str | None) -> bytes:
    """A response with its payload, or a revisit without it."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{record_id}>",
        f"WARC-Date: {_EPOCH}",
        "WARC-Target-URI: " + "".join(c for c in url if c >= " "),
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head[3:3] = [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """Headers, HTTP head and payload of each record."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("not a WARC record")
        head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
        begin, size = end + 4, int(head["Content-Length"])
        http, _, payload = data[begin : begin + size].partition(b"\r\n\r\n")
        yield head, http, payload
        at = begin + size + 4


def record_id(page_id: object, part: str) -> str:
    return f"urn:page:{'' if page_id is None else page_id}:{part}"


def write_archive(pages: DataFrame, folder: str | None = None, least_bytes: int = 1000, frame_bytes: int = 1 << 20, bundle_bytes: int = 256 << 20) -> DataFrame:
    """Write every row as a record to bundles in ``folder`` (of the shared folder); the index."""
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), payload.alias("html"))
    digests = stored(rows.select("page_id", F.sha1(F.col("html").cast("binary")).alias("digest"), F.octet_length("html").cast("long").alias("size")), "digests")
    groups = digests.where(F.col("size") >= least_bytes).groupBy("digest", "size").agg(F.max("page_id").alias("response"), F.count("*").alias("n"))
    groups = stored(groups.where("n > 1 and response is not null"), "groups")
    revisits = digests.where("page_id is not null").join(groups, ["digest", "size"]).where("page_id <> response").select("page_id", "digest", "response")
    revisits = revisits.distinct()
    digest = F.sha1(F.col("html").cast("binary"))
    keyed = rows.withColumn("digest", digest)
    full = keyed.join(stored(revisits, "revisits"), ["page_id", "digest"], "left")
    # Rows with a null page id find their response by payload.
    nulls = keyed.where("page_id is null").withColumn("size", F.octet_length("html").cast("long")).join(groups, ["digest", "size"], "left").select("page_id", "digest", "url", "html", "response")
    full = full.where("page_id is not null").unionByName(nulls)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = file_system(folder)
        writer, name, sink, entries = None, "", None, []

        def close() -> pa.RecordBatch:
            writer.finish()
            sink.close()
            return pa.RecordBatch.from_arrays([pa.array([e[0] for e in entries], pa.string()), pa.array([name] * len(entries), pa.string()), *[pa.array([e[k] for e in entries], pa.int64()) for k in (1, 2, 3)]], ["record_id", "bundle", "frame", "offset", "length"])

        for batch in batches:
            for page, sha, url, html, response in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if writer is None:
                    token = uuid.uuid4().hex
                    fs.create_dir(path, recursive=True)
                    name, entries = f"{folder}/{token}.warc.zst", []
                    sink = fs.open_output_stream(f"{path}/{token}.warc.zst", compression=None)
                    writer = BundleWriter(sink, frame_bytes)
                body = html.encode()
                # The response's identifier: where the payload is, by page and digest.
                part = f"{token}:{len(entries)}" if page is None else sha
                own = record_id(page, part)
                record = make_record(own, url, body, sha, len(body), None if response is None else record_id(response, sha))
                entries.append((own, *writer.add(record), len(record)))
                if writer.size + writer.held_bytes >= bundle_bytes:
                    yield close()
                    writer = None
        if writer is not None:
            yield close()

    return stored(full.select("page_id", "digest", "url", "html", "response").mapInArrow(tidy(write), INDEX), "index")


def read_archive(spark: SparkSession, index: DataFrame) -> DataFrame:
    """Every record that the index names, read from its frame: ``(record_id, record_type, digest, size, refers_to, payload)``.

    A response's digest is computed again and must agree with its header.
    """
    frames = index.groupBy("bundle", "frame").agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("places"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bundle, frame, places in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                reader = BundleReader(bundle)
                data = reader.frame(frame)
                reader.close()
                out: list[tuple] = []
                for p in places:
                    (head, http, payload), = parse_records(data[p["offset"] : p["offset"] + p["length"]])
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    size = int(http.rpartition(b"Content-Length: ")[2])
                    refers = head.get("WARC-Refers-To")
                    if refers is None and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                        raise ValueError(f"{head['WARC-Record-ID']} in {bundle} is damaged")
                    out.append((head["WARC-Record-ID"][1:-1], head["WARC-Type"], digest, size, refers and refers[1:-1], None if refers else payload))
                kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["record_id", "record_type", "digest", "size", "refers_to", "payload"])

    # By number and not by key: that exchange is neither left out nor merged into few tasks, though the index is small.
    spread = frames.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return spread.mapInArrow(tidy(read), "record_id string, record_type string, digest string, size long, refers_to string, payload binary")


def fetch(index: DataFrame, identifier: str) -> bytes:
    """One record by its identifier, from the one frame that holds it."""
    row = index.where(F.col("record_id") == identifier).first()
    if row is None:
        raise KeyError(identifier)
    reader = BundleReader(row["bundle"])
    try:
        return reader.record(row["frame"], row["offset"], row["length"])
    finally:
        reader.close()


def page_of(column: str) -> Column:
    """The page id in a record's identifier."""
    return F.expr(f"try_cast(split_part({column}, ':', 3) AS long)")
