"""FASTQ, blocks, the coder, the container, the command line and streams."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from readspark import cli
from readspark.functions.information import cumulative_frequencies, frequencies
from readspark.operators import blocks, models
from readspark.functions.keys import spec_of
from readspark.sources import container, fastq, rans
from readspark.session import ship
from readspark.streaming import counts

BASES = "NACTG"
READS = "read_id long, identifier string, acids array<int>, quals array<int>"


def some_reads(n, longest, seed=1):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        size = rng.choice([0, 1, rng.randrange(longest), longest])
        out.append((k, "" if k % 7 == 0 else f"id {k}/1 é", [rng.randrange(5) for _ in range(size)], [min(93, int(rng.expovariate(0.1))) for _ in range(size)]))
    return out


def frame(spark, rows):
    return ship(spark).createDataFrame(rows, READS).withColumn("n", F.size("acids"))


def text_of(rows):
    return "".join(f"@{i}\n{''.join(BASES[x] for x in a)}\n+\n{''.join(chr(x + 33) for x in q)}\n" for _, i, a, q in rows)


def found(df):
    return [(r.identifier, list(r.acids), list(r.quals)) for r in df.orderBy("read_id").collect()]


def put(tmp_path, data: bytes) -> str:
    (tmp_path / "in.fastq").write_bytes(data)
    return f"file://{tmp_path}/in.fastq"


@pytest.mark.parametrize("split", [64, 501, 1 << 20])
def test_fastq_is_the_same_in_any_split(spark, tmp_path, split):
    """Titles, qualities that begin like titles, and blank lines before titles."""
    rows = some_reads(120, 60)
    rows[5] = (5, "@odd", [1, 2, 3], [31, 10, 31])  # qualities "@+@"
    rows[6] = (6, "+odd", [1], [10])
    path = put(tmp_path, ("\n \n" + text_of(rows)).encode())
    df = fastq.read_fastq(ship(spark), path, split_bytes=split)
    assert found(df) == [r[1:] for r in rows]
    assert [r.read_id for r in df.orderBy("read_id").collect()] == list(range(120))
    assert df.agg(F.sum("size")).first()[0] == len(text_of(rows).encode()) + 3


def test_fastq_ends(spark, tmp_path):
    """An empty file, blank lines only, an empty read, a record that is cut off, a last line without its end."""
    ship(spark)
    for data, want in ((b"", []), (b"\n", []), (b"@seq\n\n+\n\n", [("seq", [], [])]), (b"@a\nAC\n+\nII\n@b\nAC\n+\n", [("a", [1, 2], [40, 40])]), (b"@a\nAC\n+a\nII", [("a", [1, 2], [40, 40])])):
        assert found(fastq.read_fastq(spark, put(tmp_path, data))) == want, data
    path = put(tmp_path, b"@a;AC;+;II;")
    assert found(fastq.read_fastq(spark, path, delimiter=";")) == [("a", [1, 2], [40, 40])]


@pytest.mark.parametrize(
    ("data", "says"),
    [(b"@a\nAXC\n+\nIII\n", "Invalid acid: `X`"), (b"@a\nAC\n+\nI\x07\n", "Invalid quality score: `\x07`"), (b"@a\nA\n+\nIII\n", "Length of acids and quality scores differs"), (b"a\nA\n+\nI\n", "Invalid FASTQ format"), (b"@a\nA\n-\nI\n", "Invalid FASTQ format"), (b"@a\r\nAC\r\n+\r\nII\r\n", "Invalid acid: `\r`")],
)
def test_fastq_errors(spark, tmp_path, data, says):
    with pytest.raises(Exception) as e:
        fastq.read_fastq(ship(spark), put(tmp_path, data)).collect()
    assert says.split("`")[0] in str(e.value)


def test_fastq_written_and_read(spark, tmp_path):
    rows = some_reads(50, 40)
    for k, title in enumerate((False, True)):
        fastq.write_fastq(frame(spark, rows), f"file://{tmp_path}/out{k}", title, files=3)
        assert found(fastq.read_fastq(spark, f"file://{tmp_path}/out{k}")) == [r[1:] for r in rows]
    # Parts by name, one behind the other, are the file.
    parts = sorted((tmp_path / "out0").glob("part-*"))
    assert b"".join(p.read_bytes() for p in parts).decode() == text_of(rows)


def test_rans():
    rng = np.random.default_rng(1337)
    for size in (2, 5, 94):
        freq = frequencies(cumulative_frequencies(rng.dirichlet(np.full(size, 0.3))))
        start = np.cumsum(freq) - freq
        lengths = np.array([4096, 0, 1, 77, 500])
        symbols = rng.choice(size, (5, 4096), p=freq / freq.sum())
        data = rans.encode(freq[symbols], start[symbols], lengths, 14)
        for i, n in enumerate(lengths):
            bits = (14 - np.log2(freq[symbols[i, :n]])).sum()
            assert abs(len(data[i]) - (4 + bits / 8)) <= 2
        decoder = rans.Decoder(data, 14)
        got = np.zeros_like(symbols)
        for k in range(4096):
            live = np.flatnonzero(lengths > k)
            slot = decoder.slots(live)
            s = np.searchsorted(start, slot, "right") - 1
            decoder.advance(live, freq[s], start[s])
            got[live, k] = s
        for i, n in enumerate(lengths):
            assert (got[i, :n] == symbols[i, :n]).all()
    # Fixed value: 500 symbols that are nearly certain take 4 bytes.
    f = np.full((1, 500), 65340)
    assert len(rans.encode(f, np.zeros_like(f), np.array([500]), 16)[0]) == 4


@pytest.mark.parametrize("identifiers", [True, False])
@pytest.mark.parametrize("options", [{"quality": 1}, {"quality": 7}, {"quality": 9}, {"fast": True}])
def test_container_round_trip(spark, tmp_path, identifiers, options):
    rows = some_reads(90, 50)
    table, coders = container.compress_reads(frame(spark, rows), ["generic_ao1_qo0_pb0", "light_ao2_qo3_pb2_qm8"], ["generic_ao0_qo1_pb0", "dummy"], max_block=500, identifiers=identifiers, **options)
    table = table.cache()
    assert table.count() > 3
    path = f"file://{tmp_path}/reads.rspk"
    container.export_file(table, coders, path)
    back = container.read_file(spark, path, coders).withColumn("read_id", F.col("block_index") * 1000 + F.col("place"))
    assert found(back) == [(r[1] if identifiers else "", *r[2:]) for r in rows]
    sums = blocks.compression_stats(table).first()
    assert sums["in_bytes"] == sum((len(r[1].encode()) if identifiers else 0) + 2 * len(r[2]) + 6 for r in rows)
    table.unpersist()


def test_container_errors(spark, tmp_path):
    table, coders = container.compress_reads(frame(spark, some_reads(20, 30)), ["dummy"], ["dummy"])
    path = tmp_path / "x"
    container.export_file(table, coders, f"file://{path}")
    raw = path.read_bytes()
    with pytest.raises(container.UnknownModel):
        container.read_file(spark, f"file://{path}", coders[:1])
    path.write_bytes(raw[:4] + b"\x02" + raw[5:])
    with pytest.raises(container.InvalidVersion):
        container.read_file(spark, f"file://{path}", coders)
    path.write_bytes(b"nope" + raw[4:])
    with pytest.raises(container.ContainerError):
        container.read_file(spark, f"file://{path}", coders)
    block = bytes(table.first()["payload"])
    assert len(container.decode_block(block, coders)) == 20
    with pytest.raises(container.ChecksumMismatch):
        container.decode_block(struct.pack(">II", len(block) - 8, 1) + block[8:], coders)
    with pytest.raises(container.InvalidModelIndex):
        container.decode_block(struct.pack(">IIBB", 2, 0, 1, 9), coders)
    with pytest.raises(container.NoActiveModel):
        container.decode_block(struct.pack(">IIBII", 9, 0, 2, 0, 0), coders)


def test_blocks(spark):
    rows = [(k, f"r{k}", [1] * n, [2] * n) for k, n in enumerate([40, 50, 20, 30, 50, 0, 1])]
    df = frame(spark, rows)
    packed = blocks.pack_blocks(df, 100)
    assert [r.block_index for r in packed.orderBy("read_id").collect()] == [0, 0, 1, 1, 1, 1, 2]
    want = {}
    for (_, i, a, q), b in zip(rows, [0, 0, 1, 1, 1, 1, 2], strict=True):
        want[b] = zlib.crc32(i.encode() + bytes(a) + bytes(q), want.get(b, 0))
    assert {r.block_index: r.checksum for r in blocks.checksums(df, packed).collect()} == want
    with pytest.raises(Exception, match="too long"):
        blocks.pack_blocks(df, 90).collect()
    many = blocks.pack_blocks(df, 100, partitions=3).join(df.select("read_id"), "read_id").groupBy("block_index").agg(F.sum("n").alias("n")).collect()
    assert sum(r.n for r in many) == 191 and max(r.n for r in many) <= 100
    assert blocks.drop_identifiers(df).orderBy("read_id").first()["size"] == 2 + 80 + 6
    chunks = blocks.rechunk(df, 60)
    assert [(r.first_read, r.last_read, r.n) for r in chunks.collect()] == [(0, 1, 90), (2, 4, 100)]
    joined = blocks.joined_chunks(df, chunks).orderBy("chunk").collect()
    assert [r.n for r in joined] == [90, 100]
    assert [blocks.format_bytes(x) for x in (12, 1500, 2.5e9)] == ["12 B", "1.50 kB", "2.50 GB"]


def test_command_line(spark, tmp_path, capsys):
    rows = some_reads(60, 40)
    path = put(tmp_path, text_of(rows).encode())
    m, run = f"file://{tmp_path}/models", lambda *a: cli.main([str(x) for x in a], ship(spark))
    run("stats", path)
    assert "A: " in capsys.readouterr().err
    run("generate-model", "acids", "generic_ao2_qo0_pb0", path, "-o", m)
    run("generate-model", "q-scores", "generic_ao0_qo1_pb0", path, "-o", m)
    run("generate-model", "acids", "generic_ao8_qo0_pb0", path, "-o", f"{m}-big", "--limit", 5)
    said = capsys.readouterr().err
    assert "25 contexts" in said and "Too big" in said and not (tmp_path / "models-big").exists()
    first = [r[0] for r in models.load(spark, m).where("model_type = 'acids'").select("model_id").distinct().collect()][0]
    run("bin-contexts", m, "-o", m, "-c", 4, "--model", first[:8])
    run("bin-contexts-all", m, f"file://{tmp_path}/all", "binned", "--csv", "-n", 3, "--model", first[:8], "--pre-bin", 10)
    lines = capsys.readouterr().out.split("\n")
    assert lines[0] == "filename,context number,rate" and lines[1].startswith("binned_1,1,") and len(lines) == 5
    for quality in (1, 7):
        run("compress", path, "-o", f"file://{tmp_path}/c{quality}", "--models", m, "--block-length", 400, "--quality", quality)
        run("decompress", f"file://{tmp_path}/c{quality}", "-o", f"file://{tmp_path}/d{quality}", "--models", m)
        assert found(fastq.read_fastq(spark, f"file://{tmp_path}/d{quality}")) == [r[1:] for r in rows]
    run("rechunk", path, f"file://{tmp_path}/re", "--seq-length", 100)
    again = fastq.read_fastq(spark, f"file://{tmp_path}/re")
    assert again.agg(F.min("n")).first()[0] >= 100
    with pytest.raises(SystemExit):
        run("generate-model", "acids", "no_such_type", path)


def test_generate_all_models(spark, tmp_path, capsys, monkeypatch):
    few = {n: spec_of(n) for n in ("dummy", "generic_ao1_qo0_pb0")}
    monkeypatch.setattr(cli, "KEY_TYPES", few)
    path = put(tmp_path, text_of(some_reads(20, 30)).encode())
    cli.main(["generate-model-all", path, f"file://{tmp_path}", "out", "--csv", "--limit", "4"], ship(spark))
    lines = capsys.readouterr().out.strip().split("\n")
    assert lines[0] == "model type,spec type,rate,context num" and len(lines) == 5
    assert any("1000000.0,4" in x for x in lines)


def test_stream_of_counts(spark, tmp_path):
    """Three files in three batches, and a batch that is run again, give the counts of all reads."""
    rows = some_reads(60, 30)
    for k in range(3):
        frame(spark, rows[k::3]).coalesce(1).write.parquet(f"{tmp_path}/in{k}")
        (tmp_path / "src").mkdir(exist_ok=True)
        next((tmp_path / f"in{k}").glob("*.parquet")).rename(tmp_path / "src" / f"{k}.parquet")
    stream = spark.readStream.schema(READS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/src")
    counts.count_stream(stream, "generic_ao2_qo0_pb0", "acids", f"{tmp_path}/state").awaitTermination()
    want = models.context_counts(frame(spark, rows), spec_of("generic_ao2_qo0_pb0"), "acids")
    assert sorted(map(tuple, counts.totals(spark, f"{tmp_path}/state").collect())) == sorted(map(tuple, want.collect()))
    counts.compact(spark, f"{tmp_path}/state", f"{tmp_path}/all")
    assert spark.read.parquet(f"{tmp_path}/all").count() == want.count()
