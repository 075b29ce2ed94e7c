"""What the work grows with: no row for a symbol, all reads, and lengths alone through one task."""

import random
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from readspark import catalog
from readspark.functions import symbols
from readspark.functions.information import cumulative_frequencies, frequencies
from readspark.functions.keys import KEY_TYPES, spec_of
from readspark.operators import blocks, models, select
from readspark.sources import container, fastq

from .conftest import DATA
from .test_models import keys_by_hand

SMALL = f"{DATA}/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def written(tmp_path, texts):
    pq.write_table(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts}), f"{tmp_path}/documents.parquet")
    return str(tmp_path)


COUNTED = ["model_rates_all", "too_big_models", "model_rates_every_type", "model_rate_single", "ctx_counts_generic", "ctx_counts_light", "ctx_counts_position", "symbol_stats_quals", "missing_models"]


@pytest.mark.parametrize("name", COUNTED)
def test_no_row_for_a_symbol(spark, name):
    assert "Generate" not in plan(catalog.QUERIES[name](spark, SMALL))


@pytest.mark.parametrize("window", [1, 7, 1 << 18])
def test_counts_in_windows(monkeypatch, window):
    """All key types, reads over the ends of windows, tables and sorted runs, rows given before the end."""
    rng = random.Random(3)
    reads = [([rng.randrange(5) for _ in range(n)], [rng.randrange(94) for _ in range(n)]) for n in (0, 1, 30, 0, 9, 2, 0)]
    batch = pa.RecordBatch.from_pydict({"acids": [a for a, _ in reads], "quals": [q for _, q in reads]}, schema=pa.schema([("acids", pa.list_(pa.int32())), ("quals", pa.list_(pa.int32()))]))
    monkeypatch.setattr(symbols.Reads.windows, "__defaults__", (window,))
    sets = [(s, kind) for s in KEY_TYPES.values() for kind in ("acids", "q_scores")]
    for few in (1 << 22, 0):
        monkeypatch.setattr(symbols.Tally, "TABLE", few)
        got: Counter = Counter()
        for part in symbols.counted(iter([batch, batch]), sets, rows=5):
            for r in part.to_pylist():
                got[r["set"], r["spec"], r["symbol"]] += r["n"]
        want: Counter = Counter()
        for j, (s, kind) in enumerate(sets):
            for a, q in reads:
                for key, symbol in zip(keys_by_hand(s.name, a, q), a if kind == "acids" else q, strict=True):
                    want[j, key, symbol] += 2
        assert got == want


def test_full_tallies_are_given(monkeypatch):
    """More distinct codes than a task may hold."""
    monkeypatch.setattr(symbols.Tally, "TABLE", 0)
    tally = symbols.Tally(1 << 40)
    tally.run, tally.held = 10, 50
    rng = random.Random(5)
    got, want, times = Counter(), Counter(), 0
    for _ in range(200):
        codes = [rng.randrange(100) << rng.choice([0, 30]) for _ in range(7)]
        want.update(codes)
        tally.add(symbols.np.array(codes))
        if tally.full:
            times += 1
            for k, n in zip(*tally.take(), strict=True):
                got[int(k)] += int(n)
    for k, n in zip(*tally.take(), strict=True):
        got[int(k)] += int(n)
    assert got == want and times > 1


def test_symbols_outside_the_alphabet():
    batch = pa.RecordBatch.from_pydict({"acids": pa.array([[5]], pa.list_(pa.int32())), "quals": pa.array([[0]], pa.list_(pa.int32()))})
    with pytest.raises(ValueError, match="base"):
        symbols.Reads(batch)


def test_sizes_are_summed_within_a_read(spark, monkeypatch):
    """No row for a symbol, and the sizes of models that are too large to be sent."""
    r = catalog.reads(spark, SMALL)
    found = [(s, models.contexts(models.context_counts(r, KEY_TYPES[s], "acids"), 5)) for s in catalog.CHOICE]
    sizes = select.read_sizes(r, found, "acids", 5)
    assert plan(sizes).count("Generate") == 1  # of models
    got = sorted(map(tuple, sizes.collect()))
    monkeypatch.setattr(select, "SENT", 0)
    assert sorted(map(tuple, select.read_sizes(r, found, "acids", 5).collect())) == got


def test_medoids_are_of_all_reads(spark, tmp_path):
    """reads beyond the first block count."""
    texts = ["".join(chr(97 + (i * k) % 7) for i in range(60_000)) for k in range(12)]
    rows = catalog.QUERIES["model_medoids"](spark, written(tmp_path, texts)).collect()
    assert sum(r.n_reads for r in rows) == 12


def test_medoid_sums_equal_medoids(spark):
    rng = random.Random(8)
    sizes = spark.createDataFrame([(r, m, rng.randrange(10, 30)) for r in range(200) for m in range(5)], "read_id long, model_idx int, bytes long")
    for k in (1, 2, 5, 7):
        assert select.medoid_sums(sizes, k) == [(m, len(g)) for m, g in select.medoids(sizes, k)]
    assert select.medoid_sums(sizes.where(F.lit(False)), 2) == []


def walks(sizes, block, chunk):
    """Blocks and chunks by one walk over all reads."""
    at, held, packed = 0, None, []
    for k, n in enumerate(sizes):
        if held is not None and held + n > block:
            at, held = at + 1, 0
        held = (held or 0) + n
        packed.append((k, n, at))
    out, first, held = [], None, 0
    for k, n in enumerate(sizes):
        first = k if first is None else first
        held += n
        if held >= chunk:
            out.append((len(out), first, k, held))
            first, held = None, 0
    return packed, out


@pytest.mark.parametrize("seed", range(6))
def test_ranges_are_one_walk(spark, seed):
    """F12 to F15: blocks and chunks over the borders of ranges, reads without symbols and reads longer than blocks."""
    rng = random.Random(seed)
    sizes = [rng.choice([0, 0, 1, 3, rng.randrange(40), 120][: rng.choice([3, 5, 6])]) for _ in range(60)] if seed else [0] * 5
    df = spark.createDataFrame(list(enumerate(sizes)), "read_id long, n int")
    for room in (1, 50, 5000):
        packed, chunks = walks(sizes, room, room)
        assert sorted(map(tuple, blocks.pack_blocks(df, room, any_length=True).collect())) == packed
        assert sorted(map(tuple, blocks.rechunk(df, room).collect())) == chunks


def test_no_task_reads_all_texts(spark, tmp_path):
    """F12 to F15: lengths are exchanged by ranges, none passes through one task."""
    path = written(tmp_path, ["x" * 1000] * 50)
    for name in ("block_packing", "block_stats", "block_checksums", "rechunk_reads"):
        df = catalog.QUERIES[name](spark, path)
        df.collect()
        assert "Coalesce" not in df._jdf.queryExecution().executedPlan().toString(), name
    none = written(tmp_path, pa.array([], pa.string()))
    assert [catalog.QUERIES[x](spark, none).count() for x in ("block_packing", "rechunk_reads")] == [0, 0]


@pytest.mark.parametrize("alone", [0, 3, 100])
def test_blocks_are_coded_side_by_side(monkeypatch, alone):
    """several blocks at once give the bytes of each alone, and a step is taken by all their reads."""
    np = symbols.np
    monkeypatch.setattr(container, "ALONE", alone)
    rng = np.random.default_rng(6)
    coders = []
    for kind, name, size in (("acids", "generic_ao2_qo0_pb2", 5), ("acids", "light_ao1_qo2_pb0_qm8", 5), ("q_scores", "generic_ao0_qo1_pb0", 94)):
        keys = np.sort(rng.choice(200, 60, replace=False))
        freqs = [frequencies(cumulative_frequencies(rng.dirichlet(np.full(size, 0.3)))) for _ in range(61)]
        coders.append(container.Coder(kind, spec_of(name), keys, np.arange(1, 61), np.array([np.cumsum(f) - f for f in freqs]), np.array(freqs), name.encode()))
    rows = [[(f"r{b}", rng.integers(0, 5, n).astype(np.uint8), rng.integers(0, 94, n).astype(np.uint8), int(rng.integers(2)), 2) for n in rng.integers(0, 90, 7)] for b in range(5)]
    together = container.encode_blocks(rows, coders)
    assert together == [container.encode_block(r, coders) for r in rows]
    back = container.decode_blocks([data for data, _ in together], coders)
    assert [[(n, a.tolist(), q.tolist()) for n, a, q in own] for own in back] == [[(n, a.tolist(), q.tolist()) for n, a, q, *_ in own] for own in rows]
    # Without the tables of few keys and few rows.
    for c in coders:
        c.__dict__.pop("one_by_one", None)
        c.__dict__.update(rows_of_keys=None, of_slots=None)
    assert [data for data, _ in container.encode_blocks(rows, coders)] == [data for data, _ in together]
    assert [[a.tolist() for _, a, _ in own] for own in container.decode_blocks([data for data, _ in together], coders)] == [[a.tolist() for _, a, *_ in own] for own in rows]


def test_records_leave_the_reader_in_batches(tmp_path):
    """no row of Python lists for a record."""
    (tmp_path / "in.fastq").write_bytes(b"@a\nAC\n+\nI!\n@b\n\n+\n\n")
    reader = fastq.FastqReader({"path": f"file://{tmp_path}/in.fastq"})
    parts = [b for p in reader.partitions() for b in reader.read(p)]
    assert all(isinstance(b, pa.RecordBatch) for b in parts)
    assert [r for b in parts for r in b.to_pylist()] == [{"part": 0, "place": 0, "identifier": "a", "acids": [1, 2], "quals": [40, 0], "size": 11}, {"part": 0, "place": 1, "identifier": "b", "acids": [], "quals": [], "size": 7}]
