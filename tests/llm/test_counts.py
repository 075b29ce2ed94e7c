"""op1, op2, op4, op8: against plain Python on whole tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from readspark.llm import packing, quality_rules, queries, warc

from .conftest import rows_of, write

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("folder", ["plain", "odd"])
def test_op2_counts(spark, request, folder):
    folder = request.getfixturevalue(folder)
    got = queries.op2_quality_rules(spark, folder).collect()
    want = []
    for r in rows_of(folder):
        text = r["text"] or ""
        w = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        hit = set()
        for i in range(len(w) - 2):
            if grams[tuple(w[i : i + 3])] > 1:
                hit |= {i, i + 1, i + 2}
        n = len(w)
        want.append((str(r["doc_id"]), n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), n < 50 or 100 * len(hit) > 50 * n))
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == sorted(want)
    assert not any(r.kept and r.base_failed for r in got)
    # Clean prose stays: most of what passes the base is kept.
    passed = [r for r in got if not r.base_failed]
    assert sum(r.kept for r in passed) >= 0.9 * len(passed)


def test_op2_sketch_quantiles(spark):
    """A bucket holds its values, and its floor is at most a 32nd below them."""
    values = [*range(0, 3000), 10**5, 10**9, 2**40]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    b = quality_rules.bucket(df["v"])
    for r in df.select("v", b.alias("b"), quality_rules.bucket_floor(b).alias("low")).collect():
        assert r.low <= r.v < r.low + max(1, r.low / 32) + 1e-9, r


@pytest.mark.parametrize("folder", ["plain", "odd"])
def test_op8_against_library(spark, request, folder):
    folder = request.getfixturevalue(folder)
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = rows_of(folder)
    want = []
    for r in rows:
        n = len(t.encode(r["text"] or "", add_special_tokens=False).ids)
        want.append((str(r["doc_id"]), len((r["text"] or "").encode()), n, n > 512))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op8_token_counts(spark, folder).collect()) == sorted(want)


@pytest.mark.parametrize("folder", ["plain", "odd"])
def test_op4_pieces_and_places(spark, request, folder):
    folder = request.getfixturevalue(folder)
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = queries.op4_packing(spark, folder).collect()
    want = []
    for r in rows_of(folder):
        ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want.append((str(r["doc_id"]), k, at, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    check_sequences(got, 4096)
    n = len({r.sequence_id for r in got})
    assert n <= -(-sum(r.length for r in got) // 4096) * 1.02 + 1


def check_sequences(got, capacity):
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity


def test_packing_rounds(spark):
    """Small partitions with gaps give their documents up, and what is left is packed again."""
    import numpy as np

    rng = np.random.default_rng(3)
    items = spark.createDataFrame([(i, int(x)) for i, x in enumerate(rng.integers(20, 60, 3000))], "id long, length long")
    got = packing.pack(items, 100, pieces_each=300).collect()
    assert sorted((r.id, r.length) for r in got) == sorted((r.id, r.length) for r in items.collect())
    check_sequences(got, 100)
    lengths = np.array([r.length for r in got])
    alone = len(packing.best_fit_decreasing(lengths, 100)[2])
    n = len({r.sequence_id for r in got})
    assert packing.lower_bound(lengths, 100) <= n <= alone + 12
    assert all(0 < r.partition_bound <= r.partition_bins for r in got)


def test_packing_keeps_the_better_of_two_rounds(spark, monkeypatch):
    """A second round that takes more sequences than the first had is given up."""
    import numpy as np

    rng = np.random.default_rng(4)
    items = spark.createDataFrame([(i, int(x)) for i, x in enumerate(rng.integers(20, 60, 1500))], "id long, length long")
    once = len({r.sequence_id for r in packing.pack(items, 100, pieces_each=300, rounds=1).collect()})
    best_fit = packing.best_fit_decreasing

    def worse(lengths, capacity):
        """Each in a sequence of its own where few are left."""
        if len(lengths) >= 250:
            return best_fit(lengths, capacity)
        return np.arange(len(lengths)), np.zeros(len(lengths), np.int64), lengths

    monkeypatch.setattr(packing, "best_fit_decreasing", worse)
    monkeypatch.setattr(packing, "lower_bound", lambda lengths, capacity: 1)
    got = packing.pack(items, 100, pieces_each=300).collect()
    assert sorted((r.id, r.length) for r in got) == sorted((r.id, r.length) for r in items.collect())
    check_sequences(got, 100)
    assert len({r.sequence_id for r in got}) <= once


def test_packing_certifies_a_single_partition(spark):
    """Halves and wholes need exactly what they get; three of five eighths can't share, and the bound says so."""
    items = spark.createDataFrame([(i, x) for i, x in enumerate([50, 50, 100, 62, 62, 62])], "id long, length long")
    got = packing.pack(items, 100).collect()
    assert {(r.partition_bins, r.partition_bound) for r in got} == {(5, 5)}
    assert len({r.sequence_id for r in got}) == 5


def test_lower_bound_is_a_bound():
    import itertools

    import numpy as np

    rng = np.random.default_rng(5)

    def least(sizes, cap):
        """By trying all ways to put sizes into bins."""
        best = len(sizes)

        def go(k, rooms):
            nonlocal best
            if len(rooms) >= best:
                return
            if k == len(sizes):
                best = len(rooms)
                return
            for i, r in enumerate(rooms):
                if r >= sizes[k]:
                    go(k + 1, [*rooms[:i], r - sizes[k], *rooms[i + 1 :]])
            go(k + 1, [*rooms, cap - sizes[k]])

        go(0, [])
        return best

    for _, cap in itertools.product(range(60), (7, 12, 20)):
        sizes = rng.integers(1, cap + 1, rng.integers(1, 9))
        best = least(sorted(sizes.tolist(), reverse=True), cap)
        bins, offsets, held = packing.best_fit_decreasing(sizes, cap)
        assert packing.lower_bound(sizes, cap) <= best <= len(held)
        for b in range(len(held)):
            assert sizes[bins == b].sum() == held[b] <= cap


PAGES = [
    (1, "http://a/1", "x" * 1000), (2, "http://a/2", "x" * 1000), (3, "http://a/3", "x" * 999), (4, "http://a/4", "x" * 999),
    (5, None, None), (6, "", ""), (7, "http://a/ü\r\nInjected: yes", "é" * 600), (8, "u", "é" * 600), (9, "u", "WARC/1.1\r\n\r\n" * 200),
    (10, "u", "x" * 1000),
]


def pages_table(rows):
    cols = list(zip(*rows, strict=True))
    return pa.table({"page_id": pa.array(cols[0], pa.int64()), "url": pa.array(cols[1], pa.string()), "html": pa.array(cols[2], pa.string()), "digest": ["clash"] * len(rows), "size": [1] * len(rows)})


def test_op1_round_trip(spark, tmp_path):
    base = [(r["page_id"] + 100, r["url"], r["html"]) for r in rows_of("/root/testdata/sf0.001", "pages")]
    rows = PAGES + base
    folder = write(tmp_path, pages=pages_table(rows))
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in queries.op1_warc(spark, folder).collect()}
    groups = defaultdict(list)
    for page, _, html in rows:
        groups[(html or "").encode()].append(page)
    want = {}
    for page, _, html in rows:
        body = (html or "").encode()
        head = max(groups[body])
        revisit = len(body) >= 1000 and page != head
        want[page] = (len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", head if revisit else None)
    assert got == want


def test_warc_seek_and_damage(spark, tmp_path):
    """Frames are read alone, a plain decompressor reads the whole, and identifiers find their records."""
    import io

    import zstandard

    df = spark.createDataFrame([(i, f"http://h/{i}", f"page {i} " * (i + 1)) for i in range(200)], "page_id long, url string, html string")
    index = warc.write_archive(df.coalesce(2), f"file://{tmp_path}/arc", frame_bytes=20_000)
    rows = index.collect()
    assert len(rows) == 200 and max(r.frame for r in rows) > 3
    for r in rows[::37]:
        (head, _, payload), = warc.parse_records(warc.fetch(index, r.record_id))
        i = int(r.record_id.split(":")[2])
        assert payload.decode() == f"page {i} " * (i + 1) and head["WARC-Target-URI"] == f"http://h/{i}"
    bundle = rows[0].bundle.removeprefix("file://")
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(open(bundle, "rb").read()), read_across_frames=True).read()
    assert len(list(warc.parse_records(whole))) == sum(r.bundle == rows[0].bundle for r in rows)
    with pytest.raises(KeyError):
        warc.fetch(index, "urn:page:999:none")


def test_warc_null_and_repeated_pages(spark):
    big = "y" * 2000
    df = spark.createDataFrame([(None, "u", big), (None, "u", big), (1, "u", big), (2, "u", big), (2, "u", big), (3, None, None), (None, None, None)], "page_id long, url string, html string")
    got = warc.read_archive(spark, warc.write_archive(df)).collect()
    assert len(got) == 7
    assert sorted(r.record_type for r in got if r["size"] == 2000) == ["response", "response", "revisit", "revisit", "revisit"]


def test_empty_tables(spark, bare):
    for f in (queries.op1_warc, queries.op2_quality_rules, queries.op4_packing, queries.op8_token_counts):
        assert f(spark, bare).collect() == []


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_of_unusual_characters(name):
    """Letters, marks and spaces of many blocks, also of those that newer tables know: as the library has them."""
    import random

    from readspark.llm import _bpe, _text

    rng = random.Random(11)
    pools = [range(32, 127), range(0xA0, 0x250), range(0x300, 0x590), range(0x860, 0x8A0), range(0x1E00, 0x2070), range(0x3040, 0x30FF), range(0x10000, 0x1FFFF), [0x20, 0x0A, 0x85, 0xA0, 0x3000]]
    texts = ["".join(chr(rng.choice(rng.choice(pools))) + rng.choice(["", "", "'s", " the", " <|endoftext|>", "é"]) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    library, own, k = Tokenizer.from_file(public_tokenizers.path(name)), _bpe.load(public_tokenizers.path(name)), 0
    for block in _text.blocks(pa.array(texts), 1 << 15):
        start, length, offsets = own.lookup(block)
        for i in range(len(block)):
            ids = [int(x) for p in range(offsets[i], offsets[i + 1]) for x in own.ids[start[p] : start[p] + length[p]]]
            assert ids == library.encode(texts[k], add_special_tokens=False).ids
            k += 1
