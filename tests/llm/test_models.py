"""op6 and op9: held-out accuracy, no leaks, and defined cases; the pipeline against brute force."""

import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from readspark.llm import language_id, quality_classifier, queries

from .conftest import DATA, documents, rows_of, write
from .test_counts import check_sequences
from .test_documents import ITEM_WORD, WORD, decontaminated_by_hand, deduplicated_by_hand, lower
from .test_near_copies import by_hand as near_copies_by_hand

MIDDLE = "/root/testdata/sf0.01"


def held(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_op6_held_out_accuracy(spark):
    got = {r.doc_id: r for r in queries.op6_quality_classifier(spark, MIDDLE).collect()}
    assert len(got) == pq.read_table(f"{MIDDLE}/documents.parquet").num_rows
    labels = [r for r in rows_of(MIDDLE, "labels") if r["quality"] is not None]
    right = [got[r["doc_id"]].score >= 0.5 and r["quality"] == 1 or got[r["doc_id"]].score < 0.5 and r["quality"] == 0 for r in labels if held(r["doc_id"])]
    assert len(right) > 50 and np.mean(right) >= 0.9
    for r in got.values():
        assert r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)


def test_op6_reads_no_held_out_labels_and_no_other_columns(spark, tmp_path):
    docs, labels = pq.read_table(f"{DATA}/documents.parquet"), pq.read_table(f"{DATA}/labels.parquet")
    flip = [1 - r["quality"] if r["quality"] is not None and held(r["doc_id"]) else r["quality"] for r in labels.to_pylist()]
    other = labels.set_column(labels.column_names.index("quality"), "quality", pa.array(flip, labels.schema.field("quality").type))
    n = len(docs)
    changed = docs.set_column(docs.column_names.index("lang"), "lang", pa.array(["xx"] * n)).set_column(docs.column_names.index("source"), "source", pa.array(["s"] * n))
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    a = queries.op6_quality_classifier(spark, write(tmp_path / "a", docs, labels=labels)).collect()
    b = queries.op6_quality_classifier(spark, write(tmp_path / "b", changed, labels=other)).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_op6_odd_rows(spark, odd, bare):
    got = queries.op6_quality_classifier(spark, odd).collect()
    assert len(got) == len(rows_of(odd)) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out for r in got if r.doc_id is None)
    assert queries.op6_quality_classifier(spark, bare).collect() == []


def test_op6_without_labels_of_both_kinds(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality_classifier.train(docs, labels)
    assert [r.score for r in quality_classifier.score(docs, model).collect()] == [0.5, 0.5]


def test_op6_column_equals_rules(spark, plain):
    """The compiled expression gives what the rules say, one by one."""
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    model = quality_classifier.train(docs, spark.read.parquet(f"{MIDDLE}/labels.parquet"))
    assert 3 < len(model.rules) < 400 and len(model.describe()) == len(model.rules)
    own = spark.read.parquet(f"{plain}/documents.parquet")
    rows = quality_classifier.score(own.withColumn("f_", quality_classifier.statistics(own["text"])), model).collect()
    for r in rows:
        x = list(r["f_"])
        odds = model.bias + sum(w for c, w in model.rules if all((x[f] <= at) == low for f, low, at in c))
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-odds)), abs=1e-9)


def test_op9_held_out_accuracy(spark):
    rows = {r["doc_id"]: r for r in rows_of(MIDDLE)}
    got = queries.op9_language_id(spark, MIDDLE).collect()
    assert len(got) == len(rows)
    right = [r.lang_pred == rows[r.doc_id]["lang"] for r in got if r.held_out and r.lang_pred != "und" and rows[r.doc_id]["lang"] is not None and len(rows[r.doc_id]["text"]) > 200]
    assert len(right) > 100 and np.mean(right) >= 0.97
    assert all(0 <= r.score <= 1 and r.held_out == held(r.doc_id) for r in got)


def test_op9_learns_from_training_rows_only(spark, tmp_path):
    docs = pq.read_table(f"{DATA}/documents.parquet")
    ids = docs["doc_id"].to_pylist()
    langs = [None if held(i) else x for i, x in zip(ids, docs["lang"].to_pylist(), strict=True)]
    other = docs.set_column(docs.column_names.index("lang"), "lang", pa.array(langs, pa.string())).set_column(docs.column_names.index("source"), "source", pa.array(["s"] * len(docs)))
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    assert sorted(map(tuple, queries.op9_language_id(spark, write(tmp_path / "a", docs)).collect())) == sorted(map(tuple, queries.op9_language_id(spark, write(tmp_path / "b", other)).collect()))


def test_op9_odd_rows(spark, odd, bare):
    rows = rows_of(odd)
    got = queries.op9_language_id(spark, odd).collect()
    assert len(got) == len(rows)
    letterless = {r["doc_id"] for r in rows if not any(c.isalpha() for c in r["text"] or "")}
    assert letterless >= {900_001, 900_002, 900_003, 900_022, 900_023}
    for r in got:
        if r.doc_id is not None:
            assert (r.lang_pred == "und") == (r.doc_id in letterless), r
    assert queries.op9_language_id(spark, bare).collect() == []


def test_op9_distance_by_hand(spark):
    """The out-of-place distance over whole profiles."""
    train = spark.createDataFrame([("abc abd abe", "x"), ("xyz xyw xyv", "y"), (None, "y"), ("no language", None)], "text string, lang string")
    profiles = language_id.train(train, size=20)
    assert sorted(profiles) == ["x", "y"] and all(len(p) <= 20 for p in profiles.values())
    docs = spark.createDataFrame([(1, "abc"), (2, "xyz"), (3, "...")], "doc_id long, text string")
    assert [r.lang_pred for r in language_id.predict(docs, profiles, size=20).orderBy("doc_id").collect()] == ["x", "y", "und"]


# --- the pipeline ---


def by_stage(spark, folder):
    """Every stage's rows, each given its predecessor's."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [[r.asDict() for r in docs.collect()]]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        out.append([r.asDict() for r in docs.collect()])
    return out


def test_pipeline_stages(spark, plain):
    start, good, apart, cut, clean, packed = by_stage(spark, plain)
    whole = {r["doc_id"]: r for r in start}
    # 1: rows stay as they are; what goes scores below the limit.
    score = {r.doc_id: r.score for r in queries.op6_quality_classifier(spark, plain).collect()}
    assert {r["doc_id"] for r in good} == {i for i, s in score.items() if s >= 0.7}
    assert all(r == whole[r["doc_id"]] for r in good)
    # 2: one of each group of texts that share 0.8 of their five-word shingles.
    assert {str(r["doc_id"]) for r in apart} == {d for d, least in near_copies_by_hand(good) if d == least}
    assert all(r == whole[r["doc_id"]] for r in apart)
    # 3: windows that a smaller document has.
    import hashlib

    want = {d: (n, gone, sha) for d, n, gone, sha in deduplicated_by_hand(apart)}
    assert {str(r["doc_id"]) for r in cut} == {d for d, (n, gone, _) in want.items() if gone == 0 or gone < n}
    for r in cut:
        n, gone, sha = want[str(r["doc_id"])]
        assert hashlib.sha256(" ".join(WORD.findall(r["text"] or "")).encode()).hexdigest() == sha
        assert gone or r == whole[r["doc_id"]]
        assert not gone or r["n_chars"] == len(r["text"])
    # 4: no window of a test item is left, but for those that cutting makes new; documents that are mostly such windows are gone.
    hits = {d: (n, hit) for d, n, hit, *_ in decontaminated_by_hand(cut, rows_of(plain, "benchmark"))}
    assert {str(r["doc_id"]) for r in clean} == {d for d, (n, hit) in hits.items() if hit <= 0.5 * n}
    before = {r["doc_id"]: r for r in cut}
    for r in clean:
        n, hit = hits[str(r["doc_id"])]
        assert (r == before[r["doc_id"]]) if not hit else len(ITEM_WORD.findall(lower(r["text"]))) == n - hit
    # 5: all tokens of what is left.
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sizes = {r["doc_id"]: len(t.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in clean}
    got = {}
    for r in packed:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == sizes
    from types import SimpleNamespace

    check_sequences([SimpleNamespace(**r) for r in packed], 4096)


def test_pipeline_runs_and_keeps_columns(spark, odd, bare):
    assert spark.createDataFrame([], corpus_pipeline.run(spark, odd).schema).columns[:2] == ["doc_id", "piece"]
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, odd)
        assert docs.columns == documents(extra=True).column_names
        assert docs.count() > 100
    # Other columns keep their values, whatever their names.
    before = {r["my col"]: r for r in rows_of(odd)}
    for row in docs.collect():
        was = before[row["my col"]]
        assert all(row[c] == was[c] for c in docs.columns if c not in ("text", "n_chars"))
        assert row["text"] == was["text"] or row["n_chars"] == len(row["text"]) < was["n_chars"]
    assert corpus_pipeline.run(spark, bare).collect() == []


def test_pipeline_run_equals_stages(spark):
    a = corpus_pipeline.run(spark, DATA).select("doc_id", "piece", "start", "length", "ids_crc32").collect()
    b = by_stage(spark, DATA)[-1]
    assert sorted(map(tuple, a)) == sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in b)


def test_tables_have_rows_of_each_kind():
    docs = documents(extra=True)
    assert docs["doc_id"].null_count == 2 and pc.count_distinct(docs["doc_id"]).as_py() < len(docs) - 2
