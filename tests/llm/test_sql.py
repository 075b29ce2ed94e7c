"""Queries against their SQL; op2's verdicts by hand."""

import duckdb
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
from readspark import storage
from readspark.llm import quality_rules, queries, sql

from .conftest import DATA, documents, write


def same(spark, folder, name):
    with duckdb.connect() as c:
        for t in ("documents", "pages", "benchmark", "labels"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
        c.execute(sql.ORACLE_SQL[name])
        columns = [x[0] for x in c.description]
        want = sorted(map(repr, c.fetchall()))
    got = queries.QUERIES[name](spark, folder)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(repr(tuple(r[x] for x in columns)) for r in got.collect()) == want


@pytest.mark.parametrize("name", list(sql.ORACLE_SQL))
def test_sql(spark, name):
    same(spark, DATA, name)


@pytest.mark.parametrize("name", ["op2_quality_rules", "op7_decontaminate", "op10_substring_dedup"])
def test_sql_of_odd_rows(spark, tmp_path, name):
    """But for the longest texts, over which this SQL takes minutes."""
    docs = documents(extra=True)
    same(spark, write(tmp_path, docs.filter(pa.compute.less(pa.compute.fill_null(pa.compute.utf8_length(docs["text"]), 0), 20_000))), name)


def quartiles(values):
    """From buckets, as the sketch has them."""
    def floor(v):
        shift = max(v.bit_length() - 8, 0)
        return v >> shift << shift

    ordered = sorted(values)
    at = lambda share: floor(ordered[-(-len(ordered) * share // 4) - 1])
    return at(1), at(3)


def test_op2_fences_by_hand(spark, plain):
    measured = quality_rules.rates(quality_rules.statistics(spark.read.parquet(f"{plain}/documents.parquet")))
    rows = measured.collect()
    for t in quality_rules.thresholds(measured, least_rows=10).collect():
        own = [r for r in rows if (r.lang, r.source) == (t.lang, t.source)]
        if len(own) < 10:
            own = [r for r in rows if r.lang == t.lang]
        if len(own) < 10:
            own = rows
        for s in quality_rules.STATISTICS:
            q1, q3 = quartiles([r[s] for r in own])
            assert (t[f"{s}_low"], t[f"{s}_high"]) == (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)), (t.lang, t.source, s)


def test_op2_follows_each_group(spark):
    """One text, in a source of prose and in a source of code where such texts are usual."""
    prose = [(i, " ".join(f"wor{'d' * (j % (i % 3 + 2))}{j}" for j in range(60 + i)), "en", "prose") for i in range(60)]
    code = [(100 + i, " ".join(f"x{j} = y{j} & {'z' * (j % (i % 4 + 1) + 1)} | #{j} {'<' * (i % 5)}" for j in range(60 + i)), "en", "code") for i in range(60)]
    odd = code[7][1] + " << >> " * 9
    docs = spark.createDataFrame([*prose, *code, (500, odd, "en", "prose"), (501, odd, "en", "code")], "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: (r.base_failed, r.kept) for r in quality_rules.quality_rules(docs).collect()}
    assert kept[500] == (False, False) and kept[501] == (False, True)
    assert sum(k for _, k in kept.values()) >= 115


def test_op2_needs_two_families(spark):
    """Rare in one respect only: kept."""
    base = [(i, " ".join(f"{'ab' * (1 + j % (2 + i % 4))}{j}" for j in range(80 + i)), "en", "s") for i in range(80)]
    signs = " ".join(f"{'ab' * (1 + j % 3)}{j}" + ("#" if j % 9 == 0 else "") for j in range(80))
    docs = spark.createDataFrame([*base, (900, signs, "en", "s")], "doc_id long, text string, lang string, source string")
    row = quality_rules.quality_rules(docs).where("doc_id = 900").first()
    assert row.n_symbols and row.n_outside == 1 and row.kept


def test_op2_writes_small_tables_in_few_files(spark, plain, monkeypatch):
    """As many as cores, whatever the number of shuffle partitions; the rows stay the same."""
    files = {}

    def counted(df, name):
        out = storage.stored(df, name)
        files[name] = len(out.inputFiles())
        return out

    want = sorted(queries.op2_quality_rules(spark, plain).collect())
    monkeypatch.setattr(quality_rules, "stored", counted)
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert sorted(queries.op2_quality_rules(spark, plain).collect()) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    cores = spark.sparkContext.defaultParallelism
    assert 0 < files["sketch"] <= cores and 0 < files["thresholds"] <= cores


def test_empty_table_has_no_fences(spark, bare):
    assert pa.table({"a": []}).num_rows == len(queries.op2_quality_rules(spark, bare).collect()) == 0
