"""Every query against its SQL in DuckDB, on the smallest tables."""

import inspect
import os

import duckdb
import pytest

import __spark_entry__
from readspark import catalog

from .conftest import DATA

SMALL = f"{DATA}/sf0.001"
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
#: Queries whose results SQL can't give; each has a test against plain Python.
WITHOUT_SQL = {"model_rates_every_type", "binned_model", "bin_sweep", "cum_freqs", "model_medoids", "block_checksums"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SMALL):
        con.execute(f"create view {name.split('.')[0]} as select * from '{SMALL}/{name}'")
    return con


def plain(x):
    if isinstance(x, float):
        return round(x, 6) + 0.0
    return [plain(y) for y in x] if isinstance(x, list) else x


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SMALL)
    got = sorted(repr([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    duck.execute(catalog.ORACLE_SQL[name])
    columns = [(d[0], str(d[1])) for d in duck.description]
    rows = duck.fetchall()
    at = [[c for c, _ in columns].index(c) for c in sorted(df.columns)]
    assert len(columns) == len(df.columns)
    assert {c: KINDS[k] for c, k in df.dtypes} == dict(columns)
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in rows)
    assert got


def test_queries_and_sql_have_the_same_names():
    assert set(catalog.QUERIES) - set(catalog.ORACLE_SQL) == WITHOUT_SQL
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_queries_without_sql_run(spark, name):
    if name != "model_rates_every_type":  # its rates are tested in test_models
        assert catalog.QUERIES[name](spark, SMALL).collect()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 5
    assert all(len(inspect.signature(f).parameters) == 2 for f in __spark_entry__.queries().values())
