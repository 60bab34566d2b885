"""Every named query agrees with its SQL on the smallest data folder."""

import math

import pytest

import __spark_entry__ as entry_module

duckdb = pytest.importorskip("duckdb")
FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in TABLES.split():
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return c


def cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def normal(rows):
    return sorted((tuple(cell(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(entry_module.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    df = entry_module.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    result = con.execute(entry_module.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    want = normal([tuple(r[i] for i in places) for r in result.fetchall()])
    assert normal([tuple(r) for r in df.select(*columns).collect()]) == want


@pytest.mark.parametrize("name", sorted(set(entry_module.queries()) - set(entry_module.oracle_sql())))
def test_other_query_gives_rows(spark, name):
    assert entry_module.queries()[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
