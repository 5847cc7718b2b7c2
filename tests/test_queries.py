"""Every registered query runs, and gives what its SQL gives."""

import math

import duckdb
import pytest

from quillspark import queries as base

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return int(value) if isinstance(value, bool) else value


@pytest.mark.parametrize("name", sorted(base.queries()))
def test_query(spark, duck, name):
    df = base.queries()[name](spark, DATA)
    rows = df.collect()
    sql = base.oracle_sql().get(name)
    if sql is None:
        return
    found = duck.execute(sql)
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(repr([plain(r[columns.index(c)]) for c in sorted(columns)]) for r in found.fetchall())
    assert sorted(repr([plain(r[c]) for c in sorted(columns)]) for r in rows) == want
