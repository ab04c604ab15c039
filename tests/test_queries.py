"""Every query against its SQL, as multisets of rows with columns in order of name."""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from logsieve import queries, source_queries

QUERIES, ORACLES = queries.QUERIES | source_queries.QUERIES, queries.ORACLES | source_queries.ORACLES
SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else (round(v, 9) if isinstance(v, float) else v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in ORACLES:
        assert got
        return
    rel = duck.sql(ORACLES[name])
    place = [rel.columns.index(c) for c in columns]
    assert sorted(rel.columns) == columns
    want = Counter(tuple(plain(r[i]) for i in place) for r in rel.fetchall())
    assert want and got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
