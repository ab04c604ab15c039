import duckdb
import pytest

from logsieve.llm.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    rel = con.sql(ORACLES[name])
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    assert sorted(rel.columns) == columns
    place = [rel.columns.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == sorted((tuple(r[i] for i in place) for r in rel.fetchall()), key=str)
