"""The queries that have SQL, against it, on the smallest tables."""

import pytest

from twinlake.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_agrees_with_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    out = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in out.description]
    key = lambda row: tuple(f"{v:.6g}" if isinstance(v, float) else str(v) for v in row)
    want = sorted(map(key, out.fetchall()))
    df = queries.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(columns) and want
    assert sorted(key([r[c] for c in columns]) for r in df.collect()) == want
