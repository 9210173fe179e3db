"""Keys, posting lists and the comparison of names are made in rounds, so that what they shuffle is never on disk all at once."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.test_whole_job import documents
from twinlake.plans import linkage
from twinlake.sources import staging


@pytest.mark.parametrize("name", ["assign_ownership", "candidate_recall", "decision_secondary", "error_taxonomy", "group_metrics"])
def test_rounds_give_what_the_sql_gives(spark, tmp_path, monkeypatch, name):
    duckdb = pytest.importorskip("duckdb")
    monkeypatch.setattr(staging, "ROUND", 1000, raising=False)
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(240).collect()
    texts = [(x.text or "")[:160] for x in rows]
    sf = documents(tmp_path, [*texts, *texts[:60]], range(300))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    out = con.execute(linkage.ORACLES[name])
    columns = [c[0] for c in out.description]
    key = lambda row: tuple(f"{v:.5f}" if isinstance(v, float) else str(v) for v in row)
    want = sorted(map(key, out.fetchall()))
    written, writer = Counter(), type(spark.range(0).write)
    monkeypatch.setattr(writer, "parquet", lambda self, path, *a, f=writer.parquet, **b: (written.update(re.findall(r"/(keys|lists|probable)-", path)), f(self, path, *a, **b))[1])
    got = sorted(map(key, linkage.QUERIES[name](spark, sf).select(*columns).collect()))
    assert got == want and len(got) > 0
    assert written == {"keys": 4, "lists": 4} | ({} if name == "candidate_recall" else {"probable": 4})


def test_each_row_is_in_one_round(spark):
    rows = spark.createDataFrame([("en", f"k{i}") for i in range(500)] + [(None, f"k{i}") for i in range(50)], "country string, key string")
    parts = [rows.where(staging.in_round(i, 4, "country", "key")).count() for i in range(4)]
    assert sum(parts) == 550 and max(parts) < 250
    back = staging.stage_rounds((rows.where(staging.in_round(i, 4, "key")) for i in range(4)), "x")
    assert back.count() == 550 and back.distinct().count() == 550 and back.where(F.col("country").isNull()).count() == 50
    assert staging.rounds_of(back) == 1 and staging.rounds_of(rows) == 1
