"""Flags of candidate pairs include whether their texts have a phone number in common."""

import pytest

from tests.test_whole_job import documents
from twinlake.plans import linkage


def test_phones_in_common(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    name = "zebra crossing shop of the high street  "
    rest = ["call +91 98765-43210 now", "tel 919876543210", "é call (98765) 43210", "none", "é, +919876543210", "", "call 98765-43210, 044 2233 4455", "x 98765 43210 y", "04422334455"]
    sf = documents(tmp_path, [name + t for t in rest])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    out = con.execute(linkage.ORACLES["feat_flags"])
    columns = [c[0] for c in out.description]
    want = sorted(out.fetchall())
    rows = linkage.QUERIES["feat_flags"](spark, sf).select(*columns).collect()
    assert sorted(map(tuple, rows)) == want and len(want) == 3 * 6
    agree = {(r.s1_id, r.target_id) for r in rows if r.phone_agree == 1}
    assert agree == {(s, t) for s, ts in (("S1-0", ("S2-1", "S3-2", "S2-4", "S2-7")), ("S1-6", ("S2-1", "S3-2", "S2-4", "S2-7", "S3-8"))) for t in ts}
