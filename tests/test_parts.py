"""Small parts that the queries don't reach: Unicode forms, fingerprints, ledgers, audits, sweeps."""

import gzip
import os
import unicodedata

import pytest
from pyspark.sql import functions as F

from twinlake.functions import text as X
from twinlake.operators import matcher as M
from twinlake.operators import metrics as ME
from twinlake.sources import tables as T


def test_indic_texts_are_composed(spark):
    texts = ["क़लम", "क़लम", "ऩ", "ऩ", "রো", "ொ", "ೋ", "ＡＢ राम ﬁ ½ ²", "ẞ राम é", "ড়"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.clean_unicode(F.col("t")).alias("c")).collect()
    assert [r.c for r in rows] == [unicodedata.normalize("NFKC", r.t) for r in rows]
    plain = spark.createDataFrame([("Crème ﬁne ½",)], "t string").select(X.clean_unicode(F.col("t")).alias("c")).first().c
    assert plain == "Creme fine 1⁄2"


def test_fingerprint_follows_content(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    a.write_bytes(b"x" * 200_000)
    b.write_bytes(b"")
    print_of = lambda: T.fingerprint(spark, [f"file://{a}", f"file://{b}"])
    stamp, before = os.stat(a), print_of()
    assert print_of() == before
    a.write_bytes(b"x" * 199_999 + b"y")
    os.utime(a, ns=(stamp.st_atime_ns, stamp.st_mtime_ns))
    assert print_of() != before


def test_ledger_and_tables(spark, tmp_path):
    T.append_ledger(spark, f"file://{tmp_path}/ledger", run=1, f=0.5)
    T.append_ledger(spark, f"file://{tmp_path}/ledger", run=2, f=0.75)
    assert sorted((r.run, r.f) for r in T.read_ledger(spark, f"file://{tmp_path}/ledger").collect()) == [(1, 0.5), (2, 0.75)]
    with gzip.open(tmp_path / "scores.json.gz", "wt") as f:
        f.write('{"a": "S1-1", "p": 0.5}\n')
    assert T.read_ledger(spark, f"file://{tmp_path}/scores.json.gz").first().p == 0.5
    (tmp_path / "t.csv").write_text("a,b\n1,\n")
    assert tuple(T.read_dict_rows(spark, f"file://{tmp_path}/t.csv", sep=",").first()) == ("1", None)
    names = spark.createDataFrame([("India",), ("Côte d'Ivoire",)], "c string").select(T.partition_name(F.col("c")).alias("n")).collect()
    assert names[0].n == "India" and len(names[1].n) == 40
    T.write_json(spark, f"file://{tmp_path}/x.json", {"a": [1, "é"]})
    assert T.read_json(spark, f"file://{tmp_path}/x.json") == {"a": [1, "é"]}


def test_audits_and_sweeps(spark):
    got = spark.createDataFrame([("",), ("ngram",), ("addr,ngram",)], "s string").select(ME.miss_category(F.col("s")).alias("c")).collect()
    assert [r.c for r in got] == ["no_shared_key", "ngram_only", "ranking_or_pruned_key"]
    pairs = spark.createDataFrame([(1, 0.1, 0.2), (1, 0.1, 0.3), (0, 0.0, 0.0)], "is_match int, a double, b double")
    assert tuple(ME.unlearnable(pairs, ["a", "b"]).first()) == (2, 1)
    f = spark.range(300).select((F.col("id") % 10 / 10).alias("x"), (F.col("id") % 10 > 6).cast("int").alias("is_match"), F.lit(1.0).alias("weight"))
    found = M.sweep(f, f, ["x"], [{"rounds": 1, "depth": 1}, {"rounds": 2, "depth": 3}])
    assert len(found) == 2 and found[0][1] >= found[1][1] and found[0][1] == pytest.approx(1.0)
