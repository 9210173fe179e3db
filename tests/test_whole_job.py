"""Linkage queries over whole texts and with production limits; the small limits are kept here, against the SQL."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from twinlake.functions import fuzzy
from twinlake.functions import text as X
from twinlake.plans import linkage
from twinlake.sources import tables as T


def documents(path, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "lang": ["en"] * len(texts)}), str(path / "documents.parquet"))
    return str(path)


def test_records_hold_the_whole_text(spark, tmp_path):
    texts = ["x " * 100 + "tail one 98765 43210", "x " * 100 + "other end", "é" * 300, "short", "", None, "a\nb" * 60]
    sf = documents(tmp_path, texts)
    got = {r.doc_id: r.name + r.addr for r in T.records_of_documents(spark, sf).collect()}
    assert got == {i: (t or "").replace("\n", " ") for i, t in enumerate(texts)}
    words = {r.id: r.norm_addr for r in linkage.QUERIES["normalize_address"](spark, sf).collect()}
    assert words["S1-0"] != words["S2-1"] and words["S1-0"].endswith("tail one 98765 43210")
    assert {(r.key, r.target_id) for r in linkage.QUERIES["post_addr_tok"](spark, sf).collect()} >= {("other", "S2-1")}


def test_linear_forms_agree_with_plain_ones(spark):
    def jaro_matches(a, b):
        reach, free, n = max(max(len(a), len(b)) // 2 - 1, 0), [True] * len(b), []
        for i, c in enumerate(a):
            for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
                if free[j] and b[j] == c:
                    free[j] = False
                    n.append(c)
                    break
        right = [b[j] for j in range(len(b)) if not free[j]]
        return len(n) and (len(n) / len(a) + len(n) / len(b) + (len(n) - sum(x != y for x, y in zip(n, right, strict=True)) // 2) / len(n)) / 3

    r = random.Random(5)
    for _ in range(300):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(1, 30))) for _ in range(2))
        j = jaro_matches(a, b)
        same = next((k for k in range(min(4, len(a), len(b))) if a[k] != b[k]), min(4, len(a), len(b)))
        assert fuzzy.jaro_winkler(a, b) == pytest.approx(1.0 if a == b else j + same * 0.1 * (1 - j) if j > 0.7 else j)
    texts = ["abcab", "é𝒳ßaé", "ab", "", "naïve text"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for n in (2, 3, 4):
        got = [x.g for x in rows.select(X.ngram_list(rows.t, n).alias("g")).collect()]
        assert got == [[t[i : i + n] for i in range(len(t) - n + 1)] for t in texts]


def test_cross_fit_scores_every_pair(spark):
    from pyspark.sql import functions as F

    from twinlake.operators import matcher as M

    f = spark.range(400).select(F.col("id").cast("string").alias("s1_id"), F.lit("t").alias("target_id"), (F.col("id") % 10 / 10).alias("x"), F.lit(1.0).alias("weight"), (F.col("id") % 10 > 6).cast("int").alias("is_match"), (F.col("id") / 10 % 2).cast("int").alias("half"))
    p = {int(r.s1_id): r.p for r in M.cross_fit(f, ["x"], rounds=3, depth=2).collect()}
    assert len(p) == 400 and all((v > 0.5) == (i % 10 > 6) for i, v in p.items())
    one_class = f.where("half = 1 or is_match = 0")
    p = {int(r.s1_id): r.p for r in M.cross_fit(one_class, ["x"], rounds=3, depth=2).collect()}
    assert len(p) == one_class.count() and {v for i, v in p.items() if i // 10 % 2 == 1} == {0.0}


def test_end_to_end_reaches_both_halves(spark, tmp_path):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    base = [" ".join(word() for _ in range(15)) for _ in range(40)]
    sf = documents(tmp_path, [base[i // 3] for i in range(120)])
    scored = {(x.s1_id, x.target_id) for x in linkage.QUERIES["gbt_scores"](spark, sf).collect()}
    assert scored == {(x.s1_id, x.target_id) for x in linkage.QUERIES["all_features"](spark, sf).collect()}
    lists = {x.s1_id: x.ids for x in linkage.QUERIES["end_to_end"](spark, sf).collect()}
    assert lists == {f"S1-{i}": f"S2-{i + 1},S3-{i + 2}" for i in range(0, 120, 3)}


def test_a_word_shared_by_many_is_kept(spark, tmp_path):
    texts = [f"zebra {i:05d}" for i in range(300)]
    sf = documents(tmp_path, texts)
    got = {(x.s1_id, x.target_id) for x in linkage.QUERIES["join_token"](spark, sf).collect()}
    assert len(got) == 100 * 200
    assert linkage.QUERIES["prune_frequent"](spark, sf).where("key = 'zebra'").count() == 200
    assert linkage.QUERIES["topk_by_score"](spark, sf).count() == 100 * 60


@pytest.mark.parametrize("name", ["prune_frequent", "idf_ngram", "score_sum", "topk_by_score", "rerank_trigram", "rerank_adaptive", "family_quota", "feat_arrays", "resolve_ownership"])
def test_small_limits_agree_with_the_sql(spark, tmp_path, monkeypatch, name):
    """With limits, depth and budget small enough to prune something, in the query and in the SQL."""
    duckdb = pytest.importorskip("duckdb")
    from twinlake.operators import blocking as B
    from twinlake.plans import linkage_sql as S

    limits = {"token": 50, "prefix": 50, "addr": 50, "addr_tok": 50, "acronym": 50, "tokpost": 50, "ngram": 20}
    monkeypatch.setattr(linkage, "PROFILE", B.Profile(limits=limits, depth=60, budget=20))
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(300).collect()
    sf = documents(tmp_path, [(x.text or "")[:120] for x in rows], [x.doc_id for x in rows])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    out = con.execute(S.resized(linkage.ORACLES[name], limits, 60, 20))
    columns = [c[0] for c in out.description]
    key = lambda row: tuple(f"{v:.5f}" if isinstance(v, float) else str(v) for v in row)
    want = sorted(map(key, out.fetchall()))
    got = sorted(map(key, linkage.QUERIES[name](spark, sf).select(*columns).collect()))
    assert got == want and len(got) > 0
    if name == "prune_frequent":
        assert len(got) < linkage.posted(spark, sf).count()
