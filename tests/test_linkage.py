"""Scalar functions and operators of record linkage against literal expectations."""

import pytest
from pyspark.sql import functions as F

from twinlake.functions import fuzzy, phonetic
from twinlake.functions import text as X
from twinlake.operators import blocking as B
from twinlake.operators import decision as D
from twinlake.operators import matcher as M
from twinlake.operators import metrics as ME
from twinlake.operators import validation as V
from twinlake.sources import tables as T


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("name", "want"),
    [("@Café  Brûlée.com Ltd", "cafe brulee ltd"), ("www.Acme-Shop.in", "acme shop"), ("", ""), (None, ""), ("शर्मा", "शर म"), ("ﬁne ½", "fine 1 2"), ("a.company", "a company")],
)
def test_normalize_name(spark, name, want):
    assert spark.createDataFrame([(name,)], "n string").select(X.normalize_name(F.col("n")).alias("x")).first().x == want


def test_scalar_functions(spark):
    assert one(spark, X.core_tokens(F.col("n")), n="the tata steel pvt ltd x") == ["tata", "steel"]
    assert one(spark, X.normalize_address(F.col("a")), a="12 Main St., Apt 4") == "12 main street apartment 4"
    assert one(spark, X.compact_alnum(F.col("n")), n="A-1 Shop!") == "a1shop"
    assert sorted(one(spark, X.phones(F.col("a")), a="call +91 98765 43210 now")) == ["919876543210", "9876543210"]
    assert one(spark, X.ngrams(F.col("n"), 3), n="ab") == ["ab"] and one(spark, X.ngrams(F.col("n"), 3), n="") == []
    assert [one(spark, X.soundex_code(F.col("n")), n=n) for n in ("ashcraft", "pfister", "lloyd", "")] == ["A226", "P123", "L430", ""]
    assert set(one(spark, X.suffix_variants(F.col("n")), n="acme limited")) == {"acme limited", "acme ltd", "acme"}
    assert one(spark, X.acronyms(F.col("n"), F.array(F.lit("tata"), F.lit("sons"))), n="tata and sons") == ["ts", "tas"]
    assert sorted(one(spark, X.address_keys(F.col("a"), F.lit("12 main road mumbai 400001")), a="12 Main Rd Mumbai 400001")) == sorted(
        ["ST_POST|12|400001", "ST_LOC|12|main", "ST_LOC|12|mumbai", "ST_LOC|12|400001", "LOC_PAIR|main|400001", "LOC_PAIR|main|mumbai", "POSTAL|400001"]
    )
    assert one(spark, phonetic.transliterate(F.col("n")), n="शर्मा") == "sharmaa" and one(spark, phonetic.transliterate(F.col("n")), n="plain") == ""
    assert one(spark, phonetic.metaphone(F.col("n")), n="knight") == one(spark, phonetic.metaphone(F.col("n")), n="night")
    assert one(spark, X.match_bucket(F.col("n")), n=5) == "4-6"


def test_fuzzy():
    assert fuzzy.ratio("abcd", "abxd") == pytest.approx(0.75) and fuzzy.ratio("", "") == 1.0
    assert fuzzy.token_sort("b a", "a b") == 1.0 and fuzzy.token_set("a b c", "a b") == 1.0 and fuzzy.token_set("", "a") == 0.0
    assert fuzzy.partial_ratio("abc", "xxabcxx") == 1.0 and fuzzy.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    import itertools

    def slow(a, b):
        best = 0
        for n in range(len(a), 0, -1):
            for c in itertools.combinations(a, n):
                i = iter(b)
                if all(x in i for x in c):
                    return n
        return best

    for a, b in [("kitten", "sitting"), ("abab", "baba"), ("xyz", "zyx")]:
        assert fuzzy.common(a, b) == slow(a, b)


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_macro_f05(spark):
    s1 = table(spark, [("a",), ("b",), ("c",)], "s1_id string")
    truth = table(spark, [("a", "1"), ("a", "2")], "s1_id string, target_id string")
    pred = table(spark, [("a", "1"), ("c", "9")], "s1_id string, target_id string")
    got = {r.s1_id: r.f for r in ME.per_record(s1, truth, pred).select("s1_id", ME._f05().alias("f")).collect()}
    assert got == {"a": pytest.approx(5 / 6), "b": 1.0, "c": 0.0}
    assert ME.macro_f05(ME.per_record(s1, truth, pred)).first().macro_f05 == pytest.approx((5 / 6 + 1) / 3)


def test_decision_and_ownership(spark):
    s = table(spark, [("a", "t", 0.95), ("b", "t", 0.93), ("a", "u", 0.90), ("c", "v", 0.5)], "s1_id string, target_id string, p double")
    assert {(r.s1_id, r.target_id) for r in D.two_stage(s).where("accepted").collect()} == {("a", "t"), ("b", "t"), ("a", "u")}
    assert {(r.target_id, r.reason) for r in D.select_owner(s, 0.6, 0.05).collect()} == {("t", "margin"), ("u", None), ("v", "probability")}
    lists = {r.s1_id: r.ids for r in D.resolve_ownership(s.select("s1_id").distinct(), s, 0.6, 0.0).collect()}
    assert lists == {"a": "t,u", "b": "", "c": ""}
    assert [r.target_id for r in D.not_unique(s).collect()] == ["t"]
    with pytest.raises(Exception, match="outside"):
        D.resolve_ownership(s.select("s1_id"), s.withColumn("p", F.lit(1.5))).collect()


def test_validation(spark):
    m = table(spark, [("S1-1", "S2-1,S2-1"), ("S1-2", "S1-2"), ("S1-9", "")], "s1_id string, ids string")
    f = {r.rule: r.n for r in V.validate(m, table(spark, [("S1-1",), ("S1-2",), ("S1-3",)], "s1_id string"), table(spark, [("S2-1",)], "id string")).collect()}
    assert f == {"duplicate_row": 0, "duplicate_in_list": 1, "empty_in_list": 0, "self_match": 1, "bad_prefix": 1, "unknown_id": 1, "missing_s1": 1, "extra_s1": 1}


def records(spark):
    rows = [("S1-1", "Tata Steel Limited", "12 Main Road Mumbai 400001"), ("S2-1", "Tata Steel Ltd", "12 Main Rd Mumbai 400001"), ("S2-2", "Tata Motors", ""), ("S3-1", "Other Shop", "9 Side St Pune")]
    r = T.prepare(table(spark, [(*x, "India") for x in rows], "id string, name string, addr string, country string"))
    return r.where("id like 'S1%'"), r.where("id not like 'S1%'")


@pytest.mark.parametrize("profile", [B.PROD, B.MEM, B.BASELINE])
def test_retrieval(spark, profile):
    got = B.top_k(B.retrieve(*records(spark), profile), 5).orderBy("rank").collect()
    assert got[0].target_id == "S2-1" and {r.target_id for r in got} >= {"S2-1", "S2-2"}
    if profile is B.PROD:
        assert {"exact", "addr", "token"} <= set(got[0].channels) and got[0].cross_field


def test_files(spark, tmp_path):
    path = str(tmp_path / "in.tsv")
    (tmp_path / "in.tsv").write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\tA "B\t\tIndia\n')
    assert tuple(T.read_records(spark, path, strict=True).first()) == ("S1-1", 'A "B', "", "India")
    s1, targets = records(spark)
    posted = B.postings(targets)
    T.write_index(posted, f"file://{tmp_path}/index")
    assert T.read_index(spark, f"file://{tmp_path}/index").count() == posted.count()
    with pytest.raises(Exception):
        T.write_index(posted, f"file://{tmp_path}/index")
    lists = T.id_lists(s1.select(F.col("id").alias("s1_id")), table(spark, [("S1-1", "S2-2", 1), ("S1-1", "S2-1", 0)], "s1_id string, target_id string, rank int"), order="rank").withColumn("seq", F.lit(0))
    T.write_id_lists(lists, f"file://{tmp_path}/out", "seq", "matched_entity_ids")
    assert (tmp_path / "out").read_text() == "source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S2-2\n"
    with pytest.raises(FileExistsError):
        T.write_id_lists(lists, f"file://{tmp_path}/out", "seq", "matched_entity_ids")


def test_streaming_index(spark, tmp_path):
    from twinlake.streaming import incremental

    src, out = tmp_path / "src", tmp_path / "index"
    _, targets = records(spark)
    targets.select("id", "name", "addr", "country").write.parquet(f"file://{src}")
    stream = spark.readStream.schema("id string, name string, addr string, country string").parquet(f"file://{src}")
    incremental.append_postings(stream, f"file://{out}", f"file://{tmp_path}/checkpoint").awaitTermination()
    assert spark.read.parquet(f"file://{out}").count() == B.postings(targets).count()


def test_matcher(spark):
    f = spark.range(400).select(F.col("id").cast("string").alias("s1_id"), F.lit("t").alias("target_id"), (F.col("id") % 10 / 10).alias("x"), F.lit(1.0).alias("weight"), (F.col("id") % 10 > 6).cast("int").alias("is_match"))
    model = M.fit_matcher(f, ["x"], rounds=3, depth=2)
    assert M.predict(model, f, ["x"]).where("(p > 0.5) <> (is_match = 1)").count() == 0
    assert M.importances(model)[0][0] == "x"
    with pytest.raises(ValueError):
        M.predict(model, f, ["y"])
