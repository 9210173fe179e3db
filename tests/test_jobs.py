"""Jobs over files: training, linking, ownership and validation, on small folders."""

import csv
import json
import random

import pytest
from pyspark.sql import functions as F

from twinlake.__main__ import main
from twinlake.operators import blocking as B
from twinlake.operators import decision as D
from twinlake.operators import metrics as ME
from twinlake.plans import jobs
from twinlake.sources import tables as T

HEADER = "entity_id\tbusiness_name\tbusiness_address\tcountry\n"


def folder(path, part, *sources):
    path.mkdir(parents=True, exist_ok=True)
    for k, rows in enumerate(sources, 1):
        (path / f"{part}_source{k}.tsv").write_text(HEADER + "".join("\t".join(r) + "\n" for r in rows), encoding="utf-8")
    return f"file://{path}"


def shops(n, seed):
    """n first-source shops, most with a second- and a third-source spelling; true links by name."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(3))
    s1, s2, s3, truth = [], [], [], []
    for i in range(n):
        name, addr, country = f"{word()} {word()} traders", f"{r.randint(1, 99)} {word()} road {r.randint(400000, 499999)}", "India" if i % 2 else "France"
        s1.append((f"S1-{i}", name + " limited", addr, country))
        links = []
        if i % 5:
            s2.append((f"S2-{i}", name + " ltd", addr, country))
            s3.append((f"S3-{i}", name, addr if i % 3 else "", country))
            links = [f"S2-{i}", f"S3-{i}"]
        truth.append((f"S1-{i}", ",".join(links)))
    return s1, s2, s3, truth


@pytest.fixture(scope="module")
def trained(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("train")
    s1, s2, s3, truth = shops(150, 3)
    data = folder(root / "data", "train", s1, s2, s3)
    (root / "data" / "train_ground_truth.tsv").write_text("source1_entity_id\tmatched_entity_ids\n" + "".join("\t".join(t) + "\n" for t in truth))
    models = f"file://{root}/models"
    settings = jobs.train(spark, data, models, n_train=90, n_dev=40, rounds=5, depth=3, gates=(0.6, 0.8), floors=(0.4,), margins=(0.1, 0.2))
    return models, settings


def test_training_calibrates(spark, trained):
    models, settings = trained
    assert settings.gate in (0.6, 0.8) and settings.metrics["dev"]["macro_f05"] > 0.95 and settings.metrics["dev"]["candidate_recall"] == 1.0
    assert jobs.load_model(spark, models)[1] == settings
    with pytest.raises(FileNotFoundError):
        jobs.load_model(spark, models + "-none")


def test_inference_keeps_order_and_subset(spark, trained, tmp_path):
    s1 = [("S1-1", "Acme Services", "24 MG Road 560001", "India"), ("S1-2", "No Candidate", "Nowhere", "Italy"), ("S1-3", "Cafe Bon", "1 Rue 75001", "France")]
    data = folder(tmp_path / "in", "test", s1, [("S2-1", "Acme Services", "24 MG Road 560001", "India"), ("S2-2", "Cafe Bon", "1 Rue 75001", "France")], [])
    out, scores = tmp_path / "out", f"file://{tmp_path}/scores.tsv"
    summary = jobs.infer(spark, data, trained[0], f"file://{out}", scores=scores)
    rows = [[line.split("\t") for line in (out / f"{name}.tsv").read_text().splitlines()] for name in ("candidate_pairs", "matching_results")]
    assert rows[0][0] == ["source1_entity_id", "candidate_entity_ids"] and rows[1][0] == ["source1_entity_id", "matched_entity_ids"]
    assert [[r[0] for r in table[1:]] for table in rows] == [["S1-1", "S1-2", "S1-3"]] * 2
    assert rows[0][1:] == [["S1-1", "S2-1"], ["S1-2", ""], ["S1-3", "S2-2"]] and summary["records"] == 3
    accepted = {(r[0], t) for r in rows[1][1:] for t in r[1].split(",") if t}
    with open(tmp_path / "scores.tsv") as f:
        scored = list(csv.DictReader(f, delimiter="\t"))
    assert {(r["candidate_s1_id"], r["target_id"]) for r in scored} == accepted and all(0 <= float(r["model_probability"]) <= 1 and int(r["candidate_rank"]) >= 1 for r in scored)
    with pytest.raises(FileExistsError):
        jobs.infer(spark, data, trained[0], f"file://{out}")
    found = {r.rule: r.n for r in jobs.validate(spark, f"file://{out}/matching_results.tsv", f"file://{out}/candidate_pairs.tsv", data).collect()}
    assert not any(found.values()) and len(found) == 19


def test_inference_keeps_the_order_of_many_rows(spark, trained, tmp_path):
    s1, s2, s3, _ = shops(400, 8)
    order = random.Random(1).sample(s1, len(s1))
    data = folder(tmp_path / "in", "test", order, s2, s3)
    got, _ = T.sources_of(spark, data, "test")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")  # many blocks of one file
        assert [r.id for r in got.orderBy("seq").collect()] == [r[0] for r in order]
        rows = T.sources_of(spark, data, "test")[0]
        assert rows.rdd.getNumPartitions() >= 1 and {r.id: r.seq for r in rows.collect()} == {r[0]: k for k, r in enumerate(order)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_bridge_is_checked_by_the_model(spark, trained):
    model, settings = jobs.load_model(spark, trained[0])
    cols = "id string, name string, addr string, country string"
    s1 = spark.createDataFrame([("S1-1", "bagala delufo traders limited", "12 fomuna road 412345", "India")], cols).withColumn("seq", F.lit(0))
    t = [("S2-1", "bagala delufo traders ltd", "12 fomuna road 412345", "India", 1), ("S3-1", "bagala delufo traders", "12 fomuna road 412345", "India", 0), ("S3-2", "bagala other shop", "9 elsewhere", "India", 0)]
    p = jobs.pool(s1, spark.createDataFrame(t, cols + ", is_s2 int"), B.FULL)
    links = spark.createDataFrame([("S1-1", "S2-1", 0.9995, True)], "s1_id string, target_id string, p double, accepted boolean")
    hop = D.hops(links, p.targets, p.posted, B.FULL)
    assert {(r.via, r.target_id) for r in hop.collect()} == {("S2-1", "S3-1"), ("S2-1", "S3-2")}
    checked = lambda least: {r.target_id for r in D.bridge_checked(links, hop, p.s1, p.targets, model, settings.feature_names, least_p=least).collect()}
    features = D.bridged_pairs(D.bridge(links, hop), hop, p.s1, p.targets).first()
    assert features.target_id == "S3-1" and (features.rank, features.blocking_weight_ratio, features.gap_to_top, features.agree_count) == (0, 1.0, 1.0, 0.0)
    assert checked(0.5) == {"S3-1"} and checked(0.99951) == set()


def test_resolver(spark, tmp_path):
    head = "source1_entity_id\tmatched_entity_ids\n"
    (tmp_path / "m.tsv").write_text(head + "S1-2\tS2-1,S3-1\nS1-1\tS2-1\nS1-3\t\nS1-4\tS2-9\n")
    (tmp_path / "s.tsv").write_text("candidate_s1_id\ttarget_id\tmodel_probability\nS1-2\tS2-1\t0.97\nS1-2\tS3-1\t0.9\nS1-1\tS2-1\t0.99\nS1-4\tS2-9\t0.4\n")
    at = lambda name: f"file://{tmp_path}/{name}"
    assert main(["resolve", "--matching", at("m.tsv"), "--scores", at("s.tsv"), "--output", at("a.tsv"), "--winning-probability", "0.5", "--conflict-margin", "0"], spark) == 0
    assert (tmp_path / "a.tsv").read_text() == head + "S1-2\tS3-1\nS1-1\tS2-1\nS1-3\t\nS1-4\t\n"
    s = jobs.resolve(spark, at("m.tsv"), at("s.tsv"), at("b.tsv"), 0.5, 0.05)
    assert (s["score_rows"], s["conflicted_targets_before"], s["rejected_probability"], s["rejected_margin"], s["owned_targets"], s["empty_s1_rows"]) == (4, 1, 1, 1, 1, 3)
    with pytest.raises(FileExistsError):
        jobs.resolve(spark, at("m.tsv"), at("s.tsv"), at("b.tsv"), 0.5, 0.05)
    for name, text, message in (("c", "S1-2\tS2-1\t1.5\n", "outside"), ("d", "S1-2\tS2-1\t0.5\n", "no probability"), ("e", "S1-2\tS2-1\t0.97\nS1-2\tS3-1\t0.9\nS1-1\tS2-1\t0.99\nS1-4\tS2-9\t0.4\nS1-4\tS2-8\t0.4\n", "match")):
        (tmp_path / f"{name}.tsv").write_text("candidate_s1_id\ttarget_id\tmodel_probability\n" + text)
        with pytest.raises(ValueError, match=message):
            jobs.resolve(spark, at("m.tsv"), at(f"{name}.tsv"), at("z.tsv"), 0.5, 0.0)


@pytest.mark.parametrize(("rows", "rule"), [
    ("S1-1\tS2-1\nS1-2\t\n", None), ("S1-2\t\nS1-1\tS2-1\n", "order"), ("S1-1\tS2-1\n", "missing_s1"), ("S1-1\tS2-2\nS1-2\t\n", "not_in_candidates"),
    ("S1-1\tS2-1,S2-1\nS1-2\t\n", "duplicate_in_list"), ("S1-1\tS2-7\nS1-2\t\n", "unknown_id"), ("S1-1\tS2-1,\nS1-2\t\n", "empty_in_list"),
])
def test_validator(spark, tmp_path, capsys, rows, rule):
    data = folder(tmp_path / "in", "test", [("S1-1", "A", "", "x"), ("S1-2", "B", "", "x")], [("S2-1", "A", "", "x"), ("S2-2", "B", "", "x")], [("S3-1", "C", "", "x")])
    (tmp_path / "m.tsv").write_text("source1_entity_id\tmatched_entity_ids\n" + rows)
    (tmp_path / "c.tsv").write_text("source1_entity_id\tcandidate_entity_ids\nS1-1\tS2-1,S3-1\nS1-2\t\n")
    code = main(["validate", "--matching", f"file://{tmp_path}/m.tsv", "--candidate", f"file://{tmp_path}/c.tsv", "--data", data, "--check-ids"], spark)
    assert code == int(rule is not None) and (rule or "PASS") in capsys.readouterr().out


def test_odd_headers_fail(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("id\tmatched_entity_ids\nS1-1\t\n")
    with pytest.raises(Exception):
        T.read_lists(spark, f"file://{tmp_path}/m.tsv", "matched_entity_ids").collect()
    (tmp_path / "r.tsv").write_text(HEADER + "S1-1\ta\tb\tc\td\n")
    with pytest.raises(Exception):
        T.read_records(spark, f"file://{tmp_path}/r.tsv", strict=True).collect()


def test_report_files(spark, tmp_path):
    s1 = spark.createDataFrame([("S1-1", "x", "Ab"), ("S1-2", "x", "Cd")], "s1_id string, country string, name string")
    targets = spark.createDataFrame([("S2-1",), ("S2-2",), ("S2-3",)], "id string")
    truth = spark.createDataFrame([("S1-1", "S2-1"), ("S1-1", "S2-2"), ("S1-1", "S2-9"), ("S1-1", "S2-3")], "s1_id string, target_id string")
    scored = spark.createDataFrame([("S1-1", "S2-1", 0.9), ("S1-1", "S2-2", 0.5), ("S1-2", "S2-3", 0.85)], "s1_id string, target_id string, p double")
    m = jobs.report(spark, s1, targets, truth, scored, D.Thresholds(), f"file://{tmp_path}")
    assert json.loads((tmp_path / "metrics.json").read_text()) == m and m["candidates"] == 3 and m["group_metrics"]["cardinality:multi"]["records"] == 1
    read = lambda name: (tmp_path / f"{name}.csv").read_text().splitlines()[1:]
    assert read("missed_candidate_analysis") == ["S1-1,S2-3,x,blocking_or_budget,2", "S1-1,S2-9,x,target_absent,2"]
    assert read("matcher_false_negative_analysis") == ["S1-1,S2-2,x,0.5,0.9,threshold_or_margin"] and read("matcher_false_positive_analysis") == ["S1-2,S2-3,x,0.85,0.85"]
    T.write_table(spark.createDataFrame([('a,"b"', 1)], "x string, y int"), f"file://{tmp_path}/q.csv")
    with open(tmp_path / "q.csv") as f:
        assert list(csv.reader(f)) == [["x", "y"], ['a,"b"', "1"]]


def test_schwa_falls_back_to_words(spark):
    from twinlake.functions.phonetic import with_sounds

    rows = [("S1-1", "sharma ram"), ("S2-1", "sharm ltd"), ("S2-2", "rama shop"), ("S2-3", "रम दुकान")]
    r = with_sounds(T.prepare(spark.createDataFrame([(i, n, "", "x") for i, n in rows], "id string, name string, addr string, country string")))
    p = B.Profile(channels=("token", "tr_tok"), schwa=True, many_tokens=0.0)
    got = {x.target_id: (x.weight, x.channels) for x in B.retrieve(r.where("id like 'S1%'"), r.where("id like 'S2%'"), p).collect()}
    # sharm is a word only; rama is a transliterated word, so the word of the second shop is not asked for.
    assert got == {"S2-1": (3.0, ["token"]), "S2-3": (3.0, ["tr_tok"])}


def test_graph_rules(spark):
    pairs = lambda rows, more="": spark.createDataFrame(rows, "s1_id string, target_id string" + more)
    s1, truth = spark.createDataFrame([("a",), ("b",)], "s1_id string"), pairs([("a", "1"), ("a", "2")])
    found = D.rule_search(s1, truth, pairs([("a", "1")]), pairs([("a", "2", 0.999, 90.0), ("b", "3", 0.99, 95.0)], ", p double, agreement double"), (0.99, 0.999), (80, 99))
    got = {(r.least_p, r.least_agreement): (r.macro_f05, r.precision, r.recall) for r in found.collect()}
    alone = 1.25 * 0.5 / (0.25 + 0.5)
    assert got == {(0.99, 80.0): (0.5, 2 / 3, 1.0), (0.999, 80.0): (1.0, 1.0, 1.0), (0.99, 99.0): (pytest.approx((alone + 1) / 2), 1.0, 0.5), (0.999, 99.0): (pytest.approx((alone + 1) / 2), 1.0, 0.5)}
    assert D.best_rule(found).first().least_p == 0.999
    scored = pairs([("a", "1", 0.99), ("a", "2", 0.985), ("a", "3", 0.999), ("b", "1", 0.5)], ", p double")
    hits = spark.createDataFrame([("1", "7", 2.0), ("3", "8", 1.0), ("3", "1", 9.0), ("1", "8", 5.0), ("2", "9", 1.0)], "via string, target_id string, weight double")
    assert [(r.s1_id, r.target_id, r["rank"]) for r in D.expand(scored, hits).orderBy("rank").collect()] == [("a", "8", 3), ("a", "7", 4)]
    assert D.expand(scored, hits, most=4).count() == 1


def test_graph_recovery(spark):
    truth = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3")], "s1_id string, target_id string")
    scored = spark.createDataFrame([("a", "1", True)], "s1_id string, target_id string, accepted boolean")
    posted = spark.createDataFrame([("x", "token", "k", "1"), ("x", "token", "k", "2"), ("x", "addr", "z", "2")], "country string, channel string, key string, target_id string")
    got = {tuple(r) for r in ME.graph_recovery(truth, scored, posted).select("s1_id", "target_id", "retrieved_true", "accepted_true", "bridge_channels", "accepted_bridge_channels").collect()}
    assert got == {("a", "2", 1, 1, "token", "token"), ("b", "3", 0, 0, "", "")}
