"""Retrieval by blocks: the same candidates as by a join of hits, and none of the hits is shuffled."""

import pytest
from pyspark.sql import functions as F

from twinlake.operators import blocking as B
from twinlake.operators import gather as G
from twinlake.plans import linkage
from twinlake.sources import tables as T


@pytest.fixture(scope="module")
def sides(spark):
    texts = ["zebra crossing 12 high road 44556 " * 2, "zebra crossing twelve", "zebra 12 high road 44556 leafy village place", "crossing over zebra 12 leafy leafy village", "", "a b c"]
    rows = [(f"S{i % 3 + 1}-{i}", f"{texts[i % 6]} {i % 7}"[:40], f"{texts[(i * 5) % 6]} leafy 12 {i % 9} 44556 leafy", ("en", "fr", None)[i % 5 % 3]) for i in range(240)]
    r = T.prepare(spark.createDataFrame([*rows, rows[1], rows[0]], "id string, name string, addr string, country string"))
    return r.where("id like 'S1-%'"), r.where("id not like 'S1-%'")


def parts(sides):
    s1, targets = sides
    p = B.postings(targets).localCheckpoint()
    stats = B.idf(B.key_counts(p), targets).localCheckpoint()
    keys = B.weighted_keys(B.query_keys(s1), stats).localCheckpoint()
    return keys, stats, p, targets.select(F.col("id").alias("target_id"))


def rows(df):
    return sorted((x.s1_id, x.target_id, round(x.weight, 6), tuple(x.channels), x.token_hits, x.phon_hits, x.cross_field) for x in df.collect())


@pytest.mark.parametrize("small", [False, True])
def test_blocks_find_what_the_join_finds(sides, monkeypatch, small):
    """Also with one record a block at least, lists cut to pieces, repeated records, targets and keys, and null countries."""
    if small:
        for name, n in (("BLOCK", 16), ("LIST", 3), ("IDS", 5), ("BATCH", 7)):
            monkeypatch.setattr(G, name, n)
    keys, stats, p, ids = parts(sides)
    scored = B.score(B.hits(keys, p)).localCheckpoint()
    assert scored.count() > 1000 and p.count() > p.distinct().count()
    assert rows(G.gather(keys, stats, p, ids, B.PROD)) == rows(scored)
    assert rows(G.gather(keys, stats, p, ids, B.PROD, G.Cut(best=7))) == rows(B.top_k(scored, 7).drop("rank"))
    assert rows(G.gather(keys, stats, p, ids, B.PROD, G.Cut(evidence="cross_field"))) == rows(scored.where("cross_field"))
    assert rows(G.gather(keys, stats, p, ids, B.PROD, G.Cut(evidence="token_hits"))) == rows(scored.where("token_hits >= 2"))
    quota = lambda df: sorted((x.s1_id, x.target_id, x["rank"]) for x in B.family_quota(df, 6).collect())
    assert quota(G.gather(keys, stats, p, ids, B.PROD, G.Cut(best=12, named=6))) == quota(scored)
    got = {x.s1_id: (x.n, round(x.best, 6)) for x in G.gather(keys, stats, p, ids, B.PROD, G.Cut(summary=True)).collect()}
    assert got == {x.s1_id: (x.n, round(x.best, 6)) for x in scored.groupBy("s1_id").agg(F.count("*").alias("n"), F.max("weight").alias("best")).collect()}


def test_nothing_found(sides):
    keys, stats, p, ids = parts(sides)
    assert G.gather(keys.where("false"), stats, p, ids, B.PROD).collect() == []


FOUND = [
    "adaptive_budget", "assert_global_unique", "assign_ownership", "best_thresholds", "bonus_cross_field", "bonus_multi_token", "candidate_diagnostic", "candidate_recall", "decision_secondary", "decision_threshold",
    "decision_two_stage", "difficulty_tier", "entity_full_recall", "error_taxonomy", "evaluate_metrics", "family_quota", "feat_flags", "feat_jaro_winkler", "feat_numeric", "fp_breakdown", "graph_recovery", "graph_rule_search",
    "group_metrics", "hard_negatives",
]


@pytest.mark.parametrize("name", FOUND)
def test_no_query_joins_hits(spark, name, monkeypatch):
    """Neither all hits nor whole prepared records are written."""

    def refused(*_):
        raise AssertionError("a row a hit")

    monkeypatch.setattr(B, "hits", refused)
    staged = []
    monkeypatch.setattr(linkage, "stage", lambda df, name, f=linkage.stage: (staged.append(name), f(df, name))[1])
    assert linkage.QUERIES[name](spark, "/root/testdata/sf0.001").columns
    assert "records" not in staged and "scored" not in staged
