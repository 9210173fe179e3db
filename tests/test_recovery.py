"""Missed pairs meet their record's other matches by kinds of targets with the same keys, not pair by pair and key by key."""

import random

from twinlake.operators import metrics as ME

COLUMNS = ["s1_id", "target_id", "retrieved_true", "accepted_true", "bridge_channels", "accepted_bridge_channels"]


def plain(truth, scored, posted):
    """The SQL's words: nulls match nothing, neighbours count once."""
    at = {}
    for country, channel, key, t in posted:
        if country is not None and key is not None:
            at.setdefault(t, set()).add((country, channel, key))
    out = set()
    for s, t in set(truth) - {x[:2] for x in scored}:
        near = [x for x in scored if x[0] == s and x[:2] in set(truth)]
        shared = lambda rows: ",".join(sorted({k[1] for x in rows for k in at.get(t, set()) & at.get(x[1], set())}))  # noqa: B023,E731
        sure = [x for x in near if x[2]]
        out.add((s, t, len({x[1] for x in near}), len({x[1] for x in sure}), shared(near), shared(sure)))
    return out


def test_kinds_give_what_pairs_give(spark):
    """Targets of equal and of different keys, filed twice, in no or two countries, repeated links, null keys."""
    r = random.Random(3)
    posted = [(r.choice(["x", "x", "y", None]), c, r.choice(["k", "l", "m", None]), str(t)) for t in range(30) for c in ("addr", "token", "exact") for _ in range(r.randrange(3))]
    posted += [(c, ch, k, str(int(t) + 30)) for c, ch, k, t in posted]
    truth = [(f"s{s}", str(t)) for s in range(8) for t in range(60) if r.random() < 0.3]
    scored = [(s, t, r.choice([True, False, None])) for s, t in truth if r.random() < 0.4] + [("s1", "none", True)]
    scored += r.sample(scored, 15)
    frames = [spark.createDataFrame(rows, schema) for rows, schema in ((truth + truth[:9], "s1_id string, target_id string"), (scored, "s1_id string, target_id string, accepted boolean"), (posted, "country string, channel string, key string, target_id string"))]
    got = [tuple(x) for x in ME.graph_recovery(*frames).select(*COLUMNS).collect()]
    want = plain(truth, scored, posted)
    assert len(got) == len(set(got)) and set(got) == want and len({x[4] for x in want}) > 4


def test_copies_do_not_meet_pair_by_pair(spark):
    """All targets have the same keys; a row a pair, or a row a pair and key, would be shuffled in many times their room."""
    store = spark.sparkContext._jsc.sc().statusStore()
    shuffled = lambda: store.executorList(False).apply(0).totalShuffleWrite()
    truth = [("s", f"t{i}") for i in range(330)]
    frames = [
        spark.createDataFrame(truth, "s1_id string, target_id string"), spark.createDataFrame([(*x, i < 10) for i, x in enumerate(truth[:30])], "s1_id string, target_id string, accepted boolean"),
        spark.createDataFrame([("x", c, f"{c}{k}", t) for _, t in truth for c in ("addr", "token") for k in range(10)], "country string, channel string, key string, target_id string"),
    ]
    before = shuffled()
    got = {tuple(x) for x in ME.graph_recovery(*frames).select(*COLUMNS).collect()}
    assert got == {("s", t, 30, 10, "addr,token", "addr,token") for _, t in truth[30:]}
    assert shuffled() - before < 60_000
