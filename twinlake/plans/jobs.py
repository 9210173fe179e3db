"""Whole jobs over files: train a matcher, link a folder of sources, resolve ownership, validate results.

A folder holds ``<part>_source1.tsv`` to ``<part>_source3.tsv``; a model folder holds the trees under
``matcher`` and ``config.json``. Each step's table is staged once and read by the next, so a lost
executor costs one step; only counts, metrics and settings reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, field, fields

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlake.functions.phonetic import with_sounds
from twinlake.operators import blocking as B
from twinlake.operators import decision as D
from twinlake.operators import features as FE
from twinlake.operators import matcher as M
from twinlake.operators import metrics as ME
from twinlake.operators import validation as V
from twinlake.sources import tables as T
from twinlake.sources.staging import stage

# The grid that calibration searches.
GATES, FLOORS, MARGINS = (0.60, 0.66, 0.70, 0.72, 0.76, 0.80), (0.40, 0.45, 0.50, 0.55), (0.10, 0.15, 0.18)
# End of fixed values.
MATCHES, CANDIDATES = "matched_entity_ids", "candidate_entity_ids"


@dataclass(frozen=True)
class Settings:
    """What a trained matcher was made with, and how its probabilities become links."""

    gate: float = 0.80
    floor: float = 0.40
    margin: float = 0.10
    budget: int = 60
    adaptive: bool = True
    extra: bool = True
    graph: bool = False
    graph_p: float = 0.999
    graph_similarity: float = 0.80
    feature_names: list[str] = field(default_factory=lambda: [*FE.BASE, *FE.EXTRA])
    metrics: dict = field(default_factory=dict)

    @property
    def thresholds(self) -> D.Thresholds:
        return D.Thresholds(self.gate, self.floor, self.margin)


def _names(extra: bool) -> list[str]:
    return [*FE.BASE, *(FE.EXTRA if extra else [])]


def load_model(spark: SparkSession, models: str) -> tuple[PipelineModel, Settings]:
    """Trees and settings; fails if either is absent, or if features differ from those of this library in name or order."""
    if not T.exists(spark, f"{models}/matcher") or not T.exists(spark, f"{models}/config.json"):
        raise FileNotFoundError(f"{models} holds no trained matcher")
    known = {f.name for f in fields(Settings)}
    s = Settings(**{k: v for k, v in T.read_json(spark, f"{models}/config.json").items() if k in known})
    model = PipelineModel.load(f"{models}/matcher")
    if s.feature_names != _names(s.extra) or model.stages[0].getInputCols() != s.feature_names:
        raise ValueError("the features of model, settings and library differ")
    return model, s


@dataclass
class Pool:
    """Prepared sources and the index of the noisy ones."""

    s1: DataFrame
    targets: DataFrame
    posted: DataFrame


def _prepared(records: DataFrame) -> DataFrame:
    return with_sounds(T.prepare(records))


def pool(s1: DataFrame, targets: DataFrame, profile: B.Profile) -> Pool:
    """Each source is prepared once; postings serve both the key counts and the joins."""
    t = stage(_prepared(targets), "targets")
    return Pool(stage(_prepared(s1), "records"), t, stage(B.postings(t, profile.channels), "postings"))


def candidates(p: Pool, s1: DataFrame, profile: B.Profile, budget: int, adaptive: bool) -> DataFrame:
    """(s1_id, target_id, weight, channels, ..., rank) within each record's budget."""
    scored = stage(B.retrieve(s1, p.targets, profile, p.posted), "retrieved")
    limit = B.budgets(s1, scored, p.posted) if adaptive else budget
    return stage(B.rerank(scored, s1, p.targets, limit, profile), "candidates")


def featurise(ranked: DataFrame, p: Pool) -> DataFrame:
    return FE.all_features(FE.paired(ranked, p.s1, p.targets))


def infer(spark: SparkSession, data: str, models: str, output: str, *, part: str = "test", scores: str | None = None, profile: B.Profile = B.FULL) -> dict:
    """Link ``part``'s first source with the others; returns a summary.

    Writes ``output``/candidate_pairs.tsv and ``output``/matching_results.tsv, a row a record in input order, and, if asked
    to, the accepted pairs' scores. Outputs that exist aren't touched, and scores are not exported with the graph bridge.
    """
    matching, listed = f"{output}/matching_results.tsv", f"{output}/candidate_pairs.tsv"
    if scores in (matching, listed):
        raise ValueError("scores need a file of their own")
    for path in filter(None, (matching, listed, scores)):
        if T.exists(spark, path):
            raise FileExistsError(path)
    model, settings = load_model(spark, models)
    if scores and settings.graph:
        raise ValueError("scores can't be exported with the graph bridge")
    p = pool(*T.sources_of(spark, data, part), profile)
    ranked = candidates(p, p.s1, profile, settings.budget, settings.adaptive)
    scored = stage(M.predict(model, featurise(ranked, p), settings.feature_names).select("s1_id", "target_id", "weight", "rank", "p"), "scored")
    decided = stage(D.two_stage(scored, settings.thresholds), "decided")
    matched, offered = decided.where("accepted").select("s1_id", "target_id", "rank"), ranked.select("s1_id", "target_id", "rank")
    if settings.graph:
        hop = stage(D.hops(decided, p.targets, p.posted, profile, least_p=settings.graph_p), "hops")
        last = F.lit(2**31 - 1).alias("rank")  # after all others, by id
        more = stage(D.bridge_checked(decided, hop, p.s1, p.targets, model, settings.feature_names, least_p=settings.graph_p, least_similarity=settings.graph_similarity).select("s1_id", "target_id", last), "bridged")
        matched = matched.unionByName(more)
        offered = offered.unionByName(more.join(offered, ["s1_id", "target_id"], "left_anti"))
    own = p.s1.select(F.col("id").alias("s1_id"), "seq")
    links = stage(T.id_lists(own, matched, order="rank"), "links")
    T.write_id_lists(T.id_lists(own, offered, order="rank"), listed, "seq", CANDIDATES)
    T.write_id_lists(links, matching, "seq", MATCHES)
    if scores:
        T.write_table(T.accepted_scores(decided), scores, "candidate_s1_id", "candidate_rank", sep="\t")
    return {"records": own.count(), **ME.output_summary(links).first().asDict()}


def _chosen(spark: SparkSession, s1: DataFrame, splits: str | None, n_train: int, n_dev: int) -> DataFrame:
    """s1 with ``part``: train, dev, holdout or null; by lists of ids (a JSON array a file), else by row number."""
    if splits is None:
        return s1.withColumn("part", F.when(F.col("seq") < n_train, "train").when(F.col("seq") < n_train + n_dev, "dev"))
    parts = None
    for part in ("train", "dev", "holdout"):
        path = f"{splits}/{part}_s1_ids.json"
        if T.exists(spark, path):
            ids = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("id"), F.lit(part).alias("part"))
            parts = ids if parts is None else parts.unionByName(ids)
    if parts is None:
        raise FileNotFoundError(f"{splits} holds no split")
    return s1.join(parts.dropDuplicates(["id"]), "id", "left")


def train(
    spark: SparkSession, data: str, models: str, *, part: str = "train", splits: str | None = None, n_train: int = 35_000, n_dev: int = 10_000, budget: int = 60, adaptive: bool = True, extra: bool = True,
    negatives: int = 10_000, head: int | None = None, profile: B.Profile = B.FULL, gates: Sequence[float] = GATES, floors: Sequence[float] = FLOORS, margins: Sequence[float] = MARGINS, **trees,
) -> Settings:
    """Fit and calibrate a matcher on a folder with ``<part>_ground_truth.tsv``; writes trees and settings to ``models``.

    ``head`` limits the pool to that many targets beside the needed ones; without it all targets are in it.
    """
    truth = stage(T.parse_truth(T.read_lists(spark, f"{data}/{part}_ground_truth.tsv", MATCHES).withColumnsRenamed({"s1_id": "source1_entity_id", "ids": MATCHES})), "truth")
    first, others = T.sources_of(spark, data, part)
    first = _chosen(spark, first, splits, n_train, n_dev).where("part is not null")
    needed = truth.join(first.select(F.col("id").alias("s1_id")), "s1_id", "left_semi")
    p = pool(first, others if head is None else T.pool_sample(others, needed, head), profile)
    names = _names(extra)
    ranked = candidates(p, p.s1, profile, budget, adaptive)
    of = lambda df, which: df.join(p.s1.where(F.col("part") == which).select(F.col("id").alias("s1_id")), "s1_id", "left_semi")
    pairs = M.training_pairs(of(ranked, "train"), of(truth, "train"), p.targets).withColumn("channels", F.coalesce("channels", F.array().cast("array<string>")))
    labelled = M.hard_negatives(pairs, negatives).select("s1_id", "target_id", "weight", "rank", "channels", "is_match")
    f = stage(featurise(labelled.drop("is_match"), p).join(labelled.select("s1_id", "target_id", "is_match"), ["s1_id", "target_id"]), "features")
    classes = {r.is_match for r in f.select("is_match").distinct().collect()}
    if classes != {0, 1}:
        raise ValueError("training needs matches and non-matches")
    model = M.fit_matcher(f, names, **trees)

    def scored(which: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        s = stage(M.predict(model, featurise(of(ranked, which), p), names).select("s1_id", "target_id", "weight", "rank", "p"), which)
        return p.s1.where(F.col("part") == which).select(F.col("id").alias("s1_id"), "country", "name"), of(truth, which), s

    ids, known, dev = scored("dev")
    best = D.best_thresholds(D.grid_search(dev, known, ids, gates, floors, margins)).first()
    t = D.Thresholds(best.gate, best.floor, best.margin) if best and best.macro_f05 is not None else D.Thresholds()
    metrics = {"dev": _measured(ids, known, dev, t)}
    if p.s1.where("part = 'holdout'").limit(1).count():
        metrics["holdout"] = _measured(*scored("holdout"), t)
    settings = Settings(t.gate, t.floor, t.margin, budget, adaptive, extra, feature_names=names, metrics=metrics)
    model.write().overwrite().save(f"{models}/matcher")
    T.write_json(spark, f"{models}/config.json", asdict(settings))
    return settings


def _measured(s1: DataFrame, truth: DataFrame, scored: DataFrame, t: D.Thresholds) -> dict:
    links = D.two_stage(scored, t).where("accepted")
    found = ME.candidate_recall(ME.per_record(s1, truth, scored)).first()
    return ME.evaluate(ME.per_record(s1, truth, links)).first().asDict() | {"candidate_recall": found.pair_recall}


def report(spark: SparkSession, s1: DataFrame, targets: DataFrame, truth: DataFrame, scored: DataFrame, t: D.Thresholds, folder: str) -> dict:
    """Metrics of scored candidates as JSON, and as CSV what was missed, rejected, wrongly linked, and every score. ``s1`` has s1_id, country and name."""
    decided = stage(D.two_stage(scored, t), "decided")
    records = stage(ME.per_record(s1, truth, decided.where("accepted")), "records")
    out = {
        "missed_candidate_analysis": ME.misses(s1, truth, targets, decided), "matcher_false_negative_analysis": ME.false_negatives(s1, truth, decided, t.gate),
        "matcher_false_positive_analysis": ME.false_positives(s1, truth, decided), "score_distribution": ME.score_distribution(s1, truth, decided),
    }
    for name, table in out.items():
        T.write_table(table, f"{folder}/{name}.csv", "s1_id", "target_id")
    groups = {f"{r.kind}:{r.label}": {k: v for k, v in r.asDict().items() if k not in ("kind", "label")} for r in ME.evaluate_groups(records).collect()}  # a row a country, script and cardinality
    metrics = ME.evaluate(records).first().asDict() | {"candidate_recall": ME.candidate_recall(ME.per_record(s1, truth, decided)).first().pair_recall, "candidates": decided.count(), "group_metrics": groups}
    T.write_json(spark, f"{folder}/metrics.json", metrics)
    return metrics


def resolve(spark: SparkSession, matching: str, scores: str, output: str, least_p: float, least_margin: float) -> dict:
    """Give each target of a result file to its likeliest record; writes all records in input order and returns a summary.

    Fails if a probability lies outside [0, 1], if the scores are not exactly the accepted pairs, or if ``output`` exists.
    """
    if output in (matching, scores):
        raise ValueError("the output must differ from the inputs")
    if T.exists(spark, output):
        raise FileExistsError(output)
    lists = stage(T.read_lists(spark, matching, MATCHES, place=True), "lists")
    scored = stage(T.read_scores(spark, scores), "scores")
    bad = scored.agg(F.count("*").alias("n"), F.count_if(F.col("p").isNull() | F.isnan("p") | ~F.col("p").between(0, 1)).alias("outside")).first()
    if bad.outside:
        raise ValueError("a probability is outside [0, 1]")
    # Pairs and scores must be the same multiset, each pair once.
    pairs = lists.select("s1_id", F.explode(F.split("ids", ",")).alias("target_id")).where("target_id <> ''").groupBy("s1_id", "target_id").agg(F.count("*").alias("listed"))
    both = pairs.join(scored.groupBy("s1_id", "target_id").agg(F.count("*").alias("given")), ["s1_id", "target_id"], "full_outer")
    odd = both.agg(F.count_if(F.expr("given is null")).alias("unscored"), F.count_if(F.expr("listed is null or listed > 1 or given > 1")).alias("extra")).first()
    if odd.unscored:
        raise ValueError(f"{odd.unscored} accepted pairs have no probability")
    if odd.extra:
        raise ValueError("the scores don't match the accepted pairs")
    owners = stage(D.select_owner(scored, least_p, least_margin), "owners")
    conflicts = scored.groupBy("target_id").count().where("count > 1").count()
    owned = T.id_lists(lists.select("s1_id", "seq"), owners.where("reason is null").select("s1_id", "target_id"))
    resolved = stage(owned, "resolved")
    twice = D.not_unique(resolved.select(F.explode(F.split("ids", ",")).alias("target_id")).where("target_id <> ''")).count()
    if twice:
        raise ValueError(f"{twice} targets are owned twice")
    T.write_id_lists(resolved, output, "seq", MATCHES)
    why = {r.reason: r["count"] for r in owners.groupBy("reason").count().collect()}
    n = F.when(F.col("ids") == "", 0).otherwise(F.size(F.split("ids", ",")))
    rows = resolved.agg(F.count("*").alias("s1_rows"), F.coalesce(F.sum(n), F.lit(0)).alias("assignments"), F.count_if(n == 0).alias("empty_s1_rows"), F.coalesce(F.max(n), F.lit(0)).alias("max_assignments_per_s1")).first().asDict()
    if rows["assignments"] != why.get(None, 0):
        raise ValueError("the owned targets differ from the assignments written")
    return {
        "score_rows": bad.n, "conflicted_targets_before": conflicts, "rejected_probability": why.get("probability", 0), "rejected_margin": why.get("margin", 0), "owned_targets": why.get(None, 0),
        **rows, "mean_assignments_per_s1": rows["assignments"] / max(rows["s1_rows"], 1), "cross_s1_duplicate_assignments": twice,
    }


def validate(spark: SparkSession, matching: str, listed: str | None, data: str, *, part: str = "test", check_ids: bool = True) -> DataFrame:
    """Findings (rule, n, samples) about result files against a folder of sources; all n are 0 if they are sound.

    Headers and widths that differ fail the read. Without ``check_ids`` target ids need not exist; without a candidate file
    the subset rule is not checked.
    """
    s1, targets = T.sources_of(spark, data, part)
    own = stage(s1.select(F.col("id").alias("s1_id"), "seq"), "own")
    read = lambda path, column: stage(T.read_lists(spark, path, column, place=True), column)
    matches = read(matching, MATCHES)
    offered = read(listed, CANDIDATES) if listed else None
    pool_ids = targets.select("id") if check_ids else matches.select(F.explode(F.split("ids", ",")).alias("id"))
    found = V.validate_strictly(matches, offered if listed else matches, own, pool_ids)
    if not listed:
        return found
    more = V.validate_strictly(offered, offered, own, targets.select("id") if check_ids else offered.select(F.explode(F.split("ids", ",")).alias("id")))
    return found.unionByName(more.where("rule <> 'not_in_candidates'").withColumn("rule", F.concat(F.lit("candidates_"), "rule")))
