"""Quality of links and candidates, error taxonomies, profiles and splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinlake.functions import text as X
from twinlake.operators.decision import f_beta
from twinlake.sources.staging import stage

CHANNELS = ("exact", "addr", "token", "prefix", "acronym", "tokpost", "addr_tok", "ngram", "tr_name", "tr_tok", "phon", "phone")


def per_record(s1: DataFrame, truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """(s1_id, n_truth, n_pred, tp) of every record; pairs are counted, never gathered."""
    t = truth.select("s1_id", "target_id").distinct().withColumn("t", F.lit(1))
    p = predicted.select("s1_id", "target_id").distinct().withColumn("p", F.lit(1))
    both = t.join(p, ["s1_id", "target_id"], "full_outer").groupBy("s1_id").agg(F.count("t").alias("n_truth"), F.count("p").alias("n_pred"), F.sum(F.when(F.col("t").isNotNull() & F.col("p").isNotNull(), 1).otherwise(0)).alias("tp"))
    return s1.join(both, "s1_id", "left").fillna(0, ["n_truth", "n_pred", "tp"])


def _f05() -> Column:
    return f_beta(F.col("tp"), F.col("n_pred"), F.col("n_truth"))


def macro_f05(records: DataFrame) -> DataFrame:
    return records.agg(F.avg(_f05()).alias("macro_f05"))


def _summary() -> list[Column]:
    single = (F.col("n_truth") == 0).cast("int")
    return [
        F.avg(_f05()).alias("macro_f05"),
        (F.sum("tp") / F.greatest(F.lit(1), F.sum("n_pred"))).alias("precision"),
        (F.sum("tp") / F.greatest(F.lit(1), F.sum("n_truth"))).alias("recall"),
        (F.sum(F.when((F.col("n_truth") == 0) & (F.col("n_pred") == 0), 1).otherwise(0)) / F.greatest(F.lit(1), F.sum(single))).alias("singleton_accuracy"),
        F.sum((F.col("n_pred") == 0).cast("int")).alias("predicted_singletons"),
        F.count("*").alias("records"),
    ]


def evaluate(records: DataFrame) -> DataFrame:
    return records.agg(*_summary())


def evaluate_groups(records: DataFrame) -> DataFrame:
    """The same by country, script and cardinality: (kind, label, ...). ``records`` carries country and name."""
    size = F.when(F.col("n_truth") == 0, "singleton").when(F.col("n_truth") == 1, "one").otherwise("multi")
    labels = F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("label")) for k, c in (("country", F.col("country")), ("script", X.script_class(F.col("name"))), ("cardinality", size))])
    return records.withColumn("g", F.explode(labels)).groupBy("g.kind", "g.label").agg(*_summary())


def candidate_recall(records: DataFrame) -> DataFrame:
    """Pair recall, full recall and zero recovery, of records whose predictions are all candidates."""
    some = F.col("n_truth") > 0
    return records.agg(
        (F.sum("tp") / F.greatest(F.lit(1), F.sum("n_truth"))).alias("pair_recall"),
        F.sum((F.col("tp") == F.col("n_truth")).cast("int")).alias("full_recall"),
        F.sum((some & (F.col("tp") == 0)).cast("int")).alias("zero_recovery"),
        F.sum(some.cast("int")).alias("with_truth"),
    )


def recall_at(truth: DataFrame, ranked: DataFrame, budgets: Sequence[int]) -> DataFrame:
    """(budget, recall) if only each record's first candidates counted; ranks from 0."""
    found = truth.join(ranked.select("s1_id", "target_id", "rank"), ["s1_id", "target_id"], "left")
    each = found.select("rank", F.explode(F.array(*map(F.lit, budgets))).alias("budget"))
    return each.groupBy("budget").agg(F.avg(F.coalesce((F.col("rank") < F.col("budget")).cast("int"), F.lit(0))).alias("recall"))


def oracle_f05(s1: DataFrame, truth: DataFrame, candidates: DataFrame) -> DataFrame:
    """The best F that any decision over these candidates could reach."""
    return macro_f05(per_record(s1, truth, truth.join(candidates.select("s1_id", "target_id").distinct(), ["s1_id", "target_id"], "left_semi")))


def diagnose(s1: DataFrame, truth: DataFrame, ranked: DataFrame) -> DataFrame:
    """One row per prepared record: what retrieval found of its truth, where, by which channels."""
    marked = ranked.join(truth.withColumn("hit", F.lit(1)), ["s1_id", "target_id"], "left")
    hit = F.col("hit") == 1
    found = marked.groupBy("s1_id").agg(
        F.count("*").alias("candidate_count"), F.count("hit").alias("recovered_gt_count"), (F.min(F.when(hit, F.col("rank"))) + 1).alias("gt_min_rank"), (F.max(F.when(hit, F.col("rank"))) + 1).alias("gt_max_rank"),
        F.avg(F.size("channels")).alias("channel_agreement_mean"),
        *[F.sum((hit & F.array_contains("channels", c)).cast("int")).alias(f"hit_{c}") for c in CHANNELS],
    )
    missing = truth.join(ranked.select("s1_id", "target_id"), ["s1_id", "target_id"], "left_anti").groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_list("target_id")), ",").alias("missing_gt_ids"))
    n = truth.groupBy("s1_id").agg(F.count("*").alias("gt_count"))
    own = s1.select(F.col("id").alias("s1_id"), "country", "name", "addr", "norm_addr", "core")
    t = own.join(n, "s1_id", "left").join(found, "s1_id", "left").join(missing, "s1_id", "left")
    t = t.fillna(0, ["gt_count", "candidate_count", "recovered_gt_count", *[f"hit_{c}" for c in CHANNELS]]).fillna(0.0, ["channel_agreement_mean"]).fillna("", ["missing_gt_ids"])
    native, words, count = F.rlike("name", F.lit("[^\\x{00}-\\x{7F}]")).cast("int"), F.size(F.array_distinct("core")), F.col("candidate_count")
    full = (F.col("recovered_gt_count") == F.col("gt_count")).cast("int")
    return t.select(
        "s1_id", "country", "gt_count", "recovered_gt_count", (F.col("gt_count") - F.col("recovered_gt_count")).alias("missing_gt_count"), "missing_gt_ids",
        F.when(F.col("gt_count") > 0, F.col("recovered_gt_count") / F.col("gt_count")).otherwise(1.0).alias("pair_recall"),
        full.alias("entity_full_recall"), full.alias("full_recall_flag"), ((F.col("gt_count") > 0) & (F.col("recovered_gt_count") == 0)).cast("int").alias("zero_recovery"),
        "gt_min_rank", "gt_max_rank", "candidate_count", F.to_json(F.struct(*[F.col(f"hit_{c}").alias(c) for c in CHANNELS])).alias("channel_hit_vector"), "channel_agreement_mean",
        F.when(words > 0, count / words).otherwise(count.cast("double")).alias("candidate_collision_density"),
        native.alias("native_script"), native.alias("transliteration_indicator"), (F.col("norm_addr") == "").cast("int").alias("empty_address"),
        (F.size("core") <= 1).cast("int").alias("single_token_name"), ((F.size("core") <= 1) | (count >= 150)).cast("int").alias("generic_high_frequency_indicator"),
        (F.col("gt_count") > 1).cast("int").alias("multi_match"), F.lit("").alias("outside_top_k"), F.lit("").alias("zero_overlap"), "name", F.col("addr").alias("address"),
    )


def summarize(diagnosed: DataFrame) -> DataFrame:
    """Totals of a diagnosis, with nearest-rank percentiles of candidate counts (half to even)."""
    some = F.col("gt_count") > 0
    w = Window.orderBy("candidate_count")
    n = diagnosed.count()  # one number, to turn a percentile into a rank
    # Counts are small integers: ranks come from their histogram, not from sorting all rows in one task.
    hist = diagnosed.groupBy("candidate_count").agg(F.count("*").alias("rows")).withColumn("upto", F.sum("rows").over(w))
    at = lambda p: F.min(F.when(F.col("upto") > int(_half_even((n - 1) * p)), F.col("candidate_count")))
    ranks = hist.agg(at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))
    totals = diagnosed.agg(
        (F.sum("recovered_gt_count") / F.sum("gt_count")).alias("candidate_pair_recall"), (F.sum(F.when(some, F.col("entity_full_recall"))) / F.sum(some.cast("int"))).alias("entity_full_recall"),
        F.sum(F.when(some, F.col("zero_recovery")).otherwise(0)).alias("zero_recovery_s1"), F.sum(some.cast("int")).alias("non_singleton_s1"),
        F.sum("candidate_count").alias("candidate_total"), F.min("candidate_count").alias("least"), F.avg("candidate_count").alias("mean"), F.max("candidate_count").alias("most"),
    )
    return totals.crossJoin(F.broadcast(ranks))  # one row each


def _half_even(x: float) -> float:
    return float(round(x))


def error_taxonomy(truth: DataFrame, scored: DataFrame) -> DataFrame:
    """(kind, reason, n): misses by where they were lost, false links by what they spoil. ``scored`` has p and accepted."""
    best = scored.groupBy("s1_id").agg(F.max("p").alias("best"))
    lost = truth.join(scored.select("s1_id", "target_id", "p", "accepted"), ["s1_id", "target_id"], "left").join(best, "s1_id", "left").where("accepted is null or not accepted")
    why = F.when(F.col("p").isNull(), "never_retrieved").when((F.col("best") >= 0.76) & (F.col("p") >= 0.45), "margin").otherwise("rejected")
    false = scored.where("accepted").join(truth, ["s1_id", "target_id"], "left_anti").join(truth.select("s1_id", F.lit(1).alias("some")).distinct(), "s1_id", "left")
    alarm = F.when(F.col("some").isNull(), "singleton_alarm").otherwise("multi_match_excess")
    return lost.select(F.lit("FN").alias("kind"), why.alias("reason")).unionByName(false.select(F.lit("FP").alias("kind"), alarm.alias("reason"))).groupBy("kind", "reason").agg(F.count("*").alias("n"))


def fp_breakdown(truth: DataFrame, links: DataFrame) -> DataFrame:
    """False links on records without any true match, and on others."""
    false = links.join(truth, ["s1_id", "target_id"], "left_anti").join(truth.select("s1_id", F.lit(1).alias("some")).distinct(), "s1_id", "left")
    return false.agg(F.sum(F.when(F.col("some").isNull(), 1).otherwise(0)).alias("on_singletons"), F.sum(F.when(F.col("some").isNotNull(), 1).otherwise(0)).alias("on_matched"))


def miss_taxonomy(truth: DataFrame, s1: DataFrame, targets: DataFrame, candidates: DataFrame, budget: int, frequent: int = 3000) -> DataFrame:
    """(cause, n) of true pairs that retrieval missed; the first cause that applies counts."""
    missed = truth.join(candidates.select("s1_id", "target_id"), ["s1_id", "target_id"], "left_anti")
    many = candidates.groupBy("s1_id").agg(F.count("*").alias("found"))
    busy = targets.select("country", F.explode(F.array_distinct("core")).alias("t")).groupBy("country", "t").count().where(F.col("count") > frequent)
    worn = s1.select(F.col("id").alias("s1_id"), "country", F.explode(F.array_distinct("core")).alias("t")).join(busy, ["country", "t"], "left_semi").select("s1_id", F.lit(True).alias("worn")).distinct()
    pick = lambda df, name, tag: df.select(F.col("id").alias(name), F.struct("core", "addr", "norm_addr", "name", "digits").alias(tag))
    p = missed.join(pick(s1, "s1_id", "x"), "s1_id").join(pick(targets, "target_id", "y"), "target_id", "left").join(many, "s1_id", "left").join(worn, "s1_id", "left")
    cause = (
        F.when(F.col("y").isNull(), "target_not_in_pool")
        .when(F.col("found") >= budget, "candidate_cap_truncation")
        .when(F.col("y.addr") == "", "missing_address_in_target")
        .when(X.has_indic_script(F.col("x.name")) != X.has_indic_script(F.col("y.name")), "indic_script_mismatch")
        .when(X.url_or_handle(F.col("x.name")) != X.url_or_handle(F.col("y.name")), "url_domain_handle_mismatch")
        .when(F.col("worn"), "high_frequency_token_pruned")
        .when((F.size("x.digits") > 0) & (F.size("y.digits") > 0) & ~F.arrays_overlap("x.digits", "y.digits"), "numeric_address_mismatch")
        .when(~F.arrays_overlap("x.core", "y.core"), "name_token_mismatch")
        .otherwise("compound_address_failure")
    )
    return p.groupBy(cause.alias("cause")).agg(F.count("*").alias("n"))


def channel_membership(truth: DataFrame, posted_s1: DataFrame, posted: DataFrame) -> DataFrame:
    """(s1_id, target_id, shared): the channels in which a true pair has a key in common, joined by commas."""
    keys = truth.join(posted_s1.select(F.col("target_id").alias("s1_id"), "country", "channel", "key"), "s1_id")
    both = keys.join(posted, ["country", "channel", "key", "target_id"], "left_semi").groupBy("s1_id", "target_id").agg(F.array_join(F.array_sort(F.collect_set("channel")), ",").alias("shared"))
    return truth.join(both, ["s1_id", "target_id"], "left").fillna("", ["shared"])


def miss_category(shared: Column) -> Column:
    return F.when(shared == "", "no_shared_key").when(shared == "ngram", "ngram_only").otherwise("ranking_or_pruned_key")


def profile_source(records: DataFrame) -> DataFrame:
    """One row per country and one (null country) for all: rows, distinct ids, empties, lengths."""
    empty = lambda c: F.sum((F.col(c) == "").cast("int"))
    return records.groupingSets([["country"], []], "country").agg(
        F.count("*").alias("n_rows"), F.countDistinct("id").alias("ids"), empty("name").alias("empty_names"), empty("addr").alias("empty_addresses"),
        F.min(F.char_length("name")).alias("name_min"), F.max(F.char_length("name")).alias("name_max"), F.avg(F.char_length("name")).alias("name_mean"),
        F.min(F.char_length("addr")).alias("addr_min"), F.max(F.char_length("addr")).alias("addr_max"), F.avg(F.char_length("addr")).alias("addr_mean"),
    )


def profile_truth(s1: DataFrame, truth: DataFrame, targets: DataFrame) -> DataFrame:
    """One row: singletons, match counts, and truth that breaks a rule (orphans, wrong prefixes, self matches)."""
    n = s1.select("s1_id").join(truth.groupBy("s1_id").agg(F.count("*").alias("n")), "s1_id", "left").fillna(0, ["n"])
    counts = n.groupBy("n").agg(F.count("*").alias("k")).withColumn("upto", F.sum("k").over(Window.orderBy("n"))).withColumn("all", F.sum("k").over(Window.partitionBy()))
    total = counts.agg(F.sum("k").alias("records"), F.sum(F.when(F.col("n") == 0, F.col("k")).otherwise(0)).alias("singletons"), (F.sum(F.col("n") * F.col("k")) / F.sum("k")).alias("mean"), F.min(F.when(F.col("upto") > F.floor(F.col("all") / 2), F.col("n"))).alias("median"), F.max("n").alias("most"))
    orphans = truth.join(targets.select(F.col("id").alias("target_id")), "target_id", "left_anti").agg(F.count("*").alias("orphans"))
    wrong = truth.agg(F.count_if(~F.rlike("target_id", F.lit("^S[23]-"))).alias("wrong_prefix"), F.count_if(F.col("target_id") == F.col("s1_id")).alias("self_matches"))
    return total.crossJoin(F.broadcast(orphans)).crossJoin(F.broadcast(wrong))  # one row each


def country_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("country").agg(F.count("*").alias("n"))


def output_summary(lists: DataFrame) -> DataFrame:
    """Of (s1_id, ids): matched records, singletons, links, links per matched record."""
    n = F.when(F.col("ids") == "", 0).otherwise(F.size(F.split("ids", ",")))
    return lists.select(n.alias("n")).agg(F.count_if(F.col("n") > 0).alias("matched"), F.count_if(F.col("n") == 0).alias("singletons"), F.sum("n").alias("links"), (F.sum("n") / F.greatest(F.lit(1), F.count_if(F.col("n") > 0))).alias("links_per_matched"))


def stratified_split(records: DataFrame, shares: dict[str, int], seed: str = "split-1") -> DataFrame:
    """(id, stratum, part): in each stratum (country, match bucket) the first shares[part] percent by a hash of the id.

    Parts are disjoint by construction, and the same in every run.
    """
    stratum = F.concat_ws("/", "country", X.match_bucket(F.col("n_truth")))
    r = records.withColumns({"stratum": stratum, "h": F.md5(F.concat(F.lit(seed + ":"), "id").cast("binary"))})
    w = Window.partitionBy("stratum")
    place = (F.row_number().over(w.orderBy("h", "id")) - 1) * 100 / F.count("*").over(w)
    part, upto = F.lit(None).cast("string"), sum(shares.values())
    for name in reversed(shares):
        part = F.when(place < upto, F.lit(name)).otherwise(part)
        upto -= shares[name]
    return r.select("id", "stratum", F.coalesce(part, F.lit("rest")).alias("part"))


def learn_token_mapping(pairs: DataFrame, least: int = 3, share: float = 0.6) -> DataFrame:
    """(variant, canonical, n): words at the same place of equally long token lists (a, b), where one reading dominates."""
    z = pairs.where(F.size("a") == F.size("b")).select(F.explode(F.arrays_zip("a", "b")).alias("z"))
    ok = lambda c: F.rlike(c, F.lit("^[\\x{00}-\\x{7F}]{3,}$"))
    n = z.where(ok(F.col("z.a")) & ok(F.col("z.b"))).groupBy(F.col("z.a").alias("variant"), F.col("z.b").alias("canonical")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("variant")
    n = n.withColumns({"total": F.sum("n").over(w), "best": F.max("n").over(w), "ties": F.sum(F.lit(1)).over(w.orderBy(F.desc("n")).rangeBetween(Window.unboundedPreceding, Window.currentRow))})
    return n.where((F.col("n") == F.col("best")) & (F.col("ties") == 1) & (F.col("n") >= least) & (F.col("n") / F.col("total") >= share) & (F.col("variant") != F.col("canonical"))).select("variant", "canonical", "n")


def reverse_variants(mapping: DataFrame) -> DataFrame:
    return mapping.groupBy("canonical").agg(F.array_join(F.array_sort(F.collect_set("variant")), ",").alias("variants"))


def unlearnable(pairs: DataFrame, similarities: Sequence[str], least: float = 0.25) -> DataFrame:
    """How many true pairs have no similarity of at least ``least``. ``pairs`` has is_match."""
    return pairs.where("is_match = 1").agg(F.count("*").alias("matches"), F.count_if(F.greatest(*similarities) < least).alias("unlearnable"))


def misses(s1: DataFrame, truth: DataFrame, targets: DataFrame, candidates: DataFrame) -> DataFrame:
    """(s1_id, target_id, country, reason, candidate_count): a row a true pair that is no candidate. ``s1`` has s1_id and country."""
    n = candidates.groupBy("s1_id").agg(F.count("*").alias("candidate_count"))
    lost = truth.join(candidates.select("s1_id", "target_id"), ["s1_id", "target_id"], "left_anti").join(targets.select(F.col("id").alias("target_id"), F.lit(1).alias("there")), "target_id", "left")
    reason = F.when(F.col("there").isNull(), "target_absent").otherwise("blocking_or_budget")
    return lost.join(s1.select("s1_id", "country"), "s1_id").join(n, "s1_id", "left").select("s1_id", "target_id", "country", reason.alias("reason"), F.coalesce("candidate_count", F.lit(0)).alias("candidate_count"))


def score_distribution(s1: DataFrame, truth: DataFrame, scored: DataFrame) -> DataFrame:
    """(s1_id, target_id, country, is_match, score) of every candidate."""
    hit = truth.select("s1_id", "target_id", F.lit(1).alias("hit")).distinct()
    return scored.join(hit, ["s1_id", "target_id"], "left").join(s1.select("s1_id", "country"), "s1_id").select("s1_id", "target_id", "country", F.coalesce("hit", F.lit(0)).alias("is_match"), F.col("p").alias("score"))


def false_negatives(s1: DataFrame, truth: DataFrame, scored: DataFrame, gate: float) -> DataFrame:
    """(s1_id, target_id, country, score, best_score, reason): true candidates that were not accepted."""
    best = scored.withColumn("best", F.max("p").over(Window.partitionBy("s1_id")))
    lost = best.where("not accepted").join(truth, ["s1_id", "target_id"], "left_semi").join(s1.select("s1_id", "country"), "s1_id")
    reason = F.when(F.col("best") < gate, "singleton_gate").otherwise("threshold_or_margin")
    return lost.select("s1_id", "target_id", "country", F.col("p").alias("score"), F.col("best").alias("best_score"), reason.alias("reason"))


def false_positives(s1: DataFrame, truth: DataFrame, scored: DataFrame) -> DataFrame:
    """(s1_id, target_id, country, score, best_score): accepted candidates that are not true."""
    best = scored.withColumn("best", F.max("p").over(Window.partitionBy("s1_id")))
    false = best.where("accepted").join(truth, ["s1_id", "target_id"], "left_anti").join(s1.select("s1_id", "country"), "s1_id")
    return false.select("s1_id", "target_id", "country", F.col("p").alias("score"), F.col("best").alias("best_score"))


def graph_recovery(truth: DataFrame, scored: DataFrame, posted: DataFrame) -> DataFrame:
    """One row a missed true pair: its record's retrieved and accepted true matches, and the channels that any of them shares with the missed one.

    (s1_id, target_id, retrieved_true, accepted_true, bridge_channels, accepted_bridge_channels); ``posted``: postings, or filed targets.
    Targets with the same keys are one kind, which shares all its channels with itself. Kinds meet by record, rather than pairs of
    targets key by key; only keys of different kinds are joined.
    """
    found = scored.select("s1_id", "target_id", F.coalesce("accepted", F.lit(False)).alias("accepted"))
    pairs = truth.select("s1_id", "target_id").distinct().join(found, ["s1_id", "target_id"], "left")
    marked = stage(pairs.groupBy("s1_id", "target_id").agg(F.max("accepted").alias("accepted")), "marked")
    lost, hit = marked.where("accepted IS NULL").drop("accepted"), marked.where("accepted IS NOT NULL")
    key = F.struct("channel", "key")
    rows = posted if "filed" in posted.columns else posted.groupBy("country", "target_id").agg(F.array_sort(F.collect_list(key)).alias("filed"))
    keys = F.filter("filed", lambda x: x["key"].isNotNull())
    sorts = rows.where("country IS NOT NULL").select("country", "target_id", keys.alias("filed")).withColumn("kind", F.unhex(F.sha2(F.to_json(F.struct("country", "filed")), 256)))
    kinds = stage(sorts.select("target_id", "kind", F.array_distinct("filed.channel").alias("channels")), "kinds")
    missed = lost.join(kinds.drop("channels"), "target_id").select("s1_id", "kind").distinct()
    near = hit.join(kinds, "target_id").groupBy("s1_id", F.col("kind").alias("near")).agg(F.max("accepted").alias("accepted"), F.any_value("channels").alias("channels"))
    met = stage(missed.join(near, "s1_id"), "met")
    shared = met.where("kind = near").select("s1_id", "kind", "accepted", "channels")
    other = met.where("kind <> near").select("kind", "near").distinct()
    if not other.isEmpty():
        asked = other.select("kind").union(other.select("near")).distinct()
        one = sorts.join(asked, "kind", "left_semi").groupBy("kind").agg(F.any_value("country").alias("country"), F.any_value("filed").alias("filed"))
        of = one.select("kind", "country", F.explode("filed").alias("x")).select("kind", "country", "x.channel", "x.key")
        own = other.join(of, "kind").join(of.withColumnRenamed("kind", "near"), ["country", "channel", "key", "near"], "left_semi")
        both = own.groupBy("kind", "near").agg(F.collect_set("channel").alias("channels"))
        shared = shared.unionByName(met.drop("channels").join(both, ["kind", "near"]).select("s1_id", "kind", "accepted", "channels"))
    every, sure = F.flatten(F.collect_list("channels")), F.flatten(F.collect_list(F.when(F.col("accepted"), F.col("channels"))))
    of_kind = shared.groupBy("s1_id", "kind").agg(F.array_distinct(every).alias("every"), F.array_distinct(sure).alias("sure"))
    of_record = hit.groupBy("s1_id").agg(F.count("*").alias("retrieved_true"), F.count_if("accepted").alias("accepted_true"))
    listed = lambda c: F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))), ",")
    bridged = lost.join(kinds.drop("channels"), "target_id").join(of_kind, ["s1_id", "kind"]).groupBy("s1_id", "target_id").agg(listed("every").alias("bridge_channels"), listed("sure").alias("accepted_bridge_channels"))
    out = lost.join(of_record, "s1_id", "left").join(bridged, ["s1_id", "target_id"], "left")
    return out.fillna(0, ["retrieved_true", "accepted_true"]).fillna("", ["bridge_channels", "accepted_bridge_channels"])
