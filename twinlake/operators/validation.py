"""Checks of result lists: one table of findings (rule, n, samples)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _exploded(lists: DataFrame) -> DataFrame:
    return lists.where("ids <> ''").select("s1_id", F.posexplode(F.split("ids", ",")).alias("pos", "target_id"))


RULES = ("duplicate_row", "duplicate_in_list", "empty_in_list", "self_match", "bad_prefix", "unknown_id", "missing_s1", "extra_s1")


def _found(rule: str, rows: DataFrame, sample: str) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), F.col(sample).cast("string").alias("x"))


def _summary(spark: SparkSession, found: DataFrame, rules: tuple[str, ...]) -> DataFrame:
    """(rule, n, samples) of each rule: how many findings, and their five smallest samples. Counted by sample first, so nothing is gathered."""
    each = found.groupBy("rule", "x").agg(F.count("*").alias("m"))
    smallest = each.withColumn("place", F.row_number().over(Window.partitionBy("rule").orderBy("x")))
    samples = F.array_join(F.array_sort(F.collect_list(F.when((F.col("place") <= 5), F.col("x")))), ",")
    counts = smallest.groupBy("rule").agg(F.sum("m").alias("n"), samples.alias("samples"))
    every = spark.createDataFrame([(r,) for r in rules], "rule string")
    return every.join(counts, "rule", "left").select("rule", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("samples", F.lit("")).alias("samples"))


def _findings(matches: DataFrame, s1: DataFrame, targets: DataFrame) -> DataFrame:
    """(rule, x): a row a finding. Each input is read once: lists and records meet once, list entries and targets once."""
    lists = matches.groupBy("s1_id").agg(F.count("*").alias("times")).join(s1.select("s1_id", F.lit(1).alias("there")).distinct(), "s1_id", "full_outer")
    when = lambda c, rule: F.when(c, F.lit(rule))
    t = F.col("times")
    by_list = F.filter(F.array(when(t > 1, "duplicate_row"), when(t.isNull(), "missing_s1")), lambda r: r.isNotNull())
    extra = F.when(F.col("there").isNull(), F.array_repeat(F.lit("extra_s1"), t.cast("int"))).otherwise(F.array().cast("array<string>"))
    one = lists.select(F.explode(F.concat(by_list, extra)).alias("rule"), F.col("s1_id").alias("x"))
    each = _exploded(matches).groupBy("s1_id", "target_id").agg(F.count("*").alias("times"))
    each = each.join(targets.select(F.col("id").alias("target_id"), F.lit(1).alias("known")).distinct(), "target_id", "left")
    own, target, n = F.col("s1_id"), F.col("target_id"), F.col("times").cast("int")
    rules = {
        "duplicate_in_list": (t > 1, F.lit(1), target), "empty_in_list": (target == "", n, own), "self_match": (target == own, n, own),
        "bad_prefix": (~F.rlike(target, F.lit("^S[23]-")), n, target), "unknown_id": (F.col("known").isNull(), n, target),
    }
    none = F.array().cast("array<struct<rule:string,x:string>>")
    by_entry = [F.when(c, F.array_repeat(F.struct(F.lit(rule).alias("rule"), x.alias("x")), times)).otherwise(none) for rule, (c, times, x) in rules.items()]
    return one.unionByName(each.select(F.explode(F.concat(*by_entry)).alias("f")).select("f.rule", "f.x"))


def validate(matches: DataFrame, s1: DataFrame, targets: DataFrame) -> DataFrame:
    """Findings about (s1_id, ids) rows: repeats, blanks, self matches, wrong prefixes, unknown, missing and extra records."""
    return _summary(matches.sparkSession, _findings(matches, s1, targets), RULES)


def not_in_candidates(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """Matched pairs that are no candidates."""
    return _exploded(matches).select("s1_id", "target_id").join(_exploded(candidates).select("s1_id", "target_id"), ["s1_id", "target_id"], "left_anti")


def validate_strictly(matches: DataFrame, candidates: DataFrame, s1: DataFrame, targets: DataFrame) -> DataFrame:
    """The same with order and the subset rule as errors. All three inputs carry ``seq``, their row numbers."""
    order = s1.select("seq", F.col("s1_id").alias("want")).join(matches.select("seq", "s1_id"), "seq", "full_outer").where("want is distinct from s1_id").select(F.coalesce("s1_id", "want").alias("s1_id"))
    found = _findings(matches.select("s1_id", "ids"), s1.select("s1_id"), targets)
    found = found.unionByName(_found("order", order, "s1_id")).unionByName(_found("not_in_candidates", not_in_candidates(matches, candidates), "target_id"))
    return _summary(matches.sparkSession, found, (*RULES, "order", "not_in_candidates"))


def overlap(parts: DataFrame, a: str, b: str) -> DataFrame:
    """Ids that two parts of a split share; empty if it is disjoint."""
    one = parts.where(F.col("part") == a).select("id")
    return one.join(parts.where(F.col("part") == b).select("id"), "id", "left_semi")
