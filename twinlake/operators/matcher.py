"""Training pairs and the tree classifier, on ``pyspark.ml``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def training_pairs(ranked: DataFrame, truth: DataFrame, targets: DataFrame, add_missing: bool = True) -> DataFrame:
    """Candidates with is_match; true targets in the pool that retrieval missed are appended last, with the top weight (15 if there is none)."""
    marked = ranked.join(truth.withColumn("is_match", F.lit(1)), ["s1_id", "target_id"], "left").fillna(0, ["is_match"])
    if not add_missing:
        return marked
    top = ranked.groupBy("s1_id").agg(F.max("weight").alias("weight"), (F.max("rank") + 1).alias("next"))
    lost = truth.join(ranked.select("s1_id", "target_id"), ["s1_id", "target_id"], "left_anti").join(targets.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    place = F.row_number().over(Window.partitionBy("s1_id").orderBy("target_id")) - 1
    more = lost.join(top, "s1_id", "left").select("s1_id", "target_id", F.coalesce("weight", F.lit(15.0)).alias("weight"), (F.coalesce("next", F.lit(0)) + place).alias("rank"), F.lit(1).alias("is_match"))
    return marked.unionByName(more, allowMissingColumns=True)


def hard_negatives(pairs: DataFrame, most: int = 10_000) -> DataFrame:
    """All matches, and each record's heaviest non-matches."""
    w = Window.partitionBy("s1_id", "is_match").orderBy(F.desc(F.round("weight", 6)), "target_id")
    return pairs.withColumn("r", F.row_number().over(w)).where((F.col("is_match") == 1) | (F.col("r") <= most)).drop("r")


def fit_matcher(features: DataFrame, names: Sequence[str], *, rounds: int = 20, depth: int = 5, step: float = 0.1, seed: int = 7) -> PipelineModel:
    """Boosted trees over the named features; values are rounded to 32 bits as the model sees them."""
    tree = GBTClassifier(labelCol="is_match", featuresCol="features", maxIter=rounds, maxDepth=depth, stepSize=step, subsamplingRate=0.85, featureSubsetStrategy="0.9", minInstancesPerNode=10, seed=seed)
    model = Pipeline(stages=[VectorAssembler(inputCols=list(names), outputCol="features", handleInvalid="keep"), tree]).fit(_single(features, names))
    return model


def _single(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("float").cast("double") for c in names})


def predict(model: PipelineModel, features: DataFrame, names: Sequence[str]) -> DataFrame:
    """Features with ``p``; fails if the model was trained on other names or another order."""
    trained = model.stages[0].getInputCols()
    if list(names) != trained:
        raise ValueError("features differ from those the model was trained on")
    out = model.transform(_single(features, names))
    return out.withColumn("p", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def cross_fit(features: DataFrame, names: Sequence[str], *, most: int = 10_000, **settings) -> DataFrame:
    """Every row with ``p`` from a model of the other ``half`` (0 or 1); where that has one class only, its share of matches (0 without rows)."""
    classes = {(r.half, r.is_match): r.n for r in features.groupBy("half", "is_match").agg(F.count("*").alias("n")).collect()}
    parts = []
    for half in (0, 1):
        train, rest = features.where(F.col("half") != half), features.where(F.col("half") == half)
        no, yes = (classes.get((1 - half, k), 0) for k in (0, 1))
        parts.append(predict(fit_matcher(hard_negatives(train, most), names, **settings), rest, names) if no and yes else rest.withColumn("p", F.lit(float(yes > 0))))
    return parts[0].select("s1_id", "target_id", "p").unionByName(parts[1].select("s1_id", "target_id", "p"))


def importances(model: PipelineModel, most: int = 10) -> list[tuple[str, float]]:
    pairs = zip(model.stages[0].getInputCols(), model.stages[1].featureImportances.toArray().tolist(), strict=True)
    return sorted(pairs, key=lambda x: -x[1])[:most]


def sweep(train: DataFrame, validation: DataFrame, names: Sequence[str], settings: Sequence[dict]) -> list[tuple[dict, float]]:
    """Area under the curve of each setting on the validation rows, the best first."""
    judge = BinaryClassificationEvaluator(labelCol="is_match")
    return sorted(((s, judge.evaluate(fit_matcher(train, names, **s).transform(_single(validation, names)))) for s in settings), key=lambda x: -x[1])
