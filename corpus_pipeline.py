"""A training corpus in five stages, each one operator of ``twinlake.llm``."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from twinlake.llm import mixing, ngram_join, packing, secrets, toxicity
from twinlake.llm._stage import fields, stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, does not reject.

    Null and empty texts stay, very long ones are scored whole; without labels, or with those of one
    class, nothing is rejected. Like every stage it keeps repeated rows and columns of any name and
    type, and leaves an empty table empty.
    """
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.scored_rows(docs, model).where("predicted = 0").select(*fields("row", docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies; texts without words stay, of repeated rows one stays."""
    return ngram_join.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, live-looking credentials masked; null and empty texts and repeated rows stay as they are."""
    return secrets.mask_live(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; those without words add nothing, null sources are one source."""
    return mixing.repeat_texts(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens; null ids and repeated rows are packed each, very long texts whole."""
    return packing.pack_documents(docs, tokenizer=public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("secret_scans", mask_secrets),
    ("source_mixing", mix),
    ("curve_packing", pack),
]

#: The classifier and the tokens can't be expressed in SQL; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each is written and read back before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
