"""Queries of the ten training-data operators: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from twinlake.llm import chat, embedding_dedup, media, mixing, ngram_join, oracles, packing, secrets, substring_dedup, suffix_dedup, toxicity


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_groups(_read(spark, sf_dir, "documents"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse_snapshots(_read(spark, sf_dir, "conversations"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.drop_repeats(_read(spark, sf_dir, "documents")))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan_secrets(_read(spark, sf_dir, "documents")))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.audio_features(media.store_text(_read(spark, sf_dir, "documents"))).drop("tensors")


def op7_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"), tokenizer=public_tokenizers.path("byte_bpe_50k.json"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, _read(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", toxicity.held_out(scored["doc_id"]).alias("held_out"), "score", "predicted")


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_read(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.drop_long_matches(_read(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_join, op2_embedding_dedup, op3_chat_formatting, op4_substring_dedup, op5_secret_scans, op6_media_columns, op7_curve_packing, op8_toxicity, op9_source_mixing, op10_suffix_dedup)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_join": oracles.NGRAM_JOIN, "op3_chat_formatting": chat.ORACLE, "op4_substring_dedup": oracles.SUBSTRING_DEDUP, "op5_secret_scans": secrets.oracle(),
        "op9_source_mixing": mixing.ORACLE, "op10_suffix_dedup": oracles.SUFFIX_DEDUP,
    }
