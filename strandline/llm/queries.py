"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import html_text, language_model, merkle, minhash_dedup, mix_sources, nearest, oracle, packing, quality_model, quality_rules, resampling, secret_scan, substring_dedup, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(_table(spark, sf_dir, "documents")).drop("spans")


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.minhash_dedup(_table(spark, sf_dir, "documents"), k=4)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality_classifier(_table(spark, sf_dir, "documents"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(_table(spark, sf_dir, "embeddings"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_scan(_table(spark, sf_dir, "documents")).drop("judged")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(_table(spark, sf_dir, "pages")).drop("url")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources.mix_sources(_table(spark, sf_dir, "documents")).drop("source")


def op11_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.language_model_scores(_table(spark, sf_dir, "documents"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.merkle(_table(spark, sf_dir, "documents")).drop("copies")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality_rules, op2_substring_dedup, op3_minhash_dedup, op4_html_text, op5_packing, op6_quality_classifier, op7_nearest, op8_secret_scan, op9_warc, op10_mix_sources, op11_language_model, op12_resampling, op13_merkle)}

#: Compression, a trained tree, a fitted scorer, token ids, an approximate index and a latent model are beyond SQL.
ORACLE_SQL: dict[str, str] = {"op2_substring_dedup": oracle.SUBSTRING, "op3_minhash_dedup": oracle.NEAR, "op8_secret_scan": oracle.SECRETS, "op9_warc": oracle.ARCHIVES, "op10_mix_sources": oracle.MIX, "op12_resampling": oracle.RESAMPLE, "op13_merkle": oracle.MANIFEST}
