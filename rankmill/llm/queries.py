"""The named queries of this subpackage, over whole tables with production parameters, and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import chat, language_id, licenses, media, mixing, quality, sentencepiece, sharding, simhash, toxicity
from .common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and hashed n-gram ratio of every text; trusted texts are those labelled of quality 1. Edge cases: quality.quality()."""
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text by PPM code length, learnt from rows that are not held out. Edge cases: language_id.language_id()."""
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard of every document by extendible hashing of its id. Edge cases: sharding.shards()."""
    return sharding.sharding(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated toxicity of every text from its nearest labelled examples that are not held out. Edge cases: toxicity.toxicity()."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces and N-best segmentations of every text. Edge cases: sentencepiece.encode_column()."""
    return sentencepiece.sentencepiece_nbest(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and template blocks of every text. Edge cases: licenses.scan()."""
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a WAV file, read back, with spectral-peak fingerprints. Edge cases: media.media_columns()."""
    return media.media_columns(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes. Edge cases: mixing.mixing()."""
    return mixing.mixing(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document. Edge cases: simhash.near_duplicates()."""
    return simhash.simhash_near_dedup(table(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation once more for each participant. Edge cases: chat.rotate()."""
    return chat.chat_format(table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_language_id, op3_sharding, op4_toxicity, op5_sentencepiece,
        op6_license_scan, op7_media_columns, op8_mixing, op9_simhash, op10_chat_format,
    )
} | {"pipeline": corpus_pipeline.run}

ORACLES = {"op3_sharding": sharding.SHARDING_SQL, "op8_mixing": mixing.MIXING_SQL, "op10_chat_format": chat.CHAT_SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
