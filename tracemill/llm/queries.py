"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontam, divergence, fingerprint, manifest, packing, pii, quality, rules, sharding, simhash, substring, tokencount, toxicity


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_docs(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op2_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count(_docs(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_docs(spark, sf_dir))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_docs(spark, sf_dir))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(_docs(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(_docs(spark, sf_dir))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_docs(spark, sf_dir))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.removal_digests(_docs(spark, sf_dir))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_docs(spark, sf_dir))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.merkle_manifest(_docs(spark, sf_dir))


def op12_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.line_rules(_docs(spark, sf_dir))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_docs(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_quality_qda, op2_token_count, op3_toxicity, op4_packing, op5_pii, op6_decontamination, op7_order_minhash, op8_sharding, op9_substring_dedup, op10_simhash, op11_merkle_manifest, op12_line_rules, op13_source_divergence)}
