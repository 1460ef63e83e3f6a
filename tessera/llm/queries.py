"""The opN_ queries: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import byte_bpe, collocations, decontamination, divergence, embedding_dedup, license_scan, line_dedup, maxent_lm, nbsvm, ngram_join, secrets, sharding, substring_dedup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbsvm.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digests(table(spark, sf_dir, "documents"))


def op3_maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.score(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digests(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.chunk_digests(table(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.report(table(spark, sf_dir, "documents"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.token_digests(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination_digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_shuffle_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_table(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_report(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_line_dedup, op3_maxent_scores, op4_secret_scan, op5_substring_dedup, op6_embedding_dedup, op7_license_scan, op8_ngram_join, op9_byte_bpe, op10_decontamination, op11_shuffle_shards, op12_source_divergence, op13_collocations)}

#: DuckDB SQL of the queries that SQL can express.
ORACLE: dict[str, str] = {"op2_line_dedup": line_dedup.ORACLE, "op10_decontamination": decontamination.ORACLE, "op12_source_divergence": divergence.ORACLE, "op13_collocations": collocations.ORACLE}
