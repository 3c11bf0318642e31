"""The queries of this subpackage's operators and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from missive.llm import op01_simhash, op02_license, op03_tokens, op04_language, op05_exact, op06_packing, op07_sharding, op08_decontaminate, op09_pii, op11_token_counts, op12_whitening, op13_resampling
from missive.llm import op10_warc as op10_warc_module
from missive.llm.common import bounded_batches, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    found = op01_simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", op01_simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id", "group_size")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op02_license.scan(table(spark, sf_dir, "documents"))


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op03_tokens.token_digests(spark, table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return op04_language.identify(docs, op04_language.fit(docs))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op05_exact.exact_duplicates(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op06_packing.packed(table(spark, sf_dir, "documents"))


def op7_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op07_sharding.shard(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op08_decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op09_pii.digest(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op10_warc_module.archive(spark, table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "history_rank")


def op11_token_counts_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_token_counts.token_counts(table(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op12_whitening.whiten(table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_license_scan": op2_license_scan,
    "op3_token_output": op3_token_output,
    "op4_language_id": op4_language_id,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_kd_sharding": op7_kd_sharding,
    "op8_decontamination": op8_decontamination,
    "op9_pii": op9_pii,
    "op10_warc": op10_warc,
    "op11_token_counts": op11_token_counts_,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_importance_resampling": op13_importance_resampling,
}

SQL: dict[str, str] = {"op2_license_scan": op02_license.sql(), "op5_exact_dedup": op05_exact.SQL, "op10_warc": op10_warc_module.SQL, "op13_importance_resampling": op13_resampling.SQL}
