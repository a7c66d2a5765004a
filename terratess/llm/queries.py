"""Queries opN_* over whole tables, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terratess.llm import op01_langid, op02_urlfilter, op03_mixing, op04_quality, op05_packing, op06_topk, op07_secrets, op08_minhash, op09_rules, op10_license
from terratess.llm.sql import ORACLES
from terratess.shipping import ship

RULES = (op02_urlfilter.Rule("block", "net", "/"), op02_urlfilter.Rule("allow", "example.net", "/en/"), op02_urlfilter.Rule("block", "example.com", "/de/"), op02_urlfilter.Rule("allow", "org", "/fr/"))


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))  # a null id has no remainder
    model = op01_langid.learn(docs.where(~held_out))
    found = op01_langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), F.col("best").alias("lang_pred"), "score", "rejected")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op02_urlfilter.filter_urls(_read(spark, sf_dir, "pages"), RULES)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    rated = op03_mixing.rates(docs)
    return rated.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op04_quality.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op05_packing.pack(_read(spark, sf_dir, "documents"))


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op06_topk.search(_read(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: candidates, secrets, the secrets' places as ``start:length`` joined by commas, and the CRC-32 of the cleaned text."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    forest = op07_secrets.train(op07_secrets.example_findings(spark))
    found = op07_secrets.scan(docs, forest)
    kept = F.filter("secrets", lambda s: s["accepted"])
    places = F.array_join(F.transform(kept, lambda s: F.concat(s["start"].cast("string"), F.lit(":"), s["length"].cast("string"))), ",")
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return found.select("doc_id", size(F.col("secrets")).alias("n_candidates"), size(kept).alias("n_secrets"), places.alias("spans"), F.crc32(F.col("clean_text").cast("binary")).alias("clean_crc32"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op08_minhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = op09_rules.judge(_read(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_stop_words", "n_lines")


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_license.labelled(op10_license.scan(_read(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_language_id, op2_url_filters, op3_mixing, op4_quality_classifier, op5_packing, op6_exact_topk, op7_secret_scans, op8_minhash_near_dedup, op9_quality_rules, op10_license_scans)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
