"""The corpus pipeline: documents to packed training sequences, each stage written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terratess.llm import op03_mixing, op04_quality, op05_packing, op07_secrets, op08_minhash
from terratess.shipping import ship
from terratess.staging import stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps."""
    ship(spark)
    return op04_quality.filter_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each near-duplicate group: that of the smallest id. Rows go only for their own texts, so other texts of an id stay; equal rows of an id are one, and rows without an id all stay."""
    ship(spark)
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        found = op08_minhash.of_unique_ids(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
        gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("gone_id"))
        return docs.join(gone.hint("shuffle_hash"), docs["doc_id"] == gone["gone_id"], "left_anti")
    # ids repeat: each text of an id is a document of its own, numbered in the order of ids
    rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("words"), F.struct(*docs.columns).alias("row"))
    once = rows.where("id is not null").dropDuplicates(["id", "words"]).orderBy("id", "words")
    numbered = stage(once.select(F.monotonically_increasing_id().alias("place"), "row"), "numbered")
    found = op08_minhash.of_unique_ids(numbered.select(F.col("place").alias("doc_id"), F.col("row")["text"].cast("string").alias("text")))
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("gone_place"))
    left = numbered.join(gone.hint("shuffle_hash"), F.col("place") == F.col("gone_place"), "left_anti")
    return left.unionByName(rows.where("id is null").select(F.lit(None).cast("long").alias("place"), "row")).select("row.*")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced."""
    return op07_secrets.redact(docs, op07_secrets.train(op07_secrets.example_findings(spark)))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return op03_mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    ship(spark)
    return op05_packing.pack(docs)


STAGES = [("quality classifier", quality), ("MinHash near-dedup", deduplicated), ("secret scans", without_secrets), ("mixing sources", mixed), ("packing", packed)]

#: Fitted models, tokenisation and dynamic programming are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
