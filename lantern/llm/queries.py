"""The registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .centroids import cluster
from .counts import token_counts
from .decontaminate import decontaminate
from .divergence import divergence
from .doubling import substring_dedup
from .jaccard import jaccard_join
from .licenses import license_scan
from .neighbours import nearest
from .pieces import encode
from .shared import table
from .sharding import shard
from .suffixes import suffix_dedup
from .toxicity import categories, toxicity
from .urls import url_filter


def tokenizer(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"), n=4, percent=85)


def op2_shard_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), shards=8)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(table(spark, sf_dir, "documents"), words=13, mode="digest")
    return found.select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


# The rules of the URL filter's query.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), URL_RULES)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity(documents, table(spark, sf_dir, "labels"), categories(), decide="toxic").drop("text")


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), least=200, mode="digest")
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept").alias("kept_sha256"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), tokenizer(), digests=True)


def op8_one_bit_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=13, least_share=0.05)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no paths: documents are laid out by source, language and thousand, some as licence files."""
    folder = F.concat_ws("/", "source", "lang")
    deep = F.concat_ws("/", folder, F.floor(F.col("doc_id") / 1024).cast("string"))
    path = F.when(F.col("doc_id") % 256 == 0, F.concat(folder, F.lit("/LICENSE."), F.col("doc_id").cast("string")))
    path = path.when(F.col("doc_id") % 64 == 0, F.concat(deep, F.lit("/LICENSE."), F.col("doc_id").cast("string")))
    path = path.otherwise(F.concat(deep, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")))
    files = table(spark, sf_dir, "documents").withColumn("path", path)
    return license_scan(files, F.col("path").rlike("(^|/)(LICENSE|COPYING)[^/]*$"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"), least=3, top=200)


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"), k=8, rounds=10, dims=64, scale=1024)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer(), limit=4096)


QUERIES = {name: f for name, f in sorted(vars(sys.modules[__name__]).items()) if name.startswith("op") and name[2].isdigit()}
ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard": oracles.jaccard(n=4, percent=85),
    "op3_substring_dedup": oracles.substring(words=13),
    "op9_benchmark_decontamination": oracles.contamination(width=13),
    "op11_source_divergence": oracles.divergence(),
    "op12_centroids": oracles.centroids(),
}
