"""From raw documents to token ids: five stages, each of which reads what the one before it wrote.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents, but for the last, which returns tokens.
"""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.llm.decontaminate import decontaminate
from lantern.llm.jaccard import jaccard_join
from lantern.llm.pieces import encode
from lantern.llm.queries import tokenizer
from lantern.llm.shared import cut, folder, table
from lantern.llm.suffixes import suffix_dedup
from lantern.llm.toxicity import categories, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keyed(docs: DataFrame) -> DataFrame:
    """Adds key, a 64-bit hash of all columns that tells rows apart whatever their ids; rows equal in all of them share it."""
    nulls = F.concat(*(F.when(F.col(c).isNull(), "1").otherwise("0") for c in COLUMNS))  # the hash itself skips nulls
    return docs.select(*COLUMNS, F.xxhash64(nulls, *COLUMNS).alias("key"))


def one_each(rows: DataFrame) -> DataFrame:
    """One row of each key. Texts move only if some key is repeated."""
    again = cut(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    if again.isEmpty():
        return rows
    return cut(rows.join(again, "key", "left_anti").unionByName(rows.join(again, "key", "left_semi").dropDuplicates(["key"])))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier chain rejects go, each judged on its own text, whatever its id; null and empty texts have
    no words and are judged by the models' answer to that. Without labels of both kinds nothing goes."""
    judged = toxicity(docs, table(spark, sf_dir, "labels"), categories(), decide="toxic")
    return judged.where(~F.col("is_toxic")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of rows that five-word shingles link at 0.8 or more, the one with the smallest id stays, null ids last.

    Rows are judged one by one, also those that share an id or have none. Texts without words link to nothing and stay.
    """
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = one_each(keyed(docs.where(worded)))
    groups = jaccard_join(rows, n=5, percent=80, id_column="key").select("key", "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")).alias("first")
    keep = groups.join(rows.select("key", "doc_id"), "key").groupBy("component_id").agg(first).select("first.key")
    return rows.join(keep, "key", "left_semi").select(*COLUMNS).unionByName(docs.where(~worded).select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every byte in a 200-byte string that also starts elsewhere goes; characters that a cut would split stay whole.

    Every row stays, if only with an empty text; a null text becomes an empty one.
    """
    cut = suffix_dedup(docs.select(*COLUMNS), least=200, mode="text")
    return cut.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of which benchmark windows cover a twentieth of the words or more go, whatever their ids. Rows without words
    stay, and all do if the benchmark is empty."""
    rows = keyed(docs)
    judged = decontaminate(rows, table(spark, sf_dir, "benchmark"), id_column="key", width=13, least_share=0.05)
    bad = judged.where("contaminated").select("key").distinct()
    return rows.join(bad, "key", "left_anti").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and decoded text of each row, whatever its id: doc_id, n_tokens, ids, decoded, n_differ. Null and empty
    texts have no ids."""
    return encode(docs, tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("sentencepiece", tokens),
]

#: SQL cannot express the trained classifier; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each is written as Parquet to the cluster's shared folder and read again. The folder of a
    run stays, as its result is read from the last one; empty documents give no rows."""
    place = posixpath.join(folder(spark), f"pipeline-{uuid.uuid4().hex}")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{place}/{i}_{name}")
            docs = spark.read.parquet(f"{place}/{i}_{name}")
    return docs
