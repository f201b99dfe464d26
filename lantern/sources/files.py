"""Readers and writers of the file datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lantern import schemas
from lantern.operators.reconcile import insert_new, require_unique


class Malformed(ValueError):
    """A file that can't be taken as it is; says which line of which file."""


def bad_lines(spark: SparkSession, path: str, schema: str, required: list[str] | None = None) -> DataFrame:
    """file, line (from 1, blank ones counted) and reason of the first bad line of each split of the files: not a JSON object, not of the
    schema, or without a required field - null or an empty string; dots reach into structs.

    One pass: lines are numbered within their split as it is read, and splits are moved by the lines before them, so that what is
    shuffled is a row a split.
    """
    kinds = T._parse_datatype_string(schema)
    whole = T.StructType([*kinds.fields, T.StructField("_corrupt", T.StringType())])
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    read = lines.withColumn("r", F.when(F.length(F.trim("value")) > 0, F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})))
    lacks = lambda c: F.col(f"r.{c}").isNull() | (F.col(f"r.{c}").cast("string") == "")
    missing = F.filter(F.array(*(F.when(lacks(c), F.lit(c)) for c in required or [])), lambda x: x.isNotNull()) if required else F.array().cast("array<string>")
    reason = F.when(F.col("r._corrupt").isNotNull() | ~F.col("value").rlike(r"^\s*\{"), "malformed").when(F.size(missing) > 0, F.concat(F.lit("without "), F.array_join(missing, ", ")))
    marked = read.select("file", "block", "id", F.when(F.col("r").isNotNull(), reason).alias("reason"))
    splits = marked.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("lines"), F.min(F.when(F.col("reason").isNotNull(), F.struct("id", "reason"))).alias("bad"))
    before = F.sum("lines").over(Window.partitionBy("file").orderBy("block")) - F.col("lines")
    return splits.withColumn("before", before).where("bad is not null").select("file", (F.col("before") + F.col("bad.id") - F.col("first") + 1).alias("line"), F.col("bad.reason").alias("reason"))


def jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False, required: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """JSON lines; blank ones are skipped. strict: the first line that is malformed, or that has no value for a required field, is
    an error that names it and its file."""
    if strict and (bad := bad_lines(spark, path, schema, required).orderBy("file", "line").first()):
        raise Malformed(f"{bad['file']}: line {bad['line']}: {bad['reason']}")
    df = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)
    return df.limit(limit) if limit is not None else df


def inventory(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, size and SHA-256 of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def texts(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """path and whole text of every file below a folder."""
    files = spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def keyed_vectors(vectors: DataFrame, chunks: DataFrame, key: list[str]) -> DataFrame:
    """Chunks with their vectors, matched by key and never by position; repeated keys are an error."""
    return chunks.join(require_unique(vectors, key), key, "left")


def server_events(lines: DataFrame, stream: str = "stream_id", order: str = "n", line: str = "line") -> DataFrame:
    """Events out of `event:` and `data:` lines; a blank line ends one. stream, seq, event, data."""
    w = Window.partitionBy(stream).orderBy(order)
    ended = F.coalesce(F.sum(F.when(F.col(line) == "", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = lines.withColumn("seq", ended).where(F.col(line) != "")
    name = F.max(F.when(F.col(line).startswith("event:"), F.trim(F.expr(f"substring({line}, 7)"))))
    data = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(line).startswith("data:"), F.struct(F.col(order).alias("o"), F.trim(F.expr(f"substring({line}, 6)")).alias("d"))))), lambda x: x["d"]), "\n")
    return rows.groupBy(stream, "seq").agg(F.coalesce(name, F.lit("message")).alias("event"), data.alias("data"))


def html_text(html) -> object:
    """Text of a page without markup: scripts and styles go, blocks end lines, entities of the common signs are read."""
    c = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    c = F.regexp_replace(c, r"(?i)<(/p|/div|/li|/h[1-6]|/tr|br)[^>]*>", "\n")
    c = F.regexp_replace(c, r"<[^>]*>", " ")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\s*\n\s*", "\n"))


def write_chunks(chunks: DataFrame, path: str) -> None:
    """One directory a subject; a chunk without a vector is an error."""
    if not (bad := chunks.where(F.col("embedding").isNull())).isEmpty():
        raise ValueError(f"without a vector: {[r[0] for r in bad.select('chunk_id').limit(3).collect()]}")
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("subject_id").parquet(path)


def replace_scope(rows: DataFrame, path: str, scope: list[str]) -> None:
    """Replaces the scopes that the rows have, and no other."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*scope).parquet(path)


def append_new(spark: SparkSession, rows: DataFrame, path: str, key: list[str]) -> None:
    """Insert-ignore into a Parquet table."""
    try:
        target = spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        target = spark.createDataFrame([], rows.schema)
    insert_new(target, rows, key).write.mode("append").parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("lineSep", "\n").json(path)


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], T._parse_datatype_string(getattr(schemas, name.upper())))


def resumable(stored: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """What is still to do; stored keys that are no longer wanted are an error."""
    if not stored.join(wanted, key, "left_anti").isEmpty():
        raise ValueError("what is stored belongs to another input")
    return wanted.join(stored, key, "left_anti")



def append_run(spark: SparkSession, path: str, commit: str, config: dict, metrics: dict) -> None:
    """Adds an evaluation run - when, of which commit, with what settings and results - to a table of runs."""
    import json

    row = spark.range(1).select(F.current_timestamp().alias("ts"), *(F.lit(v).alias(n) for n, v in (("commit", commit), ("config", json.dumps(config, sort_keys=True)), ("metrics", json.dumps(metrics, sort_keys=True)))))
    row.write.mode("append").parquet(path)


def write_vectors(vectors: DataFrame, path: str, batch: str, key: list[str]) -> None:
    """A batch of vectors, then its keys: a batch counts once its keys are there, so a torn one is ignored and written again."""
    vectors.write.mode("overwrite").parquet(f"{path}/vectors/batch={batch}")
    vectors.select(*key).write.mode("overwrite").parquet(f"{path}/keys/batch={batch}")


def stored_vectors(spark: SparkSession, path: str, key: list[str]) -> DataFrame:
    """The vectors of all batches whose keys were written too."""
    done = spark.read.option("basePath", f"{path}/keys").parquet(f"{path}/keys").select(*key, "batch")
    return spark.read.option("basePath", f"{path}/vectors").parquet(f"{path}/vectors").join(done, [*key, "batch"], "left_semi")


def token_stream(spark: SparkSession, folder: str, response: str = r"response-(\d+)") -> DataFrame:
    """Streaming: response_id, seq and text of tokens out of files of `data:` lines as a model's server writes them; the id
    is in the file's name. Lines without a token, and the closing one, are left out."""
    lines = spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").load(folder)
    name = F.regexp_extract(F.input_file_name(), response, 1).try_cast("bigint")
    rows = lines.select(name.alias("response_id"), F.posexplode(F.split("value", "\n")).alias("seq", "line")).where(F.col("line").startswith("data:"))
    token = F.get_json_object(F.trim(F.expr("substring(line, 6)")), "$.choices[0].delta.content")
    return rows.select("response_id", F.col("seq").cast("long").alias("seq"), token.alias("text")).where("text is not null")
