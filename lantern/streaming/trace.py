"""Answers of a stream as a trace that can be replayed: requests, responses and claims, one folder a micro-batch each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = ("requests", "claims", "responses")
#: What a request and a response have; whatever else an answer's row has goes into the response's payload.
REQUEST = ["request_id", "text", "mode", "subject_id", "user_id", "prompt_version", "corpus_version"]
RESPONSE = ["response_id", "request_id", "model", "ttft_ms", "total_ms", "tokens_in", "tokens_out", "cost", "abstained"]


def claims_of(rows: DataFrame, claims: str = "claims", response: str = "response_id") -> DataFrame:
    """response, n (from 1), type, text, chunk_id, verdict and the whole claim as JSON, out of an array of claims as text.
    An array that can't be read has no claims."""
    each = rows.select(response, F.posexplode(F.from_json(claims, "array<string>")).alias("n", "detail"))
    one = lambda name: F.get_json_object("detail", f"$.{name}")
    chunk = F.regexp_extract(one("fragmento"), "^F?([0-9]+)$", 1).try_cast("bigint")
    return each.select(response, (F.col("n") + 1).alias("n"), one("tipo").alias("type"), one("texto").alias("text"), chunk.alias("chunk_id"), F.coalesce(one("veredicto"), F.lit("sin_verificar")).alias("verdict"), "detail")


def tables_of(answers: DataFrame) -> dict[str, DataFrame]:
    """The three tables of a batch of answers: columns of REQUEST and RESPONSE, claims as JSON text, and whatever else."""
    have = [c for c in answers.columns if c not in {*REQUEST, *RESPONSE, "claims"}]
    pick = lambda names: [F.col(c) if c in answers.columns else F.lit(None).cast("string").alias(c) for c in names]
    payload = F.to_json(F.struct(*have)) if have else F.lit("{}")
    return {"requests": answers.select(*pick(REQUEST)).dropDuplicates(["request_id"]), "claims": claims_of(answers), "responses": answers.select(*pick(RESPONSE), payload.alias("payload"))}


def trace_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function. A batch has a folder of its own in each table, which a replay of it writes anew; responses
    are written last, and a batch counts once they are there. The rows are written first and read again, so that what
    comes before is computed once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        at = f"{path}/answers/batch={batch_id}"
        batch.write.mode("overwrite").parquet(at)
        tables = tables_of(batch.sparkSession.read.schema(batch.schema).parquet(at))
        for name in TABLES:
            tables[name].write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")

    return write


def read_trace(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables without batches that were torn; a response or request that came twice is that of its first batch."""
    done = spark.read.option("basePath", f"{path}/responses").parquet(f"{path}/responses").select("response_id", "batch")
    first = done.groupBy("response_id").agg(F.min("batch").alias("batch"))
    out = {}
    for name, key in (("requests", ["request_id"]), ("claims", ["response_id", "n"]), ("responses", ["response_id"])):
        rows = spark.read.option("basePath", f"{path}/{name}").parquet(f"{path}/{name}")
        if name == "requests":
            rows = rows.join(done.select("batch").distinct(), "batch", "left_semi")
        else:
            rows = rows.join(first, ["response_id", "batch"], "left_semi")
        order = Window.partitionBy(*key).orderBy("batch")
        out[name] = rows.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n", "batch")
    return out
