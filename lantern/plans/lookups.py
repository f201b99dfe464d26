"""Queries of lookups across tables: glossary, claims, stored ids, loads, first differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lantern.functions import text as X
from lantern.operators import lookups as L

from .registry import query, read

GLOSSARY = """g AS (SELECT 'term ' || l_partkey % 40 AS term, CASE WHEN l_linenumber % 2 = 0 THEN upper('is ' || l_suppkey % 3) ELSE 'is ' || l_suppkey % 3 END AS definition, (l_orderkey + l_linenumber // 7) % 5 AS subject_id, l_orderkey AS chunk_id FROM lineitem),
p AS (SELECT g.subject_id, term, definition, chunk_id, o_orderkey // 10 AS ord, c_mktsegment || '/' || c_name AS path FROM g JOIN orders ON o_orderkey = chunk_id AND o_orderkey % 5 = subject_id JOIN customer ON c_custkey = o_custkey)"""


def _passages(spark, sf_dir) -> DataFrame:
    said = F.concat(F.lit("is "), (F.col("l_suppkey") % 3).cast("string"))
    glossary = read(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("term "), (F.col("l_partkey") % 40).cast("string")).alias("term"), F.when(F.col("l_linenumber") % 2 == 0, F.upper(said)).otherwise(said).alias("definition"),
        ((F.col("l_orderkey") + F.floor(F.col("l_linenumber") / 7)) % 5).alias("subject_id"), F.col("l_orderkey").alias("chunk_id"),
    )
    o = F.col("o_orderkey")
    chunks = read(spark, sf_dir, "orders").select(o.alias("chunk_id"), (o % 5).alias("subject_id"), F.col("o_custkey").alias("document_id"), F.floor(o / 10).alias("ord"), F.col("o_orderstatus").alias("text"))
    documents = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"), F.concat_ws("/", "c_mktsegment", "c_name").alias("path"))
    return L.glossary_passages(glossary, chunks, documents)


@query("WITH " + GLOSSARY + " SELECT subject_id, term, definition, chunk_id, ord, path FROM p")
def glossary_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms whose chunk, in their own subject, and whose document are there."""
    return _passages(spark, sf_dir).select("subject_id", "term", "definition", "chunk_id", "ord", "path")


@query("WITH " + GLOSSARY + """, t AS (SELECT subject_id, term, count(*) AS times, md5(string_agg(definition, '|' ORDER BY definition)) AS definitions, md5(string_agg(path, '|' ORDER BY path)) AS documents, count(DISTINCT lower(definition)) AS d, count(DISTINCT path) AS n FROM p GROUP BY 1, 2 HAVING count(*) > 1)
SELECT subject_id, term, times, definitions, documents, true AS raw FROM t UNION ALL SELECT subject_id, term, times, definitions, documents, false FROM t WHERE d > 1 AND n > 1""")
def definition_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms defined more than once, and those of them that conflict."""
    digest = lambda c: F.md5(F.array_join(c, "|")).alias(c)
    each = L.repeated_terms(_passages(spark, sf_dir)).select("subject_id", "term", "times", digest("definitions"), digest("documents"), "conflict")
    raw = F.explode(F.when(F.col("conflict"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True))))
    return each.withColumn("raw", raw).drop("conflict")


@query("""WITH a AS (SELECT l_orderkey AS response_id, l_partkey AS chunk_id FROM lineitem WHERE l_linenumber <= 3), k AS (SELECT DISTINCT l_orderkey AS response_id, l_partkey AS chunk_id FROM lineitem WHERE l_returnflag = 'R'),
w AS (SELECT o_orderkey AS chunk_id, o_orderstatus AS text, o_orderpriority AS unit, c_name AS path, n_nationkey AS code, n_name AS name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = o_orderkey % 25),
s AS (SELECT k.response_id, w.* FROM k JOIN w USING (chunk_id)) SELECT a.response_id, a.chunk_id, text, unit, path, code, name, s.chunk_id IS NOT NULL AS cited FROM a LEFT JOIN s ON a.response_id = s.response_id AND a.chunk_id = s.chunk_id""")
def cited_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that may be shown, as a claim cites them, with document and subject."""
    pairs = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("response_id"), F.col("l_partkey").alias("chunk_id"), "l_linenumber", "l_returnflag")
    o = F.col("o_orderkey")
    chunks = read(spark, sf_dir, "orders").select(o.alias("chunk_id"), F.col("o_custkey").alias("document_id"), (o % 25).alias("subject_id"), F.col("o_orderstatus").alias("text"), F.col("o_orderpriority").alias("unit"))
    documents = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"), F.col("c_name").alias("path"))
    subjects = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("subject_id"), F.col("n_nationkey").alias("code"), F.col("n_name").alias("name"))
    return L.cited_passages(pairs.where("l_linenumber <= 3").select("response_id", "chunk_id"), pairs.where("l_returnflag = 'R'"), chunks, documents, subjects)


@query("""WITH c AS (SELECT doc_id, source || '/' || lang AS path, doc_id // 3 AS ord FROM documents), s AS (SELECT source || '/' || lang AS path, doc_id // 3 AS ord, doc_id * 10 AS chunk_id FROM documents WHERE doc_id % 3 = 1)
SELECT c.doc_id, c.path, c.ord, s.chunk_id FROM c LEFT JOIN s ON c.path = s.path AND c.ord = s.ord""")
def stored_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates for a glossary with the ids under which their places are stored."""
    rows = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.col("source"), F.lit("/"), F.col("lang")).alias("path"), F.floor(F.col("doc_id") / 3).alias("ord"))
    return L.stored_ids(rows, rows.where("doc_id % 3 = 1").withColumn("chunk_id", F.col("doc_id") * 10)).select("doc_id", "path", "ord", "chunk_id")


@query("""SELECT CASE vec_id % 7 WHEN 0 THEN 'dump' WHEN 1 THEN 'secret' ELSE 'loaded' END AS reason, count(*) AS n FROM embeddings GROUP BY 1""")
def load_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks loaded with their vectors, and those left out by reason."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    left_out = e.where("vec_id % 7 < 2").select("vec_id", F.when(F.col("vec_id") % 7 == 0, "dump").otherwise("secret").alias("reason"))
    loaded, counts = L.loadable(e.select("vec_id"), left_out, {"vector": e.where("vec_id % 7 > 1")}, ["vec_id"])
    return counts.unionByName(loaded.agg(F.count("embedding").alias("n")).select(F.lit("loaded").alias("reason"), "n"))


@query("""WITH t AS (SELECT conv_id, turn, text AS a, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations), p AS (SELECT *, coalesce(list_filter(range(0, least(length(a), length(b))), lambda i: substr(a, i + 1, 1) <> substr(b, i + 1, 1))[1], least(length(a), length(b))) AS p0 FROM t WHERE a <> b)
SELECT conv_id, turn, CAST(p0 AS INT) AS place, substr(a, greatest(p0 - 40, 0) + 1, p0 + 40 - greatest(p0 - 40, 0)) AS a, substr(b, greatest(p0 - 40, 0) + 1, p0 + 40 - greatest(p0 - 40, 0)) AS b FROM p""")
def first_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each turn parts from the one before it, with what stands around."""
    rows = read(spark, sf_dir, "conversations").withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return rows.select("conv_id", "turn", X.difference(F.col("text"), F.col("before")).alias("d")).where("d is not null").select("conv_id", "turn", "d.*")
