"""Small Spark helpers of the operators."""

from __future__ import annotations

import gc
import posixpath
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The folder that all machines share, as the session names it. Where it names none, as in tests, and there is but one
    machine, a temporary folder; on a cluster that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="lantern-")


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and go on from there, so that a lost executor costs no recomputation."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Like cut, as a Parquet table of the shared folder: the planner knows its size then, and broadcasts it only if small."""
    at = posixpath.join(folder(df.sparkSession), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def bucketed(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Like written, dealt by the keys into as many files as a shuffle has partitions: joins by the keys shuffle their other side
    only. The table's name is gone from the catalogue at once, its files stay in the shared folder."""
    spark = df.sparkSession
    n, table = int(spark.conf.get("spark.sql.shuffle.partitions", "200")), f"{name}_{uuid.uuid4().hex}"
    at = posixpath.join(folder(spark), table)
    df.repartition(n, *keys).write.format("parquet").option("path", at).option("compression", "zstd").bucketBy(n, *keys).sortBy(*keys).saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Removes what an operator wrote to the shared folder itself and nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back(spark: SparkSession) -> None:
    """Has Spark remove the shuffle files of frames that are gone, which it does when the driver's garbage is collected: rounds
    that each leave a few small files for every partition would fill disks until then."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def row_key(doc_id, text):
    """Tells rows apart, even those that share an id; rows equal in both count as one."""
    return F.xxhash64(doc_id, text)


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 80) -> DataFrame:
    """(node, component): the smallest node that can be reached over the undirected edges.

    Alternating large-star and small-star steps; the number of rounds grows with the logarithm of the diameter.
    Rows stay in Spark, each round is cut, minima are combined before they are shuffled, and a hub's edges are a
    skewed join that adaptive execution splits. Nodes without an edge do not appear; self edges and repeats do no harm.
    """
    hi, lo = F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")
    e = cut(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(hi, lo).distinct())
    mark = None
    for _ in range(rounds):
        seen = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(hi, lo))")).first()
        if tuple(seen) == mark or not seen[0]:
            break
        mark = tuple(seen)
        lows = e.select(F.col("hi").alias("lo"), F.col("lo").alias("x")).unionByName(e.select("lo", F.col("lo").alias("x")))
        large = e.join(lows.groupBy("lo").agg(F.min("x").alias("m")), "lo").select("hi", F.col("m").alias("lo"))
        parent = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(parent, "hi").where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        e = cut(small.unionByName(parent.select("hi", F.col("m").alias("lo"))).distinct())
        del lows, large, parent, small
        give_back(e.sparkSession)
    else:
        raise RuntimeError("components did not settle")
    tops = e.select(F.col("lo").alias("node")).distinct()
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(tops.select("node", F.col("node").alias("component")))
