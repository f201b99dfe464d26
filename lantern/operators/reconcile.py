"""Joins that compare two tables: what is missing, moved, changed, inherited or overridden."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def compare(left: DataFrame, right: DataFrame, key: str, value: str | None = None) -> DataFrame:
    """key and status: left_only, right_only, changed (values differ) or same."""
    a = left.select(F.col(key), F.lit(True).alias("l"), (F.col(value) if value else F.lit(0)).alias("x"))
    b = right.select(F.col(key), F.lit(True).alias("r"), (F.col(value) if value else F.lit(0)).alias("y"))
    status = F.when(F.col("r").isNull(), "left_only").when(F.col("l").isNull(), "right_only").when(F.col("x").eqNullSafe(F.col("y")), "same").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def repeated_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(df: DataFrame, key: list[str]) -> DataFrame:
    if not (bad := repeated_keys(df, key)).isEmpty():
        raise ValueError(f"repeated keys: {bad.limit(3).collect()}")
    return df


def require_match(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Inner join that refuses a left row without partner."""
    if not (bad := left.join(right, key, "left_anti")).isEmpty():
        raise ValueError(f"without partner: {bad.limit(3).collect()}")
    return left.join(right, key)


def shared_content(df: DataFrame, content: Column, owner: str, id_column: str) -> DataFrame:
    """Rows whose content, by hash, stands under two owners or more."""
    hashed = df.select(id_column, owner, F.sha2(content, 256).alias("hash"))
    many = hashed.groupBy("hash").agg(F.countDistinct(owner).alias("owners")).where("owners > 1")
    return hashed.join(many.select("hash"), "hash", "left_semi")


def repair(missing: DataFrame, loose: DataFrame, content: str, path: str) -> DataFrame:
    """Pairs missing paths with loose files of equal content, one to one in sorted order."""
    w = Window.partitionBy(content).orderBy(path)
    a = missing.select(content, F.col(path).alias("missing_path"), F.row_number().over(w).alias("n"))
    b = loose.select(content, F.col(path).alias("found_path"), F.row_number().over(w).alias("n"))
    return a.join(b, [content, "n"]).select("missing_path", "found_path")


def overridden(layers: list[DataFrame], key: list[str], values: list[str]) -> DataFrame:
    """Keyed merge in which a later layer's non-null values replace earlier ones."""
    out = None
    for i, df in enumerate(layers):
        df = df.select(*key, *(F.col(v).alias(f"{v}_{i}") for v in values))
        out = df if out is None else out.join(df, key, "full_outer")
    return out.select(*key, *(F.coalesce(*(F.col(f"{v}_{i}") for i in reversed(range(len(layers))))).alias(v) for v in values))


def owners(df: DataFrame, code: str, order: list[str]) -> DataFrame:
    """Each code's first row owns it; all rows stay, told apart."""
    return df.withColumn("is_owner", F.row_number().over(Window.partitionBy(code).orderBy(*order)) == 1)


def insert_new(target: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Insert-ignore: the rows whose key the target lacks, each key once."""
    return rows.dropDuplicates(key).join(target.select(*key), key, "left_anti")


def upserted(target: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Target with the rows of equal key replaced."""
    return target.join(rows.select(*key), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def pair_key(a: str, b: str) -> list[Column]:
    """The two ends of an unordered pair, in order."""
    return [F.least(a, b).alias("low"), F.greatest(a, b).alias("high")]


def with_counts(parents: DataFrame, children: DataFrame, key: str, foreign: str, name: str = "n") -> DataFrame:
    """Parents with their number of children, 0 for none."""
    counts = children.groupBy(F.col(foreign).alias(key)).agg(F.count("*").alias(name))
    return parents.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
