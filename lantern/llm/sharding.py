"""Sharding by a hypergeometric communication matrix: a uniform shuffle with exact shard sizes.

1. Rows get a random key from the seed and their place in a written table, and each block of rows is one partition of it.
2. How many rows each block sends to each shard is drawn from the multivariate hypergeometric law that a uniform
   shuffle implies: margins are the blocks' and the shards' exact sizes.
3. Each block is permuted locally (sorted by its random keys) and dealt by the drawn counts.
4. Rows are exchanged and permuted again within their shard by an independent random key.

A shard is not gathered in one task: its second permutation is a sort by random keys, so it is cut into cells of the
key's range; a cell's rows are numbered on their own from the sum of the cells before.
Only the blocks' row counts come to the driver, one number for a partition.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

#: Rows of a cell, about; and rows of the drawn matrix that are sent to every task at most (beyond, it is joined by shuffle).
CELL_ROWS, MATRIX_ROWS = 200_000, 1_000_000


def communication_matrix(blocks: list[int], shards: list[int], seed: int) -> np.ndarray:
    """Rows that each block sends to each shard: row sums are `blocks`, column sums `shards`."""
    if sum(blocks) != sum(shards):
        raise ValueError("blocks and shards hold different numbers of rows")
    draw = np.random.default_rng(seed)
    left = np.array(shards, np.int64)
    out = np.zeros((len(blocks), len(shards)), np.int64)
    for i, n in enumerate(blocks):
        rest = n
        for j in range(len(shards)):
            after = int(left[j + 1 :].sum())
            out[i, j] = hypergeometric(draw, int(left[j]), after, rest)
            rest -= int(out[i, j])
        left -= out[i]
    return out


#: Numpy draws from populations under this size. Beyond, samples are drawn in parts of at most this share of what is left;
#: margins of up to so many rows are dealt one by one.
NUMPY_LIMIT, SHARE, FEW = 10**9, 1000, 10_000


def hypergeometric(draw: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n rows drawn from good + bad are good, whatever the size."""
    if min(n, good) == 0:
        return 0
    if bad == 0:
        return n
    if good + bad < NUMPY_LIMIT:
        return int(draw.hypergeometric(good, bad, n))
    if 2 * n > good + bad:  # what is left is a sample too
        return good - hypergeometric(draw, good, bad, good + bad - n)
    found = 0
    while n > 0 and good > 0 and bad > 0:  # a sample is the sum of its parts, each drawn from what the one before left
        part = min(n, max(FEW, (good + bad) // SHARE))
        k = hypergeometric(draw, good, bad, part) if good + bad < NUMPY_LIMIT else _sparse(draw, good, bad, part)
        found, good, bad, n = found + k, good - k, bad - part + k, n - part
    return found + (n if bad == 0 else 0)


def _sparse(draw: np.random.Generator, good: int, bad: int, n: int) -> int:
    """An exact draw of a small part of a large population.

    The law is symmetric in the sample and the good rows, and in good and bad, so the smaller numbers take the small
    parts. A small margin is dealt row by row. Else the draw with replacement, a binomial one, is proposed and accepted by
    the ratio of the two laws, which is at most its value at the mean but for a thousandth.
    """
    total = good + bad
    if good > bad:
        return n - _sparse(draw, bad, good, n)
    if good < n:
        return _sparse(draw, n, total - n, good)
    if n <= FEW:
        k = 0
        for i, u in enumerate(draw.random(n).tolist()):
            k += u * (total - i) < good - k
        return k

    def fall(size: int, k: int) -> float:
        """Logarithm of size * (size - 1) * ... of k factors over size ** k, by Stirling's series."""
        x = k / size
        if x > 0.05:
            return math.lgamma(size + 1) - math.lgamma(size - k + 1) - k * math.log(size)
        series = -size * sum(x**i / (i * (i - 1)) for i in range(2, 14))  # -(1 - x) log(1 - x) - x
        return series - 0.5 * math.log1p(-x) + 1 / (12 * size) - 1 / (12 * (size - k))

    bound = -0.5 * math.log1p(-n / total) + 0.01
    whole = fall(total, n)
    while True:
        k = int(draw.binomial(n, good / total))
        if k <= good and n - k <= bad and math.log(draw.random() or 1e-300) <= fall(good, k) + fall(bad, n - k) - whole - bound:
            return k


def shard(documents: DataFrame, shards: int = 8, seed: int = 17, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every row with its place in a uniform shuffle: id, size, text_crc32, law, shard, slot, grown_shard.

    Law `rows`: shard sizes differ by one row at most, shards 0, 1, ... hold the larger ones. size is the text's UTF-8
    bytes plus 1, a null text has size 1 and the checksum of an empty text. slot counts from 0 without gaps in each
    shard. Equal rows are rows of their own: a uniform shuffle moves each independently of its text, so copies of a
    text spread like any others. An empty table gives no rows. Other columns are not looked at.
    """
    spark = documents.sparkSession
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    slim = cut(documents.select(F.col(id_column).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc")))
    rows = slim.withColumn("at", F.monotonically_increasing_id()).withColumn("block", F.shiftright("at", 33).cast("int"))
    sizes = {r["block"]: r["n"] for r in rows.groupBy("block").agg(F.count("*").alias("n")).toLocalIterator()}
    blocks = sorted(sizes)
    total = sum(sizes.values())
    target = [total // shards + (j < total % shards) for j in range(shards)]
    matrix = communication_matrix([sizes[b] for b in blocks], target, seed)
    bounds = np.cumsum(matrix, axis=1)
    drawn = spark.sql(
        "SELECT inline(from_json(:drawn, 'array<struct<block:int,bounds:array<bigint>>>'))",
        args={"drawn": json.dumps([{"block": b, "bounds": bounds[i].tolist()} for i, b in enumerate(blocks)])},
    )
    if len(blocks) * shards <= MATRIX_ROWS:
        drawn = F.broadcast(drawn)
    # Local permutation: within its block a row's place by random key is its number after a sort of the partition.
    local = rows.withColumn("r1", F.xxhash64(F.lit(seed), "at")).sortWithinPartitions("r1", "at")
    dealt = (
        local.withColumn("place", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
        .join(drawn, "block")
        .withColumn("shard", F.size(F.filter("bounds", lambda b: b <= F.col("place"))))
        .withColumn("r2", F.xxhash64(F.lit(seed + 1), "at"))
    )
    cells = max(1, -(-max(target, default=0) // CELL_ROWS))
    dealt = dealt.select("id", "size", "crc", "shard", "r2", "at", F.floor((F.col("r2").cast("double") / 2.0**64 + 0.5) * cells).cast("int").alias("cell"))
    count = dealt.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    first = count.select("shard", "cell", (F.sum("n").over(Window.partitionBy("shard").orderBy("cell")) - F.col("n")).alias("first"))
    number = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("r2", "at")) - 1
    out = dealt.withColumn("number", number).join(F.broadcast(first) if cells * shards <= MATRIX_ROWS else first, ["shard", "cell"])
    return out.select(
        F.col("id").alias(id_column),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("first") + F.col("number")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
