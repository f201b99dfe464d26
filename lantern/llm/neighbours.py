"""Approximate nearest neighbours by randomly rotated one-bit codes.

Each vector is scaled to length 1 and turned by a random rotation; the signs are its code, packed 64 to a word. With
the scalar `a`, the code's inner product with what it stands for, a code estimates inner products without bias, and its
error is bounded with high probability. A query is turned too and rounded to BITS bits, so an estimate takes one AND
and bit count for each of its bit planes. A vector is reranked with its original numbers if the upper bound of its
estimate reaches the best lower bound for the K-th place.

All rows are coded. Queries and rows meet in cells - a block of queries by a block of rows - whose sizes are bounded, and
a cell returns its K best for each query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .shared import cut

BITS, EPSILON = 6, 2.2
ROWS, QUERIES = 1 << 17, 1 << 14


def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def codes(x: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, `a` and length of each row."""
    top = np.abs(x).max(axis=1)  # squares of large numbers would be infinite
    norm = top * np.sqrt(((x / top[:, None]) ** 2).sum(axis=1))
    y = (x / top[:, None] / (norm / top)[:, None]) @ turn.T
    dim = y.shape[1]
    bits = np.zeros((len(y), -(-dim // 64) * 64), bool)
    bits[:, :dim] = y > 0
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64), np.abs(y).sum(axis=1) / np.sqrt(dim), norm


def _index(dim: int, seed: int):
    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(dim, seed)
        for batch in batches:
            if not len(batch):
                continue
            code, a, norm = codes(_vectors(batch.column("v"), dim), turn)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(a), pa.array(norm)], names=["id", "v", "code", "a", "norm"])

    return run


class Query:
    """A block of queries as bit planes, with each query's best so far."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, turn: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, x, k
        # The codes are for queries of length 1: scores of a query are compared with each other only.
        top = np.abs(x).max(axis=1, keepdims=True)
        y = (x / top / np.sqrt(((x / top) ** 2).sum(axis=1, keepdims=True))) @ turn.T
        self.dim = y.shape[1]
        low = y.min(axis=1)
        self.step = np.maximum((y.max(axis=1) - low) / (2**BITS - 1), 1e-300)
        level = np.rint((y - low[:, None]) / self.step[:, None]).astype(np.int64)
        wide = np.zeros((len(y), -(-self.dim // 64) * 64), bool)
        self.planes = []
        for b in range(BITS):
            wide[:, : self.dim] = (level >> b) & 1
            self.planes.append(np.packbits(wide, axis=1, bitorder="little").view(np.uint64))
        self.low, self.total = low, low * self.dim + self.step * level.sum(axis=1)
        self.length = top[:, 0] * np.sqrt(((x / top) ** 2).sum(axis=1))
        self.best = np.full((len(ids), k), -np.inf)
        self.who = np.full((len(ids), k), np.iinfo(np.int64).max)

    def scan(self, ids: np.ndarray, x: np.ndarray, code: np.ndarray, a: np.ndarray, norm: np.ndarray, tile: int = 128) -> None:
        root = np.sqrt(self.dim)
        ones = np.bitwise_count(code).sum(axis=1).astype(np.float64)
        spread = np.sqrt(np.maximum(1 - a * a, 0)) / np.maximum(a, 1e-12) * EPSILON / np.sqrt(max(self.dim - 1, 1))
        for lo in range(0, len(self.ids), tile):
            q = slice(lo, min(lo + tile, len(self.ids)))
            n = q.stop - lo
            dot = np.zeros((n, len(ids)))
            for b, plane in enumerate(self.planes):
                for w in range(code.shape[1]):
                    dot += np.bitwise_count(plane[q, w][:, None] & code[None, :, w]) * float(1 << b)
            # Sum of the query's numbers where the code has a one; those with a zero count negative.
            positive = self.low[q][:, None] * ones[None, :] + self.step[q][:, None] * dot
            estimate = (2 * positive - self.total[q][:, None]) / (root * a[None, :])
            error = spread[None, :] + (EPSILON / np.sqrt(12)) * self.step[q][:, None] / a[None, :]
            mine = self.ids[q][:, None] == ids[None, :]
            upper, lower = (estimate + error) * norm, (estimate - error) * norm
            lower[mine] = -np.inf
            with np.errstate(over="ignore", invalid="ignore"):
                floor = self.best[q, -1] / self.length[q]
            if len(ids) >= self.k:
                floor = np.maximum(floor, np.partition(lower, len(ids) - self.k, axis=1)[:, len(ids) - self.k])
            row, col = np.nonzero((upper >= floor[:, None]) & ~mine)
            score = np.empty(len(row))
            for s in range(0, len(row), 65536):
                e = slice(s, s + 65536)
                with np.errstate(over="ignore", invalid="ignore"):
                    score[e] = (self.x[lo + row[e]] * x[col[e]]).sum(axis=1)
            row = np.concatenate([row, np.repeat(np.arange(n), self.k)])
            score = np.concatenate([score, self.best[q].ravel()])
            who = np.concatenate([ids[col], self.who[q].ravel()])
            order = np.lexsort((who, -score, row))
            row, score, who = row[order], score[order], who[order]
            begin = np.searchsorted(row, np.arange(n))
            take = begin[:, None] + np.arange(self.k)[None, :]
            self.best[q], self.who[q] = score[take], who[take]

    def rows(self) -> pa.RecordBatch:
        found = self.who != np.iinfo(np.int64).max
        query = np.repeat(self.ids, self.k).reshape(self.best.shape)
        return pa.RecordBatch.from_arrays([pa.array(query[found]), pa.array(self.who[found]), pa.array(self.best[found])], names=["query_id", "vec_id", "score"])


def _cells(dim: int, seed: int, k: int):
    """Rows come sorted by cell, a cell's queries first."""

    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(dim, seed)
        cell, waiting, query = None, [], None

        def begin() -> Query | None:
            if not waiting:
                return None
            return Query(np.concatenate([w[0] for w in waiting]), np.concatenate([w[1] for w in waiting]), turn, k)

        for batch in batches:
            key = batch.column("cell").to_numpy()
            kind = batch.column("kind").to_numpy()
            edges = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist(), len(key)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                if key[lo] != cell:
                    if query is not None:
                        yield query.rows()
                    cell, waiting, query = key[lo], [], None
                ids, x = part.column("id").to_numpy(), _vectors(part.column("v"), dim)
                if kind[lo] == 0:
                    waiting.append((ids, x))
                    continue
                query = query or begin()
                if query is not None:
                    code = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint64).reshape(len(ids), -1)
                    a, norm = part.column("a").to_numpy(), part.column("norm").to_numpy()
                    for s in range(0, len(ids), 4096):
                        e = slice(s, s + 4096)
                        query.scan(ids[e], x[e], code[e], a[e], norm[e])
        if query is not None:
            yield query.rows()

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding", seed: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest rows by inner product, in double precision.

    Queries are the rows for which `is_query` holds, candidates all rows but those with the query's own id. Ties go to
    the smaller id. Vectors that are null, zero, hold null or non-finite numbers, or have another length than most take
    no part, nor do rows without an id. Rows that share id and vector count as one; of a query id with several vectors
    the first in order is asked. Fewer than k candidates give fewer rows, empty tables none.

    Bounds hold with high probability, not surely: EPSILON sets how many vectors are reranked.
    """
    spark = vectors.sparkSession
    # Vectors of floats stay so, which halves what is moved; all others are read as doubles.
    kind = "array<float>" if vectors.schema[vector_column].dataType.simpleString() == "array<float>" else "array<double>"
    v = F.col(vector_column).cast(kind)
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), v.alias("v"), is_query.alias("asked"))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.count_if("asked").alias("asked")).orderBy(F.desc("n"), "dim").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n, asked = sizes["dim"], sizes["n"], sizes["asked"]
    rows = rows.where(F.size("v") == dim)
    index = cut(rows.select("id", "v").mapInArrow(_index(dim, seed), f"id long, v {kind}, code binary, a double, norm double"))
    # Cells of bounded size; more row blocks than that only to give every core one.
    row_blocks = max(-(-n // ROWS), min(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-n // 4096)))
    query_blocks = max(1, -(-asked // QUERIES))
    none = {"code": F.lit(None).cast("binary"), "a": F.lit(0.0), "norm": F.lit(0.0)}
    queries = rows.where("asked").groupBy("id").agg(F.min("v").alias("v"))
    queries = queries.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(query_blocks)).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))).alias("rb"))
    queries = queries.select((F.col("qb") * row_blocks + F.col("rb")).alias("cell"), F.lit(0).alias("kind"), "id", "v").withColumns(none)
    blocks = index.dropDuplicates(["id", "v"]).select(F.pmod(F.xxhash64("id", "v"), F.lit(row_blocks)).alias("rb"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"), F.lit(1).alias("kind"), "id", "v", "code", "a", "norm")
    blocks = blocks.select((F.col("qb") * row_blocks + F.col("rb")).alias("cell"), "kind", "id", "v", "code", "a", "norm")
    both = queries.unionByName(blocks).repartition("cell").sortWithinPartitions("cell", "kind")
    found = both.mapInArrow(_cells(dim, seed, k), "query_id long, vec_id long, score double").dropDuplicates(["query_id", "vec_id", "score"])
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
