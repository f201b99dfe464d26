"""Centroid clustering with adaptive bounds (Drake and Hamerly).

Every vector keeps its centroid, an upper bound of the distance to it, the few next nearest centroids with a lower bound
each, and one remainder bound for all others. When centroids move, bounds move by as much. A vector whose upper bound
stays under all lower bounds needs no distance at all; otherwise only the centroids before the first bound that is far
enough are measured, and where no bound certifies the order all are. Bounds are rounded outwards, so results
are exactly those of a full scan.

A round is one pass over the vectors. It writes vectors with their bounds to the shared folder, and beside them what each
task's vectors that changed their centroid add to the sums; the folder of the round before is then removed. Only
k x dims numbers come to the driver.
"""

from __future__ import annotations

import hashlib
import math
import posixpath
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import folder, remove


def exact(x: np.ndarray, dims: int) -> np.ndarray:
    """Whole numbers as doubles where all sums of squares stay exact in them, else as long integers."""
    most = float(np.abs(x).max()) if x.size else 0.0
    if 4 * dims * most**2 < 2.0**53:
        return x
    if 4 * dims * most**2 >= 2.0**63:
        raise OverflowError("squared distances between these vectors do not fit in a long")
    return x.astype(np.int64)


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all rows of c, exact in the type of x."""
    return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]


def down(d: np.ndarray) -> np.ndarray:
    """A single-precision number under the square root."""
    return np.nextafter(np.sqrt(d.astype(np.float64)).astype(np.float32), np.float32(-np.inf))


def up(d: np.ndarray) -> np.ndarray:
    return np.nextafter(np.sqrt(d.astype(np.float64)).astype(np.float32), np.float32(np.inf))


class Bounds:
    """Centroid, upper bound, next nearest centroids and lower bounds, the last for all others, of a batch of vectors."""

    def __init__(self, x: np.ndarray, centroids: np.ndarray, b: int):
        self.x, self.c, self.b = x, centroids, b
        n = len(x)
        self.cluster, self.high = np.zeros(n, np.int32), np.zeros(n, np.float32)
        self.near, self.low = np.zeros((n, b), np.int32), np.zeros((n, b + 1), np.float32)

    def scan(self, rows: np.ndarray) -> None:
        """Measures all centroids; of equal distances the smaller number comes first."""
        d = squares(self.x[rows], self.c)
        order = np.argsort(d, axis=1, kind="stable")[:, : self.b + 2]
        d = np.take_along_axis(d, order, 1)
        self.cluster[rows], self.high[rows] = order[:, 0], up(d[:, 0])
        self.near[rows], self.low[rows, : self.b] = order[:, 1 : self.b + 1], down(d[:, 1 : self.b + 1])
        self.low[rows, self.b] = down(d[:, self.b + 1]) if order.shape[1] > self.b + 1 else np.inf

    def own(self, rows: np.ndarray) -> np.ndarray:
        d = self.x[rows] - self.c[self.cluster[rows]]
        return (d * d).sum(1)

    def move(self, drift: np.ndarray) -> int:
        """Follows centroids that moved by at most `drift`; the number of distances that had to be measured."""
        if not len(self.x):
            return 0
        step = np.nextafter(drift.astype(np.float32), np.float32(np.inf))
        self.high = np.nextafter(self.high + step[self.cluster], np.float32(np.inf))
        self.low[:, : self.b] -= step[self.near]
        self.low[:, self.b] -= step.max()
        self.low = np.nextafter(self.low, np.float32(-np.inf))
        beyond = np.minimum.accumulate(self.low[:, ::-1], axis=1)[:, ::-1]  # of this place and all behind it
        rows = np.flatnonzero(self.high >= beyond[:, 0])
        self.high[rows] = up(self.own(rows))
        measured = len(rows)
        far = self.high[rows, None] < beyond[rows]
        first = np.where(far.any(1), far.argmax(1), self.b + 1)
        for z in range(1, self.b + 1):
            if len(some := rows[first == z]):
                ids = np.concatenate([self.cluster[some, None], self.near[some, :z]], axis=1)
                d = self.x[some, None, :] - self.c[ids]
                d = (d * d).sum(2)
                order = np.lexsort((ids, d), axis=1)
                ids, d = np.take_along_axis(ids, order, 1), np.take_along_axis(d, order, 1)
                self.cluster[some], self.high[some] = ids[:, 0], up(d[:, 0])
                self.near[some, :z], self.low[some, :z] = ids[:, 1:], down(d[:, 1:])
                measured += d.size
        if len(some := rows[first == self.b + 1]):
            self.scan(some)
            measured += len(some) * len(self.c)
        return measured


def _list(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    at = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values.ravel(), kind))


def _round(centroids: list[list[int]], drift: list[float] | None, scale: float, b: int, last: bool):
    k, dims = len(centroids), len(centroids[0])
    names = ["__id", "__vector", "cluster", "high", "near", "low", "distance", "part", "n", "sums", "measured"]

    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle = np.array(centroids, np.int64)
        n, sums, measured, kinds = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), 0, None
        for batch in batches:
            kinds = kinds or (batch.schema.field("__id").type, batch.schema.field("__vector").type)
            raw = batch.column("__vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), dims)
            both = exact(np.concatenate([np.floor(raw * scale), middle]), dims)
            state = Bounds(both[: len(raw)], both[len(raw) :], b)
            if drift is None:
                state.scan(np.arange(len(raw)))
                measured += len(raw) * k
                was = np.full(len(raw), -1)
            else:
                was = batch.column("cluster").to_numpy()
                state.cluster, state.high = was.copy(), batch.column("high").to_numpy().copy()
                state.near = batch.column("near").flatten().to_numpy().reshape(len(raw), b).copy()
                state.low = batch.column("low").flatten().to_numpy().reshape(len(raw), b + 1).copy()
                measured += state.move(np.array(drift))
            moved = np.flatnonzero(state.cluster != was)
            for side, sign in ((state.cluster, 1), (was, -1)):
                for j in np.unique(side[moved]).tolist():
                    if j >= 0:
                        rows = moved[side[moved] == j]
                        n[j] += sign * len(rows)
                        sums[j] += sign * state.x[rows].sum(0).astype(np.int64)
            empty = [pa.nulls(len(raw), t) for t in (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int64())]
            d = pa.array(state.own(np.arange(len(raw))).astype(np.int64)) if last else pa.nulls(len(raw), pa.int64())
            vector = pa.nulls(len(raw), kinds[1]) if last else batch.column("__vector")
            cols = [batch.column("__id"), vector, pa.array(state.cluster), pa.array(state.high), _list(state.near, pa.int32()), _list(state.low, pa.float32()), d]
            yield pa.RecordBatch.from_arrays([*cols, *empty], names=names)
        if kinds:  # what this task's vectors change
            parts = np.flatnonzero(n | sums.any(1)) if n.any() or sums.any() else np.zeros(1, np.int64)
            nothing = [pa.nulls(len(parts), t) for t in (*kinds, pa.int32(), pa.float32(), pa.list_(pa.int32()), pa.list_(pa.float32()), pa.int64())]
            per = np.where(np.arange(len(parts)) == 0, measured, 0)
            yield pa.RecordBatch.from_arrays([*nothing, pa.array(parts.astype(np.int32)), pa.array(n[parts]), _list(sums[parts], pa.int64()), pa.array(per)], names=names)

    return run


def cluster(
    vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, bounds: int = 3, salt: str = "3:", id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """Lloyd's clustering of vectors turned into whole numbers floor(scale * x): id, cluster, distance (squared, to the
    vector's centroid), cluster_inertia and inertia (distance summed over the cluster and over all), centroid_sha256 (of
    the final centroid's components, as decimal integers joined by commas).

    Vectors of another length than `dims`, null ones and those that hold a null or non-finite component take no part and
    have no row. Centroids start as the k vectors with the smallest lowercase-hex SHA-256 of `salt` and id; vectors that
    share an id stand in their own order, those without an id come last. With fewer vectors than k there are as many
    centroids; an empty table gives no rows. Each of `rounds` rounds assigns all vectors to their nearest centroid, ties to
    the smaller number, and moves each centroid to the floor of its vectors' mean; an empty one stays. Then all are
    assigned once more. Once no centroid moves the rounds left change nothing and are left out. Repeated rows count each.
    Vectors whose squared distances a long could not hold are an error. Other columns are not looked at.
    `bounds` next nearest centroids have a bound of their own; it changes the work, not the result.
    """
    spark = vectors.sparkSession
    kind, of = vectors.schema[id_column].dataType.simpleString(), vectors.schema[vector_column].dataType
    flawed = F.exists("__vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = vectors.select(F.col(id_column).alias("__id"), F.col(vector_column).alias("__vector")).where((F.size("__vector") == dims) & ~flawed)
    order = F.sha2(F.concat(F.lit(salt), F.col("__id").cast("string")), 256)
    first = kept.orderBy(order.asc_nulls_last(), "__vector").limit(k).select("__vector").collect()
    if not first:
        return vectors.limit(0).select(F.col(id_column), *(F.lit(None).cast(t).alias(c) for c, t in _MORE))
    middle = [[math.floor(scale * float(x)) for x in r[0]] for r in first]
    if max(abs(x) for c in middle for x in c) >= 2**62:
        raise OverflowError("squared distances between these vectors do not fit in a long")
    k, b = len(middle), min(bounds, len(middle) - 1)
    schema = f"__id {kind}, __vector {of.simpleString()}, cluster int, high float, near array<int>, low array<float>, distance bigint, part int, n bigint, sums array<bigint>, measured bigint"
    place = posixpath.join(folder(spark), f"centroids-{uuid.uuid4().hex}")
    state, drift = kept, None
    count, total = [0] * k, [[0] * dims for _ in middle]
    for r in range(rounds + 1):
        last = r == rounds or (drift is not None and not any(drift))
        at = f"{place}/{r}"
        state.mapInArrow(_round(middle, drift, float(scale), b, last), schema).write.parquet(at)
        state = spark.read.schema(schema).parquet(at)
        if r:
            remove(spark, f"{place}/{r - 1}")
        if last:
            break
        changes = state.where("part is not null").select("part", "n", "sums")
        for part, n in changes.groupBy("part").agg(F.sum("n")).collect():
            count[part] += n
        each = changes.select("part", F.posexplode("sums").alias("at", "x")).groupBy("part", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")))
        for part, i, x in each.collect():
            total[part][i] += int(x)
        new = [[x // n for x in xs] if n else old for old, xs, n in zip(middle, total, count, strict=True)]
        drift = [math.sqrt(sum((x - y) ** 2 for x, y in zip(p, q, strict=True))) for p, q in zip(middle, new, strict=True)]
        middle = new
        state = state.where("part is null").drop("distance", "part", "n", "sums", "measured")
    rows = state.where("part is null").select("__id", "cluster", "distance")
    inertia = {r[0]: int(r[1]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in middle]
    sums = [(j, inertia[j], sum(inertia.values()), digest[j]) for j in sorted(inertia)]
    facts = spark.createDataFrame(sums, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")  # a row a centroid
    out = rows.join(F.broadcast(facts), "cluster")
    return out.select(F.col("__id").alias(id_column), *(c for c, _ in _MORE))


_MORE = [("cluster", "int"), ("distance", "bigint"), ("cluster_inertia", "bigint"), ("inertia", "bigint"), ("centroid_sha256", "string")]
