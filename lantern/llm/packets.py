"""An exchange of many small records: tasks pack arrays of records into one binary a bucket, Spark shuffles the packets.

Records of equal hash share a bucket, and so meet in one task. Each sender first settles among its own records what it
can, and sends at most a few records of a hash: however common a hash is, a bucket gets only as many of its records
as there are senders' batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .kernels import tidy

SCHEMA = "bucket int, n int, packet binary"
#: Records that a sender gathers before it packs them.
FLUSH = 1 << 19


def buckets(spark: SparkSession) -> int:
    """A few buckets a shuffle partition, so that a bucket shrinks as the cluster's setting grows."""
    return 2 * int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def pack(bucket: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    begin = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else np.zeros(0, np.int64)
    end = np.append(begin[1:], len(b))
    columns = [c[order] for c in columns]
    out = [pa.compress(b"".join(c[x:y].tobytes() for c in columns), codec="zstd", asbytes=True) for x, y in zip(begin.tolist(), end.tolist(), strict=True)] if len(b) else []
    return pa.RecordBatch.from_arrays([pa.array(b[begin].astype(np.int32)), pa.array((end - begin).astype(np.int32)), pa.array(out, pa.binary())], names=["bucket", "n", "packet"])


def unpack(batch: pa.RecordBatch, kinds: list[str]) -> list[np.ndarray]:
    """The columns of all packets of a batch, joined."""
    width = sum(np.dtype(k).itemsize for k in kinds)
    parts: list[list[np.ndarray]] = [[np.zeros(0, k)] for k in kinds]
    for n, packet in zip(batch.column("n").to_pylist(), batch.column("packet").to_pylist(), strict=True):
        raw, at = pa.decompress(packet, n * width, codec="zstd", asbytes=True), 0
        for i, k in enumerate(kinds):
            parts[i].append(np.frombuffer(raw, k, n, at))
            at += n * np.dtype(k).itemsize
    return [np.concatenate(p) for p in parts]


def sender(records: Callable[[pa.RecordBatch], Iterator[list[np.ndarray]]], settle: Callable[[list[np.ndarray]], tuple[np.ndarray, list[np.ndarray]]]):
    """mapInArrow function: gathers records of many batches, settles them, and packs what is to be sent."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for columns in records(batch):
                held.append(columns)
                n += len(columns[0])
                if n >= FLUSH:
                    yield pack(*settle([np.concatenate(c) for c in zip(*held, strict=True)]))
                    held, n = [], 0
        if n:
            yield pack(*settle([np.concatenate(c) for c in zip(*held, strict=True)]))

    return run


def receiver(kinds: list[str], meet: Callable[[list[np.ndarray]], pa.RecordBatch | None]):
    """mapInArrow function over packets sorted by bucket: calls meet with all records of one bucket."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            b = batch.column("bucket").to_numpy()
            if not len(b):
                continue
            edges = [0, *(np.flatnonzero(b[1:] != b[:-1]) + 1).tolist(), len(b)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if held and held[-1].column("bucket")[0].as_py() != int(b[lo]):
                    yield from one(held)
                    held = []
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from one(held)

    def one(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [unpack(b, kinds) for b in held]
        if (out := meet([np.concatenate(c) for c in zip(*parts, strict=True)])) is not None and len(out):
            yield out

    return run


def exchange(packets: DataFrame, kinds: list[str], meet: Callable[[list[np.ndarray]], pa.RecordBatch | None], schema: str) -> DataFrame:
    return packets.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(receiver(kinds, meet), schema)
