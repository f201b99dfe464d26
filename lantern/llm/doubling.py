"""Substring deduplication by level-wise doubling.

Windows of BASE words come first; those that occur in several documents are extended to twice that length, to both
sides, and so on while the full length leaves room for it - a full window that holds a window of a third of its words
holds one of the two extensions whole - until no candidates survive or the full windows around them are compared.
Not all windows of the first level are looked at but the minimizers: of the BASE-word windows in each full window, the
one with the smallest hash. Equal full windows have the same minimizer at the same place, so none is missed.

On each level a task first compares its own documents; a hash is then sent at most once a batch and document. Where
the comparison within a batch has settled a record it is sent no further than to its document. Answers are packed once
more, by document, so that a document gets one row of them however many tasks they come from.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import packets as P
from .shared import bucketed, cut

BASE, CHUNK = 4, 2 << 20
#: Hash, document's order, its text, first word and number of words; 1: the answer is known, 2: known, tells others.
#: Numbers of words are mostly equal, so that they pack to nothing.
_KINDS = ["u8", "i8", "i4", "i4", "i4", "i1"]


def _groups(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (hash, document), and each record's smallest and largest document among its equals, in that order."""
    order = np.lexsort((doc, h))
    hs = h[order]
    begin = np.flatnonzero(np.concatenate([[True], hs[1:] != hs[:-1]]))
    size = np.diff(np.append(begin, len(hs)))
    ds = doc[order]
    return order, np.repeat(ds[begin], size), np.repeat(ds[begin + size - 1], size)


def _home(number: int, doc: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The bucket in which a document's answers are gathered."""
    return (K.mix((doc ^ (text.astype(np.int64) << 32)).view(np.uint64)) % np.uint64(number)).astype(np.int64)


def _settle(number: int, last: bool, length: int):
    """Among a sender's records: which are repeated already, and which must be compared with the others'."""

    def settle(columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        h, doc = columns[0], columns[1]
        order, low, high = _groups(h, doc)
        known, first = np.empty(len(h), bool), np.empty(len(h), bool)
        known[order] = doc[order] > low if last else low != high
        # Of each hash whose records are all known, one still tells the others: that of its smallest document.
        first[order] = np.concatenate([[True], h[order][1:] != h[order][:-1]])
        # Records stay in the order of their documents, which packs best; what is known needs no hash any more.
        ask = ~known | first
        told = [c[known] for c in columns[1:]]
        size = np.full(len(h), length, np.int32)
        told = [*told, size[known]]
        told = _spans(*told) if last else told
        n = len(told[0])
        sent = [np.concatenate([c[ask], k]) for c, k in zip([*columns, size], [np.zeros(n, np.uint64), *told], strict=True)]
        flag = np.concatenate([np.where(known[ask], 2, 0), np.ones(n)]).astype(np.int8)
        bucket = np.concatenate([((h[ask] >> np.uint64(20)) % np.uint64(number)).astype(np.int64), _home(number, *told[:2])])
        return bucket, [*sent, flag]

    return settle


def _spans(doc: np.ndarray, text: np.ndarray, lo: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Word ranges of documents, merged; in and out as first word and number of words."""
    if not len(doc):
        return [doc, text, lo, size]
    hi = lo + size
    order = np.lexsort((text, doc))
    doc, text, lo, hi = doc[order], text[order], lo[order], hi[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (text[1:] != text[:-1])])
    begin = np.flatnonzero(new)
    row, lo, hi = K.merged(np.cumsum(new) - 1, lo.astype(np.int64), hi.astype(np.int64))
    return [doc[begin[row]], text[begin[row]], lo.astype(np.int32), (hi - lo).astype(np.int32)]


def _meet(number: int, last: bool):
    """In a bucket: the places that are repeated - of the last level, those that a smaller document has too, as spans -,
    packed by the buckets of their documents."""

    def meet(columns: list[np.ndarray]) -> pa.RecordBatch | None:
        h, doc, text, at, size, flag = columns
        asked = np.flatnonzero(flag != 1)
        yes = flag == 1
        if len(asked):
            order, low, high = _groups(h[asked], doc[asked])
            d = doc[asked][order]
            known = (d > low) if last else (low != high) | _any(h[asked][order], flag[asked][order] == 2)
            yes[asked[order]] = known & (flag[asked][order] == 0)
        out = [c[yes] for c in (doc, text, at, size)]
        out = _spans(*out) if last else out
        return P.pack(_home(number, *out[:2]), out) if len(out[0]) else None

    return meet


def _gather(last: bool):
    """One row a document, its places as pairs of 32-bit numbers: first word and number of words."""

    def gather(columns: list[np.ndarray]) -> pa.RecordBatch:
        doc, text, at, size = _spans(*columns) if last else columns
        order = np.lexsort((at, text, doc))
        doc, text = doc[order], text[order]
        pairs = np.stack([at[order], size[order]], 1).astype("<i4")
        same = (doc[1:] == doc[:-1]) & (text[1:] == text[:-1])
        new = np.concatenate([[True], ~same | (pairs[1:] != pairs[:-1]).any(axis=1)])  # repeated rows tell the same twice
        begin = np.cumsum(new)[np.flatnonzero(np.concatenate([[True], ~same]))] - 1
        offsets = np.append(begin, new.sum()).astype(np.int64) * 8
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(pairs[new].tobytes())])
        first = np.concatenate([[True], ~same])
        return pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array(text[first]), found.cast(pa.binary())], names=["doc", "hash", "found"])

    return gather


def _places(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first word and end of all places in a column of packed ones."""
    offsets, data = K.buffers(column)
    pairs = np.frombuffer(data.tobytes(), "<i4").reshape(-1, 2)
    return np.repeat(np.arange(len(column)), np.diff(offsets) // 8), pairs[:, 0].astype(np.int64), pairs.sum(axis=1, dtype=np.int64)


def _any(h: np.ndarray, flag: np.ndarray) -> np.ndarray:
    begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return np.repeat(np.maximum.reduceat(flag, begin), np.diff(np.append(begin, len(h))))


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[K.Words, np.ndarray, np.ndarray]]:
    doc, text = batch.column("doc").to_numpy(), batch.column("hash").to_numpy()
    for part in K.words(batch.column("text"), K.NOT_SPACE, False, CHUNK):
        yield part, doc[part.lo : part.hi], text[part.lo : part.hi]


def _inside(part: K.Words, length: int) -> np.ndarray:
    """Whether a window of that length that starts at a word stays in the word's document."""
    n = len(part.hash) - length + 1
    ok = np.zeros(max(n, 0), bool)
    if n > 0:
        ok[K.expand(part.row_at[:-1], np.maximum(np.diff(part.row_at) - length + 1, 0))] = True
    return ok


def _first_level(length: int):
    def records(batch: pa.RecordBatch) -> Iterator[list[np.ndarray]]:
        for part, doc, text in _parts(batch):
            ok = _inside(part, length)
            if not ok.any():
                continue
            h = K.sequence_hashes(part.hash, BASE)
            at = K.minimizers(h, ok, length - BASE + 1)
            row = np.searchsorted(part.row_at, at, "right") - 1
            yield [h[at], doc[row], text[row], (at - part.row_at[row]).astype(np.int32)]

    return records


def _starts(batch: pa.RecordBatch, part: K.Words) -> tuple[np.ndarray, np.ndarray]:
    """Row and first word of the surviving windows that documents bring along."""
    return _places(batch.column("found").slice(part.lo, part.hi - part.lo))[:2]


def _doubled(length: int):
    """The windows of twice the length that begin or end with a surviving one."""

    def records(batch: pa.RecordBatch) -> Iterator[list[np.ndarray]]:
        for part, doc, text in _parts(batch):
            row, at = _starts(batch, part)
            row, start = np.tile(row, 2), np.concatenate([at, at - length])
            ok = (start >= 0) & (start + 2 * length <= np.diff(part.row_at)[row])
            word = np.unique(part.row_at[row[ok]] + start[ok])
            row = np.searchsorted(part.row_at, word, "right") - 1
            h = K.sequence_hashes(part.hash, 2 * length)
            yield [h[word] if len(word) else h[:0], doc[row], text[row], (word - part.row_at[row]).astype(np.int32)]

    return records


def _full(length: int, words: int):
    """The full windows around surviving ones."""

    def records(batch: pa.RecordBatch) -> Iterator[list[np.ndarray]]:
        for part, doc, text in _parts(batch):
            row, at = _starts(batch, part)
            lo, hi = np.maximum(at + length - words, 0), np.minimum(at, np.diff(part.row_at)[row] - words)
            ok = lo <= hi
            row, lo, hi = K.merged(row[ok], lo[ok], hi[ok] + 1)
            start = K.expand(lo, hi - lo)
            row = np.repeat(row, hi - lo)
            h = K.sequence_hashes(part.hash, words)
            yield [h[part.row_at[row] + start] if len(start) else h[:0], doc[row], text[row], start.astype(np.int32)]

    return records


def _apply(mode: str):
    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.words(batch.column("text"), K.NOT_SPACE, False, CHUNK):
                n = part.hi - part.lo
                column = batch.column("found").slice(part.lo, n)
                row, lo, hi = K.merged(*_places(column))
                gone = np.zeros(len(part.hash), bool)
                gone[K.expand(part.row_at[row] + lo, hi - lo)] = True
                begins = np.searchsorted(row, np.arange(n + 1))
                removed = np.concatenate([[0], np.cumsum(gone)])
                kept = []
                data = part.data
                for i in range(n):
                    a, b = part.row_at[i], part.row_at[i + 1]
                    if begins[i] == begins[i + 1]:  # nothing goes: the words of the whole text
                        s = data[part.start[a] : part.end[b - 1]].tobytes().split() if b > a else []
                    else:
                        s = []
                        edges = [a, *np.stack([a + lo[begins[i] : begins[i + 1]], a + hi[begins[i] : begins[i + 1]]], 1).ravel().tolist(), b]
                        for x, y in zip(edges[::2], edges[1::2], strict=True):
                            if y > x:
                                s += data[part.start[x] : part.end[y - 1]].tobytes().split()
                    out = b" ".join(s)
                    kept.append(hashlib.sha256(out).hexdigest() if mode == "digest" else out.decode())
                spans = pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.StructArray.from_arrays([pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], ["start", "end"]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(part.lo, n), pa.array(np.diff(part.row_at).astype(np.int64)), pa.array((removed[part.row_at[1:]] - removed[part.row_at[:-1]]).astype(np.int64)), spans, pa.array(kept, pa.string())],
                    names=["id", "n_words", "n_removed", "spans", "kept"],
                )

    return run


def substring_dedup(documents: DataFrame, words: int = 13, mode: str = "text", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_words, n_removed, spans (removed ranges of words) and kept - the other words joined by one space, or with
    mode `digest` the SHA-256 of that - for each document.

    A word goes if it lies in a window of `words` consecutive words whose sequence also starts in a document with a
    smaller id. Words are what white space (0x20, 0x09 to 0x0D) leaves between it, unchanged. Windows are judged on the
    input. Null and empty texts have no words. A null id counts as larger than all others. Rows that share an id take
    nothing from each other; each is judged on its own text. Empty tables give no rows; other columns are not looked at.
    """
    spark = documents.sparkSession
    if words < BASE or documents.schema[id_column].dataType.simpleString() not in ("bigint", "int", "smallint", "tinyint"):
        raise ValueError(f"windows of {BASE} words or more and whole-number ids are needed")
    number = P.buckets(spark) // 2  # answers go from every bucket to every other
    rows = documents.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    rows = rows.select(F.coalesce("id", F.lit(2**63 - 1)).alias("doc"), F.hash("text").alias("hash"), "id", "text")
    rows = bucketed(rows, ["doc", "hash"], "texts")  # texts move once; from then on only answers come to them

    def level(frame: DataFrame, records, length: int, last: bool) -> DataFrame:
        sent = frame.mapInArrow(P.sender(records, _settle(number, last, length)), P.SCHEMA)
        met = P.exchange(sent, _KINDS, _meet(number, last), P.SCHEMA)
        return P.exchange(met, _KINDS[1:5], _gather(last), "doc long, hash int, found binary")

    def met(found: DataFrame, how: str) -> DataFrame:
        return rows.join(found, ["doc", "hash"], how).select("doc", "hash", "id", "text", "found")

    length = BASE
    found = cut(level(rows, _first_level(words), length, False))
    while 3 * length - 1 <= words and not found.isEmpty():
        found, length = cut(level(met(found, "inner"), _doubled(length), 2 * length, False)), 2 * length
    if not found.isEmpty():
        found = level(met(found, "inner"), _full(length, words), words, True)
    out = met(found, "left").mapInArrow(_apply(mode), "id long, n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept string")
    return out.withColumnRenamed("id", id_column)
