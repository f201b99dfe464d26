"""Array kernels shared by the text operators: words, hashes and minimizers of a column of texts.

Everything here works on one Arrow column at a time, inside a task, and holds a few MB at once:
hashes are made in blocks of BLOCK bytes, so a very long text needs no more memory than its words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import wraps

import numpy as np
import pyarrow as pa

BLOCK = 1 << 18
_MULT = 0x9E3779B97F4A7C15
_U = np.uint64

SPACE_BYTES = bytes([0x20, *range(0x09, 0x0E)])


def _table(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


#: Which bytes belong to a word: all but white space, and only digits, small letters and non-ASCII.
NOT_SPACE = ~_table(SPACE_BYTES)
ALNUM = _table(bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        n = max(n, BLOCK + 4096)
        for name, base in (("_pow", _MULT), ("_inv", pow(_MULT, -1, 2**64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            globals()[name] = np.multiply.accumulate(steps)
    return _pow, _inv


def release() -> None:
    """Gives memory that is no longer used back to the machine; allocators keep it else."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A mapInArrow function that leaves nothing behind: idle workers are kept for other tasks, so what they hold adds up."""

    @wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], whole[offsets[0] : offsets[-1]]


def row_chunks(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have at most `limit` bytes together, or one row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


@dataclass
class Words:
    """The words of rows lo to hi: byte ranges in `data`, hashes, and where each row's words begin."""

    lo: int
    hi: int
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    row_at: np.ndarray

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(self.hi - self.lo), np.diff(self.row_at))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of ascending, disjoint byte ranges, block by block."""
    out = np.empty(len(start), np.uint64)
    at, n = 0, len(start)
    while at < n:
        base = int(start[at])
        to = max(at + 1, int(np.searchsorted(end, base + BLOCK, "right")))
        stop = int(end[to - 1])
        p, q = _powers(stop - base + 1)
        sums = np.zeros(stop - base + 1, np.uint64)
        np.cumsum(_BYTE[data[base:stop]] * p[: stop - base], out=sums[1:])
        s, e = start[at:to] - base, end[at:to] - base
        out[at:to] = mix((sums[e] - sums[s]) * q[s] + (e - s).astype(np.uint64) * _U(0xD6E8FEB86659FD93))
        at = to
    return out


def words(column: pa.Array, members: np.ndarray, lower: bool, limit: int = 4 << 20) -> Iterator[Words]:
    """Words of whole texts: the longest runs of the bytes in `members`, A-Z lower-cased first if asked."""
    offsets, whole = buffers(column)
    for lo, hi in row_chunks(offsets, limit):
        data = whole[offsets[lo] : offsets[hi]]
        if lower:
            data = LOWER[data]
        inside = members[data]
        n = len(data)
        starts = inside.copy()
        ends = inside.copy()
        if n:
            starts[1:] &= ~inside[:-1]
            ends[:-1] &= ~inside[1:]
            edge = offsets[lo:hi] - offsets[lo]
            edge = edge[edge < n]
            starts[edge] = inside[edge]
            before = edge[edge > 0] - 1
            ends[before] = inside[before]
        start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        yield Words(lo, hi, data, start, end, span_hashes(data, start, end), np.searchsorted(start, offsets[lo : hi + 1] - offsets[lo]))


def sequence_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive elements."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for i in range(n):
        out *= _U(_MULT)
        out += hashes[i : i + m]
    return mix(out + _U(n))


def sliding(x: np.ndarray, width: int, f: np.ufunc) -> np.ndarray:
    """f over each `width` consecutive elements, by doubling."""
    have, out = 1, x
    while have < width:
        step = min(have, width - have)
        out = f(out[:-step], out[step:]) if len(out) > step else out[:0]
        have += step
    return out


def minimizers(h: np.ndarray, ok: np.ndarray, width: int) -> np.ndarray:
    """Positions that hold the smallest of some `width` consecutive hashes.

    ok: of each window start, whether that window counts (those that cross texts do not). Equal sequences have
    their minimizers at equal places, and each window that counts holds one at least.
    """
    h = np.maximum(h, _U(1))  # 0 marks what does not count
    low = sliding(h, width, np.minimum)
    low = np.where(ok[: len(low)], low, _U(0))
    edge = np.zeros(width - 1, np.uint64)
    high = sliding(np.concatenate([edge, low, edge]), width, np.maximum)
    return np.flatnonzero((high == h[: len(high)]) & (high > 0))


def merged(row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of ranges [lo, hi) of rows, as maximal disjoint ranges; touching ranges become one."""
    if not len(row):
        return row, lo, hi
    order = np.lexsort((lo, row))
    row, lo, hi = row[order], lo[order], hi[order]
    shift = int(hi.max()) + 1
    dense = np.concatenate([[0], np.cumsum(row[1:] != row[:-1])])
    top = np.maximum.accumulate(hi + dense * shift) - dense * shift
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (lo[1:] > top[:-1])])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(row) - 1]])
    return row[new], lo[new], top[last]


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive bytes."""
    m = len(data) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(m, np.uint64)
    for lo in range(0, m, BLOCK):
        hi = min(m, lo + BLOCK)
        n = hi - lo + k - 1
        p, q = _powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data[lo : lo + n]] * p[:n], out=sums[1:])
        out[lo:hi] = mix((sums[k:] - sums[: hi - lo]) * q[: hi - lo])
    return out


def expand(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... count[0] of them, then start[1], ..."""
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - count, count) + np.repeat(start, count)
