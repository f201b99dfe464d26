"""Benchmark decontamination: an FM-index of each shard of the training texts is searched for the test phrases.

A shard is a run of an Arrow batch. Its words become numbers of the benchmark's vocabulary; only stretches in which
every neighbouring pair of words also stands in some benchmark window can hold a window, so the other words are left out
before the index is built - this drops no match. The index is a suffix array (prefix doubling), its Burrows-Wheeler
transform in a wavelet tree, and suffix positions sampled every SAMPLE places. All windows are searched backwards at
once; each occurrence is located by walking back to a sampled position, and overlapping occurrences are merged to
removal spans. Documents are never shuffled.

The benchmark is taken in blocks of at most `block_bytes` of text - longer items in overlapping pieces -, so what the driver
and the tasks hold has a fixed bound. One block is the usual case and one pass over the documents; more blocks take one
pass each, the rows are written between passes so that one block is in use at a time, and the passes' spans are merged
per document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import cut

SAMPLE = 8
#: Text of a shard that is indexed at once.
SHARD_BYTES = 4 << 20


class Phrases:
    """The distinct windows of a block of benchmark items, as arrays of a few dozen bytes a window."""

    def __init__(self, items: list[tuple[str, str | None]], width: int):
        self.width = width
        self.names = np.array([a for a, _ in items], object)
        parts = [(p.hash, np.diff(p.row_at)) for p in K.words(pa.array([b or "" for _, b in items], pa.large_string()), K.ALNUM, True)]
        hashes = np.concatenate([np.zeros(0, np.uint64), *(h for h, _ in parts)])
        n = np.concatenate([np.zeros(0, np.int64), *(n for _, n in parts)])
        self.vocabulary = np.unique(hashes)
        number = (np.searchsorted(self.vocabulary, hashes) + 1).astype(np.int32)
        begin, size = np.cumsum(n) - n, np.minimum(n, width)
        windows = np.where(n > 0, n - size + 1, 0)
        item, start = np.repeat(np.arange(len(n), dtype=np.int32), windows), K.expand(begin, windows).astype(np.int32)
        # Right-aligned, as backward search starts at the last word; 0 stands for no word.
        words = np.zeros((len(start), width), np.int32)
        for j in range(width):
            long = np.flatnonzero(size[item] > j)
            words[long, width - 1 - j] = number[start[long] + size[item[long]] - 1 - j]
        del start
        order = np.argsort(words.view(np.dtype((np.void, 4 * width))).ravel()).astype(np.int32)
        new = np.ones(len(order), bool)
        for lo in range(1, len(order), 1 << 18):  # equal windows stand together
            hi = min(len(order), lo + (1 << 18))
            new[lo:hi] = (words[order[lo:hi]] != words[order[lo - 1 : hi - 1]]).any(axis=1)
        first, same = order[new], np.empty(len(order), np.int32)
        same[order] = np.cumsum(new) - 1
        self.words, self.length = words[first], size[item[first]]
        del order, words
        self.least = int(self.length.min()) if len(first) else width
        owners = np.unique(same.astype(np.int64) * max(1, len(n)) + item)
        self.owner_at = np.searchsorted(owners // max(1, len(n)), np.arange(len(first) + 1)).astype(np.int64)
        self.owner = owners % max(1, len(n))
        next_to = np.ones(max(0, len(number) - 1), bool)  # which words stand side by side in an item
        next_to[begin[(begin > 0) & (begin < len(number))] - 1] = False
        at = np.flatnonzero(next_to)
        self.pairs = np.unique(number[at].astype(np.int64) * (len(self.vocabulary) + 1) + number[at + 1])


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of small non-negative integers; each 0 ends a stretch and sorts by its place."""
    n = len(text)
    rank = text.astype(np.int64) + n
    zero = np.flatnonzero(text == 0)
    rank[zero] = np.arange(len(zero))
    _, rank = np.unique(rank, return_inverse=True)
    step = 1
    while True:
        key = rank * np.int64(n + 1)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        k = key[order]
        new = np.concatenate([[0], np.cumsum(k[1:] != k[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1 or step >= n:
            return order
        step *= 2


class Wavelet:
    """Ranks in a sequence of integers below 2**bits: one counted bit vector a level, zeros before ones."""

    def __init__(self, x: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for b in range(bits - 1, -1, -1):
            bit = (x >> b) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(int(len(x) - self.ones[-1][-1]))
            x = np.concatenate([x[bit == 0], x[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before place `at`."""
        lo = np.zeros_like(at)
        for level in range(self.bits):
            bit = (symbol >> (self.bits - 1 - level)) & 1
            ones, z = self.ones[level], self.zeros[level]
            a, b = ones[at], ones[lo]
            at = np.where(bit == 1, z + a, at - a)
            lo = np.where(bit == 1, z + b, lo - b)
        return at - lo

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at a place, and how often it stands before it."""
        lo, symbol = np.zeros_like(at), np.zeros_like(at)
        for level in range(self.bits):
            ones, z = self.ones[level], self.zeros[level]
            bit = ones[at + 1] - ones[at]
            a, b = ones[at], ones[lo]
            at = np.where(bit == 1, z + a, at - a)
            lo = np.where(bit == 1, z + b, lo - b)
            symbol = symbol * 2 + bit
        return symbol, at - lo


class FMIndex:
    """Backward search and location over stretches of positive integers, each closed by a 0."""

    def __init__(self, text: np.ndarray):
        sa = suffix_array(text)
        bwt = text[sa - 1].astype(np.int64)  # the first suffix gets the last 0
        self.wavelet = Wavelet(bwt, max(1, int(text.max()).bit_length()))
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=int(text.max()) + 1))]).astype(np.int64)
        begins = np.concatenate([[True], text[:-1] == 0])
        kept = begins[sa] | (sa % SAMPLE == 0)
        self.kept_at = np.concatenate([[0], np.cumsum(kept)]).astype(np.int64)
        self.sample = sa[kept]
        self.n, self.top = len(text), int(text.max())

    def search(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix range [lo, hi) of each row of right-aligned words."""
        lo, hi = np.zeros(len(words), np.int64), np.full(len(words), self.n, np.int64)
        for j in range(words.shape[1] - 1, -1, -1):
            w = words[:, j].astype(np.int64)
            go = np.flatnonzero((w > 0) & (lo < hi))
            if not len(go):
                continue
            c = w[go]
            known = c <= self.top
            c = np.minimum(c, self.top)
            lo[go] = np.where(known, self.below[c] + self.wavelet.rank(c, lo[go]), 0)
            hi[go] = np.where(known, self.below[c] + self.wavelet.rank(c, hi[go]), 0)
        return lo, hi

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Text places of suffixes: walk back to a sampled one and count the steps."""
        out = np.zeros(len(row), np.int64)
        left, steps = np.arange(len(row)), np.zeros(len(row), np.int64)
        row = row.copy()
        while len(left):
            hit = self.kept_at[row + 1] > self.kept_at[row]
            out[left[hit]] = self.sample[self.kept_at[row[hit]]] + steps[hit]
            left, row, steps = left[~hit], row[~hit], steps[~hit] + 1
            if len(left):
                c, before = self.wavelet.access(row)
                row = self.below[c] + before
        return out


def occurrences(part: K.Words, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of every occurrence of every window in the shard's words."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    vocabulary = phrases.vocabulary
    if not len(part.hash) or not len(vocabulary):
        return none
    at = np.minimum(np.searchsorted(vocabulary, part.hash), len(vocabulary) - 1)
    number = np.where(vocabulary[at] == part.hash, at + 1, 0)
    row = part.rows()
    joined = np.zeros(len(number), bool)  # joined[i]: words i and i + 1 can stand side by side in a window
    two = np.flatnonzero((number[:-1] > 0) & (number[1:] > 0) & (row[:-1] == row[1:]))
    if len(two) and len(phrases.pairs):
        code = number[two] * (len(vocabulary) + 1) + number[two + 1]
        p = np.minimum(np.searchsorted(phrases.pairs, code), len(phrases.pairs) - 1)
        joined[two[phrases.pairs[p] == code]] = True
    first = np.flatnonzero((number > 0) & ~np.concatenate([[False], joined[:-1]]))
    last = np.flatnonzero((number > 0) & ~joined) + 1
    keep = last - first >= phrases.least
    first, last = first[keep], last[keep]
    if not len(first):
        return none
    size = last - first + 1
    ends = np.cumsum(size)
    place = np.arange(ends[-1]) - np.repeat(ends - size, size) + np.repeat(first, size)  # word of each place; a 0's is unused
    text = number[np.minimum(place, len(number) - 1)]
    text[ends - 1] = 0
    index = FMIndex(text)
    there = np.zeros(len(vocabulary) + 2, bool)
    there[text] = True
    there[0] = True
    ask = np.flatnonzero(there[phrases.words].all(axis=1))
    lo, hi = index.search(phrases.words[ask])
    count = np.maximum(hi - lo, 0)
    window = np.repeat(ask, count)
    suffix = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
    return place[index.locate(suffix)], window


SPAN = "array<struct<start:int,end:int,first:int,words:int>>"


def _span_array(row: np.ndarray, n: int, start, end, first, words) -> pa.ListArray:
    parts = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (start, end, first, words)], ["start", "end", "first", "words"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), parts)


def _scan(phrases, number: int):
    """Adds the spans and items of one block of the benchmark to every row."""

    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book: Phrases = phrases.value
        for batch in batches:
            texts = batch.column("__text")
            for part in K.words(texts, K.ALNUM, True, SHARD_BYTES):
                at, window = occurrences(part, book)
                n = part.hi - part.lo
                row = np.searchsorted(part.row_at, at, "right") - 1
                srow, lo, hi = K.merged(row, at, at + book.length[window])
                base = np.concatenate([[0], np.cumsum(_lengths(texts, part))])[srow]  # byte places count from the row's text
                spans = _span_array(srow, n, part.start[lo] - base, part.end[hi - 1] - base, lo - part.row_at[srow], hi - lo)
                size = book.owner_at[window + 1] - book.owner_at[window]
                owner = book.owner[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(book.owner_at[window], size)]
                many = max(1, len(book.names))
                pair = np.unique(np.repeat(row, size) * many + owner)
                items = pa.ListArray.from_arrays(pa.array(np.searchsorted(pair // many, np.arange(n + 1)).astype(np.int32)), pa.array(book.names[pair % many] if len(pair) else [], pa.string()))
                cols = dict(zip(batch.schema.names, [c.slice(part.lo, n) for c in batch.columns], strict=True))
                cols |= {"n_words": pa.array(np.diff(part.row_at).astype(np.int64)), f"spans{number}": spans, f"items{number}": items}
                yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return run


@K.tidy
def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges the spans that several blocks found in a row."""
    for batch in batches:
        column = batch.column("spans")
        row = np.repeat(np.arange(len(column)), column.value_lengths().to_numpy())
        flat = column.flatten()
        start, end, first, n = (flat.field(x).to_numpy().astype(np.int64) for x in ("start", "end", "first", "words"))
        srow, lo, hi = K.merged(row, first, first + n)
        # A union begins where one of its parts begins and ends where one ends.
        group = np.searchsorted(srow * (1 << 32) + lo, row * (1 << 32) + first, "right") - 1
        s, e = np.full(len(srow), 1 << 31), np.zeros(len(srow), np.int64)
        np.minimum.at(s, group, start)
        np.maximum.at(e, group, end)
        cols = [c if name != "spans" else _span_array(srow, len(column), s, e, lo, hi - lo) for name, c in zip(batch.schema.names, batch.columns, strict=True)]
        yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)


def _lengths(texts: pa.Array, part: K.Words) -> np.ndarray:
    offsets, _ = K.buffers(texts.slice(part.lo, part.hi - part.lo))
    return np.diff(offsets)


_WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")


def _pieces(text: str, width: int, block_bytes: int) -> Iterator[str]:
    """A text of at most half a block as it is, a longer one in pieces that overlap by all but one word of a window."""
    if 2 * len(text) <= block_bytes and 2 * len(text.encode()) <= block_bytes:
        yield text
        return
    held: list[str] = []
    size, new = 0, 0
    for m in _WORD.finditer(text):
        held.append(m[0])
        size, new = size + len(m[0].encode()) + 1, new + 1
        if 2 * size > block_bytes and len(held) >= width:
            yield " ".join(held)
            held, new = held[len(held) - width + 1 :], 0
            size = sum(len(w.encode()) + 1 for w in held)
    if new:
        yield " ".join(held)


def _blocks(benchmark: DataFrame, width: int, block_bytes: int) -> Iterator[list[tuple[str | None, str]]]:
    block, size = [], 0
    for r in benchmark.toLocalIterator():
        for piece in _pieces(r[1] or "", width, block_bytes):
            n = len(piece.encode())
            if block and size + n > block_bytes:
                yield block
                block, size = [], 0
            block.append((r[0], piece))
            size += n
    yield block


def decontaminate(
    documents: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_id_column: str = "item_id",
    item_text_column: str = "text",
    width: int = 13,
    least_share: float = 0.05,
    block_bytes: int = 12 << 20,
) -> DataFrame:
    """One row per document: id, n_words, n_hit, items (the ids of benchmark items with occurring windows, sorted as
    strings), spans (merged removal spans: byte range and number of words) and contaminated.

    Words are runs of digits, letters a-z after lower-casing A-Z, and non-ASCII characters. A window is `width`
    consecutive words of an item; a shorter item, if it has words, is one window. A document is contaminated if it has
    a hit word and hit words are at least `least_share` of its words.

    Null or empty texts have no words and are clean. Repeated rows and ids are judged one by one. Items that share
    windows are all named; an item whose id is null hits words like any other but has no name. An empty benchmark hits nothing, empty documents give
    no rows. Other columns of the inputs are not looked at.
    """
    spark = documents.sparkSession
    out = documents.select(F.col(id_column).alias("__id"), F.col(text_column).cast("string").alias("__text"))
    items = benchmark.select(F.col(item_id_column).cast("string").alias("a"), F.col(item_text_column).cast("string").alias("b"))
    fields = [f"__id {documents.schema[id_column].dataType.simpleString()}", "__text string", "n_words bigint"]
    names = [f.split()[0] for f in fields]
    for block in _blocks(items, width, block_bytes):
        again = "spans" in out.columns
        found = (cut(out) if again else out).mapInArrow(_scan(spark.sparkContext.broadcast(Phrases(block, width)), 0), ", ".join([*fields, *(("spans " + SPAN, "items array<string>") if again else ()), f"spans0 {SPAN}", "items0 array<string>"]))
        spans, items_ = (F.concat(c, f"{c}0") if again else F.col(f"{c}0") for c in ("spans", "items"))
        out = found.select(*names, spans.alias("spans"), F.array_sort(F.array_distinct(F.array_compact(items_))).alias("items"))
        if again:
            out = out.mapInArrow(_union, out.schema)
    out = out.select("__id", "n_words", "spans", "items")
    out = out.withColumn("n_hit", F.expr("aggregate(spans, 0L, (a, s) -> a + s.words)"))
    share = F.col("n_hit") * round(1 / least_share) >= F.col("n_words") if abs(round(1 / least_share) * least_share - 1) < 1e-12 else F.col("n_hit") >= least_share * F.col("n_words")
    return out.select(F.col("__id").alias(id_column), "n_words", "n_hit", "items", "spans", ((F.col("n_hit") > 0) & share).alias("contaminated"))
