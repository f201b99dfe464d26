"""Removal of long repeated strings by an enhanced suffix array and its tree of common-prefix intervals.

The suffix array is sparse: it holds the suffixes that start at anchors. An anchor is a place whose GRAM bytes have the
smallest hash among those of some window of `least` bytes (a minimizer). Equal windows have equal anchors, and every
window has one, so every repeated window shows up as two suffixes with a common prefix, and a common left context, that
together reach `least` bytes.

1. Anchors whose bytes occur once are dropped. Anchors whose whole context - all windows around them - occurs again are
   settled by comparing hashes, however many copies there are. One of each such context stays. Both comparisons are
   made among a sender's own records first, which then sends one record of a kind.
2. The other contexts are dealt by anchor and sorted by suffix: each task gets a part of the suffix array.
3. A stack scan over the neighbours' common prefixes gives the interval trees of many anchors. In each interval the members
   are ordered by their left contexts; the common left extensions of neighbours there tell how far the maximal repeats -
   groups that can be extended neither way - reach around each member.
4. A group with more than HOT different contexts is not gathered in one task but split by the bytes around the anchor:
   what covers a window shares either so many bytes to the right or the rest of it to the left, so members are dealt anew
   by either. Parts that are still too large are split again, down to whole windows, of which only the number counts.
   All other parts are suffix arrays with interval trees like any group.
5. Spans meet their texts again, are merged and cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import packets as P
from .shared import cut, row_key

GRAM, HOT, CHUNK, SLICE = 50, 50_000, 1 << 20, 1 << 18
_KINDS = ["u8", "u8", "i8", "i4", "i4"]  # anchor, context, key, place, flag - 0: asks, 1: the answer is known, 2: known, tells others


def _anchors(least: int, gram: int):
    def records(batch: pa.RecordBatch) -> Iterator[list[np.ndarray]]:
        key = batch.column("key").to_numpy()
        offsets, whole = K.buffers(batch.column("text"))
        for lo, hi in K.row_chunks(offsets, CHUNK):
            data = whole[offsets[lo] : offsets[hi]]
            edge = offsets[lo : hi + 1] - offsets[lo]
            if len(data) < least:
                continue
            ok = np.zeros(len(data) - least + 1, bool)
            ok[K.expand(edge[:-1], np.maximum(np.diff(edge) - least + 1, 0))] = True
            at = K.minimizers(K.gram_hashes(data, gram), ok, least - gram + 1)
            row = np.searchsorted(edge, at, "right") - 1
            left = np.minimum(at - edge[row], least - gram)
            right = np.minimum(edge[row + 1] - at, least)
            context = K.mix(K.span_hashes(data, at - left, at + right) + left.astype(np.uint64))
            yield [K.span_hashes(data, at, at + gram), context, key[lo + row], (at - edge[row]).astype(np.int32)]

    return records


def _rows(batch: pa.RecordBatch) -> Iterator[list[np.ndarray]]:
    anchor, context, key, at = (batch.column(c).to_numpy() for c in ("anchor", "context", "key", "at"))
    yield [anchor.view(np.uint64), context.view(np.uint64), key, at]


def _equal(columns: list[np.ndarray], by_context: bool) -> np.ndarray:
    """What must be equal for records to count as repeats of each other."""
    return K.mix(columns[0] * np.uint64(5) + columns[1]) if by_context else columns[0]


def _settle(number: int, by_context: bool):
    def settle(columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        h = _equal(columns, by_context)
        order = np.argsort(h, kind="stable")
        starts = np.concatenate([[True], h[order][1:] != h[order][:-1]])
        first, alone = np.empty(len(h), bool), np.empty(len(h), bool)
        first[order] = starts
        alone[order] = starts & np.concatenate([starts[1:], [True]])
        # Records stay in the order of their texts, which packs best.
        told = [c[~alone] for c in columns]
        if by_context:  # settled for good: only the place is still needed
            told[0], told[1] = np.zeros_like(told[0]), np.zeros_like(told[1])
        sent = [np.concatenate([c[first], k]) for c, k in zip(columns, told, strict=True)]
        flag = np.concatenate([np.where(alone[first], 0, 2), np.ones(len(told[0]))]).astype(np.int32)
        bucket = np.concatenate([(h[first] >> np.uint64(20)) % np.uint64(number), K.mix(told[2].view(np.uint64)) % np.uint64(number)])
        return bucket.astype(np.int64), [*sent, flag]

    return settle


def _meet(by_context: bool):
    """In a bucket: the records that have an equal; of contexts also the others, and one record of each kind.

    what: -1 has an equal, 0 has none, 1 stands for a context that has.
    """

    def meet(columns: list[np.ndarray]) -> pa.RecordBatch | None:
        known = columns[4] == 1
        asked = [c[~known] for c in columns]
        h = _equal(asked, by_context)
        order = np.lexsort((asked[3], asked[2], h))
        h, asked = h[order], [c[order] for c in asked]
        first = np.concatenate([[True], h[1:] != h[:-1]])[: len(h)]
        begin = np.flatnonzero(first)
        size = np.diff(np.append(begin, len(h)))
        twice = np.repeat((size > 1) | (np.maximum.reduceat(asked[4], begin) == 2), size) if len(h) else np.zeros(0, bool)
        out = [(twice & (asked[4] == 0), -1)]
        if by_context:
            out += [(first & ~twice, 0), (first & twice, 1)]
        parts = [[c[at] for c in asked[:4]] + [np.full(int(at.sum()), what, np.int32)] for at, what in out]
        parts.append([c[known] for c in columns[:4]] + [np.full(int(known.sum()), -1, np.int32)])
        anchor, context, key, at, what = (np.concatenate(c) for c in zip(*parts, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor.view(np.int64), context.view(np.int64), key, at, what)], names=["anchor", "context", "key", "at", "what"])

    return meet


def _contexts(least: int, gram: int):
    """Cuts the contexts of the wanted anchors out of their texts."""

    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = K.buffers(batch.column("text"))
            wanted = batch.column("wanted")
            row = np.repeat(np.arange(len(wanted)), wanted.value_lengths().to_numpy())
            flat = wanted.flatten()
            at = flat.field("at").to_numpy().astype(np.int64)
            key = batch.column("key").to_numpy()
            for lo in range(0, len(at), 20_000):
                r, a = row[lo : lo + 20_000], at[lo : lo + 20_000]
                left = np.minimum(a, least - gram)
                right = np.minimum(offsets[r + 1] - offsets[r] - a, least)
                p = offsets[r] + a
                raw = data.tobytes() if len(data) < CHUNK else memoryview(data)
                yield pa.RecordBatch.from_arrays(
                    [
                        flat.field("anchor").slice(lo, len(a)),
                        flat.field("hot").slice(lo, len(a)),
                        pa.array(key[r]),
                        flat.field("at").slice(lo, len(a)),
                        pa.array([bytes(raw[x : x + n]) for x, n in zip(p.tolist(), right.tolist(), strict=True)], pa.binary()),
                        pa.array([bytes(raw[x - n : x]) for x, n in zip(p.tolist(), left.tolist(), strict=True)], pa.binary()),
                    ],
                    names=["anchor", "hot", "key", "at", "suffix", "before"],
                )

    return run


def _matrix(column: pa.Array, width: int, backwards: bool) -> tuple[np.ndarray, np.ndarray]:
    """The byte strings as rows of a matrix, and their lengths."""
    offsets, data = K.buffers(column)
    size = np.diff(offsets)
    out = np.zeros((len(size), width), np.uint8)
    row = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(data)) - np.repeat(offsets[:-1], size)
    out[row, np.repeat(size, size) - 1 - place if backwards else place] = data
    return out, size


def _common(m: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of rows a and b."""
    out = np.empty(len(a), np.int64)
    for lo in range(0, len(a), 8192):
        x, y = a[lo : lo + 8192], b[lo : lo + 8192]
        differ = m[x] != m[y]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), m.shape[1])
        out[lo : lo + 8192] = np.minimum(first, np.minimum(size[x], size[y]))
    return out


def intervals(lcp: list[int], least: int = 0) -> Iterator[tuple[int, int, int]]:
    """Stack scan: (length, first, last) of each common-prefix interval with a length of at least `least`.

    lcp[i] is what elements i and i + 1 have in common.
    """
    stack: list[tuple[int, int]] = []
    for i, x in enumerate([*lcp, -1]):
        first = i
        while stack and stack[-1][0] > x:
            length, first = stack.pop()
            if length >= least:
                yield length, first, i
        if x >= 0 and (not stack or stack[-1][0] < x):
            stack.append((x, first))


class _Lowest:
    """Smallest element of ranges, by doubling."""

    def __init__(self, x: np.ndarray):
        self.levels = np.zeros((max(1, len(x)).bit_length(), len(x)), x.dtype)
        self.levels[0] = x
        for k in range(1, len(self.levels)):
            step, n = 1 << (k - 1), len(x) - (1 << k) + 1
            np.minimum(self.levels[k - 1, :n], self.levels[k - 1, step : step + n], out=self.levels[k, :n])

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        level = np.frexp((hi - lo).astype(float))[1] - 1
        return np.minimum(self.levels[level, lo], self.levels[level, hi - (1 << level)])


def maximal_repeats(right: np.ndarray, right_lcp: np.ndarray, left_order: np.ndarray, left_lcp: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, int, int]]:
    """(members, left, right) of each maximal repeat of one anchor: the members share `left` bytes before the anchor and
    `right` bytes from it, at least `least` together; no larger group shares as much, no longer string is shared by all.

    Members are numbered in suffix order; left_order lists them by left context. `covered` looks at the same intervals for
    many anchors at once, without listing groups.
    """
    n = len(right)
    rank = np.empty(n, np.int64)
    rank[left_order] = np.arange(n)
    low_left, low_right = _Lowest(left_lcp), _Lowest(right_lcp)
    for r, i, j in intervals(right_lcp.tolist()):
        places = np.sort(rank[i : j + 1])
        shared = low_left(places[:-1], places[1:])
        enough = np.flatnonzero(shared + r >= least)
        if not len(enough):
            continue
        for run in np.split(enough, np.flatnonzero(np.diff(enough) > 1) + 1):
            a, part = int(run[0]), shared[run]
            tree = [(int(part[0]), 0, len(part))] if part.min() == part.max() else intervals(part.tolist())
            for length, x, y in tree:
                members = left_order[places[a + x : a + y + 1]]
                first, last = int(members.min()), int(members.max())
                # A group that shares more to the right belongs to an interval within this one.
                if int(low_right(np.array([first]), np.array([last]))[0]) == r:
                    yield members, length, r


def covered(right_lcp: np.ndarray, left_order: np.ndarray, left_lcp: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """How far the maximal repeats of many anchors reach to the left and to the right of each member, 0 where there is none.

    Members are numbered in suffix order, anchor by anchor, with a right_lcp of -1 between two anchors; left_order lists them
    by anchor and left context. In an interval of the tree a member shares most to the left with a neighbour in left_order,
    so neighbours tell all. An interval lies in as many others as there are lengths from `gram` to `least`, at most, so
    the work grows with the members. It is done for about SLICE members of intervals at once.
    """
    n = len(left_order)
    rank = np.empty(n, np.int64)
    rank[left_order] = np.arange(n)
    best = np.zeros(n, np.int64)  # what a member shares with any other of its anchor
    best[left_order[:-1]] = left_lcp
    best[left_order[1:]] = np.maximum(best[left_order[1:]], left_lcp)
    low = _Lowest(left_lcp.astype(np.int32))
    left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    tree = np.array(list(intervals(right_lcp.tolist(), gram)), np.int64).reshape(-1, 3)
    ends = np.cumsum(tree[:, 2] - tree[:, 1] + 1)
    at = 0
    while at < len(tree):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
        length, first, last = tree[at:to].T
        member, of = K.expand(first, last - first + 1), np.repeat(np.arange(to - at), last - first + 1)
        able = best[member] + length[of] >= least
        of, place = np.divmod(np.sort(of[able] * n + rank[member[able]]), n)
        pair = np.flatnonzero(of[1:] == of[:-1])
        x, y, reach = place[pair], place[pair + 1], length[of[pair]]
        shared = low(x, y)
        hit = shared + reach >= least
        for side in (left_order[x[hit]], left_order[y[hit]]):
            np.maximum.at(left, side, shared[hit])
            np.maximum.at(right, side, reach[hit])
        at = to
    return left, right


def _groups(least: int, gram: int):
    """Interval trees of whole anchors, rows sorted by anchor and suffix: how far each context is covered."""

    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            anchor = t.column("anchor").to_numpy()
            stop = len(anchor) - _tail(anchor)
            rest = t.slice(stop)
            if stop:
                yield solve(t.slice(0, stop).combine_chunks())
        if rest is not None and len(rest):
            yield solve(rest.combine_chunks())

    def solve(t: pa.Table) -> pa.RecordBatch:
        anchor, n = t.column("anchor").to_numpy(), len(t)
        after, after_size = _matrix(t.column("suffix"), least, False)
        before, before_size = _matrix(t.column("before"), least - gram, True)
        begin = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        size = np.diff(np.append(begin, n))
        lcp = np.append(_common(after, after_size, np.arange(n - 1), np.arange(1, n)), 0)
        left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
        two = begin[size == 2]
        if len(two):  # an interval of two members is a leaf pair
            both = _common(before, before_size, two, two + 1)
            hit = both + lcp[two] >= least
            for at in (two[hit], two[hit] + 1):
                left[at], right[at] = both[hit], lcp[two[hit]]
        many = size > 2
        if many.any():
            group = np.repeat(np.arange(len(begin)), size)
            rows = np.flatnonzero(many[group])
            words = np.ascontiguousarray(np.pad(before[rows], ((0, 0), (0, -before.shape[1] % 8)))).view(">u8")
            order = rows[np.lexsort((before_size[rows], *words.T[::-1], group[rows]))]
            near = _common(before, before_size, order[:-1], order[1:])
            near[group[order[1:]] != group[order[:-1]]] = 0
            lcp[begin[1:] - 1] = -1
            back = np.empty(n, np.int64)
            back[rows] = np.arange(len(rows))
            left[rows], right[rows] = covered(lcp[rows[:-1]], back[order], near, least, gram)
        hit = np.flatnonzero(right)
        return pa.RecordBatch.from_arrays(
            [pa.array(t.column("key").to_numpy()[hit]), pa.array(t.column("at").to_numpy()[hit].astype(np.int32)), pa.array(left[hit].astype(np.int32)), pa.array(right[hit].astype(np.int32))],
            names=["key", "at", "left", "right"],
        )

    return run


def _tail(anchor: np.ndarray) -> int:
    """Rows of the last anchor, whose group may go on in the next batch."""
    other = np.flatnonzero(anchor != anchor[-1])
    return len(anchor) - (int(other[-1]) + 1 if len(other) else 0)


def split_hot(members: DataFrame, least: int, gram: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """Of rows with anchor, key, at, suffix and before: the same rows in groups of at most `hot`, told by `anchor`, and the
    covers (key, at, left, right) of windows that larger groups share whole.

    Members of a group share `l` bytes before the anchor and `r` from it. Two that share more, `least` together, share half
    of what is missing to the right, or else the other half and one byte to the left.
    """
    rows = members.select(F.col("anchor").alias("g"), "key", "at", "suffix", "before", F.lit(0).alias("l"), F.lit(gram).alias("r"), F.lit(0).cast("long").alias("check"))
    small, whole = [], []
    while True:
        rows = cut(rows)
        sizes = cut(rows.groupBy("g", "l", "r", "check").agg(F.count("*").alias("n")).where("n > 1"))
        # Few groups are large, but how few is not known: they are joined, and their members split as a skewed side.
        told = rows.join(sizes, ["g", "l", "r", "check"])
        missing = F.lit(least) - F.col("l") - F.col("r")
        whole.append(told.where(missing <= 0).select("key", "at", F.col("l").alias("left"), F.col("r").alias("right")))
        small.append(told.where((missing > 0) & (F.col("n") <= hot)).select(F.xxhash64("g", "l", "r").alias("anchor"), "key", "at", "suffix", "before"))
        if sizes.where((missing > 0) & (F.col("n") > hot)).isEmpty():
            break
        large = told.where((missing > 0) & (F.col("n") > hot)).drop("n")
        half = F.ceil(missing / 2).cast("int")
        right = large.withColumn("r", F.col("r") + half).where(F.length("suffix") >= F.col("r"))
        left = large.withColumn("l", F.col("l") + missing - half + 1).where(F.length("before") >= F.col("l"))
        after = F.substring("suffix", F.lit(1), F.col("r"))
        ahead = F.substring("before", F.length("before") - F.col("l") + 1, F.col("l"))
        rows = right.unionByName(left).withColumns({"g": F.xxhash64("g", after, ahead), "check": F.xxhash64(F.lit(7), after, ahead)})
    return reduce(DataFrame.unionByName, small), reduce(DataFrame.unionByName, whole)


def _apply(mode: str, least: int, gram: int):
    """Merges a text's spans and cuts them out."""

    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = K.buffers(batch.column("text"))
            n = np.diff(offsets)
            column = batch.column("found")
            row = np.repeat(np.arange(len(column)), column.value_lengths().fill_null(0).to_numpy())
            flat = column.flatten()
            at, left, right = (flat.field(x).to_numpy().astype(np.int64) for x in ("at", "left", "right"))
            full = right < 0  # the whole context
            left = np.where(full, np.minimum(at, least - gram), left)
            right = np.where(full, np.minimum(n[row] - at, least), right)
            if mode == "text":
                whole = np.zeros(len(data) + 1, bool)  # where a character begins
                whole[:-1] = (data & 0xC0) != 0x80
                whole[-1] = True
            srow, lo, hi = K.merged(row, at - left, at + right)
            begins = np.searchsorted(srow, np.arange(len(column) + 1))
            kept = []
            for i in range(len(column)):
                a, parts = 0, []
                text = data[offsets[i] : offsets[i + 1]]
                for k in range(begins[i], begins[i + 1]):
                    x, y = int(lo[k]), int(hi[k])
                    if mode == "text":
                        while not whole[offsets[i] + x]:
                            x += 1
                        while y > x and not whole[offsets[i] + y]:
                            y -= 1
                    parts.append(text[a:x])
                    a = y
                parts.append(text[a:])
                b = b"".join(p.tobytes() for p in parts)
                kept.append(b.decode() if mode == "text" else hashlib.sha256(b).hexdigest() if mode == "digest" else b)
            spans = pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.StructArray.from_arrays([pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], ["start", "end"]))
            cols = {c: batch.column(c) for c in batch.schema.names if c not in ("text", "found", "key")}
            cols |= {"n_bytes": pa.array(n), "spans": spans, "kept": pa.array(kept, pa.binary() if mode == "bytes" else pa.string())}
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return run


def repeated(documents: DataFrame, least: int = 200, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """From rows with key and text: (key, at, left, right) around anchors whose windows occur again; right -1 means all."""
    number = P.buckets(documents.sparkSession)
    fields = "anchor long, context long, key long, at int, what int"
    again = P.exchange(documents.select("key", "text").mapInArrow(P.sender(_anchors(least, gram), _settle(number, False)), P.SCHEMA), _KINDS, _meet(False), fields)
    told = cut(P.exchange(again.mapInArrow(P.sender(_rows, _settle(number, True)), P.SCHEMA), _KINDS, _meet(True), fields))
    settled = told.where("what = -1").select("key", "at", F.lit(0).alias("left"), F.lit(-1).alias("right"))
    different = told.where("what >= 0")
    many = cut(different.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor", (F.col("n") > hot).alias("hot")))
    any_hot = not many.where("hot").isEmpty()
    wanted = different.join(many, "anchor").groupBy("key").agg(F.collect_list(F.struct("at", "anchor", "hot")).alias("wanted"))
    schema = "anchor long, hot boolean, key long, at int, suffix binary, before binary"
    contexts = documents.join(wanted, "key").mapInArrow(_contexts(least, gram), schema)
    covers = "key long, at int, left int, right int"
    groups, whole = contexts.where("not hot").drop("hot"), None
    if any_hot:
        contexts = cut(contexts)
        small, whole = split_hot(contexts.where("hot").drop("hot"), least, gram, hot)
        groups = contexts.where("not hot").drop("hot").unionByName(small)
    out = settled.unionByName(groups.repartition("anchor").sortWithinPartitions("anchor", "suffix").mapInArrow(_groups(least, gram), covers))
    if whole is not None:
        out = out.unionByName(whole)
    return out


def suffix_dedup(documents: DataFrame, least: int = 200, gram: int = GRAM, hot: int = HOT, mode: str = "bytes", text_column: str = "text") -> DataFrame:
    """Adds to each row n_bytes, n_removed, n_spans, spans (byte ranges) and kept - what is left of the text once every
    byte is gone that lies in a string of `least` bytes which starts anywhere else too, in the same text or another.

    Texts are UTF-8 bytes, null counts as empty; strings are judged on the input, not on what is left, and never cross
    texts. mode: kept as `bytes`; as `text`, where a span that cuts a character in two leaves it whole; or as `digest`,
    the SHA-256. Texts under `least` bytes stay as they are. Equal texts are copies of each other and lose all their
    bytes if they are long enough; rows equal in all columns too. Rows are told apart by a 64-bit hash of all their
    columns. An empty table gives no rows. Columns named like the new ones are replaced.
    """
    names = [c for c in documents.columns if c not in ("n_bytes", "n_removed", "n_spans", "spans", "kept", text_column)]
    kind = {f.name: f.dataType.simpleString() for f in documents.schema}
    inner = [f"c{i}" for i in range(len(names))]
    rows = documents.select(F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"), *(F.col(n).alias(c) for n, c in zip(names, inner, strict=True)))
    rows = rows.withColumn("key", row_key(F.to_json(F.struct(*inner)) if inner else F.lit(0), F.col("text")))
    rows = rows.select("key", *inner, "text")
    spans = repeated(rows, least, gram, hot)
    spans = spans.groupBy("key").agg(F.collect_list(F.struct("at", "left", "right")).alias("found"))
    joined = rows.join(spans, "key", "left")
    schema = ", ".join([*(f"{c} {kind[n]}" for n, c in zip(names, inner, strict=True)), "n_bytes long, spans array<struct<start:int,end:int>>", f"kept {'binary' if mode == 'bytes' else 'string'}"])
    out = joined.mapInArrow(_apply(mode, least, gram), schema)
    removed = F.expr("aggregate(spans, 0L, (a, s) -> a + s.end - s.start)")
    return out.select(*(F.col(c).alias(n) for n, c in zip(names, inner, strict=True)), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "spans", "kept")
