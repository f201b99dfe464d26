"""N-gram Jaccard join: documents whose sets of word shingles overlap enough, by blocked sparse matrix products.

1. Sets that are equal are one: the smallest id stands for its copies and carries their number.
2. Which documents can be similar at all is found by dividing each set's shingles, by hash, into a number of parts that depends on
   the set's size: similar sets differ in fewer shingles than there are parts, so they agree in some whole part. A set is
   divided on the level of its own size class, as a native, and on the next one's, as a guest. What agrees on a level is
   joined to families of that level; a family is a superset of what is linked, not yet a result.
3. Families are chains, and a passage that many documents share makes long ones. Similar sets agree in more parts than
   there are spare ones, so a family's sets are compared by their parts first, with the same product as in the next step
   over four bytes a part; what agrees in enough parts makes the families that go on.
4. A family's sets meet once and are cut into blocks of documents. Each pair of blocks is a product of two sparse
   document by n-gram matrices, held as postings and taken over blocks of columns: overlap counts are accumulated, and
   pairs that cannot reach the overlap that their sizes require are discarded on the way. A task returns a spanning forest of the links it
   found and each document's number of links, never all pairs. Guests are not compared with each other: they are on
   their own level.
5. Links are joined to components.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import packets as P
from .shared import components, cut

CHUNK, BLOCK = 2 << 20, 1500
#: Shingles of a block of documents, about; documents whose row of the product is made at once; products that are added at once.
SHINGLES, ROWS, PRODUCTS = 1 << 20, 64, 1 << 20
#: A signature counts as frequent from so many sets of a task's on; so many frequent ones at most go to all tasks (16 bytes each).
OFTEN, FREQUENT = 4, 1 << 17
_U = np.uint64


def shingle_sets(batch_text: pa.Array, n: int) -> Iterator[tuple[K.Words, list[np.ndarray]]]:
    """Each document's distinct n-word shingles, as sorted hashes."""
    for part in K.words(batch_text, K.NOT_SPACE, True, CHUNK):
        h = K.sequence_hashes(part.hash, n)
        at = part.row_at.tolist()
        out = []
        for a, b in zip(at, at[1:], strict=False):
            if b - a >= n:
                x = np.sort(h[a : b - n + 1])
                out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
            else:
                out.append(K.sequence_hashes(part.hash[a:b], b - a) if b > a else h[:0])
        yield part, out


def set_hashes(sets: list[np.ndarray]) -> np.ndarray:
    return np.array([int(K.mix(s).sum(dtype=np.uint64)) for s in sets], np.uint64)


def nodes_of(told: np.ndarray, level: np.ndarray, guest: np.ndarray) -> np.ndarray:
    """A set on a level: the same number for all copies, negative for natives, so that these come first."""
    h = K.mix(told.astype(np.uint64) ^ K.mix(level.astype(np.uint64) + _U(0x2545F4914F6CDD1D))) >> _U(1)
    return np.where(guest, h, h | _U(1 << 63)).view(np.int64)


class Parts:
    """How sets of each size are divided: by size class, the classes' largest sizes, parts, and spare parts among them.

    Sets agree in an empty part without having anything in common, so empty parts are no signatures. There are so many
    spare parts that hardly a set has more empty ones; those that do are told by the empty parts they have.
    """

    def __init__(self, share: Fraction, largest: int = 1 << 40):
        self.top, self.count, self.spare = [], [], []
        low = before = 1
        while low <= largest:
            top = int(low / share)
            differ = int((1 - share) / (1 + share) * 2 * top)
            spare = self._spares(differ, before) if differ else 0
            self.top.append(top)
            self.count.append(differ + 1 + spare if differ else 0)
            self.spare.append(spare)
            before, low = low, top + 1
        self.top, self.count, self.spare = np.array(self.top), np.array(self.count), np.array(self.spare)

    @staticmethod
    def _spares(differ: int, least: int) -> int:
        """Spare parts such that a set of `least` shingles, the fewest on the level, has more empty parts only beyond six
        standard deviations - or as many as there can be. Spare parts add empty parts, so very small sets may have none
        that are enough; there are then so few parts that all subsets of the empty ones are few too.
        """
        for deviations in (6, 5, 4, 3):
            spare = 3
            while spare <= least:
                parts = differ + 1 + spare
                empty = parts * math.exp(-least / parts)
                if (enough := math.ceil(empty + deviations * math.sqrt(empty))) <= spare:
                    return spare
                spare = enough
        return 3

    def own(self, size: np.ndarray) -> np.ndarray:
        """The level of each set's own size class."""
        return np.searchsorted(self.top, size)

    def divided(self, sets: list[np.ndarray], level: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each part of each set: a hash of its number and content, its tag - that of its number -, whether it has
        content and whose it is; and where each set's parts begin and how many there are."""
        size = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate([np.zeros(0, np.uint64), *sets])
        row = np.repeat(np.arange(len(sets)), size)
        parts = np.where(size > 0, self.count[level], 0)
        begin = np.cumsum(parts) - parts
        use = parts[row] > 0
        x, r = flat[use], row[use]
        y = K.mix(x + level[r].astype(np.uint64) * _U(0xA0761D6478BD642F))
        part = begin[r] + (y % parts[r].astype(np.uint64)).astype(np.int64)
        sums, filled = np.zeros(int(parts.sum()), np.uint64), np.zeros(int(parts.sum()), bool)
        np.add.at(sums, part, K.mix(y))
        filled[part] = True
        number = K.expand(np.zeros(len(parts), np.int64), parts)
        owner = np.repeat(np.arange(len(parts)), parts)
        tag = K.mix((number + (level[owner] << 44)).astype(np.uint64))
        return K.mix(sums + tag), tag, filled, owner, begin, parts

    def signatures(self, sets: list[np.ndarray], told: np.ndarray, frequent: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Signatures of each set's parts - on the level of its own size class, and of the next - and the sets on those
        levels that they are of; told: a number for each set.

        frequent: hashes of parts that many sets have, in order, and how many. Similar sets agree in one part more than
        there are spare ones; in empty parts they agree in no more than either has. So each set can do without as many of
        its parts as its empty ones leave of the spare ones, if all sets leave out the last by one order: the first that
        two similar sets agree in stays. The most frequent are last, which any counts may say.
        """
        hashes, nodes = [], []
        own = self.own(np.array([len(s) for s in sets], np.int64))
        for level in (own, own + 1):
            node = nodes_of(told, level, level > own)
            content, tag, filled, owner, begin, parts = self.divided(sets, level)
            empty, spare = np.bincount(owner[~filled], minlength=len(parts)), self.spare[level]
            h, o = content[filled], owner[filled]
            if frequent is not None:
                h, o = self._without_last(h, o, np.maximum(spare - empty, 0), *frequent)
            hashes.append(h)
            nodes.append(node[o])
            # Sets may agree in empty parts alone if they have more than the spare ones: then in some subset of one more.
            for i in np.flatnonzero((empty > spare) & (parts > 0)).tolist():
                mine = tag[begin[i] : begin[i] + parts[i]][~filled[begin[i] : begin[i] + parts[i]]]
                extra = np.array([sum(c) & (2**64 - 1) for c in itertools.combinations(mine.tolist(), int(spare[i]) + 1)], np.uint64)
                hashes.append(K.mix(extra ^ _U(0x5851F42D4C957F2D)))
                nodes.append(np.full(len(extra), node[i]))
        return np.concatenate(hashes), np.concatenate(nodes)

    @staticmethod
    def _without_last(h: np.ndarray, owner: np.ndarray, drop: np.ndarray, known: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each owner's hashes but for the last few, as many as `drop` says, by how frequent they are."""
        at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
        n = np.where(known[at] == h, times[at], 0) if len(known) else np.zeros(len(h), np.int64)
        order = np.lexsort((h, n, owner))
        h, owner = h[order], owner[order]
        end = np.cumsum(np.bincount(owner, minlength=len(drop)))
        keep = np.arange(len(h)) < (end - drop)[owner]
        return h[keep], owner[keep]


def _base(n: int):
    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sets in shingle_sets(batch.column("text"), n):
                one = set_hashes(sets)
                two = [int(K.mix(s ^ _U(0x9FB21C651E98DF25)).sum(dtype=np.uint64)) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(part.lo, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(one.view(np.int64)), pa.array(np.array(two, np.uint64).view(np.int64))],
                    names=["id", "n", "h1", "h2"],
                )

    return run


def _signatures(parts: Parts, n: int, frequent: tuple[np.ndarray, np.ndarray] | None = None):
    def records(batch: pa.RecordBatch) -> Iterator[list[np.ndarray]]:
        for _, sets in shingle_sets(batch.column("text"), n):
            yield [*parts.signatures(sets, set_hashes(sets), frequent)]

    return records


def _often(parts: Parts, n: int):
    """Signatures that OFTEN or more sets of those that a task holds at once have, and how many."""
    records = _signatures(parts, n)

    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for h, _ in records(batch):
                held.append(h)
                size += len(h)
                if size >= P.FLUSH:
                    yield counted(held)
                    held, size = [], 0
        if held:
            yield counted(held)

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        h, times = np.unique(np.concatenate(held), return_counts=True)
        h, times = h[times >= OFTEN], times[times >= OFTEN]
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(times.astype(np.int64))], names=["h", "times"])

    return run


def frequent_parts(rows: DataFrame, parts: Parts, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the most frequent parts of all rows, in order, and how many sets have them: FREQUENT at most, as all
    tasks get them. They only order a set's parts; nothing is lost by those that are missing."""
    counts = cut(rows.mapInArrow(_often(parts, n), "h long, times long").groupBy("h").agg(F.sum("times").alias("times")))
    power = F.floor(F.log2("times")).cast("int")
    least, many = 63, 0
    for p, c in sorted(((r[0], r[1]) for r in counts.groupBy(power.alias("p")).count().collect()), reverse=True):
        many += c
        if many > FREQUENT:
            break
        least = p
    t = counts.where(power >= least).toArrow()
    h = t.column("h").to_numpy().view(np.uint64)
    order = np.argsort(h)
    return h[order], t.column("times").to_numpy()[order]


def _stars(h: np.ndarray, node: np.ndarray, natives: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First record of each hash, and an edge from its smallest node to each other; natives: if that is a native only."""
    order = np.lexsort((node, h))
    h, node = h[order], node[order]
    first = np.concatenate([[True], h[1:] != h[:-1]])[: len(h)]
    begin = np.flatnonzero(first)
    low = np.repeat(node[begin], np.diff(np.append(begin, len(h))))
    edge = (low != node) & (low < 0) if natives else low != node
    pairs = np.unique(np.stack([low[edge], node[edge]], 1), axis=0) if edge.any() else np.zeros((0, 2), np.int64)
    return np.sort(order[begin]), pairs[:, 0], pairs[:, 1]  # in the sender's order, which packs best


def _settle(number: int):
    """A sender's documents that agree are joined at once; one of each hash is sent on."""

    def settle(columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        h, node = columns
        first, a, b = _stars(h, node)
        bucket = np.concatenate([(h[first] >> _U(20)) % _U(number), K.mix(b.view(np.uint64)) % _U(number)]).astype(np.int64)
        return bucket, [np.concatenate([h[first], a.view(np.uint64)]), np.concatenate([node[first], b]), np.concatenate([np.zeros(len(first), np.int8), np.ones(len(a), np.int8)])]

    return settle


def _meet(columns: list[np.ndarray]) -> pa.RecordBatch:
    h, node, known = columns
    asks = known == 0
    _, a, b = _stars(h[asks], node[asks], True)
    pairs = np.unique(np.stack([np.concatenate([a, h[~asks].view(np.int64)]), np.concatenate([b, node[~asks]])], 1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _levels(parts: Parts):
    """Each distinct set on its two levels."""

    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, told = parts.own(batch.column("n").to_numpy()), batch.column("h1").to_numpy().view(np.uint64)
            for level in (own, own + 1):
                cols = [batch.column("rep"), batch.column("weight"), batch.column("n"), pa.array(level.astype(np.int32)), pa.array(nodes_of(told, level, level > own))]
                yield pa.RecordBatch.from_arrays(cols, names=["rep", "weight", "n", "level", "node"])

    return run


def _vectors(parts: Parts, n: int):
    """Each document's set on its two levels as hashes of all its parts, empty ones too, four bytes each."""

    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sets in shingle_sets(batch.column("text"), n):
                own, told = parts.own(np.array([len(s) for s in sets], np.int64)), set_hashes(sets)
                ids = batch.column("id").slice(part.lo, len(sets))
                for level in (own, own + 1):
                    content, _, _, _, begin, count = parts.divided(sets, level)
                    offsets = np.append(begin, len(content)).astype(np.int32) * 4
                    packed = pa.Array.from_buffers(pa.binary(), len(sets), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(content.astype("<u4").tobytes())])
                    yield pa.RecordBatch.from_arrays([ids, pa.array(nodes_of(told, level, level > own)), packed], names=["id", "node", "shingles"]).filter(pa.array(count > 0))

    return run


def _sets(parts: Parts, n: int):
    """The shingle sets of a family's documents, one copy for each cell - pair of blocks - that needs them."""

    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = [batch.column(c).to_pylist() for c in ("id", "family", "level", "weight", "blocks", "block")]
            for part, sets in shingle_sets(batch.column("text"), n):
                rows: list[list] = [[] for _ in _CELL_NAMES]
                size = 0
                own = parts.own(np.array([len(s) for s in sets])).tolist()
                for s, at, (i, family, level, weight, blocks, block) in zip(sets, own, [list(r) for r in zip(*(c[part.lo : part.hi] for c in rest), strict=True)], strict=True):
                    if level - at not in (0, 1):  # another row's set that goes by the same id
                        continue
                    raw = s.tobytes()
                    for other in range(blocks):
                        for c, v in zip(rows, (family, min(block, other), max(block, other), i, weight, block, level > at, 0, raw), strict=True):
                            c.append(v)
                        size += len(raw)
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, _CELL_TYPES, strict=True)], names=_CELL_NAMES)
                            rows, size = [[] for _ in _CELL_NAMES], 0
                if rows[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, _CELL_TYPES, strict=True)], names=_CELL_NAMES)

    return run


_CELL_NAMES = ["family", "x", "y", "id", "weight", "block", "guest", "enough", "shingles"]
_CELL_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.binary()]
_CELL_SCHEMA = "family long, x int, y int, id long, weight long, block int, guest boolean, enough int, shingles binary"


def _multiplied(cells: DataFrame, percent: int) -> DataFrame:
    """The products of all cells, each in one task."""
    return cut(cells.repartition("family", "x", "y").sortWithinPartitions("family", "x", "y").mapInArrow(_cells(percent, 100), "a long, b long, links long"))


def _nearer(rows: DataFrame, members: DataFrame, parts: Parts, n: int, percent: int, block: int) -> DataFrame:
    """(node, family): the members that agree with another in as many parts as similar sets must."""
    sizes = members.groupBy("family").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.count("*").alias("members"), F.count_if(F.col("node") < 0).alias("natives"))
    sizes = sizes.where("members > 1 and natives > 0").select("family", "blocks")
    enough = F.element_at(F.array(*(F.lit(int(x)) for x in parts.spare + 1)), F.col("level") + 1)
    dealt = members.join(sizes, "family").select(F.col("rep").alias("id"), "node", "family", "blocks", enough.alias("enough"), F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    met = rows.mapInArrow(_vectors(parts, n), "id long, node long, shingles binary").join(dealt, ["id", "node"]).dropDuplicates(["node"])
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = met.select("family", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), F.col("node").alias("id"), F.lit(1).cast("long").alias("weight"), "block", (F.col("node") >= 0).alias("guest"), "enough", "shingles")
    return components(_multiplied(cells, percent).where("b is not null")).withColumnRenamed("component", "family")


class Incidence:
    """A sparse document by n-gram matrix as postings by column. Columns with equal postings are one, with a weight;
    columns that most documents have are held as the documents that lack them."""

    def __init__(self, sets: list[np.ndarray]):
        n = self.n = len(sets)
        flat = np.concatenate([np.zeros(0, np.uint64), *sets])
        order = np.argsort(flat, kind="stable")  # a column's documents in ascending order
        flat, doc = flat[order], np.repeat(np.arange(n, dtype=np.int32), [len(s) for s in sets])[order]
        begin = np.flatnonzero(np.concatenate([np.ones(min(len(flat), 1), bool), flat[1:] != flat[:-1]]))
        df = np.diff(np.append(begin, len(flat)))
        doc, df = doc[np.repeat(df > 1, df)], df[df > 1]  # columns of one document add to no overlap
        begin = np.cumsum(df) - df
        told = np.add.reduceat(K.mix(doc.astype(np.uint64) + _U(1)), begin) if len(begin) else np.zeros(0, np.uint64)
        _, first, weight = np.unique(told, return_index=True, return_counts=True)
        rare = np.argsort(np.minimum(df[first], n - df[first]), kind="stable")  # first those with the fewest products
        first, self.weight = first[rare], weight[rare].astype(np.int64)
        df, begin = df[first], begin[first]
        doc, column = doc[K.expand(begin, df)].astype(np.int64), np.repeat(np.arange(len(df)), df)
        self.common = np.bincount(doc, self.weight[column], n).astype(np.int64)  # shingles that some other document has
        full = 2 * df > n
        parts = [(column[~full[column]], doc[~full[column]])]
        number = np.flatnonzero(full)
        for lo in range(0, len(number), 256):
            some = number[lo : lo + 256]
            there = np.zeros((len(some), n), bool)
            at = np.isin(column, some)
            there[np.searchsorted(some, column[at]), doc[at]] = True
            c, d = np.nonzero(~there)
            parts.append((some[c], d))
        column, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(column, kind="stable")
        column, self.doc = column[order], doc[order]
        self.count = np.bincount(column, minlength=len(df))
        self.begin = np.cumsum(self.count) - self.count
        self.full = int(self.weight[full].sum())
        lacking = full[column]
        self.lack = np.bincount(self.doc[lacking], self.weight[column[lacking]], n).astype(np.int64)
        by_doc = np.argsort(self.doc, kind="stable")
        self.of_doc, self.doc_at = column[by_doc], np.searchsorted(self.doc[by_doc], np.arange(n + 1))

    def rows(self, first: int, last: int, alive: np.ndarray, need: np.ndarray) -> np.ndarray:
        """Which pairs of documents first to last with all others overlap in `need` shingles or more.

        Products are added a block of columns at a time. A pair is discarded once what it has and the most that its row
        has left cannot reach what it needs; a row without pairs takes no part in further blocks. What both documents
        lack of the full columns counts in neither: w(full) - lack(i) - lack(j) + w(lacked by both).
        """
        row = np.repeat(np.arange(last - first), np.diff(self.doc_at[first : last + 1]))
        column = self.of_doc[self.doc_at[first] : self.doc_at[last]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        have = self.full - self.lack[first:last, None] - self.lack[None, :]
        left = np.bincount(row, self.weight[column], last - first).astype(np.int64)
        at = 0
        while at < len(row) and alive.any():
            cost = np.cumsum(self.count[column[at : at + PRODUCTS]])
            to = at + max(1, int(np.searchsorted(cost, PRODUCTS, "right")))
            r, c = row[at:to], column[at:to]
            left -= np.bincount(r, self.weight[c], last - first).astype(np.int64)
            go = alive.any(axis=1)[r]
            r, c = r[go], c[go]
            n = self.count[c]
            key = np.repeat(r * self.n, n) + self.doc[K.expand(self.begin[c], n)]
            have += np.bincount(key, np.repeat(self.weight[c], n), have.size).astype(np.int64).reshape(have.shape)
            alive = alive & (have + left[:, None] >= need)
            at = to
        return alive & (have >= need)


def links(sets: list[np.ndarray], side: np.ndarray | None, up: int, down: int, guest: np.ndarray | None = None, enough: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(documents, matrix of these by all documents), a few documents at a time, of the pairs with
    down * overlap >= up * union; of pairs of the two sides only, if sides are given, and not of two guests.

    The product of the sparse incidence matrix with its transpose. Pairs whose sizes, or whose numbers of shingles that
    any other document has, cannot reach the overlap that their sizes require are discarded before it, others on the way.
    enough: an overlap that links whatever the sizes.
    """
    size = np.array([len(s) for s in sets], np.int64)
    everyone = np.arange(len(sets))

    def needed(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        if enough:
            return np.full((len(i), len(j)), enough)
        return -(-up * (size[i, None] + size[None, j]) // (up + down))  # overlap o with down * o >= up * (a + b - o)

    def possible(i: np.ndarray, j: np.ndarray, common: np.ndarray) -> np.ndarray:
        ok = (np.minimum(common[i, None], common[None, j]) >= needed(i, j)) & (i[:, None] != j[None, :])
        if side is not None:
            ok &= side[i, None] != side[None, j]
        if guest is not None:
            ok &= ~(guest[i, None] & guest[None, j])
        return ok

    # Documents that fit none by size, then those that share too few columns with all others together.
    common, keep = size, everyone
    for _ in range(2):
        some = [possible(keep[lo : lo + ROWS], keep, common).any(axis=1) for lo in range(0, len(keep), ROWS)]
        keep = keep[np.concatenate([np.zeros(0, bool), *some])]
        if len(keep) < 2:
            return
        product = Incidence([sets[i] for i in keep.tolist()])
        common = np.zeros(len(sets), np.int64)
        common[keep] = product.common
    for lo in range(0, len(keep), ROWS):
        i = keep[lo : lo + ROWS]
        out = np.zeros((len(i), len(sets)), bool)
        out[:, keep] = product.rows(lo, lo + len(i), possible(i, keep, common), needed(i, keep))
        yield i, out


def _cells(up: int, down: int):
    """Products of the cells' blocks, rows sorted by cell: each document's links, and edges that span what is linked."""

    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("family", "x", "y")), strict=True))
            lo = 0
            while lo < len(keys):
                hi = lo
                while hi < len(keys) and keys[hi] == keys[lo]:
                    hi += 1
                if keys[lo] != cell:
                    if held:
                        yield from solve(cell, held)
                    cell, held = keys[lo], []
                held.append(batch.slice(lo, hi - lo))
                lo = hi
        if held:
            yield from solve(cell, held)

    def solve(cell, held) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        if len(t) < 2:
            return
        ids, weight, block = (t.column(c).to_numpy() for c in ("id", "weight", "block"))
        guest = t.column("guest").to_numpy()
        offsets, data = K.buffers(t.column("shingles"))
        enough = t.column("enough")[0].as_py()
        sets = [data[a:b].view(np.uint32 if enough else np.uint64) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        many = np.zeros(len(ids), np.int64)
        part = np.arange(len(ids))  # what is joined so far
        a, b = [], []
        for some, linked in links(sets, block if cell[1] != cell[2] else None, up, down, guest, enough):
            many[some] = linked @ weight
            for i, row in zip(some.tolist(), linked, strict=True):
                others = np.unique(part[row])
                for j in others[others != part[i]].tolist():  # parts are told by one of their documents
                    a.append(int(ids[i]))
                    b.append(int(ids[j]))
                    part[part == j] = part[i]
        hit = np.flatnonzero(many)
        n = len(hit)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*ids[hit].tolist(), *a], pa.int64()), pa.array([*[None] * n, *b], pa.int64()), pa.array([*many[hit].tolist(), *[0] * len(a)], pa.int64())],
            names=["a", "b", "links"],
        )

    return run


def jaccard_join(documents: DataFrame, n: int = 4, percent: int = 85, block: int = BLOCK, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_shingles, component_id and n_links of every document.

    Words are what white space (0x20, 0x09 to 0x0D) leaves between it, A-Z lower-cased; a document's set holds its
    distinct n-word shingles, or its whole sequence if that is shorter. Two documents are linked if 100 times the size
    of the intersection is at least `percent` times that of the union. component_id is the smallest id that links
    reach, n_links the number of documents linked with. Documents without words have an empty set and no link, their
    own id is their component. Rows that share an id share its links. A null id has no links and a null component.
    Ids are whole numbers; empty tables give no rows; other columns are not looked at.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    base = cut(rows.mapInArrow(_base(n), "id long, n long, h1 long, h2 long"))
    whole = base.where("id is not null and n > 0").groupBy("n", "h1", "h2").agg(F.min("id").alias("rep"), F.countDistinct("id").alias("weight"))
    whole = cut(whole)
    number = P.buckets(spark) // 2
    parts = Parts(Fraction(percent, 100))
    named = rows.where("id is not null")
    sent = named.mapInArrow(P.sender(_signatures(parts, n, frequent_parts(named, parts, n)), _settle(number)), P.SCHEMA)
    family = components(P.exchange(sent, ["u8", "i8", "i1"], _meet, "a long, b long"))
    members = whole.select("rep", "weight", "n", "h1").mapInArrow(_levels(parts), "rep long, weight long, n long, level int, node long")
    members = cut(members.join(family.withColumnRenamed("component", "family"), "node"))
    members = members.drop("family").join(_nearer(named, members, parts, n, percent, 16 * block), "node")
    sizes = members.groupBy("family").agg(F.ceil(F.greatest(F.count("*") / block, F.sum("n") / SHINGLES)).cast("int").alias("blocks"), F.count("*").alias("members"), F.count_if(F.col("node") < 0).alias("natives"))
    sizes = sizes.where("members > 1 and natives > 0").select("family", "blocks")
    members = members.join(sizes, "family").select(F.col("rep").alias("id"), "family", "level", "weight", "blocks", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"))
    cells = rows.join(members.dropDuplicates(["id", "family"]), "id").mapInArrow(_sets(parts, n), _CELL_SCHEMA)
    found = _multiplied(cells, percent)
    count = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    joined = components(found.where("b is not null")).select(F.col("node").alias("rep"), "component")
    told = whole.join(joined, "rep", "left").join(count, "rep", "left")
    told = told.select("n", "h1", "h2", F.coalesce("component", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"))
    some, none = base.where("id is not null and n > 0"), base.where("id is null or n = 0")
    out = some.join(told, ["n", "h1", "h2"]).select("id", "n", "component", "links")
    out = out.unionByName(none.select("id", "n", F.col("id").alias("component"), F.lit(0).cast("long").alias("links")))
    return out.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("links").alias("n_links"))
