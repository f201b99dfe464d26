"""How far the sources of a language diverge in their words, exactly, by inclusion-exclusion over supports.

The divergence of source A from source B sums f(p, q) = floor((p - q)^2 / q) over every term of the language, but most terms
occur in neither. For one pair the sum is

    terms of A, as if absent from B    priced once for each distinct count in A's histogram
  + terms of B, as if absent from A    likewise
  + (V - |A| - |B|) f(p0, q0)          all terms, as if absent from both
  + terms of both                      f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0), from the postings of each term

so that work goes with the postings and the histograms. Sources of a language are numbered and dealt into blocks of at most
BLOCK; postings of a term are packed by block, joined block by block, and added up inside the tasks before they are shuffled.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .shared import cut, written

BLOCK = 256
#: Counts that a task gathers before it sends them on, and term pairs that are priced at once.
FLUSH, PAIRS = 300_000, 1 << 19
#: Terms of UTF-8 text with A-Z lower-cased.
_TERM = re.compile(rb"[a-z\x80-\xFF]+")


def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


@K.tidy
def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of terms and texts that hold them, by group, added up as far as a task's memory goes."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, texts) in held.items():
            terms = list(n)
            for at in range(0, len(terms), 50_000):
                some = terms[at : at + 50_000]
                cols = [pa.array([lang] * len(some), pa.string()), pa.array([source] * len(some), pa.string()), pa.array(some, pa.binary()).cast(pa.string())]
                cols += [pa.array([c[t] for t in some], pa.int64()) for c in (n, texts)]
                yield pa.RecordBatch.from_arrays(cols, names=["lang", "source", "term", "n", "texts"])
        held.clear()

    size = 0
    for batch in batches:
        offsets, data = K.buffers(batch.column("text"))
        at = offsets.tolist()
        for i, group in enumerate(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)):
            terms = _TERM.findall(K.LOWER[data[at[i] : at[i + 1]]].tobytes())
            n, texts = held[group]
            size -= len(n)
            n.update(terms)
            texts.update(set(terms))
            size += len(n)
            if size > FLUSH:
                yield from out()
                size = 0
    yield from out()


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def _lengths(column: pa.Array) -> np.ndarray:
    return column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def _sums(batches: Iterator[pa.RecordBatch], priced, block: int) -> Iterator[pa.RecordBatch]:
    """Adds what `priced` gives for the rows of each pair of blocks; a task holds one block pair's sums, or a few, at a time."""
    held: dict[tuple[str, int, int], np.ndarray] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, x, y), sums in held.items():
            a, b = np.nonzero(sums)
            if len(a):
                cols = [pa.array([lang] * len(a), pa.string()), pa.array((x * block + a).astype(np.int64)), pa.array((y * block + b).astype(np.int64)), pa.array(sums[a, b])]
                yield pa.RecordBatch.from_arrays(cols, names=["lang", "a", "b", "value"])
        held.clear()

    for batch in batches:
        for key, a, b, v in priced(batch):
            if key not in held:
                if len(held) >= 64:
                    yield from out()
                held[key] = np.zeros((block, block), np.int64)
            np.add.at(held[key], (a, b), v)
    yield from out()


def _overlaps(block: int):
    """Corrections for terms that two sources share: each row holds a term's postings in two blocks."""

    def priced(batch: pa.RecordBatch):
        lang = batch.column("lang").dictionary_encode()
        names, code = lang.dictionary.to_pylist(), lang.indices.to_numpy()
        x, y = batch.column("x").to_numpy(), batch.column("y").to_numpy()
        na, nb = _lengths(batch.column("xi")), _lengths(batch.column("yi"))
        ia, ps, za = (_flat(batch.column(c)) for c in ("xi", "xp", "xz"))
        ib, qs, zb = (_flat(batch.column(c)) for c in ("yi", "yp", "yz"))
        at, bt = np.cumsum(na) - na, np.cumsum(nb) - nb
        for key in np.unique(np.stack([code, x, y], 1), axis=0).tolist() if len(x) else []:
            rows = np.flatnonzero((code == key[0]) & (x == key[1]) & (y == key[2]))
            for lo, hi in K.row_chunks(np.concatenate([[0], np.cumsum(na[rows] * nb[rows])]), PAIRS):
                r = rows[lo:hi]
                width = np.repeat(nb[r], na[r])
                a, b = np.repeat(K.expand(at[r], na[r]), width), K.expand(np.repeat(bt[r], na[r]), width)
                if key[1] == key[2]:
                    other = ia[a] != ib[b]
                    a, b = a[other], b[other]
                p, q, p0, q0 = ps[a], qs[b], za[a], zb[b]
                yield (names[key[0]], key[1], key[2]), ia[a], ib[b], f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)

    return K.tidy(lambda batches: _sums(batches, priced, block))


def _apart(block: int):
    """Everything but the overlaps: each row holds one source's histogram and a block of sources of the language."""

    def priced(batch: pa.RecordBatch):
        for r in batch.to_pylist():
            i, p0, v = r["i"], np.int64(r["z"]), r["v"]
            p, h = np.array(r["p"], np.int64), np.array(r["h"], np.int64)
            other, q0 = np.array(r["yi"], np.int64), np.array(r["yz"], np.int64)
            if r["x"] == r["y"]:
                other, q0 = other[other != i], q0[other != i]
            n = int(h.sum())
            mine, theirs = (v - n) * f(p0, q0), -n * f(q0, p0)
            for at in range(0, len(p), 4096):
                some, times = p[at : at + 4096, None], h[at : at + 4096, None]
                mine = mine + (times * f(some, q0[None, :])).sum(0)
                theirs = theirs + (times * f(q0[None, :], some)).sum(0)
            here = np.full(len(other), i)
            yield (r["lang"], r["x"], r["y"]), here, other, mine
            yield (r["lang"], r["y"], r["x"]), other, here, theirs

    return K.tidy(lambda batches: _sums(batches, priced, block))


def share(n, total, terms):
    """p = 1 + floor(1000000000 (n + 1) / (total + terms)), in exact whole numbers."""
    return F.lit(1) + F.call_function("div", (F.lit(1_000_000_000).cast("decimal(11,0)") * (n + 1).cast("decimal(20,0)")), (total + terms).cast("decimal(20,0)"))


def divergence(documents: DataFrame, least: int = 3, top: int = 200, block: int = BLOCK, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Rows of two parts for each (lang, source): `pair`, every other source of the language with the summed f, p being the
    group's and q the other's; and `term`, the `top` kept terms that the group has and that weigh more in it than in the
    language, q being the language's. lang, source, part, item, value long, rank int from 1 for each group and part, by value
    descending, then item ascending in UTF-8.

    Terms are runs of letters A-Z and of characters from U+0080 on, of whole texts, only A-Z lower-cased; each language keeps
    those in at least `least` of its rows. p = 1 + floor(1000000000 (count + 1) / (N + V)), V kept terms, N the group's
    occurrences of them. Null text, lang and source count as empty strings. Repeated rows count each. A group without
    terms still is one, also where its language keeps none (all values 0); a language with one source has no rows, and so has an
    empty table. Other columns are not looked at. Values fit a long as long as a language keeps under 5 x 10^8 terms.
    """
    named = {"lang": F.coalesce(F.col(lang).cast("string"), F.lit("")), "source": F.coalesce(F.col(source).cast("string"), F.lit(""))}
    docs = documents.select(*(c.alias(n) for n, c in named.items()), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    sent = docs.mapInArrow(_counts, "lang string, source string, term string, n bigint, texts bigint")
    term = Window.partitionBy("lang", "term")
    summed = sent.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts"))
    marked = summed.withColumns({"of_texts": F.sum("texts").over(term), "of_lang": F.sum("n").over(term), "head": F.min("source").over(term) == F.col("source")})
    postings = cut(marked.where(F.col("of_texts") >= least).drop("texts", "of_texts"))

    langs = postings.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.count_if("head").alias("v"))
    totals = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.na.fill(0, ["total", "lang_n", "v"])
    absent = F.when(F.col("v") > 0, share(F.lit(0), F.col("total"), F.col("v"))).otherwise(1)
    i = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = written(groups.withColumns({"i": i.cast("long"), "z": absent}), "groups")  # with its true size, for the planner

    priced = postings.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("v")))
    q = share(F.col("of_lang"), F.col("lang_n"), F.col("v"))
    terms = priced.withColumn("q", q).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    terms = terms.withColumn("rank", rank).where(F.col("rank") <= top)

    place, within = F.expr(f"cast(i div {block} as int)"), F.expr(f"cast(i % {block} as int)").alias("i")
    packed = priced.repartition("lang", "term").groupBy("lang", "term", place.alias("block"))
    packed = packed.agg(F.collect_list(F.struct(within, "p", "z")).alias("s"))
    side = lambda c: packed.select("lang", "term", F.col("block").alias(c), F.col("s.i").alias(f"{c}i"), F.col("s.p").alias(f"{c}p"), F.col("s.z").alias(f"{c}z"))
    met = side("x").join(side("y"), ["lang", "term"]).where((F.size("xi") > 1) | (F.size("yi") > 1) | (F.col("x") != F.col("y"))).drop("term")
    kind = "lang string, a bigint, b bigint, value bigint"
    shared = met.mapInArrow(_overlaps(block), kind)

    histogram = priced.groupBy("lang", "source", "p").agg(F.count("*").alias("h")).groupBy("lang", "source").agg(F.collect_list(F.struct("p", "h")).alias("s"))
    ones = groups.join(histogram, ["lang", "source"], "left").select("lang", "v", "z", place.alias("x"), within, F.col("s.p").alias("p"), F.col("s.h").alias("h"))
    ones = ones.withColumns({c: F.coalesce(c, F.array().cast("array<bigint>")) for c in ("p", "h")})
    blocks = groups.groupBy("lang", place.alias("y")).agg(F.collect_list(F.struct(within, "z")).alias("s"))
    apart = ones.join(blocks.select("lang", "y", F.col("s.i").alias("yi"), F.col("s.z").alias("yz")), "lang").mapInArrow(_apart(block), kind)

    sums = shared.unionByName(apart).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    zero = groups.select("lang", "i", "source")
    every = zero.select("lang", F.col("i").alias("a"), "source").join(zero.select("lang", F.col("i").alias("b"), F.col("source").alias("item")), "lang").where("a != b")
    pairs = every.join(sums, ["lang", "a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).unionByName(terms)
