"""URL filters: rules first, then the ratio of two character language models.

The models are smoothed Markov chains of variable order over all bytes: one of accepted, one of rejected URLs. A byte's
probability after its last ORDER bytes is mixed with that after one less, and so on, each weighted by how much was seen
and how varied it was (Witten and Bell). A URL's score is the difference of its log-likelihoods divided by its length;
the threshold is calibrated on URLs the counts were not taken from.

Counts come from all URLs that a rule decides. They stay in Spark and grow with the input: strings of ORDER + 1 bytes are
dealt by the two bytes before the last, so that all counts a probability needs are in one task, but for those of orders
under LOW, of which there are at most 256 ** LOW and which go to all tasks. The logarithms found there are joined to the
URLs' places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import cut

ORDER, LOW, BINS, FOLDS = 6, 2, 2000, 5
ALPHABET = 256
#: Stands before a URL; no UTF-8 text holds this byte.
START = 255
#: Strings that a task takes at once, but for those of one context.
HELD = 1 << 19

UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parsed(url: Column) -> tuple[Column, Column]:
    """Host - after the first :// up to /, ?, # or the end, A-Z lower-cased - and path, up to ?, # or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, SMALL), F.lit("")), F.coalesce(path, F.lit(""))


def ruled(rules: list[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits, like `net/es/`, and its verdict; null if none does."""
    rule = verdict = None
    for said, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def _grams(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and last row, row of each byte, and it with ORDER bytes before it as one number."""
    offsets, whole = K.buffers(column)
    for lo, hi in K.row_chunks(offsets, 1 << 20):
        data = K.LOWER[whole[offsets[lo] : offsets[hi]]].astype(np.int64)
        size = np.diff(offsets[lo : hi + 1])
        row = np.repeat(np.arange(hi - lo), size)
        place = K.expand(np.zeros(hi - lo, np.int64), size)
        gram = data.copy()
        for k in range(1, ORDER + 1):
            before = np.full_like(data, START)
            before[k:] = data[:-k]
            gram += np.where(place >= k, before, START) * ALPHABET**k
        yield lo, hi, row, gram


@K.tidy
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each string stands in accepted and in rejected URLs; those of the others come with zeros."""
    for batch in batches:
        good, bad = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("good", "bad"))
        for lo, _, row, gram in _grams(batch.column("url")):
            key, which = np.unique(gram, return_inverse=True)
            counts = [np.bincount(which, c[lo + row], len(key)).astype(np.int64) for c in (good, bad)]
            yield pa.RecordBatch.from_arrays([pa.array(key), *map(pa.array, counts)], names=["gram", "good", "bad"])


@K.tidy
def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, _, row, gram in _grams(batch.column("url")):
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(lo + row)), pa.array(gram)], names=["key", "gram"])


class Chain:
    """A smoothed variable-order model; all orders come from the counts of the highest, or the first LOW from another model."""

    def __init__(self, gram: np.ndarray, n: np.ndarray, low: Chain | None = None):
        self.tables = [] if low is None else low.tables[:LOW]
        for k in range(len(self.tables), ORDER + 1):
            key, which = np.unique(gram % ALPHABET ** (k + 1), return_inverse=True)
            count = np.bincount(which, n, len(key)) if len(key) else np.zeros(0)
            context, inner = np.unique(key // ALPHABET, return_inverse=True)
            total, kinds = np.bincount(inner, count, len(context)), np.bincount(inner, minlength=len(context))
            # The last character is the lowest digit, its context the digits above.
            self.tables.append((key, count, context, total, kinds.astype(float)))

    @staticmethod
    def _get(keys: np.ndarray, values: np.ndarray, ask: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(len(ask))
        at = np.minimum(np.searchsorted(keys, ask), len(keys) - 1)
        return np.where(keys[at] == ask, values[at], 0.0)

    def logs(self, gram: np.ndarray) -> np.ndarray:
        p = np.full(len(gram), 1 / ALPHABET)
        for k, (key, count, context, total, kinds) in enumerate(self.tables):
            g = gram % ALPHABET ** (k + 1)
            n, t = self._get(context, total, g // ALPHABET), self._get(context, kinds, g // ALPHABET)
            p = np.where(n > 0, (self._get(key, count, g) + t * p) / np.maximum(n + t, 1), p)
        return np.log(p)


def _chain(gram: np.ndarray, n: np.ndarray, low: Chain | None = None) -> Chain:
    return Chain(gram[n > 0], n[n > 0].astype(float), low)


def _ratios(lows):
    """The difference of the models' logarithms for each string, from rows sorted by context."""

    def told(t: pa.Table) -> pa.RecordBatch:
        gram, good, bad = (t.column(c).to_numpy() for c in ("gram", "good", "bad"))
        ratio = _chain(gram, good, lows.value[0]).logs(gram) - _chain(gram, bad, lows.value[1]).logs(gram)
        return pa.RecordBatch.from_arrays([pa.array(gram), pa.array(ratio)], names=["gram", "ratio"])

    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= HELD:
                t = pa.Table.from_batches(held)
                context = t.column("context").to_numpy()
                whole = int(np.searchsorted(context, context[-1]))  # the last context may go on in the next batch
                if whole:
                    yield told(t.slice(0, whole))
                held = t.slice(whole).to_batches()
        if held and (t := pa.Table.from_batches(held)):
            yield told(t)

    return run


def scored(rows: DataFrame) -> tuple[DataFrame, bool]:
    """(key, score) of every distinct URL of rows with key, url, good and bad - whether it counts for a model -, and
    whether there is a model of each kind."""
    spark = rows.sparkSession
    sums = [F.sum("good").alias("good"), F.sum("bad").alias("bad")]
    grams = cut(rows.select("url", "good", "bad").mapInArrow(_count, "gram long, good long, bad long").groupBy("gram").agg(*sums))
    few = grams.where("good > 0 or bad > 0").groupBy((F.col("gram") % ALPHABET**LOW).alias("gram")).agg(*sums).toArrow()
    gram, good, bad = (few.column(c).to_numpy() for c in ("gram", "good", "bad"))
    if not good.sum() or not bad.sum():
        return spark.createDataFrame([], "key long, score double"), False
    lows = spark.sparkContext.broadcast((_chain(gram, good), _chain(gram, bad)))
    context = F.shiftright("gram", 8).bitwiseAND(ALPHABET**LOW - 1).cast("int").alias("context")
    ratios = grams.select("*", context).repartition("context").sortWithinPartitions("context").mapInArrow(_ratios(lows), "gram long, ratio double")
    places = rows.select("key", "url").distinct().mapInArrow(_places, "key long, gram long")
    return cut(places.join(ratios, "gram").groupBy("key").agg(F.avg("ratio").alias("score"))), True


def url_filter(pages: DataFrame, rules: list[tuple[str, str]], id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """id, host, path, rule, verdict, score and threshold of every page.

    rules are pairs of allow or block and a host with the path's start, like ("block", "net/es/"). A rule fits its host
    and all subdomains if the path starts with the rule's; the longest wins. Where none fits the verdict is `allow` if
    the score is at least the threshold - the one that, on URLs set aside by hash, gives the best mean of the shares of
    accepted and of rejected that are told right. If the rules accept or reject no URL there is nothing to compare and
    the verdict is `allow`, with score and threshold null.

    The models read the whole URL. Null URLs, and those without ://, have an empty host and path and no rule; null and empty
    ones have a score of 0.
    Repeated rows are judged one by one, and each counts in the models. An empty table gives no rows; other columns
    are not looked at.
    """
    host, path = parsed(F.col(url_column).cast("string"))
    rows = pages.select(F.col(id_column).alias("id"), host.alias("host"), path.alias("path"), F.coalesce(F.col(url_column).cast("string"), F.lit("")).alias("url"))
    rule, verdict = ruled(rules, F.col("host"), F.col("path"))
    rows = rows.withColumns({"rule": rule, "said": verdict})
    rows = rows.withColumn("key", F.xxhash64("url"))
    aside, allowed = F.pmod("key", F.lit(FOLDS)) == 0, F.col("said") == "allow"
    counts = F.col("said").isNotNull() & ~aside
    scores, both = scored(rows.select("key", "url", F.coalesce(counts & allowed, F.lit(False)).alias("good"), F.coalesce(counts & ~allowed, F.lit(False)).alias("bad")).withColumns({c: F.col(c).cast("long") for c in ("good", "bad")}))
    score, threshold = F.lit(None).cast("double"), None
    if both:
        rows = rows.join(scores, "key", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
        known = rows.where(aside & F.col("said").isNotNull()).select(allowed.alias("good"), "score")
        # Scores are logarithms of ratios; bins of equal width between -5 and 5 hold them all but for the ends.
        bins = known.groupBy(F.floor((F.greatest(F.least("score", F.lit(4.9999)), F.lit(-5.0)) + 5) * (BINS / 10)).cast("int").alias("bin")).agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")).toArrow()
        good, bad = np.zeros(BINS + 1), np.zeros(BINS + 1)
        good[bins.column("bin").to_numpy()], bad[bins.column("bin").to_numpy()] = bins.column("good").to_numpy(), bins.column("bad").to_numpy()
        right = good[::-1].cumsum()[::-1] / max(good.sum(), 1) + (bad.cumsum() - bad) / max(bad.sum(), 1)
        best = np.flatnonzero(right >= right.max() - 1e-12)
        threshold = float(best[len(best) // 2] / (BINS / 10) - 5)
        score = F.col("score")
    told = F.when(F.col("said").isNotNull(), F.col("said"))
    told = told.otherwise("allow") if threshold is None else told.when(F.col("score") >= threshold, "allow").otherwise("block")
    return rows.select(F.col("id").alias(id_column), "host", "path", "rule", told.alias("verdict"), score.alias("score"), F.lit(threshold).cast("double").alias("threshold"))
