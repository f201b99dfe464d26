"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear (logistic) models. Each reads the words of a text and the
probabilities of the categories before it; in training those probabilities are out-of-fold, so that a later model learns from
what it will see and not from what an earlier one has memorised.

The models are fitted on the driver from a sample of the labelled rows: the SAMPLE rows whose ids have the smallest hashes, a fixed
bound. Every document is scored, whole, by one pass that shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K

SAMPLE, FEATURES, FOLDS = 12_000, 256, 5
#: A word is a feature if its share among positives would come by chance with a probability of e ** -LEAST_NATS at most.
LEAST_NATS = 7.5


def _distinct_words(column: pa.Array, limit: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for part in K.words(column, K.ALNUM, True, limit):
        yield part.lo, part.hi, part.rows(), part.hash


@K.tidy
def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bags = []
        for lo, hi, row, h in _distinct_words(batch.column("text")):
            at = np.searchsorted(row, np.arange(hi - lo + 1))
            bags += [np.unique(h[a:b]).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("said"), pa.array(bags, pa.binary())], names=["id", "said", "bag"])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights and intercept of a ridge logistic regression, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    keep[-1] = 1e-6
    for _ in range(steps):
        p = _sigmoid(x @ w)
        slope = x.T @ (p - y) + keep * w
        curve = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(keep)
        move = np.linalg.solve(curve, slope)
        w -= move
        if np.abs(move).max() < 1e-6:
            break
    return w


class Chain:
    """Words that tell the categories apart, and one model a category."""

    def __init__(self, bags: list[np.ndarray], y: np.ndarray, fold: np.ndarray, features: int = FEATURES):
        n, categories = y.shape
        word, df = np.unique(np.concatenate([np.zeros(0, np.uint64), *bags]), return_counts=True)
        best = np.zeros(len(word))
        for c in range(categories):
            # Chernoff's bound on a word's number of positive texts, in nats; rare words, which would only memorise
            # single labels, wrong ones among them, cannot reach much.
            mine, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *(b for b, one in zip(bags, y[:, c], strict=True) if one)]), return_counts=True)
            seen, share = np.zeros(len(word)), np.clip(y[:, c].mean(), 1e-9, 1 - 1e-9)
            seen[np.searchsorted(word, mine)] = times
            rate = seen / np.maximum(df, 1)
            with np.errstate(divide="ignore", invalid="ignore"):
                nats = df * (np.nan_to_num(rate * np.log(rate / share)) + np.nan_to_num((1 - rate) * np.log((1 - rate) / (1 - share))))
            best = np.maximum(best, nats)
        order = np.argsort(-best, kind="stable")[:features]
        self.words = np.sort(word[order[best[order] >= LEAST_NATS]])
        x = np.zeros((n, len(self.words)), np.float32)
        for i, bag in enumerate(bags):
            x[i] = np.isin(self.words, bag, assume_unique=True)
        self.models, earlier = [], np.zeros((n, 0))
        for c in range(categories):
            here = np.hstack([x, earlier])
            out = np.zeros(n)
            for f in range(FOLDS):
                out[fold == f] = self._apply(logistic(here[fold != f], y[fold != f, c]), here[fold == f])
            self.models.append(logistic(here, y[:, c]))
            earlier = np.hstack([earlier, out[:, None]])
        self.out_of_fold = earlier

    @staticmethod
    def _apply(w: np.ndarray, x: np.ndarray) -> np.ndarray:
        return _sigmoid(x @ w[:-1] + w[-1])

    def predict(self, rows: int, row: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Probabilities of rows given as (row, word) pairs."""
        out = np.zeros((rows, 0))
        at = np.minimum(np.searchsorted(self.words, h), max(len(self.words) - 1, 0))
        hit = self.words[at] == h if len(self.words) else np.zeros(len(h), bool)
        x = np.zeros((rows, len(self.words)), np.float32)
        x[row[hit], at[hit]] = 1
        for w in self.models:
            out = np.hstack([out, self._apply(w, np.hstack([x, out]))[:, None]])
        return out


def _score(chain, names: list[str]):
    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Chain = chain.value
        for batch in batches:
            for lo, hi, row, h in _distinct_words(batch.column("__text")):
                p = model.predict(hi - lo, row, h)
                cols = {c: batch.column(c).slice(lo, hi - lo) for c in batch.schema.names if c != "__text"}
                yield pa.RecordBatch.from_arrays([*cols.values(), *(pa.array(p[:, i].copy()) for i in range(len(names)))], names=[*cols, *names])

    return run


def threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The probability at which out-of-fold predictions have the fewest errors; over 1 if refusing none has."""
    order = np.argsort(-p, kind="stable")
    gain = np.cumsum(2 * y[order] - 1)
    gain[np.append(np.diff(p[order]) == 0, False)] = 0  # only between different probabilities
    at = int(np.argmax(gain))
    if gain[at] <= 0:
        return 2.0
    if at + 1 == len(p):
        return 0.0
    odds = np.log(p[order][at : at + 2] / (1 - p[order][at : at + 2] + 1e-12) + 1e-12)
    return float(_sigmoid(odds.mean()))


def toxicity(
    documents: DataFrame,
    labels: DataFrame,
    categories: dict[str, Column],
    decide: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    sample: int = SAMPLE,
) -> DataFrame:
    """Every document's columns and p_<category> for each category, in the order of the chain, and is_toxic: whether
    p_<decide> reaches the threshold that had the fewest errors out of fold - none is if refusing none had.

    categories: names and conditions over the columns of `labels`. Labels that are null in any category are left out,
    and of an id labelled several times the smallest labels hold; a labelled id of several rows is learnt from one of them. Words are runs of digits, letters (A-Z lower-cased)
    and non-ASCII characters; null and empty texts have none and get what the models give for no word. Without a
    labelled text of each kind in `decide` nothing can be learnt: probabilities are 0 and nothing is toxic. Repeated
    rows are judged one by one; an empty table gives no rows; other columns are kept, or replaced if named like the new
    ones.
    """
    spark = documents.sparkSession
    names = list(categories)
    said = F.array(*(c.cast("double") for c in categories.values()))
    marked = labels.select(F.col(id_column).alias("id"), said.alias("said")).where(F.col("id").isNotNull() & ~F.exists("said", lambda x: x.isNull()))
    marked = marked.groupBy("id").agg(F.min("said").alias("said")).orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = documents.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    # At most `sample` rows of an id and a few numbers: a fixed bound, so they can be sent to all. Of an id that several rows
    # share one row counts, so that no more come back.
    bags = texts.join(F.broadcast(marked), "id").select("id", "said", "text").mapInArrow(_bags, f"id {documents.schema[id_column].dataType.simpleString()}, said array<double>, bag binary")
    rows = bags.groupBy("id").agg(F.min("said").alias("said"), F.min("bag").alias("bag")).toArrow().sort_by("id")
    y = np.array(rows.column("said").to_pylist(), float).reshape(-1, len(names))
    target = names.index(decide)
    kept = [c for c in documents.columns if c not in [f"p_{n}" for n in names] + ["is_toxic"]]
    if not len(y) or len(np.unique(y[:, target])) < 2:
        return documents.select(*kept, *(F.lit(0.0).alias(f"p_{n}") for n in names), F.lit(False).alias("is_toxic"))
    fold = np.array([int(i) * 2654435761 % 2**32 // 65536 % FOLDS for i in rows.column("id").to_pylist()])
    offsets, data = K.buffers(rows.column("bag"))
    chain = Chain([data[a:b].view(np.uint64) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], y, fold)
    limit = threshold(chain.out_of_fold[:, target], y[:, target])
    del rows, data
    K.release()
    sent = spark.sparkContext.broadcast(chain)
    inner = {c: f"c{i}" for i, c in enumerate(kept)}
    fields = ", ".join([*(f"{inner[c]} {documents.schema[c].dataType.simpleString()}" for c in kept), *(f"p{i} double" for i in range(len(names)))])
    scored = documents.select(*(F.col(c).alias(inner[c]) for c in kept), F.col(text_column).cast("string").alias("__text")).mapInArrow(_score(sent, [f"p{i}" for i in range(len(names))]), fields)
    return scored.select(*(F.col(inner[c]).alias(c) for c in kept), *(F.col(f"p{i}").alias(f"p_{n}") for i, n in enumerate(names)), (F.col(f"p{target}") >= limit).alias("is_toxic"))


def categories() -> dict[str, Column]:
    """The chain over a table with quality and toxic: poor text first, then toxic text, then what is both."""
    return {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1, "toxic_low_quality": (F.col("toxic") == 1) & (F.col("quality") == 0)}
