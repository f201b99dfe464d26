"""Token counts by whole tokens.

Most words of a text are a piece of the vocabulary as they stand. For which strings that piece is also all that the
merges leave - a piece that no order of merges reaches is none - is proved once, on the driver: each piece that can be a
whole pre-token is merged on its own, and the library has to give the same single id. Texts are then cut into pre-tokens
as in pieces.py; a proved one counts as one token without a look at its characters. Only the rest is merged, by the
library, each distinct one once as long as a task remembers it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .pieces import CHUNK, Pieces, pieces

#: Merged pre-tokens in each of a task's two memories - when the young one is full it takes the old one's place -, and
#: how long they may be: about 20 MB a memory.
KEEP, KEEP_CHARS = 150_000, 40
#: A long text is taken apart in stretches of about so many characters; between two plain words each is on its own.
STRETCH = 1 << 20
_BETWEEN = re.compile("(?<=[^ ▁\n]) (?=[^ ▁\n])")


def proved(p: Pieces) -> frozenset[str]:
    """The pre-tokens, without the space that leads them, that are one token by themselves; no more than the vocabulary has."""
    alone = [t[1:] for t in p.id if t[0] == "▁" and p.merge(t) == [t]]
    said = p.library.encode(alone, num_threads=1)
    return frozenset(a for a, ids in zip(alone, said, strict=True) if not a or ids == [p.id["▁" + a]])


def stretches(text: str, size: int = STRETCH) -> Iterator[str]:
    """A text cut at single spaces between words, which belong to the word behind them."""
    at = 0
    while len(text) - at > size and (m := _BETWEEN.search(text, at + size)):
        yield text[at : m.start()]
        at = m.end()
    yield text[at:] if at else text


class Costs:
    """What pre-tokens count: the proved ones one, others as many as merging leaves."""

    def __init__(self, p: Pieces, whole: frozenset[str]):
        self.p, self.whole = p, whole
        self.old: dict[str, int] = {}
        self.known = dict.fromkeys(whole, 1)

    def learn(self, parts: set[str]) -> list[str]:
        """Makes all parts known; those that had to be merged."""
        if len(self.known) > KEEP + len(self.whole):
            self.old, self.known = self.known, dict.fromkeys(self.whole, 1)
        new = []
        for x in parts.difference(self.known):
            if (n := self.old.get(x)) is None:
                new.append(x)
            else:
                self.known[x] = n
        for x, ids in zip(new, self.p.library.encode(new, num_threads=1), strict=True):
            self.known[x] = len(ids) - (x[:1] == "\n") if x else 1  # the library puts a space before it that isn't there
        return new

    def count(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each text, and those of them that were counted as whole pre-tokens."""
        tokens, direct = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        held: list[tuple[int, list[str]]] = []
        size = 0

        def settle() -> None:
            new = self.learn(set().union(*(parts for _, parts in held)))
            for i, parts in held:
                tokens[i] += sum(map(self.known.__getitem__, parts))
                direct[i] += sum(map(self.whole.__contains__, parts))
            for x in new:
                if len(x) > KEEP_CHARS:
                    del self.known[x]
            held.clear()

        for i, text in enumerate(texts):
            for stretch in stretches(text):
                held.append((i, self.p.parts(stretch)))
                size += len(stretch)
                if size > STRETCH:
                    settle()
                    size = 0
        settle()
        return tokens, direct


def _run(model: str, whole):
    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs = Costs(pieces(model), whole.value)
        for batch in batches:
            offsets = K.buffers(batch.column("__text"))[0]
            for lo, hi in K.row_chunks(offsets, CHUNK):
                texts = [t or "" for t in batch.column("__text").slice(lo, hi - lo).to_pylist()]
                n, direct = costs.count(texts)
                differs = np.zeros(len(texts), np.int32)
                said = len(costs.p.library.encode(texts[0]))  # a whole text of each chunk is checked
                if said != n[0]:
                    n[0], differs[0] = said, 1
                cols = [batch.column("__id").slice(lo, hi - lo), pa.array(np.diff(offsets[lo : hi + 1])), pa.array(n), pa.array(direct), pa.array(differs)]
                yield pa.RecordBatch.from_arrays(cols, names=["__id", "n_bytes", "n_tokens", "n_whole", "n_differ"])

    return run


def token_counts(documents: DataFrame, model: str, limit: int = 4096, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Tokens of every whole text: id, n_bytes (UTF-8), n_tokens as the sentencepiece library counts them without begin and
    end ids, over_limit (more than `limit`), n_whole (tokens counted as whole pre-tokens) and n_differ (1 where a text that was
    checked, one of each chunk, has another number as a whole, which was taken then; else 0).

    Null and empty texts have no tokens. Repeated rows are counted one by one, also under one id or none; very long texts
    whole, in stretches. The names of special symbols inside a text are ordinary text, as is the library's default. An
    empty table gives no rows. Other columns are not looked at. `model` is a file that every executor can open; what is
    sent to the executors is at most its vocabulary.
    """
    whole = documents.sparkSession.sparkContext.broadcast(proved(pieces(model)))
    docs = documents.select(F.col(id_column).alias("__id"), F.col(text_column).cast("string").alias("__text"))
    kind = documents.schema[id_column].dataType.simpleString()
    out = docs.mapInArrow(_run(model, whole), f"__id {kind}, n_bytes bigint, n_tokens bigint, n_whole bigint, n_differ int")
    return out.select(F.col("__id").alias(id_column), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "n_whole", "n_differ")
