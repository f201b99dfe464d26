"""SentencePiece encoding and decoding for merge-type vocabularies.

A text is cut before each run of spaces and each line end - no piece goes on with a space after another character or
holds a line end, which is checked when the model is read - and each part is encoded on its own: all adjacent pairs of symbols that form a
piece wait in an agenda ordered by score, then place; the best is merged and its new neighbours join the agenda.
Parts repeat often, so their ids are kept in a bounded memory for as long as a task runs. Everything a batch adds to that
memory is checked against the sentencepiece library, and so is one whole text of each batch. Where the two differ the
library's answer holds, as the contract names it, and the text is counted in n_differ.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

#: Parts in each of a task's two memories at most: when the young one is full it takes the old one's place, so parts
#: in use stay known. Longer parts than KEEP_CHARS are not kept. That is about 25 MB a memory.
KEEP, KEEP_CHARS = 110_000, 40
#: Bytes of text that are taken apart at once, but for a longer text.
CHUNK = 1 << 20
#: Parts of up to WIDE symbols are merged side by side, about BLOCK symbols at once.
WIDE, BLOCK = 64, 1 << 15
_NONE = np.int32(2**31 - 1)
_PART = re.compile("▁+[^▁\n]*|\n[^▁\n]*")


class Pairs:
    """The pairs of symbols that form a piece, as sorted arrays. Symbols are numbers: pieces by their ids, then the other
    characters that pieces hold, then one number for all other characters and one for no symbol. A character of one byte
    that is no piece has the id of its byte."""

    def __init__(self, text: list[str], ids: dict[str, int], rank: dict[str, float], of_byte: dict[int, int]):
        number = {chr(b): i for b, i in of_byte.items() if b < 0x80} | ids
        others = sorted({c for p in rank for c in p} - number.keys())
        number |= {c: len(text) + i for i, c in enumerate(others)}
        self.unknown, self.gone = len(text) + len(others), len(text) + len(others) + 1
        self.base = self.gone + 1
        place = {r: i for i, r in enumerate(sorted(set(rank.values())))}
        found = [(number[a] * self.base + number[b], place[r], ids[p]) for p, r in rank.items() for k in range(1, len(p)) if (a := p[:k]) in number and (b := p[k:]) in number]
        pairs = np.array(sorted(found), np.int64).reshape(-1, 3)
        if len(place) * WIDE >= _NONE:
            raise ValueError("the vocabulary is too large")
        self.pair = np.append(pairs[:, 0], np.iinfo(np.int64).max)
        self.score, self.piece = (np.append(x, last).astype(np.int32) for x, last in ((pairs[:, 1], _NONE), (pairs[:, 2], 0)))
        codes = {ord(c): i for c, i in number.items() if len(c) == 1}
        self.of_code = np.full(max(codes, default=0) + 2, self.unknown, np.int32)
        self.of_code[list(codes)] = list(codes.values())

    def single(self, text: str) -> np.ndarray:
        """The number of each character."""
        return self.of_code[np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), len(self.of_code) - 1)]

    def find(self, left: np.ndarray, right: np.ndarray, shape: int | tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Place of each pair in the order of scores, _NONE if it forms no piece; and the piece."""
        asked = left.astype(np.int64) * self.base + right
        at = np.searchsorted(self.pair, asked)
        return np.where(self.pair[at] == asked, self.score[at], _NONE).reshape(shape), self.piece[at].reshape(shape)


class Pieces:
    """A vocabulary read from a model file, with encoding and decoding."""

    def __init__(self, model: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        proto = sentencepiece_model_pb2.ModelProto()
        with open(model, "rb") as f:
            proto.ParseFromString(f.read())
        spec, trainer = proto.normalizer_spec, proto.trainer_spec
        if trainer.model_type != trainer.BPE or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not trainer.byte_fallback:
            raise ValueError("only merge-type models with byte fallback and plain normalization are supported")
        self.text = [p.piece for p in proto.pieces]
        self.byte = {i: int(p.piece[3:5], 16) for i, p in enumerate(proto.pieces) if p.type == p.BYTE}
        self.control = {i for i, p in enumerate(proto.pieces) if p.type in (p.CONTROL, p.UNKNOWN)}
        self.of_byte = {b: i for i, b in self.byte.items()}
        self.id = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == p.NORMAL}
        self.name = [str(i) for i in range(len(self.text))]
        self.rank = {p.piece: -p.score for p in proto.pieces if p.type == p.NORMAL and len(p.piece) > 1}
        if any(re.search("[^▁]▁|\n", p) for p in self.id):
            raise ValueError("a piece spans words; texts can't be cut at spaces")
        self.forget()

    @cached_property
    def pairs(self) -> Pairs:
        return Pairs(self.text, self.id, self.rank, self.of_byte)

    def forget(self) -> None:
        """Empties the memory of parts: ids joined by commas, with the decoded text where it isn't the part itself."""
        self.young: dict[str, str | tuple[str, str]] = {}
        self.old: dict[str, str | tuple[str, str]] = {}

    def merge(self, part: str) -> list[str]:
        """The symbols that are left of one part when no pair is left in the agenda."""
        symbol = list(part)
        n = len(symbol)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        find, push, pop = self.rank.get, heapq.heappush, heapq.heappop
        agenda = [(r, i, p) for i, p in enumerate(map(str.__add__, symbol, symbol[1:])) if (r := find(p)) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, i, piece = pop(agenda)
            j = after[i]
            left = symbol[i]
            if not left or j == n or left + symbol[j] != piece:
                continue  # one of the two has been merged meanwhile
            symbol[i], symbol[j] = piece, ""
            j = after[i] = after[j]
            if j < n:
                before[j] = i
                if (r := find(p := piece + symbol[j])) is not None:
                    push(agenda, (r, i, p))
            if (h := before[i]) >= 0 and (r := find(p := symbol[h] + piece)) is not None:
                push(agenda, (r, h, p))
        return [s for s in symbol if s]

    def merge_many(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Merges parts of up to WIDE symbols like `merge`. Of all symbols that are left: the number in `pairs`, and where it
        begins in its part; and how many symbols each part has."""
        t, n = self.pairs, len(parts)
        size = np.fromiter(map(len, parts), np.int64, n)
        wide = int(size.max())
        symbol = np.full((wide + 1, n), t.gone, np.int32)  # a row for each place, a column for each part
        symbol[K.expand(np.zeros(n, np.int64), size), np.repeat(np.arange(n), size)] = t.single("".join(parts))
        place = np.arange(wide + 1)[:, None]
        after, before = (np.repeat(x.astype(np.int16), n, 1) for x in (place + 1, place - 1))
        before[0] = wide
        agenda = np.full((wide + 1, n), _NONE, np.int32)
        piece = np.zeros((wide + 1, n), np.int32)
        score, piece[:-1] = t.find(symbol[:-1].ravel(), symbol[1:].ravel(), (wide, n))
        agenda[:-1] = np.where(score == _NONE, _NONE, score * WIDE + place[:-1])
        left, column = symbol.copy(), np.arange(n)
        while n:
            best = agenda.min(axis=0)
            live = np.flatnonzero(best != _NONE)
            if len(live) < 0.75 * n:  # parts whose agenda is empty are done
                left[:, column] = symbol
                column, best, n = column[live], best[live], len(live)
                symbol, after, before, agenda, piece = (x.take(live, axis=1) for x in (symbol, after, before, agenda, piece))
                live = np.arange(n)
            s, a, b, g, p = (x.reshape(-1) for x in (symbol, after, before, agenda, piece))
            at = (best[live] % WIDE).astype(np.int64)
            i = at * n + live
            j = a[i].astype(np.int64) * n + live
            end = a[j].astype(np.int64)
            k = end * n + live
            s[i] = new = p[i]
            s[j], g[j] = t.gone, _NONE
            a[i], b[k] = end, at
            first = b[i].astype(np.int64)
            h = first * n + live
            changed = np.concatenate([i, h])
            score, p[changed] = t.find(np.concatenate([new, s[h]]), np.concatenate([s[k], new]), 2 * len(live))
            g[changed] = np.where(score == _NONE, _NONE, score * WIDE + np.concatenate([at, first]))
        left = left.T
        stays = left != t.gone
        return left[stays], np.nonzero(stays)[1], stays.sum(axis=1)

    def numbers(self, symbols: list[str]) -> list[int]:
        """Ids of merged symbols; a symbol that is no piece becomes its bytes' ids."""
        out = []
        for s in symbols:
            i = self.id.get(s)
            out += [i] if i is not None else [self.of_byte[b] for b in s.encode()]
        return out

    def unmerge(self, ids: list[int]) -> str:
        """The text of ids, without the dummy prefix's removal; runs of byte pieces are read as UTF-8."""
        out, raw = [], bytearray()
        for i in ids:
            if i in self.byte:
                raw.append(self.byte[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if i not in self.control:
                out.append(self.text[i])
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out).replace("▁", " ")

    @staticmethod
    def parts(text: str) -> list[str]:
        """Cuts a text, with the dummy prefix. One space before each part is understood, but for those with a line end."""
        if not text:
            return []
        if "▁" not in text and "  " not in text and " \n" not in text and text[0] != " " and text[-1] != " ":
            return text.replace("\n", " \n").split(" ")  # the usual case
        return [p if p[0] == "\n" else p[1:] for p in _PART.findall("▁" + text.replace(" ", "▁"))]

    def told(self, part: str, symbols: list[str], theirs: list[int]) -> str | tuple[str, str]:
        """What is remembered of one part: ids joined by commas, with the decoded text where it isn't the part itself."""
        own, ids = part[:1] == "\n", self.numbers(symbols)
        if ids != (theirs[1:] if own else theirs) and part:
            self.differ.add(part)
        joined, text = ",".join(map(str, ids)), self.unmerge(ids)
        return joined if text == (part if own else " " + part) else (joined, text)

    def learn(self, parts: list[str]) -> dict[str, str | tuple[str, str]]:
        """Encodes new parts and checks each against the library."""
        out = {}
        usual = sorted((p for p in parts if 0 < len(p) < WIDE), key=len)
        for x in set(parts).difference(usual):
            out[x] = self.told(x, self.merge(x if x[:1] == "\n" else "▁" + x), self.library.encode(x))
        at = 0
        while at < len(usual):
            block = usual[at : at + BLOCK // (len(usual[at]) + 1)]
            block = block[: BLOCK // (len(block[-1]) + 1)]  # the last is the longest
            at += len(block)
            self.learn_block(block, out)
        return out

    def learn_block(self, block: list[str], out: dict[str, str | tuple[str, str]]) -> None:
        """Adds parts that are merged side by side; one by one only those with symbols that are no pieces, or that differ."""
        own = np.array([p[0] == "\n" for p in block])
        words = [p if p[0] == "\n" else "▁" + p for p in block]
        found, begins, sizes = self.merge_many(words)
        theirs = self.library.encode(block, num_threads=1)
        n = np.fromiter(map(len, theirs), np.int64, len(block))
        said = np.delete(np.fromiter(chain.from_iterable(theirs), np.int64, int(n.sum())), (np.cumsum(n) - n)[own])
        ends = np.cumsum(sizes)
        names = list(map(self.name.__getitem__, np.minimum(found, len(self.name) - 1).tolist()))
        lo = 0
        for p, hi in zip(block, ends.tolist(), strict=True):
            joined = ",".join(names[lo:hi])
            out[p] = (joined, " " + p.replace("▁", " ")) if "▁" in p else joined
            lo = hi
        if np.array_equal(n - own, sizes) and np.array_equal(said, found):
            return
        strange = np.logical_or.reduceat(found >= len(self.text), ends - sizes)  # some symbol is no piece
        for i in np.flatnonzero(strange).tolist():
            x, at = words[i], [*begins[ends[i] - sizes[i] : ends[i]].tolist(), len(words[i])]
            out[block[i]] = self.told(block[i], [x[a:b] for a, b in zip(at, at[1:], strict=False)], theirs[i])
        for i in np.flatnonzero(~strange).tolist():
            if found[ends[i] - sizes[i] : ends[i]].tolist() != theirs[i][int(own[i]) :]:
                self.differ.add(block[i])

    def encode(self, texts: list[str | None], check: bool = True) -> Iterator[tuple[str, int, str, bool]]:
        """For each text: ids joined by commas, their number, the decoded text, and whether the agenda and the library differed."""
        cut = [self.parts(t or "") for t in texts]
        young, old, need, new = self.young, self.old, {}, []
        self.differ: set[str] = set()
        for p in set().union(*cut):
            if (known := young.get(p)) is not None:
                need[p] = known
            elif (known := old.get(p)) is not None:
                need[p] = young[p] = known
            else:
                new.append(p)
        if new:
            added = self.learn(new)
            need |= added
            young.update((k, v) for k, v in added.items() if len(k) <= KEEP_CHARS and k not in self.differ)
            if len(young) > KEEP:
                self.young, self.old = {}, young
        odd = {p: v for p, v in need.items() if not isinstance(v, str)}
        need |= {p: v[0] for p, v in odd.items()}
        for n, (text, parts) in enumerate(zip(texts, cut, strict=True)):
            ids = ",".join([need[p] for p in parts])
            if odd and not odd.keys().isdisjoint(parts):
                decoded = "".join([odd[p][1] if p in odd else p if p[:1] == "\n" else " " + p for p in parts])[1:]
            else:
                decoded = "".join([p if p[:1] == "\n" else " " + p for p in parts])[1:] if text and text.find("\n") >= 0 else " ".join(parts)
            differs = not self.differ.isdisjoint(parts) if self.differ else False
            if text and (differs or (check and n == 0)):
                theirs = self.library.encode(text)
                said, back = ",".join(map(str, theirs)), self.library.decode(theirs)
                differs = (ids, decoded) != (said, back)
                ids, decoded = said, back
            yield ids, ids.count(",") + 1 if ids else 0, decoded, differs


_loaded: dict[str, Pieces] = {}


def pieces(model: str) -> Pieces:
    """The vocabulary, read once in a worker."""
    if model not in _loaded:
        _loaded[model] = Pieces(model)
    return _loaded[model]


def _run(model: str, ids: bool):
    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        try:
            for batch in batches:
                texts = batch.column("__text")
                for lo, hi in K.row_chunks(K.buffers(texts)[0], CHUNK):
                    rows = list(p.encode(texts.slice(lo, hi - lo).to_pylist()))
                    n = np.array([r[1] for r in rows], np.int64)
                    cols = [batch.column("__id").slice(lo, hi - lo), pa.array(n)]
                    names = ["__id", "n_tokens", "ids_sha256", "decoded_sha256", "n_differ"]
                    if ids:
                        flat = np.fromstring(",".join(r[0] for r in rows if r[0]), np.int32, sep=",")
                        at = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                        cols += [pa.ListArray.from_arrays(at, pa.array(flat)), pa.array([r[2] for r in rows], pa.string())]
                        names[2:4] = ["ids", "decoded"]
                    else:
                        cols += [pa.array([hashlib.sha256(r[k].encode()).hexdigest() for r in rows], pa.string()) for k in (0, 2)]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array([int(r[3]) for r in rows], pa.int32())], names=names)
        finally:  # workers are used again by other tasks
            p.forget()

    return run


def encode(documents: DataFrame, model: str, id_column: str = "doc_id", text_column: str = "text", digests: bool = False) -> DataFrame:
    """Ids and decoded text of every whole text: id, n_tokens, ids, decoded - or, as digests, the SHA-256 of the ids
    joined by commas and of the decoded text - and n_differ, 1 where the agenda and the library gave different ids and
    the library's were taken, else 0.

    No begin or end ids, no sampling; decoding gives what the library's decode(ids) gives. Null and empty texts have no
    ids and decode to an empty text. Repeated rows are encoded one by one, very long texts whole; an empty table
    gives no rows. Other columns are not looked at. `model` is a file that every executor can open.
    """
    docs = documents.select(F.col(id_column).alias("__id"), F.col(text_column).cast("string").alias("__text"))
    more = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    out = docs.mapInArrow(_run(model, not digests), f"__id {documents.schema[id_column].dataType.simpleString()}, n_tokens bigint, {more}, n_differ int")
    return out.withColumnRenamed("__id", id_column)
