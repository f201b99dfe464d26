"""Operators on streams of answer tokens: prose out of unfinished JSON, sentence gate, rate watchdog.

Each has a plain state machine, which a stateful streaming query runs per response and which batch queries share.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


class Prose:
    """Emits one string field of the root object as it arrives, however the text is cut."""

    def __init__(self, field: str = "prosa", state: tuple | None = None):
        self.field = field
        (self.depth, self.quoted, self.escape, self.digits, self.high, self.word, self.key, self.after_colon, self.live) = state or (0, False, False, None, 0, "", "", False, False)

    def state(self) -> tuple:
        return (self.depth, self.quoted, self.escape, self.digits, self.high, self.word, self.key, self.after_colon, self.live)

    def _char(self, c: str, out: list[str]) -> None:
        if self.live:
            out.append(c)
        elif self.depth == 1:
            self.word += c

    def feed(self, text: str) -> str:
        out: list[str] = []
        for c in text:
            if self.quoted:
                self._inside(c, out)
            elif c == '"':
                self.quoted, self.word = True, ""
                self.live = self.depth == 1 and self.after_colon and self.key == self.field
            elif c in "{[":
                self.depth += 1
                self.after_colon = False
            elif c in "}]":
                self.depth -= 1
                self.after_colon = False
            elif c == ":" and self.depth == 1:
                self.key, self.after_colon = self.word, True
            elif c == "," and self.depth == 1:
                self.key, self.after_colon = "", False
        return "".join(out)

    def _inside(self, c: str, out: list[str]) -> None:
        if self.digits is not None:
            self.digits += c
            if len(self.digits) == 4:
                code, self.digits = int(self.digits, 16), None
                if 0xD800 <= code < 0xDC00:
                    self.high = code
                elif 0xDC00 <= code < 0xE000 and self.high:
                    self._char(chr(0x10000 + ((self.high - 0xD800) << 10) + code - 0xDC00), out)
                    self.high = 0
                else:
                    self._char(chr(code) if not 0xD800 <= code < 0xE000 else "�", out)
        elif self.escape:
            self.escape = False
            if c == "u":
                self.digits = ""
            else:
                self._char(ESCAPES.get(c, c), out)
        elif c == "\\":
            self.escape = True
        elif c == '"':
            self.quoted = self.live = False
        else:
            self._char(c, out)


class EarlyArray:
    """Gives out the array of a root field as soon as its closing bracket has come, however the text is cut."""

    def __init__(self, field: str = "afirmaciones", state: tuple | None = None):
        self.field = field
        (self.depth, self.quoted, self.escape, self.word, self.key, self.kept, self.done) = state or (0, False, False, "", "", "", False)

    def state(self) -> tuple:
        return (self.depth, self.quoted, self.escape, self.word, self.key, self.kept, self.done)

    def feed(self, text: str) -> str | None:
        for c in text:
            if self.done:
                return None
            if self.kept:
                self.kept += c
            if self.quoted:
                if self.escape:
                    self.escape = False
                elif c == "\\":
                    self.escape = True
                elif c == '"':
                    self.quoted = False
                elif self.depth == 1:
                    self.word += c
            elif c == '"':
                self.quoted, self.word = True, ""
            elif c == ":" and self.depth == 1:
                self.key = self.word
            elif c in "{[":
                self.depth += 1
                if c == "[" and self.depth == 2 and self.key == self.field and not self.kept:
                    self.kept = c
            elif c in "}]":
                self.depth -= 1
                if self.depth == 1 and self.kept:
                    out, self.kept, self.done = self.kept, "", True
                    return out
        return None


def early_array(text: str, field: str) -> str | None:
    """The array of a root field once its closing bracket is there, else null."""
    return EarlyArray(field).feed(text)


class Gate:
    """Buffers until a sentence ends and marks it; nothing is ever lost."""

    def __init__(self, buffer: str = ""):
        self.buffer = buffer

    def feed(self, text: str) -> list[str]:
        self.buffer += text
        out, at = [], 0
        for i, c in enumerate(self.buffer):
            if c in ".!?\n":
                out.append(self.buffer[at : i + 1])
                at = i + 1
        self.buffer = self.buffer[at:]
        return out

    def close(self) -> list[str]:
        out, self.buffer = [self.buffer] if self.buffer else [], ""
        return out


# Fixed values of the watchdog: window in seconds, tokens a second at least, tokens of grace.
WINDOW, LEAST_RATE, GRACE = 2.0, 35.0, 8


def rates(seconds: list[float], window: float = WINDOW) -> list[float | None]:
    """Tokens a second over the trailing window at each token; null before the first whole window has passed."""
    out, lo = [], 0
    for i, t in enumerate(seconds):
        while seconds[lo] < t - window:
            lo += 1
        out.append((i - lo + 1) / window if t - seconds[0] >= window else None)
    return out


def cut_at(seconds: list[float], least: float = LEAST_RATE, grace: int = GRACE, window: float = WINDOW) -> int | None:
    """The token at which a stream is cut for being slow, or null."""
    return next((i for i, r in enumerate(rates(seconds, window)) if i >= grace and r is not None and r < least), None)


def _step(begin, feed, close, keep, idle_ms: int | None):
    """A stateful step over a response's token rows in order. A row with a null text ends the response, and so does
    silence of idle_ms: what waits is then given out and the state is dropped, so that states don't pile up."""

    def step(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        it = begin(state.get if state.exists else None)
        ended, out = state.hasTimedOut, []
        if not ended:
            rows = pd.concat(list(pdfs)).sort_values("seq")
            ended = bool(rows["text"].isna().any())
            out = feed(it, "".join(rows["text"].dropna()))
        if ended:
            out = out + close(it)
            if state.exists:
                state.remove()
        else:
            state.update(keep(it))
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
        if out:
            yield pd.DataFrame({"response_id": [key[0]] * len(out), "out": out})

    return step


def _timeout(idle_ms: int | None) -> str:
    """Silence is looked for in batches without data, which never end: a query that is to stop by itself has no limit."""
    return GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout


def prose_stream(tokens: DataFrame, field: str = "prosa", idle_ms: int | None = None) -> DataFrame:
    """Streaming: (response_id, prose) as (response_id, seq, text) rows arrive; each micro-batch's rows are taken in order.

    A null text ends a response, or silence of idle_ms if that is given."""
    step = _step(lambda kept: Prose(field, tuple(kept[i] for i in range(9)) if kept else None), lambda p, text: [x for x in [p.feed(text)] if x], lambda p: [], lambda p: p.state(), idle_ms)
    kept = "depth int, quoted boolean, escape boolean, digits string, high int, word string, key string, after_colon boolean, live boolean"
    out = tokens.groupBy("response_id").applyInPandasWithState(step, "response_id long, out string", kept, "append", _timeout(idle_ms))
    return out.withColumnRenamed("out", "prose")


def gate_stream(tokens: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Streaming: whole sentences out of token rows; the tail waits in the state until a sentence ends or the response does -
    with a null text, or after silence of idle_ms if that is given."""
    step = _step(lambda kept: Gate(kept[0] if kept else ""), lambda g, text: g.feed(text), lambda g: g.close(), lambda g: (g.buffer,), idle_ms)
    out = tokens.groupBy("response_id").applyInPandasWithState(step, "response_id long, out string", "buffer string", "append", _timeout(idle_ms))
    return out.withColumnRenamed("out", "sentence")


def claims_stream(tokens: DataFrame, field: str = "afirmaciones", idle_ms: int | None = None) -> DataFrame:
    """Streaming: (response_id, claims), the array of claims as JSON text, in the micro-batch in which its bracket closes -
    while the prose behind it is still being written. A response whose array never closes has no row."""
    step = _step(lambda kept: EarlyArray(field, tuple(kept[i] for i in range(7)) if kept else None), lambda p, text: [x for x in [p.feed(text)] if x], lambda p: [], lambda p: p.state(), idle_ms)
    kept = "depth int, quoted boolean, escape boolean, word string, key string, kept string, done boolean"
    out = tokens.groupBy("response_id").applyInPandasWithState(step, "response_id long, out string", kept, "append", _timeout(idle_ms))
    return out.withColumnRenamed("out", "claims")


def rate_stream(tokens: DataFrame, every: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """Streaming: tokens per response and fixed window, final once the watermark has passed. `watch.rate_watch` has the exact
    trailing rate."""
    return tokens.withWatermark("ts", late).groupBy("response_id", F.window("ts", every)).agg(F.count("*").alias("n")).select("response_id", F.col("window.start").alias("start"), "n")


def gated_batch(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """The batch twin of the gate: sentences with their place."""
    pattern = r"([^.!?\n]*[.!?\n]|[^.!?\n]+$)"
    return df.select(id_column, F.posexplode(F.regexp_extract_all(text_column, F.lit(pattern), 1)).alias("n", "sentence"))
