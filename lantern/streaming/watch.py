"""The exact trailing rate of token streams: cut at the token at which a response became too slow.

Each response keeps the times of its last `window`, a count for the grace, its lowest rate, and tokens that the watermark
hasn't passed yet. These wait for a timer and are taken in order of time, so the outcome doesn't depend on how tokens fell
into micro-batches, nor on their order as long as none is later than the watermark allows. The state store must be RocksDB's
(`spark.sql.streaming.stateStore.providerClass`), as `lantern.session.session` sets it.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lantern.streaming.tokens import GRACE, LEAST_RATE, WINDOW

SECOND = 1_000_000
OUT = "response_id long, event string, seq long, tokens long, rate double, lowest double"
_STATE = "began long, total long, lowest double, cut long, recent array<bigint>, seqs array<bigint>, times array<bigint>"


class Watch:
    """One response's rate, token by token; times are whole microseconds."""

    def __init__(self, least: float, grace: int, window: int, kept: tuple | None = None):
        self.least, self.grace, self.window = least, grace, window
        self.began, self.total, self.lowest, self.cut, recent = kept or (None, 0, None, None, [])
        self.recent = deque(recent)

    def rate(self, now: int) -> float | None:
        """Tokens a second over the trailing window, which divides always; null, which is not 0, before one has passed."""
        if self.began is None or now - self.began < self.window:
            return None
        while self.recent and self.recent[0] < now - self.window:
            self.recent.popleft()
        return len(self.recent) * SECOND / self.window

    def feed(self, seq: int, now: int) -> float | None:
        """Takes a token; its rate if that is where the response is to be cut. What comes after a cut isn't looked at."""
        if self.cut is not None:
            return None
        self.began = now if self.began is None else self.began
        self.total += 1
        self.recent.append(now)
        if self.total <= self.grace or (r := self.rate(now)) is None:
            return None
        self.lowest = r if self.lowest is None else min(self.lowest, r)
        if r < self.least:
            self.cut = seq
            return r
        return None


class _Processor(StatefulProcessor):
    def __init__(self, least: float, grace: int, window: int, idle_ms: int):
        self.how, self.idle_ms = (least, grace, window), idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("watch", _STATE)

    def _load(self) -> tuple[Watch, list[tuple[int, int]]]:
        if not self.state.exists():
            return Watch(*self.how), []
        began, total, lowest, cut, recent, seqs, times = self.state.get()
        return Watch(*self.how, (began, total, lowest, cut, recent)), list(zip(times, seqs, strict=True))

    def _keep(self, w: Watch, waiting: list[tuple[int, int]]) -> None:
        self.state.update((w.began, w.total, w.lowest, w.cut, list(w.recent), [s for _, s in waiting], [t for t, _ in waiting]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        w, waiting = self._load()
        for pdf in rows:
            us = pdf["ts"].astype("datetime64[us]").astype("int64")
            waiting += zip(us.tolist(), pdf["seq"].tolist(), strict=True)
        waiting.sort()
        self._keep(w, waiting)
        self._wake(waiting)
        yield pd.DataFrame()

    def _wake(self, waiting: list[tuple[int, int]]) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(waiting[0][0] // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        w, waiting = self._load()
        passed = timerValues.getCurrentWatermarkInMs()
        out, now = [], 0
        while waiting and waiting[0][0] // 1000 < passed:
            now, seq = waiting.pop(0)
            if (r := w.feed(seq, now)) is not None:
                out.append((key[0], "cut", seq, w.total, r, w.lowest))
        if waiting:
            self._keep(w, waiting)
            self._wake(waiting)
        elif w.recent and (last := w.recent[-1]) // 1000 + self.idle_ms < passed or w.cut is not None and not now:
            out.append((key[0], "end", w.cut, w.total, None if w.cut is not None else w.rate(last), w.lowest))
            self.state.clear()
        else:
            self._keep(w, waiting)
            self.handle.registerTimer((now or w.recent[-1]) // 1000 + self.idle_ms + 1)
        yield pd.DataFrame(out, columns=["response_id", "event", "seq", "tokens", "rate", "lowest"]).astype({"seq": "Int64"}) if out else pd.DataFrame()

    def close(self) -> None:
        pass


def rate_watch(tokens: DataFrame, least: float = LEAST_RATE, grace: int = GRACE, window: float = WINDOW, late: str = "0 seconds", idle_ms: int = 60_000) -> DataFrame:
    """Streaming: (response_id, event, seq, tokens, rate, lowest) out of token rows (response_id, seq, ts).

    `cut` comes once, with the first token after the grace at which fewer than `least` tokens a second came in the trailing
    window; `end` after `idle_ms` of silence in event time, with the tokens looked at, the last rate and the lowest, and
    then the state goes. Tokens of the same microsecond go by seq. Rows that come later than `late` behind the newest are lost.
    """
    rows = tokens.select("response_id", "seq", "ts").withWatermark("ts", late)
    processor = _Processor(least, grace, int(window * SECOND), idle_ms)
    return rows.groupBy("response_id").transformWithStateInPandas(statefulProcessor=processor, outputStructType=OUT, outputMode="Append", timeMode="EventTime")
