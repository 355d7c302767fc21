"""Stateful jobs with event-time timers: admission in order, inactivity, expiry.

State is kept per key and goes as soon as nothing depends on it, so it is
bounded by the keys that are live, not by those ever seen.  Everything is
driven by the watermark of the events; no clock is read.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate, groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from reelweave import fixed_values as fv

STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


#: Keys and rows pass through state as JSON text, so that nulls and wide numbers come back as they were.
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def _packed(columns: list[str]) -> Column:
    return F.to_json(F.struct(*columns), _JSON)


def _unpacked(stream: DataFrame, column: str, columns: list[str]) -> Column:
    return F.from_json(column, StructType([stream.schema[c] for c in columns]), _JSON)


def _stateful(stream: DataFrame, key: list[str], carry: list[str], ts: str, late: str, processor: StatefulProcessor, out: str, **more: Column) -> DataFrame:
    """``out`` columns of the processor, and key and carried columns unpacked; rows without time can't be placed and are left out."""
    stream.sparkSession.conf.set(*STATE_STORE)  # timers and state variables need it
    rows = stream.filter(F.col(ts).isNotNull()).select(
        _packed(key).alias("key_json"), _packed(carry).alias("row_json"), ts, F.unix_micros(ts).alias("at_us"), *[c.alias(n) for n, c in more.items()])
    found = rows.withWatermark(ts, late).groupBy("key_json").transformWithStateInPandas(processor, f"key_json string, row_json string, {out}", "Append", "EventTime")
    names = [f.name for f in found.schema][2:]
    opened = found.select(_unpacked(stream, "key_json", key).alias("k"), _unpacked(stream, "row_json", carry).alias("r"), *names)
    return opened.select("k.*", "r.*", *names)


class _Admission(StatefulProcessor):
    """Events wait in slots of time; the slots that the watermark has passed are decided in order, all at one timer.

    A key has one timer, however many slots wait.  What is left waiting is
    written again each time, so the next timer stands where a quarter of it is
    due.  Slots are read in runs of about ``CHUNK`` events.
    """

    CHUNK = 100_000

    def __init__(self, n: int, window_us: int, slot_ms: int):
        self.n, self.window, self.slot = n, window_us, slot_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us bigint, event string")
        self.admitted = handle.getListState("admitted", "us bigint")

    def _end(self, us: int) -> int:
        return (us // 1000 // self.slot + 1) * self.slot

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        timed = self.waiting.exists()
        for batch in rows:
            times = list(map(int, batch["at_us"]))
            self.waiting.appendList(list(zip(times, batch["row_json"], strict=True)))
            first = min(times, default=None) if first is None else min([first, *times])
        if first is not None and not timed:
            self.handle.registerTimer(self._end(first))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        sizes = Counter(self._end(us) for us, _ in self.waiting.get())
        ends = sorted(sizes)
        due = [end for end in ends if end <= now]
        had = kept = [us for us, in self.admitted.get()]
        before = accumulate((sizes[end] for end in due), initial=0)
        for _, run in groupby(zip(due, before), key=lambda e: e[1] // self.CHUNK):
            run = [end for end, _ in run]
            events = {(us, event) for us, event in self.waiting.get() if run[0] <= self._end(us) <= run[-1]}
            out = []
            for us, event in sorted(events, key=lambda e: (e[0], [(v is not None, v) for v in json.loads(e[1]).values()])):
                kept = [t for t in kept if t > us - self.window]
                out.append((key[0], event, len(kept) < self.n))
                if out[-1][2]:
                    kept.append(us)
            yield pd.DataFrame(out, columns=["key_json", "row_json", "admitted"])
        later = [end for end in ends if end > now]
        if not later:
            self.waiting.clear()
        else:
            if len(later) < len(ends):
                self.waiting.put([e for e in self.waiting.get() if self._end(e[0]) > now])
            quarter = sum(sizes[end] for end in later) / 4
            self.handle.registerTimer(next(end for end, n in zip(later, accumulate(sizes[e] for e in later), strict=True) if n >= quarter))
        # times that no later event can meet go: those behind the watermark or the first slot that waits
        passed = min(now, later[0] - self.slot) if later else now
        kept = [t for t in kept if t > passed * 1000 - self.window]
        if kept:
            if kept != had:
                self.admitted.put([(t,) for t in kept])
            if not later:
                self.handle.registerTimer((max(kept) + self.window) // 1000 + 1)
        elif had:
            self.admitted.clear()


def stream_rate_limit(stream: DataFrame, key: str, ts: str, event_id: str, n: int = fv.RATE_LIMIT_EVENTS, seconds: int = fv.RATE_LIMIT_SECONDS, late: str = "1 hour") -> DataFrame:
    """``admitted`` per event: fewer than ``n`` admitted ones of its key in the ``seconds`` before it.

    Events may come in any order within ``late``; an event that comes again
    counts once.  They are decided by slots (a sixtieth of the window), some at a time.
    """
    processor = _Admission(n, seconds * 1_000_000, max(1000, seconds * 1000 // 60))
    return _stateful(stream, [key], [event_id], ts, late, processor, "admitted boolean")


class _Rearmed(StatefulProcessor):
    """The latest row of a key, and a timer that every newer row sets back.

    ``life_ms`` is how long a row lives, under 0 for ever; those are no state.
    Newer rows are emitted as they come, and once more as ``ended`` when their
    time is up.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "at_us bigint, row_json string, life_ms bigint")

    @staticmethod
    def _due(row: tuple) -> int:
        return row[0] // 1000 + row[2] + 1

    @staticmethod
    def _frames(key, row: tuple, ended: bool) -> Iterator[pd.DataFrame]:
        return iter([pd.DataFrame([(key[0], row[1], row[0], ended)], columns=["key_json", "row_json", "at_us", "ended"])])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = tuple(self.latest.get()) if self.latest.exists() else None
        best = old
        for batch in rows:
            new = max(zip(map(int, batch["at_us"]), batch["row_json"], map(int, batch["life_ms"]), strict=True))
            best = new if best is None else max(best, new)
        if best == old:
            return iter(())
        if old:
            self.handle.deleteTimer(self._due(old))
        if best[2] >= 0:
            self.latest.update(best)
            self.handle.registerTimer(self._due(best))
        else:
            self.latest.clear()
        return self._frames(key, best, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.latest.exists():
            return iter(())
        row = tuple(self.latest.get())
        self.latest.clear()
        return self._frames(key, row, True)


def _rearmed(stream: DataFrame, key: list[str], ts: str, life_ms: Column, late: str, carry: list[str]) -> DataFrame:
    out = _stateful(stream, key, carry, ts, late, _Rearmed(), "at_us bigint, ended boolean", life_ms=F.coalesce(life_ms, F.lit(-1)).cast("bigint"))
    return out.select(*key, *carry, F.timestamp_micros("at_us").alias(ts), "ended")


_DAY_MS = 86_400_000


def stream_inactivity(stream: DataFrame, key: str = "thread_hash", ts: str = "last_updated", status: str = "status", days: int = fv.WATCH_INACTIVE_DAYS, late: str = "1 day") -> DataFrame:
    """Changes of a watch list: every newer row as it comes, and ``archived`` rows once an active one was silent for ``days``.

    Only active rows are kept as state.  The last change of a key is what the
    batch job makes of its last row at the time of the watermark.
    """
    life = F.when(F.col(status) == "active", F.lit(days * _DAY_MS))
    out = _rearmed(stream, [key], ts, life, late, [status])
    return out.select(key, F.when(F.col("ended"), "archived").otherwise(F.col(status)).alias(status), ts)


#: How long rows of a table live after their time.
LIFE_MS = {"download_cache": 5 * _DAY_MS, "failed_threads": 7 * _DAY_MS, "link_cache": 30 * _DAY_MS, "locks": _DAY_MS}


def stream_expiry(stream: DataFrame, key: str, ts: str, table: str = "table_name", late: str = "1 hour") -> DataFrame:
    """(table, key, ts) of rows whose table's time to live has run out since they were last touched."""
    life = None
    for name, ms in LIFE_MS.items():
        life = F.when(F.col(table) == name, F.lit(ms)) if life is None else life.when(F.col(table) == name, F.lit(ms))
    return _rearmed(stream, [table, key], ts, life, late, []).filter("ended").drop("ended")
