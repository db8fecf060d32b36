"""Rate limiting as a stream: per key one window and the events the watermark has not passed."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql import types as T

from glyphlake.operators.ratelimit import EXPIRY_US


# Stateful workers need not find this module: it travels with the query.
register_pickle_by_value(sys.modules[__name__])


#: A window is cut into so many buckets; a bucket is no shorter than LEAST_BUCKET_MS.
BUCKETS_PER_WINDOW = 8
LEAST_BUCKET_MS = 1000
#: Events of a trigger that share an entry, if they are no more or of one bucket: every entry is three calls to the state store.
ENTRY_EVENTS = 1000


class _FixedWindow(StatefulProcessor):
    """Holds a key's events until the watermark has passed them, then judges them in (at, event_id) order.

    Events wait in entries named by their first bucket of time, each trigger's in entries of its own, so taking events in
    rewrites none. An entry is one bucket or ``ENTRY_EVENTS`` events of several; judging reads the entries whose first bucket is due and
    puts back what is not. A key has one timer: the end of its first bucket, or the clean-up of its window.
    """

    def __init__(self, limit: int, window_us: int, event: T.StructType, expiry_us: int):
        self.limit, self.window_us, self.event, self.expiry_us = limit, window_us, event, expiry_us
        self.bucket_ms = max(LEAST_BUCKET_MS, window_us // 1000 // BUCKETS_PER_WINDOW)

    def init(self, handle: StatefulProcessorHandle) -> None:
        def longs(*names: str) -> T.StructType:
            return T.StructType([T.StructField(n, T.LongType()) for n in names])

        self.handle = handle
        self.window = handle.getValueState("window", longs("count", "reset"))
        self.timer = handle.getValueState("timer", longs("at", "entries"))
        lists = T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in self.event.fields])
        self.waiting = handle.getMapState("waiting", longs("bucket", "entry"), lists)

    def _bucket(self, at: int) -> int:
        return at // 1000 // self.bucket_ms

    def _entries(self, at: list[int]) -> Iterator[slice]:
        """``at``, in order, cut between buckets."""
        start = 0
        for i in range(1, len(at)):
            if i - start >= ENTRY_EVENTS and self._bucket(at[i - 1]) < self._bucket(at[i]):
                yield slice(start, i)
                start = i
        yield slice(start, len(at))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at, ident = [], []
        for batch in rows:
            at.extend(batch["at"].tolist())
            ident.extend(batch["event_id"].tolist())
        if at:
            known = self.timer.get()
            wakes, entry = known if known else (-1, 0)
            order = sorted(range(len(at)), key=at.__getitem__)
            at, ident = [at[i] for i in order], [ident[i] for i in order]
            for part in self._entries(at):
                self.waiting.updateValue((self._bucket(at[part.start]), entry), (at[part], ident[part]))
            due = (self._bucket(at[0]) + 1) * self.bucket_ms
            # A timer that waits for clean-up, or for a later bucket, gives way to the earlier one.
            if wakes == -1 or wakes > due:
                if wakes != -1:
                    self.handle.deleteTimer(wakes)
                self.handle.registerTimer(due)
                wakes = due
            self.timer.update((wakes, entry + 1))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        known = self.timer.get()
        entries = known[1] if known else 0
        names = [tuple(name) for name in self.waiting.keys()]
        left = [bucket for bucket, _ in names if (bucket + 1) * self.bucket_ms > passed]
        events = []
        for name in sorted(name for name in names if (name[0] + 1) * self.bucket_ms <= passed):
            at, ident = self.waiting.getValue(name)
            due = sum((self._bucket(a) + 1) * self.bucket_ms <= passed for a in at)
            events.extend(zip(at[:due], ident[:due]))
            self.waiting.removeKey(name)
            if due < len(at):
                # Later entries of the trigger begin after all of this one, so the name is free.
                left.append(self._bucket(at[due]))
                self.waiting.updateValue((left[-1], name[1]), (at[due:], ident[due:]))
        window = self.window.get()
        count, reset = window if window else (0, None)
        allowed, remaining, resets = [], [], []
        events.sort(key=lambda e: (e[0], e[1] is not None, e[1]))
        for at, _ in events:
            if reset is None or reset < at:
                count, reset = 0, at + self.window_us
            passes = count < self.limit
            count += passes
            allowed.append(passes)
            remaining.append(self.limit - count if passes else 0)
            resets.append(reset)
        wakes = (min(left) + 1) * self.bucket_ms if left else -1 if reset is None else (reset + self.expiry_us) // 1000 + 1
        if wakes > passed:
            self.handle.registerTimer(wakes)
            self.timer.update((wakes, entries))
            if events:
                self.window.update((int(count), int(reset)))
        else:
            self.window.clear()
            self.timer.clear()
        for start in range(0, len(events), 10_000):
            part = slice(start, start + 10_000)
            yield pd.DataFrame(
                {
                    "key": [key[0]] * len(events[part]),
                    "at": [at for at, _ in events[part]],
                    "event_id": [ident for _, ident in events[part]],
                    "allowed": allowed[part],
                    "remaining": remaining[part],
                    "reset": resets[part],
                }
            )

    def close(self) -> None:
        pass


def rate_limit_stream(events: DataFrame, limit: int, window_us: int, delay: str = "5 minutes") -> DataFrame:
    """Adds ``allowed, remaining, reset`` to a stream of ``key, at, event_id`` rows.

    ``at`` is a BIGINT time in microseconds. A key's events wait until the watermark, ``delay`` behind
    the newest event, has passed them and are then judged in (at, event_id) order, whatever order,
    triggers or batches they came in; they wait for the end of their bucket, an eighth of a window and a second at least.
    Rows later than the watermark are dropped. A key is one state, so one key's events are judged one after another. Its state is dropped once the watermark has
    passed its window by the clean-up period.
    """
    event = T.StructType([T.StructField("at", T.LongType()), events.schema["event_id"]])
    schema = T.StructType(
        [
            events.schema["key"],
            T.StructField("at", T.LongType()),
            T.StructField("event_id", events.schema["event_id"].dataType),
            T.StructField("allowed", T.BooleanType()),
            T.StructField("remaining", T.LongType()),
            T.StructField("reset", T.LongType()),
        ]
    )
    return (
        events.select("key", "at", "event_id", F.timestamp_micros("at").alias("__ts"))
        .withWatermark("__ts", delay)
        .groupBy("key")
        .transformWithStateInPandas(
            statefulProcessor=_FixedWindow(limit, window_us, event, EXPIRY_US),
            outputStructType=schema,
            outputMode="append",
            timeMode="eventTime",
        )
    )
