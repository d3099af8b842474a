"""Admission in event time: events wait until the watermark has passed them, so no split into batches changes a decision."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..operators.jobs import Limiter


class Admission(StatefulProcessor):
    """State of a key: events that the watermark has not passed (time, order) and the times of its last admitted events.

    A timer stands at the first waiting event. Where none waits it stands where the last admitted event stops to count, and what is
    known of the key is given up there.
    """

    def __init__(self, key: str, order: str, order_type: str, most: int, within: int):
        self.key, self.order, self.order_type, self.most, self.within = key, order, order_type, most, within

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"at long, ord {self.order_type}")
        self.seen = handle.getValueState("seen", "times array<long>")

    def _wake(self, micros: int) -> None:
        self.handle.registerTimer(-(-micros // 1000))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            timed = part[part["at"].notna()]
            if len(timed):
                self.waiting.appendList([(int(a), o) for a, o in zip(timed["at"], timed["ord"].tolist(), strict=True)])
                first = int(timed["at"].min()) if first is None else min(first, int(timed["at"].min()))
            lost = part[part["at"].isna()]
            if len(lost):
                yield self._rows(key, [(None, o, False) for o in lost["ord"].tolist()])
        if first is not None:
            self._wake(first)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        ready, rest = [], []
        for at, order in self.waiting.get():
            (ready if at <= now else rest).append((at, order))
        limiter = Limiter(self.most, self.within, tuple(self.seen.get()[0]) if self.seen.exists() else ())
        out = [(at, order, limiter.admit(at)) for at, order in sorted(ready)]
        if ready and rest:
            self.waiting.put(rest)
        elif ready:
            self.waiting.clear()
        if rest:
            self._wake(min(rest)[0])
        elif limiter.seen and limiter.seen[-1] + self.within > now:
            self._wake(limiter.seen[-1] + self.within)
        if limiter.seen and limiter.seen[-1] + self.within > now:
            self.seen.update((list(limiter.seen),))
        elif self.seen.exists():
            self.seen.clear()
        if out:
            yield self._rows(key, out)

    def _rows(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        at, order, admitted = zip(*rows, strict=True)
        return pd.DataFrame({self.key: [key[0]] * len(rows), "at": pd.array(at, dtype="Int64"), self.order: list(order), "admitted": list(admitted)})

    def close(self) -> None:
        pass


def admitted_in_event_time(events: DataFrame, *, key: str, at: str, order: str, most: int, within: int, delay: str) -> DataFrame:
    """(key, at, order, admitted) for each event of a stream, as operators.jobs.admitted gives for the whole table.

    at is a timestamp, within a number of microseconds, order a column that tells events of one time apart (not null). An event is
    judged once the watermark (the latest time less delay) has passed it, in the order of (at, order), so the result doesn't depend
    on how events are dealt to batches. Events that come after the watermark has passed their time are late and give no row; events
    without a time are turned away at once. What is held of a key are its waiting events and its last `most` admitted times, the
    latter until they no longer count. The session needs the RocksDB state store.
    """
    kinds = dict(events.dtypes)
    rows = events.withWatermark(at, delay).select(key, F.col(at).alias("__event_time"), F.unix_micros(F.col(at).cast("timestamp")).alias("at"), F.col(order).alias("ord"))
    judged = rows.groupBy(key).transformWithStateInPandas(
        Admission(key, order, kinds[order], most, within), f"{key} {kinds[key]}, at long, {order} {kinds[order]}, admitted boolean", "Append", "EventTime"
    )
    return judged.withColumn("at", F.timestamp_micros("at")).withColumnRenamed("at", at)
