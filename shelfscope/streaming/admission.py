"""The admission limiter on a stream: state for each key, in event time order within a batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.jobs import Limiter


def admitted_stream(events: DataFrame, *, key: str, at: str, most: int, within: int, idle_seconds: int | None = None) -> DataFrame:
    """(key, at, admitted) for each event of a stream; `at` is a whole number of the unit of `within`. Events without a time are
    turned away.

    The state of a key is the times of its last admitted events, `most` at most; with idle_seconds it is given up once nothing has
    come for so long, which should be no less than `within`. A key's events come in pieces, each of which is taken in the order
    of its times and judged after the piece before, so however many events a key has, one piece of them is held.
    """

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        limiter = Limiter(most, within, tuple(state.get[0]) if state.exists else ())
        for rows in batches:
            rows = rows.sort_values(at, kind="stable")
            yield pd.DataFrame({key: group[0], at: rows[at], "admitted": [bool(pd.notna(x) and limiter.admit(int(x))) for x in rows[at]]})
        state.update((list(limiter.seen),))
        if idle_seconds is not None:
            state.setTimeoutDuration(1000 * idle_seconds)

    kinds = dict(events.dtypes)
    timeout = GroupStateTimeout.NoTimeout if idle_seconds is None else GroupStateTimeout.ProcessingTimeTimeout
    return events.select(key, at).groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {at} {kinds[at]}, admitted boolean", "seen array<long>", "append", timeout)
