"""Keyed state that expires: last values with a time to live, and circuit breakers that forget idle keys.

Both run on transformWithStateInPandas over the RocksDB state store. Expiry follows event time: a key's timer fires when
the watermark passes its end, and takes its state away, so that state holds live keys only. A row that comes after its
key's end, but before the timer, starts afresh as well. Rows later than the watermark are dropped by Spark and meet no
state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from alphaloom.operators.engines import Breaker

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ms(at: pd.Timestamp) -> int:
    return int(pd.Timestamp(at).value // 1_000_000)


class _Expiring(StatefulProcessor):
    """A value state per key, and a timer at its end; subclasses say what a row does to it.

    State rows begin with `ends`, the event time in milliseconds after which they count no more.
    """

    kept: str
    order: list[str]

    def __init__(self, ttl_ms: int) -> None:
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.kept)

    def fresh(self) -> tuple:
        raise NotImplementedError

    def step(self, key: tuple, row: tuple, state: tuple, known: bool) -> tuple[tuple, tuple]:
        """The state after a row (without its end), and the row to put out."""
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # each call of the state's handle is a round trip: a key's only timer stands at its end, so that none is asked for
        kept = self.state.get()
        held = before = tuple(kept) if kept is not None else None
        parts = list(rows)
        frame = parts[0] if len(parts) == 1 else pd.concat(parts)
        frame = frame.iloc[np.lexsort([frame[c].to_numpy() for c in reversed(self.order)])]
        out = []
        for row in frame.itertuples(index=False):
            at = _ms(row.ts)
            known = held is not None and at <= held[0]
            state, found = self.step(key, row, held[1:] if known else self.fresh(), known)
            held = (max(at + self.ttl, held[0] if known else 0), *state)
            out.append(found)
        self.state.update(held)
        if before is None or before[0] != held[0]:
            if before is not None:
                self.handle.deleteTimer(before[0])
            self.handle.registerTimer(held[0])
        yield pd.DataFrame(out, columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame(columns=self.columns)

    def close(self) -> None:
        pass


class LastValue(_Expiring):
    """For each row: whether its key was known (`hit`), the value it had, and how many hits in a row there were."""

    kept = "ends long, value double, hits int"
    order = ["ts", "event_id"]
    columns = ["user_id", "event_type", "event_id", "ts", "hit", "previous", "hits"]
    schema = "user_id long, event_type string, event_id long, ts timestamp, hit boolean, previous double, hits int"

    def fresh(self) -> tuple:
        return None, 0

    def step(self, key, row, state, known):
        hits = state[1] + 1 if known else 0
        value = None if pd.isna(row.value) else float(row.value)
        return (value, hits), (key[0], key[1], row.event_id, row.ts, known, state[0], hits)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        self.state.update((_ms(row.ts) + self.ttl, None if pd.isna(row.value) else float(row.value), 0))
        self.handle.registerTimer(_ms(row.ts) + self.ttl)


class Breakers(_Expiring):
    """The state of a circuit breaker after each row; a key that was idle for longer than its time starts anew."""

    kept = "ends long, state string, streak int, peak double, opened double, equity double"
    order = ["ts", "event_id"]
    columns = ["user_id", "ts", "state"]
    schema = "user_id long, ts timestamp, state string"

    def fresh(self) -> tuple:
        return "closed", 0, 0.0, 0.0, 1000.0

    def step(self, key, row, state, known):
        b = Breaker()
        b.state, b.streak, b.peak, b.opened, equity = state
        pnl = 0.0 if pd.isna(row.value) else float(row.value) - 50.0
        equity += pnl
        found = b.update(pnl, equity, pd.Timestamp(row.ts).timestamp())
        return (b.state, b.streak, float(b.peak), float(b.opened), float(equity)), (key[0], row.ts, found)


def _run(events: DataFrame, keys: list[str], processor: _Expiring, late: str, initial: DataFrame | None) -> DataFrame:
    spark = events.sparkSession
    spark.conf.set(STORE, ROCKSDB)  # the store of all of this session's stateful streams, as this operator needs it
    start = None if initial is None else initial.groupBy(*keys)
    return events.withWatermark("ts", late).groupBy(*keys).transformWithStateInPandas(processor, processor.schema, "append", "eventTime", start)


def last_values(events: DataFrame, ttl: str = "2 days", late: str = "1 day", initial: DataFrame | None = None) -> DataFrame:
    """user_id, event_type, event_id, ts, hit, previous, hits: a row for each event (event_id, ts, user_id, event_type,
    value) of a stream.

    A key (user_id, event_type) lives for ttl after its last row. initial: user_id, event_type, ts, value, a row for each
    key that is known before the stream begins.
    """
    return _run(events, ["user_id", "event_type"], LastValue(int(pd.Timedelta(ttl).total_seconds() * 1000)), late, initial)


def breakers(events: DataFrame, idle: str = "30 days", late: str = "1 day") -> DataFrame:
    """user_id, ts, state: a circuit breaker for each user over the values of its events."""
    return _run(events, ["user_id"], Breakers(int(pd.Timedelta(idle).total_seconds() * 1000)), late, None)
