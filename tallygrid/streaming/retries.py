"""Retry state of items while their attempts arrive, kept only as long as an item isn't settled."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallygrid.shipping import ship
from tallygrid.streaming.results import drain

#: What is known of an item that isn't settled, and the row that it leaves when it is.
STATE = "attempts long, last_error string, last_ms long"
SETTLED = "item_id long, attempts long, last_error string, done boolean, reason string"
STORE = "spark.sql.streaming.stateStore.providerClass"
ON_DISK = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RetryProcessor(StatefulProcessor):
    """One state value an item and one timer. An attempt that succeeds settles the item ('done'), as does the last one that is
    allowed ('attempts'), or no attempt for `timeout_ms` of event time ('timeout'). Its state goes with the row that is put
    out; attempts that come later begin anew."""

    def __init__(self, timeout_ms: int, max_attempts: int):
        self.timeout_ms, self.max_attempts = timeout_ms, max_attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("attempts", STATE)

    def _row(self, key: tuple, seen: tuple, done: bool, reason: str) -> Row:
        return Row(item_id=key[0], attempts=seen[0], last_error=seen[1], done=done, reason=reason)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        seen = tuple(self.state.get()) if self.state.exists() else None
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        # of one micro-batch; attempts of a moment stand in their order
        for at, _, ok, error in sorted((r.ms, r.attempt, r.ok, r.error) for r in rows):
            if seen is not None and at > seen[2] + self.timeout_ms:
                yield self._row(key, seen, False, "timeout")
                seen = None
            seen = ((seen[0] if seen else 0) + 1, error, at)
            if ok == 1 or seen[0] >= self.max_attempts:
                yield self._row(key, seen, ok == 1, "done" if ok == 1 else "attempts")
                seen = None
        if seen is None:
            self.state.clear()
        else:
            self.state.update(seen)
            self.handle.registerTimer(seen[2] + self.timeout_ms)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        seen = tuple(self.state.get())
        self.state.clear()
        yield self._row(key, seen, False, "timeout")

    def close(self) -> None:
        pass


def settled(attempts: DataFrame, timeout_ms: int, max_attempts: int = 1 << 62, delay: str = "0 seconds") -> DataFrame:
    """ST3: a row for each item that is settled, of a stream (item_id, attempt, ok, error, ts); for append mode, with the state
    store that keeps state on disk (see `drain_settled`)."""
    ship(attempts.sparkSession)
    own = attempts.withWatermark("ts", delay).withColumn("ms", F.unix_millis("ts")).groupBy("item_id")
    return own.transformWithState(RetryProcessor(timeout_ms, max_attempts), SETTLED, "Append", "EventTime")


def drain_settled(attempts: DataFrame, timeout_ms: int, path: str, checkpoint: str, max_attempts: int = 1 << 62, delay: str = "0 seconds") -> DataFrame:
    """ST3: all that has arrived, through `settled`, as Parquet below path; run again with the same folders it goes on.

    The session's state store is set to the one that keeps state on disk while this runs."""
    spark = attempts.sparkSession
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ON_DISK)
    try:
        return drain(settled(attempts, timeout_ms, max_attempts, delay), path, checkpoint)
    finally:
        spark.conf.set(STORE, before)
