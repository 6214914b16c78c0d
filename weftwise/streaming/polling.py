"""Following issues to their end: a stream of statuses in, one row for each issue that is over out.

Each issue has a little state: how often it was seen, first and last when, and its status. It is over with a terminal
status, or when nothing is heard of it for ``patience`` of event time: then a timer of the watermark, or the next status
that comes too late, ends it with what was known. State of issues that are over is kept (one flag), so that whatever is
still said of them is left out. Needs Spark's RocksDB state store (``state_store``).
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# The statuses behind which none follows.
TERMINAL = ("RESOLVED", "STOPPED")
ENDED = "issue_id string, status string, outcome string, seen long, first_at timestamp, last_at timestamp"
_ROW = "issue_id string, status string, outcome string, seen long, first_ms long, last_ms long"
_STATE = "over boolean, status string, seen long, first_at long, last_at long"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """While this is open, streams that begin have the state store that ``follow_issues`` needs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, _PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(name, before)


class _Issue(StatefulProcessor):
    """Rows come and go as rows, not as tables of a key, and each call of the state is one that is needed: an open issue
    has its one timer at a time that its state tells."""

    def __init__(self, patience_ms: int):
        self.patience = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("issue", _STATE)

    def _ended(self, key: tuple, state: tuple, outcome: str) -> Row:
        _, status, seen, first, last = state
        self.state.update((True, status, seen, first, last))
        return Row(issue_id=key[0], status=status, outcome=outcome, seen=seen, first_ms=first, last_ms=last)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        said = sorted((r.ms, r.status) for r in rows)
        before = state = self.state.get()
        if state and state[0]:
            return
        for ms, status in said:
            if state and ms > state[4] + self.patience:
                outcome = "timed out"
                break
            state = (False, status, state[2] + 1, state[3], max(state[4], ms)) if state else (False, status, 1, ms, ms)
            if status in TERMINAL:
                outcome = "ended"
                break
        else:
            outcome = None
        if before and (outcome or state[4] != before[4]):
            self.handle.deleteTimer(before[4] + self.patience)
        if outcome:
            yield self._ended(key, state, outcome)
            return
        self.state.update(state)
        if not before or state[4] != before[4]:
            self.handle.registerTimer(state[4] + self.patience)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state = self.state.get()
        if state and not state[0]:
            yield self._ended(key, state, "timed out")

    def close(self) -> None:
        pass


def follow_issues(statuses: DataFrame, patience: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """(issue_id, status, outcome, seen, first_at, last_at) of each issue when it is over; ``statuses`` is a stream of
    (issue_id, status, at).

    ``outcome`` is ended (by a terminal status) or timed out (``patience`` without a status). Statuses that are older than
    the watermark (``lateness`` behind the latest) aren't looked at. Nulls in any column are left out.
    """
    heard = statuses.select("issue_id", "status", "at", F.unix_millis("at").alias("ms")).dropna().withWatermark("at", lateness)
    processor = _Issue(int(pd.Timedelta(patience).total_seconds() * 1000))
    ended = heard.groupBy("issue_id").transformWithState(processor, outputStructType=_ROW, outputMode="Append", timeMode="EventTime")
    return ended.select("issue_id", "status", "outcome", "seen", F.timestamp_millis("first_ms").alias("first_at"), F.timestamp_millis("last_ms").alias("last_at"))
