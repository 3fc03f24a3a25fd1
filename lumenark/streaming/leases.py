"""A job queue as a stream: claims under a lease, completions behind a fence, and leases that expire by themselves.

The state of a job is its row in the queue. Commands (job_id, seq, command, owner, permanent) change it by the rules of the
batch operators (``operators.ingest``), and a processing-time timer is set for the end of each lease: when it fires and
the lease still runs, the job is pending again and the attempt does not count, without anyone asking. Every command and
every expiry gives a row with its outcome, so the rows of a job in their order are its history.

A job is a key, so its commands are taken one after the other, by ``seq`` within a batch; two owners never hold one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.ingest import LEASE_MS, MOST_ATTEMPTS

STATE = "status string, owner string, lease_ms long, attempts int, next_attempt_ms long"
OUT = "job_id long, seq long, event string, owner string, status string, attempts int, lease_ms long, at_ms long"
#: A job before it is seen: status, owner, end of lease, attempts, time of the next attempt.
NEW = ("PENDING", None, None, 0, 0)
RETRY_MS, MOST_RETRY_MS = 30_000, 120_000


def after(state: tuple, command: str, owner: str | None, permanent: bool, now: int, lease_ms: int = LEASE_MS) -> tuple[tuple, str]:
    """The state after a command, and its outcome."""
    status, holder, lease, attempts, due = state
    running = status == "RUNNING" and lease is not None and lease > now
    if command == "CLAIM":
        if status in ("PENDING", "FAILED_RETRYABLE") and due <= now:
            return ("RUNNING", owner, now + lease_ms, attempts + 1, due), "CLAIMED"
        return state, "REFUSED"
    if command == "COMPLETE":
        return (("COMPLETE", holder, lease, attempts, due), "COMPLETED") if running and holder == owner else (state, "FENCED")
    if command == "FAIL":
        if not (running and holder == owner):
            return state, "FENCED"
        if permanent or attempts >= MOST_ATTEMPTS:
            return ("FAILED_PERMANENT" if permanent else "FAILED_EXHAUSTED", holder, lease, attempts, due), "FAILED"
        return ("FAILED_RETRYABLE", holder, lease, attempts, now + min(MOST_RETRY_MS, RETRY_MS * 2 ** max(0, attempts - 1))), "FAILED"
    if command == "SUBMIT":
        return state, "SUBMITTED"
    return state, "UNKNOWN"


def expired(state: tuple, now: int) -> tuple | None:
    """The state after its lease has run out; None if it has not."""
    status, holder, lease, attempts, due = state
    if status == "RUNNING" and (lease is None or lease <= now):
        return "PENDING", holder, None, max(0, attempts - 1), due
    return None


class Queue(StatefulProcessor):
    def __init__(self, lease_ms: int):
        self.lease_ms = lease_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        state, out = tuple(self.job.get()) if self.job.exists() else NEW, []
        if (back := expired(state, now)) is not None:  # the timer will fire behind this batch: the job is free already
            out.append((key[0], None, "EXPIRED", state[1], *back[:1], back[3], back[2], now))
            state = back
        for r in pd.concat(list(rows)).sort_values("seq", kind="stable").itertuples():
            before = state
            state, outcome = after(state, r.command, r.owner, bool(r.permanent) if r.permanent is not None and r.permanent == r.permanent else False, now, self.lease_ms)
            out.append((key[0], r.seq, outcome, r.owner, state[0], state[3], state[2], now))
            if outcome == "CLAIMED":
                self.handle.registerTimer(state[2])
            elif before[0] == "RUNNING" and state[0] != "RUNNING" and before[2] is not None:
                self.handle.deleteTimer(before[2])
        self.job.update(state)
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        state = tuple(self.job.get()) if self.job.exists() else NEW
        back = expired(state, now)
        if back is None:
            return
        self.job.update(back)
        yield _frame([(key[0], None, "EXPIRED", state[1], back[0], back[3], back[2], now)])

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in OUT.split(", ")]
    columns = {n: [r[i] for r in rows] for i, n in enumerate(names)}
    return pd.DataFrame({n: pd.array(v, "Int64") if n in ("job_id", "seq", "attempts", "lease_ms", "at_ms") else v for n, v in columns.items()})


def leased(commands: DataFrame, lease_ms: int = LEASE_MS) -> DataFrame:
    """Outcomes of a stream of commands; the session needs the RocksDB state store, as all operators with timers do."""
    return commands.groupBy("job_id").transformWithStateInPandas(statefulProcessor=Queue(lease_ms), outputStructType=OUT, outputMode="Append", timeMode="ProcessingTime")


#: The setting that ``leased`` needs.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
