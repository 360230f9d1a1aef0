"""Jobs whose leases end by themselves: claims and results as a stream, timers that release a job without a message.

Events are (tenant_id, document_id, index_version, kind, owner_id, at), kind CLAIM, DONE or FAIL.  Per job they count in
order of time.  A claim wins a job that is new, pending, failed or the caller's own; it runs until ``at`` plus the lease.
A job that is still running then is PENDING again from that moment, be there an event or not: the time is that of the
stream's watermark.  Results count from the owner of a running job alone; a completed job is not to be had.

Every change of state is a row (.., state, owner_id, at); refused claims are rows of state HELD.  Events of one job
that come late, behind the watermark, are dropped by the stream.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docloom.operators.lifecycle import LEASE_SECONDS

KEY = ["tenant_id", "document_id", "index_version"]
CHANGE = "tenant_id long, document_id long, index_version long, state string, owner_id string, at timestamp"
Job = tuple[str, str | None, datetime | None]  # state, owner, end of the lease
NEW: Job = ("PENDING", None, None)


def released(job: Job, now: datetime) -> tuple[Job, list[tuple]]:
    """The job at ``now``, and the change where its lease has ended by then."""
    state, _, ends = job
    if state == "RUNNING" and ends <= now:
        return NEW, [("PENDING", None, ends)]
    return job, []


def step(job: Job, kind: str, owner: str | None, at: datetime, lease: timedelta) -> tuple[Job, list[tuple]]:
    """The job after an event, and the changes (state, owner, at) that it brings."""
    job, changes = released(job, at)
    state, held_by, _ = job
    if kind == "CLAIM":
        if state == "COMPLETED" or (state == "RUNNING" and held_by != owner):
            return job, [*changes, ("HELD", owner, at)]
        return ("RUNNING", owner, at + lease), [*changes, ("RUNNING", owner, at)]
    if state == "RUNNING" and held_by == owner and kind in ("DONE", "FAIL"):
        end = "COMPLETED" if kind == "DONE" else "FAILED"
        return (end, owner, None), [*changes, (end, owner, at)]
    return job, changes


def fold(job: Job, events: Iterable[tuple], lease: timedelta) -> tuple[Job, list[tuple]]:
    """All events (at, kind, owner) of one job in order."""
    changes: list[tuple] = []
    for at, kind, owner in sorted(events, key=lambda e: (e[0], e[1], e[2] or "")):
        job, more = step(job, kind, owner, at, lease)
        changes += more
    return job, changes


def _utc(ms: int) -> datetime:
    return datetime.fromtimestamp(ms / 1000, timezone.utc).replace(tzinfo=None)


def _ms(at: datetime) -> int:
    return int(at.replace(tzinfo=timezone.utc).timestamp() * 1000)


class _Leases(StatefulProcessor):
    """State and timers count in milliseconds, as the stream's clock does."""

    def __init__(self, seconds: int):
        self.lease = timedelta(seconds=seconds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "state string, owner string, ends long")

    def _held(self) -> Job:
        held = self.job.get() if self.job.exists() else None
        return NEW if held is None else (held[0], held[1], None if held[2] is None else _utc(held[2]))

    def _put(self, before: Job, after: Job) -> None:
        if before[2] != after[2]:
            if before[2] is not None:
                self.handle.deleteTimer(_ms(before[2]))
            if after[2] is not None:
                self.handle.registerTimer(_ms(after[2]))
        self.job.update((after[0], after[1], None if after[2] is None else _ms(after[2])))

    @staticmethod
    def _rows(key: tuple, changes: list[tuple]) -> Iterator[pd.DataFrame]:
        if changes:
            states, owners, times = zip(*changes, strict=True)
            yield pd.DataFrame({**{c: [k] * len(changes) for c, k in zip(KEY, key, strict=True)}, "state": states, "owner_id": owners, "at": pd.to_datetime(list(times))})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events: list[tuple] = []
        for frame in rows:
            moments = pd.DatetimeIndex(frame["at"]).floor("ms").to_pydatetime()
            owners = frame["owner_id"].astype(object).where(frame["owner_id"].notna(), None)
            events += zip(moments, frame["kind"], owners, strict=True)
        before = self._held()
        after, changes = fold(before, events, self.lease)
        self._put(before, after)
        yield from self._rows(key, changes)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        before = self._held()
        after, changes = released(before, _utc(expiredTimerInfo.getExpiryTimeInMs()))
        if changes:
            self.job.update((after[0], after[1], None))
        yield from self._rows(key, changes)

    def close(self) -> None:
        pass


def lease_stream(events: DataFrame, lease_seconds: int = LEASE_SECONDS, late: str = "0 seconds") -> DataFrame:
    """Changes of state of all jobs, as they happen.  The session's time zone is to be UTC, its state on disk."""
    timed = events.withWatermark("at", late)
    return timed.groupBy(*KEY).transformWithStateInPandas(_Leases(lease_seconds), CHANGE, "append", "eventtime")
