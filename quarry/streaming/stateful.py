"""Operators over streams whose state expires: timers in event time end windows, locks, sessions and idleness.

State is kept by key in RocksDB (``use_rocksdb`` once a session).  The events'
column ``t`` carries a watermark; a timer fires when the watermark passes it,
also for keys that send nothing more, and what no later event can need is
removed then.  Rows that come later than the watermark are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that these operators need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def allowed(times: list[int], log: list[int], limit: int, window_us: int) -> tuple[list[bool], list[int]]:
    """Which requests a sliding log accepts; only accepted ones enter it."""
    out = []
    for t in times:
        log = [x for x in log if x > t - window_us]
        ok = len(log) < limit
        if ok:
            log.append(t)
        out.append(ok)
    return out, log


def locked(rows: list[tuple[int, bool]], failures: int, last: int, limit: int, block_us: int) -> tuple[list[bool], int, int]:
    """Which attempts (time, failed) meet a lock: ``limit`` failures close the account for a time; a success clears the count."""
    out = []
    for t, failed in rows:
        shut = failures >= limit and t < last + block_us
        out.append(shut)
        if failures >= limit and not shut:
            failures = 0
        if not shut:
            failures, last = (failures + 1, t) if failed else (0, last)
    return out, failures, last


def extended(open_: list[tuple[int, int, int]], times: list[int], gap_us: int) -> list[tuple[int, int, int]]:
    """Sessions (first, last, number of events) with further events: one within ``gap_us`` of a session extends it, and may join two."""
    out: list[tuple[int, int, int]] = []
    for first, last, n in sorted(open_ + [(t, t, 1) for t in times]):
        if out and first <= out[-1][1] + gap_us:
            a, b, m = out[-1]
            out[-1] = (a, max(b, last), m + n)
        else:
            out.append((first, last, n))
    return out


class _Keyed(StatefulProcessor):
    """Common steps: rows of a key in order of time, one timer for each key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def close(self) -> None:
        pass

    @staticmethod
    def in_order(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(list(rows)).sort_values(["us", "event_id"])

    def wake_at(self, us: int | None) -> None:
        """The key's only timer: the first millisecond after ``us``; none for None."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if us is not None:
            self.handle.registerTimer(us // 1000 + 1)


class RateLimit(_Keyed):
    """The log of accepted requests is a list; what leaves the window is removed."""

    def __init__(self, limit: int, window_us: int):
        self.limit, self.window = limit, window_us

    def init(self, handle):
        super().init(handle)
        self.log = handle.getListState("log", "us long")

    def keep(self, log: list[int]) -> None:
        if log:
            self.log.put([(t,) for t in log])
        else:
            self.log.clear()
        self.wake_at(max(log) + self.window if log else None)

    def handleInputRows(self, key, rows, timerValues):
        batch = self.in_order(rows)
        ok, log = allowed(batch["us"].tolist(), [r[0] for r in self.log.get()], self.limit, self.window)
        self.keep(log)
        yield pd.DataFrame({"event_id": batch["event_id"].to_numpy(), "user_id": key[0], "accepted": ok})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs() * 1000
        self.keep([r[0] for r in self.log.get() if r[0] > now - self.window])
        return iter(())


class Lockout(_Keyed):
    """Failures in a row and the time of the last one; a success, or the end of a lock, removes both."""

    def __init__(self, limit: int, block_us: int):
        self.limit, self.block = limit, block_us

    def init(self, handle):
        super().init(handle)
        self.failures = handle.getValueState("failures", "n long, last long")

    def handleInputRows(self, key, rows, timerValues):
        batch = self.in_order(rows)
        n, last = self.failures.get() if self.failures.exists() else (0, 0)
        out, n, last = locked(list(zip(batch["us"].tolist(), batch["failed"].tolist(), strict=True)), n, last, self.limit, self.block)
        if n:
            self.failures.update((n, last))
        else:
            self.failures.clear()
        self.wake_at(last + self.block if n >= self.limit else None)
        yield pd.DataFrame({"event_id": batch["event_id"].to_numpy(), "user_id": key[0], "locked": out})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.failures.clear()
        return iter(())


class Sessions(_Keyed):
    """Open sessions of a user; each is given out, and goes, once no event can extend it."""

    def __init__(self, gap_us: int):
        self.gap = gap_us

    def init(self, handle):
        super().init(handle)
        self.open = handle.getListState("open", "first long, last long, n long")

    def keep(self, sessions: list[tuple[int, int, int]]) -> None:
        if sessions:
            self.open.put(sessions)
        else:
            self.open.clear()
        self.wake_at(min(last for _, last, _ in sessions) + self.gap if sessions else None)

    def handleInputRows(self, key, rows, timerValues):
        times = [t for b in rows for t in b["us"].tolist()]
        self.keep(extended([tuple(r) for r in self.open.get()], times, self.gap))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs() * 1000
        sessions = [tuple(r) for r in self.open.get()]
        over = [s for s in sessions if s[1] + self.gap < now]
        self.keep([s for s in sessions if s not in over])
        if over:
            yield pd.DataFrame({"user_id": key[0], "first_us": [s[0] for s in over], "expires_us": [s[1] + self.gap for s in over], "n": [s[2] for s in over]})


class Idle(_Keyed):
    """When a user was seen last; given out, and forgotten, after ``idle_us`` without an event."""

    def __init__(self, idle_us: int):
        self.idle = idle_us

    def init(self, handle):
        super().init(handle)
        self.last = handle.getValueState("last", "us long")

    def handleInputRows(self, key, rows, timerValues):
        last = max([t for b in rows for t in b["us"].tolist()] + ([self.last.get()[0]] if self.last.exists() else []))
        self.last.update((last,))
        self.wake_at(last + self.idle)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        last = self.last.get()[0]
        self.last.clear()
        yield pd.DataFrame({"user_id": [key[0]], "last_us": [last]})


def _run(events: DataFrame, late: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    keyed = events.withWatermark("t", late).select("event_id", "user_id", "t", F.unix_micros("t").alias("us"), (F.col("event_type") == "error").alias("failed"))
    return keyed.groupBy("user_id").transformWithStateInPandas(processor, schema, "Append", "EventTime")


def rate_limit(events: DataFrame, limit: int = 100, window_s: int = 60, late: str = "0 seconds") -> DataFrame:
    """event_id, user_id, accepted: at most ``limit`` accepted requests in any trailing window."""
    return _run(events, late, RateLimit(limit, window_s * 1_000_000), "event_id long, user_id long, accepted boolean")


def lockout(events: DataFrame, limit: int = 5, block_s: int = 300, late: str = "0 seconds") -> DataFrame:
    """event_id, user_id, locked for each event; events of type error are failures."""
    return _run(events, late, Lockout(limit, block_s * 1_000_000), "event_id long, user_id long, locked boolean")


def expiring_sessions(events: DataFrame, gap_s: int = 1800, late: str = "0 seconds") -> DataFrame:
    """user_id, first_us, expires_us, n of each session, once it has expired; an event before that extends it."""
    return _run(events, late, Sessions(gap_s * 1_000_000), "user_id long, first_us long, expires_us long, n long")


def idle_users(events: DataFrame, idle_s: int = 300, late: str = "0 seconds") -> DataFrame:
    """user_id and last_us of users who have sent nothing for ``idle_s`` seconds."""
    return _run(events, late, Idle(idle_s * 1_000_000), "user_id long, last_us long")


def followed(first: DataFrame, second: DataFrame, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """user_id, first_id, first_t, second_id, second_t: what a user does within a time after a first event; first events that nothing follows have null.

    Both sides have event_id, user_id and t.  Over streams each side's rows
    leave the state when the other side's watermark says that nothing can meet
    them, and a first event without a second is given out then.  Over tables it
    is the plain join.
    """
    a = first.select(F.col("user_id"), F.col("event_id").alias("first_id"), F.col("t").alias("first_t")).withWatermark("first_t", late)
    b = second.select(F.col("user_id").alias("who"), F.col("event_id").alias("second_id"), F.col("t").alias("second_t")).withWatermark("second_t", late)
    meet = (F.col("user_id") == F.col("who")) & (F.col("second_t") > F.col("first_t")) & (F.col("second_t") <= F.col("first_t") + F.expr(f"INTERVAL {within}"))
    return a.join(b, meet, "left_outer").drop("who")


def dropped_rows(query) -> int:
    """Rows that came after the watermark and were dropped, over all operators and recent batches of a query."""
    return sum(o.numRowsDroppedByWatermark for p in query.recentProgress for o in p.stateOperators)
