"""Limits over event streams: windows that start at the first event, and daily quotas."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

# Attempts per actor and over all in a window of ten minutes.
WINDOW_MS = 600_000
ACTOR_LIMIT = 5
GLOBAL_LIMIT = 30

DECISION = "event_id bigint, limit_key string, now_ms bigint, count int, allowed boolean, retry_after_ms bigint"


def step(state: tuple[int, int] | None, now: int, window: int, limit: int) -> tuple[tuple[int, int], bool, int]:
    """The next state (start, count) of a key at an event, whether it is allowed, and the rest of the window.

    The window starts with its first event and is over once ``window`` has passed; refused events count too.
    """
    start, count = (now, 0) if state is None or now - state[0] >= window else state
    count += 1
    return (start, count), count <= limit, max(0, start + window - now)


def _success(events: DataFrame) -> Column:
    given = F.coalesce("success", F.lit(False)) if "success" in events.columns else F.lit(False)
    return given.alias("success")


def decide(events: DataFrame, limit: int, window: int = WINDOW_MS) -> DataFrame:
    """Decision for every event of a finished table: ``event_id, limit_key, now_ms``, in order of time, then id.

    With a column ``success``, an event where it is true is no attempt but ends its key's window, so the
    next attempt starts anew; it has no decision.

    Keys are sorted within their partition and read in batches with only the state of the
    current key held, so a key with very many events takes no more memory than any other.
    """
    names = [c.split()[0] for c in DECISION.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            out = []
            for r in batch.itertuples():
                if r.limit_key != key:
                    key, state = r.limit_key, None
                if r.success:
                    state = None
                    continue
                state, allowed, rest = step(state, int(r.now_ms), window, limit)
                out.append((r.event_id, r.limit_key, r.now_ms, state[1], allowed, rest))
            yield pd.DataFrame(out, columns=names)

    keyed = events.filter(F.col("limit_key").isNotNull() & F.col("now_ms").isNotNull()).select("event_id", "limit_key", "now_ms", _success(events))
    return keyed.repartition("limit_key").sortWithinPartitions("limit_key", "now_ms", "event_id").mapInPandas(run, DECISION)


class Limiter(StatefulProcessor):
    """The same decisions on a stream, with the window's start and count as state of each key."""

    def __init__(self, limit: int, window: int = WINDOW_MS) -> None:
        self.limit, self.window = limit, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("window", "start bigint, count int")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["now_ms", "event_id"], kind="stable")
        held = self.state.get() if self.state.exists() else None
        state, out = (None if held is None else (int(held[0]), int(held[1]))), []
        for r in events.itertuples():
            if r.success:
                state = None
                continue
            state, allowed, rest = step(state, int(r.now_ms), self.window, self.limit)
            out.append((r.event_id, key[0], r.now_ms, state[1], allowed, rest))
        if state is not None:
            self.state.update(state)
        elif held is not None:
            self.state.clear()
        yield pd.DataFrame(out, columns=[c.split()[0] for c in DECISION.split(", ")])

    def close(self) -> None:
        pass


def decide_stream(events: DataFrame, limit: int, window: int = WINDOW_MS) -> DataFrame:
    """Decisions on a stream of ``event_id, limit_key, now_ms``; needs a state store that holds several columns (RocksDB)."""
    return events.select("event_id", "limit_key", "now_ms", _success(events)).groupBy("limit_key").transformWithStateInPandas(
        statefulProcessor=Limiter(limit, window), outputStructType=DECISION, outputMode="Append", timeMode="None"
    )


def both_limits(per_actor: DataFrame, overall: DataFrame) -> DataFrame:
    """An event is allowed if both limits allow it; the longer wait counts."""
    other = overall.select("event_id", F.col("allowed").alias("all_allowed"), F.col("retry_after_ms").alias("all_retry"))
    return per_actor.join(other, "event_id").select(
        "event_id", "limit_key", (F.col("allowed") & F.col("all_allowed")).alias("allowed"), F.greatest("retry_after_ms", "all_retry").alias("retry_after_ms")
    )


# Calls a day, calls a refill adds, and refills a day.
DAILY_CALLS = 40
REFILL_CALLS = 200
REFILLS = 2

QUOTA = "event_id bigint, day string, subject string, action string, allowed boolean, used int, call_limit int, remaining int, refills int"


def quota_step(state: tuple[int, int], action: str, calls: int, refill: int, most: int) -> tuple[tuple[int, int], bool | None]:
    """The next state (calls used, refills) of a subject's day at an event, and whether it is allowed; other actions only read it.

    Only an allowed call uses one; a refill is allowed ``most`` times.
    """
    used, refills = state
    if action == "refill":
        return ((used, refills + 1), True) if refills < most else (state, False)
    if action == "consume":
        return ((used + 1, refills), True) if used < calls + refills * refill else (state, False)
    return state, None


def _quota_row(r: Any, state: tuple[int, int], allowed: bool | None, calls: int, refill: int) -> tuple:
    limit = calls + state[1] * refill
    return r.event_id, r.day, r.subject, r.action, allowed, state[0], limit, max(0, limit - state[0]), state[1]


def quotas(events: DataFrame, calls: int = DAILY_CALLS, refill: int = REFILL_CALLS, most: int = REFILLS) -> DataFrame:
    """Daily quotas of a finished table of events: ``event_id, day, subject, action, now_ms``, in order of time, then id.

    Each event has its decision and what is left after it. Days and subjects are sorted within their partition and read
    in batches with only the current state held. Events without day or subject have no quota and no row.
    """
    names = [c.split()[0] for c in QUOTA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, (0, 0)
        for batch in batches:
            out = []
            for r in batch.itertuples():
                if (r.day, r.subject) != key:
                    key, state = (r.day, r.subject), (0, 0)
                state, allowed = quota_step(state, r.action, calls, refill, most)
                out.append(_quota_row(r, state, allowed, calls, refill))
            yield pd.DataFrame(out, columns=names).astype({"allowed": "object"})

    keyed = events.filter(F.col("day").isNotNull() & F.col("subject").isNotNull() & F.col("now_ms").isNotNull())
    keyed = keyed.select("event_id", F.col("day").cast("string"), F.col("subject").cast("string"), F.coalesce("action", F.lit("")).alias("action"), "now_ms")
    return keyed.repartition("day", "subject").sortWithinPartitions("day", "subject", "now_ms", "event_id").mapInPandas(run, QUOTA)


class Quota(StatefulProcessor):
    """The same quotas on a stream, with a subject's calls and refills of the day as state."""

    def __init__(self, calls: int, refill: int, most: int) -> None:
        self.calls, self.refill, self.most = calls, refill, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("quota", "used int, refills int")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["now_ms", "event_id"], kind="stable")
        held = self.state.get() if self.state.exists() else (0, 0)
        state, out = (int(held[0]), int(held[1])), []
        for r in events.itertuples():
            state, allowed = quota_step(state, r.action, self.calls, self.refill, self.most)
            out.append(_quota_row(r, state, allowed, self.calls, self.refill))
        self.state.update(state)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in QUOTA.split(", ")]).astype({"allowed": "object"})

    def close(self) -> None:
        pass


def quotas_stream(events: DataFrame, calls: int = DAILY_CALLS, refill: int = REFILL_CALLS, most: int = REFILLS) -> DataFrame:
    """Daily quotas on a stream of ``event_id, day, subject, action, now_ms``; needs a state store that holds several columns (RocksDB)."""
    return events.select("event_id", "day", "subject", "action", "now_ms").groupBy("day", "subject").transformWithStateInPandas(
        statefulProcessor=Quota(calls, refill, most), outputStructType=QUOTA, outputMode="Append", timeMode="None"
    )
