"""The path of a written memory as a state machine: embed, deduplicate, extract, relate.

A memory's state is its stage, its attempts and the time by which it should be done.
Events move it on; one that doesn't fit the state (repeated, too early, after the
end) changes nothing, so a replay is harmless. A memory that is still at work ten
minutes after it was written is reported as stuck, once, by a timer on event time or
by the first event after that time, whichever comes first: a batch and a stream of the
same events report the same. Three errors end it as failed.

``statuses`` folds a table, ``status_stream`` a stream (``transformWithState`` with
one value state and timers); both use ``step``. Input: memory_id, ts, event, detail,
is_capture; events: written, embedded, duplicate, distinct, extracted, related, error.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STUCK_MINUTES = 10
MOST_ATTEMPTS = 3
#: An ended memory is remembered so long; a write of the same id after that begins anew.
KEEP_HOURS = 24
_MINUTE = 60_000_000
#: Stage before an event, the event, the stage after it.
_NEXT = {("written", "embedded"): "embedded", ("embedded", "distinct"): "distinct", ("distinct", "extracted"): "extracted", ("extracted", "related"): "completed"}
OUTPUT = "memory_id string, at timestamp, status string, stage string, attempts int, detail string"


class State(NamedTuple):
    stage: str
    attempts: int
    until: int  # microseconds: when it is stuck, or once ended is forgotten
    stuck: bool
    capture: bool
    degraded: str | None
    ended: bool


Out = tuple[int, str, str, int, str | None]


def overdue(state: State | None, now: int) -> tuple[State | None, list[Out]]:
    """What time alone does to a state."""
    if state is None or now < state.until:
        return state, []
    if state.ended:
        return None, []
    if state.stuck:
        return state, []
    return state._replace(stuck=True), [(state.until, "stuck", state.stage, state.attempts, None)]


def _ended(state: State, ts: int, status: str, attempts: int, what: str | None, out: list[Out]) -> tuple[State, list[Out]]:
    return state._replace(attempts=attempts, until=ts + KEEP_HOURS * 60 * _MINUTE, ended=True), [*out, (ts, status, state.stage, attempts, what)]


def step(state: State | None, ts: int, event: str, detail: str | None, capture: bool | None) -> tuple[State | None, list[Out]]:
    """The state after an event at ``ts`` (microseconds), and what to report."""
    out = []
    if state is not None and ts >= state.until:
        state, out = overdue(state, ts)
    if state is None:
        if event != "written":
            return None, out
        new = State("written", 0, ts + STUCK_MINUTES * _MINUTE, False, bool(capture), None, False)
        return new, [*out, (ts, "processing", "written", 0, None)]
    if state.ended:
        return state, out
    before, attempts, until, stuck, is_capture, degraded, _ = state
    if event == "error":
        if attempts + 1 >= MOST_ATTEMPTS:
            return _ended(state, ts, "failed", attempts + 1, detail, out)
        return State(before, attempts + 1, until, stuck, is_capture, degraded, False), [*out, (ts, "retrying", before, attempts + 1, detail)]
    if event == "duplicate" and before == "embedded":
        return _ended(state, ts, "dropped" if is_capture else "merged", attempts, detail, out)
    stage = _NEXT.get((before, event))
    if stage == "embedded" and detail == "none":
        stage = "distinct"  # without a vector there is nothing to compare
    if stage is None:
        return state, out
    if stage == "completed":
        return _ended(state, ts, "completed", attempts, degraded, out)
    return State(stage, attempts, until, stuck, is_capture, detail if event == "extracted" else degraded, False), [*out, (ts, "processing", stage, attempts, detail)]


def _micros(ts) -> int:
    return int(pd.Timestamp(ts).value // 1000)


def _frame(rows: list[tuple[str, Out]]) -> pd.DataFrame:
    out = [(memory_id, pd.Timestamp(at, unit="us"), *rest) for memory_id, (at, *rest) in rows]
    return pd.DataFrame(out, columns=["memory_id", "at", "status", "stage", "attempts", "detail"]).astype({"attempts": "int32"})


_ORDER = ["ts", "rank", "detail"]
_RANK = {"written": 0, "embedded": 1, "distinct": 2, "duplicate": 3, "extracted": 4, "related": 5, "error": 6}


def _columns(events: DataFrame) -> DataFrame:
    """Events with their order among those of one time."""
    rank = F.coalesce(F.create_map(*(F.lit(x) for pair in _RANK.items() for x in pair))[F.col("event")], F.lit(9))
    return events.where("memory_id is not null and ts is not null").select(F.col("memory_id").cast("string").alias("memory_id"), "ts", "event", rank.alias("rank"), F.coalesce("detail", F.lit("")).alias("detail"), F.coalesce("is_capture", F.lit(False)).alias("is_capture"))


def statuses(events: DataFrame, until: str | None = None) -> DataFrame:
    """Reports of a table of events; states still open at ``until`` (default: never) are stuck if they are overdue by then."""
    last_call = None if until is None else events.sparkSession.sql("select unix_micros(cast(:until as timestamp))", {"until": until}).first()[0]
    schema = pa.schema([("memory_id", pa.string()), ("at", pa.int64()), ("status", pa.string()), ("stage", pa.string()), ("attempts", pa.int32()), ("detail", pa.string())])

    def reports(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            rows = []
            for memory_id, ts, event, detail, capture in zip(*(c.to_numpy(zero_copy_only=False).tolist() for c in b.columns)):
                if memory_id != key:
                    if last_call is not None:
                        rows += [(key, *x) for x in overdue(state, last_call)[1]]
                    key, state = memory_id, None
                state, out = step(state, ts, event, detail or None, capture)
                rows += [(key, *x) for x in out]
            if rows:
                yield reports(rows)
        if last_call is not None and (rows := [(key, *x) for x in overdue(state, last_call)[1]]):
            yield reports(rows)

    # times as numbers: a task handles no time object for each event
    ordered = _columns(events).repartition("memory_id").sortWithinPartitions("memory_id", *_ORDER).select("memory_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), "event", "detail", "is_capture")
    found = ordered.mapInArrow(fold, "memory_id string, at long, status string, stage string, attempts int, detail string")
    return found.withColumn("at", F.timestamp_micros("at"))


class WritePath(StatefulProcessor):
    """One memory's state; a timer stands at the time by which it is stuck or forgotten."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("state", "stage string, attempts int, until long, stuck boolean, capture boolean, degraded string, ended boolean")

    def _load(self) -> State | None:
        return State(*self.value.get()) if self.value.exists() else None

    def _save(self, state: State | None) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if state is None:
            self.value.clear()
            return
        self.value.update(tuple(state))
        if not state.stuck or state.ended:
            self.handle.registerTimer(-(-state.until // 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state, out = self._load(), []
        for r in pd.concat(list(rows)).sort_values(_ORDER).itertuples():
            state, more = step(state, _micros(r.ts), r.event, r.detail or None, r.is_capture)
            out += more
        self._save(state)
        yield _frame([(key[0], x) for x in out])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, out = overdue(self._load(), expiredTimerInfo.getExpiryTimeInMs() * 1000)
        self._save(state)
        yield _frame([(key[0], x) for x in out])

    def close(self) -> None:
        pass


def status_stream(events: DataFrame, late: str = "0 seconds") -> DataFrame:
    """The same reports of a stream; events of a memory may be late by ``late`` and must otherwise come in order."""
    keyed = _columns(events.withWatermark("ts", late))
    return keyed.groupBy("memory_id").transformWithStateInPandas(WritePath(), OUTPUT, "Append", "EventTime")


# ---------------------------------------------------------------- the scheduler
def rebuilds_due(events: DataFrame, every: int = 300, window: int = 600) -> DataFrame:
    """container_tag, at: the ticks (each ``every`` seconds) at which a container's profile is rebuilt, since something was written to it less than ``window`` seconds before. Containers below another (with ``_``) have no profile of their own. Works on tables and, with a watermark, on streams."""
    at, tick = "unix_micros(cast(ts as timestamp))", f"{every * 1_000_000}L"
    first, last = F.expr(f"({at} + {tick} - 1) div {tick}"), F.expr(f"({at} + {window * 1_000_000}L - 1) div {tick}")
    ticks = events.where(~F.col("container_tag").contains("_")).select("container_tag", F.explode(F.sequence(first, last)).alias("tick"))
    return ticks.select("container_tag", F.timestamp_seconds(F.col("tick") * every).alias("at")).distinct()
