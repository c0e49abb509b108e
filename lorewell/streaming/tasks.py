"""Progress of tasks while their events arrive."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import DEFAULT
from ..operators.tasklog import step_name

OUT = "task_id string, status string, running_list array<string>, done_list array<string>, durations map<string,double>, total_seconds double, progress int"
#: State that is kept by key and step needs a store that can read and write one entry.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Step(NamedTuple):
    """What is known of a step; times are microseconds, -1 stands for none. Of each fact the event counts that is latest (or, for the first finish, earliest) by
    its own time, so the order of arrival doesn't matter."""

    last: int = -1
    event: str = ""
    first_done: int = -1
    last_done: int = -1
    starts: tuple[int, ...] = ()  # since the step last finished, as far as is known
    said: int = -1
    seconds: float | None = None

    def after(self, ts: int, event: str, duration: float | None, settled: int = -1) -> Step:
        """With one more event. ``settled``: no event before that time can still come. Starts before it can only go together, so the first of them is enough."""
        new = self
        if (ts, event) > (new.last, new.event):
            new = new._replace(last=ts, event=event)
        if event == "done":
            new = new._replace(first_done=ts if new.first_done < 0 else min(new.first_done, ts), last_done=max(new.last_done, ts))
            if duration is not None and duration == duration and ts >= new.said:
                new = new._replace(said=ts, seconds=float(duration))
        starts = {*new.starts, ts} if event == "start" else new.starts
        starts = sorted(s for s in starts if s >= new.last_done)
        return new._replace(starts=tuple(s for i, s in enumerate(starts) if i == 0 or s >= settled))


STEP = "last long, event string, first_done long, last_done long, starts array<long>, said long, seconds double"


def summary(task: str, status: str, steps: dict[str, Step], total_steps: int) -> pd.DataFrame:
    running = sorted((s.starts[0], name) for name, s in steps.items() if s.event == "start")
    done = sorted((s.first_done, name) for name, s in steps.items() if s.first_done >= 0)
    spent = {name: round(s.seconds, 2) for name, s in sorted(steps.items()) if s.seconds is not None}
    progress = min(100, math.floor(100 * len(done) / total_steps + 0.5))
    return pd.DataFrame({"task_id": [task], "status": [status], "running_list": [[n for _, n in running]], "done_list": [[n for _, n in done]], "durations": [spent], "total_seconds": [round(sum(spent.values()), 2)], "progress": [progress]})


class Progress(StatefulProcessor):
    """A task's state: a map entry for each step, of which only those with new events are written, and its own status. A timer forgets a task without events."""

    def __init__(self, idle_ms: int, total_steps: int):
        self.idle_ms, self.total_steps = idle_ms, total_steps

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.steps = handle.getMapState("steps", "node string", STEP)
        self.task = handle.getValueState("task", "status_at long, status string, last long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        settled = timerValues.getCurrentWatermarkInMs() * 1000
        known = {k[0]: Step(*v[:4], tuple(v[4]), *v[5:]) for k, v in self.steps.iterator()}
        fresh = not self.task.exists()
        status_at, status, last = (-1, "", -1) if fresh else self.task.get()
        touched = set()
        for pdf in rows:
            for e in pdf.itertuples(index=False):
                last = max(last, e.us)
                if e.node is None or e.node != e.node:
                    if e.event in ("completed", "failed") and (e.us, e.event) > (status_at, status):
                        status_at, status = e.us, e.event
                    continue
                known[e.node] = known.get(e.node, Step()).after(e.us, e.event, e.duration, settled)
                touched.add(e.node)
        for node in touched:
            s = known[node]
            self.steps.updateValue((node,), (*s[:4], list(s.starts), *s[5:]))
        self.task.update((status_at, status, last))
        if fresh:
            self.handle.registerTimer(max(last // 1000, timerValues.getCurrentWatermarkInMs()) + self.idle_ms)
        yield summary(key[0], status or "processing", known, self.total_steps)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.task.exists():
            due = self.task.get()[2] // 1000 + self.idle_ms
            if due > timerValues.getCurrentWatermarkInMs():  # there were events since the timer was set
                self.handle.registerTimer(due)
            else:
                self.steps.clear()
                self.task.clear()
        return iter(())

    def close(self) -> None:
        pass


def task_rollup_stream(events: DataFrame, late: str = "1 hour", idle_minutes: int = 1440, total_steps: int = DEFAULT.total_steps["md"], names: dict[str, str] | None = None) -> DataFrame:
    """Update-mode rows, the columns of ``task_rollup``, as the events of a task come in. A task without events for ``idle_minutes`` of event time is forgotten;
    events later than ``late`` may be dropped. The session's state store is set to RocksDB, which state by step needs."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    marked = events.withWatermark("ts", late).select("task_id", step_name(F.col("node"), names).alias("node"), "event", "ts", F.unix_micros("ts").alias("us"), F.col("duration").cast("double").alias("duration"))
    return marked.groupBy("task_id").transformWithStateInPandas(Progress(idle_minutes * 60_000, total_steps), OUT, "update", "eventTime")
