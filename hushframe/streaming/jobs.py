"""Jobs that run by timers: a stream of actions on jobs in, a stream of runs out.

A job is a key of the stream; its schedule and next run are state, and a timer stands at the next run. Time is that of the
events (their watermark), so a replay gives the same runs, or the clock's, where runs missed while nothing ran are one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from hushframe.operators.history import cron_after

#: What an action may do; rows of others only tell that time has gone on.
ACTIONS = ("add", "remove", "enable", "disable", "run")
SCHEDULE = ("kind", "at_ms", "every_ms", "expr", "zone", "once")
_RAN = Row("job", "due_ms", "run", "cause")
_STATE = "kind string, at_ms long, every_ms long, expr string, zone string, once boolean, enabled boolean, next_run long, runs long, changed long, gone boolean"


@dataclass
class Job:
    """A schedule (at, every or cron) and where it stands; `once` deletes a job of kind `at` after its run."""

    kind: str | None = None
    at_ms: int | None = None
    every_ms: int | None = None
    expr: str | None = None
    zone: str | None = None
    once: bool = False
    enabled: bool = False
    next_run: int | None = None
    runs: int = 0
    changed: int = -1
    gone: bool = True

    def following(self, now: int) -> int | None:
        """The next run after `now`."""
        if self.kind == "at":
            return self.at_ms if self.at_ms is not None and self.at_ms > now else None
        if self.kind == "every":
            return now + self.every_ms if self.every_ms and self.every_ms > 0 else None
        return cron_after(self.expr, now, self.zone) if self.kind == "cron" else None

    def _ran(self, now: int) -> None:
        self.runs += 1
        if self.kind == "at":
            self.enabled, self.next_run, self.gone = False, None, self.once
        else:
            self.next_run = self.following(now)

    def advance(self, now: int, catch_up: bool) -> list[tuple[int, int, str]]:
        """(due, run, cause) of the runs that are due by `now`: each of them, or one for all that were missed."""
        out = []
        while not self.gone and self.enabled and self.next_run is not None and self.next_run <= now:
            due = self.next_run
            self._ran(due if catch_up else now)
            out.append((due, self.runs, "timer"))
        return out

    def act(self, action: str, now: int, schedule: dict) -> list[tuple[int, int, str]]:
        """What an action does: add (or replace), remove, enable, disable, run; others, and those on a job that isn't there, do nothing."""
        if action == "add":
            runs = self.runs
            self.__init__(**schedule, enabled=True, runs=runs, gone=False)
            self.next_run = self.following(now)
        elif self.gone:
            return []
        elif action == "remove":
            self.gone, self.next_run = True, None
        elif action in ("enable", "disable"):
            self.enabled = action == "enable"
            self.next_run = self.following(now) if self.enabled else None
        elif action == "run":
            self._ran(now)
            return [(now, self.runs, "manual")]
        return []


class Scheduler(StatefulProcessor):
    """A job's actions and timers; catch_up: by event time, every run on its own."""

    def __init__(self, catch_up: bool):
        self.catch_up = catch_up

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", _STATE)

    def _load(self) -> Job:
        held = self.state.get()
        return Job() if held is None else Job(*held)

    def _store(self, job: Job) -> None:
        self.state.update(astuple(job))
        if not job.gone and job.enabled and job.next_run is not None:
            self.handle.registerTimer(job.next_run)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        job, out, taken, latest = self._load(), [], [], None
        for row in rows:
            latest = row.ms if latest is None else max(latest, row.ms)
            if row.what is not None:
                taken.append((row.ms, row.what))
        clock = lambda ms: ms if self.catch_up else timerValues.getCurrentProcessingTimeInMs()
        for ms, what in sorted(taken, key=lambda x: (x[0], x[1]["action"])):
            if ms < job.changed:
                continue  # later actions have been taken already
            now = clock(ms)
            out += job.advance(now, self.catch_up)
            out += job.act(what["action"], now, {c: what[c] for c in SCHEDULE})
            job.changed = ms
        if latest is not None and latest > job.changed:
            # What is due between actions is due before the next one as well, so the last of the other rows stands for all.
            out += job.advance(clock(latest), self.catch_up)
            job.changed = latest
        self._store(job)
        yield from _told(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        job = self._load()
        now = timerValues.getCurrentWatermarkInMs() if self.catch_up else timerValues.getCurrentProcessingTimeInMs()
        out = job.advance(now, self.catch_up)  # none, if the timer is one of a schedule before
        if out:
            self._store(job)
        yield from _told(key, out)


def _told(key: tuple, out: list[tuple]) -> Iterator[Row]:
    """A row for all runs of a job: each row that leaves Python costs as much as many runs do."""
    if out:
        yield _RAN(key[0], *map(list, zip(*out, strict=True)))


def runs(actions: DataFrame, delay: str | None = "0 seconds") -> DataFrame:
    """Streaming actions(job, ts, action, kind, at_ms, every_ms, expr, zone, once) to runs (job, due_ms, run, cause).

    delay: by how much the watermark of `ts` lags, actions older than it are dropped by the stream; None: time is the
    clock's, and `ts` orders a job's actions only. Actions of a job in one batch are taken by time (a few: they are held together, rows that do nothing aren't);
    those that come after a later one of their job was taken do nothing. run counts a job's runs. Rows without a job or time are left out.
    """
    by_event = delay is not None
    rows = actions.filter("job is not null and ts is not null")
    rows = rows.withWatermark("ts", delay) if by_event else rows
    # A cell that goes to Python costs more than what is done with it, so an action is one, and null in rows that do nothing.
    what = F.when(F.col("action").isin(*ACTIONS), F.struct("action", *SCHEDULE[:-1], F.coalesce("once", F.lit(False)).alias("once"))).alias("what")
    keyed = rows.select(F.col("job").cast("string").alias("job"), F.unix_millis("ts").alias("ms"), what, *(["ts"] if by_event else [])).groupBy("job")
    told = "job string, due_ms array<long>, run array<long>, cause array<string>"
    out = keyed.transformWithState(Scheduler(by_event), told, "append", "EventTime" if by_event else "ProcessingTime")
    return out.select("job", F.inline(F.arrays_zip("due_ms", "run", "cause")))
