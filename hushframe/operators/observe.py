"""Hooks on runs: what went through each stage of a plan, counted while it runs, and handed to those who listen.

A stage is a place in a plan; `watch` names it and the metrics taken there, which Spark sums up in the tasks that run
anyway, so nothing is read twice. `Stages` gives the counts of a batch job, `StageListener` those of each batch of streams, to
hooks and as the table that reports read: (query, batch, stage, rows, metrics).
"""

from __future__ import annotations

import logging
import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = "query string, batch long, stage string, rows long, metrics map<string,double>"
ROWS = "rows"


def _taken(metrics: dict[str, Column]) -> list[Column]:
    if ROWS in metrics:
        raise ValueError(f"{ROWS!r} is counted at every stage")
    return [F.count(F.lit(1)).alias(ROWS), *(c.cast("double").alias(name) for name, c in metrics.items())]


def _record(query: str | None, batch: int | None, stage: str, found: dict) -> tuple:
    metrics = {k: v for k, v in found.items() if k != ROWS and v is not None}
    return query, batch, stage, int(found.get(ROWS) or 0), metrics


def call(hooks: list[Callable], record: tuple) -> None:
    """Hand a record to hooks in their order; one that fails is logged and keeps nothing from the others."""
    for hook in hooks:
        try:
            hook(dict(zip(("query", "batch", "stage", "rows", "metrics"), record, strict=True)))
        except Exception:  # noqa: BLE001  a hook's failure is its own
            logging.getLogger(__name__).exception("a hook of stage %s failed", record[2])


class Stages:
    """Stages of a batch job. Each is counted by the first action over it; `counts` waits for that."""

    def __init__(self, hooks: list[Callable] | None = None):
        self.hooks, self.observed = hooks or [], {}

    def watch(self, df: DataFrame, stage: str, **metrics: Column) -> DataFrame:
        """`df`, counted at this place, with more metrics (aggregates); a stage has its name once."""
        if stage in self.observed:
            raise ValueError(f"a stage is called {stage} already")
        self.observed[stage] = Observation(stage)
        return df.observe(self.observed[stage], *_taken(metrics))

    def counts(self, spark: SparkSession) -> DataFrame:
        records = [_record(None, None, stage, own.get) for stage, own in self.observed.items()]
        for record in records:
            call(self.hooks, record)
        return spark.createDataFrame(records, SCHEMA)


def watch(stream: DataFrame, stage: str, **metrics: Column) -> DataFrame:
    """A streaming DataFrame, counted at this place in each batch; a stage has its name once in its query."""
    return stream.observe(stage, *_taken(metrics))


class StageListener(StreamingQueryListener):
    """Counts of the stages of streams, batch by batch: `spark.streams.addListener(listener)` before they start.

    hooks get each record as it comes, on Spark's thread for listeners. At most `keep` records are held, the oldest go.
    """

    def __init__(self, hooks: list[Callable] | None = None, keep: int = 100_000):
        self.hooks, self.keep, self.records, self.ended = hooks or [], keep, [], {}
        self.lock = threading.Condition()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        progress = event.progress
        for stage, row in (progress.observedMetrics or {}).items():
            record = _record(str(progress.id), progress.batchId, stage, row.asDict())
            with self.lock:
                self.records = [*self.records, record][-self.keep :]
            call(self.hooks, record)

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        with self.lock:
            self.ended[str(event.id)] = event.exception
            self.lock.notify_all()

    def wait(self, query: str, seconds: float = 60) -> bool:
        """Whether all of a query that has ended was heard within some seconds."""
        with self.lock:
            return self.lock.wait_for(lambda: str(query) in self.ended, seconds)

    def counts(self, spark: SparkSession, query: str | None = None) -> DataFrame:
        """What was heard so far, of one query or of all."""
        with self.lock:
            records = [r for r in self.records if query is None or r[0] == str(query)]
        return spark.createDataFrame(records, SCHEMA)


def totals(counts: DataFrame) -> DataFrame:
    """(stage, batches, rows) over all batches."""
    return counts.groupBy("stage").agg(F.count("*").alias("batches"), F.sum("rows").alias("rows"))
