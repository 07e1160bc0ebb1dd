"""Events out and to those who asked for them: a sink that takes each event once, and a fan-out by subscriptions.

`events` is a format for streams and tables to write to: a task writes a file of its own and tells its name; the commit of a
batch writes a list of them under the batch's number. Readers take what lists name, so a batch that is run again, after whatever failure,
replaces its list and counts once, and files of tasks that failed count for nothing.
"""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.streaming import DataStreamWriter

from hushframe.sources.storage import put_json, storage

#: Subscriptions up to so many are broadcast (some MB); more are joined by shuffle.
BROADCAST_SUBSCRIPTIONS = 50_000
#: What a subscription to all kinds of events names.
EVERY = "*"


@dataclass
class Written(WriterCommitMessage):
    """The file a task wrote, none if it had no rows."""

    file: str | None
    rows: int


def _write(path: str, batches: Iterator[pa.RecordBatch]) -> Written:
    files, inner = storage(path)
    name, rows, writer = f"{uuid.uuid4().hex}.parquet", 0, None
    try:
        for batch in batches:
            if writer is None and batch.num_rows:
                files.create_dir(f"{inner}/data", recursive=True)
                writer = pq.ParquetWriter(f"{inner}/data/{name}", batch.schema, filesystem=files)
            if batch.num_rows:
                writer.write_batch(batch)
                rows += batch.num_rows
    finally:
        if writer is not None:
            writer.close()
    return Written(name if rows else None, rows)


def _drop(path: str, messages) -> None:
    files, inner = storage(path)
    for message in messages:
        if message is not None and message.file:
            files.delete_file(f"{inner}/data/{message.file}")


def _list(messages) -> dict:
    return {"files": sorted(m.file for m in messages if m is not None and m.file), "rows": sum(m.rows for m in messages if m is not None)}


class StreamSink(DataSourceStreamArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return _write(self.path, iterator)

    def commit(self, messages, batchId: int) -> None:  # noqa: N803
        put_json(f"{self.path}/commits", f"{batchId:012d}.json", _list(messages))

    def abort(self, messages, batchId: int) -> None:  # noqa: N803
        _drop(self.path, messages)


class TableSink(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return _write(self.path, iterator)

    def commit(self, messages) -> None:
        if self.overwrite:
            files, inner = storage(self.path)
            files.create_dir(f"{inner}/commits", recursive=True)
            files.delete_dir_contents(f"{inner}/commits")
        put_json(f"{self.path}/commits", f"table-{uuid.uuid4().hex}.json", _list(messages))

    def abort(self, messages) -> None:
        _drop(self.path, messages)


class EventSource(DataSource):
    """The format `events`; its one option is the path, a folder that the driver and all executors reach."""

    @classmethod
    def name(cls) -> str:
        return "events"

    def streamWriter(self, schema, overwrite: bool) -> StreamSink:  # noqa: N802
        return StreamSink(self.options["path"])

    def writer(self, schema, overwrite: bool) -> TableSink:
        return TableSink(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EventSource)


def write_events(stream: DataFrame, path: str, state: str) -> DataStreamWriter:
    """A streaming query, not started, that writes events to the sink at `path`; state: its checkpoint folder."""
    register(stream.sparkSession)
    return stream.writeStream.format("events").option("path", path).option("checkpointLocation", state)


def committed(spark: SparkSession, path: str) -> DataFrame:
    """(batch, files, rows) of the sink's lists."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("batch")
    return spark.read.schema("files array<string>, rows long").json(f"{path}/commits").select(name, "files", "rows")


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    """Events of committed batches, each once; a sink without any has no rows."""
    files, inner = storage(path)
    there = files.get_file_info(f"{inner}/commits").type == FileType.Directory
    # Names of files alone come to the driver, as they do when Spark lists a folder.
    names = [f"{path}/data/{r.file}" for r in committed(spark, path).select(F.explode("files").alias("file")).distinct().collect()] if there else []
    return spark.read.schema(schema).parquet(*names) if names else spark.createDataFrame([], schema)


def fan_out(events: DataFrame, subscriptions: DataFrame, event_type: str = "event_type") -> DataFrame:
    """Each event (of a table or stream) once for each subscription that asks for its kind or for all: adds subscriber and place.

    subscriptions(subscriber, event_type, place): a null event_type asks for all kinds; place is the order of registration.
    A subscriber with several fitting subscriptions gets the event once for each. Events of null kind go to those who ask for all.
    """
    asked = subscriptions.select("subscriber", "place", F.coalesce("event_type", F.lit(EVERY)).alias("_asked"))
    if asked.count() <= BROADCAST_SUBSCRIPTIONS:
        asked = F.broadcast(asked)
    # An event is looked up under its kind and under that of all, so that one equality join finds both.
    keys = F.explode(F.array_distinct(F.array(F.coalesce(F.col(event_type), F.lit(EVERY)), F.lit(EVERY)))).alias("_key")
    rows = events.select("*", keys)
    return rows.join(asked, F.col("_key") == F.col("_asked")).drop("_key", "_asked")


def deliver(stream: DataFrame, handlers: list[tuple[str | None, Callable[[DataFrame, int], None]]], event_type: str = "event_type") -> DataStreamWriter:
    """A streaming query, not started, that hands each batch to handlers in their order: handler(events of its kind, batch number).

    A handler is registered with a kind of event, or None for all. One that fails is logged and doesn't keep events from the others.
    """

    def batch(events: DataFrame, number: int) -> None:
        events.persist()
        try:
            for kind, handler in handlers:
                try:
                    handler(events if kind is None else events.filter(F.col(event_type) == kind), number)
                except Exception:  # noqa: BLE001  a handler's failure is its own
                    logging.getLogger(__name__).exception("a handler of %s failed", kind or "all events")
        finally:
            events.unpersist()

    return stream.writeStream.foreachBatch(batch)
