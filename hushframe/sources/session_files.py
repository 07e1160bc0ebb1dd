"""The format `sessions`: a folder of session files as a table, read by tasks that take some files each.

A session's file is named after it, `<session>.jsonl`, or lies in a folder `session=<session>`. A filter on the session goes down to
the listing, so files of other sessions are never opened; it needs `spark.sql.python.filterPushdown.enabled`, which `read` sets.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, StringStartsWith

from hushframe.sources.storage import files_below, read_text, storage

#: Bytes of files that a task reads, each file counted with so many besides for its opening; a larger file is one task's.
TASK_BYTES, OPEN_BYTES = 64 << 20, 128 << 10
#: Rows of a batch that a task gives back.
ROWS = 5000
SCHEMA = (
    "session string, idx long, role string, content string, timestamp string, tool_call_id string, name string, "
    "tool_calls array<struct<id:string,name:string>>, created_at string, updated_at string, last_consolidated long, broken long"
)
_FIELDS = ("role", "content", "timestamp", "tool_call_id", "name")


@dataclass
class Files(InputPartition):
    """Files that one task reads: (session, path)."""

    files: list[tuple[str, str]]


def session_of(path: str) -> str:
    """The session that a file belongs to; files of one folder `session=...` are parts of one session."""
    folder = re.search(r"/session=([^/]+)/[^/]+$", path)
    return unquote(folder[1]) if folder else re.sub(r"\.jsonl?$", "", path.rsplit("/", 1)[-1])


def parse(text: str) -> tuple[list[dict], dict, int]:
    """Messages of a session file, its metadata line (empty without one), and how many lines are no JSON object."""
    messages, metadata, broken = [], {}, 0
    for line in text.split("\n"):
        if not line.strip():
            continue
        try:
            record = json.loads(line)
        except ValueError:
            record = None
        if not isinstance(record, dict):
            broken += 1
        elif record.get("_type") == "metadata":
            metadata = record
        elif isinstance(record.get("role"), str):
            messages.append(record)
    return messages, metadata, broken


def _text(value) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _calls(value) -> list[dict] | None:
    if not isinstance(value, list):
        return None
    named = lambda c: c.get("name") or (c.get("function") or {}).get("name")
    return [{"id": _text(c.get("id")), "name": _text(named(c))} for c in value if isinstance(c, dict)]


class SessionReader(DataSourceReader):
    def __init__(self, path: str, task_bytes: int):
        self.path, self.task_bytes, self.only, self.prefix = path, task_bytes, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Filters on the session choose files; all others are left to Spark."""
        for f in filters:
            if getattr(f, "attribute", None) != ("session",):
                yield f
            elif isinstance(f, EqualTo | EqualNullSafe):
                self._keep({f.value})
            elif isinstance(f, In):
                self._keep(set(f.value))
            elif isinstance(f, StringStartsWith):
                self.prefix = f.value
                yield f
            else:
                yield f

    def _keep(self, sessions: set) -> None:
        self.only = sessions if self.only is None else self.only & sessions

    def partitions(self) -> list[Files]:
        """Files by session, whole sessions to a task, as many as its bytes allow."""
        found: dict[str, list[tuple[str, int]]] = {}
        for path, size in files_below(self.path, "") if self.only is None or self.only else []:
            name = path.rsplit("/", 1)[-1]
            if name.endswith((".jsonl", ".json")) and not name.startswith((".", "_")):
                session = session_of(path)
                if (self.only is None or session in self.only) and (self.prefix is None or session.startswith(self.prefix)):
                    found.setdefault(session, []).append((path, size))
        tasks, held = [], self.task_bytes
        for session in sorted(found):
            size = sum(n + OPEN_BYTES for _, n in found[session])
            if held + size > self.task_bytes:
                tasks.append(Files([]))
                held = 0
            held += size
            tasks[-1].files += [(session, path) for path, _ in found[session]]
        return tasks or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        files, _ = storage(self.path)
        rows, idx, before = [], 0, None
        for session, path in partition.files:
            messages, metadata, broken = parse(read_text(files, path))
            idx = idx if session == before else 0
            before = session
            shared = {k: _text(metadata.get(k)) for k in ("created_at", "updated_at")}
            last = metadata.get("last_consolidated")
            for m in messages:
                row = {"session": session, "idx": idx, "tool_calls": _calls(m.get("tool_calls")), "broken": broken, **shared}
                row["last_consolidated"] = last if isinstance(last, int) else None
                rows.append(row | {k: _text(m.get(k)) for k in _FIELDS})
                idx += 1
                if len(rows) >= ROWS:
                    yield pa.RecordBatch.from_pylist(rows, schema=_arrow())
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_arrow())


def _arrow() -> pa.Schema:
    text, number = pa.string(), pa.int64()
    kinds = {"idx": number, "tool_calls": pa.list_(pa.struct([("id", text), ("name", text)])), "last_consolidated": number, "broken": number}
    names = ("session", "idx", *_FIELDS, "tool_calls", "created_at", "updated_at", "last_consolidated", "broken")
    return pa.schema([(n, kinds.get(n, text)) for n in names])


class SessionSource(DataSource):
    """The format `sessions`; options: path, and task_bytes."""

    @classmethod
    def name(cls) -> str:
        return "sessions"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SessionReader:
        return SessionReader(self.options["path"], int(self.options.get("task_bytes", TASK_BYTES)))


def read(spark: SparkSession, path: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Messages of a folder of sessions: idx from 0 in file order, with what the file's metadata line says and how many of its lines are broken."""
    spark.dataSource.register(SessionSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("sessions").option("path", path).option("task_bytes", task_bytes).load()
