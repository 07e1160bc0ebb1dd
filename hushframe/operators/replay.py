"""Transcripts replayed: the lines of a session, each an event, folded to the messages that a reader sees.

A thread is a list of messages, of which only the last ones can still change: the answer that is being streamed, the last
message while reasoning goes on, and the traces of work of the turn. `Thread` takes one event at a time; what an event may
touch is found from marks that the thread keeps, not by reading messages again. A transcript is bounded by the size that
`files.read_transcripts` takes (8 MB), so a session is one group, and sessions are spread over tasks.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Version of the payload, endings of media, tools that edit files, order of a call's phases.
SCHEMA_VERSION = 3
IMAGE_ENDINGS = (".png", ".jpg", ".jpeg", ".webp", ".gif", ".svg")
VIDEO_ENDINGS = (".mp4", ".mov", ".webm")
EDIT_TOOLS = ("write_file", "edit_file", "apply_patch")
PHASES = {"start": 1, "end": 2, "error": 3}

_MEDIA = "array<struct<kind:string,url:string,name:string>>"
SCHEMA = (
    "session string, n long, line long, role string, kind string, content string, reasoning string, segment string, traces array<string>, "
    f"tool_events string, file_edits string, media {_MEDIA}, apps string, presets string, latency_ms long"
)


@dataclass
class Message:
    role: str
    line: int
    content: str = ""
    trace: bool = False
    reasoning: str | None = None
    segment: int | None = None
    traces: list[str] = field(default_factory=list)
    seen: set[str] = field(default_factory=set)  # the same lines, to be asked
    events: dict[str, dict] = field(default_factory=dict)
    edits: dict[str, dict] = field(default_factory=dict)
    media: list[dict] = field(default_factory=list)
    apps: list[dict] = field(default_factory=list)
    presets: list[dict] = field(default_factory=list)
    latency: int | None = None
    #: Whether its answer, and its reasoning, may still grow.
    streaming: bool = False
    thinking: bool = False

    def only_reasoning(self) -> bool:
        """Whether it holds reasoning that has ended, and no answer (yet)."""
        return self.role == "assistant" and not self.content.strip() and bool(self.reasoning) and not self.thinking and not self.media


def media_kind(name: str) -> str:
    low = name.lower()
    return "image" if low.endswith(IMAGE_ENDINGS) else "video" if low.endswith(VIDEO_ENDINGS) else "file"


def _dicts(value) -> list[dict]:
    return [dict(x) for x in value if isinstance(x, dict)] if isinstance(value, list) else []


def _text(value) -> str | None:
    return value if isinstance(value, str) and value else None


def _tool(event: dict) -> str | None:
    inner = event.get("function")
    return (_text(inner.get("name")) if isinstance(inner, dict) else None) or _text(event.get("name"))


def trace_line(event: dict) -> str | None:
    """A call as a line: name(arguments)."""
    name, inner = _tool(event), event.get("function")
    if name is None:
        return None
    given = (inner.get("arguments") if isinstance(inner, dict) else None) or event.get("arguments")
    if isinstance(given, str) and given.strip():
        return f"{name}({given})"
    return f"{name}({json.dumps(given, ensure_ascii=False)})" if given and isinstance(given, dict) else f"{name}()"


def trace_lines(events: list[dict]) -> list[str]:
    """Lines of calls, one a call id, in order."""
    first: dict = {}
    for i, event in enumerate(events):
        first.setdefault(_text(event.get("call_id")) or i, trace_line(event))
    return [line for line in first.values() if line]


def call_key(event: dict) -> str:
    """What tells calls apart: their id, else their line."""
    own = _text(event.get("call_id"))
    return f"id {own}" if own else trace_line(event) or json.dumps(event, sort_keys=True)


def edit_key(edit: dict) -> str:
    """What tells edits of files apart: call and tool, or tool and path where the call has no id."""
    call, tool = str(edit.get("call_id") or ""), str(edit.get("tool") or "")
    return f"{call}|{tool}" if call else f"{tool}|{edit.get('path') or ''}"


def edit_of_call(event: dict) -> str | None:
    """Key of the edit that a call of an editing tool makes."""
    call = _text(event.get("call_id"))
    name = _text(event.get("name")) or _tool(event)
    return f"{call}|{name}" if call and name in EDIT_TOOLS else None


class Thread:
    """The messages of a session, event by event."""

    def __init__(self, user_media=None, assistant_media=None):
        self.messages: list[Message] = []
        self.user_media, self.assistant_media = user_media, assistant_media
        self.turn = 0  # where the messages after the last one of a user begin
        self.answer: Message | None = None  # the one that chunks of an answer go to
        self.parts: list[str] = []
        self.muted = False  # a complete answer with media came: what follows up to the end of the turn repeats it
        self.work: int | None = None  # the segment that traces go to
        self.editing: int | None = None  # the segment that edits of files go to
        self.segments = 0
        self.settled = 0  # messages before have seen the end of a turn
        self.thinkers: list[Message] = []  # those whose reasoning was opened, latest last
        self.edited: set[str] = set()  # keys of all edits, by which calls that only repeat one are left out

    def take(self, line: int, record: dict) -> None:
        """Fold one event; unknown ones, and those without what they need, change nothing."""
        handler = self._EVENTS.get(record.get("event")) if isinstance(record.get("event"), str) else None
        if handler is not None:
            handler(self, line, record)

    def done(self) -> list[Message]:
        return self.messages

    # What events have in common

    def _last(self) -> Message | None:
        return self.messages[-1] if self.messages else None

    def _add(self, message: Message) -> Message:
        self.messages.append(message)
        return message

    def _of_turn(self):
        """Messages since the user's last one, latest first."""
        return reversed(self.messages[self.turn :])

    def _segment(self) -> int:
        self.segments += 1
        return self.segments

    def _working(self) -> int:
        if self.work is None:
            self.work = self._segment()
        return self.work

    def _close_segments(self) -> None:
        self.work = self.editing = None

    def _end_answer(self) -> None:
        self.answer, self.parts = None, []

    def _interrupt(self, segment: int) -> None:
        """Work begins: an answer that was being streamed turns out to have been reasoning."""
        open_ = (m for m in self._of_turn() if m.role == "assistant" and m.streaming and m.content.strip() and not m.media)
        found = next(open_, None)
        if found is None:
            return
        found.reasoning = "\n\n".join(p for p in (found.reasoning, found.content) if p and p.strip())
        found.content, found.streaming, found.thinking = "", False, False
        found.segment = found.segment or segment
        if found is self.answer:
            self._end_answer()

    def _think(self, line: int, chunk: str) -> None:
        """Reasoning goes to the last message if that is an answer or reasoning already, else to a new one."""
        if self.editing is not None:
            self._close_segments()
        last = self._last()
        if last is None or last.role != "assistant" or not (last.thinking or last.reasoning is not None or last.content or last.streaming):
            last = self._add(Message("assistant", line, streaming=True))
        if not last.thinking:
            self.thinkers.append(last)
        last.reasoning, last.thinking = (last.reasoning or "") + chunk, True
        last.segment = last.segment or self._working()

    def _end_thinking(self) -> None:
        while self.thinkers:
            found = self.thinkers.pop()
            if found.thinking:
                found.thinking = False
                return

    # Events

    def _user(self, line: int, record: dict) -> None:
        self._close_segments()
        paths = record.get("media_paths")
        paths = [str(p) for p in paths if p] if isinstance(paths, list) else []
        media = self.user_media(paths) if paths and self.user_media else []
        self._add(Message("user", line, _text(record.get("text")) or "", media=media or [], apps=_dicts(record.get("cli_apps")), presets=_dicts(record.get("mcp_presets"))))
        self.turn = len(self.messages)

    def _delta(self, line: int, record: dict) -> None:
        chunk = record.get("text")
        if self.muted or not isinstance(chunk, str):
            return
        self._close_segments()
        if self.answer is None:
            last = self._last()
            waiting = last is not None and last.role == "assistant" and last.streaming and not last.content
            self.answer = last if waiting else self._add(Message("assistant", line))
        self.parts.append(chunk)
        self.answer.content, self.answer.streaming = "".join(self.parts), True

    def _stream_end(self, line: int, record: dict) -> None:
        whole = record.get("text")
        if not self.muted and isinstance(whole, str):
            answer = self.answer or self._add(Message("assistant", line))
            answer.content, answer.streaming = whole, True
        self._end_answer()

    def _reasoning_delta(self, line: int, record: dict) -> None:
        chunk = _text(record.get("text"))
        if not self.muted and chunk:
            self._think(line, chunk)

    def _reasoning_end(self, line: int, record: dict) -> None:
        if not self.muted:
            self._end_thinking()

    def _message(self, line: int, record: dict) -> None:
        kind = record.get("kind")
        if kind in ("reasoning", "tool_hint", "progress"):
            if self.muted:
                return
            if kind != "reasoning":
                self._hint(line, record)
            elif _text(record.get("text")):
                self._think(line, record["text"])
                self._end_thinking()
            return
        self._end_answer()
        paths = record.get("media")
        paths = [p for p in paths if isinstance(p, str) and p] if isinstance(paths, list) else []
        if paths and self.assistant_media:
            media = self.assistant_media(paths) or []
        else:
            named = [(str(m["url"]), str(m.get("name") or "")) for m in _dicts(record.get("media_urls")) if m.get("url")]
            media = [{"kind": media_kind(name), "url": url, "name": name} for url, name in named]
        last = self._last()
        answer = last if last is not None and last.only_reasoning() else self._add(Message("assistant", line))
        answer.content, answer.streaming, answer.thinking = _text(record.get("text")) or "", False, False
        answer.media = media or answer.media
        answer.latency = _latency(record, answer.latency)
        self._close_segments()
        self.muted = self.muted or bool(media)

    def _hint(self, line: int, record: dict) -> None:
        """A trace of work: calls of tools, or a line of text where no call is named."""
        calls = [e for e in _dicts(record.get("tool_events")) if e.get("phase") in PHASES and (isinstance(e.get("name"), str) or _tool(e))]
        shown = [e for e in calls if edit_of_call(e) not in self.edited]
        lines = trace_lines(shown)
        plain = not lines
        if plain and not calls and _text(record.get("text")):
            lines = [record["text"]]
        if not lines:
            return
        segment = self._working()
        self._interrupt(segment)
        last = self._last()
        if last is not None and last.trace and last.segment in (None, segment):
            if not last.traces:
                last.traces, last.seen = [last.content], {last.content}
            last.segment = segment
        else:
            last = self._add(Message("tool", line, trace=True, segment=segment))
        # Calls are told once each, lines of text whenever they come.
        last.traces += lines if plain else [x for x in dict.fromkeys(lines) if x not in last.seen]
        last.seen.update(lines)
        last.content = last.traces[-1]
        for event in shown:
            key = call_key(event)
            known = last.events.get(key)
            if known is None or PHASES[event["phase"]] >= PHASES.get(known.get("phase"), 0):
                last.events[key] = {**(known or {}), **event}

    def _file_edit(self, line: int, record: dict) -> None:
        edits = _dicts(record.get("edits"))
        if not edits:
            return
        self.editing = self.editing or self._segment()
        self._interrupt(self.editing)
        keys = {edit_key(e) for e in edits}
        traces = (m for m in self._of_turn() if m.trace)
        target = next((m for m in traces if m.segment == self.editing or keys & m.edits.keys() or any(edit_of_call(e) in keys for e in m.events.values())), None)
        if target is None:
            target = self._add(Message("tool", line, trace=True, segment=self.editing))
        else:
            self.editing = target.segment = target.segment or self.editing
            # The calls that made these edits are told by the edits from now on.
            covered = {k: e for k, e in target.events.items() if edit_of_call(e) in keys}
            if covered:
                gone = set(trace_lines(list(covered.values())))
                target.events = {k: e for k, e in target.events.items() if k not in covered}
                target.traces = [x for x in target.traces or ([target.content] if target.content else []) if x not in gone]
                target.content, target.seen = target.traces[-1] if target.traces else "", set(target.traces)
        for edit in edits:
            key = edit_key(edit)
            known = target.edits.get(key)
            merged = {**(known or {}), **edit}
            if known is not None and edit.get("path") and not edit.get("pending"):
                merged.pop("pending", None)
            target.edits[key] = merged
        self.edited |= keys

    def _turn_end(self, line: int, record: dict) -> None:
        self.muted = False
        self._close_segments()
        self._end_answer()
        open_ = self.messages[self.settled :]
        for m in open_:
            m.streaming = False
        following = [*open_[1:], None]
        kept = [m for m, after in zip(open_, following, strict=False) if not m.only_reasoning() or (after is not None and after.trace)]
        self.messages[self.settled :] = kept
        users = [i for i, m in enumerate(kept, self.settled) if m.role == "user"]
        self.turn = users[-1] + 1 if users else self.turn
        self.settled = len(self.messages)
        latency = _latency(record, None)
        last = next((m for m in reversed(self.messages) if m.role == "assistant"), None)
        if latency is not None and last is not None:
            last.latency = latency

    _EVENTS = {
        "user": _user, "delta": _delta, "stream_end": _stream_end, "reasoning_delta": _reasoning_delta, "reasoning_end": _reasoning_end,
        "message": _message, "file_edit": _file_edit, "turn_end": _turn_end,
    }


def _latency(record: dict, other: int | None) -> int | None:
    value = record.get("latency_ms")
    return int(value) if isinstance(value, int | float) and value >= 0 else other


def replay(lines: DataFrame, user_media: Callable | None = None, assistant_media: Callable | None = None, assistant_text: Callable | None = None) -> DataFrame:
    """Messages of transcripts: lines(session, line_no, line) to rows of SCHEMA, n from 0 in each session.

    line: a JSON object as text; lines that are none are left out. role: user, assistant or tool; kind: 'trace' for work,
    else null. segment groups what one piece of work brought. tool_events, file_edits, apps and presets are JSON arrays, null without any.
    user_media, assistant_media: paths to attachments (dicts of kind, url, name); assistant_text: rewrites an answer. Null
    sessions are one session; lines of equal number keep the order of their text; events of one call are one event, the
    latest phase on top. An empty table gives no rows.
    """

    def fold(rows: pa.Table) -> pa.Table:
        thread, out = Thread(user_media, assistant_media), []
        ordered = sorted(rows.to_pylist(), key=lambda r: (r["line_no"] is None, r["line_no"] or 0, r["line"] or ""))
        for row in ordered:
            try:
                record = json.loads(row["line"] or "")
            except ValueError:
                continue
            if isinstance(record, dict):
                thread.take(row["line_no"], record)
        for n, m in enumerate(thread.done()):
            shown = assistant_text(m.content) if assistant_text and m.role == "assistant" else m.content
            out.append(
                {
                    "session": ordered[0]["session"], "n": n, "line": m.line, "role": m.role, "kind": "trace" if m.trace else None, "content": shown,
                    "reasoning": m.reasoning, "segment": f"activity-{m.segment}" if m.segment else None, "traces": m.traces if m.trace else None,
                    "tool_events": _json(m.events.values()), "file_edits": _json(m.edits.values()),
                    "media": [{k: x.get(k) for k in ("kind", "url", "name")} for x in m.media] or None,
                    "apps": _json(m.apps), "presets": _json(m.presets), "latency_ms": m.latency,
                }
            )
        return pa.Table.from_pylist(out, schema=_arrow_schema())

    rows = lines.select(F.col("session").cast("string").alias("session"), F.col("line_no").cast("long").alias("line_no"), F.col("line").cast("string").alias("line"))
    return rows.groupBy("session").applyInArrow(fold, SCHEMA)


def _json(items) -> str | None:
    items = list(items)
    return json.dumps(items, ensure_ascii=False) if items else None


def _arrow_schema() -> pa.Schema:
    text, number = pa.string(), pa.int64()
    media = pa.list_(pa.struct([("kind", text), ("url", text), ("name", text)]))
    kinds = {"n": number, "line": number, "traces": pa.list_(text), "media": media, "latency_ms": number}
    names = "session n line role kind content reasoning segment traces tool_events file_edits media apps presets latency_ms".split()
    return pa.schema([(name, kinds.get(name, text)) for name in names])


def images(media: Column) -> Column:
    """The attachments of a user's message as images (url, name), if all of them are."""
    every = (F.size(media) > 0) & F.forall(media, lambda m: m["kind"] == "image")
    return F.when(every, F.transform(media, lambda m: F.struct(m["url"].alias("url"), m["name"].alias("name"))))


def threads(messages: DataFrame) -> DataFrame:
    """The payload of each session: (session, schema_version, messages), the messages in order."""
    rest = [c for c in messages.columns if c not in ("session", "n")]
    ordered = F.array_sort(F.collect_list(F.struct("n", *[c for c in rest if c != "media"], "media")))
    return messages.groupBy("session").agg(F.lit(SCHEMA_VERSION).alias("schema_version"), ordered.alias("messages"))
