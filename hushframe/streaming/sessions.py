"""Streams of text chunks sanitised with the vault of their session.

State is keyed by the session, so that all its streams share tokens: two people never have one, and one never has two. It is
held in maps: surfaces with their tokens, of which a batch writes the new ones alone; the open streams, each with its held
back tail; and chunks that wait for one before them. A stream without an end is closed by a timer once it has been silent
for long enough: its tail goes out, sanitised, and its state goes.

The state store must be RocksDB's, which keeps maps; `use_state_store` sets it for streams that a session starts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from hushframe.functions import scalars
from hushframe.operators.vault import Vault
from hushframe.streaming.chunks import Sanitizer

#: Rows that a task gives back at a time.
ROWS = 1000
SCHEMA = "session string, stream long, seq long, emitted string, tokens string, closed string, trailer string"
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)


class _Open:
    """A stream that hasn't ended: the number of the chunk that follows, what is held back, and when it was last heard of."""

    def __init__(self, following: int, raw: str, seen: int):
        self.following, self.raw, self.seen = following, raw, seen


class SessionSanitizer(StatefulProcessor):
    """A session's streams; idle_ms: silence after which a stream is closed (None: never), by event time or by the clock; ttl_ms: how long a vault is kept unused."""

    def __init__(self, idle_ms: int | None, ttl_ms: int | None, by_event: bool = False):
        self.idle_ms, self.ttl_ms, self.by_event = idle_ms, ttl_ms, by_event

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.surfaces = handle.getMapState("surfaces", "surface string", "token string, place long", self.ttl_ms)
        self.streams = handle.getMapState("streams", "stream long", "following long, raw string, seen long")
        self.waiting = handle.getMapState("waiting", "stream long, seq long", "chunk string, last boolean, trailer string")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        place = len(list(self.surfaces.keys())) if self.surfaces.exists() else 0
        for row in initialState.itertuples(index=False):
            self.surfaces.updateValue((row.surface,), (row.placeholder, int(row.place) + place))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        vault, opened, out = self._vault(), {}, []
        held = len(vault.order)
        # What the state holds is asked once a batch: a question a chunk would cost more than its work.
        stored = {stream for (stream,) in list(self.streams.keys())} if self.streams.exists() else set()
        ahead = {(int(s), int(n)) for s, n in list(self.waiting.keys())} if self.waiting.exists() else set()
        for part in rows:
            ordered = part.sort_values(["stream", "seq"], kind="stable")
            for stream, seq, chunk, last, heard, trailer in zip(*(ordered[c].tolist() for c in ("stream", "seq", "chunk", "last", "at", "trailer")), strict=True):
                stream, seq, last = int(stream), int(seq), bool(last)
                at = opened.get(stream) or (self._stream(stream) if stream in stored else _Open(0, "", 0))
                opened[stream] = at
                at.seen = max(at.seen, int(heard))
                chunk, trailer = chunk if isinstance(chunk, str) else "", trailer if isinstance(trailer, str) else None
                if seq > at.following:
                    if (stream, seq) not in ahead:
                        self.waiting.updateValue((stream, seq), (chunk, last, trailer))
                        ahead.add((stream, seq))
                while seq == at.following:
                    machine = Sanitizer(at.raw, vault)
                    shown = machine.feed(chunk, last)
                    at.raw, at.following = machine.raw, seq + 1
                    out.append(self._row(key, stream, seq, shown, vault, held, "last" if last else None, trailer))
                    held = len(vault.order)
                    if last:
                        if stream in stored:
                            self.streams.removeKey((stream,))
                            stored.discard(stream)
                        del opened[stream]
                        break
                    if (stream, seq + 1) in ahead:
                        seq += 1
                        ahead.discard((stream, seq))
                        chunk, last, trailer = self.waiting.getValue((stream, seq))
                        self.waiting.removeKey((stream, seq))
                if len(out) >= ROWS:
                    yield _frame(out)
                    out = []
        for stream, at in opened.items():
            self.streams.updateValue((stream,), (at.following, at.raw, at.seen))
        if self.idle_ms is not None and opened:
            # One timer, for the first that falls silent; it sets the next. One a stream would read the vault and all streams for each.
            self.handle.registerTimer(min(at.seen for at in opened.values()) + self.idle_ms)
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        clock = timerValues.getCurrentWatermarkInMs() if self.by_event else timerValues.getCurrentProcessingTimeInMs()
        due = max(expiredTimerInfo.getExpiryTimeInMs(), clock) - self.idle_ms
        silent, later = [], None
        for (stream,), (following, raw, seen) in self.streams.iterator() if self.streams.exists() else ():
            if seen <= due:
                silent.append((seen, stream, following, raw))
            else:
                later = seen if later is None else min(seen, later)
        if later is not None:
            self.handle.registerTimer(later + self.idle_ms)
        if not silent:
            return
        # Chunks whose forerunner never came follow in their order.
        gone, rest = {stream for _, stream, _, _ in silent}, {}
        for (stream, seq), (chunk, _, _) in self.waiting.iterator() if self.waiting.exists() else ():
            if stream in gone:
                rest.setdefault(stream, []).append((seq, chunk))
        vault, out = self._vault(), []
        held = len(vault.order)
        for _, stream, following, raw in sorted(silent):
            waited = sorted(rest.get(stream, ()))
            shown = Sanitizer(raw, vault).feed("".join(chunk for _, chunk in waited), True)
            out.append(self._row(key, stream, max([following, *(seq + 1 for seq, _ in waited)]), shown, vault, held, "idle"))
            held = len(vault.order)
            self.streams.removeKey((stream,))
            for seq, _ in waited:
                self.waiting.removeKey((stream, seq))
            if len(out) >= ROWS:
                yield _frame(out)
                out = []
        yield _frame(out)

    def _vault(self) -> Vault:
        vault = Vault()
        known = sorted((place, surface, token) for (surface,), (token, place) in self.surfaces.iterator()) if self.surfaces.exists() else []
        for _, surface, token in known:
            vault.hold(surface, token)
        return vault

    def _stream(self, stream: int) -> _Open:
        return _Open(*self.streams.getValue((stream,)))

    def _row(self, key, stream: int, seq: int, shown: str, vault: Vault, held: int, closed: str | None, trailer: str | None = None) -> tuple:
        """A row of the result; surfaces that the vault holds beyond the first `held` are new and are written down."""
        news = [(surface, vault.by_surface[surface]) for surface in vault.order[held:]]
        for place, (surface, token) in enumerate(news, held):
            self.surfaces.updateValue((surface,), (token, place))
        return (key[0], stream, seq, shown, json.dumps(dict(news), ensure_ascii=False) if news else None, closed, trailer)


def _frame(out: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(out, columns=["session", "stream", "seq", "emitted", "tokens", "closed", "trailer"]).astype({"stream": "int64", "seq": "int64"})


def sanitize_stream(chunks: DataFrame, idle: str | None = None, delay: str = "0 seconds", vault: DataFrame | None = None, ttl: str | None = None) -> DataFrame:
    """Streaming chunks(session, stream, seq, chunk, last) to (session, stream, seq, emitted, tokens, closed, trailer): seq from 0 without holes.

    emitted: what can be shown now that this chunk has come. tokens: surfaces met for the first time in the session, with
    their tokens, as JSON, null without any. closed: 'last' with the last chunk, 'idle' in the row that a timer adds. trailer: that of
    the chunk, as it came, where chunks have such a column; null else.
    idle: silence after which a stream without an end is closed, by the event time of a column `ts` whose watermark lags by `delay`, or by the
    clock if there is none; rows later than the watermark are dropped by the stream, so `delay` must cover the lag of the
    source. vault: entities(session, placeholder, canonical, aliases) that sessions know from the start, as of `vault_table`.
    ttl: how long after its last change a surface is remembered, by the clock alone. Null sessions, streams and chunks: one session,
    one stream, an empty chunk; a repeated chunk counts once.
    """
    by_event = idle is not None and "ts" in chunks.columns
    mode = "EventTime" if by_event else "ProcessingTime" if idle or ttl else "None"
    if ttl and by_event:
        raise ValueError("a ttl goes by the clock, so it can't stand beside event time")
    rows = chunks.withWatermark("ts", delay) if by_event else chunks
    at = F.unix_millis("ts") if by_event else F.unix_millis(F.current_timestamp())
    trailer = F.col("trailer").cast("string") if "trailer" in chunks.columns else F.lit(None).cast("string")
    columns = [F.col("session").cast("string").alias("session"), F.coalesce(F.col("stream").cast("long"), F.lit(-1)).alias("stream"), F.col("seq").cast("long").alias("seq")]
    rows = rows.select(*columns, F.col("chunk").cast("string").alias("chunk"), F.coalesce("last", F.lit(False)).alias("last"), at.alias("at"), trailer.alias("trailer"), *(["ts"] if by_event else []))
    processor = SessionSanitizer(_millis(idle), _millis(ttl), by_event)
    initial = None if vault is None else _surfaces(vault).groupBy("session")
    return rows.groupBy("session").transformWithStateInPandas(processor, SCHEMA, "append", mode, initial)


def _surfaces(vault: DataFrame) -> DataFrame:
    """(session, surface, placeholder, place) of a vault: canonical surfaces before aliases, tokens by number."""
    none = F.array().cast("array<string>")
    every = F.posexplode(F.array_distinct(F.concat(F.array("canonical"), F.coalesce("aliases", none)))).alias("nth", "surface")
    number = F.regexp_extract("placeholder", r"_(\d+)>>$", 1).cast("long")
    rows = vault.select(F.col("session").cast("string").alias("session"), "placeholder", every, number.alias("number"))
    return rows.filter("surface <> ''").select("session", "surface", "placeholder", (F.col("nth") * F.lit(1 << 40) + F.col("number")).alias("place"))


def _millis(interval: str | None) -> int | None:
    """Milliseconds of an interval as '5 minutes'."""
    return None if interval is None else int(pd.Timedelta(interval).total_seconds() * 1000)


def known_tokens(out: DataFrame) -> DataFrame:
    """(session, surface, placeholder) of all that `sanitize_stream` emitted so far."""
    return out.select("session", F.explode(F.from_json("tokens", "map<string,string>")).alias("surface", "placeholder"))


def canonical_tokens(out: DataFrame) -> DataFrame:
    """(session, placeholder, canonical) for restoring: of a token's surfaces the one that came first."""
    first = F.min_by("surface", F.struct("stream", "seq", "nth"))
    rows = out.select("session", "stream", "seq", F.posexplode(F.map_entries(F.from_json("tokens", "map<string,string>"))).alias("nth", "e"))
    rows = rows.select("session", "stream", "seq", "nth", F.col("e.key").alias("surface"), F.col("e.value").alias("placeholder"))
    return rows.groupBy("session", "placeholder").agg(first.alias("canonical"))


#: Tools whose polls of a running session go on in the next, and what the key of such a stream begins with (fixed values).
POLLED, RUNNING = ("exec", "write_stdin"), "exec_session:"


def sanitize_polls(results: DataFrame, **how) -> DataFrame:
    """Streaming results of tools that tell their output bit by bit to what a model may be shown: (session, stream, seq, shown, emitted, tokens, trailer).

    results: (session, tool, call_id, session_id, stream_id, seq, result), seq from 0 without holes within each stream; a stream is
    named as `scalars.stream_key` does. Status lines at the end of a result stand apart, so that they cut no entity, and are put back as
    they were. Only a session that is still running holds its end back; any other result ends its stream, and one of no stream is one of
    its own. A result that is null has no output. how: as of `sanitize_stream`.
    """
    result = F.coalesce("result", F.lit(""))
    key = scalars.stream_key(F.col("tool"), F.col("call_id"), F.col("session_id"), F.col("stream_id"), result)
    alone = F.xxhash64(F.lit("alone"), "session", "seq", result)
    parts = scalars.output_and_trailer(result)
    holds = F.col("tool").isin(*POLLED) & key.startswith(RUNNING) & scalars.stream_live(result)
    held = F.coalesce(holds, F.lit(False))
    rest = ["ts"] if "ts" in results.columns else []
    columns = ("session", F.when(key.isNull(), alone).otherwise(F.xxhash64(key)).alias("stream"), F.when(key.isNull(), 0).otherwise(F.col("seq")).alias("seq"))
    chunks = results.select(*columns, parts["output"].alias("chunk"), (~held).alias("last"), parts["trailer"].alias("trailer"), *rest)
    out = sanitize_stream(chunks, **how)
    both = (F.coalesce("trailer", F.lit("")) != "") & (F.col("emitted") != "")
    shown = F.concat("emitted", F.when(both, "\n").otherwise(""), F.coalesce("trailer", F.lit("")))
    return out.select("session", "stream", "seq", shown.alias("shown"), "emitted", "tokens", "trailer")
