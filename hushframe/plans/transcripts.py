"""Queries: transcripts of conversations and of events, replayed to messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from hushframe.operators import replay
from hushframe.plans.registry import query
from hushframe.sources.tables import table

#: Characters of a chunk of an answer.
PIECE = 60


def _lines(turns):
    """Turns (session, turn, records array of JSON texts) as lines of transcripts."""
    rows = turns.select("session", "turn", F.posexplode("records").alias("k", "line"))
    return rows.select("session", (F.col("turn") * 10_000 + F.col("k")).alias("line_no"), "line")


def _record(event: str, **fields):
    values = [c.alias(name) for name, c in fields.items()]
    return F.to_json(F.struct(F.lit(event).alias("event"), *values))


def _pieces(text):
    """A text as chunks of an answer."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(text) - 1), F.lit(PIECE))
    return F.transform(starts, lambda i: _record("delta", text=F.substring(text, i + 1, F.lit(PIECE))))


def _conversation_lines(spark, sf_dir):
    """Conversations as their transcripts would be; an answer comes in one of four ways, by conversation and turn."""
    text, turn = F.coalesce("text", F.lit("")), F.col("turn")
    head, tail = F.left(text, F.lit(9)), F.substring(text, F.lit(10), F.lit(20))
    end, over = _record("stream_end"), _record("turn_end", latency_ms=turn * 10)
    says = lambda kind, said: _record("message", kind=F.lit(kind), text=said)
    edit = lambda path, phase, pending: F.struct(
        F.lit("c1").alias("call_id"), F.lit("write_file").alias("tool"), F.lit(path).alias("path"), F.lit(phase).alias("phase"), F.lit(pending).alias("pending")
    )
    file_edit = lambda *edits: _record("file_edit", edits=F.array(*edits))
    call = lambda phase: _record(
        "message", kind=F.lit("progress"), text=F.lit(""),
        tool_events=F.array(F.struct(F.lit("c1").alias("call_id"), F.lit("write_file").alias("name"), F.lit(phase).alias("phase"))),
    )
    thought = F.concat(F.array(_record("reasoning_delta", text=head), _record("reasoning_delta", text=tail), _record("reasoning_end")), _pieces(text), F.array(end, over))
    looked = F.concat(
        F.array(_record("delta", text=F.lit("Let me ")), _record("delta", text=F.lit("look.")), end, says("tool_hint", F.concat(F.lit("grep("), head, F.lit(")"))), says("progress", F.lit("step 2"))),
        _pieces(text),
        F.array(_record("stream_end", text=F.concat(text, F.lit("!"))), over),
    )
    edited = F.array(
        call("start"), file_edit(edit("", "start", True)), call("end"), says("reasoning", F.lit("Check.")),
        file_edit(edit("f.txt", "end", None)), _record("message", text=text), over,
    )
    media = F.array(F.struct(F.lit("/m/1").alias("url"), F.lit("Clip.MP4").alias("name")))
    shown = F.concat(F.array(_record("message", text=text, media_urls=media)), _pieces(text), F.array(says("progress", F.lit("late")), end, over))
    kind = (F.col("conv_id") + turn) % 4
    answer = F.when(kind == 0, thought).when(kind == 1, looked).when(kind == 2, edited).otherwise(shown)
    records = F.when(F.col("role") == "user", F.array(_record("user", text=text), _record("unheard of"), F.lit("no json"))).otherwise(answer)
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("session"), turn, records.alias("records"))
    return _lines(turns)


@query("transcript_messages", """WITH c AS (SELECT *, CASE WHEN role = 'user' THEN -1 ELSE (conv_id + turn) % 4 END AS kind, coalesce(text, '') AS t FROM conversations),
m AS (SELECT conv_id, turn, 0 AS k, 'user' AS role, NULL AS shape, t AS content, NULL AS reasoning, NULL AS traces, NULL AS phase, NULL AS media, NULL AS latency_ms FROM c WHERE kind = -1
UNION ALL SELECT conv_id, turn, 0, 'assistant', NULL, t, CASE WHEN t = '' THEN NULL ELSE left(t, 9) || substr(t, 10, 20) END, NULL, NULL, NULL, turn * 10 FROM c WHERE kind = 0
UNION ALL SELECT conv_id, turn, 0, 'assistant', NULL, '', 'Let me look.', NULL, NULL, NULL, NULL FROM c WHERE kind = 1
UNION ALL SELECT conv_id, turn, 1, 'tool', 'trace', 'step 2', NULL, 'grep(' || left(t, 9) || ')|step 2', NULL, NULL, NULL FROM c WHERE kind = 1
UNION ALL SELECT conv_id, turn, 2, 'assistant', NULL, t || '!', NULL, NULL, NULL, NULL, turn * 10 FROM c WHERE kind = 1
UNION ALL SELECT conv_id, turn, 0, 'tool', 'trace', '', NULL, '', 'end f.txt', NULL, NULL FROM c WHERE kind = 2
UNION ALL SELECT conv_id, turn, 1, 'assistant', NULL, t, 'Check.', NULL, NULL, NULL, turn * 10 FROM c WHERE kind = 2
UNION ALL SELECT conv_id, turn, 0, 'assistant', NULL, t, NULL, NULL, NULL, 'video /m/1', turn * 10 FROM c WHERE kind = 3)
SELECT conv_id::VARCHAR AS session, row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) - 1 AS n, role, shape AS kind, content, reasoning, traces, phase, media, latency_ms FROM m""")
def transcript_messages(spark, sf_dir):
    """Transcripts of conversations replayed: chunks joined, reasoning kept apart, interrupted answers set back, edits of a file as one, repeats muted."""
    out = replay.replay(_conversation_lines(spark, sf_dir))
    edit = F.from_json("file_edits", "array<struct<phase:string,path:string,pending:boolean>>")
    media = F.transform("media", lambda m: F.concat_ws(" ", m["kind"], m["url"]))
    one = F.when(F.size(edit) == 1, F.concat_ws(" ", edit[0]["phase"], edit[0]["path"], F.when(edit[0]["pending"], F.lit("pending"))))
    columns = ("session", "n", "role", "kind", "content", "reasoning", F.array_join("traces", "|").alias("traces"), one.alias("phase"))
    return out.select(*columns, F.array_join(media, "|").alias("media"), "latency_ms")


@query("transcript_calls", """WITH t AS (SELECT user_id, 'e' || event_id % 7 AS call_id, event_type || '(' || props || ')' AS line, event_id, CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 ELSE 1 END AS rank, event_type AS name FROM events),
f AS (SELECT user_id, call_id, max(rank) AS rank FROM t GROUP BY ALL), l AS (SELECT user_id, line, min(event_id) AS first FROM t GROUP BY ALL)
SELECT user_id::VARCHAR AS session, 1::BIGINT AS messages, (SELECT string_agg(line, '|' ORDER BY first) FROM l WHERE l.user_id = f.user_id) AS traces, string_agg(call_id || ':' || rank, ',' ORDER BY call_id) AS phases FROM f GROUP BY user_id""")
def transcript_calls(spark, sf_dir):
    """The events of a user as calls of tools in a transcript: one trace, each line once where it first came, each call at its latest phase."""
    events = table(spark, sf_dir, "events")
    phase = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "end").otherwise("start")
    call = F.struct(F.concat(F.lit("e"), (F.col("event_id") % 7).cast("string")).alias("call_id"), F.col("event_type").alias("name"), phase.alias("phase"), F.col("props").alias("arguments"))
    line = _record("message", kind=F.lit("progress"), text=F.lit(""), tool_events=F.array(call))
    out = replay.replay(events.select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("line_no"), line.alias("line")))
    rank = lambda e: F.concat_ws(":", e["call_id"], F.when(e["phase"] == "error", "3").when(e["phase"] == "end", "2").otherwise("1"))
    calls = F.from_json("tool_events", "array<struct<call_id:string,phase:string>>")
    shown = out.select("session", F.array_join("traces", "|").alias("traces"), F.array_join(F.array_sort(F.transform(calls, rank)), ",").alias("phases"))
    return shown.groupBy("session").agg(F.count("*").alias("messages"), F.max("traces").alias("traces"), F.max("phases").alias("phases"))


@query("transcript_threads", """SELECT conv_id::VARCHAR AS session, 3 AS schema_version, sum(CASE WHEN role = 'user' THEN 1 WHEN (conv_id + turn) % 4 = 1 THEN 3 WHEN (conv_id + turn) % 4 = 2 THEN 2 ELSE 1 END)::BIGINT AS messages,
    sum(length(coalesce(text, '')) + CASE WHEN role <> 'user' AND (conv_id + turn) % 4 = 1 THEN 7 ELSE 0 END)::BIGINT AS chars FROM conversations GROUP BY conv_id""")
def transcript_threads(spark, sf_dir):
    """The payload of each conversation: version and messages in order."""
    out = replay.threads(replay.replay(_conversation_lines(spark, sf_dir)))
    chars = F.aggregate("messages", F.lit(0).cast("long"), lambda n, m: n + F.length(m["content"]))
    return out.select("session", "schema_version", F.size("messages").cast("long").alias("messages"), chars.alias("chars"))
