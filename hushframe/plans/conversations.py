"""Queries: windows over conversations and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from hushframe.functions import grammar
from hushframe.operators import history, report
from hushframe.plans.registry import query
from hushframe.sources.tables import table

_TOKENS = "greatest(4, floor(length(coalesce(text, '')) / 4) + 4)::INTEGER"
_COLLAPSED = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"


def _messages(spark, sf_dir):
    return table(spark, sf_dir, "conversations")


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


@query("history_tail", """WITH last AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations),
cut AS (SELECT *, min(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS f FROM last WHERE r <= 5)
SELECT conv_id, turn, role FROM cut WHERE f IS NULL OR turn >= f""")
def history_tail(spark, sf_dir):
    return history.tail(_messages(spark, sf_dir), "conv_id", "turn", 5).select("conv_id", "turn", "role")


@query("token_budget", f"""WITH t AS (SELECT conv_id, turn, {_TOKENS} AS tokens FROM conversations),
r AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS running, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM t)
SELECT conv_id, turn, tokens, running::BIGINT AS running FROM r WHERE running <= 200 OR k = 1""")
def token_budget(spark, sf_dir):
    return history.budget(_messages(spark, sf_dir), "conv_id", "turn", grammar.token_estimate(F.col("text")), 200).select("conv_id", "turn", "tokens", "running")


@query("consolidation_boundary", f"""WITH t AS (SELECT conv_id, turn, role, coalesce(sum({_TOKENS}) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b,
    min(turn) OVER (PARTITION BY conv_id) AS f FROM conversations)
SELECT conv_id, coalesce(min(CASE WHEN b >= 150 THEN turn END), max(turn)) AS boundary FROM t WHERE role = 'user' AND turn > f GROUP BY conv_id""")
def consolidation_boundary(spark, sf_dir):
    return history.boundary(_messages(spark, sf_dir), "conv_id", "turn", grammar.token_estimate(F.col("text")), 150)


@query("retain_suffix", """WITH last AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations),
cut AS (SELECT *, min(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS f FROM last WHERE r <= 4)
SELECT conv_id, total, count(*) AS kept, min(turn) AS first_kept, total - count(*) AS dropped FROM cut WHERE f IS NULL OR turn >= f GROUP BY conv_id, total""")
def retain_suffix(spark, sf_dir):
    return history.suffix_counts(_messages(spark, sf_dir), "conv_id", "turn", 4)


@query("session_list_preview", f"""SELECT conv_id, left({_COLLAPSED.format("coalesce(arg_min(text, turn) FILTER (role = 'user'), arg_min(text, turn) FILTER (role = 'assistant'))")}, 60) AS preview,
    max(turn) AS last_turn, count(*) AS messages FROM conversations GROUP BY conv_id""")
def session_list_preview(spark, sf_dir):
    return history.previews(_messages(spark, sf_dir), "conv_id", "turn")


@query("dedup_outbound", f"""WITH f AS (SELECT conv_id, role, turn, sha1({_COLLAPSED.format('text')}) AS fingerprint FROM conversations)
SELECT conv_id, turn, fingerprint, coalesce(fingerprint = lag(fingerprint) OVER (PARTITION BY conv_id, role ORDER BY turn), false) AS suppressed FROM f""")
def dedup_outbound(spark, sf_dir):
    return history.suppress_repeats(_messages(spark, sf_dir), ["conv_id", "role"], ["turn"], "text").select("conv_id", "turn", "fingerprint", "suppressed")


@query("microcompact", """WITH r AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id, role = 'assistant' ORDER BY turn DESC) AS k FROM conversations)
SELECT conv_id, turn, CASE WHEN role = 'assistant' AND k > 1 AND length(text) >= 100 THEN '[cleared]' ELSE text END AS compacted FROM r""")
def microcompact(spark, sf_dir):
    return history.microcompact(_messages(spark, sf_dir), "conv_id", "turn", F.col("role") == "assistant", "text", keep=1, least=100).select("conv_id", "turn", "compacted")


@query("orphan_results", """SELECT conv_id, turn FROM conversations c WHERE role = 'assistant' AND NOT EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id = c.conv_id AND d.turn = c.turn - 1 AND d.role = 'user' AND length(d.text) > 60)""")
def orphan_results(spark, sf_dir):
    """Answers whose question right before them is missing (here: too short to be a call)."""
    is_call = (F.col("role") == "user") & (F.length("text") > 60)
    return history.orphans(_messages(spark, sf_dir), "conv_id", "turn", F.col("role") == "assistant", is_call).select("conv_id", "turn")


@query("archive_lines", """SELECT conv_id, string_agg('[' || turn || '] ' || upper(role) || ': ' || left(text, 40), chr(10) ORDER BY turn) AS archive FROM conversations GROUP BY conv_id""")
def archive_lines(spark, sf_dir):
    """A session's messages as lines for the archive."""
    line = F.concat(F.lit("["), F.col("turn").cast("string"), F.lit("] "), F.upper("role"), F.lit(": "), F.left("text", F.lit(40)))
    ordered = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    return _messages(spark, sf_dir).groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("archive"))


@query("coalesce_runs", """WITH m AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS new FROM events),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM m)
SELECT user_id, run::BIGINT AS run, event_type, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM r GROUP BY ALL""")
def coalesce_runs(spark, sf_dir):
    found = history.runs(_events(spark, sf_dir), "user_id", ["ts", "event_id"], F.col("event_type"))
    return found.groupBy("user_id", "run", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("joined_deltas", """WITH e AS (SELECT *, event_type || event_id % 10 AS piece, event_type = 'purchase' AS ends FROM events), m AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER w AND NOT lag(ends) OVER w THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM m) SELECT user_id, run::BIGINT AS run, string_agg(piece, '' ORDER BY event_id) AS piece, count(*) AS parts FROM r GROUP BY user_id, run""")
def joined_deltas(spark, sf_dir):
    """Deltas to one target joined, until another target comes or the stream ends."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.concat("event_type", (F.col("event_id") % 10).cast("string")).alias("piece"))
    return history.joined_runs(rows, "user_id", ["event_id"], F.col("event_type"), "piece", F.col("event_type") == "purchase")


@query("tool_batches", """WITH s AS (SELECT *, event_type IN ('view', 'click') AS safe FROM events), m AS (SELECT *, CASE WHEN safe AND lag(safe) OVER w THEN 0 ELSE 1 END AS new FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS batch FROM m)
SELECT user_id, batch::BIGINT AS batch, bool_and(safe) AS parallel, count(*) AS n FROM r GROUP BY user_id, batch""")
def tool_batches(spark, sf_dir):
    """Calls that may run at once are one batch while nothing else comes between; any other call is a batch of its own."""
    safe = F.col("event_type").isin("view", "click")
    # a call that isn't safe never equals its neighbour
    same = F.when(safe, F.lit("safe")).otherwise(F.col("event_id").cast("string"))
    found = history.runs(_events(spark, sf_dir).withColumn("safe", safe), "user_id", ["ts", "event_id"], same)
    return found.groupBy("user_id", F.col("run").alias("batch")).agg(F.bool_and("safe").alias("parallel"), F.count("*").alias("n"))


_RANK = "CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 ELSE 0 END"


@query("latest_by_phase", f"SELECT user_id, arg_max(event_id, ({_RANK}, event_id)) AS event_id, arg_max(event_type, ({_RANK}, event_id)) AS event_type, arg_max(value, ({_RANK}, event_id)) AS value FROM events GROUP BY user_id")
def latest_by_phase(spark, sf_dir):
    kind = F.col("event_type")
    rank = F.when(kind == "error", 3).when(kind == "purchase", 2).when(kind == "click", 1).otherwise(0)
    return history.latest(_events(spark, sf_dir), ["user_id"], rank, "event_id", ["event_id", "event_type", "value"])


@query("event_sequence", "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INTEGER AS sequence FROM events")
def event_sequence(spark, sf_dir):
    return report.sequence(_events(spark, sf_dir), "user_id", ["ts", "event_id"]).select("event_id", "user_id", "sequence")


_TRACED = """e AS (SELECT event_id, user_id AS session, event_id % 4 AS turn, 't' || user_id || '-' || event_id % 4 AS trace, 'turn.' || event_type || '.done' AS kind, event_id % 5 AS sequence, ts, CASE WHEN event_id % 3 > 0 THEN floor(value * 10)::BIGINT END AS ms FROM events)"""


def _traced(spark, sf_dir):
    """Events as those of turns, numbered anew out of the order of time."""
    key = F.col("event_id")
    turn = key % 4
    trace = F.concat(F.lit("t"), F.col("user_id").cast("string"), F.lit("-"), turn.cast("string"))
    kind = F.concat(F.lit("turn."), "event_type", F.lit(".done"))
    ms = F.when(key % 3 > 0, F.floor(F.col("value") * 10).cast("long"))
    return _events(spark, sf_dir).select("event_id", F.col("user_id").alias("session"), turn.alias("turn"), trace.alias("trace_id"), kind.alias("event_type"), (key % 5).alias("sequence"), F.col("ts").alias("timestamp"), ms.alias("duration_ms"))


@query("event_replay", f"""WITH {_TRACED} SELECT event_id, row_number() OVER (PARTITION BY session ORDER BY sequence, ts)::INTEGER AS of_session, row_number() OVER (PARTITION BY trace ORDER BY sequence, ts)::INTEGER AS of_trace, row_number() OVER (PARTITION BY session, turn ORDER BY sequence, ts)::INTEGER AS of_turn FROM e""")
def event_replay(spark, sf_dir):
    """The place of each event in the replay of its session, its trace and its turn."""
    rows = _traced(spark, sf_dir)
    for name, scope in (("of_session", ["session"]), ("of_trace", ["trace_id"]), ("of_turn", ["session", "turn"])):
        rows = report.replay(rows, scope).withColumnRenamed("place", name)
    return rows.select("event_id", "of_session", "of_trace", "of_turn")


@query("turn_timelines", f"""WITH {_TRACED}, k AS (SELECT session, turn, kind, arg_max(ms, (sequence, ts)) AS ms FROM e WHERE ms IS NOT NULL GROUP BY ALL), s AS (SELECT session, turn, string_agg(string_split(kind, '.')[2] || '=' || ms, ',' ORDER BY kind) AS stages FROM k GROUP BY ALL),
w AS (SELECT session, turn, min(trace) AS trace_id, count(*) AS events, greatest(0, (epoch_us(arg_max(ts, (sequence, ts))) // 1000) - (epoch_us(arg_min(ts, (sequence, ts))) // 1000)) AS total_duration_ms FROM e GROUP BY ALL)
SELECT session, turn, trace_id, events, total_duration_ms, coalesce(stages, '') AS stages FROM w LEFT JOIN s USING (session, turn)""")
def turn_timelines(spark, sf_dir):
    """Turns as the replay of their events tells them: how long in all, and each stage."""
    out = report.turn_timelines(_traced(spark, sf_dir), ["session", "turn"])
    entries = F.array_sort(F.map_entries("stage_durations_ms"))
    stages = F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return out.select("session", "turn", "trace_id", "events", "total_duration_ms", stages.alias("stages"))


@query("placeholder_spans", f"""WITH t AS (SELECT conv_id, turn, '<<PERSON_' || turn || '>>' || coalesce(text, '') || '<<A_B_12>> <<ORG_' || conv_id || '>>' AS text, length(coalesce(text, '')) AS n, length('<<PERSON_' || turn || '>>') AS a, length('<<ORG_' || conv_id || '>>') AS b FROM conversations)
SELECT conv_id, turn, '0-' || a || ',' || (a + n) || '-' || (a + n + 10) || ',' || (a + n + 11) || '-' || (a + n + 11 + b) AS spans FROM t""")
def placeholder_spans(spark, sf_dir):
    """Where tokens stand in messages, at their ends and side by side."""
    token = lambda tag, c: F.concat(F.lit(f"<<{tag}_"), F.col(c).cast("string"), F.lit(">>"))
    text = F.concat(token("PERSON", "turn"), F.coalesce("text", F.lit("")), F.lit("<<A_B_12>> "), token("ORG", "conv_id"))
    spans = F.transform(grammar.spans(text), lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string")))
    return _messages(spark, sf_dir).select("conv_id", "turn", F.array_join(spans, ",").alias("spans"))


@query("event_durations", """WITH s AS (SELECT *, last_value(CASE WHEN event_type = 'view' THEN {'id': event_id, 'ts': ts} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS st FROM events)
SELECT user_id, event_id AS end_id, st.id AS start_id, greatest(0, (epoch_us(ts) // 1000) - (epoch_us(st.ts) // 1000)) AS duration_ms FROM s WHERE event_type = 'purchase' AND st IS NOT NULL""")
def event_durations(spark, sf_dir):
    return report.durations(_events(spark, sf_dir), "user_id", "view", "purchase", "ts", "event_id", "event_type")


@query("turn_timeline", """WITH s AS (SELECT *, 'privacy.' || event_type || CASE WHEN event_id % 2 = 0 THEN '.completed' ELSE '.failed' END AS t FROM events)
SELECT user_id, string_split(t, '.')[-2] AS stage, arg_max(value, event_id) AS duration, count(*) AS n FROM s GROUP BY ALL""")
def turn_timeline(spark, sf_dir):
    dotted = F.concat(F.lit("privacy."), "event_type", F.when(F.col("event_id") % 2 == 0, F.lit(".completed")).otherwise(F.lit(".failed")))
    return report.timeline(_events(spark, sf_dir).withColumn("kind", dotted), ["user_id"], "kind", "value", "event_id")


@query("stage_counts", """SELECT event_type AS stage, count(*) AS n, count(*) FILTER (value > 10) AS succeeded, min(event_id) AS first_id, max(event_id) AS last_id,
    (epoch_us(arg_max(ts, event_id)) // 1000) - (epoch_us(arg_min(ts, event_id)) // 1000) AS span_ms FROM events GROUP BY event_type""")
def stage_counts(spark, sf_dir):
    span = F.unix_millis(F.max_by("ts", "event_id")) - F.unix_millis(F.min_by("ts", "event_id"))
    return _events(spark, sf_dir).groupBy(F.col("event_type").alias("stage")).agg(F.count("*").alias("n"), F.count_if(F.col("value") > 10).alias("succeeded"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), span.alias("span_ms"))


@query("idle_sessions", """SELECT user_id, epoch_us(TIMESTAMP '2024-01-31') // 1000 - (epoch_us(max(ts)) // 1000) AS idle_ms, count(*) AS events FROM events GROUP BY user_id HAVING epoch_us(TIMESTAMP '2024-01-31') // 1000 - (epoch_us(max(ts)) // 1000) >= 240 * 60000""")
def idle_sessions(spark, sf_dir):
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    return history.idle(_events(spark, sf_dir), "user_id", "ts", now, 240).select("user_id", "idle_ms", "events")


@query("session_gaps", """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM g)
SELECT user_id, (epoch_us(min(ts)) // 1000) AS first_ms, (epoch_us(max(ts)) // 1000) AS last_ms, count(*) AS n, round(sum(value), 2) AS total FROM r GROUP BY user_id, s""")
def session_gaps(spark, sf_dir):
    """Sessions that end after six idle hours, by the session window of event time."""
    found = _events(spark, sf_dir).groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.unix_millis(F.min("ts")).alias("first_ms"), F.unix_millis(F.max("ts")).alias("last_ms"), F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return found.drop("session_window")


@query("cron_next_run", """WITH j AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'at' ELSE 'every' END AS kind, (epoch_us(ts) // 1000) AS at_ms, (value * 1000)::BIGINT AS every_ms FROM events), n AS (SELECT epoch_us(TIMESTAMP '2024-01-15') // 1000 AS now_ms)
SELECT event_id, CASE WHEN kind = 'at' AND at_ms > now_ms THEN at_ms WHEN kind = 'every' AND every_ms > 0 THEN now_ms + every_ms END AS next_run_ms FROM j, n WHERE (kind = 'at' AND at_ms > now_ms) OR (kind = 'every' AND every_ms > 0)""")
def cron_next_run(spark, sf_dir):
    kind = F.when(F.col("event_id") % 2 == 0, F.lit("at")).otherwise(F.lit("every"))
    now = F.unix_millis(F.lit("2024-01-15 00:00:00").cast("timestamp"))
    return _events(spark, sf_dir).select("event_id", history.next_run(kind, F.unix_millis("ts"), F.round(F.col("value") * 1000).cast("long"), now).alias("next_run_ms")).filter("next_run_ms is not null")


@query("incremental_scan", "SELECT event_id, event_type FROM events WHERE event_id > (SELECT max(event_id) // 2 FROM events)")
def incremental_scan(spark, sf_dir):
    """What a reader at a cursor hasn't seen: the cursor is a value, so the filter reaches the scan."""
    events = _events(spark, sf_dir)
    cursor = events.agg(F.max("event_id")).first()[0] or 0
    return events.filter(F.col("event_id") > cursor // 2).select("event_id", "event_type")
