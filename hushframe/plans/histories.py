"""Queries: what of long conversations is replayed, kept, archived and shown."""

from __future__ import annotations

from pyspark.sql import functions as F

from hushframe.functions import grammar
from hushframe.operators import history
from hushframe.plans.registry import query
from hushframe.sources.tables import table

#: Conversations with tool calls: every third turn is a result, of which some name a call that was never made. Turns of a few
#: conversations are put together, so that sessions are longer than the windows.
_MESSAGES = """raw AS (SELECT conv_id // 6 AS s, (conv_id % 6) * 100 + turn AS o, CASE WHEN (conv_id + turn) % 3 = 2 THEN 'tool' ELSE role END AS role, length(text) // 20 + 4 AS tokens FROM conversations),
m AS (SELECT s, (row_number() OVER (PARTITION BY s ORDER BY o) - 1)::INTEGER AS idx, role, tokens, o FROM raw),
msgs AS (SELECT s, idx, role, tokens, CASE WHEN role = 'assistant' THEN ['k' || o, 'k' || (o + 3)] ELSE [] END AS calls, CASE WHEN role = 'tool' THEN 'k' || (o - 1 - (o % 5) // 4) END AS call_id FROM m)"""


def _messages(spark, sf_dir):
    raw = table(spark, sf_dir, "conversations")
    order = (F.col("conv_id") % 6) * 100 + F.col("turn")
    role = F.when((F.col("conv_id") + F.col("turn")) % 3 == 2, F.lit("tool")).otherwise(F.col("role"))
    m = raw.select(F.floor(F.col("conv_id") / 6).alias("s"), order.alias("o"), role.alias("role"), (F.floor(F.length("text") / 20) + 4).alias("tokens"))
    name = lambda n: F.concat(F.lit("k"), n.cast("string"))
    calls = F.when(F.col("role") == "assistant", F.array(name(F.col("o")), name(F.col("o") + 3))).otherwise(F.array().cast("array<string>"))
    call_id = F.when(F.col("role") == "tool", name(F.col("o") - 1 - F.floor((F.col("o") % 5) / 4)))
    return history.indexed(m, "s", "o").select("s", "idx", "role", "tokens", calls.alias("calls"), call_id.alias("call_id"))


def _legal(name: str, source: str) -> str:
    """CTEs that walk each session of `source`(s, p from 1, idx, role, tokens, calls, call_id) and give its legal start: name(s, start)."""
    return f"""{name}_w AS (SELECT s, 0::BIGINT AS p, []::VARCHAR[] AS declared, 0::BIGINT AS start FROM (SELECT DISTINCT s FROM {source}) UNION ALL
    SELECT w.s, x.p, CASE WHEN x.role = 'tool' AND x.call_id IS NOT NULL AND NOT list_contains(w.declared, x.call_id) THEN [] WHEN x.role = 'assistant' THEN list_concat(w.declared, x.calls) ELSE w.declared END,
    CASE WHEN x.role = 'tool' AND x.call_id IS NOT NULL AND NOT list_contains(w.declared, x.call_id) THEN x.p ELSE w.start END FROM {name}_w w JOIN {source} x ON x.s = w.s AND x.p = w.p + 1),
{name} AS (SELECT s, arg_max(start, p) AS start FROM {name}_w GROUP BY s)"""


def _after(name: str, source: str, first: str) -> str:
    """source cut to rows from `first`(s, at) on, numbered anew."""
    return f"{name} AS (SELECT x.* EXCLUDE (p), row_number() OVER (PARTITION BY x.s ORDER BY idx) AS p FROM {source} x JOIN {first} f ON f.s = x.s WHERE x.p > f.at)"


def _replay_sql(n: int, tokens: int) -> str:
    user = lambda name, source: f"{name} AS (SELECT s, coalesce(min(p) FILTER (role = 'user'), 1) - 1 AS at FROM {source} GROUP BY s)"
    return f"""{_MESSAGES}, a AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY idx) AS p FROM msgs QUALIFY row_number() OVER (PARTITION BY s ORDER BY idx DESC) <= {n}),
{user('u1', 'a')}, {_after('b', 'a', 'u1')}, {_legal('l1', 'b')}, l1a AS (SELECT s, start AS at FROM l1), {_after('c', 'b', 'l1a')},
r AS (SELECT *, sum(tokens) OVER (PARTITION BY s ORDER BY idx DESC) AS used, row_number() OVER (PARTITION BY s ORDER BY idx DESC) AS back FROM c),
k AS (SELECT s, count(*) AS total, count(*) FILTER (used <= {tokens} OR back = 1) AS kept, min(p) FILTER (role = 'user' AND (used <= {tokens} OR back = 1)) AS user_in, max(p) FILTER (role = 'user') AS last_user FROM r GROUP BY s),
k2 AS (SELECT s, coalesce(user_in, last_user, total - kept + 1) - 1 AS at FROM k), {_after('d', 'c', 'k2')}, {_legal('l2', 'd')}, l2a AS (SELECT s, start AS at FROM l2), {_after('e', 'd', 'l2a')}"""


@query("replay_window", f"WITH RECURSIVE {_replay_sql(12, 60)} SELECT s, idx, role FROM e")
def replay_window(spark, sf_dir):
    """The messages of each session that are replayed: count, user, legality and budget together."""
    return history.replay(_messages(spark, sf_dir), "s", 12, 60).select("s", "idx", "role")


@query("replay_overflow", f"WITH RECURSIVE {_replay_sql(12, 2**62)}, z AS (SELECT s, count(*) AS n FROM msgs GROUP BY s HAVING count(*) > 12), f AS (SELECT s, min(idx) AS first FROM e GROUP BY s) SELECT s, coalesce(first, n)::INTEGER AS boundary FROM z LEFT JOIN f USING (s) WHERE coalesce(first, n) > 0")
def replay_overflow(spark, sf_dir):
    return history.replay_overflow(_messages(spark, sf_dir), "s", 12)


def _suffix_sql(n: int) -> str:
    return f"""{_MESSAGES}, z AS (SELECT *, count(*) OVER (PARTITION BY s) AS n, row_number() OVER (PARTITION BY s ORDER BY idx DESC) AS back, max(CASE WHEN role = 'user' THEN idx END) OVER (PARTITION BY s) AS last_user FROM msgs),
y AS (SELECT *, max(CASE WHEN back <= {n} AND role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY s) AS has FROM z),
a AS (SELECT s, idx, role, tokens, calls, call_id, row_number() OVER (PARTITION BY s ORDER BY idx) AS p FROM y WHERE n > {n} AND CASE WHEN has = 1 OR last_user IS NULL THEN back <= {n} ELSE idx >= last_user AND idx < last_user + {n} END),
u AS (SELECT s, coalesce(min(p) FILTER (role = 'user'), 1) - 1 AS at FROM a GROUP BY s), {_after('b', 'a', 'u')}, {_legal('l', 'b')}, la AS (SELECT s, start AS at FROM l), {_after('c', 'b', 'la')},
j AS (SELECT y.s, y.idx, y.n <= {n} OR c.idx IS NOT NULL AS retained, y.idx < 5 AS early FROM y LEFT JOIN c ON c.s = y.s AND c.idx = y.idx)"""


@query("retained_suffix", f"WITH RECURSIVE {_suffix_sql(8)} SELECT s, count(*) FILTER (retained) AS kept, count(*) FILTER (NOT retained) AS dropped, count(*) FILTER (NOT retained AND early) AS already, count(*) FILTER (NOT retained AND NOT early) AS to_archive, count(*) FILTER (retained AND early) AS consolidated FROM j GROUP BY s")
def retained_suffix(spark, sf_dir):
    """Sessions cut to a legal end of 8 messages (idle compaction, and the cap of session files), with what is to be archived."""
    return history.suffix_report(history.legal_suffix(_messages(spark, sf_dir), "s", 8, F.lit(5)), "s")


@query("open_consolidation", f"""WITH {_MESSAGES}, b AS (SELECT s, idx, role, coalesce(sum(tokens) OVER (PARTITION BY s ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM msgs WHERE idx >= 2)
SELECT s, coalesce(min(idx) FILTER (b >= 30), max(idx)) AS boundary, coalesce(arg_min(b, idx) FILTER (b >= 30), arg_max(b, idx))::BIGINT AS removed FROM b WHERE role = 'user' AND idx > 2 GROUP BY s""")
def open_consolidation(spark, sf_dir):
    return history.consolidation(_messages(spark, sf_dir), "s", F.lit(2), F.lit(30))


@query("consolidated_sessions")
def consolidated_sessions(spark, sf_dir):
    """Sessions archived in rounds until they are within their budget (checked against a loop in the tests)."""
    return history.consolidate(_messages(spark, sf_dir), "s", 100, 50)


@query("pruned_sessions", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events WHERE event_type = 'click') WHERE r > 10")
def pruned_sessions(spark, sf_dir):
    """All but the ten latest of each user's: what a pruning removes."""
    return history.oldest(table(spark, sf_dir, "events").filter("event_type = 'click'"), ["user_id"], "event_id", 10).select("user_id", "event_id")


@query("merged_tool_events", """WITH e AS (SELECT user_id, event_id % 4 AS call, event_id, CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS rank, CASE WHEN event_id % 5 > 0 THEN event_type END AS event_type, CASE WHEN event_id % 7 > 0 THEN value END AS value FROM events),
g AS (SELECT *, max(rank) OVER (PARTITION BY user_id, call ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM e)
SELECT user_id, call, arg_max(event_type, event_id) FILTER (event_type IS NOT NULL) AS event_type, arg_max(value, event_id) FILTER (value IS NOT NULL) AS value FROM g WHERE top IS NULL OR rank >= top GROUP BY user_id, call""")
def merged_tool_events(spark, sf_dir):
    """Events of a call merged field by field, later phases beating earlier ones."""
    key = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("user_id", (key % 4).alias("call"), "event_id", F.when(key % 5 > 0, F.col("event_type")).alias("event_type"), F.when(key % 7 > 0, F.col("value")).alias("value"))
    rank = F.when(key % 3 == 0, F.lit(1)).when(key % 3 == 1, F.lit(2)).otherwise(F.lit(3))
    return history.merged_events(rows, ["user_id", "call"], rank, "event_id", ["event_type", "value"])


@query("usage_totals", "SELECT user_id, name, sum(n)::BIGINT AS total FROM (SELECT user_id, 'prompt_tokens' AS name, event_id % 100 AS n FROM events UNION ALL SELECT user_id, event_type, 1 FROM events) GROUP BY ALL")
def usage_totals(spark, sf_dir):
    counters = F.create_map(F.lit("prompt_tokens"), F.col("event_id") % 100, F.col("event_type"), F.lit(1).cast("long"))
    return history.usage(table(spark, sf_dir, "events").select("user_id", counters.alias("usage")), ["user_id"])


@query("line_diffs", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 0 END AS added, CASE p_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 0 END AS deleted FROM part""")
def line_diffs(spark, sf_dir):
    key = F.col("p_partkey") % 4
    before = F.concat(F.lit("first\n"), "p_name", F.lit("\nlast"))
    after = F.when(key == 0, F.concat(before, F.lit("\nmore"))).when(key == 1, F.lit("first\nlast")).when(key == 2, F.lit("first\nother thing entirely\nlast")).otherwise(F.replace(before, F.lit("\n"), F.lit("\r\n")))
    # a line that is cut out and one that is changed; the second text may hold the first's name only where it is the same
    return table(spark, sf_dir, "part").select("p_partkey", history.line_diff(F.when(key == 1, F.concat(F.lit("first\n"), F.lit("gone\n"), F.lit("last"))).otherwise(before), after).alias("d")).select("p_partkey", "d.added", "d.deleted")


@query("paired_artifacts", """WITH l AS (SELECT l_orderkey, l_linenumber AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS i, l_partkey FROM lineitem), r AS (SELECT l_orderkey, i, l_partkey AS other FROM l WHERE i % 2 = 1),
rr AS (SELECT l_orderkey, other, row_number() OVER (PARTITION BY l_orderkey ORDER BY i) AS i FROM r)
SELECT l.l_orderkey, l.i AS o, l.l_partkey, rr.other FROM l LEFT JOIN rr USING (l_orderkey, i)""")
def paired_artifacts(spark, sf_dir):
    """Records and artifacts paired by position, records without one left alone."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    left = table(spark, sf_dir, "lineitem").select("l_orderkey", place.alias("o"), "l_partkey")
    right = left.filter("o % 2 = 1").select("l_orderkey", "o", F.col("l_partkey").alias("other"))
    return history.paired(left, right, ["l_orderkey"], "o")


@query("timeline_payloads", """WITH t AS (SELECT user_id, event_type AS turn, count(*) AS n FROM events GROUP BY ALL), e AS (SELECT user_id, event_type AS turn, string_agg('{"sequence":' || event_id || ',"kind":"' || (event_id % 3) || '"}', ',' ORDER BY event_id) AS ev FROM events GROUP BY ALL),
s AS (SELECT user_id, count(*) AS total FROM events GROUP BY user_id)
SELECT user_id, turn, '{"turn":{"n":' || n || '},"timeline":[' || coalesce(ev, '') || '],"snapshot":{"total":' || total || '}}' AS payload FROM t LEFT JOIN e USING (user_id, turn) JOIN s USING (user_id)""")
def timeline_payloads(spark, sf_dir):
    """A turn, its events and its session's counts nested into one payload."""
    events = table(spark, sf_dir, "events")
    some = events.withColumnRenamed("event_type", "turn")
    each = some.select("user_id", "turn", F.col("event_id").alias("sequence"), (F.col("event_id") % 3).cast("string").alias("kind"))
    counts = events.groupBy("user_id").agg(F.count("*").alias("total"))
    return history.timeline_payload(some.groupBy("user_id", "turn").agg(F.count("*").alias("n")), each, counts, "user_id", "turn")


@query("covered_edits", "SELECT event_id FROM events e WHERE event_type = 'click' AND NOT EXISTS (SELECT 1 FROM events f WHERE f.event_type = 'purchase' AND f.user_id = e.user_id AND f.event_id % 10 = e.event_id % 10)")
def covered_edits(spark, sf_dir):
    """Tool events that no edit of the same call covers (an anti join on the call)."""
    events = table(spark, sf_dir, "events").withColumn("call", F.col("event_id") % 10)
    edits = events.filter("event_type = 'purchase'").select("user_id", "call")
    return events.filter("event_type = 'click'").join(edits, ["user_id", "call"], "left_anti").select("event_id")


@query("token_probe", f"SELECT conv_id, sum(len(regexp_extract_all(text || ' <<PERSON_' || turn || '>> <<X_1>> <<x_2>>', '{grammar.PLACEHOLDER}')))::BIGINT AS n FROM conversations GROUP BY conv_id")
def token_probe(spark, sf_dir):
    """How many tokens the messages of a conversation hold."""
    text = F.concat("text", F.lit(" <<PERSON_"), F.col("turn").cast("string"), F.lit(">> <<X_1>> <<x_2>>"))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(F.regexp_count(text, F.lit(grammar.PLACEHOLDER))).alias("n"))


_CRON = {
    "30 9 * * *": "(d + INTERVAL 570 MINUTE) + CASE WHEN d + INTERVAL 570 MINUTE > t THEN INTERVAL 0 DAY ELSE INTERVAL 1 DAY END",
    "*/15 * * * *": "time_bucket(INTERVAL 15 MINUTE, t) + INTERVAL 15 MINUTE",
    "0 0 1 * *": "date_trunc('month', t) + INTERVAL 1 MONTH",
    "0 8 * * 1-5": "(SELECT min(x) FROM (SELECT d + INTERVAL 8 HOUR + to_days(i::INTEGER) AS x FROM range(0, 8) r(i)) WHERE x > t AND isodow(x) <= 5)",
    "bad": "NULL",
}


@query("cron_runs", f"""WITH e AS (SELECT event_id, ts AS t, date_trunc('day', ts) AS d FROM events) SELECT event_id, CASE event_id % {len(_CRON)} {' '.join(f"WHEN {i} THEN epoch_ms(({sql})::TIMESTAMP)" for i, sql in enumerate(_CRON.values()))} END AS next_run FROM e""")
def cron_runs(spark, sf_dir):
    """Next runs of cron schedules."""
    key = F.col("event_id")
    expr = F.element_at(F.array(*map(F.lit, _CRON)), (key % len(_CRON)).cast("int") + 1)
    return table(spark, sf_dir, "events").select("event_id", history.cron_next(expr, F.unix_millis("ts"), F.lit("UTC")).alias("next_run"))


@query("advanced_jobs", """WITH j AS (SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'at' ELSE 'every' END AS kind, event_id % 5 > 0 AS enabled, event_id AS at_ms, event_id % 50 AS every_ms, event_id % 3 = 0 AS once, event_id AS next_run FROM events), k AS (SELECT *, enabled AND next_run <= 500 AS due FROM j)
SELECT id, enabled AND NOT (due AND kind = 'at') AS enabled, CASE WHEN due AND kind = 'at' THEN NULL WHEN due THEN CASE WHEN every_ms > 0 THEN 500 + every_ms END ELSE next_run END AS next_run FROM k WHERE NOT (due AND kind = 'at' AND once)""")
def advanced_jobs(spark, sf_dir):
    """Jobs after a tick of the timer."""
    key = F.col("event_id")
    kind = F.when(key % 2 == 0, F.lit("at")).otherwise(F.lit("every"))
    jobs = table(spark, sf_dir, "events").select(key.alias("id"), kind.alias("kind"), (key % 5 > 0).alias("enabled"), key.alias("at_ms"), (key % 50).alias("every_ms"), (key % 3 == 0).alias("once"), key.alias("next_run"))
    return history.advanced(jobs, F.lit(500).cast("long")).select("id", "enabled", "next_run")
