"""Queries: gates, projections, joins and folds at the level of turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from hushframe.functions import grammar, policy
from hushframe.operators import compaction, history, leak, report, turns
from hushframe.plans.detection import _CLASS, ENTITIES, _entities
from hushframe.plans.registry import query
from hushframe.sources.tables import table

_PROMPT = "'Pay <<FINANCE_' || (o_orderkey % 7) || '>> to <<ORG_' || (o_custkey % 5) || '>>' || CASE WHEN o_orderkey % 3 = 0 THEN ' or <<ORG_9>> now' ELSE '' END"


def _prompts(spark, sf_dir):
    key = F.col("o_orderkey")
    text = F.concat(F.lit("Pay <<FINANCE_"), (key % 7).cast("string"), F.lit(">> to <<ORG_"), (F.col("o_custkey") % 5).cast("string"), F.lit(">>"), F.when(key % 3 == 0, F.lit(" or <<ORG_9>> now")).otherwise(F.lit("")))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))


@query("token_predicates", """WITH s AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '<<PERSON_' || p_partkey || '>>' WHEN 1 THEN 'x <<LOCAL_PATH_2>>' WHEN 2 THEN '<<person_1>>' WHEN 3 THEN ' <<A_1>> <<B_2>> ' ELSE '' END AS t FROM part)
SELECT p_partkey, regexp_full_match(t, '<<[A-Z]+(?:_[A-Z]+)*_\\d+>>') AS is_token, CASE WHEN regexp_full_match(t, '<<[A-Z]+(?:_[A-Z]+)*_\\d+>>') THEN lower(regexp_extract(t, '<<([A-Z]+(?:_[A-Z]+)*)_\\d+>>', 1)) ELSE '' END AS token_type,
    p_partkey % 5 IN (0, 3) AS only_tokens FROM s""")
def token_predicates(spark, sf_dir):
    key = F.col("p_partkey")
    t = F.when(key % 5 == 0, F.concat(F.lit("<<PERSON_"), key.cast("string"), F.lit(">>"))).when(key % 5 == 1, F.lit("x <<LOCAL_PATH_2>>")).when(key % 5 == 2, F.lit("<<person_1>>")).when(key % 5 == 3, F.lit(" <<A_1>> <<B_2>> ")).otherwise(F.lit(""))
    return table(spark, sf_dir, "part").select("p_partkey", grammar.is_placeholder(t).alias("is_token"), F.coalesce(grammar.placeholder_type(t), F.lit("")).alias("token_type"), grammar.only_placeholders(t).alias("only_tokens"))


@query("placeholder_summary", f"""WITH p AS (SELECT o_orderkey, {_PROMPT} AS t FROM orders), f AS (SELECT DISTINCT o_orderkey, unnest(regexp_extract_all(t, '{grammar.PLACEHOLDER}')) AS token, t FROM p)
SELECT o_orderkey, regexp_extract(token, '{grammar.PLACEHOLDER_TAG}', 1) AS tag, count(*) AS n, string_agg(token, ',' ORDER BY strpos(t, token)) AS tokens FROM f GROUP BY ALL""")
def placeholder_summary(spark, sf_dir):
    found = report.summarize_placeholders(_prompts(spark, sf_dir), ["o_orderkey"], "text")
    return found.withColumn("tokens", F.array_join("tokens", ","))


@query("restore_annotations", f"""WITH v AS (SELECT '<<ORG_' || n_nationkey || '>>' AS placeholder, n_name AS canonical FROM nation), p AS (SELECT o_orderkey, {_PROMPT} AS t, '<<ORG_' || (o_custkey % 5) || '>>' AS one FROM orders),
r AS (SELECT o_orderkey, one, a.canonical AS c1, b.canonical AS c2, t, strpos(t, one) - 1 AS s1, strpos(t, '<<ORG_9>>') - 1 AS s2 FROM p JOIN v a ON a.placeholder = one JOIN v b ON b.placeholder = '<<ORG_9>>')
SELECT o_orderkey, one AS placeholder, c1 AS value, s1::BIGINT AS "start", (s1 + length(c1))::BIGINT AS "end" FROM r UNION ALL
SELECT o_orderkey, '<<ORG_9>>', c2, (s2 - length(one) + length(c1))::BIGINT, (s2 - length(one) + length(c1) + length(c2))::BIGINT FROM r WHERE s2 >= 0""")
def restore_annotations(spark, sf_dir):
    vault = table(spark, sf_dir, "nation").select(F.concat(F.lit("<<ORG_"), F.col("n_nationkey").cast("string"), F.lit(">>")).alias("placeholder"), F.col("n_name").alias("canonical"))
    return turns.annotate(_prompts(spark, sf_dir), vault, ["o_orderkey"])


@query("known_tokens", f"""WITH p AS (SELECT o_orderkey, {_PROMPT} AS t FROM orders), f AS (SELECT o_orderkey, unnest(list_distinct(regexp_extract_all(t, '{grammar.PLACEHOLDER}'))) AS token FROM p)
SELECT o_orderkey, count(*) FILTER (v.k IS NOT NULL) AS known, count(*) FILTER (v.k IS NULL) AS unknown_tokens FROM f LEFT JOIN (SELECT '<<ORG_' || n_nationkey || '>>' AS k FROM nation WHERE n_regionkey <> 1) v ON v.k = token GROUP BY o_orderkey""")
def known_tokens(spark, sf_dir):
    """Tokens of prompts that a vault knows, and that it doesn't."""
    vault = table(spark, sf_dir, "nation").filter("n_regionkey <> 1").select(F.concat(F.lit("<<ORG_"), F.col("n_nationkey").cast("string"), F.lit(">>")).alias("token"), F.lit(True).alias("k"))
    found = _prompts(spark, sf_dir).select("o_orderkey", F.explode(grammar.tokens(F.col("text"))).alias("token")).join(vault, "token", "left")
    return found.groupBy("o_orderkey").agg(F.count_if(F.col("k").isNotNull()).alias("known"), F.count_if(F.col("k").isNull()).alias("unknown_tokens"))


@query("severity_of_prompts", f"""WITH p AS (SELECT o_orderkey, {_PROMPT} AS t FROM orders) SELECT o_orderkey, bool_or(regexp_matches(t, '<<(FINANCE|ORG)_')) AS severe, count(*) AS prompts FROM p GROUP BY o_orderkey""")
def severity_of_prompts(spark, sf_dir):
    p = _prompts(spark, sf_dir).withColumn("severe", turns.severity_flags(grammar.tokens(F.col("text"))))
    return p.groupBy("o_orderkey").agg(F.bool_or("severe").alias("severe"), F.count("*").alias("prompts"))


@query("approval_gate", f"""WITH c AS (SELECT event_id, event_type || '_' || CASE event_id % 4 WHEN 0 THEN 'url' WHEN 1 THEN 'grep' ELSE 'x' END AS name, CASE WHEN event_id % 3 = 0 THEN 'of <<PERSON_1>>' ELSE 'plain' END AS args FROM events),
k AS (SELECT *, name AS t FROM c) SELECT event_id, {_CLASS} AS privacy_class, ({_CLASS} = 'external') OR ({_CLASS} <> 'local' AND contains(args, '<<')) AS needs_approval FROM k""")
def approval_gate(spark, sf_dir):
    name = F.concat("event_type", F.lit("_"), F.when(F.col("event_id") % 4 == 0, F.lit("url")).when(F.col("event_id") % 4 == 1, F.lit("grep")).otherwise(F.lit("x")))
    args = F.when(F.col("event_id") % 3 == 0, F.lit("of <<PERSON_1>>")).otherwise(F.lit("plain"))
    return table(spark, sf_dir, "events").select("event_id", policy.privacy_class(name).alias("privacy_class"), policy.needs_gate(name, args).alias("needs_approval"))


@query("fetch_rewrite", """WITH c AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN '/tmp/' || page_id WHEN 2 THEN 'file:///a' ELSE '../up' END AS target FROM pages)
SELECT page_id, CASE WHEN regexp_matches(target, '^(file://|~[/\\\\]|/|\\.{1,2}[/\\\\]|[A-Za-z]:[\\\\/])') THEN 'read_file' ELSE 'web_fetch' END AS tool FROM c""")
def fetch_rewrite(spark, sf_dir):
    key = F.col("page_id") % 4
    target = F.when(key == 0, F.col("url")).when(key == 1, F.concat(F.lit("/tmp/"), F.col("page_id").cast("string"))).when(key == 2, F.lit("file:///a")).otherwise(F.lit("../up"))
    return table(spark, sf_dir, "pages").select("page_id", turns.fetch_tool(F.lit("web_fetch"), target).alias("tool"))


@query("viewer_projection", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE '[redacted: localhost-only]' END AS o_orderstatus, o_orderpriority FROM orders")
def viewer_projection(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return turns.for_viewer(rows, ["o_orderstatus"], F.col("o_orderkey") % 2 == 0)


@query("expired_sessions", "SELECT user_id, max(event_id) AS last_event, epoch_us(TIMESTAMP '2024-01-31') // 1000 - epoch_us(max(ts)) // 1000 >= 600 * 60000 AS expired FROM events GROUP BY user_id")
def expired_sessions(spark, sf_dir):
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("event_id").alias("last_event"), turns.expired(F.max("ts"), now, 600).alias("expired"))


@query("due_jobs", """WITH j AS (SELECT user_id, event_id, epoch_us(ts) // 1000 + (value * 1000)::BIGINT AS due FROM events) SELECT user_id, count(*) FILTER (due <= epoch_us(TIMESTAMP '2024-01-10') // 1000) AS due_now, min(due) FILTER (due > epoch_us(TIMESTAMP '2024-01-10') // 1000) AS next_wake FROM j GROUP BY user_id
HAVING min(due) FILTER (due > epoch_us(TIMESTAMP '2024-01-10') // 1000) IS NOT NULL""")
def due_jobs(spark, sf_dir):
    now = F.unix_millis(F.lit("2024-01-10 00:00:00").cast("timestamp"))
    due = F.unix_millis("ts") + F.round(F.col("value") * 1000).cast("long")
    jobs = table(spark, sf_dir, "events").select("user_id", due.alias("due"))
    return jobs.groupBy("user_id").agg(F.count_if(F.col("due") <= now).alias("due_now"), F.min(F.when(F.col("due") > now, F.col("due"))).alias("next_wake")).filter("next_wake is not null")


@query("partial_candidates", """WITH e AS (SELECT '<<PERSON_' || s_suppkey || '>>' AS placeholder, 'Agent ' || s_name AS canonical FROM supplier), t AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 'ask Supplier#' || lpad(l_suppkey::VARCHAR, 9, '0') ELSE 'ask Agent Supplier#' || lpad(l_suppkey::VARCHAR, 9, '0') END AS x, l_suppkey FROM lineitem)
SELECT DISTINCT l_orderkey, l_linenumber, '<<PERSON_' || l_suppkey || '>>' AS placeholder, 'supplier#' || lpad(l_suppkey::VARCHAR, 9, '0') AS part FROM t JOIN supplier ON s_suppkey = l_suppkey WHERE l_linenumber % 2 = 0""")
def partial_candidates(spark, sf_dir):
    entries = table(spark, sf_dir, "supplier").select(F.concat(F.lit("<<PERSON_"), F.col("s_suppkey").cast("string"), F.lit(">>")).alias("placeholder"), F.concat(F.lit("Agent "), "s_name").alias("canonical"))
    name = F.concat(F.lit("Supplier#"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0"))
    text = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("ask "), name)).otherwise(F.concat(F.lit("ask Agent "), name))
    texts = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.alias("text"))
    return turns.partial_candidates(texts, entries, ["l_orderkey", "l_linenumber"], "text", least=6)


@query("protecting_placeholder", """WITH v AS (SELECT c_nationkey AS session, '<<PERSON_' || c_custkey || '>>' AS placeholder, 'client ' || lower(c_mktsegment) || ' ' || c_custkey AS canonical FROM customer),
x AS (SELECT DISTINCT c_nationkey AS session, lower(c_mktsegment) || ' ' || (c_custkey + 25) AS value FROM customer),
l AS (SELECT DISTINCT session, value, unnest(string_split(value, ' ')) AS part FROM x), r AS (SELECT DISTINCT session, placeholder, canonical, unnest(string_split(canonical, ' ')) AS part FROM v),
s AS (SELECT session, value, placeholder, canonical, count(*) AS n FROM l JOIN r USING (session, part) GROUP BY ALL)
SELECT session, value, arg_max(placeholder, (n, length(canonical), placeholder)) AS placeholder, max(n) AS shared FROM s GROUP BY session, value""")
def protecting_placeholder(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "session")
    name = F.concat(F.lower("c_mktsegment"), F.lit(" "))
    vault = customer.select("session", F.concat(F.lit("<<PERSON_"), F.col("c_custkey").cast("string"), F.lit(">>")).alias("placeholder"), F.concat(F.lit("client "), name, F.col("c_custkey").cast("string")).alias("canonical"))
    values = customer.select("session", F.concat(name, (F.col("c_custkey") + 25).cast("string")).alias("value")).distinct()
    return turns.protecting(values, vault, "session", "value", F.split("value", " "), F.split("canonical", " "))


@query("backfill_results", """SELECT conv_id, turn, text AS content, false AS filled FROM conversations WHERE role = 'assistant' UNION ALL
SELECT conv_id, turn + 1, '[missing result]', true FROM conversations u WHERE role = 'user' AND NOT EXISTS (SELECT 1 FROM conversations a WHERE a.role = 'assistant' AND a.conv_id = u.conv_id AND a.turn = u.turn + 1)""")
def backfill_results(spark, sf_dir):
    messages = table(spark, sf_dir, "conversations")
    calls = messages.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"))
    results = messages.filter("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("content"))
    return turns.backfill(calls, results, ["conv_id", "turn"])


@query("line_window", "SELECT * FROM (SELECT doc_id, generate_subscripts(l, 1)::INTEGER AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE line_no BETWEEN 3 AND 6")
def line_window(spark, sf_dir):
    return turns.line_window(table(spark, sf_dir, "documents"), "doc_id", 2, 4)


@query("spilled_results", "SELECT doc_id, CASE WHEN length(text) > 4000 THEN '[stored as ' || sha256(text) || ', ' || length(text) || ' chars]' || chr(10) || left(text, 200) ELSE text END AS text FROM documents")
def spilled_results(spark, sf_dir):
    return turns.spill(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", 4000, 200)[0]


@query("spilled_texts", "SELECT sha256(text) AS reference, doc_id, text FROM documents WHERE length(text) > 4000")
def spilled_texts(spark, sf_dir):
    """The side table of the large results."""
    return turns.spill(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", 4000, 200)[1]


@query("fold_results", """SELECT l_orderkey, bool_or(l_quantity > 45) AS was_sanitized, bool_or(l_tax > 0.07) AS failed, string_agg(l_returnflag || l_linestatus, ',' ORDER BY l_linenumber, l_returnflag || l_linestatus) AS parts FROM lineitem GROUP BY l_orderkey""")
def fold_results(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("part"), (F.col("l_quantity") > 45).alias("was_sanitized"), (F.col("l_tax") > 0.07).alias("failed"), F.array(F.concat("l_returnflag", "l_linestatus")).alias("parts"))
    return turns.fold(rows, ["l_orderkey"], ["was_sanitized", "failed"], ["parts"]).withColumn("parts", F.array_join("parts", ","))


@query("keep_last_entries", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 20")
def keep_last_entries(spark, sf_dir):
    return turns.keep_last(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], 20).select("user_id", "event_id")


@query("trailer_lines", """WITH l AS (SELECT doc_id, generate_subscripts(l, 1)::INTEGER AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)), b AS (SELECT *, min((length(line) < 60)::INTEGER) OVER (PARTITION BY doc_id ORDER BY line_no DESC) AS m FROM l)
SELECT doc_id, count(*) FILTER (m = 1) AS trailer_lines, count(*) AS n_lines FROM b GROUP BY doc_id""")
def trailer_lines(spark, sf_dir):
    """Short lines at a document's end."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    marked = turns.trailer(lines, "doc_id", "line_no", F.length("line") < 60)
    return marked.groupBy("doc_id").agg(F.count_if("in_trailer").alias("trailer_lines"), F.count("*").alias("n_lines"))


@query("template_fill", "SELECT o_orderkey, 'Dear ' || c_name || ', order ' || o_orderkey || ' is ' || o_orderstatus || '.' AS filled FROM orders JOIN customer ON o_custkey = c_custkey")
def template_fill(spark, sf_dir):
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    filled = turns.fill(F.lit("Dear {name},\n order  {id} is {status}."), {"name": F.col("c_name"), "id": F.col("o_orderkey"), "status": F.col("o_orderstatus")})
    return joined.select("o_orderkey", filled.alias("filled"))


@query("split_messages", """WITH RECURSIVE s AS (SELECT doc_id, -1 AS part, '' AS message, text AS rest FROM documents WHERE length(text) > 0 UNION ALL
    SELECT doc_id, part + 1, left(rest, p), CASE WHEN length(rest) <= 2000 THEN '' ELSE regexp_replace(substr(rest, p + 1), '^\\s+', '') END FROM (SELECT doc_id, part, rest, CASE WHEN length(rest) <= 2000 THEN length(rest) WHEN contains(substr(rest, 2, 1999), chr(10)) THEN 2000 - strpos(reverse(left(rest, 2000)), chr(10))
        WHEN contains(substr(rest, 2, 1999), ' ') THEN 2000 - strpos(reverse(left(rest, 2000)), ' ') ELSE 2000 END AS p FROM s WHERE length(rest) > 0))
SELECT doc_id, part::INTEGER AS part, message FROM s WHERE part >= 0""")
def split_messages(spark, sf_dir):
    """Messages in parts a channel accepts."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(turns.split_message(F.col("text"))).alias("part", "message"))


@query("turn_report", f"""WITH {ENTITIES}, c AS (SELECT doc_id, upper(entity_type) AS t, count(*) AS n FROM entities GROUP BY ALL) SELECT doc_id, string_agg(t || ' x' || n, ', ' ORDER BY t) AS report, sum(n)::BIGINT AS total FROM c GROUP BY doc_id""")
def turn_report(spark, sf_dir):
    return turns.turn_report(_entities(spark, sf_dir), ["doc_id"])


@query("counter_snapshot", f"""WITH p AS (SELECT o_orderkey, {_PROMPT} AS t FROM orders), f AS (SELECT o_orderkey, unnest(regexp_extract_all(t, '{grammar.PLACEHOLDER}')) AS token FROM p)
SELECT o_orderkey, regexp_extract(token, '{grammar.PLACEHOLDER_TAG}', 1) AS tag, max(regexp_extract(token, '_(\\d+)>>$', 1)::BIGINT) AS counter FROM f GROUP BY ALL""")
def counter_snapshot(spark, sf_dir):
    found = _prompts(spark, sf_dir).select("o_orderkey", F.explode(grammar.tokens(F.col("text"))).alias("placeholder"))
    return compaction.counters(found, "o_orderkey")


@query("scope_delete", "SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 100)")
def scope_delete(spark, sf_dir):
    """What stays when whole sessions are deleted."""
    events = table(spark, sf_dir, "events")
    gone = events.filter("event_type = 'error' and value > 100").select("user_id").distinct()
    return events.join(gone, "user_id", "left_anti").select("event_id", "user_id")


@query("intent_counts", """SELECT CASE WHEN regexp_matches(text, '(?i)\\b(sum|total|add|average|percent|calculate|how much|difference)\\b') THEN 'math' WHEN regexp_matches(text, '(?i)\\b(document|file|pdf|attachment|summari[sz]e)\\b') THEN 'document' ELSE 'chat' END AS intent, count(*) AS n FROM
    (SELECT p_name || CASE p_partkey % 3 WHEN 0 THEN ' in total' WHEN 1 THEN ' of the file' ELSE '' END AS text FROM part) GROUP BY ALL""")
def intent_counts(spark, sf_dir):
    key = F.col("p_partkey") % 3
    text = F.concat("p_name", F.when(key == 0, F.lit(" in total")).when(key == 1, F.lit(" of the file")).otherwise(F.lit("")))
    return table(spark, sf_dir, "part").groupBy(turns.intent(text).alias("intent")).agg(F.count("*").alias("n"))


@query("key_functions", "SELECT c_custkey, regexp_replace(trim(c_name), '[^\\w.-]', '_', 'g') AS safe_key, regexp_replace(lower(c_name), '[^a-z0-9]+', '', 'g') AS match_key, c_mktsegment || '#' || c_nationkey AS scope_key FROM customer")
def key_functions(spark, sf_dir):
    scope = F.concat_ws("#", "c_mktsegment", F.col("c_nationkey").cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", turns.safe_key(F.col("c_name")).alias("safe_key"), turns.match_key(F.col("c_name")).alias("match_key"), scope.alias("scope_key"))


@query("unprocessed_batch", "SELECT event_id, left(props, 500) AS content FROM events WHERE event_id > 100 ORDER BY event_id LIMIT 20")
def unprocessed_batch(spark, sf_dir):
    """The next entries after a cursor, a batch by design."""
    return history.page(table(spark, sf_dir, "events").filter("event_id > 100").select("event_id", F.left("props", F.lit(500)).alias("content")), ["event_id"], 0, 20)


@query("ident_tokens", """SELECT o_orderkey, array_to_string(list_filter(regexp_extract_all(o_orderpriority || ' ' || o_orderkey || ' Ünal A8K3 foo_bar 12 URGENT', '[\\p{L}\\p{N}_]+'), lambda p: regexp_full_match(p, '\\p{Nd}{3,}') OR regexp_full_match(p, '\\p{L}{4,}')), ',') AS parts FROM orders""")
def ident_tokens(spark, sf_dir):
    value = F.concat("o_orderpriority", F.lit(" "), F.col("o_orderkey").cast("string"), F.lit(" Ünal A8K3 foo_bar 12 URGENT"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(leak.ident_tokens(value), ",").alias("parts"))


@query("long_document_rollup", """SELECT source, count(*) AS documents, count(*) FILTER (length(text) > 6000) AS chunked, max(ceil(length(text) / 6000.0))::BIGINT AS max_chunks, quantile_cont(ceil(length(text) / 6000.0), 0.5) AS median_chunks, sum(ceil(length(text) / 6000.0) - 1)::BIGINT AS seams FROM documents GROUP BY source""")
def long_document_rollup(spark, sf_dir):
    chunks = F.ceil(F.length("text") / F.lit(6000))
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("documents"), F.count_if(F.length("text") > 6000).alias("chunked"), F.max(chunks).alias("max_chunks"), F.percentile(chunks, 0.5).alias("median_chunks"), F.sum(chunks - 1).alias("seams"))


@query("long_session_rollup", """WITH d AS (SELECT doc_id, source, text, CASE WHEN length(text) > 2000 THEN ceil(length(text) / 2000.0)::BIGINT END AS chunks_total FROM documents),
l AS (SELECT doc_id, strpos(text, '@') - 1 AS pos, length(text) AS n FROM documents WHERE contains(text, '@') AND length(text) > 2000),
k AS (SELECT pos, greatest(1, ceil(n / 2000.0)::BIGINT - 1) AS seams, greatest(1, least(greatest(1, ceil(n / 2000.0)::BIGINT - 1), pos // 2000)) AS below FROM l), g AS (SELECT least(abs(pos - below * 2000), abs(pos - least(seams, below + 1) * 2000)) AS distance FROM k)
SELECT count(*) AS sessions, count(*) FILTER (chunks_total > 1) AS chunker_activated, count(*) FILTER (chunks_total IS NOT NULL AND contains(text, '$')) AS chunks_failed_sessions, quantile_cont(chunks_total, 0.5) AS p50_chunks, max(chunks_total) AS max_chunks,
    (SELECT count(*) FROM g) AS seam_leaks, (SELECT count(*) FROM g WHERE distance <= 300) AS seam_leaks_within_overlap, (SELECT count(*) FROM orders) AS cross_path_checked, (SELECT count(*) FROM orders WHERE o_orderkey % 5 > 0) AS cross_path_carried,
    (SELECT count(*) FILTER (o_orderkey % 5 > 0)::DOUBLE / count(*) FROM orders) AS cross_path_rate FROM d""")
def long_session_rollup(spark, sf_dir):
    """What long documents came to over all sessions: chunks, failures, leaks near a seam, tokens carried to later turns."""
    docs = table(spark, sf_dir, "documents").withColumn("n", F.length("text"))
    total = F.when(F.col("n") > 2000, F.ceil(F.col("n") / 2000))
    sessions = docs.select(F.col("doc_id").alias("session"), total.alias("chunks_total"), F.when(total.isNotNull(), F.contains("text", F.lit("$")).cast("int")).alias("chunks_failed"))
    places = docs.filter(F.contains("text", F.lit("@")) & (F.col("n") > 2000)).select(F.col("doc_id").alias("session"), (F.instr("text", "@") - 1).alias("at"), "n")
    seams = leak.nearest_seam(places, "session", "at", 2000, "n")
    carried = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session"), (F.col("o_orderkey") % 5 > 0).alias("carried"))
    return leak.long_rollup(sessions, seams, carried, band=300)


@query("jobs_by_next_run", "SELECT user_id, next_run, row_number() OVER (ORDER BY next_run ASC NULLS LAST, user_id) AS place FROM (SELECT user_id, max(event_id) FILTER (event_type = 'view' AND value > 90) AS next_run FROM events GROUP BY user_id)")
def jobs_by_next_run(spark, sf_dir):
    jobs = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.when((F.col("event_type") == "view") & (F.col("value") > 90), F.col("event_id"))).alias("next_run"))
    return history.place(jobs, [F.col("next_run").asc_nulls_last(), F.col("user_id")], "place")
