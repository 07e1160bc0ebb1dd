"""Queries: the vault as tables, turns out and back, calculations of a session, summaries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hushframe.functions import grammar
from hushframe.operators import annotations, calc, compaction, detect, report, turn_pipeline, vault_table
from hushframe.plans.detection import _TURNS_SQL, _turns
from hushframe.plans.registry import query
from hushframe.sources import sessions
from hushframe.sources.tables import keep_folder, table, work_folder

_SCHEMA = "session string, placeholder string, entity_type string, canonical string, aliases array<string>, value double, created_turn long, last_seen_turn long"
_KNOWN = """known AS (SELECT 'n' || c_nationkey AS session, '<<PERSON_' || c_custkey || '>>' AS placeholder, 'person' AS entity_type, c_name AS canonical, [c_name, upper(c_mktsegment) || '-' || c_custkey] AS aliases, c_custkey AS turn FROM customer)"""


def _known(spark, sf_dir):
    """Customers as the people that the sessions of nations know."""
    key = F.col("c_custkey")
    token = F.concat(F.lit("<<PERSON_"), key.cast("string"), F.lit(">>"))
    aliases = F.array("c_name", F.concat(F.upper("c_mktsegment"), F.lit("-"), key.cast("string")))
    columns = (F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("session"), token.alias("placeholder"), F.lit("person").alias("entity_type"), F.col("c_name").alias("canonical"), aliases.alias("aliases"))
    return table(spark, sf_dir, "customer").select(*columns, F.lit(None).cast("double").alias("value"), key.alias("created_turn"), key.alias("last_seen_turn"))


@query("vault_lookup", f"""WITH {_KNOWN}, s AS (SELECT session, unnest(aliases) AS surface, placeholder, turn FROM known), k AS (SELECT session, regexp_replace(lower(surface), '[^\\w\\s]', '', 'g') AS key, arg_max(placeholder, turn) AS placeholder FROM s GROUP BY ALL),
e AS (SELECT session, surface, arg_max(placeholder, turn) AS placeholder FROM s GROUP BY ALL),
a AS (SELECT o_orderkey, 'n' || c_nationkey AS session, CASE o_orderkey % 4 WHEN 0 THEN c_name WHEN 1 THEN '  ' || upper(c_name) || '.' WHEN 2 THEN lower(c_mktsegment) || ' ' || c_custkey ELSE lower(c_mktsegment) || '' || c_custkey END AS surface FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT o_orderkey, surface, coalesce(e.placeholder, k.placeholder) AS placeholder FROM a LEFT JOIN e USING (session, surface) LEFT JOIN k ON k.session = a.session AND k.key = regexp_replace(lower(trim(a.surface)), '[^\\w\\s]', '', 'g')""")
def vault_lookup(spark, sf_dir):
    """Surfaces looked up as they are, then by their alias key."""
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    kind, key = F.col("o_orderkey") % 4, F.col("c_custkey").cast("string")
    surface = F.when(kind == 0, F.col("c_name")).when(kind == 1, F.concat(F.lit("  "), F.upper("c_name"), F.lit("."))).when(kind == 2, F.concat(F.lower("c_mktsegment"), F.lit(" "), key)).otherwise(F.concat(F.lower("c_mktsegment"), key))
    asked = joined.select("o_orderkey", F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("session"), surface.alias("surface"))
    return vault_table.lookup(asked, _known(spark, sf_dir)).select("o_orderkey", "surface", "placeholder")


@query("vault_register", f"""WITH {_KNOWN}, seen AS (SELECT c_custkey, list_sort(list_distinct(list('Mx ' || (o_orderkey % 3) || ' ' || c_name))) AS news, min(o_orderkey) AS f, max(o_orderkey) AS l FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_custkey, c_name),
v AS (SELECT c_custkey, arg_max(o_totalprice, o_orderkey) AS value FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_custkey)
SELECT session, placeholder, array_to_string(list_concat(aliases, coalesce(news, [])), '|') AS aliases, turn AS created_turn, greatest(turn, coalesce(l, turn)) AS last_seen_turn, value FROM known LEFT JOIN seen ON turn = seen.c_custkey LEFT JOIN v ON turn = v.c_custkey""")
def vault_register(spark, sf_dir):
    """Aliases and turns of entities seen again, and their latest values."""
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    session, token = F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("session"), F.concat(F.lit("<<PERSON_"), F.col("c_custkey").cast("string"), F.lit(">>")).alias("placeholder")
    surface = F.concat(F.lit("Mx "), (F.col("o_orderkey") % 3).cast("string"), F.lit(" "), "c_name")
    after = vault_table.register(_known(spark, sf_dir), joined.select(session, token, surface.alias("surface"), F.col("o_orderkey").alias("turn")))
    after = vault_table.set_values(after, joined.select(session, token, F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("order")))
    return after.select("session", "placeholder", F.array_join("aliases", "|").alias("aliases"), "created_turn", "last_seen_turn", "value")


@query("vault_variables", """SELECT 'n' || c_nationkey AS session, string_agg('PERSON_' || c_custkey, ',' ORDER BY 'PERSON_' || c_custkey) AS names, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY c_nationkey""")
def vault_variables(spark, sf_dir):
    values = table(spark, sf_dir, "customer").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("session"), F.concat(F.lit("<<PERSON_"), F.col("c_custkey").cast("string"), F.lit(">>")).alias("placeholder"), F.col("c_acctbal").alias("value"), F.col("c_custkey").alias("order"))
    named = vault_table.variables(vault_table.set_values(_known(spark, sf_dir), values))
    total = F.aggregate(F.map_values("values"), F.lit(0.0), lambda a, b: a + b)
    return named.select("session", F.array_join(F.map_keys("values"), ",").alias("names"), F.round(total, 2).alias("total"))


@query("vault_store", f"""WITH {_KNOWN}, stored AS (SELECT *, CASE WHEN session IN ('n1', 'n3') THEN 'new ' ELSE '' END AS mark FROM known WHERE session <> 'n5')
SELECT session, placeholder, mark || canonical AS canonical FROM stored UNION ALL SELECT 'n1', '<<PERSON_0>>', 'fresh'""")
def vault_store(spark, sf_dir):
    """A vault saved, changed for two sessions, saved again, loaded, and cleared of a session; a scope that ends isn't stored."""
    path = keep_folder(spark, f"{work_folder(spark)}/vaults/{uuid.uuid4().hex}")
    first = vault_table.load(spark, path, _SCHEMA).unionByName(_known(spark, sf_dir))
    passing = first.filter("session = 'n2'").withColumn("session", F.lit("n2#task#7"))
    token_like = first.limit(1).withColumn("canonical", F.lit("<<PERSON_1>>")).withColumn("placeholder", F.lit("<<PERSON_00>>"))
    vault_table.save(first.unionByName(passing).unionByName(token_like), path)
    stored = vault_table.load(spark, path)
    news = stored.filter("session in ('n1', 'n3')").withColumn("canonical", F.concat(F.lit("new "), "canonical"))
    fresh = spark.createDataFrame([("n1", "<<PERSON_0>>", "person", "fresh", None, None, 1, 1)], _SCHEMA)
    vault_table.save(turn_pipeline.keep(vault_table.merged(stored, news.unionByName(fresh))), path)
    gone = spark.createDataFrame([("n5",)], "session string")
    return vault_table.without_sessions({"vault": vault_table.load(spark, path)}, gone)["vault"].select("session", "placeholder", "canonical")


_PREPARED = """replace(replace(replace(text, substr(text, 11, strpos(text, ' paid') - 11), '<<PERSON_1>>'), price, p.token), day, d.token)"""


def _people(spark, sf_dir):
    session = F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("session")
    none = F.lit(None)
    return table(spark, sf_dir, "customer").select(session, F.lit("<<PERSON_1>>").alias("placeholder"), F.lit("person").alias("entity_type"), F.col("c_name").alias("canonical"), F.array("c_name").alias("aliases"), none.cast("double").alias("value"), none.cast("long").alias("created_turn"), none.cast("long").alias("last_seen_turn"))


@query("prepared_turns", f"""WITH {_TURNS_SQL} SELECT t.session, turn, {_PREPARED} AS remote_text, true AS was_sanitized, 3 AS n_tokens
    FROM t JOIN n p ON p.session = t.session AND p.surface = price JOIN n d ON d.session = t.session AND d.surface = day""")
def prepared_turns(spark, sf_dir):
    """Messages ready for a remote model: known people by the vault, prices and dates by detection."""
    done, _ = turn_pipeline.prepare(_turns(spark, sf_dir), _people(spark, sf_dir))
    return done.select("session", "turn", "remote_text", "was_sanitized", F.size("tokens").alias("n_tokens"))


@query("vault_after_turns", f"""WITH {_TURNS_SQL}, l AS (SELECT session, price AS surface, max(turn) AS l FROM t GROUP BY ALL UNION ALL SELECT session, day, max(turn) FROM t GROUP BY ALL)
SELECT session, token AS placeholder, surface AS canonical, first AS created_turn, l AS last_seen_turn FROM n JOIN l USING (session, surface) UNION ALL SELECT 'c' || c_custkey, '<<PERSON_1>>', c_name, NULL, NULL FROM customer""")
def vault_after_turns(spark, sf_dir):
    _, after = turn_pipeline.prepare(_turns(spark, sf_dir), _people(spark, sf_dir))
    return after.select("session", "placeholder", "canonical", "created_turn", "last_seen_turn")


@query("turns_out_of_order", f"""WITH {_TURNS_SQL}, x AS (SELECT *, turn % 3 = 0 AS late FROM t),
b AS (SELECT session, surface, tag, min(late) AS batch FROM (SELECT session, price AS surface, 'FINANCE' AS tag, CASE WHEN late THEN 2 ELSE 1 END AS late FROM x UNION ALL SELECT session, day, 'DATE', CASE WHEN late THEN 2 ELSE 1 END FROM x) GROUP BY ALL),
f AS (SELECT b.*, min(turn) AS first FROM b JOIN (SELECT session, turn, price AS surface, late FROM x UNION ALL SELECT session, turn, day, late FROM x) USING (session, surface) WHERE (batch = 2) = late GROUP BY ALL),
m AS (SELECT *, '<<' || tag || '_' || row_number() OVER (PARTITION BY session, tag ORDER BY batch, first) || '>>' AS token FROM f),
texts AS (SELECT session, turn, 0 AS part, text, price, day FROM x UNION ALL SELECT session, turn, 1, 'again: ' || text || ' ' || price, price, day FROM x WHERE NOT late)
SELECT t.session, t.turn, part, replace(replace(replace(text, c_name, '<<PERSON_1>>'), price, p.token), day, d.token) AS remote_text, p.first AS price_turn
    FROM texts t JOIN m p ON p.session = t.session AND p.surface = price JOIN m d ON d.session = t.session AND d.surface = day JOIN customer ON t.session = 'c' || c_custkey""")
def turns_out_of_order(spark, sf_dir):
    """Two turns in three come first as arguments of tools, then as messages; the third, of earlier and later numbers, comes after them all.

    Whatever came before, and in whichever order, nothing known goes out; a token keeps its first turn.
    """
    turns = _turns(spark, sf_dir)
    early, late = turns.filter("turn % 3 <> 0"), turns.filter("turn % 3 = 0")
    price = F.concat(F.lit("$"), F.regexp_extract("text", r"\$([0-9.]+) on", 1))
    said = F.concat(F.lit("again: "), "text", F.lit(" "), price)
    calls = early.select("session", "turn", F.to_json(F.struct(F.struct(F.col("text").alias("q"), F.array(said).alias("l")).alias("a"))).alias("arguments"))
    nested, after = turn_pipeline.sanitize_nested(calls, _people(spark, sf_dir))
    again, after = turn_pipeline.prepare(early, after)
    last, after = turn_pipeline.prepare(late, after)
    strings = nested.select("session", "turn", F.lit(1).alias("part"), F.get_json_object("sanitized", "$.a.l[0]").alias("remote_text"))
    first = after.filter("entity_type = 'financial'").select("session", F.col("canonical").alias("price"), F.col("created_turn").alias("price_turn"))
    texts = again.unionByName(last).select("session", "turn", F.lit(0).alias("part"), "remote_text").unionByName(strings)
    prices = turns.select("session", "turn", price.alias("price")).join(first, ["session", "price"])
    return texts.join(prices.drop("price"), ["session", "turn"])


@query("privacy_reports", f"""WITH {_TURNS_SQL}, b AS (SELECT t.session, turn, '`DATE` x1 (`' || d.token || '`), `FINANCE` x1 (`' || p.token || '`), `PERSON` x1 (`<<PERSON_1>>`)' AS sent, p.token AS price FROM t JOIN n p ON p.session = t.session AND p.surface = price JOIN n d ON d.session = t.session AND d.surface = day)
SELECT session, turn, array_to_string(['### \U0001f512 Privacy Report  ', '├─ Intent: `chat`  ', '├─ Input protection: _sanitized before remote LLM_  ', '│  > ' || sent || '  ', '├─ Newly detected this turn: `FINANCIAL` (high) x1, `TEMPORAL` (high) x1  ',
    '├─ Tool-output detections: ' || CASE WHEN turn % 3 = 0 THEN '`EMAIL` (high) x2' ELSE '_none_' END || '  '] || CASE WHEN turn % 2 = 0 THEN ['├─ Restored in final output: `FINANCE` x1 (`' || price || '`)  ', '└─ Status: _tokens restored for display_'] ELSE ['└─ Status: _nothing restored in final output_'] END, chr(10)) AS report FROM b""")
def privacy_reports(spark, sf_dir):
    """What each turn's privacy came to, as text for its user: tokens sent, what was found, what came back."""
    turns = _turns(spark, sf_dir)
    done, _ = turn_pipeline.prepare(turns, _people(spark, sf_dir))
    output = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Paid "), F.regexp_extract("remote_text", "<<FINANCE_[0-9]+>>", 0), F.lit(", yes "), F.regexp_extract("remote_text", "<<FINANCE_[0-9]+>>", 0))).otherwise(F.lit("Done."))
    rows = done.select("session", "turn", F.lit("chat").alias("intent"), F.col("remote_text").alias("sanitized_input"), "was_sanitized", output.alias("sanitized_output"))
    tools = detect.detect(turns.filter("turn % 3 = 0").select("session", "turn", F.lit("a@ex.org and b@ex.org").alias("text")))
    return report.privacy_reports(rows, turn_pipeline.detect_turns(turns), tools)


@query("computed_turns", f"""WITH {_TURNS_SQL}, p AS (SELECT t.session, turn, price, token, o_totalprice AS v FROM t JOIN n ON n.session = t.session AND surface = price JOIN orders ON o_orderkey = turn)
SELECT session, turn, 'Half of ' || price || ' is ' || regexp_replace(round(v / 2, 4)::VARCHAR, '\\.0$', '') || '.' AS display_text FROM p""")
def computed_turns(spark, sf_dir):
    """Numbers that a turn brought are computed with in its answer: the vault holds their values from the start."""
    turns = _turns(spark, sf_dir)
    done, after = turn_pipeline.prepare(turns, _people(spark, sf_dir))
    token = F.regexp_extract("remote_text", "<<(FINANCE_[0-9]+)>>", 1)
    text = F.concat(F.lit("Half of <<"), token, F.lit(">> is <python_snippet_1>"), token, F.lit(" / 2</python_snippet_1>."))
    return turn_pipeline.finalize(done.select("session", "turn", text.alias("text")), after).select("session", "turn", "display_text")


_JSON = """'{"q": "' || t || '", "opts": {"n": 1, "list": ["' || p || '", "plain", null, true]}}'"""


@query("nested_arguments", f"""WITH {_TURNS_SQL} SELECT t.session, turn, replace(replace(replace({_JSON.replace("|| t ||", "|| text ||").replace("|| p ||", "|| price ||")}, substr(text, 11, strpos(text, ' paid') - 11), '<<PERSON_1>>'), price, p.token), day, d.token) AS sanitized, {_JSON.replace("|| t ||", "|| text ||").replace("|| p ||", "|| price ||")} AS restored
    FROM t JOIN n p ON p.session = t.session AND p.surface = price JOIN n d ON d.session = t.session AND d.surface = day""")
def nested_arguments(spark, sf_dir):
    """Arguments of any depth sanitised string by string, and restored again."""
    price = F.concat(F.lit("$"), F.regexp_extract("text", r"\$([0-9.]+) on", 1))
    arguments = F.concat(F.lit('{"q": "'), "text", F.lit('", "opts": {"n": 1, "list": ["'), price, F.lit('", "plain", null, true]}}'))
    calls = _turns(spark, sf_dir).select("session", "turn", arguments.alias("arguments"))
    done, after = turn_pipeline.sanitize_nested(calls, _people(spark, sf_dir))
    done = turn_pipeline.keep(done.select("session", "turn", "sanitized"))
    back = turn_pipeline.restore_nested(done.withColumnRenamed("sanitized", "arguments"), after)
    return back.select("session", "turn", F.col("arguments").alias("sanitized"), "restored")


@query("failed_outputs", """WITH p AS (SELECT doc_id, text, unnest(range(0, length(text), 6000)) // 6000 AS idx FROM documents WHERE length(text) > 0), f AS (SELECT doc_id, text, count(*) AS chunks, count(*) FILTER ((doc_id + idx) % 5 = 4) AS failed_chunks FROM p GROUP BY ALL)
SELECT doc_id, chunks, failed_chunks, CASE WHEN failed_chunks > 0 THEN '[tool output omitted; privacy detection failed on one or more chunks for tool ''grep'']' ELSE text END AS shown, failed_chunks > 0 AS modified FROM f""")
def failed_outputs(spark, sf_dir):
    """Tool outputs of which a chunk's detection failed give way to a note as a whole."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    parts = turn_pipeline.chunk.hard_cut(docs).select("doc_id", ((F.col("doc_id") + F.col("idx")) % 5 == 4).alias("failed"))
    flagged = docs.join(turn_pipeline.failed_texts(parts, ["doc_id"]), "doc_id").withColumn("sanitized", F.col("text")).withColumn("modified", F.lit(False))
    out = turn_pipeline.on_failure(flagged, F.col("failed"), F.lit("grep"))
    return out.select("doc_id", "chunks", "failed_chunks", F.col("sanitized").alias("shown"), "modified")


_ANSWERS = """a AS (SELECT 'c' || c_custkey AS session, o_orderkey AS turn, o_orderkey % 3 AS k, c_acctbal AS b, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) AS r FROM orders JOIN customer ON c_custkey = o_custkey),
f AS (SELECT session, k, min(turn) AS first FROM a GROUP BY ALL), g AS (SELECT session, k, 2 + row_number() OVER (PARTITION BY session ORDER BY first) AS number FROM f)"""
_NUM = lambda x: f"regexp_replace(round({x}, 4)::VARCHAR, '\\.0$', '')"


@query("math_turns", f"""WITH {_ANSWERS} SELECT a.session, turn, 'Twice is ' || {_NUM('b * 2')} || ', again ' || {_NUM('b * 2')} || ', plus one ' || {_NUM('b * 2 + 1')} || ' and ' || {_NUM('b + k')} || '; bad open(1)' AS display,
    'Twice is <<CALC_1>>, again <<CALC_1>>, plus one <<CALC_2>> and <<CALC_' || number || '>>; bad open(1)' AS history, 3 AS n_records FROM a JOIN g USING (session, k)""")
def math_turns(spark, sf_dir):
    """Answers with calculations: results as shown, CALC tokens as kept, the same expression calculated once a session."""
    done = calc.apply(_answers(spark, sf_dir), _balances(spark, sf_dir))
    return done.select("session", "turn", "display", "history", F.size("computations").alias("n_records"))


def _answers(spark, sf_dir):
    tail = F.concat(F.lit("<python_snippet_4>result = FINANCE_1 + "), (F.col("o_orderkey") % 3).cast("string"), F.lit("</python_snippet_4>; bad <python_snippet_5>open(1)</python_snippet_5>"))
    text = F.concat(F.lit("Twice is <python_snippet_1>result = FINANCE_1 * 2</python_snippet_1>, again <PYTHON_SNIPPET_2> FINANCE_1*2 </PYTHON_SNIPPET_2>, plus one <python_snippet_3>CALC_1 + 1</python_snippet_3> and "), tail)
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("session"), F.col("o_orderkey").alias("turn"), text.alias("text"))


def _balances(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("session"), F.create_map(F.lit("FINANCE_1"), "c_acctbal").alias("values"))


@query("finalized_turns", f"""WITH {_ANSWERS} SELECT session, turn, 'Dear ' || c_name || ', ' || {_NUM('b * 2')} || ' by <<ORG_9>>' AS display_text, 'Dear <<PERSON_1>>, <<CALC_1>> by <<ORG_9>>' AS history_text FROM a JOIN customer ON session = 'c' || c_custkey""")
def finalized_turns(spark, sf_dir):
    """Answers for the user: calculated, then restored."""
    text = F.lit("Dear <<PERSON_1>>, <python_snippet_1>FINANCE_1 * 2</python_snippet_1> by <<ORG_9>>")
    answers = _answers(spark, sf_dir).withColumn("text", text)
    money = _balances(spark, sf_dir).select("session", F.lit("<<FINANCE_1>>").alias("placeholder"), F.lit("financial").alias("entity_type"), F.lit("$x").alias("canonical"), F.array(F.lit("$x")).alias("aliases"), F.col("values")["FINANCE_1"].alias("value"), F.lit(1).cast("long").alias("created_turn"), F.lit(1).cast("long").alias("last_seen_turn"))
    return turn_pipeline.finalize(answers, _people(spark, sf_dir).unionByName(money)).select("session", "turn", "display_text", "history_text")


@query("annotated_answers", f"""WITH {_ANSWERS}, v AS (SELECT a.*, c_name AS who, {_NUM('b * 2')} AS twice, {_NUM('b + k')} AS more, regexp_replace(b::VARCHAR, '\\.0$', '') AS plain FROM a JOIN customer ON session = 'c' || c_custkey),
p AS (SELECT *, 3 AS s1, 3 + length(who) + 2 AS s2, 3 + length(who) + 2 + length(twice) + 21 AS s3, 3 + length(who) + 2 + length(twice) + 21 + length(twice) + 2 AS s4, 3 + length(who) + 2 + length(twice) + 21 + length(twice) + 2 + length(more) + 2 AS s5 FROM v)
SELECT session, turn, '<<PERSON_1>>' AS placeholder, 'entity' AS kind, 'high' AS severity, s1::BIGINT AS start, s1 + length(who) AS end, who AS cut, NULL AS formula FROM p
UNION ALL SELECT session, turn, '<python_snippet_1>', 'local_computation', 'low', s2, s2 + length(twice), twice, plain || ' * 2' FROM p
UNION ALL SELECT session, turn, '<python_snippet_3>', 'local_computation', 'low', s4, s4 + length(more), more, plain || ' + ' || k FROM p
UNION ALL SELECT session, turn, '<<PERSON_1>>', 'entity', 'high', s5, s5 + length(who), who, NULL FROM p""")
def annotated_answers(spark, sf_dir):
    """Answers for the user with the places of all that was restored and calculated, a sign of two UTF-16 units before them."""
    tail = F.concat(F.lit("<python_snippet_3>FINANCE_1 + "), (F.col("turn") % 3).cast("string"), F.lit("</python_snippet_3>, <<PERSON_1>>."))
    text = F.concat(F.lit("\U0001f4b3 <<PERSON_1>>, <python_snippet_1>FINANCE_1 * 2</python_snippet_1> by <<ORG_9>>; again <python_snippet_2>FINANCE_1*2</python_snippet_2>, "), tail)
    answers = _answers(spark, sf_dir).withColumn("text", text)
    money = _balances(spark, sf_dir).select(
        "session", F.lit("<<FINANCE_1>>").alias("placeholder"), F.lit("financial").alias("entity_type"), F.lit("$x").alias("canonical"), F.array(F.lit("$x")).alias("aliases"),
        F.col("values")["FINANCE_1"].alias("value"), F.lit(1).cast("long").alias("created_turn"), F.lit(1).cast("long").alias("last_seen_turn"),
    )
    out = turn_pipeline.finalize_annotated(answers, _people(spark, sf_dir).unionByName(money))
    rows = out.select("session", "turn", "display_text", F.inline("annotations"))
    cut = annotations.cut(F.col("display_text"), F.col("start"), F.col("end"))
    return rows.select("session", "turn", "placeholder", F.col("annotation_type").alias("kind"), "severity", "start", "end", cut.alias("cut"), "formula")


_SUMMARY = "'Known  <<PERSON_' || (o_orderkey % 3) || '>> and <<ORG_' || (o_orderkey % 4) || '>>' || chr(10) || 'told  by <<EMAIL_1>>.'"


@query("compaction_verdict", f"""WITH s AS (SELECT o_custkey AS session, o_orderkey AS win, {_SUMMARY} AS t FROM orders), k AS (SELECT *, list_filter(list_distinct(regexp_extract_all(t, '{grammar.PLACEHOLDER}')), lambda x: NOT list_contains(['<<PERSON_1>>', '<<EMAIL_1>>', '<<ORG_0>>'], x)) AS other FROM s),
v AS (SELECT *, list_sort(list_filter(other, lambda x: x IN ('<<PERSON_2>>', '<<ORG_3>>'))) AS renumbered, list_sort(list_filter(other, lambda x: x NOT IN ('<<PERSON_2>>', '<<ORG_3>>'))) AS made_up FROM k)
SELECT session, win AS "window", len(renumbered) = 0 AS accepted, CASE WHEN len(renumbered) > 0 THEN 'renumbered placeholder in summary' WHEN len(made_up) > 0 THEN 'repaired' ELSE 'clean' END AS reason,
    CASE WHEN len(renumbered) > 0 THEN NULL WHEN len(made_up) = 0 THEN t ELSE array_to_string(list_transform(string_split(list_reduce(list_concat([t], made_up), lambda a, x: replace(a, x, '')), chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), chr(10)) END AS repaired,
    array_to_string(made_up, ',') AS foreign_tokens, array_to_string(renumbered, ',') AS renumbered FROM v""")
def compaction_verdict(spark, sf_dir):
    """Summaries judged: tokens put in place of others reject one, made up ones are taken out."""
    key = F.col("o_orderkey")
    text = F.concat(F.lit("Known  <<PERSON_"), (key % 3).cast("string"), F.lit(">> and <<ORG_"), (key % 4).cast("string"), F.lit(">>\ntold  by <<EMAIL_1>>."))
    allowed = F.array(*map(F.lit, ("<<PERSON_1>>", "<<EMAIL_1>>", "<<ORG_0>>")))
    said = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session"), key.alias("window"), text.alias("summary"), allowed.alias("allowed"))
    tokens = F.array(*map(F.lit, ("<<PERSON_1>>", "<<EMAIL_1>>", "<<ORG_0>>", "<<PERSON_2>>", "<<ORG_3>>")))
    vault = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session"), F.explode(tokens).alias("placeholder"))
    out = compaction.verdict(said, vault)
    return out.select("session", "window", "accepted", "reason", "repaired", F.array_join("foreign", ",").alias("foreign_tokens"), F.array_join("renumbered", ",").alias("renumbered"))


@query("math_instructions", """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'Compute with a python snippet over these names; do not calculate yourself.' || chr(10) || '- FINANCE_' || (o_orderkey % 7) || chr(10) || '- CALC_2' ELSE '' END AS told FROM orders""")
def math_instructions(spark, sf_dir):
    key = F.col("o_orderkey")
    text = F.when(key % 2 == 0, F.concat(F.lit("<<PERSON_1>> owes <<FINANCE_"), (key % 7).cast("string"), F.lit(">> and <<CALC_2>>"))).otherwise(F.lit("hello <<PERSON_1>>"))
    return table(spark, sf_dir, "orders").select("o_orderkey", calc.instruction(calc.numeric_names(text)).alias("told"))


@query("turn_documents", f"""WITH {_TURNS_SQL} SELECT t.session, turn, 'note.txt' AS name, sha256(text) AS original_sha256, length(text)::INTEGER AS char_count, {_PREPARED} AS sanitized_text, left({_PREPARED}, 20) AS preview, 1::BIGINT AS chunks_total, true AS was_sanitized, 'financial,temporal' AS entity_types
    FROM t JOIN n p ON p.session = t.session AND p.surface = price JOIN n d ON d.session = t.session AND d.surface = day""")
def turn_documents(spark, sf_dir):
    """Documents that came as data URLs, sanitised, with a record of each."""
    url = F.concat(F.lit("data:text/plain;base64,"), F.base64(F.col("text").cast("binary")))
    media = sessions.data_urls(_turns(spark, sf_dir).select("session", "turn", F.lit("note.txt").alias("name"), url.alias("url")), "url")
    records, _ = turn_pipeline.documents(media.select("session", "turn", "name", "mime", "document"), _people(spark, sf_dir), preview=20)
    return records.drop("mime").withColumn("entity_types", F.array_join("entity_types", ","))


@query("goals_at_rest", f"""WITH {_TURNS_SQL} SELECT t.session, turn, CASE WHEN turn % 9 = 0 THEN '[message withheld; privacy detection failed]' ELSE {_PREPARED} END AS stored
    FROM t JOIN n p ON p.session = t.session AND p.surface = price JOIN n d ON d.session = t.session AND d.surface = day""")
def goals_at_rest(spark, sf_dir):
    """Goals as they are stored: sanitised, or withheld where detection failed."""
    done, _ = turn_pipeline.at_rest(_turns(spark, sf_dir), _people(spark, sf_dir), F.col("turn") % 9 == 0)
    return done.select("session", "turn", F.col("sanitized").alias("stored"))


@query("compacted_windows", f"""WITH {_TURNS_SQL} SELECT t.session, turn, turn % 4 <> 1 AS accepted, CASE turn % 4 WHEN 1 THEN 'renumbered placeholder in summary' WHEN 2 THEN 'repaired' ELSE 'clean' END AS reason,
    CASE turn % 4 WHEN 1 THEN NULL WHEN 2 THEN 'Sum: ' || replace({_PREPARED}, '<<PERSON_1>>', '<<PERSON_1>> or') ELSE 'Sum: ' || {_PREPARED} END AS summary
    FROM t JOIN n p ON p.session = t.session AND p.surface = price JOIN n d ON d.session = t.session AND d.surface = day""")
def compacted_windows(spark, sf_dir):
    """Windows summed up under guard: one summary in four names another's token, one a made-up one, one says a name in clear."""
    people = _people(spark, sf_dir)
    other = people.withColumn("placeholder", F.lit("<<PERSON_2>>")).withColumn("canonical", F.concat(F.lit("not "), "canonical")).withColumn("aliases", F.array("canonical"))
    names = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("session"), F.col("c_name").alias("who"))

    def summarize(c):
        kind = F.col("turn") % 4
        told = F.when(kind == 1, F.replace(c, F.lit("<<PERSON_1>>"), F.lit("<<PERSON_2>>"))).when(kind == 2, F.replace(c, F.lit("<<PERSON_1>>"), F.lit("<<PERSON_1>> or <<ORG_7>>")))
        return F.concat(F.lit("Sum: "), told.when(kind == 3, F.replace(c, F.lit("<<PERSON_1>>"), F.col("who"))).otherwise(c))

    windows = _turns(spark, sf_dir).join(names, "session")
    done, _ = turn_pipeline.compacted(windows, summarize, people.unionByName(other))
    return done
