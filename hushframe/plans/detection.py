"""Queries: detection, entity counts, placeholders, policy, sanitising and restoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from hushframe.functions import grammar, policy, taxonomy
from hushframe.operators import detect, report, vault
from hushframe.plans.registry import query
from hushframe.sources.tables import keep, table

_RULE = {slug: (pattern, group) for slug, pattern, group, _ in detect.RULES}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _extract(slug: str, text: str = "text") -> str:
    pattern, group = _RULE[slug]
    found = f"regexp_extract_all({text}, {_quoted(pattern)}, {group})"
    if slug == "local_path":
        found = f"list_filter(list_transform({found}, lambda x: regexp_replace(x, '[.,;:!?)\\\\\\]}}]+$', '')), lambda x: x <> '')"
    return found


def _found_sql(source: str, key: str, text: str) -> str:
    parts = [
        f"SELECT {key}, {rank} AS source_rank, {i} * 1000000 + generate_subscripts(l, 1) - 1 AS detect_rank, unnest(l) AS entity_text, '{slug}' AS entity_type FROM (SELECT {key}, {_extract(slug, text)} AS l FROM {source})"
        for i, (slug, _, _, rank) in enumerate(detect.RULES)
    ]
    return " UNION ALL ".join(parts)


_PRIORITY = "CASE entity_type " + " ".join(f"WHEN '{s}' THEN {p}" for s, p in taxonomy.PRIORITY.items()) + " ELSE 0 END"
_TAG = "CASE entity_type " + " ".join(f"WHEN '{s}' THEN '{t}'" for s, t in taxonomy.TAGS.items()) + " ELSE 'ENTITY' END"
FOUND = f"found AS ({_found_sql('documents', 'doc_id', 'text')})"
ENTITIES = f"""{FOUND},
entities AS (SELECT * FROM found WHERE NOT regexp_matches(entity_text, '{grammar.INTERNAL_TOKEN}')
    QUALIFY row_number() OVER (PARTITION BY doc_id, entity_text ORDER BY {_PRIORITY} DESC, source_rank, detect_rank) = 1)"""
MINTED = f"""{ENTITIES},
sourced AS (SELECT source, e.* FROM entities e JOIN documents USING (doc_id)),
surfaces AS (SELECT source, entity_text, arg_min(entity_type, (doc_id, -length(entity_text), detect_rank)) AS entity_type, min((doc_id, -length(entity_text), detect_rank)) AS f, max(doc_id) AS last_seen_turn
    FROM sourced GROUP BY ALL),
minted AS (SELECT source, entity_text AS canonical, entity_type, f[1] AS created_turn, last_seen_turn,
    '<<' || {_TAG} || '_' || row_number() OVER (PARTITION BY source, {_TAG} ORDER BY f, entity_text) || '>>' AS placeholder FROM surfaces)"""


def _detect_query(name: str, slug: str, source: str, key: str, text: str, sql: str | None = None) -> None:
    """A query of one rule's matches; text: a Spark SQL expression, sql: the same for DuckDB where it differs."""

    @query(name, f"SELECT {key}, generate_subscripts(l, 1)::BIGINT - 1 AS place, unnest(l) AS entity_text FROM (SELECT {key}, {_extract(slug, sql or text)} AS l FROM {source})")
    def run(spark, sf_dir):
        found = detect.matches(F.col("_text"), slug)
        rows = table(spark, sf_dir, source).select(key, F.expr(text).alias("_text"))
        return rows.select(key, F.posexplode(found).alias("place", "entity_text")).withColumn("place", F.col("place").cast("long"))


for _name, _slug in (("detect_email", "email"), ("detect_ip", "ip_address"), ("detect_phone", "phone"), ("detect_credential", "credential"), ("detect_card", "identifier")):
    _detect_query(_name, _slug, "documents", "doc_id", "text")
_detect_query("detect_email_pages", "email", "pages", "page_id", "html")
_detect_query("detect_url_pages", "url", "pages", "page_id", "concat('see ', url, ' or <a href=\"', url, '\">', html)", "'see ' || url || ' or <a href=\"' || url || '\">' || html")
_PAID = "'paid $' || o_totalprice || ', fee $1,200.50 and ' || o_custkey || '.5% of ' || o_orderkey || '%, 7 %'"
_PAID_SPARK = "concat('paid $', cast(o_totalprice AS string), ', fee $1,200.50 and ', o_custkey, '.5% of ', o_orderkey, '%, 7 %')"
_detect_query("detect_money", "financial", "orders", "o_orderkey", _PAID_SPARK, _PAID)
_detect_query("detect_percentage", "percentage", "orders", "o_orderkey", _PAID_SPARK, _PAID)
_PATHS = "'/srv/p' || p_partkey || '/a.html, ~/x (' || p_name || ') C:\\d\\' || p_partkey || '; file://h/' || p_partkey || ').'"
_detect_query("detect_path", "local_path", "part", "p_partkey", _PATHS.replace("\\", "\\\\"), _PATHS)


def _entities(spark, sf_dir):
    return detect.by_priority(detect.detect(table(spark, sf_dir, "documents").select("doc_id", "source", "text")), ["doc_id"])


@query("detect_priority_dedup", f"WITH {ENTITIES} SELECT doc_id, entity_text, entity_type, {_PRIORITY}::INTEGER AS priority FROM entities")
def detect_priority_dedup(spark, sf_dir):
    return _entities(spark, sf_dir).select("doc_id", "entity_text", "entity_type", taxonomy.priority_of(F.col("entity_type")).alias("priority"))


_VALUES = f"""f AS (SELECT o_orderkey, unnest({_extract('financial', 'x')}) AS entity_text, 'financial' AS entity_type FROM (SELECT o_orderkey, {_PAID} AS x FROM orders) UNION ALL
    SELECT o_orderkey, unnest({_extract('percentage', 'x')}), 'percentage' FROM (SELECT o_orderkey, {_PAID} AS x FROM orders))"""


@query("entity_values", f"""WITH {_VALUES} SELECT DISTINCT o_orderkey, entity_text, CASE entity_type WHEN 'financial' THEN try_cast(regexp_replace(entity_text, '[$,%]', '', 'g') AS DOUBLE)
    ELSE try_cast(regexp_replace(entity_text, '[$,%]', '', 'g') AS DOUBLE) / 100 END AS value_num FROM f""")
def entity_values(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_PAID_SPARK).alias("text"))
    found = detect.by_priority(detect.detect(rows, types=("financial", "percentage")), ["o_orderkey"])
    return found.select("o_orderkey", "entity_text", detect.number_value(F.col("entity_text"), F.col("entity_type")).alias("value_num"))


@query("entity_counts", f"WITH {ENTITIES} SELECT upper(entity_type) AS entity_type, 'high' AS severity, count(*) AS n FROM entities GROUP BY ALL")
def entity_counts(spark, sf_dir):
    return report.summarize_entities(_entities(spark, sf_dir))


@query("mint_placeholders", f"WITH {MINTED} SELECT * FROM minted")
def mint_placeholders(spark, sf_dir):
    return detect.mint(_entities(spark, sf_dir), "source", "doc_id")


@query("session_snapshot", f"""WITH {MINTED} SELECT source, {_TAG} AS tag, count(*) AS placeholders, min(created_turn) AS first_turn, max(last_seen_turn) AS last_turn,
    sum(CASE WHEN entity_type IN ({', '.join(repr(s) for s in sorted(taxonomy.TAGS))}) THEN 1 ELSE 0 END)::BIGINT AS high_severity FROM minted GROUP BY ALL""")
def session_snapshot(spark, sf_dir):
    return report.session_snapshot(detect.mint(_entities(spark, sf_dir), "source", "doc_id"), "source")


def _sanitized(spark, sf_dir):
    """Documents, their entities (detected once and kept) and the tokens of each session."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    found = keep(_entities(spark, sf_dir))
    return docs, found, detect.mint(found, "source", "doc_id")


#: Surfaces give way one after the other, the longest first.
_SANITIZED = f"""{MINTED},
own AS (SELECT doc_id, entity_text, placeholder, row_number() OVER (PARTITION BY doc_id ORDER BY length(entity_text) DESC, entity_text) AS k FROM sourced s JOIN minted m ON s.source IS NOT DISTINCT FROM m.source AND s.entity_text = m.canonical),
step AS (SELECT doc_id, text AS t, 0::BIGINT AS k FROM documents UNION ALL SELECT s.doc_id, replace(s.t, o.entity_text, o.placeholder), o.k FROM step s JOIN own o ON o.doc_id = s.doc_id AND o.k = s.k + 1)"""


@query("sanitize_documents", f"WITH RECURSIVE {_SANITIZED} SELECT doc_id, arg_max(t, k) AS sanitized, max(k) > 0 AS modified FROM step GROUP BY doc_id")
def sanitize_documents(spark, sf_dir):
    """Each document with its surfaces replaced by the tokens of its session."""
    docs, found, minted = _sanitized(spark, sf_dir)
    return vault.apply_minted(docs, found, minted, "source", "doc_id").select("doc_id", "sanitized", "modified")


@query("restore_documents", "SELECT doc_id, text AS restored FROM documents")
def restore_documents(spark, sf_dir):
    """Sanitise and restore: the texts as they were."""
    docs, found, minted = _sanitized(spark, sf_dir)
    minted = keep(minted)
    clean = vault.apply_minted(docs, found, minted, "source", "doc_id").select("doc_id", "source", F.col("sanitized").alias("text"))
    return vault.restore(clean, minted, "source", ["doc_id"]).select("doc_id", F.col("restored"))


#: Surfaces of a session get their numbers with the turn that names them first.
_TURNS_SQL = """t AS (SELECT 'c' || c_custkey AS session, o_orderkey AS turn, 'Order for ' || c_name || ' paid $' || o_totalprice || ' on ' || strftime(o_orderdate, '%Y-%m-%d') || '.' AS text, '$' || o_totalprice AS price, strftime(o_orderdate, '%Y-%m-%d') AS day
    FROM orders JOIN customer ON o_custkey = c_custkey),
s AS (SELECT session, price AS surface, 'FINANCE' AS tag, min(turn) AS first FROM t GROUP BY ALL UNION ALL SELECT session, day, 'DATE', min(turn) FROM t GROUP BY ALL),
n AS (SELECT *, '<<' || tag || '_' || row_number() OVER (PARTITION BY session, tag ORDER BY first) || '>>' AS token FROM s)"""


@query("vault_turns", f"""WITH {_TURNS_SQL} SELECT t.session, turn, replace(replace(text, price, p.token), day, d.token) AS sanitized, true AS modified
    FROM t JOIN n p ON p.session = t.session AND p.surface = price JOIN n d ON d.session = t.session AND d.surface = day""")
def vault_turns(spark, sf_dir):
    """The sequential vault (aliases, reuse across turns) over the orders of customers."""
    return vault.sanitize_sessions(_turns(spark, sf_dir)).select("session", "turn", "sanitized", "modified")


@query("minted_turns", f"""WITH {_TURNS_SQL} SELECT t.session, turn, replace(replace(text, price, p.token), day, d.token) AS sanitized, true AS modified
    FROM t JOIN n p ON p.session = t.session AND p.surface = price JOIN n d ON d.session = t.session AND d.surface = day""")
def minted_turns(spark, sf_dir):
    """The same by the set-based way: no session is gathered."""
    turns = _turns(spark, sf_dir)
    found = keep(detect.by_priority(detect.detect(turns), ["session", "turn"]))
    return vault.apply_minted(turns, found, detect.mint(found, "session", "turn"), "session", "turn").select("session", "turn", "sanitized", "modified")


@query("restored_turns", """SELECT 'c' || c_custkey AS session, o_orderkey AS turn, 'Order for ' || c_name || ' paid $' || o_totalprice || ' on ' || strftime(o_orderdate, '%Y-%m-%d') || '.' AS restored
    FROM orders JOIN customer ON o_custkey = c_custkey""")
def restored_turns(spark, sf_dir):
    return vault.sanitize_sessions(_turns(spark, sf_dir)).select("session", "turn", "restored")


def _turns(spark, sf_dir):
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    text = F.concat(F.lit("Order for "), "c_name", F.lit(" paid $"), F.col("o_totalprice").cast("string"), F.lit(" on "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("."))
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("session"), F.col("o_orderkey").alias("turn"), text.alias("text"))


_TOOLS = ("read_file", "list_dir", "write_file", "exec", "my", "web_fetch", "generate_image", "run_cli_app", "mcp_github_list", "totally_new_uploader", "brand_new_unknown_x", "", "read_file_v2", "Grep_all", "post_message", " cron ")


def _in(values) -> str:
    return ", ".join(_quoted(v) for v in values)


def _hints(values) -> str:
    return " OR ".join(f"contains(lower(t), {_quoted(v)})" for v in values)


_CLASS = f"""CASE WHEN t = '' THEN 'external' WHEN t IN ({_in(policy.CLI_TOOLS)}) OR starts_with(t, 'mcp_') OR t IN ({_in(policy.EXTERNAL_TOOLS)}) THEN 'external'
    WHEN t IN ({_in(policy.LOCAL_TOOLS)}) THEN 'local' WHEN t IN ({_in(policy.SIDE_EFFECT_TOOLS)}) THEN 'side_effect'
    WHEN {_hints(policy.NETWORK_HINTS)} THEN 'external' WHEN {_hints(policy.LOCAL_HINTS)} THEN 'local' ELSE 'external' END"""


@query("egress_policy", f"""WITH tools(name) AS (VALUES {', '.join(f'({_quoted(t)})' for t in _TOOLS)}), calls AS (SELECT event_id, trim(name) AS t, name FROM events JOIN tools ON true WHERE event_id % {len(_TOOLS)} = (SELECT count(*) FROM tools s WHERE s.name < tools.name))
SELECT event_id, name, {_CLASS} AS privacy_class, {_CLASS} = 'external' AS requires_approval FROM calls""")
def egress_policy(spark, sf_dir):
    names = F.array(*[F.lit(t) for t in sorted(_TOOLS)])
    calls = table(spark, sf_dir, "events").select("event_id", F.element_at(names, (F.col("event_id") % len(_TOOLS)).cast("int") + 1).alias("name"))
    return calls.select("event_id", "name", policy.privacy_class(F.col("name")).alias("privacy_class"), policy.requires_approval(F.col("name")).alias("requires_approval"))


_OVERRIDES = {"exec": ("external", False), "totally_new_uploader": ("local", True), "grep_all": "side_effect", "my": "local"}


@query("egress_overrides", f"""WITH tools(name) AS (VALUES {', '.join(f'({_quoted(t)})' for t in (*_TOOLS, "grep_all"))}), k AS (SELECT DISTINCT p_brand, trim(name) AS t, name FROM part JOIN tools ON true)
SELECT p_brand, name, CASE t WHEN 'exec' THEN 'external' WHEN 'totally_new_uploader' THEN 'local' WHEN 'grep_all' THEN 'side_effect' WHEN 'my' THEN 'local' ELSE {_CLASS} END AS privacy_class,
    CASE t WHEN 'exec' THEN false WHEN 'totally_new_uploader' THEN true WHEN 'grep_all' THEN false WHEN 'my' THEN false ELSE {_CLASS} = 'external' END AS requires_approval,
    p_brand = 'Brand#11' OR p_brand = 'Brand#23' AS app_allowed FROM k""")
def egress_overrides(spark, sf_dir):
    """The policy with decisions of the host's own, which carry their own approval flag; and applications on a list."""
    names = F.explode(F.array(*[F.lit(t) for t in (*_TOOLS, "grep_all")])).alias("name")
    calls, name = table(spark, sf_dir, "part").select("p_brand").distinct().select("p_brand", names), F.col("name")
    allowed = policy.cli_app_allowed(F.col("p_brand"), ("Brand#11", "Brand#23"))
    return calls.select("p_brand", "name", policy.privacy_class(name, _OVERRIDES).alias("privacy_class"), policy.requires_approval(name, _OVERRIDES).alias("requires_approval"), allowed.alias("app_allowed"))


_PROMPT = "'Compare <<' || upper(l_returnflag) || 'X_' || l_linenumber || '>> with <<FINANCE_' || l_linenumber || '>>' || CASE WHEN l_linenumber % 2 = 0 THEN ' of <<PERSON_1>>' ELSE '' END"
_TAGS_SQL = f"list_distinct(regexp_extract_all(p, '{grammar.PLACEHOLDER_TAG}', 1))"


@query("high_severity_gate", f"""WITH prompts AS (SELECT l_orderkey, l_linenumber, {_PROMPT} AS p FROM lineitem)
SELECT l_orderkey, l_linenumber, list_has_any({_TAGS_SQL}, [{_in(sorted(taxonomy.SLUGS))}]) AS severe, list_has_any(list_transform({_TAGS_SQL}, lambda x: lower(x)), [{_in(sorted(taxonomy.TAGS))}]) AS severe_parity,
    len({_TAGS_SQL})::INTEGER AS n_tags FROM prompts""")
def high_severity_gate(spark, sf_dir):
    flag, line = F.col("l_returnflag"), F.col("l_linenumber").cast("string")
    prompt = F.concat(F.lit("Compare <<"), F.upper(flag), F.lit("X_"), line, F.lit(">> with <<FINANCE_"), line, F.lit(">>"), F.when(F.col("l_linenumber") % 2 == 0, F.lit(" of <<PERSON_1>>")).otherwise(F.lit("")))
    p = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", prompt.alias("p"))
    return p.select("l_orderkey", "l_linenumber", policy.high_severity_prompt(F.col("p")).alias("severe"), policy.high_severity_prompt(F.col("p"), parity=True).alias("severe_parity"), F.size(grammar.tags(F.col("p"))).alias("n_tags"))


@query("normalize_alias", "SELECT s_suppkey, coalesce(nullif(regexp_replace(a, '[^\\w\\s]', '', 'g'), ''), a) AS alias_key FROM (SELECT s_suppkey, lower(trim(regexp_replace(s_name, '\\s+', ' ', 'g'))) AS a FROM supplier)")
def normalize_alias(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", grammar.alias_key_ascii(F.col("s_name")).alias("alias_key"))


@query("alias_resolve", """WITH known AS (SELECT c_nationkey AS session, '<<PERSON_' || c_custkey || '>>' AS placeholder, lower(replace(c_name, '#', ' ')) AS alias FROM customer),
asked AS (SELECT s_suppkey, s_nationkey AS session, lpad((s_suppkey * 7 % 300)::VARCHAR, 9, '0') AS q FROM supplier)
SELECT s_suppkey, CASE WHEN count(DISTINCT placeholder) = 1 THEN min(placeholder) END AS placeholder FROM asked a LEFT JOIN known k ON a.session = k.session AND list_contains(string_split(alias, ' '), q) GROUP BY s_suppkey""")
def alias_resolve(spark, sf_dir):
    known = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("session"), F.concat(F.lit("<<PERSON_"), F.col("c_custkey").cast("string"), F.lit(">>")).alias("placeholder"), F.lower(F.replace("c_name", F.lit("#"), F.lit(" "))).alias("alias"))
    asked = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("session"), F.lpad((F.col("s_suppkey") * 7 % 300).cast("string"), 9, "0").alias("surface"))
    return vault.resolve_aliases(asked, known, ["s_suppkey"]).select("s_suppkey", "placeholder")


@query("alias_resolve_names", """WITH known AS (SELECT c_nationkey AS session, '<<ORG_' || (ascii(c_mktsegment) * 10 + c_custkey % 3) || '>>' AS placeholder, lower(c_mktsegment) || CASE c_custkey % 3 WHEN 0 THEN ' works inc' WHEN 1 THEN ' of nation ' || c_nationkey ELSE ' trading' END AS alias FROM customer),
asked AS (SELECT s_suppkey, s_nationkey AS session, CASE s_suppkey % 5 WHEN 0 THEN 'building works' WHEN 1 THEN 'machinery' WHEN 2 THEN 'furniture of nation ' || s_nationkey || ' limited' WHEN 3 THEN 'works inc' ELSE 'household' END AS q FROM supplier),
fit AS (SELECT s_suppkey, placeholder FROM asked a JOIN known k ON a.session = k.session AND (alias = q OR CASE WHEN contains(q, ' ') THEN starts_with(alias, q) OR ends_with(alias, q) OR starts_with(q, alias) OR ends_with(q, alias) ELSE length(q) >= 2 AND list_contains(string_split(alias, ' '), q) END))
SELECT s_suppkey, CASE WHEN count(DISTINCT placeholder) = 1 THEN min(placeholder) END AS placeholder FROM asked LEFT JOIN fit USING (s_suppkey) GROUP BY s_suppkey""")
def alias_resolve_names(spark, sf_dir):
    """Names of several words: parts at either end of a known name, and names with more at either end."""
    key = F.col("c_custkey") % 3
    alias = F.concat(F.lower("c_mktsegment"), F.when(key == 0, F.lit(" works inc")).when(key == 1, F.concat(F.lit(" of nation "), F.col("c_nationkey").cast("string"))).otherwise(F.lit(" trading")))
    number = (F.ascii("c_mktsegment") * 10 + key).cast("string")
    known = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("session"), F.concat(F.lit("<<ORG_"), number, F.lit(">>")).alias("placeholder"), alias.alias("alias"))
    kind = F.col("s_suppkey") % 5
    limited = F.concat(F.lit("furniture of nation "), F.col("s_nationkey").cast("string"), F.lit(" limited"))
    surface = F.when(kind == 0, F.lit("building works")).when(kind == 1, F.lit("machinery")).when(kind == 2, limited).when(kind == 3, F.lit("works inc")).otherwise(F.lit("household"))
    asked = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("session"), surface.alias("surface"))
    return vault.resolve_aliases(asked, known, ["s_suppkey"]).select("s_suppkey", "placeholder")


@query("doc_redaction_record", f"""WITH {ENTITIES}, types AS (SELECT doc_id, string_agg(DISTINCT entity_type, ',' ORDER BY entity_type) AS entity_types FROM entities GROUP BY doc_id)
SELECT doc_id, sha256(text) AS original_sha256, length(text)::INTEGER AS char_count, ceil(length(text) / 6000.0)::BIGINT AS chunks_total, entity_types IS NOT NULL AS was_sanitized, coalesce(entity_types, '') AS entity_types
FROM documents LEFT JOIN types USING (doc_id)""")
def doc_redaction_record(spark, sf_dir):
    return report.document_records(table(spark, sf_dir, "documents"), _entities(spark, sf_dir))
