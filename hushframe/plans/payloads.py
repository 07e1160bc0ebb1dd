"""Queries: sniffing, chunks, HTML, JSON, line search, text functions, arithmetic and the summary guard."""

from __future__ import annotations

from pyspark.sql import functions as F

from hushframe.functions import grammar, register, schemas
from hushframe.operators import calc, chunk, compaction, detect, search
from hushframe.plans.detection import _found_sql, _quoted
from hushframe.plans.registry import query
from hushframe.sources.tables import table, tasks


def _lits(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for v in values) + "]"


def _sniff_sql(c: str) -> str:
    head = f"lower(left(regexp_replace({c}, '^\\s+', ''), 512))"
    return f"""CASE WHEN {head} = '' THEN 'text' WHEN regexp_matches({head}, '^[{{\\[]') AND json_valid({c}) THEN 'json'
    WHEN len(list_filter({_lits(chunk.HTML_HINTS)}, lambda h: contains({head}, h))) > 0 THEN 'html'
    WHEN len(list_filter({_lits(chunk.MARKDOWN_STARTS)}, lambda h: starts_with({head}, h))) > 0 OR len(list_filter({_lits(chunk.MARKDOWN_HINTS)}, lambda h: contains(left({c}, 2048), h))) >= 2 THEN 'markdown' ELSE 'text' END"""


for _name, _source, _key, _text in (("sniff_documents", "documents", "doc_id", "text"), ("sniff_pages", "pages", "page_id", "html"), ("sniff_props", "events", "event_id", "props")):

    @query(_name, f"SELECT {_key}, {_sniff_sql(_text)} AS content_type FROM {_source}")
    def _run(spark, sf_dir, source=_source, key=_key, text=_text):
        return table(spark, sf_dir, source).select(key, chunk.sniff(F.col(text)).alias("content_type"))


@query("chunk_text", """SELECT doc_id, (s // 6000)::INTEGER AS idx, substr(text, s + 1, 6000) AS chunk, s AS span_start, s + length(substr(text, s + 1, 6000)) AS span_end
    FROM (SELECT doc_id, text, unnest(range(0, length(text), 6000))::INTEGER AS s FROM documents WHERE length(text) > 0)""")
def chunk_text(spark, sf_dir):
    return chunk.hard_cut(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("chunk_payloads")
def chunk_payloads(spark, sf_dir):
    """Chunks of documents and pages by their sniffed type (paragraph packing has no SQL; tests compare literal cases)."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    pages = table(spark, sf_dir, "pages").select((-F.col("page_id") - 1).alias("id"), F.col("html").alias("text"))
    return chunk.chunk(docs.unionByName(pages), "id")


_CHUNKS = f"""c AS (SELECT doc_id, s // 6000 AS idx, substr(text, s + 1, 6000) AS chunk FROM (SELECT doc_id, text, unnest(range(0, length(text), 6000)) AS s FROM documents WHERE length(text) > 0)),
f AS ({_found_sql('c', 'doc_id, idx', 'chunk')})"""


@query("chunk_coalesce", f"""WITH {_CHUNKS} SELECT doc_id, entity_text, arg_min(entity_type, (idx, detect_rank)) AS entity_type, min(idx)::INTEGER AS first_idx, count(DISTINCT idx) AS chunks FROM f GROUP BY doc_id, entity_text""")
def chunk_coalesce(spark, sf_dir):
    cut = chunk.hard_cut(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "idx", "chunk")
    return chunk.coalesce_chunks(detect.detect(cut, text="chunk"), "doc_id")


@query("chunk_traces", f"""WITH {_CHUNKS}, t AS (SELECT doc_id, idx, count(DISTINCT entity_text) AS n, string_agg(DISTINCT entity_type, ',' ORDER BY entity_type) AS types FROM f GROUP BY ALL)
SELECT doc_id, idx::INTEGER AS idx, coalesce(n, 0)::BIGINT AS entities, coalesce(types, '') AS entity_types, length(chunk) % 50 = 0 AS failed FROM c LEFT JOIN t USING (doc_id, idx)""")
def chunk_traces(spark, sf_dir):
    """What each chunk's detection found, and whether it failed."""
    cut = chunk.hard_cut(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "idx", "chunk")
    out = chunk.chunk_traces(cut, detect.detect(cut, text="chunk"), "doc_id", F.length("chunk") % 50 == 0)
    return out.withColumn("entity_types", F.array_join("entity_types", ","))


@query("sql_chunks", """SELECT doc_id, (s // 6000)::INTEGER AS idx, substr(text, s + 1, 6000) AS chunk FROM (SELECT doc_id, replace(text, chr(10) || chr(10), chr(10)) AS text, unnest(range(0, length(replace(text, chr(10) || chr(10), chr(10))), 6000)) AS s FROM documents WHERE length(text) > 0)
UNION ALL SELECT -1 - event_id, 0, string_agg('$.' || k || ': ' || json_extract_string(props, '$.' || k), chr(10) ORDER BY i) FROM (SELECT event_id, props, unnest(json_keys(props)) AS k, generate_subscripts(json_keys(props), 1) AS i FROM events) GROUP BY event_id""")
def sql_chunks(spark, sf_dir):
    """The chunkers as a table function of SQL, and functions by name."""
    register.register(spark)
    docs = table(spark, sf_dir, "documents").filter("length(text) > 0").select("doc_id", F.lit("text").alias("kind"), F.replace("text", F.lit("\n\n"), F.lit("\n")).alias("payload"))
    props = table(spark, sf_dir, "events").select((-1 - F.col("event_id")).alias("doc_id"), F.lit("json").alias("kind"), F.col("props").alias("payload"))
    return spark.sql("SELECT p.doc_id, c.idx, c.chunk FROM {payloads} p, LATERAL chunk_payload(p.kind, p.payload, 6000) c", payloads=docs.unionByName(props))


@query("html_meta", f"SELECT page_id, array_to_string(list_transform(list_zip(regexp_extract_all(html, {_quoted('(?i)' + chunk.META)}, 1), regexp_extract_all(html, {_quoted('(?i)' + chunk.META)}, 2)), lambda m: 'meta[' || m[1] || ']: ' || m[2]), chr(10)) AS metas FROM pages")
def html_meta(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(chunk.meta_lines(F.col("html")), "\n").alias("metas"))


@query("html_refs", f"""SELECT page_id, generate_subscripts(l, 1)::INTEGER - 1 AS place, unnest(l) AS ref FROM (SELECT page_id, list_filter(list_transform(regexp_extract_all(html, {_quoted('(?i)' + chunk.HREF)}, 1), lambda u: trim(u)),
    lambda u: regexp_matches(u, '^(mailto:|tel:|(?i:https?://|ftps?://|file://)|/|\\./|\\.\\./)')) AS l FROM pages)""")
def html_refs(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(chunk.references(F.col("html"))).alias("place", "ref"))


@query("html_text", """SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script>', ' ', 'g'), '(?is)<style\\b[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS visible FROM pages""")
def html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", chunk.visible_text(F.col("html")).alias("visible"))


@query("json_flatten", "SELECT event_id, '$.' || k AS path, json_extract_string(props, '$.' || k) AS leaf FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def json_flatten(spark, sf_dir):
    return chunk.flat_json(table(spark, sf_dir, "events"), "event_id", "props")


_PATTERN = "(?i)license"


@query("grep_count", f"SELECT doc_id, count(*) AS matches FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(line, '{_PATTERN}') GROUP BY doc_id")
def grep_count(spark, sf_dir):
    return search.grep_count(table(spark, sf_dir, "documents"), "doc_id", _PATTERN)


@query("grep_lines", f"SELECT * FROM (SELECT doc_id, generate_subscripts(l, 1)::INTEGER AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE regexp_matches(line, '{_PATTERN}')")
def grep_lines(spark, sf_dir):
    return search.grep(table(spark, sf_dir, "documents"), "doc_id", _PATTERN)


@query("grep_context", f"""WITH l AS (SELECT doc_id, generate_subscripts(l, 1)::INTEGER AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
m AS (SELECT *, regexp_matches(line, '{_PATTERN}') AS is_match FROM l), n AS (SELECT *, bool_or(is_match) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS near FROM m)
SELECT doc_id, line_no, line, is_match FROM n WHERE near""")
def grep_context(spark, sf_dir):
    return search.context(table(spark, sf_dir, "documents"), "doc_id", _PATTERN, 1, 2)


@query("grep_page", f"""SELECT doc_id, line_no, line FROM (SELECT doc_id, generate_subscripts(l, 1)::INTEGER AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))
WHERE regexp_matches(line, '{_PATTERN}') ORDER BY doc_id, line_no LIMIT 20 OFFSET 5""")
def grep_page(spark, sf_dir):
    """A page of matches: offset and limit are the feature."""
    return search.grep(table(spark, sf_dir, "documents"), "doc_id", _PATTERN).orderBy("doc_id", "line_no").offset(5).limit(20)


@query("line_budget", "SELECT doc_id, line_no FROM (SELECT doc_id, line_no, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) AS s FROM (SELECT doc_id, generate_subscripts(l, 1)::INTEGER AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))) WHERE s <= 1000")
def line_budget(spark, sf_dir):
    return search.within_budget(search.lines(table(spark, sf_dir, "documents"), "doc_id"), ["line_no"], "doc_id", "line", 1000).select("doc_id", "line_no")


@query("text_functions", """SELECT doc_id, CASE WHEN length(text) > 500 THEN left(text, 500) || chr(10) || '... (truncated)' ELSE text END AS cut, greatest(4, floor(length(text) / 4) + 4)::INTEGER AS tokens,
    CASE WHEN length(text) > 400 THEN left(text, 200) || chr(10) || chr(10) || '... (' || (length(text) - 400) || ' chars truncated) ...' || chr(10) || chr(10) || right(text, 200) ELSE text END AS both_ends,
    sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS collapsed_sha FROM documents""")
def text_functions(spark, sf_dir):
    c = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", grammar.truncate(c, 500).alias("cut"), grammar.token_estimate(c).alias("tokens"), grammar.head_and_tail(c, 400).alias("both_ends"), F.sha2(grammar.collapse(c), 256).alias("collapsed_sha"))


_SUM = "'Known <<PERSON_' || (o_orderkey % 3) || '>> and <<ORG_' || (o_orderkey % 2) || '>>, told by <<EMAIL_1>>.'"
_ALLOWED = "['<<PERSON_1>>', '<<EMAIL_1>>', '<<DATE_4>>']"


@query("token_set_diff", f"""WITH s AS (SELECT o_orderkey, {_SUM} AS t FROM orders), f AS (SELECT o_orderkey, list_distinct(regexp_extract_all(t, '{grammar.PLACEHOLDER}')) AS l FROM s),
d AS (SELECT o_orderkey, list_filter(l, lambda x: list_contains({_ALLOWED}, x)) AS kept, list_filter(l, lambda x: NOT list_contains({_ALLOWED}, x)) AS gone FROM f)
SELECT o_orderkey, array_to_string(list_sort(kept), ',') AS kept, array_to_string(list_sort(gone), ',') AS foreign_tokens,
    array_to_string(list_sort(list_filter(gone, lambda x: regexp_extract(x, '{grammar.PLACEHOLDER_TAG}', 1) IN ('PERSON', 'EMAIL', 'DATE'))), ',') AS renumbered FROM d""")
def token_set_diff(spark, sf_dir):
    key = F.col("o_orderkey")
    text = F.concat(F.lit("Known <<PERSON_"), (key % 3).cast("string"), F.lit(">> and <<ORG_"), (key % 2).cast("string"), F.lit(">>, told by <<EMAIL_1>>."))
    allowed = F.array(F.lit("<<PERSON_1>>"), F.lit("<<EMAIL_1>>"), F.lit("<<DATE_4>>"))
    found = table(spark, sf_dir, "orders").select("o_orderkey", compaction.check(text, allowed).alias("c"))
    joined = lambda name: F.array_join(F.array_sort(F.col(f"c.{name}")), ",")
    return found.select("o_orderkey", joined("kept").alias("kept"), joined("foreign").alias("foreign_tokens"), joined("renumbered").alias("renumbered"))


@query("math_snippets", """SELECT o_orderkey, 1 AS snippet, 'FINANCE_1 * 2 - VALUE_1 / 4' AS expression, o_totalprice * 2 - o_custkey / 4 AS result FROM orders UNION ALL
SELECT o_orderkey, 2 AS snippet, 'max(FINANCE_1, VALUE_1) + 1' AS expression, greatest(o_totalprice, o_custkey) + 1 AS result FROM orders""")
def math_snippets(spark, sf_dir):
    text = F.lit("So: <python_snippet_1>result = FINANCE_1 * 2 - VALUE_1 / 4</python_snippet_1> and <python_snippet_2>max(FINANCE_1, VALUE_1) + 1</python_snippet_2>.")
    values = F.create_map(F.lit("FINANCE_1"), F.col("o_totalprice"), F.lit("VALUE_1"), F.col("o_custkey").cast("double"))
    # The work of a row is far more than its bytes, by which files are dealt to tasks.
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_custkey").repartition(tasks(spark))
    answers = orders.select("o_orderkey", text.alias("text"), values.alias("values"))
    return calc.compute(answers, ["o_orderkey"]).select("o_orderkey", "snippet", "expression", "result")


#: Arguments of an event as a tool would take them.
_ARGUMENTS = {
    "type": "object",
    "properties": {
        "kind": {"type": "string", "enum": ["click", "view", "purchase"], "maxLength": 6},
        "value": {"type": "number", "minimum": 5, "maximum": 200},
        "props": {"type": "object", "properties": {"k": {"type": "integer", "minimum": 10, "maximum": 80}}, "required": ["k", "z"]},
        "marks": {"type": ["array", "null"], "items": {"type": "integer"}, "minItems": 2},
        "note": {"type": "string"},
    },
    "required": ["kind", "note"],
}


def _arguments(spark, sf_dir):
    """Events as arguments: value as a text in one of three, marks that hold a text or are too few or null."""
    key = F.col("event_id")
    value = F.when(key % 3 == 0, F.concat(F.lit('"'), F.col("value").cast("decimal(12,2)").cast("string"), F.lit('"'))).otherwise(F.col("value").cast("decimal(12,2)").cast("string"))
    marks = F.when(key % 4 == 0, F.lit("null")).when(key % 4 == 1, F.lit("[7]")).when(key % 4 == 2, F.concat(F.lit("[1, "), key.cast("string"), F.lit(', "x", true]'))).otherwise(F.lit("[1, 2.0]"))
    note = F.when(key % 5 == 0, F.lit("")).otherwise(F.concat(F.lit(', "note": '), F.when(key % 5 == 1, key.cast("string")).otherwise(F.lit('"n"'))))
    text = F.concat(F.lit('{"kind": "'), "event_type", F.lit('", "value": '), value, F.lit(', "props": '), "props", F.lit(', "marks": '), marks, note, F.lit("}"))
    # The work of a row is far more than its bytes, by which files are dealt to tasks.
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value", "props").repartition(tasks(spark))
    return events.select("event_id", text.alias("arguments"))


_ARGUMENT_SQL = """a AS (SELECT event_id, event_type, value::DECIMAL(12,2) AS v, (props->>'$.k')::INTEGER AS k FROM events)"""


def _violations_sql(cast: bool) -> str:
    """Messages on the arguments, before or after they are cast."""
    value = "v < 5" if cast else "event_id % 3 <> 0 AND v < 5"
    above = "v > 200" if cast else "event_id % 3 <> 0 AND v > 200"
    text = "[]" if cast else "CASE WHEN event_id % 3 = 0 THEN ['value should be number'] ELSE [] END"
    note = "[]" if cast else "CASE WHEN event_id % 5 = 1 THEN ['note should be string'] ELSE [] END"
    one = lambda test, said: f"CASE WHEN {test} THEN ['{said}'] ELSE [] END"
    parts = [
        one("event_id % 5 = 0", "missing required note"), one("event_type NOT IN (''click'', ''view'', ''purchase'')".replace("''", "'"), "kind must be one of [''click'', ''view'', ''purchase'']"),
        one("length(event_type) > 6", "kind must be at most 6 chars"), text, one(value, "value must be >= 5"), one(above, "value must be <= 200"), one("true", "missing required props.z"),
        one("k < 10", "props.k must be >= 10"), one("k > 80", "props.k must be <= 80"), one("event_id % 4 = 1", "marks must have at least 2 items"),
        "CASE WHEN event_id % 4 = 2 THEN ['marks[2] should be integer', 'marks[3] should be integer'] ELSE [] END", note,
    ]
    return " || ".join(parts)


@query("argument_checks", f"WITH {_ARGUMENT_SQL} SELECT event_id, array_to_string({_violations_sql(False)}, '; ') AS told, array_to_string({_violations_sql(True)}, '; ') AS told_after_cast FROM a")
def argument_checks(spark, sf_dir):
    """Arguments checked by the schema of their tool, as they are and after what can be cast safely is cast."""
    rows = _arguments(spark, sf_dir)
    told = lambda c: F.array_join(schemas.violations(c, _ARGUMENTS), "; ")
    cast = schemas.cast(F.col("arguments"), _ARGUMENTS)
    return rows.select("event_id", told(F.col("arguments")).alias("told"), cast.alias("_cast")).select("event_id", "told", told(F.col("_cast")).alias("told_after_cast"))
