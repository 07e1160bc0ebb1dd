"""Queries: leak evaluation over turns made of customers and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from hushframe.operators import leak, turns
from hushframe.plans.registry import query
from hushframe.sources.tables import table

_BASE = """t AS (SELECT c_custkey AS session, o_orderkey AS turn, c_mktsegment AS domain, 'Order ' || o_orderkey || ' of ' || c_name || ' in ' || c_mktsegment AS raw,
    CASE o_orderkey % 7 WHEN 0 THEN 'Order ' || o_orderkey || ' of ' || c_name || ' in <<ORG_1>>' WHEN 1 THEN 'Order of Customer <<ID_1>> in ' || lower(c_mktsegment) ELSE 'Order <<ID_' || o_orderkey || '>> of <<PERSON_1>> in <<ORG_1>>' END AS prepared,
    (o_orderkey % 1000)::BIGINT AS latency_ms FROM orders JOIN customer ON o_custkey = c_custkey),
g AS (SELECT c_custkey AS session, 'PERSON' AS entity_type, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'ORG', c_mktsegment FROM customer UNION ALL SELECT c_custkey, 'GEO', 'in' FROM customer),
tok AS (SELECT *, list_filter(regexp_extract_all(value, '[\\p{L}\\p{N}_]+'), lambda p: regexp_full_match(p, '\\p{Nd}{3,}') OR regexp_full_match(p, '\\p{L}{4,}')) AS l FROM t JOIN g USING (session) WHERE contains(raw, value)),
pairs AS (SELECT session, turn, domain, entity_type, value, latency_ms, len(list_filter(l, lambda x: contains(prepared, x))) > 0 AS leaked, len(l)::INTEGER AS tokens, len(list_filter(l, lambda x: contains(prepared, x)))::INTEGER AS leaked_tokens, prepared FROM tok WHERE len(l) > 0)"""


def _turns(spark, sf_dir):
    """Turns as sent out: a seventh with the name left in, a seventh with a part of it and the segment in other letters."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    key, seventh = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 7
    joined = orders.select("o_orderkey", "o_custkey").join(customer.select("c_custkey", "c_name", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    raw = F.concat(F.lit("Order "), key, F.lit(" of "), "c_name", F.lit(" in "), "c_mktsegment")
    kept = F.concat(F.lit("Order "), key, F.lit(" of "), "c_name", F.lit(" in <<ORG_1>>"))
    part = F.concat(F.lit("Order of Customer <<ID_1>> in "), F.lower("c_mktsegment"))
    hidden = F.concat(F.lit("Order <<ID_"), key, F.lit(">> of <<PERSON_1>> in <<ORG_1>>"))
    prepared = F.when(seventh == 0, kept).when(seventh == 1, part).otherwise(hidden)
    return joined.select(F.col("c_custkey").alias("session"), F.col("o_orderkey").alias("turn"), F.col("c_mktsegment").alias("domain"), raw.alias("raw"), prepared.alias("prepared"), (F.col("o_orderkey") % 1000).alias("latency_ms"))


def _truth(spark, sf_dir):
    value = lambda kind, c: F.struct(F.lit(kind).alias("entity_type"), c.alias("value"))
    every = F.array(value("PERSON", F.col("c_name")), value("ORG", F.col("c_mktsegment")), value("GEO", F.lit("in")))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session"), F.inline(every))


def _pairs(spark, sf_dir):
    return leak.pairs(_turns(spark, sf_dir), _truth(spark, sf_dir))


@query("leak_pairs", f"WITH {_BASE} SELECT session, turn, entity_type, value, leaked, tokens, leaked_tokens FROM pairs")
def leak_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).select("session", "turn", "entity_type", "value", "leaked", "tokens", "leaked_tokens")


_RATES = "count(*) AS pairs, count(*) FILTER (leaked) AS leaked_pairs, sum(tokens)::BIGINT AS tokens, sum(leaked_tokens)::BIGINT AS leaked_tokens"


@query("leak_by_type", f"WITH {_BASE} SELECT entity_type, {_RATES}, count(*) FILTER (leaked) / count(*) AS pair_rate, sum(leaked_tokens) / sum(tokens) AS token_rate FROM pairs GROUP BY entity_type")
def leak_by_type(spark, sf_dir):
    return leak.score(_pairs(spark, sf_dir), ["entity_type"])


@query("leak_by_session", f"WITH {_BASE} SELECT session, {_RATES}, count(*) FILTER (leaked) / count(*) AS pair_rate, sum(leaked_tokens) / nullif(sum(tokens), 0) AS token_rate FROM pairs GROUP BY session")
def leak_by_session(spark, sf_dir):
    return leak.score(_pairs(spark, sf_dir), ["session"])


@query("leak_rollup", f"WITH {_BASE} SELECT domain, entity_type, {_RATES} FROM pairs GROUP BY GROUPING SETS ((domain), (entity_type), ())")
def leak_rollup(spark, sf_dir):
    return leak.rollup(_pairs(spark, sf_dir), "domain", "entity_type")


_ALIAS = """p AS (SELECT *, nullif(regexp_extract(prepared, '<<' || entity_type || '_\\d+>>'), '') AS placeholder FROM pairs),
seen AS (SELECT session, value, bool_and(placeholder IS NOT NULL) AND count(DISTINCT placeholder) = 1 AS consistent FROM p GROUP BY session, value HAVING count(DISTINCT turn) >= 2),
al AS (SELECT c_mktsegment AS domain, session, count(*) AS multi, count(*) FILTER (consistent) AS good FROM seen JOIN customer ON c_custkey = session GROUP BY ALL),
ad AS (SELECT domain, sum(multi)::BIGINT AS multi_turn_values, sum(multi * (good / multi)) / sum(multi) AS alias_rate FROM al GROUP BY domain),
sc AS (SELECT domain, count(*) AS pairs, count(*) FILTER (leaked) AS leaked_pairs, sum(tokens)::BIGINT AS tokens, sum(leaked_tokens)::BIGINT AS leaked_tokens FROM pairs GROUP BY domain)"""


def _by_domain(spark, sf_dir):
    found = _pairs(spark, sf_dir)
    alias = leak.consistency(_with_tokens(found)).join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session"), F.col("c_mktsegment").alias("domain")), "session")
    alias = alias.groupBy("domain", "session").agg(F.count("*").alias("multi"), F.count_if("consistent").alias("consistent"))
    return leak.cross_sessions(found, alias, ["domain"])


@query("leak_by_domain", f"WITH {_BASE}, {_ALIAS} SELECT domain, pairs, leaked_pairs, tokens, leaked_tokens, leaked_pairs / pairs AS pair_rate, leaked_tokens / tokens AS token_rate, multi_turn_values, round(alias_rate, 9) AS alias_rate FROM sc LEFT JOIN ad USING (domain)")
def leak_by_domain(spark, sf_dir):
    """Scores by domain, the alias rate weighted by the values that recur."""
    return _by_domain(spark, sf_dir).withColumn("alias_rate", F.round("alias_rate", 9))


@query("leak_domains", f"""WITH {_BASE}, {_ALIAS}, r AS (SELECT domain, latency_ms, row_number() OVER (PARTITION BY domain ORDER BY latency_ms) - 1 AS i, count(*) OVER (PARTITION BY domain) AS n FROM t),
lat AS (SELECT domain, min(latency_ms) FILTER (i = round_even(0.95 * (n - 1), 0)) AS p95 FROM r GROUP BY domain)
SELECT count(*) AS domains, sum(pairs)::BIGINT AS pairs, sum(leaked_pairs)::BIGINT AS leaked_pairs, sum(tokens)::BIGINT AS tokens, sum(leaked_tokens)::BIGINT AS leaked_tokens, sum(multi_turn_values)::BIGINT AS multi_turn_values,
    round(sum(multi_turn_values * alias_rate) / sum(multi_turn_values), 9) AS alias_rate, max(p95) AS worst_p95, sum(leaked_pairs) / sum(pairs) AS pair_rate, sum(leaked_tokens) / sum(tokens) AS token_rate
FROM sc LEFT JOIN ad USING (domain) LEFT JOIN lat USING (domain)""")
def leak_domains(spark, sf_dir):
    """All domains in a row: sums, weighted alias rate, worst 95th percentile."""
    latency = leak.percentiles(_turns(spark, sf_dir), ["domain"], "latency_ms", (0.95,))
    return leak.domains(_by_domain(spark, sf_dir), latency, "domain").withColumn("alias_rate", F.round("alias_rate", 9))


def _with_tokens(found):
    token = lambda tag: F.regexp_extract("prepared", rf"<<{tag}_\d+>>", 0)
    own = F.when(F.col("entity_type") == "PERSON", token("PERSON")).otherwise(token("ORG"))
    return found.withColumn("placeholder", F.when(own != "", own))


@query("cross_path_carry", f"""WITH {_BASE}, f AS (SELECT session, min(turn) AS turn FROM t GROUP BY session), long AS (SELECT t.* FROM t JOIN f USING (session, turn)), later AS (SELECT t.* FROM t ANTI JOIN f ON t.session = f.session AND t.turn = f.turn)
SELECT g.session, entity_type, value, '<<' || entity_type || '_1>>' AS placeholder, bool_or(contains(long.prepared, '<<' || entity_type || '_1>>')) AS in_long, bool_or(contains(later.prepared, '<<' || entity_type || '_1>>')) AS in_later,
    bool_or(contains(long.prepared, '<<' || entity_type || '_1>>')) AND bool_or(contains(later.prepared, '<<' || entity_type || '_1>>')) AS carried
FROM g JOIN long ON g.session = long.session AND contains(long.raw, value) JOIN later ON g.session = later.session WHERE entity_type <> 'GEO' GROUP BY ALL HAVING bool_or(contains(later.raw, value))""")
def cross_path_carry(spark, sf_dir):
    """Values of each session's first turn that come up again, and whether their token carries over."""
    said, truth = _turns(spark, sf_dir), _truth(spark, sf_dir)
    first = said.groupBy("session").agg(F.min("turn").alias("turn"))
    long_, later = said.join(first, ["session", "turn"], "left_semi"), said.join(first, ["session", "turn"], "left_anti")
    vault = truth.filter("entity_type <> 'GEO'").select("session", F.concat(F.lit("<<"), "entity_type", F.lit("_1>>")).alias("placeholder"), F.col("value").alias("canonical"))
    known = turns.protecting(truth, vault, "session", "value", leak.ident_tokens(F.col("value")), leak.ident_tokens(F.col("canonical")))
    return leak.carried(long_, later, truth, known)


@query("alias_consistency", f"""WITH {_BASE}, p AS (SELECT *, nullif(regexp_extract(prepared, '<<' || entity_type || '_\\d+>>'), '') AS placeholder FROM pairs)
SELECT session, value, count(DISTINCT turn) AS turns, count(DISTINCT placeholder) AS placeholders, bool_and(placeholder IS NOT NULL) AS protected, bool_and(placeholder IS NOT NULL) AND count(DISTINCT placeholder) = 1 AS consistent
FROM p GROUP BY session, value HAVING count(DISTINCT turn) >= 2""")
def alias_consistency(spark, sf_dir):
    return leak.consistency(_with_tokens(_pairs(spark, sf_dir)))


@query("latency_percentiles", """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, min(value) FILTER (i = round_even(0.5 * (n - 1), 0)) AS p50, min(value) FILTER (i = round_even(0.95 * (n - 1), 0)) AS p95, min(value) FILTER (i = round_even(0.99 * (n - 1), 0)) AS p99 FROM r GROUP BY event_type""")
def latency_percentiles(spark, sf_dir):
    return leak.percentiles(table(spark, sf_dir, "events"), ["event_type"], "value")


@query("nearest_seam", """WITH p AS (SELECT doc_id, length(text) AS n, string_split(text, ' the ') AS parts FROM documents WHERE length(text) > 6000),
e AS (SELECT doc_id, n, (sum(length(part)) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) + 5 * (i - 1) + 1)::INTEGER AS pos, i, m FROM (SELECT doc_id, n, unnest(parts) AS part, generate_subscripts(parts, 1) AS i, len(parts) AS m FROM p)),
k AS (SELECT *, unnest(range(1, greatest(1, ceil(n / 6000)::BIGINT - 1) + 1)) * 6000 AS seam FROM e WHERE i < m)
SELECT doc_id, pos, arg_min(seam, (abs(pos - seam), seam))::BIGINT AS seam, min(abs(pos - seam))::BIGINT AS distance FROM k GROUP BY doc_id, pos""")
def nearest_seam(spark, sf_dir):
    """The seam nearest to every occurrence of a word in long documents."""
    parts = table(spark, sf_dir, "documents").filter(F.length("text") > 6000).select("doc_id", F.length("text").alias("n"), F.split("text", " the ", -1).alias("parts"))
    upto = F.aggregate("parts", F.array(F.lit(0)), lambda done, x: F.array_append(done, F.element_at(done, -1) + F.length(x) + 5))
    ends = parts.select("doc_id", "n", F.explode(F.slice(upto, 2, F.size("parts") - 1)).alias("end"))
    return leak.nearest_seam(ends.withColumn("pos", F.col("end") - 4), "doc_id", "pos", 6000, "n").select("doc_id", "pos", "seam", "distance")
