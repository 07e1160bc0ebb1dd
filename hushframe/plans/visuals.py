"""Queries: recognised words and what has to be covered, over texts taken as pages of words."""

from __future__ import annotations

from pyspark.sql import functions as F

from hushframe.operators import crossmodal, leak, visual
from hushframe.plans.registry import query
from hushframe.sources.tables import keep, table

#: Words of messages as an engine would report them: ten a line, some without extent or letter; and amounts, numbers and addresses among them.
_MORE = "' | $1,200.50 USD #INV-2024-' || (1000000 + turn) || ' (01/02/2024) x@y.org 12345678901ABC-99_X $5 ' || role || '.'"
_WORDS_SQL = f"""t AS (SELECT conv_id * 100 + turn AS image, string_split(text || {_MORE}, ' ') AS l FROM conversations), e AS (SELECT image, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS i FROM t),
k AS (SELECT image, i, trim(text) AS text, regexp_replace(lower(replace(trim(text), '|', ' ')), '[^a-z0-9]+', '', 'g') AS token, (i % 10) * 60 AS l, (i // 10) * 20 AS tp, CASE WHEN i % 17 = 16 THEN 0 ELSE 50 END AS w FROM e),
words AS (SELECT image, (row_number() OVER (PARTITION BY image ORDER BY i) - 1)::INTEGER AS place, text, token, l::INTEGER AS "left", tp::INTEGER AS top, (l + w)::INTEGER AS "right", (tp + 15)::INTEGER AS bottom FROM k WHERE text <> '' AND token <> '' AND w > 0)"""


def _words(spark, sf_dir):
    text = F.concat("text", F.expr(_MORE))
    split = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("image"), F.posexplode(F.split(text, " ")).alias("i", "text"))
    place = (F.col("i") % 10).alias("word"), F.floor(F.col("i") / 10).cast("int").alias("line")
    raw = split.select("image", F.lit(0).alias("block"), F.lit(0).alias("par"), *place, "text", ((F.col("i") % 10) * 60).alias("left"), (F.floor(F.col("i") / 10) * 20).cast("int").alias("top"), F.when(F.col("i") % 17 == 16, F.lit(0)).otherwise(F.lit(50)).alias("width"), F.lit(15).alias("height"))
    return visual.reading_order(raw, "image")


@query("ocr_words", f"WITH {_WORDS_SQL} SELECT * FROM words")
def ocr_words(spark, sf_dir):
    return _words(spark, sf_dir)


@query("ocr_forms", f"""WITH {_WORDS_SQL}, n AS (SELECT *, lead(token) OVER w AS nt, lead(text) OVER w AS nx, lead("left") OVER w AS nl, lead(top) OVER w AS ntp, lead("right") OVER w AS nr, lead(bottom) OVER w AS nb FROM words WINDOW w AS (PARTITION BY image ORDER BY place)),
f AS (SELECT *, 'email' AS label, text AS value, false AS usd FROM n WHERE regexp_full_match(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}') UNION ALL SELECT *, 'invoice_number', text, false FROM n WHERE regexp_full_match(text, '#?[A-Z0-9]+-[A-Z0-9-]+') AND length(token) > 10
    UNION ALL SELECT *, 'transaction_id', text, false FROM n WHERE regexp_full_match(text, '\\d{{10,}}[A-Z0-9|_-]{{8,}}') UNION ALL SELECT *, 'date', regexp_replace(text, '^\\(+|[()]+$', '', 'g'), false FROM n WHERE regexp_full_match(text, '\\(?\\d{{2}}/\\d{{2}}/\\d{{4}}\\)?')
    UNION ALL SELECT *, 'amount', CASE WHEN nt = 'usd' THEN text || ' ' || nx ELSE text END, coalesce(nt = 'usd', false) FROM n WHERE regexp_full_match(text, '\\$[0-9][0-9,.]*'))
SELECT image, place, label, value, CASE WHEN usd THEN least("left", nl) ELSE "left" END AS "left", CASE WHEN usd THEN least(top, ntp) ELSE top END AS top, CASE WHEN usd THEN greatest("right", nr) ELSE "right" END AS "right", CASE WHEN usd THEN greatest(bottom, nb) ELSE bottom END AS bottom FROM f""")
def ocr_forms(spark, sf_dir):
    """Addresses, numbers, dates and amounts by their form."""
    return visual.word_forms(_words(spark, sf_dir), "image")


#: Needles of each page: three words as they stand, four with one misread, one long word with more at its end.
_NEEDLES_SQL = """nd AS (SELECT image, list(token ORDER BY place)[2:4] AS tokens, 'three' AS needle FROM words GROUP BY image UNION ALL SELECT image, list_concat(list(token ORDER BY place)[5:7], ['misread']), 'four' FROM words GROUP BY image
    UNION ALL SELECT image, [max(token) FILTER (length(token) >= 8) || 'extra'], 'one' FROM words GROUP BY image HAVING max(token) FILTER (length(token) >= 8) IS NOT NULL)"""


def _needles(words):
    tokens = F.transform(F.array_sort(F.collect_list(F.struct("place", "token"))), lambda x: x["token"])
    per = words.groupBy("image").agg(tokens.alias("t"), F.max(F.when(F.length("token") >= 8, F.col("token"))).alias("long"))
    few = F.array(F.struct(F.lit("three").alias("needle"), F.slice("t", 2, 3).alias("tokens")), F.struct(F.lit("four").alias("needle"), F.concat(F.slice("t", 5, 3), F.array(F.lit("misread"))).alias("tokens")))
    one = F.when(F.col("long").isNotNull(), F.array(F.struct(F.lit("one").alias("needle"), F.array(F.concat("long", F.lit("extra"))).alias("tokens"))))
    return per.select("image", F.inline(F.concat(few, F.coalesce(one, F.array().cast("array<struct<needle:string,tokens:array<string>>>")))))


_MATCHED_SQL = """single AS (SELECT n.image, needle, place AS first, "left", top, "right", bottom FROM nd n JOIN words w USING (image) WHERE len(tokens) = 1 AND (token = tokens[1] OR (length(token) >= 8 AND length(tokens[1]) >= 8 AND (contains(token, tokens[1]) OR contains(tokens[1], token))))),
win AS (SELECT n.image, needle, tokens, a.place AS first, list(b.token ORDER BY b.place) AS w, min(b."left") AS "left", min(b.top) AS top, max(b."right") AS "right", max(b.bottom) AS bottom FROM nd n JOIN words a ON a.image = n.image JOIN words b ON b.image = n.image AND b.place BETWEEN a.place AND a.place + len(tokens) - 1
    WHERE len(tokens) > 1 GROUP BY ALL HAVING count(*) = len(tokens)),
judged AS (SELECT *, w = tokens AS strict, bool_or(w = tokens) OVER (PARTITION BY image, needle) AS anyw, len(list_filter(w, lambda x: list_contains(tokens, x))) >= greatest(2, (len(tokens) * 7 + 9) // 10) AS near FROM win)"""


@query("ocr_matches", f"""WITH {_WORDS_SQL}, {_NEEDLES_SQL}, {_MATCHED_SQL} SELECT * FROM single UNION ALL SELECT image, needle, first, "left", top, "right", bottom FROM judged WHERE CASE WHEN anyw THEN strict ELSE len(tokens) >= 3 AND near END""")
def ocr_matches(spark, sf_dir):
    """Where needles stand among the words of their page: strictly, else with gaps."""
    words = _words(spark, sf_dir)
    return visual.match_needles(words, _needles(words), "image")


@query("region_maps", f"""WITH {_WORDS_SQL}, r AS (SELECT image, CASE WHEN place % 3 = 0 THEN '<<PERSON_' || (place % 2) || '>>' ELSE '<<NAME>>' END AS token, CASE WHEN place % 3 = 0 THEN 'person' ELSE 'name' END AS label, place, "left", top, "right", bottom FROM words WHERE place < 9),
g AS (SELECT image, token, any_value(label) AS label, min(place) AS first, count(*) AS n, min("left") AS l, min(top) AS t, max("right") AS rt, max(bottom) AS b FROM r GROUP BY image, token)
SELECT image, string_agg('- ' || token || ' (' || label || ') at (' || l || ',' || t || ')–(' || rt || ',' || b || ')' || CASE WHEN n > 1 THEN ' [' || n || ' regions merged]' ELSE '' END, chr(10) ORDER BY first) AS map FROM g GROUP BY image""")
def region_maps(spark, sf_dir):
    """Regions announced once for each token, with the union of their boxes."""
    third = F.col("place") % 3 == 0
    words = _words(spark, sf_dir).filter("place < 9")
    found = words.select("image", "place", F.when(third, F.lit("person")).otherwise(F.lit("name")).alias("label"), F.when(third, F.concat(F.lit("<<PERSON_"), (F.col("place") % 2).cast("string"), F.lit(">>"))).alias("placeholder"), *visual.BOX)
    return visual.region_lines(visual.regions(found, "image"), "image")


@query("visual_leaks", """WITH s AS (SELECT conv_id * 100 + turn AS image, role AS label, text FROM conversations), o AS (SELECT conv_id * 100 + turn AS image, CASE WHEN turn % 3 = 0 THEN text WHEN turn % 3 = 1 THEN left(text, length(text) // 2) ELSE 'covered' END AS ocr FROM conversations),
k AS (SELECT label, text, ocr, list_filter(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'), lambda p: regexp_full_match(p, '\\p{Nd}{3,}') OR regexp_full_match(p, '\\p{L}{4,}')) AS l FROM s JOIN o USING (image))
SELECT label, count(*) AS spans, count(*) FILTER (text <> '' AND contains(ocr, text)) AS spans_leaked, sum(len(l))::BIGINT AS tokens, sum(len(list_filter(l, lambda x: contains(ocr, x))))::BIGINT AS tokens_leaked FROM k GROUP BY label""")
def visual_leaks(spark, sf_dir):
    """What a second recognition still reads of covered spans, by label."""
    rows = table(spark, sf_dir, "conversations").withColumn("image", F.col("conv_id") * 100 + F.col("turn"))
    kind = F.col("turn") % 3
    read = rows.select("image", F.when(kind == 0, F.col("text")).when(kind == 1, F.expr("left(text, length(text) div 2)")).otherwise(F.lit("covered")).alias("ocr"))
    return visual.leak_by_label(rows.select("image", F.col("role").alias("label"), "text"), read, "image", leak.ident_tokens(F.col("text")))


@query("needle_candidates", """SELECT c_custkey, array_to_string(list_sort(list_distinct(list_filter(list_transform(list_concat([t], string_split_regex(t, '[,;\\n]'), regexp_extract_all(t, '\\$?[0-9][\\w\\s./,-]*(USD|usd|%)?')), lambda x: trim(x)), lambda x: length(x) >= 4))), '|') AS needles
FROM (SELECT c_custkey, c_name || ', paid $' || c_custkey || '00.50 USD; ' || c_mktsegment AS t FROM customer)""")
def needle_candidates(spark, sf_dir):
    text = F.concat("c_name", F.lit(", paid  $"), F.col("c_custkey").cast("string"), F.lit("00.50|USD; "), "c_mktsegment")
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(F.array_sort(visual.needle_candidates(text, F.lit("amount"))), "|").alias("needles"))


@query("cross_modal", f"""WITH {_WORDS_SQL}, f AS (SELECT image, place, contains(text, '@') AS is_mail FROM words WHERE regexp_full_match(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}') OR (regexp_full_match(text, '#?[A-Z0-9]+-[A-Z0-9-]+') AND length(token) > 10)
    OR regexp_full_match(text, '\\d{{10,}}[A-Z0-9|_-]{{8,}}') OR regexp_full_match(text, '\\(?\\d{{2}}/\\d{{2}}/\\d{{4}}\\)?') OR regexp_full_match(text, '\\$[0-9][0-9,.]*'))
SELECT image, CASE WHEN NOT bool_or(is_mail) THEN NULL WHEN (image // 100) % 2 = 0 THEN '<<EMAIL_7>>' ELSE '<<EMAIL_1>>' END AS mail, count(*) AS forms, count(*) AS covered, false AS in_clear FROM f GROUP BY image""")
def cross_modal(spark, sf_dir):
    """Messages as images of their words, some addresses known to their sessions: all that has a form is covered and gone from the text, under one token on both sides."""
    words = keep(_words(spark, sf_dir))
    session = F.concat(F.lit("c"), F.col("conv_id").cast("string"))
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("image"), session.alias("session"), "turn", F.concat("text", F.expr(_MORE)).alias("text"))
    none = F.lit(None)
    known = rows.filter("image div 100 % 2 = 0").select("session").distinct().select(
        "session", F.lit("<<EMAIL_7>>").alias("placeholder"), F.lit("email").alias("entity_type"), F.lit("x@y.org").alias("canonical"), F.array(F.lit("x@y.org")).alias("aliases"),
        none.cast("double").alias("value"), none.cast("long").alias("created_turn"), none.cast("long").alias("last_seen_turn"),
    )
    texts, boxes, _ = crossmodal.cover(rows, words, known)
    seen = visual.word_forms(words, "image").groupBy("image", "place").agg(F.collect_set("value").alias("values"))
    at = boxes.groupBy("image", "place").agg(F.lit(True).alias("hit"), F.max(F.when(F.col("placeholder").startswith("<<EMAIL"), F.col("placeholder"))).alias("mail"))
    per = seen.join(at, ["image", "place"], "left").groupBy("image").agg(F.max("mail").alias("mail"), F.count("*").alias("forms"), F.count_if("hit").alias("covered"), F.flatten(F.collect_list("values")).alias("values"))
    both = per.join(texts.select("image", "sanitized"), "image")
    clear = F.exists("values", lambda v: F.contains(F.col("sanitized"), v))
    # The token that covers the address is the one that stands in the text.
    mail = F.when(F.contains("sanitized", F.col("mail")), F.col("mail"))
    return both.select("image", mail.alias("mail"), "forms", "covered", clear.alias("in_clear"))
