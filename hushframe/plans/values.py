"""Queries: numbers, dates and accounts read from texts of four languages, and detectors held to their texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from hushframe.operators import detect, forms, guarded, turn_pipeline, vault
from hushframe.plans.detection import ENTITIES
from hushframe.plans.registry import query
from hushframe.sources.tables import table
from hushframe.streaming.chunks import emails

_MONTHS = {
    "en": "January February March April May June July August September October November December",
    "de": "Januar Februar März April Mai Juni Juli August September Oktober November Dezember",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
}


def _card(key):
    """A number of 16 digits in groups; every second one passes the check of card numbers, the others miss it by one."""
    first = F.concat(F.lit("4"), F.lpad(key.cast("string"), 14, "7"))
    each = F.transform(F.split(first, ""), lambda d, i: F.when(i % 2 == 1, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    right = (10 - F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10) % 10
    whole = F.concat(first, ((right + key % 2) % 10).cast("string"))
    return F.concat_ws(" ", *[F.substring(whole, i, 4) for i in (1, 5, 9, 13)])


def _letters(spark, sf_dir):
    """Orders as sentences in one of four languages, numbers and dates written as each does."""
    key = F.col("o_orderkey")
    english = F.format_number(F.col("o_totalprice"), 2)
    swapped = F.translate(english, ",.", ".,")
    spaced = F.translate(english, ",.", " ,")
    share = lambda sign: F.concat((F.floor(key / 10) % 100).cast("string"), F.lit(sign), (key % 10).cast("string"))
    mass = lambda sign: F.concat(F.col("o_custkey").cast("string"), F.lit(sign + "5 kg"))
    day, year = F.dayofmonth("o_orderdate").cast("string"), F.year("o_orderdate").cast("string")
    month = lambda lang: F.get(F.array(*map(F.lit, _MONTHS[lang].split())), F.month("o_orderdate") - 1)
    texts = (
        F.concat(F.lit("Paid $"), english, F.lit(" on "), month("en"), F.lit(" "), day, F.lit(", "), year, F.lit(" ("), share("."), F.lit("%), "), mass("."), F.lit(" sent.")),
        F.concat(F.lit("Bezahlt "), swapped, F.lit(" € am "), day, F.lit(". "), month("de"), F.lit(" "), year, F.lit(" ("), share(","), F.lit(" %), "), mass(","), F.lit(" versandt.")),
        F.concat(F.lit("Payé "), spaced, F.lit(" EUR le "), day, F.lit(" "), month("fr"), F.lit(" "), year, F.lit(" ("), share(","), F.lit(" pour cent), "), mass(","), F.lit(" partis.")),
        F.concat(F.lit("Pagado "), swapped, F.lit(" euros el "), day, F.lit(" de "), month("es"), F.lit(" de "), year, F.lit(" ("), share(","), F.lit(" por ciento), "), mass(","), F.lit(" enviados.")),
    )
    text = F.get(F.array(*texts), (key % 4).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat(text, F.lit(" Card "), _card(key), F.lit(".")).alias("text"))


@query("typed_values", """SELECT o_orderkey, 'financial' AS kind, round(o_totalprice, 2) AS value, CASE WHEN o_orderkey % 4 = 0 THEN 'USD' ELSE 'EUR' END AS unit, NULL AS day FROM orders
UNION ALL SELECT o_orderkey, 'percentage', round((o_orderkey // 10 % 100 + o_orderkey % 10 / 10) / 100, 6), NULL, NULL FROM orders
UNION ALL SELECT o_orderkey, 'measurement', o_custkey + 0.5, 'kg', NULL FROM orders
UNION ALL SELECT o_orderkey, 'temporal', NULL, NULL, strftime(o_orderdate, '%Y-%m-%d') FROM orders
UNION ALL SELECT o_orderkey, 'card', NULL, NULL, NULL FROM orders WHERE o_orderkey % 2 = 0""")
def typed_values(spark, sf_dir):
    """What sentences in four languages say, read back as typed values: amounts, shares, measures, days, and card numbers that pass their check."""
    found = forms.entities(_letters(spark, sf_dir))
    return found.select("o_orderkey", "kind", F.round("value", 6).alias("value"), "unit", F.col("day").cast("string").alias("day"))


@query("form_turns", "SELECT o_orderkey, true AS restored, false AS left_in_clear FROM orders")
def form_turns(spark, sf_dir):
    """The sentences sanitised with the detector of forms: nothing that it reads stays in clear, and all comes back."""
    letters = _letters(spark, sf_dir).select(F.lit("s").alias("session"), F.col("o_orderkey").alias("turn"), "text")
    # A session an order: numbers of one aren't looked for in all others.
    letters = letters.withColumn("session", F.concat(F.lit("o"), F.col("turn").cast("string")))
    schema = "session string, placeholder string, entity_type string, canonical string, aliases array<string>, value double, created_turn long, last_seen_turn long"
    found = turn_pipeline.detect_turns(letters, detector=forms.detector)
    done, after = turn_pipeline.sanitize(letters, spark.createDataFrame([], schema), found)
    back = vault.restore(done.select("session", "turn", F.col("text").alias("said"), F.col("sanitized").alias("text")), after, "session", ["turn"])
    bare = F.regexp_replace("text", "<<[A-Z_]+_[0-9]+>>", "#")
    left = [F.coalesce(F.size(forms.matches(bare, k)), F.lit(0)) for k in ("financial", "percentage", "temporal", "card", "measurement")]
    clear = F.greatest(*left) > 0
    return back.select(F.col("turn").alias("o_orderkey"), (F.col("restored") == F.col("said")).alias("restored"), clear.alias("left_in_clear"))


@query("checked_entities", f"""WITH {ENTITIES} SELECT doc_id, trim(entity_text) AS entity_text, entity_type FROM entities WHERE doc_id % 3 <> 0 AND trim(entity_text) <> ''""")
def checked_entities(spark, sf_dir):
    """A detector that invents: of its entities those stay that stand in their text and have a known type."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = detect.by_priority(detect.detect(docs), ["doc_id"]).select("doc_id", "entity_text", "entity_type")
    kind = F.col("doc_id") % 3
    shown = F.when(kind == 1, F.upper("entity_type")).otherwise(F.concat(F.lit(" "), "entity_type"))
    real = found.withColumn("entity_type", F.when(kind == 0, F.lit("hallucination")).otherwise(shown)).withColumn("entity_text", F.concat(F.lit(" "), "entity_text", F.lit(" ")))
    made_up = found.withColumn("entity_text", F.concat("entity_text", F.lit(" invented")))
    out = forms.checked(real.unionByName(made_up), docs, ["doc_id"])
    return out


def _unsure(text: str) -> list:
    """A detector that gives up at a dollar sign and answers nonsense at a percent sign; else it finds addresses, and makes one up."""
    if "$" in text:
        raise ValueError("no dollars")
    if "%" in text:
        return "all fine"
    return [(text[a:b], "email") for a, b in emails(text)] + [("nobody@example.org", "email")]


@query("guarded_outputs", """WITH p AS (SELECT doc_id, unnest(range(0, length(text), 6000)) AS i FROM documents WHERE length(text) > 0), c AS (SELECT doc_id, substr(text, i + 1, 6000) AS piece FROM p JOIN documents USING (doc_id)),
f AS (SELECT doc_id, count(*) AS chunks, count(*) FILTER (contains(piece, '$')) AS gave_up, count(*) FILTER (contains(piece, '%') AND NOT contains(piece, '$')) AS nonsense FROM c GROUP BY doc_id)
SELECT doc_id, chunks, gave_up, nonsense, gave_up + nonsense > 0 AS failed, CASE WHEN gave_up + nonsense > 0 THEN '[tool output omitted; privacy detection failed on one or more chunks for tool ''grep'']'
    ELSE regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '<<EMAIL>>', 'g') END AS shown FROM f JOIN documents USING (doc_id)""")
def guarded_outputs(spark, sf_dir):
    """Outputs of a tool through a detector that fails on some chunks: those texts give way to a note, and no made-up entity is believed."""
    turns = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("session"), F.col("doc_id").alias("turn"), "text")
    schema = "session string, placeholder string, entity_type string, canonical string, aliases array<string>, value double, created_turn long, last_seen_turn long"
    done, _, traces = guarded.sanitize(turns, spark.createDataFrame([], schema), _unsure, F.lit("grep"))
    told = traces.groupBy(F.col("turn").alias("doc_id")).agg(F.count("*").alias("chunks"), F.count_if(F.col("reason") == "ValueError").alias("gave_up"), F.count_if(F.col("reason") == "TypeError").alias("nonsense"))
    shown = F.regexp_replace("sanitized", "<<EMAIL_[0-9]+>>", "<<EMAIL>>")
    return told.join(done.select(F.col("turn").alias("doc_id"), "failed", shown.alias("shown")), "doc_id")
