"""Reports: entity and placeholder summaries, session snapshots, document records, event metrics and timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushframe.functions import grammar, taxonomy

#: Characters a chunk holds at most.
MAX_CHARS = 6000


def summarize_entities(entities: DataFrame) -> DataFrame:
    """Entities by type and severity."""
    return entities.groupBy(F.upper("entity_type").alias("entity_type"), taxonomy.severity_of(F.col("entity_type")).alias("severity")).agg(F.count("*").alias("n"))


def summarize_placeholders(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Different tokens of each text by tag, in order of first appearance."""
    found = texts.select(*keys, F.posexplode(grammar.tokens(F.col(text))).alias("place", "token")).withColumn("tag", grammar.placeholder_tag(F.col("token")))
    ordered = F.array_sort(F.collect_list(F.struct("place", "token")))
    return found.groupBy(*keys, "tag").agg(F.count("*").alias("n"), F.transform(ordered, lambda x: x["token"]).alias("tokens"))


# How a turn's report reads.
TITLE = "### \U0001f512 Privacy Report  "
SENT, KEPT, NOTHING_SENT = "sanitized before remote LLM", "placeholder-preserving input", "├─ Input protection: _no placeholders sent to the remote LLM_  "
RESTORED, NO_NEED, NOT_RESTORED = "└─ Status: _tokens restored for display_", "└─ Status: _no restoration needed_", "└─ Status: _nothing restored in final output_"


def placeholders_line(c: Column) -> Column:
    """Different tokens of a text by tag: `TAG` xN (`token`, ...), tags in order, tokens as they first appear; empty without any."""
    found = grammar.tokens(F.coalesce(c, F.lit("")))
    tag = lambda t: F.regexp_extract(t, grammar.PLACEHOLDER_TAG, 1)
    quoted = lambda x: F.concat(F.lit("`"), x, F.lit("`"))

    def one(name: Column) -> Column:
        own = F.filter(found, lambda t: tag(t) == name)
        return F.concat(quoted(name), F.lit(" x"), F.size(own).cast("string"), F.lit(" ("), F.array_join(F.transform(own, quoted), ", "), F.lit(")"))

    return F.array_join(F.transform(F.array_sort(F.array_distinct(F.transform(found, tag))), one), ", ")


def entities_line(entities: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, name): entities of each turn by type and severity: `TYPE` (severity) xN, in order."""
    counted = entities.groupBy(*keys, F.upper("entity_type").alias("_t"), taxonomy.severity_of(F.lower("entity_type")).alias("_s")).agg(F.count("*").alias("_n"))
    item = lambda x: F.format_string("`%s` (%s) x%d", x["_t"], x["_s"], x["_n"])
    return counted.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_t", "_s", "_n"))), item), ", ").alias(name))


def privacy_reports(turns: DataFrame, detected: DataFrame, tool_detected: DataFrame) -> DataFrame:
    """(session, turn, report): what a turn's privacy came to, as text for its user.

    turns: (session, turn, intent, sanitized_input, was_sanitized, sanitized_output); detected, tool_detected: entities (session, turn,
    entity_type) newly found in the input, and in the outputs of tools. Null keys are values like others, a null text holds no token.
    """
    rows = turns
    for found, name in ((detected, "_detected"), (tool_detected, "_tools")):
        lines = entities_line(found, ["session", "turn"], name).withColumnsRenamed({"session": "_s", "turn": "_t"})
        rows = rows.join(lines, rows["session"].eqNullSafe(F.col("_s")) & rows["turn"].eqNullSafe(F.col("_t")), "left").drop("_s", "_t")
    sent, back = placeholders_line(F.col("sanitized_input")), placeholders_line(F.col("sanitized_output"))
    said = lambda head, c: F.concat(F.lit(head), c, F.lit("  "))
    status = F.when(F.col("was_sanitized"), SENT).otherwise(KEPT)
    lines = F.concat(
        F.array(F.lit(TITLE), F.concat(F.lit("├─ Intent: `"), "intent", F.lit("`  "))),
        F.when(sent != "", F.array(F.concat(F.lit("├─ Input protection: _"), status, F.lit("_  ")), said("│  > ", sent))).otherwise(F.array(F.lit(NOTHING_SENT))),
        F.array(said("├─ Newly detected this turn: ", F.coalesce("_detected", F.lit("_none_")))),
        F.array(said("├─ Tool-output detections: ", F.coalesce("_tools", F.lit("_none_")))),
        F.when(back != "", F.array(said("├─ Restored in final output: ", back), F.lit(RESTORED))).otherwise(F.array(F.when(sent == "", NO_NEED).otherwise(NOT_RESTORED))),
    )
    return rows.select("session", "turn", F.array_join(lines, "\n").alias("report"))


def session_snapshot(vault: DataFrame, session: str) -> DataFrame:
    """What a session's vault holds, by tag."""
    severe = F.count_if(taxonomy.severity_of(F.col("entity_type")) == "high")
    tag = taxonomy.tag_of(F.col("entity_type"))
    return vault.groupBy(session, tag.alias("tag")).agg(F.count("*").alias("placeholders"), F.min("created_turn").alias("first_turn"), F.max("last_seen_turn").alias("last_turn"), severe.alias("high_severity"))


def document_records(docs: DataFrame, entities: DataFrame) -> DataFrame:
    """A record per document: hash, size, chunks and the types found in it."""
    types = entities.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("entity_type")), ",").alias("entity_types"))
    record = docs.select("doc_id", F.sha2("text", 256).alias("original_sha256"), F.length("text").alias("char_count"), F.ceil(F.length("text") / F.lit(MAX_CHARS)).alias("chunks_total"))
    joined = record.join(types, "doc_id", "left")
    return joined.select("doc_id", "original_sha256", "char_count", "chunks_total", F.col("entity_types").isNotNull().alias("was_sanitized"), F.coalesce("entity_types", F.lit("")).alias("entity_types"))


def sequence(events: DataFrame, trace: str, order: list[str]) -> DataFrame:
    """Number the events of each trace from 1, in order."""
    return events.withColumn("sequence", F.row_number().over(Window.partitionBy(trace).orderBy(*order)))


def durations(events: DataFrame, key: str, start: str, end: str, ts: str, order: str, kind: str) -> DataFrame:
    """Each end event with the last start before it of the same key, and the ms between them (0 at least)."""
    before = Window.partitionBy(key).orderBy(ts, order).rowsBetween(Window.unboundedPreceding, -1)
    started = F.last(F.when(F.col(kind) == start, F.struct(F.col(order).alias("id"), F.col(ts).alias("ts"))), ignorenulls=True).over(before)
    found = events.withColumn("_start", started).filter((F.col(kind) == end) & F.col("_start").isNotNull())
    ms = F.greatest(F.lit(0), F.unix_millis(ts) - F.unix_millis("_start.ts"))
    return found.select(key, F.col(order).alias("end_id"), F.col("_start.id").alias("start_id"), ms.alias("duration_ms"))


def timeline(events: DataFrame, keys: list[str], event_type: str, duration: str, order: str) -> DataFrame:
    """Last duration of each stage of a turn; the stage is the last but one part of the event's dotted type."""
    stage = F.try_element_at(F.split(event_type, r"\."), F.lit(-2))
    staged = events.withColumn("stage", F.coalesce(stage, F.col(event_type)))
    return staged.groupBy(*keys, "stage").agg(F.max_by(duration, order).alias("duration"), F.count("*").alias("n"))


def replay(events: DataFrame, scope: list[str]) -> DataFrame:
    """Events of each scope (a session, a trace, or a session's turn) in the order of replay: adds place, from 1.

    events: (..., sequence, timestamp); by sequence, then time, unnumbered ones first; events alike in both keep no order of their own.
    """
    order = Window.partitionBy(*scope).orderBy("sequence", "timestamp")
    return events.withColumn("place", F.row_number().over(order))


def turn_timelines(events: DataFrame, keys: list[str]) -> DataFrame:
    """A row per turn: (keys, trace_id, events, total_duration_ms, stage_durations_ms map<string, long>).

    events: (keys, trace_id, event_type, sequence, timestamp, duration_ms). In the order of replay: the trace of the first event, the time from
    the first to the last (0 at least), and of each stage, the last but one part of a dotted type, the last duration told.
    """
    rank = F.struct("sequence", "timestamp")
    stage = F.coalesce(F.try_element_at(F.split("event_type", r"\."), F.lit(-2)), F.col("event_type"))
    span = F.unix_millis(F.max_by("timestamp", rank)) - F.unix_millis(F.min_by("timestamp", rank))
    whole = events.groupBy(*keys).agg(F.min_by("trace_id", rank).alias("trace_id"), F.count("*").alias("events"), F.greatest(F.lit(0), span).alias("total_duration_ms"))
    told = events.filter("duration_ms is not null").groupBy(*keys, stage.alias("_stage")).agg(F.max_by("duration_ms", rank).alias("_ms"))
    stages = told.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_stage", "_ms")))).alias("stage_durations_ms"))
    on = F.lit(True)
    for k in keys:
        on = on & whole[k].eqNullSafe(F.col(f"_{k}"))
    joined = whole.join(stages, on, "left").drop(*[f"_{k}" for k in keys])
    return joined.withColumn("stage_durations_ms", F.coalesce("stage_durations_ms", F.create_map().cast("map<string,bigint>")))
