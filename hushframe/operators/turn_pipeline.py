"""A turn's way out and back: tokens in place of known and newly found surfaces, failures closed, arguments of any depth.

turns: (session, turn, text); more columns pass through. entities: the vault, see `vault_table`. Everything here is set based:
a session's turns are rewritten side by side, with tokens numbered in order of first appearance.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.functions import grammar, taxonomy
from hushframe.operators import annotations, calc, chunk, compaction, detect, vault, vault_table
from hushframe.sources.tables import keep, release


#: A turn may have several texts, told apart by this column where there is one.
PART = "_part"


def detect_turns(turns: DataFrame, detector=detect.detect, chunk_chars: int | None = None) -> DataFrame:
    """Entities of turns(session, turn, text), each surface of a text once; texts of tokens alone are left out.

    detector: rows with a text to rows with detect_rank, source_rank, entity_text and entity_type. chunk_chars: for detectors
    that read only so much at once, texts are cut to that, and entities of all chunks put together.
    """
    keys = ["session", "turn", *(c for c in turns.columns if c == PART)]
    rows = turns.select(*keys, "text").filter(~grammar.only_placeholders(F.col("text")))
    if chunk_chars is None:
        return detect.by_priority(detector(rows), keys)
    cut = chunk.hard_cut(rows, max_chars=chunk_chars).select(*keys, F.col("chunk").alias("text"), "idx")
    found = detector(cut).withColumn("detect_rank", F.col("idx").cast("long") * 1_000_000_000 + F.col("detect_rank")).drop("idx")
    return detect.by_priority(found, keys)


def sanitize(turns: DataFrame, entities: DataFrame, found: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Turns with sanitized and modified, and the entities after them.

    Surfaces that the session knows give way wherever they stand, in whatever order turns arrive: a surface that a later
    turn brought is no less private in an earlier one. Found surfaces (by default of `detect_turns`) have the
    token of an equal surface or alias key, else a new one, with their number if they are one. Longer surfaces come first, tokens
    stay whole. A null session is one session, a null turn one turn; a null text stays null. Texts of one turn may be told apart by a
    column `_part`.
    """
    parted = PART in turns.columns
    rows = turns if parted else turns.withColumn(PART, F.lit(0))
    found = detect_turns(rows) if found is None else found if PART in found.columns else found.withColumn(PART, F.lit(0))
    # A surface of a session is one row from here on: nothing later needs its occurrences, and tables and shuffles of them would fill the disk.
    if entities.isEmpty():
        # Nothing to look up, so one shuffle by session serves surfaces and numbers.
        news = vault_table.numbered(vault_table.met(found.repartition("session")), None)
        after = keep(entities.limit(0).unionByName(news.select(*entities.columns)))
    else:
        told = keep(vault_table.lookup(vault_table.met(found), entities, strict="strict"))
        news = vault_table.numbered(told.filter("placeholder is null").drop("placeholder"), entities)
        seen = told.filter("placeholder is not null").select("session", "placeholder", "surface", F.explode(F.array("first_turn", "last_seen_turn")).alias("turn"))
        after = keep(vault_table.register(entities, seen).unionByName(news.select(*entities.columns)))
        release(told)
    done = _rewritten(rows, after)
    return (done if parted else done.drop(PART)), after


def _rewrite(texts: pd.Series, own: pd.Series) -> pd.Series:
    return pd.Series([None if pairs is None or text is None else vault.replace_all(text, [(p["surface"], p["placeholder"]) for p in pairs]) for text, pairs in zip(texts, own, strict=True)])


def _rewritten(rows: DataFrame, entities: DataFrame) -> DataFrame:
    # A surface is the session's, so it is looked for in all of the session's texts, whatever was detected in them. A text meets
    # its session's surfaces once, as one array; only those of very large sessions meet them one by one.
    # No session has more surfaces than these; counting equal ones once would shuffle all of them.
    big = vault.large(entities.select("session", (F.coalesce(F.size("aliases"), F.lit(0)) + 1).alias("_n")))
    small = entities if big is None else entities.join(big, entities["session"].eqNullSafe(F.col("_s")), "left_anti")
    # One shuffle, by the key of the join, serves the surfaces, the arrays and the join.
    keyed = small.withColumn("session", F.struct(F.col("session").alias("session"))).repartition("session")
    few = vault_table.surfaces(keyed).groupBy(F.col("session").alias("_k")).agg(F.collect_set(F.struct("surface", "placeholder")).alias("_own"))
    rest = rows if big is None else rows.join(big, rows["session"].eqNullSafe(F.col("_s")), "left_anti")
    held = F.filter("_own", lambda p: F.contains(F.col("text"), p["surface"]))
    out = _put_in(rest.join(few, F.struct(rest["session"].alias("session")) == F.col("_k"), "left").withColumn("_pairs", held).drop("_k", "_own"))
    if big is None:
        return out
    return out.unionByName(_put_in(_with_pairs(rows.join(big, rows["session"].eqNullSafe(F.col("_s")), "left_semi"), vault_table.surfaces(entities))))


def _with_pairs(rows: DataFrame, known: DataFrame) -> DataFrame:
    theirs = known.select(F.col("session").alias("_of"), "surface", "placeholder")
    within = rows["session"].eqNullSafe(F.col("_of")) & F.contains("text", F.col("surface"))
    pairs = rows.select("session", "turn", PART, "text").join(theirs, within)
    keys = {"session": "_s", "turn": "_t", PART: "_q"}
    per = pairs.groupBy(*[F.col(k).alias(v) for k, v in keys.items()]).agg(F.collect_set(F.struct("surface", "placeholder")).alias("_pairs"))
    on = [rows[k].eqNullSafe(F.col(v)) for k, v in keys.items()]
    return rows.join(per, on[0] & on[1] & on[2], "left").drop(*keys.values())


def _put_in(rows: DataFrame) -> DataFrame:
    any_ = F.size("_pairs") > 0
    rows = rows.withColumn("_plain", F.when(any_ & (F.size("_pairs") <= vault.MOST), vault.replaced(F.col("text"), F.col("_pairs"))))
    # To Python go only texts that hold what could be a token, or very many surfaces.
    left = any_ & F.col("_plain").isNull()
    clean = F.coalesce("_plain", F.pandas_udf(_rewrite, "string")(F.when(left, F.col("text")), F.when(left, F.col("_pairs"))), F.col("text"))
    modified = F.coalesce(F.col("sanitized") != F.col("text"), F.lit(False))
    return rows.withColumn("sanitized", clean).withColumn("modified", modified).drop("_pairs", "_plain")


def on_failure(rows: DataFrame, failed: Column, tool: Column | None = None, fail_open: bool = False) -> DataFrame:
    """Rows after detection failed for some: with fail_open their text goes out as it came, else a note takes its place.

    tool: name of the tool whose output it is; without one the note stands for a message.
    """
    what = F.concat(F.lit("[tool output omitted; privacy detection failed on one or more chunks for tool '"), tool, F.lit("']")) if tool is not None else F.lit("[message withheld; privacy detection failed]")
    shown = F.when(failed, F.col("text") if fail_open else what).otherwise(F.col("sanitized"))
    return rows.withColumn("sanitized", shown).withColumn("modified", F.when(failed, F.lit(not fail_open)).otherwise(F.col("modified")))


def failed_texts(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, chunks, failed_chunks, failed) of texts from their chunks' flags: one failed chunk fails its text. parts: (keys, failed)."""
    return parts.groupBy(*keys).agg(F.count("*").alias("chunks"), F.count_if("failed").alias("failed_chunks"), F.bool_or("failed").alias("failed"))


def _leaves(value, out: list[str]) -> list[str]:
    if isinstance(value, str):
        out.append(value)
    elif isinstance(value, dict | list):
        for item in value.values() if isinstance(value, dict) else value:
            _leaves(item, out)
    return out


def _refilled(value, leaves):
    if isinstance(value, str):
        return next(leaves)
    if isinstance(value, dict):
        return {k: _refilled(v, leaves) for k, v in value.items()}
    return [_refilled(v, leaves) for v in value] if isinstance(value, list) else value


def leaves(c: Column) -> Column:
    """Strings inside a JSON text of any depth, in order; none of a text that isn't JSON."""

    def one(text):
        try:
            return _leaves(json.loads(text), []) if text else []
        except ValueError:
            return []

    return F.pandas_udf(lambda s: s.map(one), "array<string>")(c)


def refilled(c: Column, strings: Column) -> Column:
    """A JSON text with its strings replaced in order."""

    def one(texts: pd.Series, new: pd.Series) -> pd.Series:
        return pd.Series([t if n is None or not len(n) else json.dumps(_refilled(json.loads(t), iter(n)), ensure_ascii=False) for t, n in zip(texts, new, strict=True)])

    return F.pandas_udf(one, "string")(c, strings)


def sanitize_nested(calls: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """calls(session, turn, arguments) with their JSON arguments' strings sanitised one by one, and the entities after them.

    The strings are texts of the call's own turn, told apart by their number, and go through `sanitize`. Numbers, truth
    values and keys stay as they are, as does a text that isn't JSON. Calls of a session have turns of their own.
    """
    rows = calls.select("session", "turn", F.posexplode(leaves(F.col("arguments"))).alias(PART, "text"))
    done, after = sanitize(rows, entities)
    strings = F.array_sort(F.collect_list(F.struct(PART, "sanitized"))).alias("_new")
    back = done.groupBy(F.col("session").alias("_s"), F.col("turn").alias("_t")).agg(strings, F.bool_or("modified").alias("modified"))
    joined = calls.join(back, calls["session"].eqNullSafe(F.col("_s")) & calls["turn"].eqNullSafe(F.col("_t")), "left")
    filled = refilled(F.col("arguments"), F.transform("_new", lambda x: x["sanitized"]))
    done = joined.withColumn("sanitized", filled).withColumn("modified", F.coalesce("modified", F.lit(False)))
    return done.drop("_s", "_t", "_new"), after


def restore_nested(calls: DataFrame, entities: DataFrame) -> DataFrame:
    """calls(session, turn, arguments) with restored: known tokens in their strings give way to canonical surfaces."""
    rows = calls.select("session", "turn", F.posexplode(leaves(F.col("arguments"))).alias("_i", "text"))
    back = vault.restore(rows, entities, "session", ["turn", "_i"])
    strings = F.array_sort(F.collect_list(F.struct("_i", "restored"))).alias("_new")
    back = back.groupBy(F.col("session").alias("_s"), F.col("turn").alias("_t")).agg(strings)
    joined = calls.join(back, calls["session"].eqNullSafe(F.col("_s")) & calls["turn"].eqNullSafe(F.col("_t")), "left")
    return joined.withColumn("restored", refilled(F.col("arguments"), F.transform("_new", lambda x: x["restored"]))).drop("_s", "_t", "_new")


def prepare(turns: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages of users ready for a remote model: (session, turn, remote_text, was_sanitized, tokens), and the entities after them."""
    done, after = sanitize(turns, entities)
    return done.select("session", "turn", F.col("sanitized").alias("remote_text"), F.col("modified").alias("was_sanitized"), grammar.tokens(F.col("sanitized")).alias("tokens")), after


def finalize(answers: DataFrame, entities: DataFrame) -> DataFrame:
    """Answers of a remote model for their user: (session, turn, display_text, history_text, computations).

    Calculations are carried out, first, then tokens give way to surfaces; the history keeps tokens.
    """
    # Read once for those that calculate, once for the rest.
    done = calc.apply(keep(answers.select("session", "turn", "text")), vault_table.variables(entities))
    shown = vault.restore(done.withColumnRenamed("display", "text"), entities, "session", ["turn"])
    return shown.select("session", "turn", F.col("restored").alias("display_text"), F.col("history").alias("history_text"), "computations")


def finalize_annotated(answers: DataFrame, entities: DataFrame, repeats: bool = False) -> DataFrame:
    """`finalize` with annotations: (session, turn, display_text, history_text, computations, annotations).

    The text shown is the one kept with each token as what it shows, CALC tokens as their results, so that spans fit it
    exactly; annotations (see `annotations.annotations`) are in order of their place.
    """
    done = keep(calc.apply(answers, vault_table.variables(entities)))
    texts = done.select("session", "turn", F.col("history").alias("text"), "computations")
    results = annotations.known_results(done).select("session", F.col("token").alias("placeholder"), F.col("shown").alias("canonical"))
    known = entities.select("session", "placeholder", "canonical").unionByName(results)
    shown = vault.restore(texts, known, "session", ["turn"])
    marked = annotations.of_text(shown, annotations.annotations(texts, entities, done, repeats))
    return marked.select("session", "turn", F.col("restored").alias("display_text"), F.col("text").alias("history_text"), "computations", "annotations")


def at_rest(goals: DataFrame, entities: DataFrame, failed: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Texts that are stored for later (session, turn, text): sanitised, and withheld where detection failed; and the entities after them."""
    done, after = sanitize(goals, entities)
    return on_failure(done, F.lit(False) if failed is None else failed), after


def documents(media: DataFrame, entities: DataFrame, chunk_chars: int = 6000, preview: int = 200) -> tuple[DataFrame, DataFrame]:
    """Documents that came with turns, sanitised: (session, turn, name, mime, original_sha256, char_count, sanitized_text, preview, chunks_total, was_sanitized, entity_types), and the entities after them.

    media: (session, turn, name, mime, document), a text a row, as of `sessions.data_urls`; turns of a session are unique here.
    """
    rows = media.withColumn("text", F.col("document"))
    found = keep(detect_turns(rows, chunk_chars=None))
    done, after = sanitize(rows, entities, found)
    types = found.groupBy(F.col("session").alias("_s"), F.col("turn").alias("_t")).agg(F.array_sort(F.collect_set("entity_type")).alias("_types"))
    joined = done.join(types, done["session"].eqNullSafe(F.col("_s")) & (done["turn"] == F.col("_t")), "left")
    columns = ("session", "turn", "name", "mime", F.sha2("text", 256).alias("original_sha256"), F.length("text").alias("char_count"), F.col("sanitized").alias("sanitized_text"), F.left("sanitized", F.lit(preview)).alias("preview"))
    none = F.array().cast("array<string>")
    return joined.select(*columns, F.ceil(F.length("text") / F.lit(chunk_chars)).cast("long").alias("chunks_total"), F.col("modified").alias("was_sanitized"), F.coalesce("_types", none).alias("entity_types")), after


def compacted(windows: DataFrame, summarize, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Summaries of windows(session, turn, text) that may be kept: (session, turn, accepted, reason, summary), and the entities after them.

    The window is sanitised before summarize(column) sees it; its tokens are those that a summary may hold. A summary is
    judged, made-up tokens are taken out, and what it says in clear is sanitised again with numbers that only go on.
    """
    safe, after = sanitize(windows, entities)
    told = keep(safe.select("session", F.col("turn").alias("window"), summarize(F.col("sanitized")).alias("summary"), grammar.tokens(F.col("sanitized")).alias("allowed")))
    judged = keep(compaction.verdict(told, after))
    again, last = sanitize(judged.filter("accepted and repaired is not null").select("session", F.col("window").alias("turn"), F.col("repaired").alias("text")), after)
    clean = again.select(F.col("session").alias("_s"), F.col("turn").alias("_t"), F.col("sanitized").alias("_clean"))
    joined = judged.join(clean, judged["session"].eqNullSafe(F.col("_s")) & (judged["window"] == F.col("_t")), "left")
    return joined.select("session", F.col("window").alias("turn"), "accepted", "reason", F.when(F.col("accepted"), F.coalesce("_clean", "repaired")).alias("summary")), last
