"""Turn-level pieces: gates, projections for viewers, candidates, annotations, folds, payloads and small text operations."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushframe.functions import grammar, taxonomy

_SOLID = re.compile(r"\S")
REDACTED = "[redacted: localhost-only]"
# Words that tell what a user asks for.
INTENTS = (("math", r"(?i)\b(sum|total|add|average|percent|calculate|how much|difference)\b"), ("document", r"(?i)\b(document|file|pdf|attachment|summari[sz]e)\b"))


def local_path(c: Column) -> Column:
    """Whether a fetch target is a local file."""
    return c.rlike(r"^(file://|~[/\\]|/|\.{1,2}[/\\]|[A-Za-z]:[\\/])")


def fetch_tool(tool: Column, target: Column) -> Column:
    """A web fetch of a local path is a read of that file."""
    return F.when((tool == "web_fetch") & local_path(target), F.lit("read_file")).otherwise(tool)


def intent(c: Column) -> Column:
    """math, document or chat, by the first rule that fits."""
    return reduce(lambda rest, r: F.when(c.rlike(r[1]), F.lit(r[0])).otherwise(rest), reversed(INTENTS), F.lit("chat"))


def for_viewer(rows: DataFrame, secret: list[str], local: Column) -> DataFrame:
    """Rows as a viewer may see them: secret columns only where the viewer is local."""
    return rows.withColumns({c: F.when(local, F.col(c)).otherwise(F.lit(REDACTED)) for c in secret})


def expired(seen: Column, now: Column, minutes: int) -> Column:
    return F.unix_millis(now) - F.unix_millis(seen) >= minutes * 60_000


def safe_key(c: Column) -> Column:
    """A key as a file name."""
    return F.regexp_replace(F.trim(c), r"[^\w.-]", "_")


def match_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def partial_candidates(texts: DataFrame, entries: DataFrame, keys: list[str], text: str, least: int = 4) -> DataFrame:
    """Words of known canonical surfaces that a text holds without the whole surface: (keys, placeholder, part).

    Words of texts and of surfaces are matched by equality. entries: (placeholder, canonical).
    """
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}#-]+"), lambda w: F.length(w) >= least))
    parts = entries.select("placeholder", F.lower("canonical").alias("_canonical"), F.explode(words(F.col("canonical"))).alias("part"))
    said = texts.select(*keys, F.lower(text).alias("_text"), F.explode(words(F.col(text))).alias("part"))
    found = said.join(parts, "part").filter(~F.contains("_text", F.col("_canonical")))
    return found.select(*keys, "placeholder", "part").distinct()


def annotate(texts: DataFrame, vault: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Where restored tokens stand in the restored text: (keys, placeholder, value, start, end) in UTF-16 units.

    vault: (placeholder, canonical). A token's place is the length of all pieces before it, restored.
    """
    pieces = F.split(F.regexp_replace(F.col(text), f"({grammar.PLACEHOLDER})", "\x00$1\x00"), "\x00", -1)
    cut = texts.select(*keys, F.posexplode(pieces).alias("place", "piece"))
    known = cut.join(vault.select(F.col("placeholder").alias("piece"), "canonical"), "piece", "left").withColumn("shown", F.coalesce("canonical", "piece"))
    upto = F.sum(grammar.utf16_length(F.col("shown"))).over(Window.partitionBy(*keys).orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    ended = known.withColumn("end", upto).filter(F.col("canonical").isNotNull())
    return ended.select(*keys, F.col("piece").alias("placeholder"), F.col("canonical").alias("value"), (F.col("end") - grammar.utf16_length(F.col("canonical"))).cast("long").alias("start"), F.col("end").cast("long").alias("end"))


#: Of so many parts all sets are listed.
FEW_PARTS = 6


def protecting(values: DataFrame, vault: DataFrame, session: str, value: str, token: Column, other: Column) -> DataFrame:
    """The placeholder whose surface shares most parts with each value of its session, then the longest surface, then the last in order.

    values: (session, value, ...); vault: (session, placeholder, canonical); token and other: arrays of parts of a value and
    of a surface. Returns (session, value, placeholder, shared), a row per value that shares a part with any surface.
    """
    left = values.select(session, value, F.array_distinct(F.filter(token, lambda p: p.isNotNull())).alias("_all")).distinct()
    right = vault.select(session, "placeholder", "canonical", F.array_distinct(F.filter(other, lambda p: p.isNotNull())).alias("_all")).distinct()
    few = F.size("_all") <= FEW_PARTS
    best = lambda n: F.max(F.struct(n, F.length("canonical").alias("length"), F.col("placeholder"))).alias("best")
    # Of all surfaces that hold a set of parts only the best can win by sharing that set, so values meet sets, not surfaces: a part
    # that is frequent on both sides costs a row each, not a row per pair.
    held = right.filter(few).select(session, "placeholder", "canonical", F.explode(_subsets(F.col("_all"))).alias("_set"))
    held = held.groupBy(session, "_set").agg(best(F.size("_set").cast("long").alias("n")))
    said = left.filter(few).select(session, value, F.explode(_subsets(F.col("_all"))).alias("_set"))
    found = said.join(held, [session, "_set"]).select(session, value, "best")
    # Those of many parts have too many sets, and are compared one by one.
    for mine, theirs in ((left.filter(~few), right), (left.filter(few), right.filter(~few))):
        parts = mine.select(session, value, F.explode("_all").alias("_part")).join(theirs.select(session, "placeholder", "canonical", F.explode("_all").alias("_part")), [session, "_part"])
        found = found.unionByName(parts.groupBy(session, value, "placeholder", "canonical").agg(F.count("*").alias("n")).groupBy(session, value).agg(best(F.col("n"))))
    return found.groupBy(session, value).agg(F.max("best").alias("best")).select(session, value, F.col("best.placeholder").alias("placeholder"), F.col("best.n").alias("shared"))


def _subsets(parts: Column) -> Column:
    """All sets of parts but the empty one, each sorted."""
    none = F.array(F.array().cast("array<string>"))
    every = F.aggregate(F.array_sort(parts.cast("array<string>")), none, lambda sets, p: F.concat(sets, F.transform(sets, lambda s: F.array_append(s, p))))
    return F.filter(every, lambda s: F.size(s) > 0)


def backfill(calls: DataFrame, results: DataFrame, keys: list[str], note: str = "[missing result]") -> DataFrame:
    """Results with a note for each call that has none."""
    missing = calls.join(results.select(*keys), keys, "left_anti").select(*keys, F.lit(note).alias("content"), F.lit(True).alias("filled"))
    return results.select(*keys, "content", F.lit(False).alias("filled")).unionByName(missing)


def line_window(docs: DataFrame, key: str, offset: int, limit: int, text: str = "text") -> DataFrame:
    """Lines offset+1 to offset+limit of each text, as a reader of a file asks for them."""
    lines = F.slice(F.split(text, "\n", -1), offset + 1, limit)
    return docs.select(key, F.posexplode(lines).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + offset + 1)


def spill(results: DataFrame, key: str, text: str, limit: int, preview: int) -> tuple[DataFrame, DataFrame]:
    """Large results as a reference and a preview, and the side table of their whole texts."""
    large = F.length(text) > limit
    note = F.concat(F.lit("[stored as "), F.sha2(text, 256), F.lit(", "), F.length(text).cast("string"), F.lit(" chars]\n"), F.left(text, F.lit(preview)))
    return results.withColumn(text, F.when(large, note).otherwise(F.col(text))), results.filter(large).select(F.sha2(text, 256).alias("reference"), key, text)


def fold(results: DataFrame, keys: list[str], flags: list[str], lists: list[str]) -> DataFrame:
    """Merge results of nested parts: flags by or, lists joined in order of `part`."""
    joined = [F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", F.col(c).alias("v")))), lambda x: x["v"])).alias(c) for c in lists]
    return results.groupBy(*keys).agg(*[F.bool_or(c).alias(c) for c in flags], *joined)


def keep_last(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    last = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("_r", F.row_number().over(last)).filter(F.col("_r") <= n).drop("_r")


def trailer(lines: DataFrame, key: str, order: str, is_trailer: Column) -> DataFrame:
    """Mark the lines at a text's end that are all trailer: adds in_trailer."""
    back = Window.partitionBy(key).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("in_trailer", F.min(is_trailer.cast("int")).over(back) == 1)


def fill(template: Column, slots: dict[str, Column]) -> Column:
    """A template with its {slots} filled and space collapsed."""
    return grammar.collapse(reduce(lambda t, s: F.replace(t, F.lit("{" + s[0] + "}"), s[1].cast("string")), slots.items(), template))


def split_message(c: Column, limit: int = 2000) -> Column:
    """Parts of a message of at most `limit` characters, cut at the last newline there is in one, else at a blank, else hard.

    A part ends before the newline or blank it is cut at; space at the start of the next one goes.
    """

    def one(text: str | None) -> list[str]:
        out, at = [], 0
        while text and len(text) - at > limit:
            stop = next((p for p in (text.rfind(x, at + 1, at + limit) for x in "\n ") if p > at), at + limit)
            out.append(text[at:stop])
            solid = _SOLID.search(text, stop)
            at = solid.start() if solid else len(text)
        return [*out, text[at:]] if text and at < len(text) else out

    split = F.pandas_udf(lambda s: pd.Series([one(t) for t in s]), "array<string>")
    whole = F.when(F.length(c) > 0, F.array(c)).otherwise(F.array().cast("array<string>"))
    # Only messages that need cutting go to Python.
    return F.when(F.length(c) > limit, split(F.when(F.length(c) > limit, c))).otherwise(whole)


def turn_report(entities: DataFrame, keys: list[str]) -> DataFrame:
    """A line per turn: `TYPE xN` of what was protected."""
    counted = entities.groupBy(*keys, F.upper("entity_type").alias("t")).agg(F.count("*").alias("n"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("t", "n"))), lambda x: F.concat(x["t"], F.lit(" x"), x["n"].cast("string")))
    return counted.groupBy(*keys).agg(F.array_join(items, ", ").alias("report"), F.sum("n").alias("total"))


def severity_flags(tokens: Column) -> Column:
    """Whether any token of an array is of a severe type."""
    return F.exists(tokens, lambda t: taxonomy.severity_of(taxonomy.slug_of(F.regexp_extract(t, grammar.PLACEHOLDER_TAG, 1))) == "high")
