"""Deterministic detector: pattern rules as one projection, and its composition by priority.

A model may stand in for the rules: any DataFrame (keys, detect_rank, text, entity_type) goes on with `by_priority`.
Phone, address, card and credential patterns are rules of this library; the pattern of local paths and what is cut off
their ends are fixed values. Patterns keep to what Java's and RE2's regular expressions share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushframe.functions import grammar, taxonomy

#: (entity type, pattern, group, source): source 0 general, 1 numeric, 2 paths, as the detectors run.
RULES = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", 0, 0),
    ("ip_address", r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b", 0, 0),
    ("phone", r"\+[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4}", 0, 0),
    ("credential", r"(?:token|password|secret|api_key) = \"[0-9A-Za-z]{16,}\"", 0, 0),
    ("identifier", r"\b[0-9]{16}\b", 0, 0),
    ("url", r"https?://[^\s<>'\"]+", 0, 0),
    ("financial", r"\$[0-9][0-9,]*(?:\.[0-9]+)?", 0, 1),
    ("percentage", r"\b[0-9]+(?:\.[0-9]+)?%", 0, 1),
    ("temporal", r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b", 0, 1),
    ("local_path", r"(?:^|\s)(file://[^\s<>'\"]+|~[/\\][^\s<>'\"]+|/[^<>'\"\s]+|\.{1,2}[/\\][^\s<>'\"]+|[A-Za-z]:[\\/][^\s<>'\"]+)", 1, 2),
)
PATH_TRAILING = r".,;:!?)\\]}"
#: What a text must hold for a rule to match at all: a plain search decides most texts.
NEEDLES = {"email": "@", "phone": "+", "credential": ' = "', "url": "://", "financial": "$", "percentage": "%"}
#: The e-mail rule for Java's expressions: a run is read once, from its start or from the end of the match before, and never
#: given back, so a long run without an @ takes time in proportion to its length.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def matches(text: Column, entity_type: str) -> Column:
    """All matches of a type's rule in a text, in order."""
    _, pattern, group, _ = next(r for r in RULES if r[0] == entity_type)
    found = F.regexp_extract_all(text, F.lit(_EMAIL if entity_type == "email" else pattern), F.lit(group))
    if entity_type in NEEDLES:
        found = F.when(F.contains(text, F.lit(NEEDLES[entity_type])), found).when(text.isNotNull(), F.array().cast("array<string>"))
    if entity_type == "local_path":
        found = F.filter(F.transform(found, lambda x: F.regexp_replace(x, r"[.,;:!?)\\\]}]+$", "")), lambda x: x != "")
    return found


def _entity(i: int, slug: str, source: int):
    return lambda x, k: F.struct(F.lit(source).alias("source_rank"), (F.lit(i * 1_000_000) + k).cast("long").alias("detect_rank"), x.alias("entity_text"), F.lit(slug).alias("entity_type"))


def detect(docs: DataFrame, text: str = "text", types: tuple[str, ...] | None = None) -> DataFrame:
    """All matches: the columns of `docs` without text, with source_rank, detect_rank, entity_text and entity_type."""
    parts = []  # null texts have no matches
    for i, (slug, _, _, source) in enumerate(RULES):
        if types is None or slug in types:
            parts.append(F.transform(matches(F.col(text), slug), _entity(i, slug, source)))
    rest = [c for c in docs.columns if c != text]
    return docs.select(*rest, F.inline(F.concat(*parts)))


def by_priority(found: DataFrame, keys: list[str]) -> DataFrame:
    """One entity for each surface of a text: highest priority, then first found; the library's own tokens are no entities."""
    order = Window.partitionBy(*keys, "entity_text").orderBy(taxonomy.priority_of(F.col("entity_type")).desc(), "source_rank", "detect_rank")
    own = found.filter(~F.col("entity_text").rlike(grammar.INTERNAL_TOKEN))
    return own.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank")


def number_value(entity_text: Column, entity_type: Column) -> Column:
    """Numeric value of a financial or percentage surface: separators off, percent as a fraction; null for others."""
    digits = F.regexp_replace(entity_text, r"[$,%]", "").try_cast("double")
    return F.when(entity_type == "financial", digits).when(entity_type == "percentage", digits / 100)


def mint(found: DataFrame, session: str, turn: str) -> DataFrame:
    """Placeholders of a session's surfaces, numbered by tag in order of first appearance (turn, longer first, rank).

    found: (session, turn, detect_rank, entity_text, entity_type) after `by_priority`. Surfaces are first reduced to one row
    each, so the numbering sorts surfaces, not occurrences.
    """
    first = F.min(F.struct(F.col(turn).alias("turn"), (-F.length("entity_text")).alias("shorter"), F.col("detect_rank").alias("rank"), F.col("entity_type").alias("type"))).alias("first")
    surfaces = found.groupBy(session, "entity_text").agg(first, F.max(turn).alias("last_seen_turn"))
    surfaces = surfaces.withColumn("tag", taxonomy.tag_of(F.col("first.type")))
    number = F.row_number().over(Window.partitionBy(session, "tag").orderBy("first.turn", "first.shorter", "first.rank", "entity_text"))
    token = F.concat(F.lit("<<"), F.col("tag"), F.lit("_"), number.cast("string"), F.lit(">>"))
    return surfaces.select(session, F.col("entity_text").alias("canonical"), F.col("first.type").alias("entity_type"), token.alias("placeholder"), F.col("first.turn").alias("created_turn"), "last_seen_turn")
