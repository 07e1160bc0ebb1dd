"""Placeholder grammar `<<TAG_N>>` and the text functions around it, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token grammar.
PLACEHOLDER = r"<<[A-Z]+(?:_[A-Z]+)*_\d+>>"
PLACEHOLDER_TAG = r"<<([A-Z]+(?:_[A-Z]+)*)_\d+>>"
INTERNAL_TOKEN = r"(?:<<)?[A-Z]{2,}(?:_[A-Z]+)*_\d+(?:>>)?"
PLACEHOLDER_RE, PLACEHOLDER_TAG_RE, INTERNAL_TOKEN_RE = map(re.compile, (PLACEHOLDER, PLACEHOLDER_TAG, INTERNAL_TOKEN))


def is_placeholder(c: Column) -> Column:
    """Whether the whole string is one token."""
    return c.rlike(rf"\A{PLACEHOLDER}\z")


def placeholder_tag(c: Column) -> Column:
    """Tag of a token, null where the string isn't one."""
    return F.when(is_placeholder(c), F.regexp_extract(c, PLACEHOLDER_TAG, 1))


def placeholder_type(c: Column) -> Column:
    return F.lower(placeholder_tag(c))


def tokens(c: Column) -> Column:
    """Different tokens of a text in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(f"({PLACEHOLDER})"), 1))


def spans(c: Column) -> Column:
    """Where tokens stand in a text, which nothing may replace: array<struct<start, end>> in characters, end exclusive, in order."""
    found = F.regexp_extract_all(c, F.lit(f"({PLACEHOLDER})"), F.lit(1))
    between = F.split(c, PLACEHOLDER, -1)
    total = lambda parts: F.aggregate(parts, F.lit(0), lambda n, x: n + F.length(x))

    def one(token: Column, i: Column) -> Column:
        start = total(F.slice(between, F.lit(1), i + 1)) + total(F.slice(found, F.lit(1), i))
        return F.struct(start.alias("start"), (start + F.length(token)).alias("end"))

    return F.transform(found, one)


def tags(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(PLACEHOLDER_TAG), 1))


def only_placeholders(c: Column) -> Column:
    """Whether a text holds tokens and, besides, nothing but space."""
    return c.rlike(PLACEHOLDER) & (F.trim(F.regexp_replace(c, rf"{PLACEHOLDER}|\s", "")) == "")


def truncate(c: Column, limit: int, suffix: str = "\n... (truncated)") -> Column:
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit)), F.lit(suffix))).otherwise(c)


def head_and_tail(c: Column, limit: int) -> Column:
    """A text longer than `limit` as its two halves around a note of how much is left out."""
    half = limit // 2
    note = F.concat(F.lit("\n\n... ("), (F.length(c) - 2 * half).cast("string"), F.lit(" chars truncated) ...\n\n"))
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(half)), note, F.right(c, F.lit(half)))).otherwise(c)


def token_estimate(c: Column) -> Column:
    """Rough number of model tokens of a message: four more than a quarter of its characters, four at least."""
    return F.greatest(F.lit(4), F.floor(F.length(F.coalesce(c, F.lit(""))) / 4).cast("int") + 4)


def utf16_length(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16LE")) / 2).cast("int")


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def alias_key_ascii(c: Column) -> Column:
    """Alias key of ASCII text: space collapsed, lower case, no punctuation unless nothing else is left."""
    low = F.lower(collapse(c))
    bare = F.regexp_replace(low, r"[^\w\s]", "")
    return F.when(bare != "", bare).otherwise(low)


def alias_key(c: Column) -> Column:
    """Alias key of any text: compatibility forms unified and marks dropped, then as `alias_key_ascii`. Printable ASCII stays in the JVM."""
    import unicodedata

    def one(text):
        if not text:
            return ""
        plain = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", text))
        low = " ".join("".join(x for x in plain if not unicodedata.combining(x)).split()).lower()
        return re.sub(r"[^\w\s]", "", low) or low

    plain = F.coalesce(c.rlike(r"\A[\x20-\x7E]*\z"), F.lit(False))
    return F.when(plain, alias_key_ascii(c)).otherwise(F.pandas_udf(lambda s: s.map(one), "string")(F.when(~plain, c)))


# Reasoning blocks and control tokens that must not reach a reader, in the order in which they are taken out.
THINK = (
    r"(?s)<think>.*?</think>",
    r"(?sU)^\s*<think>.*$",
    r"(?s)<thought>.*?</thought>",
    r"(?sU)^\s*<thought>.*$",
    r"<think(?![A-Za-z0-9_\-:>/])",
    r"<thought(?![A-Za-z0-9_\-:>/])",
    r"(?U)^\s*</think>\s*",
    r"(?U)\s*</think>\s*$",
    r"(?U)^\s*</thought>\s*",
    r"(?U)\s*</thought>\s*$",
    r"(?U)^\s*<\|?channel\|?>\s*",
    r"(?:</?(?:t|th|thi|thin|think|tho|thou|thoug|though|thought)>?|<\|?(?:c|ch|cha|chan|chann|channe|channel)(?:\|?>?)?)$",
    r"(?U)^\s*<\|?$",
)


def strip(c: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def strip_think(c: Column) -> Column:
    """A text without reasoning blocks and what a model leaves of their marks at its ends; marks that prose mentions stay."""
    for pattern in THINK:
        c = F.regexp_replace(c, pattern, "")
    return strip(c)


def extract_think(c: Column) -> Column:
    """What closed reasoning blocks hold, joined by blank lines; null without any."""
    blocks = lambda tag: F.transform(F.regexp_extract_all(c, F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1)), strip)
    parts = F.concat(blocks("think"), blocks("thought"))
    return F.when(F.size(parts) > 0, F.array_join(parts, "\n\n"))
