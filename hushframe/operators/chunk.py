"""Content sniffing and chunking of long or structured payloads.

A text without blank lines is cut by column expressions. Paragraph packing, JSON and markdown depend on what came before
within one payload, so they run as Arrow batches, a payload at a time.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_CHARS, OVERLAP = 6000, 300
# What a payload starts with or holds.
HTML_HINTS = ("<!doctype html", "<html", "<head", "<body", "<div", "<span", "<table", "<p>", "<br", "<a ")
MARKDOWN_STARTS = ("# ", "## ", "```", "- ", "* ", "> ")
MARKDOWN_HINTS = ("\n# ", "\n## ", "\n```", "\n- ", "\n* ", "\n> ", "\n---", "\n| ")
JSON_LIMIT = 16_384
HREF = r"""\b(?:href|src|content|action|cite|data-[\w-]+)\s*=\s*["']([^"']+)["']"""
META = r"""<meta\b[^>]*?(?:name|property|http-equiv)\s*=\s*["']([^"']+)["'][^>]*?content\s*=\s*["']([^"']+)["']"""


def sniff(c: Column) -> Column:
    """text, json, html or markdown."""
    bare = F.regexp_replace(c, r"^\s+", "")
    head = F.lower(F.left(bare, F.lit(512)))
    whole = F.regexp_replace(bare, r"\s+$", "")
    some = lambda text, hints: F.exists(F.array(*[F.lit(h) for h in hints]), lambda h: F.contains(text, h))
    is_json = head.rlike(r"^[{\[]") & F.when(F.length(whole) <= JSON_LIMIT, F.try_parse_json(whole).isNotNull()).otherwise(head.rlike(r'^(\{"|\[\{)') & F.contains(head, F.lit('":')))
    start = F.left(c, F.lit(2048))
    many = F.size(F.filter(F.array(*[F.lit(h) for h in MARKDOWN_HINTS]), lambda h: F.contains(start, h))) >= 2
    is_markdown = F.exists(F.array(*[F.lit(h) for h in MARKDOWN_STARTS]), lambda h: F.startswith(head, h)) | many
    return F.when(F.coalesce(head, F.lit("")) == "", F.lit("text")).when(is_json, F.lit("json")).when(some(head, HTML_HINTS), F.lit("html")).when(is_markdown, F.lit("markdown")).otherwise(F.lit("text"))


def hard_cut(docs: DataFrame, text: str = "text", max_chars: int = MAX_CHARS) -> DataFrame:
    """Chunks of texts without blank lines: adds idx, chunk, span_start and span_end; a text within the limit is one chunk."""
    starts = F.sequence(F.lit(0), F.length(text) - 1, F.lit(max_chars))
    cut = docs.filter(F.length(text) > 0).withColumn("_s", F.explode(starts))
    body = F.substring(F.col(text), F.col("_s") + 1, F.lit(max_chars))
    out = cut.withColumn("idx", (F.col("_s") / max_chars).cast("int")).withColumn("chunk", body)
    return out.withColumn("span_start", F.col("_s")).withColumn("span_end", F.col("_s") + F.length("chunk")).drop("_s", text)


def meta_lines(c: Column) -> Column:
    return F.transform(F.arrays_zip(F.regexp_extract_all(c, F.lit("(?i)" + META), F.lit(1)).alias("n"), F.regexp_extract_all(c, F.lit("(?i)" + META), F.lit(2)).alias("v")), lambda m: F.concat(F.lit("meta["), m["n"], F.lit("]: "), m["v"]))


def references(c: Column) -> Column:
    """Urls and paths in attributes, in order."""
    found = F.transform(F.regexp_extract_all(c, F.lit("(?i)" + HREF), F.lit(1)), F.trim)
    return F.filter(found, lambda u: u.rlike(r"^(mailto:|tel:|(?i:https?://|ftps?://|file://)|/|\./|\.\./)"))


def visible_text(c: Column) -> Column:
    for tag in ("script", "style"):
        c = F.regexp_replace(c, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", " "), r"\s+", " "))


def html_text(c: Column) -> Column:
    """An HTML page as text: meta lines, references, what is visible, blank lines between."""
    parts = F.array(F.array_join(meta_lines(c), "\n"), F.array_join(references(c), "\n"), visible_text(c))
    return F.trim(F.array_join(F.filter(parts, lambda p: p != ""), "\n\n"))


def paragraphs(text: str, max_chars: int = MAX_CHARS, overlap: int = OVERLAP, overlap_on_cut: bool = False) -> list[tuple[str, int, int]]:
    """Pack paragraphs (blank lines end them) into chunks: (chunk, start, end) where the packed paragraphs stood.

    Every chunk but the first starts with the last `overlap` characters of the one before. Chunks above the limit are cut hard,
    as they are without overlap, or with it if overlap_on_cut.
    """
    if not text:
        return []
    if len(text) <= max_chars:
        return [(text, 0, len(text))]
    bounds = [0, *(m.end() for m in re.finditer("\n\n", text)), len(text)]
    spans: list[list[int]] = []
    for a, b in zip(bounds, bounds[1:], strict=False):
        if a == b:
            continue
        if spans and b - spans[-1][0] <= max_chars and spans[-1][1] == a:
            spans[-1][1] = b
        else:
            spans.append([a, b])
    whole: list[tuple[str, int, int]] = []
    for a, b in spans:
        tail = whole[-1][0][-overlap:] if whole and overlap > 0 else ""
        whole.append((tail + text[a:b], a, b))
    step = max_chars - overlap if overlap_on_cut and overlap < max_chars else max_chars
    return [(body[i : i + max_chars], a, b) for body, a, b in whole for i in (range(0, len(body), step) if len(body) > max_chars else (0,))]


def flatten(value, path: str = "$") -> Iterator[tuple[str, str]]:
    """Leaves of a JSON value as (path, text); nulls and empty texts are left out."""
    if isinstance(value, dict):
        for k, v in value.items():
            simple = k[:1].isalpha() and all(c.isalnum() or c == "_" for c in k)
            yield from flatten(v, f"{path}.{k}" if simple else f"{path}[{k!r}]")
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from flatten(v, f"{path}[{i}]")
    elif value is not None and str(value):
        yield path, str(value)


def json_chunks(text: str, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> list[str]:
    """Lines `path: leaf`, as many to a chunk as fit; what isn't JSON is cut as text."""
    try:
        lines = [f"{p}: {v}" for p, v in flatten(json.loads(text))]
    except ValueError:
        return [c for c, _, _ in paragraphs(text, max_chars, overlap)]
    out, size = [], 0
    for line in lines:
        if out and size + len(line) <= max_chars:
            out[-1].append(line)
        else:
            out.append([line])
            size = 0
        size += len(line) + 1
    return ["\n".join(x) for x in out]


def markdown_chunks(text: str, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> list[str]:
    """Sections from heading to heading, as many to a chunk as fit, never cut inside a fence but where one is too large."""
    at = [m.start() for m in re.finditer(r"(?m)^#{1,6}\s", text)]
    sections = [s for a, b in zip([0, *at], [*at, len(text)], strict=True) if (s := text[a:b].rstrip())] if at else [text]
    groups: list[list[str]] = []
    for section in sections:
        open_ = groups and sum(len(re.findall(r"(?m)^```", s)) for s in groups[-1]) % 2
        if groups and (open_ or sum(len(s) + 1 for s in groups[-1]) + len(section) <= max_chars):
            groups[-1].append(section)
        else:
            groups.append([section])
    return [c for g in groups for c, _, _ in paragraphs("\n".join(g), max_chars, overlap)]


def chunk(docs: DataFrame, key: str, text: str = "text", max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of any payload by its sniffed type: (key, content_type, idx, chunk)."""
    rows = docs.select(F.col(key).cast("long").alias(key), sniff(F.col(text)).alias("content_type"), F.when(sniff(F.col(text)) == "html", html_text(F.col(text))).otherwise(F.col(text)).alias("payload"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, kind, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = json_chunks if kind == "json" else markdown_chunks if kind == "markdown" else lambda t, m, o: [c for c, _, _ in paragraphs(t, m, o)]
                out.extend((k, kind, i, c) for i, c in enumerate(own(payload or "", max_chars, overlap)))
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.string()), strict=True)], names=[key, "content_type", "idx", "chunk"])

    return rows.mapInArrow(cut, f"{key} long, content_type string, idx int, chunk string")


def flat_json(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Leaves of JSON payloads of any depth: (key, path, leaf)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    out.extend((k, p, v) for p, v in flatten(json.loads(t or "null")))
                except ValueError:
                    continue
            cols = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string()), strict=True)], names=[key, "path", "leaf"])

    return docs.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, f"{key} long, path string, leaf string")


def chunk_traces(chunks: DataFrame, found: DataFrame, key: str, failed: Column) -> DataFrame:
    """A row per chunk: (key, idx, entities, entity_types, failed). chunks: (key, idx, ...); found: of the chunks' detector; failed: over a chunk's row."""
    per = found.groupBy(key, "idx").agg(F.count_distinct("entity_text").alias("entities"), F.array_sort(F.collect_set("entity_type")).alias("entity_types"))
    none = F.array().cast("array<string>")
    joined = chunks.select(key, "idx", failed.alias("failed")).join(per, [key, "idx"], "left")
    return joined.select(key, "idx", F.coalesce("entities", F.lit(0)).cast("long").alias("entities"), F.coalesce("entity_types", none).alias("entity_types"), "failed")


def coalesce_chunks(found: DataFrame, key: str) -> DataFrame:
    """Entities of all chunks of a document, each surface once, where it came first. found: (key, idx, detect_rank, entity_text, entity_type)."""
    first = F.min(F.struct("idx", "detect_rank", "entity_type")).alias("f")
    return found.groupBy(key, "entity_text").agg(first, F.count_distinct("idx").alias("chunks")).select(key, "entity_text", F.col("f.entity_type").alias("entity_type"), F.col("f.idx").alias("first_idx"), "chunks")
