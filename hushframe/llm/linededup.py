"""Line dedup by winnowing over line hashes.

A text is the sequence of its lines (split at newline, lines without a word left aside), a line the hash of its words. A
passage is a run of whole lines with at least `words` words. Winnowing picks the lowest line hash of every shortest such
run: two texts that share a passage share a fingerprint. Fingerprints are joined; only texts that hold one a second time
go on. Joining each place of a fingerprint with all earlier ones and extending every pair would cost the square of the
copies of a frequent passage, and joining it with the first alone would miss a longer match with another. So matches are
extended by the runs themselves: every shortest run that starts, and every one that ends, at a line is compared with the
first place that holds it (128 bits), and those two kinds of runs together cover a match of any length to both its ends.
Lines of runs that occurred before, in an earlier document or earlier in the same one, are deleted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.llm.common import BROADCAST_BYTES, checkpoint, free_name, marks, mix64, release, steps, word_hashes

WORDS = 50
_STEP, _OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _line_table(data: np.ndarray, offsets: np.ndarray):
    """For the texts in a buffer: hash, words and number (within the text) of each line with a word, and each text's first of them."""
    hashes, starts, _ = word_hashes(data, offsets, fold_case=False)
    if not len(hashes):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    breaks = np.flatnonzero(data == 10)
    text_of = np.searchsorted(offsets, starts, "right") - 1
    line_of = np.searchsorted(breaks, starts)  # newlines before the word, over all texts
    new = np.ones(len(starts), bool)
    new[1:] = (line_of[1:] != line_of[:-1]) | (text_of[1:] != text_of[:-1])
    begin = np.flatnonzero(new)
    words = np.diff(begin, append=len(starts))
    place = (np.arange(len(starts)) - np.repeat(begin, words)).astype(np.uint64)
    lines = mix64(np.add.reduceat(mix64(hashes + place * _STEP), begin) + words.astype(np.uint64))
    number = line_of[begin] - np.searchsorted(breaks, offsets[:-1])[text_of[begin]]
    return lines, words, number, np.searchsorted(text_of[begin], np.arange(len(offsets)))


def runs(lines: np.ndarray, words: np.ndarray, least: int) -> tuple[list[int], list[tuple[int, int]], list[int], list[int]]:
    """Shortest runs of a text's lines with at least `least` words: fingerprints, and each run's hash (two halves), first and last line."""
    total = np.concatenate([[0], np.cumsum(words)])
    n = len(lines)
    if total[-1] < least:
        return [], [], [], []
    ends = np.searchsorted(total, total[:-1] + least)  # past the last line, from each start
    firsts = np.flatnonzero(ends <= n)
    spans = {(int(i), int(ends[i])) for i in firsts}
    prints = {int(lines[i : ends[i]].min()) for i in firsts}
    begins = np.searchsorted(total, total[1:] - least, "right") - 1  # the last start for each end
    spans |= {(int(begins[j]), j + 1) for j in range(n) if begins[j] >= 0}
    out, first, last = [], [], []
    for a, b in sorted(spans):
        place = np.arange(b - a, dtype=np.uint64)
        sums = [mix64(lines[a:b] + place * _STEP).sum(dtype=np.uint64), mix64((lines[a:b] ^ _OTHER) + place * _STEP).sum(dtype=np.uint64)]
        one, two = mix64(np.array(sums) + np.uint64(b - a)).view(np.int64).tolist()
        out.append((one, two))
        first.append(a)
        last.append(b - 1)
    return sorted(prints), out, first, last


def _signed(values: list[int]) -> list[int]:
    return [v - (1 << 64) if v >> 63 else v for v in values]


def sequences(docs: DataFrame, words: int) -> DataFrame:
    """Per text with a run: its key (doc_id, m1, m2), its fingerprints, and its runs (hash, first and last line number, whether first in this text)."""
    run_type = pa.list_(pa.struct([("run", pa.int64()), ("also", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("fresh", pa.bool_())]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first_row, _, data, offsets in steps(batch.column(1)):
                lines, counts, number, begin = _line_table(data, offsets)
                rows, out = [], []
                for k in range(len(offsets) - 1):
                    a, b = int(begin[k]), int(begin[k + 1])
                    prints, hashes, first, last = runs(lines[a:b], counts[a:b], words)
                    if not prints:
                        continue
                    seen, own = set(), []
                    for h, f, t in zip(hashes, first, last, strict=True):
                        own.append({"run": h[0], "also": h[1], "first": int(number[a + f]), "last": int(number[a + t]), "fresh": h not in seen})
                        seen.add(h)
                    rows.append(first_row + k)
                    out.append((_signed(prints), own))
                if out:
                    key = [batch.column(i).take(pa.array(rows)) for i in (0, 2, 3)]
                    c = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([*key, pa.array(c[0], pa.list_(pa.int64())), pa.array(c[1], run_type)], names=["doc_id", "m1", "m2", "prints", "runs"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"), *marks())
    return rows.mapInArrow(read, "doc_id long, m1 long, m2 long, prints array<long>, runs array<struct<run:long,also:long,first:int,last:int,fresh:boolean>>")


def repeated(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Line ranges to delete: (doc_id, m1, m2, spans array<struct<first, last>>), a row per document with any.

    Ranges are inclusive numbers of lines from 0, apart and in order. The first place of a passage is that with the
    smallest doc_id, null doc_ids last, in it the topmost; of rows that share a doc_id, the text of smaller hash comes
    first. Rows equal in doc_id and text are one document: they don't delete one another's lines. m1, m2: see `marks`.
    docs: (doc_id, text).
    """
    rows = checkpoint(sequences(docs, words).withColumn("row", F.monotonically_increasing_id()))
    prints = rows.select("row", F.explode("prints").alias("print"))
    # A print is suspect if two texts hold it, or one text twice (then a run of it isn't fresh).
    twice = checkpoint(prints.groupBy("print").agg(F.count("*").alias("n")).filter("n > 1").select("print"))
    inside = rows.filter(F.exists("runs", lambda r: ~r["fresh"])).select("row")
    suspects = checkpoint(prints.join(twice, "print").select("row").unionByName(inside).distinct())
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "m1", "m2")
    spans = rows.join(suspects, "row", "left_semi").select("doc_id", "m1", "m2", F.explode("runs").alias("r")).select("doc_id", "m1", "m2", "r.*")
    spans = checkpoint(spans)
    first = checkpoint(spans.groupBy("run", "also").agg(F.min(key).alias("origin"), F.count("*").alias("n")).filter("n > 1").select("run", "also", "origin"))
    later = spans.join(first, ["run", "also"]).filter((key > F.col("origin")) | (key.eqNullSafe(F.col("origin")) & ~F.col("fresh")))
    # Runs overlap; what a row needs is their union.
    span = "struct<first:int,last:int>"
    merged = F.expr(f"""aggregate(array_sort(collect_set(struct(first, last))), cast(array() as array<{span}>), (done, s) ->
        CASE WHEN size(done) > 0 AND element_at(done, -1).last + 1 >= s.first
        THEN concat(slice(done, 1, size(done) - 1), array(named_struct('first', element_at(done, -1).first, 'last', greatest(element_at(done, -1).last, s.last))))
        ELSE concat(done, array(s)) END)""")
    gone = checkpoint(later.groupBy("doc_id", "m1", "m2").agg(merged.alias("spans")))
    release(rows, twice, suspects, spans, first)
    return gone


def _without(text: pa.Array, spans: pa.Array) -> pa.Array:
    removed, kept = [], []
    for t, own in zip(text, spans, strict=True):
        t, own = t.as_py(), own.as_py()
        lines = t.split("\n") if t else []
        gone = {i for s in own or () for i in range(s["first"], s["last"] + 1)}
        removed.append(sorted(gone))
        kept.append("\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else None)
    return pa.StructArray.from_arrays([pa.array(removed, pa.list_(pa.int32())), pa.array(kept, pa.string())], names=["removed", "kept"])


def dedup(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """`docs` with repeated passages deleted from `text`: adds n_lines, removed (array of line numbers) and kept_text.

    n_lines: lines of the text, 0 for null or empty text. Deleted lines go with their newline, all else stays as it was; a
    null text stays null. A row keeps its text if none of its lines is deleted. Repeated rows, null or shared doc_ids, ties:
    see `repeated`. An empty table stays empty. Columns of `docs` named n_lines, removed or kept_text are replaced, all others kept.
    """
    gone = repeated(docs.select("doc_id", "text"), words)
    doc, one, two, spans, cut_ = (free_name(docs, n) for n in ("_doc", "_one", "_two", "_spans", "_cut"))
    gone = gone.select(F.col("doc_id").alias(doc), F.col("m1").alias(one), F.col("m2").alias(two), F.col("spans").alias(spans))
    held = gone.agg(F.count("*"), F.sum(F.size(spans))).first()
    small = 64 * held[0] + 16 * (held[1] or 0) <= BROADCAST_BYTES
    m1, m2 = marks()
    on = docs["doc_id"].cast("long").eqNullSafe(F.col(doc)) & (m1 == F.col(one)) & (m2 == F.col(two))
    df = docs.join(F.broadcast(gone) if small else gone, on, "left").drop(doc, one, two)
    lines = F.when(F.length("text") > 0, F.split("text", "\n", -1)).otherwise(F.array().cast("array<string>"))
    df = df.withColumn("n_lines", F.coalesce(F.size(lines), F.lit(0)).cast("long"))
    # Called non-deterministic so that no filter on its result is evaluated apart from it, which would cut every text twice.
    cut = F.arrow_udf(_without, "struct<removed:array<int>,kept:string>").asNondeterministic()
    # Only texts that lose lines go to Python; all others are null there.
    df = df.withColumn(cut_, cut(F.when(F.col(spans).isNotNull(), F.col("text").cast("string")), F.col(spans)))
    df = df.withColumn("removed", F.coalesce(F.col(cut_)["removed"], F.array().cast("array<int>")))
    return df.withColumn("kept_text", F.when(F.size("removed") > 0, F.col(cut_)["kept"]).otherwise(F.col("text"))).drop(spans, cut_)
