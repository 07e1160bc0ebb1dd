"""Quality rules: a threshold table compiled into one projection of built-in functions.

A rule bounds one count by another: `low * per <= scale * count <= high * per`, in whole numbers, so that no rounding
decides. All counts come from the text alone and every rule reads them, so adding a rule adds a comparison, not a pass.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.llm.common import free_name, words_of

#: Frequent short words of the languages served (fixed values).
STOP_WORDS = {
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "on", "was", "with", "as", "by", "this", "be", "are", "from", "at"),
    "de": ("der", "die", "und", "den", "das", "von", "zu", "ist", "mit", "des", "dem", "nicht", "ein", "eine", "auf", "sich", "als", "für", "im", "in"),
    "fr": ("le", "la", "les", "de", "des", "et", "en", "un", "une", "du", "que", "qui", "pour", "dans", "par", "sur", "est", "pas", "au", "elle"),
    "es": ("el", "la", "los", "las", "de", "que", "y", "en", "un", "una", "del", "se", "por", "con", "no", "para", "es", "su", "al", "lo"),
}
SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """`low * per <= scale * count <= high * per`; `per` None stands for 1, a bound None for no bound."""

    name: str
    count: str
    per: str | None = None
    scale: int = 1
    low: int | None = None
    high: int | None = None

    def holds(self) -> Column:
        count, per = F.col(self.count) * F.lit(self.scale).cast("long"), F.col(self.per) if self.per else F.lit(1).cast("long")
        bounds = [count >= per * F.lit(self.low)] * (self.low is not None) + [count <= per * F.lit(self.high)] * (self.high is not None)
        return reduce(lambda a, b: a & b, bounds)

    def sql(self) -> str:
        per = self.per or "1"
        bounds = [f"{self.scale} * {self.count} >= {self.low} * {per}"] * (self.low is not None) + [f"{self.scale} * {self.count} <= {self.high} * {per}"] * (self.high is not None)
        return " AND ".join(bounds)


BASE_RULES = (Rule("enough words", "n_words", low=50), Rule("few repeated words", "n_repeat_words", "n_words", 100, high=50))
RULES = (
    Rule("word length", "word_chars", "n_words", 100, low=250, high=1200),
    Rule("few symbols", "n_symbols", "n_words", 100, high=10),
    Rule("stop words", "n_stop_words", "n_words", 100, low=5),
    Rule("few duplicate lines", "n_dup_lines", "n_lines", 100, high=40),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts that rules may bound: COUNTS, each a long and never null.

    n_lines: lines with a word; n_dup_lines: those equal to an earlier one; n_repeat_words: words in three-word windows found
    twice or more, the first included; n_stop_words: words in STOP_WORDS. A null text counts as empty, texts of any length are
    measured whole. A column of `docs` that has the name of a count is replaced, every other one stays.
    """
    stops = sorted({w for words in STOP_WORDS.values() for w in words})
    words, windows, again, ordered, hashes, lines = helpers = [free_name(docs, f"_{n}") for n in ("words", "windows", "again", "ordered", "hashes", "lines")]
    n = F.size(words)
    window = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    starts = F.sequence(F.lit(0), n - 3)
    df = docs.withColumn(words, words_of(text))
    df = df.withColumn(windows, F.when(n >= 3, F.transform(starts, window)).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn(again, F.size(windows) > F.size(F.array_distinct(windows)))
    # The windows in order of their hashes, with their places; only texts with a repeated window pay for the sort.
    places = F.transform(F.col(windows), lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    df = df.withColumn(ordered, F.when(F.col(again), F.array_sort(places)))
    df = df.withColumn(hashes, F.col(ordered)["h"])
    twin = lambda x, k: F.coalesce(F.get(hashes, k - 1) == x["h"], F.lit(False)) | F.coalesce(F.get(hashes, k + 1) == x["h"], F.lit(False))
    covered = F.array_distinct(F.flatten(F.transform(F.filter(ordered, twin), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    solid = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn(lines, solid)
    joined = F.array_join(words, "")
    return df.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(joined).cast("long"),
            "n_symbols": F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(SYMBOLS)).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_repeat_words": F.when(F.col(again), F.size(covered)).otherwise(F.lit(0)).cast("long"),
            "n_lines": F.size(lines).cast("long"),
            "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(stops))).cast("long"),
        }
    ).drop(*helpers)


def judge(docs: DataFrame, rules=RULES, base=BASE_RULES, text: str = "text") -> DataFrame:
    """Add the counts, base_failed and kept (false if base_failed, else whether all rules hold).

    No text or a text without words fails the base rules. Repeated rows are judged alike, as a text is judged by itself
    alone; a count right at a bound holds. An empty table stays empty.
    """
    all_hold = lambda table: reduce(lambda a, b: a & b, [r.holds() for r in table], F.lit(True))
    judged = measure(docs, text).withColumn("base_failed", ~all_hold(base))
    # A row number, always at least 0, keeps a filter on the verdict above the projections. Pushed below them it would repeat the
    # splitting of a text for each of its words.
    return judged.withColumn("kept", ~F.col("base_failed") & all_hold(rules) & (F.monotonically_increasing_id() >= 0))
