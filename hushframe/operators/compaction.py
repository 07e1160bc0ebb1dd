"""Guard of summaries: what tokens a summary may hold, and what is done about the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.functions import grammar, scalars


def check(summary: Column, allowed: Column) -> Column:
    """struct(kept, foreign, renumbered): tokens of a summary within `allowed`, outside, and outside though their tag is allowed."""
    found = grammar.tokens(summary)
    foreign = F.array_except(found, allowed)
    tag = lambda t: F.regexp_extract(t, grammar.PLACEHOLDER_TAG, 1)
    known = F.array_distinct(F.transform(allowed, tag))
    renumbered = F.filter(foreign, lambda t: F.array_contains(known, tag(t)))
    return F.struct(F.array_intersect(found, allowed).alias("kept"), foreign.alias("foreign"), renumbered.alias("renumbered"))


def strip(text: Column, bad: Column) -> Column:
    """A text without some tokens, white space of each line closed up."""
    gone = F.aggregate(bad, text, lambda acc, t: F.replace(acc, t, F.lit("")))
    return F.array_join(F.transform(F.split(gone, "\n", -1), grammar.collapse), "\n")


def verdict(summaries: DataFrame, vault: DataFrame) -> DataFrame:
    """Whether each summary may replace its window: (session, window, accepted, reason, repaired, foreign, renumbered).

    summaries: (session, window, summary, allowed array<string>), allowed the tokens of what was summed up; vault: (session,
    placeholder). A token outside `allowed` that the vault knows was put in place of another: the summary is rejected.
    One that it doesn't know is made up: it is taken out. No summary is accepted as it is.
    """
    none = F.array().cast("array<string>")
    bad = F.coalesce(F.array_except(grammar.tokens(F.col("summary")), F.col("allowed")), none)
    df = summaries.select("session", "window", "summary", scalars.filtered(bad).alias("_bad"))
    told = df.select(F.col("session").alias("_of"), F.col("window").alias("_w"), F.explode("_bad").alias("token"))
    # Joined by shuffle, so that what is gathered by window before it moves again is a shuffled partition's, not all that a task scans; only what the vault knows is.
    known = vault.select("session", "placeholder").hint("merge")
    both = told.join(known, told["_of"].eqNullSafe(known["session"]) & (F.col("token") == F.col("placeholder")))
    put = both.groupBy("_of", "_w").agg(F.collect_set("token").alias("_put")).hint("shuffle_hash")  # a few rows beside the summaries, which then needn't be sorted
    df = df.join(put, df["session"].eqNullSafe(F.col("_of")) & df["window"].eqNullSafe(F.col("_w")), "left")
    df = df.withColumn("renumbered", F.array_sort(F.array_intersect("_bad", F.coalesce("_put", none))))
    df = df.withColumn("foreign", F.array_sort(F.array_except("_bad", "renumbered")))
    empty = F.coalesce(F.col("summary") == "", F.lit(True))
    reason = F.when(empty, F.lit("empty")).when(F.size("renumbered") > 0, F.lit("renumbered placeholder in summary")).when(F.size("foreign") > 0, F.lit("repaired")).otherwise(F.lit("clean"))
    accepted = F.size("renumbered") == 0
    repaired = F.when(~empty & accepted, F.when(F.size("foreign") > 0, strip(F.col("summary"), F.col("foreign"))).otherwise(F.col("summary"))).when(empty, F.col("summary"))
    return df.select("session", "window", accepted.alias("accepted"), reason.alias("reason"), repaired.alias("repaired"), "foreign", "renumbered")


def counters(vault: DataFrame, session: str, placeholder: str = "placeholder") -> DataFrame:
    """Highest number of each tag of a session."""
    tag = grammar.placeholder_tag(F.col(placeholder))
    number = F.regexp_extract(placeholder, r"_(\d+)>>$", 1).cast("long")
    return vault.groupBy(session, tag.alias("tag")).agg(F.max(number).alias("counter"))


def shrunk(before: DataFrame, after: DataFrame, session: str) -> DataFrame:
    """Counters that went down, which they never may: a token would be given twice."""
    joined = before.join(after.withColumnRenamed("counter", "now"), [session, "tag"], "left")
    return joined.filter(F.coalesce("now", F.lit(0)) < F.col("counter"))
