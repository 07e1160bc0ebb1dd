"""Leak evaluation: which true values survive in what leaves the host.

turns: (session, turn, raw, prepared, latency_ms); truth: (session, entity_type, value).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ident_tokens(value: Column) -> Column:
    """Identifying parts of a value, as often as they occur: runs of word characters that are all digits (three or more) or all letters (four or more)."""
    parts = F.regexp_extract_all(value, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.filter(parts, lambda p: p.rlike(r"^(?:\p{Nd}{3,}|\p{L}{4,})$"))


def pairs(turns: DataFrame, truth: DataFrame) -> DataFrame:
    """Each true value in each turn whose raw text holds it whole: whether it leaked, and how many of its parts did.

    A value leaks if any identifying part of it stays in the prepared text; one without such parts isn't scored.
    """
    truth = truth.withColumn("_parts", ident_tokens(F.col("value"))).filter(F.size("_parts") > 0)
    found = turns.join(truth, "session").filter(F.contains(F.col("raw"), F.col("value")))
    leaked = F.size(F.filter("_parts", lambda t: F.contains(F.col("prepared"), t)))
    return found.select(*turns.columns, "entity_type", "value", (leaked > 0).alias("leaked"), F.size("_parts").alias("tokens"), leaked.alias("leaked_tokens")).drop("raw")


def score(found: DataFrame, by: list[str]) -> DataFrame:
    """Counts and rates of pairs by some columns."""
    counted = found.groupBy(*by).agg(F.count("*").alias("pairs"), F.count_if("leaked").alias("leaked_pairs"), F.sum("tokens").alias("tokens"), F.sum("leaked_tokens").alias("leaked_tokens"))
    return counted.withColumn("pair_rate", F.try_divide(F.col("leaked_pairs").cast("double"), F.col("pairs"))).withColumn("token_rate", F.try_divide(F.col("leaked_tokens").cast("double"), F.col("tokens")))


def rollup(found: DataFrame, domain: str, kind: str) -> DataFrame:
    """The score by domain, by type and over all, in one pass of grouping sets."""
    sums = (F.count("*").alias("pairs"), F.count_if("leaked").alias("leaked_pairs"), F.sum("tokens").alias("tokens"), F.sum("leaked_tokens").alias("leaked_tokens"))
    return found.groupingSets([[domain], [kind], []], domain, kind).agg(*sums)


def weighted_rate(scores: DataFrame, weight: str, rate: str):
    """Mean of a rate over rows by their weight, null without weight: of sums, as those of sessions to those of all."""
    return F.try_divide(F.sum(F.col(weight) * F.coalesce(rate, F.lit(0.0))), F.sum(F.when(F.col(rate).isNotNull(), F.col(weight))))


def cross_sessions(found: DataFrame, alias: DataFrame, by: list[str]) -> DataFrame:
    """Scores of groups of sessions, with the alias rate over all values that recur.

    found: of `pairs`, with the columns `by`; alias: (by, session, multi, consistent), the number of values of a session seen
    in two turns or more and how many of them always had one token.
    """
    rate = F.try_divide(F.col("consistent").cast("double"), F.col("multi"))
    sums = alias.withColumn("_rate", rate).groupBy(*by).agg(F.sum("multi").alias("multi_turn_values"), weighted_rate(alias, "multi", "_rate").alias("alias_rate"))
    return score(found, by).join(sums, by, "left")


def domains(scores: DataFrame, latency: DataFrame, domain: str) -> DataFrame:
    """One row over all domains: sums, rates and the worst 95th percentile. scores: of `cross_sessions`; latency: (domain, p95)."""
    total = scores.join(latency, domain, "left").agg(
        F.count("*").alias("domains"), F.sum("pairs").alias("pairs"), F.sum("leaked_pairs").alias("leaked_pairs"), F.sum("tokens").alias("tokens"), F.sum("leaked_tokens").alias("leaked_tokens"),
        F.sum("multi_turn_values").alias("multi_turn_values"), weighted_rate(scores, "multi_turn_values", "alias_rate").alias("alias_rate"), F.max("p95").alias("worst_p95"),
    )
    return total.withColumn("pair_rate", F.try_divide(F.col("leaked_pairs").cast("double"), F.col("pairs"))).withColumn("token_rate", F.try_divide(F.col("leaked_tokens").cast("double"), F.col("tokens")))


def carried(long_turns: DataFrame, later_turns: DataFrame, truth: DataFrame, protecting: DataFrame) -> DataFrame:
    """Whether the token that protects a value of a long document is still in use in the turns after it.

    long_turns, later_turns: (session, raw, prepared), one long turn a session; truth: (session, entity_type, value);
    protecting: (session, value, placeholder). A row per value that the long turn and a later one name: (session,
    entity_type, value, placeholder, in_long, in_later, carried).
    """
    named = truth.join(long_turns.select("session", F.col("raw").alias("_long"), F.col("prepared").alias("_kept")), "session").filter(F.contains("_long", F.col("value")))
    known = named.join(protecting, ["session", "value"]).filter("placeholder is not null")
    after = known.join(later_turns.select("session", F.col("raw").alias("_later"), F.col("prepared").alias("_out")), "session")
    grouped = after.groupBy("session", "entity_type", "value", "placeholder")
    tests = (F.contains("_later", F.col("value")), F.contains("_kept", F.col("placeholder")), F.contains("_out", F.col("placeholder")))
    out = grouped.agg(*[F.bool_or(t).alias(n) for t, n in zip(tests, ("_again", "in_long", "in_later"), strict=True)])
    return out.filter("_again").drop("_again").withColumn("carried", F.col("in_long") & F.col("in_later"))


def consistency(found: DataFrame) -> DataFrame:
    """Values seen in two turns or more: whether one token stands for them in all. found has placeholder, null where none does."""
    seen = found.groupBy("session", "value").agg(F.count_distinct("turn").alias("turns"), F.count_distinct("placeholder").alias("placeholders"), F.bool_and(F.col("placeholder").isNotNull()).alias("protected"))
    return seen.filter("turns >= 2").withColumn("consistent", F.col("protected") & (F.col("placeholders") == 1))


def percentile(values: Column, q: float) -> Column:
    """The value at index round(q * (n - 1)), ties to even, of an array."""
    n = F.size(values)
    return F.when(n > 0, F.element_at(F.sort_array(values), F.rint(F.lit(q) * (n - 1)).cast("int") + 1))


def percentiles(rows: DataFrame, by: list[str], value: str, qs: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Percentiles by index. Values are counted first, so that a group is as large as its different values."""
    counted = rows.groupBy(*by, value).agg(F.count("*").alias("_n"))
    order = Window.partitionBy(*by).orderBy(value)
    ranked = counted.withColumn("_upto", F.sum("_n").over(order)).withColumn("_all", F.sum("_n").over(Window.partitionBy(*by)))
    at = lambda q: F.min(F.when(F.col("_upto") > F.rint(F.lit(q) * (F.col("_all") - 1)), F.col(value))).alias(f"p{round(q * 100)}")
    return ranked.groupBy(*by).agg(*[at(q) for q in qs])


def nearest_seam(spans: DataFrame, key: str, start: str, step: int, length: str) -> DataFrame:
    """The seam nearest to each position (multiples of step inside the text; of two as near, the first): adds seam and distance."""
    seams = F.greatest(F.lit(1), F.ceil(F.col(length) / step) - 1)
    below = F.greatest(F.lit(1), F.least(seams, F.floor(F.col(start) / step)))
    above = F.least(seams, below + 1)
    near = F.when(F.abs(F.col(start) - below * step) <= F.abs(F.col(start) - above * step), below).otherwise(above) * step
    return spans.withColumn("seam", near.cast("long")).withColumn("distance", F.abs(F.col(start) - near).cast("long"))


def long_rollup(sessions: DataFrame, seams: DataFrame, carried_values: DataFrame, band: int) -> DataFrame:
    """What long documents came to, over all sessions, as one row.

    sessions: (session, chunks_total, chunks_failed), chunks_total null for a session without a long document; seams:
    (session, distance), a row per leak with its distance to the nearest seam; carried_values: (session, carried), as of `carried`.
    Chunks are counted by sessions that have any; the rate of carried tokens is null where none was checked. Counts of one
    row a session are summed up; the median is that of all counts.
    """
    has = F.col("chunks_total").isNotNull()
    per = sessions.agg(
        F.count("*").alias("sessions"),
        F.count_if(F.col("chunks_total") > 1).alias("chunker_activated"),
        F.count_if(F.coalesce(F.col("chunks_failed"), F.lit(0)) > 0).alias("chunks_failed_sessions"),
        F.median(F.when(has, F.col("chunks_total"))).alias("p50_chunks"),
        F.max("chunks_total").alias("max_chunks"),
    )
    near = seams.agg(F.count("*").alias("seam_leaks"), F.count_if(F.col("distance") <= band).alias("seam_leaks_within_overlap"))
    cross = carried_values.agg(F.count("*").alias("cross_path_checked"), F.count_if("carried").alias("cross_path_carried"))
    cross = cross.withColumn("cross_path_rate", F.try_divide(F.col("cross_path_carried").cast("double"), F.col("cross_path_checked")))
    # One row each, met on a key that all share.
    key = F.lit(0).alias("_k")
    return per.select(key, "*").join(near.select(key, "*"), "_k").join(cross.select(key, "*"), "_k").drop("_k")
