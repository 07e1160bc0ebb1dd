"""Line search over texts: matches, counts, context and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lines(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Lines of each text, numbered from 1."""
    return docs.select(key, F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def grep(docs: DataFrame, key: str, pattern: str, text: str = "text") -> DataFrame:
    """Matching lines. Texts without a match are dropped before they are split."""
    return lines(docs.filter(F.col(text).rlike(f"(?m){pattern}")), key, text).filter(F.col("line").rlike(pattern))


def grep_count(docs: DataFrame, key: str, pattern: str, text: str = "text") -> DataFrame:
    return grep(docs, key, pattern, text).groupBy(key).agg(F.count("*").alias("matches"))


def context(docs: DataFrame, key: str, pattern: str, before: int, after: int, text: str = "text") -> DataFrame:
    """Matching lines with those around them; a line near several matches comes once."""
    near = Window.partitionBy(key).orderBy("line_no").rowsBetween(-after, before)
    hit = F.col("line").rlike(pattern)
    df = lines(docs.filter(F.col(text).rlike(f"(?m){pattern}")), key, text).withColumn("is_match", hit)
    return df.withColumn("_near", F.max("is_match").over(near)).filter("_near").drop("_near")


def within_budget(rows: DataFrame, order: list[str], key: str, text: str, limit: int) -> DataFrame:
    """The first rows of each key whose texts stay within a budget of characters."""
    running = F.sum(F.length(text) + 1).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_running", running).filter(F.col("_running") <= limit).drop("_running")
