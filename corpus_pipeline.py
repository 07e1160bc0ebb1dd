"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, packing, each over all that the one before kept.

Every stage takes the columns of documents, whichever of them are null, and texts of any length as a whole; further columns
of its input are left out, so their names can't clash. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm import linededup, minhash, mixing, packing, quality
from hushframe.llm.common import release, settled, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the threshold table keep. A text is judged by itself: a null or empty one goes, repeated rows fare alike, a count right at a bound holds."""
    return quality.judge(docs.select(*COLUMNS)).filter("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the passages that occurred before; n_chars follows the text. One that lost lines and is left without a word goes.

    Of equal passages that of the smallest doc_id stays (null ids last, then by hash of the text); rows equal in doc_id and
    text don't delete one another's; a null text stays.
    """
    cleaned = linededup.dedup(docs.select(*COLUMNS))
    changed = F.size("removed") > 0
    cleaned = cleaned.filter(~changed | F.col("kept_text").rlike(r"[^\x20\x09-\x0D]"))
    return cleaned.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest doc_id. Nulls, ties, repeated rows: see `minhash.keep_one`."""
    return minhash.keep_one(docs.select(*COLUMNS), k=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by weights 5, 2, 1: each document as often as it is taken. Null sources are one source, the last; ties are decided by a fixed seed, repeated rows taken each for itself."""
    return mixing.mix(docs.select(*COLUMNS), weights=(5, 2, 1), cap=3.0, share=1.0)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 ids: a row per piece. A null text is empty and packs its end mark alone; repeated rows are packed each."""
    packed = packing.pack(docs.select("doc_id", "text"), capacity=1024)
    return packed.select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "sequence_tokens", F.crc32("ids").alias("ids_crc32"))


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near dedup", near_dedup), ("mixing", mix_sources), ("packing", pack)]
#: SQL can't sample by the cube method or tokenise; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over documents; between two stages the rows are checkpointed, as they would be written and reread."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        before = docs
        docs = stage(spark, docs, sf_dir) if i + 1 == len(STAGES) else settled(lambda: stage(spark, before, sf_dir))  # noqa: B023  called at once
        if 0 < i < len(STAGES) - 1:
            release(before)
    return docs
