"""Exact dedup against a persistent digest index.

The index is a table of SHA-256 digests, bucketed and sorted by digest, in a folder of its own: it outlives the session, and
`DigestIndex` finds it again by its path. A batch is digested and summed up by digest (before any shuffle, so a text that
holds a third of all rows crosses the network as a row a task). Its digests are compared with the index by a sort-merge
anti-join, which reads the index where it lies: only the batch is shuffled. What the index doesn't hold is appended.

The row of a text that stays is written down in the index, and every decision is read from there. Rows then meet the
decisions of their digest: texts that occur once need none; the few texts that hold more than one in HOT rows are
broadcast (there can't be more than HOT of them), the others joined by shuffle, or broadcast as well if they are small.

Only built-in functions are used; no row leaves the JVM.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm.common import BROADCAST_BYTES, checkpoint, release

#: A text with more than total / HOT rows is hot.
HOT = 1000
#: Bytes of a decision in memory: digest, ids, counts and what the row itself takes.
DECISION_BYTES = 160
_FOLDER = re.compile(r"by-(\d+)$")


class DigestIndex:
    """The index at `path`: (digest binary, keep_id long, copies long, batch string), one row a digest.

    buckets: files that a batch is spread over, fixed when the index is made (a later session takes what it finds).
    A bucket should hold what a task can sort: 64 bytes a text, so that 200 buckets serve some thousand millions of texts.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark = spark
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = root.getFileSystem(spark._jsc.hadoopConfiguration())
        held = [_FOLDER.search(s.getPath().getName()) for s in files.listStatus(root)] if files.exists(root) else []
        held = [int(m[1]) for m in held if m]
        self.buckets = held[0] if held else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.path = f"{path.rstrip('/')}/by-{self.buckets}"
        self.name = f"digest_index_{uuid.uuid4().hex}"
        location = self.path.replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT, copies BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{location}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def missing(self, groups: DataFrame) -> DataFrame:
        """The rows of `groups` (with a column digest, each once) whose digest the index doesn't hold."""
        return groups.repartition(self.buckets, "digest").join(self.rows().select("digest").hint("merge"), "digest", "left_anti")

    def append(self, groups: DataFrame, batch: str) -> None:
        """Add what the index doesn't hold of `groups` (digest, keep_id, copies). Doing it again adds nothing, so a batch that broke off can be run again."""
        self.missing(groups).select("digest", "keep_id", "copies", F.lit(batch).alias("batch")).write.insertInto(self.name)

    def close(self) -> None:
        """Forget the table's name; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def digest(column: str = "text"):
    """SHA-256 of a text's UTF-8 bytes as 32 bytes; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"), 256))


def judge(docs: DataFrame, index: DigestIndex, batch: str, keep: tuple[str, ...] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deduplicate a batch against the index and itself, and append it. Adds keep_id, group_size, kept and text_sha256.

    Texts are equal when their bytes are; null counts as empty. If an earlier batch held the text, none of its rows
    is kept and keep_id is the row that stayed then; otherwise the row of the largest id stays (null ids are smallest; of rows that
    share that id any one). group_size: rows of the text in this batch and, where it was known, in the batch that brought it.
    A batch that is run again under its name gets the same answer. keep: columns of `docs` to carry along, all by default;
    those named like an added column are replaced. Any other names may clash with anything. An empty table gives no rows.
    """
    added = ("keep_id", "group_size", "kept", "text_sha256")
    carried = [c for c in (docs.columns if keep is None else keep) if c.lower() not in added]
    given = F.struct(*[F.col(f"`{c}`") for c in carried]) if carried else F.lit(None).cast("int")
    rows = docs.select(given.alias("given"), F.col(id_col).cast("long").alias("id"), digest(text_col).alias("digest"))
    # Numbered once and written down: equal rows are told apart by their number.
    rows = checkpoint(rows.withColumn("row", F.monotonically_increasing_id()))
    most = F.max(F.struct("id", "row"))
    groups = checkpoint(rows.groupBy("digest").agg(most.alias("most"), F.count("*").alias("n")).select("digest", F.col("most.id").alias("keep_id"), F.col("most.row").alias("keep_row"), F.col("n").alias("copies")))
    index.append(groups, batch)
    held = index.rows().select("digest", F.col("keep_id").alias("held_id"), F.col("copies").alias("before"), F.col("batch").alias("of")).hint("merge")
    both = groups.repartition(index.buckets, "digest").join(held, "digest")
    own = F.col("of") == batch
    decided = both.select(
        "digest",
        F.col("held_id").alias("keep_id"),
        F.when(own, F.col("keep_row")).alias("keep_row"),
        (F.col("copies") + F.when(own, 0).otherwise(F.col("before"))).alias("group_size"),
        "copies",
    )
    # A text that occurs once and wasn't known stays; only the others need their decision.
    decided = checkpoint(decided.filter("copies > 1 or keep_row is null"))
    joined = _decide(rows, decided)
    release(groups)
    alone = F.col("group_size").isNull()
    keep_id = F.when(alone, F.col("id")).otherwise(F.col("keep_id"))
    kept = alone | F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False))
    columns = [F.col(f"given.`{c}`").alias(c) for c in carried]
    size = F.coalesce("group_size", F.lit(1).cast("long"))
    return joined.select(*columns, keep_id.alias("keep_id"), size.alias("group_size"), kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def _decide(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """Each of `rows` with the decision on its digest, if there is one."""
    decisions = decided.select("digest", "keep_id", "keep_row", "group_size")
    if DECISION_BYTES * decided.count() <= BROADCAST_BYTES:
        return rows.join(F.broadcast(decisions), "digest", "left")
    many = decided.filter(F.col("copies") > rows.count() // HOT).select("digest")  # HOT digests at most
    hot = decisions.join(F.broadcast(many), "digest", "left_semi")
    cold = decisions.join(F.broadcast(many), "digest", "left_anti")
    return rows.join(F.broadcast(hot), "digest").unionByName(rows.join(F.broadcast(many), "digest", "left_anti").join(cold, "digest", "left"))


def dedup(docs: DataFrame, index: DigestIndex, batch: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of a batch that stay, with the columns they had; see `judge`."""
    judged = judge(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), F.col(id_col).alias("id"), F.col(text_col).alias("text")), index, batch, ("whole",), "id")
    return judged.filter("kept").select(*[F.col(f"whole.`{c}`").alias(c) for c in docs.columns])
