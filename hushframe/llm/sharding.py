"""Sharding by extendible hashing: a directory over hash-prefix bits, in which only oversized buckets split further.

Buckets are the leaves of a binary tree over the leading bits of a row's hash. A pass counts bytes by cells of some more
bits of those rows alone whose bucket is still too large; within the pass every cell goes to its shallowest prefix that
fits, so all splits of that many bits take one aggregation. Passes repeat until every shard fits. The directory has an
entry for each value of the first `global depth` bits, as many as the deepest bucket needs; a bucket of fewer bits stands
under several entries in a row, which `directory` gives as a range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hushframe.llm.common import checkpoint, numbered

#: Bits that one pass may add; its directory has at most 2^BITS cells for each bucket that is still too large.
BITS = 10
HASH_BITS = 60


def prefix(h, bits):
    """The leading `bits` of a hash of HASH_BITS bits."""
    return F.call_function("shiftrightunsigned", h, (F.lit(HASH_BITS) - bits).cast("int"))


def shard(docs: DataFrame, limit_bytes: int, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """Assign rows to shards of at most limit_bytes of text: (doc_id, bytes, hash, depth, bucket, piece, shard).

    depth and bucket: number and value of the hash bits that name the bucket (the directory entry); shard: their string, as
    '3:5', with '/piece' where one hash holds more than the limit (repeated rows, which no bit tells apart): those are cut
    by running bytes. A single text above the limit is a shard of its own. A null text has 0 bytes; the hash is of
    doc_id (which may be null) and text, so no hot key exists but repeated rows, and texts of any length go as a whole. Reruns
    agree: a row's shard depends on the rows alone. Other columns are ignored; an empty table gives no rows.
    """
    mask = F.lit((1 << HASH_BITS) - 1)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("bytes"), F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string")).bitwiseAND(mask).alias("hash"))
    rows = checkpoint(rows)
    done, open_, depth = [], rows.withColumn("depth", F.lit(0)), 0
    while True:
        step = min(bits, HASH_BITS - depth)
        # Bytes of the finest cells of this pass, then of every shorter prefix of them.
        cells = open_.groupBy(prefix(F.col("hash"), F.lit(depth + step)).alias("cell")).agg(F.sum("bytes").alias("bytes"))
        levels = cells.withColumn("d", F.explode(F.sequence(F.lit(depth), F.lit(depth + step)))).withColumn("p", F.expr(f"shiftrightunsigned(cell, {depth + step} - d)"))
        sums = levels.groupBy("d", "p").agg(F.sum("bytes").alias("held"))
        fits = levels.join(sums.filter(F.col("held") <= limit_bytes), ["d", "p"])
        leaf = fits.groupBy("cell").agg(F.min("d").alias("leaf"))
        known = open_.withColumn("cell", prefix(F.col("hash"), F.lit(depth + step))).join(checkpoint(leaf), "cell", "left")
        known = checkpoint(known)
        settled = known.filter("leaf is not null").withColumn("depth", F.col("leaf"))
        done.append(settled.withColumn("piece", F.lit(None).cast("long")).select("doc_id", "bytes", "hash", "depth", "piece"))
        open_, depth = known.filter("leaf is null").select("doc_id", "bytes", "hash", "depth"), depth + step
        if open_.isEmpty():
            break
        if depth == HASH_BITS:
            done.append(_pieces(open_, limit_bytes))
            break
        # A hash whose rows alone exceed the limit can't be split by bits.
        alone = checkpoint(open_.groupBy("hash").agg(F.sum("bytes").alias("held")).filter(F.col("held") > limit_bytes).select("hash"))
        if not alone.isEmpty():
            done.append(_pieces(open_.join(alone, "hash", "left_semi"), limit_bytes))
            open_ = checkpoint(open_.join(alone, "hash", "left_anti"))
            if open_.isEmpty():
                break
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    out = out.withColumn("depth", F.col("depth").cast("int")).withColumn("bucket", F.expr(f"shiftrightunsigned(hash, {HASH_BITS} - depth)"))
    name = F.concat_ws(":", F.col("depth").cast("string"), F.col("bucket").cast("string"))
    return out.withColumn("shard", F.when(F.col("piece").isNull(), name).otherwise(F.concat_ws("/", name, F.col("piece").cast("string")))).select("doc_id", "bytes", "hash", "depth", "bucket", "piece", "shard")


def _pieces(rows: DataFrame, limit_bytes: int) -> DataFrame:
    """Rows of one hash are copies of one size: as many to a piece as fit, at least one.

    Equal rows are counted and written out again by number, so that no task has to hold all copies and every run cuts alike.
    """
    groups = rows.groupBy("hash", "doc_id", "bytes").agg(F.count("*").alias("n"))
    each = F.greatest(F.lit(1), F.floor(F.lit(limit_bytes) / F.greatest(F.col("bytes"), F.lit(1)))).cast("long")
    groups = groups.withColumn("each", each).withColumn("pieces", F.ceil(F.col("n") / F.col("each")).cast("long"))
    # Different rows of one hash (a collision of HASH_BITS bits) number their pieces one after the other.
    order = Window.partitionBy("hash").orderBy("doc_id", "bytes").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("from", F.coalesce(F.sum("pieces").over(order), F.lit(0)))
    placed = numbered(groups, "n", "i").withColumn("piece", F.col("from") + F.floor(F.col("i") / F.col("each")).cast("long"))
    return placed.withColumn("depth", F.lit(HASH_BITS)).select("doc_id", "bytes", "hash", "depth", "piece")


def directory(assigned: DataFrame) -> DataFrame:
    """The directory of rows that `shard` assigned: a row per shard, with the range of entries that point to it.

    (global_depth, first_entry, last_entry, depth, bucket, piece, shard, n_rows, bytes). Entries are numbers of global_depth
    bits, the depth of the deepest bucket. Ranges of different buckets don't overlap; together they leave out only entries
    without rows. Pieces of one hash are no buckets: they are the overflow of the entry that the hash falls under.
    """
    shards = checkpoint(assigned.groupBy("depth", "bucket", "piece", "shard").agg(F.count("*").alias("n_rows"), F.sum("bytes").alias("bytes")))
    deepest = shards.filter("piece is null").agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    own = F.expr(f"shiftleft(bucket, {deepest} - depth)")
    over = prefix(F.col("bucket"), F.lit(deepest))
    first = F.when(F.col("piece").isNull(), own).otherwise(over)
    last = F.when(F.col("piece").isNull(), own + F.expr(f"shiftleft(1L, {deepest} - depth)") - 1).otherwise(over)
    return shards.select(F.lit(deepest).alias("global_depth"), first.alias("first_entry"), last.alias("last_entry"), "depth", "bucket", "piece", "shard", "n_rows", "bytes")
