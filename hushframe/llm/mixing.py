"""Mixing sources to target weights by cube-method balanced sampling.

Every source gets a target number of words. A document of a source is taken floor(target / source size) times for certain
and once more with the fractional rest as its inclusion probability. The flight phase moves the probabilities of three
undecided documents at a time along the null space of the two balancing constraints (documents and words) until one of
them is 0 or 1, so both totals stay as expected. It runs in blocks of one source; what at most two documents of each block
leave undecided goes to the next, far smaller round, until each source has one block left. A giant among small documents can't
move without leaving the balance, so it is undecided to the end; the landing rounds what is left, and then trades documents of
that last block, one or two at a time, until its words are as near to those expected as such trades can bring them.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hushframe.llm.common import BROADCAST_BYTES, checkpoint, free_name, marks, numbered

WORD = r"[^\x20\x09-\x0D]+"
#: With at most so many sources (some MB), their table is broadcast; above, it is joined by shuffle.
BROADCAST_SOURCES = 100_000
#: So many documents have few enough choices to look at all of them.
FEW = 16


def flight(sizes: list[int], chance: list[float], seed: str, landing: bool, eps: float = 1e-9) -> list[float]:
    """Cube method over one block: each chance becomes 0 or 1, but for up to two that stay between when not landing."""
    dice, out, waiting, nxt = random.Random(seed), list(chance), [], 0
    while True:
        while len(waiting) < 3 and nxt < len(out):
            if eps < out[nxt] < 1 - eps:
                waiting.append(nxt)
            else:
                out[nxt] = round(out[nxt])
            nxt += 1
        if len(waiting) < 3:
            break
        a, b, c = (sizes[i] for i in waiting)
        u = (c - b, a - c, b - a)
        if not any(u):  # equal sizes: any two may trade
            u = (1, -1, 0)
        up = min((1 - out[i]) / d if d > 0 else out[i] / -d for i, d in zip(waiting, u, strict=True) if d)
        down = min(out[i] / d if d > 0 else (1 - out[i]) / -d for i, d in zip(waiting, u, strict=True) if d)
        step = up if dice.random() * (up + down) < down else -down
        for i, d in zip(waiting, u, strict=True):
            out[i] = min(1.0, max(0.0, out[i] + step * d))
            if out[i] < eps or out[i] > 1 - eps:
                out[i] = float(round(out[i]))
        left = [i for i in waiting if 0 < out[i] < 1]
        if len(left) == 3:  # rounding kept the one that should have settled: settle the nearest
            k = min(left, key=lambda i: min(out[i], 1 - out[i]))
            out[k] = float(round(out[k]))
            left.remove(k)
        waiting = left
    if landing:
        want = float(np.dot(sizes, chance))
        picks = [[(n >> k) & 1 for k in range(len(waiting))] for n in range(1 << len(waiting))]
        held = sum(x * n for i, (x, n) in enumerate(zip(out, sizes, strict=True)) if i not in waiting)
        best = min(picks, key=lambda pick: (abs(held + sum(x * sizes[i] for x, i in zip(pick, waiting, strict=True)) - want), pick))
        for i, x in zip(waiting, best, strict=True):
            out[i] = float(x)
        out = land(sizes, out, want)
    return out


def land(sizes: list[int], taken: list[float], want: float, near: float = 1e-3) -> list[float]:
    """Trade documents in and out, one or two at a time, each time those that bring the words taken nearest to `want`.

    It ends within `near` of `want` (a part of it), or where no trade helps any more. Ties go to the first documents. If
    trades of two leave more than that and there are FEW documents at most, the nearest of all choices is taken instead.
    """
    n, x = np.array(sizes, np.float64), np.array(taken)
    traded = _trade(n, x.copy(), want, near)
    if abs(want - float(n @ traded)) <= near * want or len(n) > FEW:
        return traded.tolist()
    sums = np.zeros(1)
    for size in n:
        sums = np.concatenate([sums, sums + size])  # document k is in the choices whose number has bit k
    far = np.abs(sums - want)
    nearest = np.flatnonzero(far <= far.min() + 1e-9)
    own = sum(1 << k for k in range(len(n)) if x[k])
    choice = min(nearest.tolist(), key=lambda c: ((c ^ own).bit_count(), c))
    return [float(choice >> k & 1) for k in range(len(n))]


def _trade(n: np.ndarray, x: np.ndarray, want: float, near: float) -> np.ndarray:
    while True:
        missing = want - float(n @ x)
        change = np.where(x == 0, n, -n)
        if abs(missing) <= near * want or not len(n):
            return x
        one = np.abs(missing - change)
        two = np.abs(missing - change[:, None] - change[None, :])
        np.fill_diagonal(two, one)  # a document traded with itself is one traded alone
        i, j = divmod(int(two.argmin()), len(n))
        if two[i, j] >= abs(missing) - 1e-6:
            return x
        for k in {i, j}:
            x[k] = 1 - x[k]


def targets(sizes: DataFrame, weights: tuple[int, ...], cap: float, share: float) -> DataFrame:
    """Targets of sources from `sizes(source, source_size, ...)`: by weight, none above cap times its size, the excess reshared.

    Sources take the weights in turn, in code point order, null last. The table has a row per source, so its windows are small.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)
    df = sizes.withColumn("weight", weight).withColumn("ceiling", F.col("source_size") * F.lit(float(cap)))
    fill = Window.orderBy(F.col("ceiling") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    below = F.coalesce(F.sum("ceiling").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing))
    df = df.withColumn("level", (F.sum("source_size").over(everything) * F.lit(float(share)) - below) / rest)
    # The water level is that of the first source, in filling order, that it doesn't lift above its ceiling.
    fits = F.col("level") * F.col("weight") <= F.col("ceiling")
    level = F.min(F.when(fits, F.struct(F.col("ceiling") / F.col("weight"), F.col("source").isNull(), F.col("source"), F.col("level").alias("level")))).over(everything)["level"]
    df = df.withColumn("water", level)
    return df.withColumn("target", F.coalesce(F.least("ceiling", F.col("water") * F.col("weight")), F.col("ceiling"))).drop("ceiling", "level", "water", "weight")


def _fly(block: int, seed: int):
    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("doc_id", "ascending"), ("mark", "ascending")])
        sizes, chance = rows["size"].to_pylist(), rows["chance"].to_pylist()
        where = f"{seed}|{rows['source'][0].as_py()}|{rows['block'][0].as_py()}|{rows['level'][0].as_py()}"
        new = flight(sizes, chance, where, rows["blocks"][0].as_py() <= 1)
        return rows.set_column(rows.schema.get_field_index("chance"), "chance", pa.array(new, pa.float64()))

    return run


def copies(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: float = 3.0, share: float = 1.0, block: int = 512, seed: int = 7, source: str = "source", text: str = "text") -> DataFrame:
    """How often each document goes into the mix: (doc_id, source, mark, m2, n_rows, size, source_size, target, whole, extra).

    size: words of the text (null: 0), of texts of any length. mark, m2: hashes of the text; rows equal in doc_id, source and
    text are one unit of n_rows rows. Each row is taken `whole` times, and `extra` of the unit's rows once more: the whole
    part of their expected number for certain, one row by the cube method for the rest. Source and text may be null, and so
    may doc_id; equal sizes are ties that the seed decides. share: words of the mix as a part of all words. A source of size
    0 and documents without words take no words. An empty table gives no rows; other columns are ignored. Reruns agree:
    decisions depend on the rows alone, not on their order or partitions. No row is taken more than cap times (rounded up).
    """
    m1, m2 = marks(text)
    keys = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), m1.alias("mark"), m2, F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    units = checkpoint(keys.groupBy("doc_id", "source", "mark", "m2").agg(F.count("*").alias("n_rows"), F.max("size").alias("size")))
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n_rows")).alias("source_size"))
    goals = checkpoint(targets(sizes, weights, cap, share))
    small = goals.count() <= BROADCAST_SOURCES

    def with_goals(df: DataFrame, right: DataFrame) -> DataFrame:
        right = right.withColumnRenamed("source", "_source")
        return df.join(F.broadcast(right) if small else right, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")

    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    df = with_goals(units, goals).withColumn("rate", rate).withColumn("whole", F.floor("rate").cast("long"))
    # Of a unit's rows the whole part of the expected number is certain, so at most one row is drawn.
    more = (F.col("rate") - F.col("whole")) * F.col("n_rows")
    df = df.withColumn("sure", F.floor(more + 1e-9).cast("long")).withColumn("chance", F.greatest(F.lit(0.0), more - F.col("sure"))).drop("rate")
    keep = ["doc_id", "source", "mark", "m2", "n_rows", "size", "source_size", "target", "whole", "sure", "chance"]
    out = ["doc_id", "source", "mark", "m2", "n_rows", "size", "source_size", "target", "whole", "extra"]
    open_, done = df.filter("chance > 1e-9 and size > 0").select(keep), [df.filter("chance <= 1e-9 or size = 0").withColumn("extra", F.col("sure")).select(out)]
    schema = "doc_id long, source string, mark long, m2 long, n_rows long, size long, source_size long, target double, whole long, sure long, chance double, n_open long, blocks long, block long, level long"
    level = 0
    while True:
        counts = open_.groupBy("source").agg(F.count("*").alias("n_open"))
        dealt = with_goals(open_, checkpoint(counts)).withColumn("blocks", F.ceil(F.col("n_open") / F.lit(block)).cast("long"))
        dealt = dealt.withColumn("block", F.pmod(F.xxhash64("doc_id", "mark", F.lit(level)), F.col("blocks"))).withColumn("level", F.lit(level).cast("long"))
        flown = checkpoint(dealt.groupBy("source", "block").applyInArrow(_fly(block, seed), schema))
        done.append(flown.filter("chance = 0 or chance = 1").withColumn("extra", F.col("sure") + F.col("chance").cast("long")).select(out))
        open_ = flown.filter("chance > 0 and chance < 1").select(keep)
        if open_.isEmpty():
            break
        level += 1
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    return result


def rows_taken(units: DataFrame) -> DataFrame:
    """`copies` with a row per row of the documents: adds taken, how often that row is taken."""
    rows = numbered(units, "n_rows", "_row")
    return rows.withColumn("taken", F.col("whole") + (F.col("_row") < F.col("extra")).cast("long")).drop("_row")


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed rows: `docs` with each row as often as `copies` says, all columns as they were.

    Rows of one unit that differ in another column: the unit's rows are taken alike, those to be taken once more are the
    first in the order of all their columns' hash. A decision is a few numbers; texts are shuffled to meet them only if there are too many to broadcast.
    """
    source, text = how.get("source", "source"), how.get("text", "text")
    picks = checkpoint(copies(docs, **how).filter("whole > 0 or extra > 0"))
    doc, src, one, two, n, whole, extra, copy = names = [free_name(docs, x) for x in ("_doc", "_src", "_one", "_two", "_rows", "_whole", "_extra", "_copy")]
    right = picks.select("doc_id", "source", "mark", "m2", "n_rows", "whole", "extra").toDF(*names[:-1])
    if picks.count() * 96 <= BROADCAST_BYTES:
        right = F.broadcast(right)
    m1, m2 = marks(text)
    on = docs["doc_id"].cast("long").eqNullSafe(F.col(doc)) & docs[source].cast("string").eqNullSafe(F.col(src)) & (m1 == F.col(one)) & (m2 == F.col(two))
    joined = docs.join(right, on)
    # Rows that all fare alike need no order among them.
    alike = (F.col(extra) == 0) | (F.col(extra) == F.col(n))
    plain = joined.filter(alike).withColumn(copy, F.col(whole) + (F.col(extra) > 0).cast("long"))
    # Equal rows of one unit are counted, so that a group of copies, however large, is a row for each different one of them.
    mixed = joined.filter(~alike)
    counted = mixed.groupBy(*docs.columns, doc, src, one, two, whole, extra).agg(F.count("*").alias(n))
    order = Window.partitionBy(doc, src, one, two).orderBy(F.xxhash64(*docs.columns)).rowsBetween(Window.unboundedPreceding, -1)
    upto = F.coalesce(F.sum(n).over(order), F.lit(0))
    counted = counted.withColumn(extra, F.greatest(F.lit(0).cast("long"), F.least(F.col(n), F.col(extra) - upto)))
    some = counted.withColumn(copy, F.col(whole) * F.col(n) + F.col(extra))
    every = plain.select(*docs.columns, copy).unionByName(some.select(*docs.columns, copy))
    return numbered(every, copy, free_name(every, "_nth")).select(*docs.columns)
