"""Approximate nearest neighbours by cosine: vantage-point trees, one per shard.

Vectors are spread over shards by a hash of their id, so no shard is hot. Each shard builds one tree over its different
unit vectors, by Euclidean distance, which orders as cosine does: a node splits its points at the median distance to a
vantage point. A search of radius r skips a side whose nearest possible point lies beyond r / factor by the triangle
inequality; factor 1 is exact, larger factors skip more. Blocks of queries meet every shard, and each query's best of all
shards are ranked by the exact cosine in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hushframe.llm.common import checkpoint


class Tree:
    """Vantage-point tree over unit vectors `points`; a leaf holds up to `leaf` of them."""

    def __init__(self, points: np.ndarray, leaf: int = 256, seed: int = 11):
        self.points, self.leaf, self.dice = points, leaf, np.random.default_rng(seed)
        self.root = self._build(np.arange(len(points)))

    def _build(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        pivot = self.points[rows[self.dice.integers(len(rows))]]
        far = _distance(self.points[rows], pivot[None])[:, 0]
        cut = np.partition(far, len(rows) // 2)[len(rows) // 2]
        inside = far < cut
        if not inside.any():  # all at one distance
            return rows
        return pivot, float(cut), self._build(rows[inside]), self._build(rows[~inside])

    def search(self, queries: np.ndarray, k: int, factor: float = 1.0) -> list[np.ndarray]:
        """For each unit query the rows of at least its k nearest points (all that may tie), as far as the pruning is exact."""
        best = np.full((len(queries), k), np.inf)
        found: list[list[np.ndarray]] = [[] for _ in queries]
        slack = 1e-9

        def visit(node, who: np.ndarray) -> None:
            if not len(who):
                return
            if isinstance(node, np.ndarray):
                d = _distance(queries[who], self.points[node])
                both = np.concatenate([best[who], d], axis=1)
                best[who] = np.partition(both, k - 1, axis=1)[:, :k]
                near = d <= best[who].max(axis=1, keepdims=True) + slack
                for i, q in enumerate(who.tolist()):
                    if near[i].any():
                        found[q].append(np.stack([node[near[i]], d[i, near[i]]]))
                return
            pivot, cut, inner, outer = node
            d = _distance(queries[who], pivot[None])[:, 0]
            inside = d < cut
            visit(inner, who[inside])
            visit(outer, who[~inside])
            reach = (best[who].max(axis=1) + slack) / factor
            visit(outer, who[inside & (cut - d <= reach)])
            visit(inner, who[~inside & (d - cut <= reach)])

        visit(self.root, np.arange(len(queries)))
        out = []
        for q, parts in enumerate(found):
            both = np.concatenate(parts, axis=1) if parts else np.zeros((2, 0))
            out.append(both[0, both[1] <= best[q].max() + slack].astype(np.int64))
        return out


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows by a power of two each, so that squares neither overflow nor vanish: only exponents change, so a cosine stays the same to the last bit."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    dots = lambda x, y: np.einsum("ij,ij->i", x, y)
    return dots(a, b) / (np.sqrt(dots(a, a)) * np.sqrt(dots(b, b)))


def vectors(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v, dim) of the rows that take part: an id, and a vector that isn't null or zero and has only finite components."""
    v = F.col(embedding).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    df = df.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null")
    return df.filter(finite).filter(F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))


def nearest(df: DataFrame, is_query, k: int = 5, factor: float = 1.0, shard_rows: int = 4096, block: int = 512, tree_blocks: int = 64, leaf: int = 256, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The k nearest rows of each query row by cosine: (query_id, rank, vec_id, score), ties to the smaller vec_id.

    is_query: a condition over vec_id. Candidates are all rows but those with the query's own id; vectors of other lengths
    are not compared. Rows that repeat an id count as one with its best vector. Fewer than k candidates: all. An empty table or one
    without queries gives no rows; other columns are ignored. factor: pruning as of the module, 1 exact. tree_blocks: blocks
    of queries that a tree serves; each further tree_blocks * block queries cost one more building of every tree. Rows left
    out (nulls among them): see `vectors`.
    """
    base = checkpoint(vectors(df, vec_id, embedding))
    n = base.count()
    shards = max(1, -(-n // shard_rows))
    queries = base.filter(is_query)
    blocks = max(1, -(-queries.count() // block))
    held = base.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    asked = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int"))
    # A block of queries, packed in one row, meets each shard; a shard's tree serves a group of blocks.
    packed = asked.groupBy("dim", "block").agg(F.collect_list(F.struct("vec_id", "v")).alias("q"))
    groups = -(-blocks // tree_blocks)
    left = held.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = packed.withColumn("part", F.pmod("block", F.lit(groups)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def search(key, points: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if len(points) and len(asked):
            ids, x = points["vec_id"].to_numpy(), _matrix(points["v"].combine_chunks())
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], x[order]
            _, first, inverse = np.unique(x, axis=0, return_index=True, return_inverse=True)
            inverse = inverse.reshape(-1)
            # Of equal vectors only the k+1 smallest ids can be among a query's k nearest.
            members: list[list[int]] = [[] for _ in first]
            for i, c in zip(ids.tolist(), inverse.tolist(), strict=True):
                if len(members[c]) <= k and (not members[c] or members[c][-1] != i):
                    members[c].append(i)
            own = _scaled(x[first])
            unit = own / np.linalg.norm(own, axis=1, keepdims=True)
            tree = Tree(unit, leaf)
            for q in asked["q"].chunks:
                items = q.flatten()
                qid, qx = items.field("vec_id").to_numpy(), _scaled(_matrix(items.field("v")))
                for start in range(0, len(qid), block):
                    part = qx[start : start + block]
                    # one more, as the query itself may be among them
                    for i, rows in enumerate(tree.search(part / np.linalg.norm(part, axis=1, keepdims=True), k + 1, factor)):
                        score = _cosine(np.broadcast_to(part[i], (len(rows), part.shape[1])), own[rows])
                        pairs = sorted((-s, m) for s, r in zip(score.tolist(), rows.tolist(), strict=True) for m in members[r] if m != qid[start + i])
                        out.extend((int(qid[start + i]), m, -s) for s, m in pairs[:k])
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=["query_id", "vec_id", "score"])

    near = left.groupBy("dim", "shard", "part").cogroup(right.select("dim", "shard", "part", "q").groupBy("dim", "shard", "part")).applyInArrow(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    near = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
