import numpy as np
import pytest
from pyspark.sql import functions as F

from hushframe.llm import ann


def rows_of(n=700, dim=12, seed=1):
    dice = np.random.default_rng(seed)
    x = dice.normal(size=(n, dim)).astype(np.float32)
    x[100:300] = x[5]  # many equal vectors
    x[7] = 2 * x[5]
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    rows += [(700, None), (750, [0.0] * dim), (800, [float("nan")] * dim), (850, [None] * dim), (900, [1e300] * dim), (950, [float("inf")] * dim), (None, [1.0] * dim), (1000, [1.0, 2.0]), (1001, [2.0, 4.0])]
    return rows


def brute(rows, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {}
    for i, v in good:
        if i % 50 == 0:
            v = v / np.abs(v).max()
            near = sorted((-round(float(v @ (w / np.abs(w).max()) / np.sqrt(v @ v) / np.sqrt((w / np.abs(w).max()) @ (w / np.abs(w).max()))), 12), j) for j, w in good if j != i and len(w) == len(v))
            out[i] = [(j, -s) for s, j in near[:k]]
    return out


def test_exact_search_matches_brute_force(spark):
    rows = rows_of()
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0, k=5, shard_rows=150, block=4, leaf=16).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 12)))
        assert r["rank"] == len(got[r.query_id])
    want = brute(rows, 5)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=1e-9)


def test_relaxed_pruning_keeps_recall():
    dice = np.random.default_rng(3)
    centres = dice.normal(size=(40, 16))
    x = (centres[dice.integers(40, size=3000)] + 0.2 * dice.normal(size=(3000, 16)))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    queries, tree = x[::60], ann.Tree(x, 64)
    true = [set(np.argsort(-(x @ q))[:5].tolist()) for q in queries]
    recall = lambda factor: np.mean([len(true[i] & set(r.tolist())) / 5 for i, r in enumerate(tree.search(queries, 5, factor))])
    assert recall(1.0) == 1.0 and recall(1.5) >= 0.9


def test_no_rows(spark):
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).count() == 0


def test_relaxed_search_of_the_table_keeps_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    found = {}
    for factor in (1.0, 1.1):
        for r in ann.nearest(df, F.col("vec_id") % 50 == 0, k=5, factor=factor, leaf=32).collect():
            found.setdefault((factor, r.query_id), set()).add(r.vec_id)
    queries = {q for f, q in found if f == 1.0}
    recall = sum(len(found[1.0, q] & found.get((1.1, q), set())) for q in queries) / sum(len(found[1.0, q]) for q in queries)
    assert queries and recall >= 0.9


def test_repeated_ids_and_ties(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [2.0, 0.0]), (2, [4.0, 0.0]), (3, [3.0, 4.0])]
    out = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, k=5).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in out] == [(1, 1.0), (2, 1.0), (3, 0.6)]
