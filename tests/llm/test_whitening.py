import math
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest

from hushframe.llm import queries, whitening


def brute(vectors, components=16):
    """Of equally long vectors: for each, its deviation, whitened entries, and explained parts; all from exact sums."""
    xs = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    fit = sorted({tuple(x) for x in xs})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[i] for x in fit) for i in range(d)]
    centred = np.array([[float(Fraction(x[i] * n - sums[i], n)) for i in range(d)] for x in fit])
    covariance = centred.T @ centred / n
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    out = []
    for x in xs:
        z = np.array([float(Fraction(x[i] * n - sums[i], n)) for i in range(d)])
        out.append((n, sum((n * x[i] - sums[i]) ** 2 for i in range(d)), z @ axes / np.sqrt(values), values / np.trace(covariance)))
    return out


def check(got, want, tolerance=1e-7):
    """got: rows by key; want: by key as of brute. A component may have either sign, the same for all."""
    signs: dict = {}
    for key, (n, deviation, white, explained) in want.items():
        rows = sorted(got[key], key=lambda r: r.component)
        assert [r.component for r in rows] == list(range(1, len(white) + 1))
        for r, w, e in zip(rows, white, explained, strict=True):
            assert (r.n, r.deviation) == (n, deviation)
            assert r.explained == pytest.approx(e, rel=1e-9)
            sign = signs.setdefault(r.component, 1 if r.whitened * w >= 0 else -1) if abs(w) > 1e-3 else signs.get(r.component, 1)
            assert r.whitened * sign == pytest.approx(w, abs=tolerance)
            assert 0 <= r.identity_error < 1e-8


def by_key(rows, key="vec_id"):
    out: dict = {}
    for r in rows:
        out.setdefault(r[key], []).append(r)
    return out


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_query_matches_brute_force(spark, folder):
    rows = pq.read_table(f"/root/testdata/{folder}/embeddings.parquet").to_pylist()
    got = by_key(queries.op11_whitening(spark, f"/root/testdata/{folder}").collect())
    assert len(got) == len(rows)
    check(got, dict(zip([r["vec_id"] for r in rows], brute([r["embedding"] for r in rows]), strict=True)))


def test_copies_count_once_and_every_row_is_returned(spark):
    dice = np.random.default_rng(3)
    x = dice.normal(size=(60, 5))
    x[:, 0] *= 9
    vectors = [*x.tolist(), *[x[7].tolist()] * 200]
    df = spark.createDataFrame([(i if i % 9 else None, i, v, "x") for i, v in enumerate(vectors)], "vec_id long, row int, embedding array<double>, N string").repartition(7)
    got = by_key(whitening.whiten(df, keep=("vec_id", "row", "N")).withColumnRenamed("n", "n").collect(), "row")
    assert len(got) == 260 and {len(v) for v in got.values()} == {5}
    check(got, dict(enumerate(brute(vectors))))


def test_the_shift_rounds_nothing_away(spark):
    # entries far from zero that differ little: a mean rounded to a double near 1e15 would show
    dice = np.random.default_rng(4)
    vectors = (dice.integers(-40, 40, (300, 4)) / 64 + np.array([2.0**40, -(2.0**40), 0, 1e3])).tolist()
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    check(by_key(whitening.whiten(df).collect()), dict(enumerate(brute(vectors))))


def test_rows_that_take_no_part_and_flat_directions(spark):
    rows = [(0, None), (1, []), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [1e300, 1.0]), (6, [1.0, 2.0]), (7, [1.0, 4.0]), (8, [1.0, 4.0]), (None, [1.0, 3.0]), (9, [5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = by_key(whitening.whiten(df).collect())
    assert set(got) == {6, 7, 8, None, 9}
    for key, want in ((6, -math.sqrt(1.5)), (7, math.sqrt(1.5)), (8, math.sqrt(1.5)), (None, 0.0)):
        one, two = sorted(got[key], key=lambda r: r.component)
        assert one.whitened == pytest.approx(want, abs=1e-12) and one.explained == pytest.approx(1) and one.n == 3 and one.identity_error < 1e-12
        assert two.whitened is None and two.explained == pytest.approx(0)
    # a length of its own with a single vector: nothing varies
    assert [tuple(r) for r in got[9]] == [(9, 1, 1, 0, None, None, None)]
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.filter("vec_id < 6")).count() == 0


def test_sums_and_deviations_beyond_a_long(spark):
    big = 2.0**54
    vectors = [[big, -big], [-big, big], [big, big], [0.0, 1.0]]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    got = by_key(whitening.whiten(df).collect())
    want = brute(vectors)
    for i, (_, deviation, white, _) in enumerate(want):
        for r in got[i]:
            assert r.deviation == (deviation if deviation < 1 << 63 else None)
            assert abs(r.whitened) == pytest.approx(abs(white[r.component - 1]), rel=1e-6, abs=1e-6)


def test_exact_sums_do_not_overflow():
    x = np.full((5, 2), (1 << 61) + 3, np.int64)
    n, total = whitening._exact_sums(x)
    assert n == 5 and total.tolist() == [5 * ((1 << 61) + 3)] * 2


def test_floats_and_whole_numbers_serve_alike(spark):
    rows = [(i, [i % 3, i * i % 7]) for i in range(20)]
    a = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<int>")).collect()
    b = whitening.whiten(spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<float>")).collect()
    assert sorted(a) == sorted(b) and len(a) == 40
