"""Embedding whitening by a covariance in two passes.

A vector's entries become whole numbers (scaled, floored, shifted). The fit list holds each different vector once. The first
pass sums it exactly, in integers; the second sums the outer products of the centred vectors, a matrix product a block, and
merges the partial sums with treeAggregate. LAPACK's symmetric solver gives the components on the driver, and
the projection, a matrix of dimensions by components, goes to all tasks as a broadcast.

Vectors of different lengths live in different spaces: each length has a fit of its own. Memory is a square matrix a length in a
task and on the driver (134 MB at 4096 dimensions); no vector is gathered anywhere.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hushframe.llm.common import checkpoint, release

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: An eigenvalue at most this part of the largest counts as zero: nothing varies in its direction.
FLAT = 1e-12
#: Rows that one matrix product takes.
BLOCK = 4096


@dataclass
class Space:
    """What is known of the vectors of one length: n of them, their sums, and the leading components (columns) with their variances."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float | None = None

    def __post_init__(self):
        # The mean as a whole number and a fraction, so that nothing is rounded away by the shift.
        whole = [s // self.n for s in self.sums]
        self.whole = np.array(whole, np.int64)
        self.rest = [s - self.n * w for s, w in zip(self.sums, whole, strict=True)]
        self.fraction = np.array([r / self.n for r in self.rest])

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n."""
        return (x - self.whole).astype(np.float64) - self.fraction

    def scale(self) -> np.ndarray:
        """1 / sqrt(variance), nan for components in which nothing varies."""
        least = FLAT * max(float(self.variances[0]), 0.0) if len(self.variances) else 0.0
        out = np.full(len(self.variances), np.nan)
        good = self.variances > least
        out[good] = 1 / np.sqrt(self.variances[good])
        return out

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (self.centred(x) @ self.components) * self.scale()

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S)^2, exactly; None where it doesn't fit a long."""
        y = x - self.whole
        far = self.n * (int(np.abs(y).max(initial=0)) + 1)
        if far * far * len(self.rest) < 1 << 63:
            d = y * self.n - np.array(self.rest, np.int64)
            return np.einsum("ij,ij->i", d, d).tolist()
        d = y.astype(object) * self.n - np.array(self.rest, object)
        return [v if v < 1 << 63 else None for v in (d * d).sum(axis=1).tolist()]


def whole_vectors(df: DataFrame, embedding: str = "embedding", scale: int = SCALE, shift: int = SHIFT):
    """floor(scale * entry) + shift of each entry, as longs; null where the row takes no part (see `whiten`)."""
    v = F.col(f"`{embedding}`").cast("array<double>")
    near = F.lit(float(1 << 61))  # differences of two stay longs; nulls, nan and infinities fail as well
    good = F.forall(v, lambda c: F.coalesce((c * scale < near) & (c * scale > -near), F.lit(False)))
    x = F.transform(v, lambda c: F.floor(c * scale).cast("long") + F.lit(shift).cast("long"))
    return F.when(good & (F.size(v) > 0), x)


def _blocks(batch: pa.RecordBatch, column: str):
    """The rows of a batch by length of their vectors, BLOCK at most at a time: (row numbers, matrix)."""
    held = batch.column(column)
    offsets = np.asarray(held.offsets, np.int64)
    flat, offsets = np.asarray(held.values, np.int64)[offsets[0] : offsets[-1]], offsets - offsets[0]
    sizes = np.diff(offsets)
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        for k in range(0, len(rows), BLOCK):
            part = rows[k : k + BLOCK]
            yield part, flat[offsets[part][:, None] + np.arange(size)]


def _merge(into: dict, more: dict) -> dict:
    for size, parts in more.items():
        into[size] = tuple(a + b for a, b in zip(into[size], parts, strict=True)) if size in into else parts
    return into


def _tree_sum(fit: DataFrame, partial, depth: int) -> dict:
    """Sum over all blocks of the fit list of partial(matrix), a tuple of numbers and arrays, by length of the vectors."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for batch in batches:
            for _, x in _blocks(batch, "x"):
                _merge(total, {x.shape[1]: partial(x)})
        if total:
            yield pa.RecordBatch.from_pydict({"part": pa.array([pickle.dumps(total)], pa.binary())})

    def unpacked(total: dict, row) -> dict:
        return _merge(total, pickle.loads(bytes(row.part)))

    return fit.mapInArrow(read, "part binary").rdd.treeAggregate({}, unpacked, _merge, depth)


def _exact_sums(x: np.ndarray) -> tuple[int, np.ndarray]:
    safe = int(np.abs(x).max(initial=0)) * len(x) < 1 << 62
    return len(x), (x.sum(axis=0) if safe else x.astype(object).sum(axis=0)).astype(object)


def fit(vectors: DataFrame, components: int = COMPONENTS, depth: int = 3) -> dict[int, Space]:
    """Fit each length of the different vectors `vectors` (a column x, array of longs): its Space, by length.

    A component is a unit vector whose entry of largest size (the first of them) is positive; they are numbered by falling variance. No vectors: no spaces.
    """
    found = {}
    sc = vectors.sparkSession.sparkContext
    sums = _tree_sum(vectors, _exact_sums, depth)
    for size, (n, s) in sums.items():
        found[size] = Space(n, s.tolist(), np.zeros((size, 0)), np.zeros(0), 0.0)
    centre = sc.broadcast(found)

    def products(x: np.ndarray) -> tuple[np.ndarray]:
        z = centre.value[x.shape[1]].centred(x)
        return (z.T @ z,)

    for size, (total,) in _tree_sum(vectors, products, depth).items():
        covariance = total / found[size].n
        values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
        values, axes = np.maximum(values[::-1][:components], 0), axes[:, ::-1][:, :components]
        top = axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])]
        found[size] = Space(found[size].n, found[size].sums, axes * np.where(top < 0, -1.0, 1.0), values, float(np.trace(covariance)))
    model = sc.broadcast(found)

    def squares(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = model.value[x.shape[1]].whitened(x)
        return w.sum(axis=0), w.T @ w

    # How far the whitened vectors' own covariance is from the identity, over all of the fit list; they are centred already.
    for size, (mean, total) in _tree_sum(vectors, squares, depth).items():
        space = found[size]
        good = np.isfinite(space.scale())
        if good.any():
            mean = mean[good] / space.n
            own = total[np.ix_(good, good)] / space.n - np.outer(mean, mean)
            space.identity_error = float(np.abs(own - np.eye(good.sum())).max())
    centre.unpersist()
    model.unpersist()
    return found


def whiten(df: DataFrame, components: int = COMPONENTS, keep: tuple[str, ...] = ("vec_id",), embedding: str = "embedding") -> DataFrame:
    """A row for each vector and component: keep..., component, n, deviation, whitened, explained, identity_error.

    A vector takes no part if it is null or empty, or holds a null or non-finite entry or one too large for a long. Whether the other
    columns are null doesn't matter. The fit list holds equal vectors once, however many rows have them; each row is returned. A
    vector of d dimensions has min(d, components) components. Where nothing varies (a variance that is zero but for
    rounding, a single vector) whitened is null; explained and identity_error are null where nothing varies at all.
    deviation is null where it exceeds a long. keep: columns to carry along; those named like an added one are replaced.
    No vectors: no rows.
    """
    added = ("component", "n", "deviation", "whitened", "explained", "identity_error")
    carried = [c for c in keep if c.lower() not in added]
    given = F.struct(*[F.col(f"`{c}`") for c in carried]) if carried else F.lit(0)
    rows = df.select(given.alias("given"), whole_vectors(df, embedding).alias("x")).filter("x is not null")
    different = checkpoint(rows.select("x").distinct())
    model = df.sparkSession.sparkContext.broadcast(fit(different, components))
    release(different)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["given", *added]
        for batch in batches:
            for part, x in _blocks(batch, "x"):
                space = model.value[x.shape[1]]
                k = len(space.variances)
                white = space.whitened(x).reshape(-1)
                explained = np.tile(space.variances / space.trace if space.trace > 0 else np.full(k, np.nan), len(x))
                columns = [
                    batch.column("given").take(pa.array(np.repeat(part, k))),
                    pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                    pa.array(np.full(len(white), space.n), pa.int64()),
                    pa.array([v for v in space.deviation(x) for _ in range(k)], pa.int64()),
                    pa.array(white, pa.float64(), mask=np.isnan(white)),
                    pa.array(explained, pa.float64(), mask=np.isnan(explained)),
                    pa.array([space.identity_error] * len(white), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    types = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    schema = StructType([rows.schema["given"], *StructType.fromDDL(types).fields])
    out = rows.mapInArrow(project, schema)
    return out.select(*[F.col(f"given.`{c}`").alias(c) for c in carried], *added)
