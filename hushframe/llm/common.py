"""What several operators share: checkpoints and vectorised hashes of words."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The whitespace that separates words: space and \\t \\n \\v \\f \\r, nothing else.
SPACE_BYTES = (9, 10, 11, 12, 13, 32)
WORD_SPLIT = r"[\x20\x09-\x0D]+"
#: Bytes of text that one vectorised step works on, so that its arrays stay small.
STEP_BYTES = 1 << 20
#: A table of decisions is broadcast up to so many bytes, estimated from its counted rows; a larger one is joined by shuffle.
BROADCAST_BYTES = 32 << 20

_own: list[str] = []
_written: dict[str, tuple[SparkSession, int]] = {}
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACE_BYTES)] = True
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application below spark.checkpoint.dir, which driver and executors share.

    A folder of this process's own is used only where the session names none and runs in one process, as in tests.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="checkpoints-"))
        root = _own[0]
    return f"{root.rstrip('/')}/tables-{spark.sparkContext.applicationId}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage: write a table in the shared folder and read it back.

    A lost executor costs nothing that was written. Unlike a checkpointed plan, a table read back brings along neither the
    constraints nor the orderings of the plan it replaces, which multiply over the rounds of a loop, and its size is known,
    so joins choose to broadcast by it. Tables go with `release`, or with the folder when the process ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[path] = (spark, threading.get_ident())
    out = spark.read.schema(df.schema).parquet(path)
    out._table = path
    return out


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder below `shared_folder`, deleted when the process ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _written[path] = (spark, threading.get_ident())
    return path


def release(*tables: DataFrame) -> None:
    """Delete tables of `checkpoint` that nothing reads any more."""
    for df in tables:
        _delete(getattr(df, "_table", None))


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """`checkpoint` of what make() returns; every other table that make wrote on the way is deleted."""
    before = set(_written)
    out = checkpoint(make())
    for path, (_, thread) in list(_written.items()):
        if path not in before and path != out._table and thread == threading.get_ident():
            _delete(path)
    return out


def free_name(df: DataFrame, name: str) -> str:
    """A column name that `df` doesn't have, made from `name`."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def marks(column: str = "text") -> list:
    """Two independent 64-bit hashes m1, m2 of a text column, computed alike wherever a row's key is needed."""
    text = F.col(column).cast("string")
    return [F.xxhash64(text).alias("m1"), F.xxhash64(F.lit(7), text).alias("m2")]


def numbered(df: DataFrame, n: str, name: str) -> DataFrame:
    """Each row `n` times (none for 0), with `name` from 0 to n - 1; made in two steps, so that no row builds an array of n values."""
    size, block = 1 << 12, free_name(df, "_block")
    df = df.filter(F.col(n) > 0).withColumn(block, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / size))))
    count = F.least(F.lit(size).cast("long"), F.col(n) - F.col(block) * size)
    return df.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), count - 1))).withColumn(name, F.col(name) + F.col(block) * size).drop(block)


def _delete(path: str | None) -> None:
    spark, _ = _written.pop(path, (None, 0))
    if spark is not None:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _leave() -> None:
    for path in list(_written):
        try:
            _delete(path)
        except Exception:  # noqa: BLE001, S112  the session may be gone already
            break


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(column: str = "text"):
    """Array of the words of a column; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(F.col(column), F.lit("")), WORD_SPLIT), "")


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, elementwise."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def _byte_values(fold_case: bool) -> np.ndarray:
    values = mix64(np.arange(1, 257, dtype=np.uint64) * _ODD)
    if fold_case:
        values[65:91] = values[97:123]
    return values


_VALUES = {fold: _byte_values(fold) for fold in (False, True)}
_powers = np.ones(1, np.uint64)


def _powers_upto(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        factors = np.full(max(n, 1024), _M2)
        factors[0] = 1
        _powers = np.cumprod(factors, dtype=np.uint64)
    return _powers


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold_case: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash the words of several UTF-8 texts that lie in one buffer.

    data: the bytes; offsets: where each text starts, and the end of the last. fold_case: A-Z count as a-z.
    Returns the words' 64-bit hashes, their first bytes' positions, and for each text the number of its first word (and at last the number of words).
    """
    solid = ~_SPACE[data]
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[firsts] = solid[firsts]
    at = np.flatnonzero(solid)
    starts = np.flatnonzero(start)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, np.zeros(len(offsets), np.int64)
    begin = np.flatnonzero(start[at])
    lengths = np.diff(begin, append=len(at))
    place = np.arange(len(at)) - np.repeat(begin, lengths)
    value = _VALUES[fold_case][data[at]] * _powers_upto(int(lengths.max()))[place]
    hashes = mix64(np.add.reduceat(value, begin) + lengths.astype(np.uint64) * _ODD)
    return hashes, starts, np.searchsorted(starts, offsets)


def sequence_hash(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive values, in order; k-1 values fewer."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, k * int(_ODD) & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for j in range(k):
        out = mix64(out * _ODD + hashes[j : j + n])
    return out


def binary_column(array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of an Arrow binary column, without a copy; nulls are empty."""
    n, (_, offsets, data) = len(array), array.buffers()
    offsets = np.frombuffer(offsets, np.int32)[array.offset : array.offset + n + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def steps(array, step_bytes: int = STEP_BYTES):
    """Cut an Arrow binary column into runs of rows of about step_bytes: (first row, past the last, bytes, offsets from 0)."""
    data, offsets = binary_column(array)
    first = 0
    while first < len(array):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + step_bytes, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last
