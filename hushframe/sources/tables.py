"""The test tables, and tables of the engine's own between two steps of a plan."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []
_kept: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; its timestamps without zone are read as instants of the session's zone."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    naive = {c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"}
    return df.withColumns(naive) if naive else df


def tasks(spark: SparkSession) -> int:
    """Into how many tasks small rows go whose work isn't their bytes; adaptive execution would put them into a few."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def work_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; one of this process only where all run in it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="work-"))
        root = _own[0]
    return root.rstrip("/")


def keep(df: DataFrame) -> DataFrame:
    """Write a result that a plan reads more than once, and read it back; the table goes with `release`, or when the process ends."""
    spark = df.sparkSession
    path = f"{work_folder(spark)}/kept-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _kept[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._table = path
    return out


def once(df: DataFrame) -> DataFrame:
    """What a step reads several times, computed once: a table of `keep` as it is, anything else kept."""
    return df if getattr(df, "_table", None) in _kept else keep(df)


def release(*tables: DataFrame) -> None:
    """Delete tables of `keep` that nothing reads any more; other tables are left alone."""
    for df in tables:
        path = getattr(df, "_table", None)
        if path in _kept:
            delete(_kept.pop(path), path)


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def replace(spark: SparkSession, new: str, path: str) -> None:
    """Put a folder in the place of another, by renaming it."""
    source, target = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (new, path))
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    files.delete(target, True)
    if not files.rename(source, target):
        raise OSError(f"{new} couldn't be renamed to {path}")
    _kept.pop(new, None)


def keep_folder(spark: SparkSession, path: str) -> str:
    """Mark a folder to be deleted when the process ends."""
    _kept[path] = spark
    return path


@atexit.register
def _leave() -> None:
    for path, spark in list(_kept.items()):
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone already
            break
