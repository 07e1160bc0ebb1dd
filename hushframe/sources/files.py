"""Files besides sessions: transcripts, logs of turns, artifacts, documents, listings, job stores and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hushframe.functions import scalars
from hushframe.sources.tables import keep, release

#: Largest transcript that is read, and document that is decoded, in bytes (fixed values).
TRANSCRIPT_BYTES, DOCUMENT_BYTES = 8 << 20, 32 << 20
#: Endings of documents that are text as they are.
TEXT_ENDINGS = ("txt", "md", "csv", "json", "xml", "html", "htm", "log", "yaml", "yml", "toml", "ini", "cfg", "py", "js", "ts", "sql")


def _name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.jsonl?)?$", 1)


def read_transcripts(spark: SparkSession, path: str, limit: int = TRANSCRIPT_BYTES, session: Column | None = None) -> DataFrame:
    """Lines of transcripts that are JSON objects: (session, line_no, object variant). Files above `limit` are left out, and so are lines that are no object.

    session: made of the column `file`, by default the file's name.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), "value")
    lines = files.filter(F.col("size") <= limit).select((_name(F.col("file")) if session is None else session).alias("session"), F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    objects = lines.withColumn("object", F.when(F.ltrim("line").startswith("{"), F.try_parse_json("line")))
    return objects.filter(F.col("object").isNotNull()).drop("line")


def append_log(rows: DataFrame, path: str, key: str = "session") -> None:
    """Add rows to a log, a folder per hash of the key; what is there stays."""
    _hashed(rows, key).write.mode("append").partitionBy("bucket").json(path)


def replace_log(rows: DataFrame, path: str, key: str = "session") -> None:
    """Put rows in place of all that the log holds of their keys; other keys stay, also those that share a folder with them."""
    _put(rows, path, "json", [key], key)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a log; broken lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def _hashed(rows: DataFrame, key: str, buckets: int = 16) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def _put(rows: DataFrame, path: str, kind: str, same: list[str], key: str) -> None:
    """Write rows to the folders of their keys; stored rows that are `same` as one of them give way, all others stay.

    Only folders that a row falls into are read and rewritten.
    """
    spark = rows.sparkSession
    news = keep(_hashed(rows, key))
    touched = [r.bucket for r in news.select("bucket").distinct().collect()]  # numbers of folders
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    written, merged = news, None
    if touched and there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        stored = spark.read.schema(news.schema).format(kind).load(path).filter(F.col("bucket").isin(touched))
        gone = news.select(*[F.col(c).alias(f"_{c}") for c in same]).distinct()
        on = [stored[c].eqNullSafe(F.col(f"_{c}")) for c in same]
        # Written down first: the folders that are read are the ones to be replaced.
        written = merged = keep(stored.join(gone, reduce(lambda a, b: a & b, on), "left_anti").unionByName(news))
    mode = written.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    mode.partitionBy("bucket").format(kind).save(path)
    release(news, *([merged] if merged is not None else []))


def last_entry(history: DataFrame, key: list[str]) -> DataFrame:
    """The entry of highest cursor of each key, entries without a whole number aside."""
    cursor = F.col("cursor").cast("string").try_cast("long")
    rest = [c for c in history.columns if c not in (*key, "cursor")]
    good = history.withColumn("cursor", cursor).filter("cursor is not null")
    return good.groupBy(*key).agg(F.max_by(F.struct("cursor", *rest), "cursor").alias("_e")).select(*key, "_e.*")


def write_artifacts(artifacts: DataFrame, path: str) -> None:
    """Artifacts(session, turn, call, name, payload binary) as a table, names made safe; the same artifact again takes the place of the one before.

    Of several under one name in one write, that of the largest hash stays.
    """
    name = F.regexp_replace(F.regexp_extract("name", r"([^/\\]*)$", 1), r"[^a-zA-Z0-9_.-]", "_")
    same = ["session", "turn", "call", "name"]
    named = artifacts.withColumn("name", name).withColumn("sha256", F.sha2("payload", 256))
    rest = [c for c in named.columns if c not in same]
    once = named.groupBy(*same).agg(F.max_by(F.struct(*rest), F.coalesce("sha256", F.lit(""))).alias("_a")).select(*same, "_a.*")
    _put(once, path, "parquet", same, "session")


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files below a folder with their bytes: (path, modified, size, content)."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return df.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content")


def documents(files: DataFrame, limit: int = DOCUMENT_BYTES, endings: tuple[str, ...] = TEXT_ENDINGS) -> DataFrame:
    """Files(path, size, content) as documents: adds document and refused (too large, binary, or an ending without an extractor)."""
    ending = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    refused = F.when(F.col("size") > limit, F.lit("too large")).when(~ending.isin(*endings), F.lit("no extractor")).when(scalars.is_binary(F.col("content")), F.lit("binary"))
    return files.withColumn("refused", refused).withColumn("document", F.when(refused.isNull(), scalars.decoded(F.col("content"))))


def listing(files: DataFrame, root: str, order: str = "path", limit: int | None = None) -> DataFrame:
    """Entries below a folder, by path or latest first (then path): (entry, size, modified); contents aren't read. limit: a page, by design."""
    entry = F.regexp_replace(F.col("path"), "^.*?" + root.rstrip("/").replace(".", r"\."), "")
    rows = files.select(F.ltrim(entry, F.lit("/")).alias("entry"), "size", "modified")
    rows = rows.orderBy("entry") if order == "path" else rows.orderBy(F.col("modified").desc(), "entry")
    return rows if limit is None else rows.limit(limit)


def page(rows: DataFrame, order: list, offset: int, limit: int) -> tuple[DataFrame, bool]:
    """A page of rows in order and whether more follow; one row more than the page is asked for, no count of all."""
    ahead = rows.orderBy(*order).offset(offset).limit(limit + 1)
    return ahead.limit(limit), ahead.count() > limit


def upsert_jobs(store: DataFrame, actions: DataFrame, order: str) -> DataFrame:
    """A store of jobs(id, ...) after a log of actions(kind: add, update or delete, id, ...): the last action of each job counts."""
    columns = [c for c in store.columns if c != "id"]
    last = actions.groupBy("id").agg(F.max_by(F.struct("kind", *columns), order).alias("_a"))
    joined = store.withColumn("_old", F.struct(*columns)).select("id", "_old").join(last, "id", "full")
    # An update keeps the fields that it leaves null.
    field = lambda c: F.when(F.col("_a").isNull(), F.col(f"_old.{c}")).when(F.col("_a.kind") == "add", F.col(f"_a.{c}")).otherwise(F.coalesce(f"_a.{c}", f"_old.{c}")).alias(c)
    return joined.filter("_a is null or _a.kind <> 'delete'").select("id", *[field(c) for c in columns])


def templates(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation templates stored as JSON: (id, domain, slots map<string, struct<type, choices>>, turns array<struct<role, text>>)."""
    schema = "id string, domain string, slots map<string,struct<type:string,choices:array<string>>>, turns array<struct<role:string,text:string>>"
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def slots_unfilled(templates_: DataFrame) -> DataFrame:
    """Templates whose turns use other slots than they declare: (id, missing, unused), empty arrays where all is well."""
    used = F.array_distinct(F.flatten(F.transform("turns", lambda t: F.regexp_extract_all(t["text"], F.lit(r"\{(\w+)\}"), F.lit(1)))))
    return templates_.select("id", F.array_sort(F.array_except(used, F.map_keys("slots"))).alias("missing"), F.array_sort(F.array_except(F.map_keys("slots"), used)).alias("unused"))


def markdown_table(rows: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """Rows as the lines of a markdown table, in order: (line_no, line), head and rule first. For reports, which are small."""
    cells = lambda values: F.concat(F.lit("| "), F.array_join(F.array(*values), " | "), F.lit(" |"))
    number = F.row_number().over(Window.orderBy(*order)) + 2
    body = rows.select(number.alias("line_no"), cells([F.coalesce(F.col(c).cast("string"), F.lit("–")) for c in columns]).alias("line"))
    head = rows.sparkSession.createDataFrame([(1, "| " + " | ".join(columns) + " |"), (2, "|" + "---|" * len(columns))], "line_no int, line string")
    return head.unionByName(body)
