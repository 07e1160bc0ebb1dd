"""Session files (JSON lines: a line of metadata, then messages) and cursor logs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hushframe.operators.history import place
from hushframe.sources.storage import write_files
from hushframe.sources.tables import keep_folder, replace, tasks

MESSAGE = "role string, content string, timestamp string, tool_call_id string, name string, tool_calls array<struct<id:string,name:string>>"
_ESCAPED = r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]"""
#: What follows the content of a cut history entry.
CUT = "\n... (truncated)"
METADATA = "created_at string, updated_at string, last_consolidated long"


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Messages of session files: session (the file's name), idx and the message; metadata and broken lines are left out."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    parsed = lines.withColumn("kind", F.get_json_object("line", "$._type")).withColumn("m", F.from_json("line", MESSAGE))
    session = F.regexp_extract("file", r"([^/]+?)(?:\.jsonl)?$", 1)
    good = parsed.filter(F.col("kind").isNull() & F.col("m.role").isNotNull()).select(session.alias("session"), "line_no", "m.*")
    number = F.row_number().over(Window.partitionBy("session").orderBy("line_no")) - 1
    return good.withColumn("idx", number).drop("line_no")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Metadata line of each session file."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), "value").filter(F.get_json_object("value", "$._type") == "metadata")
    return lines.select(F.regexp_extract("file", r"([^/]+?)(?:\.jsonl)?$", 1).alias("session"), F.from_json("value", METADATA).alias("m")).select("session", "m.*")


def broken_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of session files that are no JSON object, by file."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), "value").filter(F.trim("value") != "")
    return lines.groupBy("file").agg(F.count_if(F.try_parse_json("value").isNull()).alias("broken"), F.count("*").alias("lines"))


def write_sessions(messages: DataFrame, path: str) -> None:
    """A folder per session, its messages in order; all files appear together, by a renaming of their folder, in place of what is there."""
    spark = messages.sparkSession
    columns = [c for c in messages.columns if c != "session"]
    # Names of folders as Spark writes and reads them.
    name = F.coalesce(F.nullif(F.col("session").cast("string"), F.lit("")), F.lit("__HIVE_DEFAULT_PARTITION__"))
    escaped = F.array_join(F.transform(F.split(name, ""), lambda c: F.when(c.rlike(_ESCAPED), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c)), "")
    file = F.concat(F.lit("session="), F.when(name.rlike(_ESCAPED), escaped).otherwise(name), F.lit("/part-0.json"))
    ordered = messages.repartition(tasks(spark), "session").sortWithinPartitions("session", "idx")
    passing = keep_folder(spark, f"{path.rstrip('/')}-{uuid.uuid4().hex}")
    write_files(ordered.select(file.alias("file"), F.to_json(F.struct(*columns)).alias("line")), passing)
    replace(spark, passing, path)


def append_history(history: DataFrame, new: DataFrame, order: str, limit: int = 64_000) -> DataFrame:
    """New entries(content, ...) with cursors after the history's last, contents cut to `limit`; cut ones end with CUT.

    order: a column without ties; entries are numbered by ranges of it, so no task sees all of them.
    """
    last = history.agg(F.coalesce(F.max(F.col("cursor").try_cast("long")), F.lit(0))).first()[0]
    content = F.when(F.length("content") > limit, F.concat(F.left("content", F.lit(limit)), F.lit(CUT))).otherwise(F.col("content"))
    return place(new, [F.col(order)], "cursor").withColumn("cursor", F.col("cursor") + F.lit(last)).withColumn("content", content)


def valid_entries(history: DataFrame) -> DataFrame:
    """Entries whose cursor is a whole number."""
    cursor = F.col("cursor").cast("string").try_cast("long")
    return history.filter(cursor.isNotNull()).withColumn("cursor", cursor)


def unread(history: DataFrame, since: int) -> DataFrame:
    return valid_entries(history).filter(F.col("cursor") > since)


def data_urls(media: DataFrame, url: str, limit: int = 64_000) -> DataFrame:
    """Decoded base64 data URLs: adds mime, payload (binary) and, for text types, document (cut to limit)."""
    head = r"^data:([\w.+-]+/[\w.+-]+)(?:;[\w=.+-]+)*;base64,"
    df = media.withColumn("mime", F.nullif(F.regexp_extract(url, head, 1), F.lit("")))
    df = df.withColumn("payload", F.when(F.col("mime").isNotNull(), F.try_to_binary(F.regexp_replace(F.col(url), head, ""), F.lit("base64"))))
    return df.withColumn("document", F.when(F.col("mime").rlike("^text/|json|xml"), F.left(F.decode("payload", "UTF-8"), F.lit(limit))))
