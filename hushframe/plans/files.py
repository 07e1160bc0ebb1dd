"""Queries: files written and read again in a work folder, checked against what went in."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hushframe.plans.registry import query
from hushframe.sources import files, sessions
from hushframe.sources.storage import write_files
from hushframe.sources.tables import keep, keep_folder, table, tasks, work_folder


def _folder(spark) -> str:
    return keep_folder(spark, f"{work_folder(spark)}/files/{uuid.uuid4().hex}")


@query("transcript_lines", """SELECT 's' || conv_id AS session, count(*) AS n, count(*) FILTER (role = 'user') AS users FROM conversations WHERE conv_id % 5 <> 0 GROUP BY conv_id""")
def transcript_lines(spark, sf_dir):
    """Transcripts with broken lines and lines that are no object; those above the size limit are left out."""
    path, turn = _folder(spark), F.col("turn")
    good = F.to_json(F.struct("role", F.col("text").alias("content"), "turn"))
    pad = F.when(F.col("conv_id") % 5 == 0, F.repeat(F.lit(" "), F.lit(200_000))).otherwise(F.lit(""))
    line = F.concat(good, F.lit('\n{"role": "user", "cut\n[1, 2]\n\n7'))
    file = F.concat(F.lit("s"), F.col("conv_id").cast("string"), F.lit(".jsonl")).alias("file")
    rows = table(spark, sf_dir, "conversations").select(file, "conv_id", "turn", line.alias("line"))
    # As many tasks as there are for any shuffle, however few bytes: what counts is the number of files. Padding comes last, so
    # nothing moves or sorts it.
    ordered = rows.repartition(tasks(spark), "file").sortWithinPartitions("file", "turn", "line")
    write_files(ordered.select("file", F.concat("line", pad).alias("line")), path)
    told = files.read_transcripts(spark, path, 100_000)
    role = F.try_variant_get("object", "$.role", "string")
    return told.groupBy("session").agg(F.count("*").alias("n"), F.count_if(role == "user").alias("users"))


@query("turn_log", """SELECT 'u' || user_id AS session, event_id AS turn, CASE WHEN user_id = 3 THEN 'replaced' ELSE event_type END AS payload FROM events WHERE event_id % 3 < 2""")
def turn_log(spark, sf_dir):
    """A log of turns: appended twice, then one session's rows replaced."""
    path = _folder(spark)
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session"), F.col("event_id").alias("turn"), F.col("event_type").alias("payload"))
    files.append_log(rows.filter("turn % 3 = 0"), path)
    files.append_log(rows.filter("turn % 3 = 1"), path)
    schema = "session string, turn long, payload string, bucket int"
    stored = files.read_log(spark, path, schema)
    changed = stored.filter("session = 'u3'").withColumn("payload", F.lit("replaced"))
    files.replace_log(keep(changed.drop("bucket")), path)
    return files.read_log(spark, path, schema).drop("bucket")


@query("history_cursors", """SELECT event_id, 7 + row_number() OVER (ORDER BY event_id) AS cursor, CASE WHEN length(props) > 20 THEN left(props, 20) || chr(10) || '... (truncated)' ELSE props END AS content FROM events""")
def history_cursors(spark, sf_dir):
    """Entries appended with cursors after the last whole number of the log."""
    old = spark.createDataFrame([("3", "a"), ("x", "b"), ("7", "c"), (None, "d")], "cursor string, content string")
    new = table(spark, sf_dir, "events").select("event_id", F.col("props").alias("content"))
    return sessions.append_history(old, new, "event_id", 20).select("event_id", "cursor", "content")


@query("last_entries", "SELECT user_id, max(event_id) AS cursor, arg_max(event_type, event_id) AS content FROM events WHERE event_id % 4 <> 0 GROUP BY user_id")
def last_entries(spark, sf_dir):
    cursor = F.when(F.col("event_id") % 4 == 0, F.lit("?")).otherwise(F.col("event_id").cast("string"))
    return files.last_entry(table(spark, sf_dir, "events").select("user_id", cursor.alias("cursor"), F.col("event_type").alias("content")), ["user_id"])


@query("stored_artifacts", "SELECT p_partkey, regexp_replace(p_name, '[^a-zA-Z0-9_.-]', '_', 'g') || '.bin' AS name, sha256(p_name) AS sha256 FROM part")
def stored_artifacts(spark, sf_dir):
    path = _folder(spark)
    rows = table(spark, sf_dir, "part").select(F.lit("s").alias("session"), F.col("p_partkey").alias("turn"), F.lit("c").alias("call"), F.concat(F.lit("/tmp/"), "p_name", F.lit(".bin")).alias("name"), F.col("p_name").cast("binary").alias("payload"))
    files.write_artifacts(rows.unionByName(rows.filter("turn % 2 = 0")), path)
    return spark.read.parquet(path).select(F.col("turn").alias("p_partkey"), "name", "sha256")


@query("read_documents", """SELECT n_name AS name, CASE n_nationkey % 4 WHEN 0 THEN 'Ünit ' || n_name WHEN 1 THEN 'Ünit ' || n_name END AS document, CASE n_nationkey % 4 WHEN 2 THEN 'no extractor' WHEN 3 THEN 'binary' END AS refused FROM nation""")
def read_documents(spark, sf_dir):
    """Documents by their ending: UTF-8, Latin-1, binary ones, and ones that nothing reads."""
    key, text = F.col("n_nationkey") % 4, F.concat(F.lit("Ünit "), "n_name")
    ending = F.when(key == 2, F.lit(".xyz")).otherwise(F.lit(".txt"))
    content = F.when(key == 1, F.encode(text, "ISO-8859-1")).when(key == 3, F.concat(text.cast("binary"), F.lit(bytearray(b"\x00\x01")))).otherwise(F.encode(text, "UTF-8"))
    stored = table(spark, sf_dir, "nation").select("n_name", F.concat(F.lit("/d/"), "n_name", ending).alias("path"), content.alias("content"))
    out = files.documents(stored.withColumn("size", F.octet_length("content").cast("long")))
    return out.select(F.col("n_name").alias("name"), "document", "refused")


@query("folder_listing", "SELECT name || '.txt' AS entry, length(name)::BIGINT AS size FROM (SELECT n_name AS name FROM nation) ORDER BY entry LIMIT 10")
def folder_listing(spark, sf_dir):
    """The first entries of a folder: a page by design."""
    rows = table(spark, sf_dir, "nation").select(F.concat(F.lit("/root/d/"), "n_name", F.lit(".txt")).alias("path"), F.length("n_name").cast("long").alias("size"), F.current_timestamp().alias("modified"))
    return files.listing(rows, "/root/d", limit=10).select("entry", "size")


@query("paged_listing", "SELECT event_id, (SELECT count(*) > 25 FROM events WHERE event_type = 'click') AS more FROM events WHERE event_type = 'click' ORDER BY event_id LIMIT 20 OFFSET 5")
def paged_listing(spark, sf_dir):
    """A page of matches and whether more follow."""
    shown, more = files.page(table(spark, sf_dir, "events").filter("event_type = 'click'").select("event_id"), ["event_id"], 5, 20)
    return shown.withColumn("more", F.lit(more))


@query("job_store", """WITH s AS (SELECT c_custkey AS id, c_name AS name, c_acctbal AS due FROM customer WHERE c_custkey % 2 = 0), a AS (SELECT o_custkey AS id, arg_max(CASE o_orderkey % 3 WHEN 0 THEN 'add' WHEN 1 THEN 'update' ELSE 'delete' END, o_orderkey) AS kind, max(o_orderkey) AS k FROM orders GROUP BY o_custkey),
l AS (SELECT a.id, kind, 'job ' || k AS name, CASE WHEN k % 2 = 0 THEN k::DOUBLE END AS due FROM a)
SELECT coalesce(s.id, l.id) AS id, CASE WHEN l.id IS NULL THEN s.name ELSE l.name END AS name, CASE WHEN l.id IS NULL THEN s.due WHEN kind = 'add' THEN l.due ELSE coalesce(l.due, s.due) END AS due FROM s FULL JOIN l ON s.id = l.id WHERE kind IS NULL OR kind <> 'delete'""")
def job_store(spark, sf_dir):
    """A store of jobs after a log of actions."""
    key = F.col("o_orderkey")
    store = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("due"))
    kind = F.when(key % 3 == 0, F.lit("add")).when(key % 3 == 1, F.lit("update")).otherwise(F.lit("delete"))
    actions = table(spark, sf_dir, "orders").select(kind.alias("kind"), F.col("o_custkey").alias("id"), F.concat(F.lit("job "), key.cast("string")).alias("name"), F.when(key % 2 == 0, key.cast("double")).alias("due"), key.alias("seq"))
    return files.upsert_jobs(store, actions, "seq")


@query("report_lines", """SELECT 1 AS line_no, '| region | nations |' AS line UNION ALL SELECT 2, '|---|---|' UNION ALL SELECT 2 + row_number() OVER (ORDER BY r_name)::INTEGER, '| ' || r_name || ' | ' || n || ' |' FROM (SELECT r_name, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name)""")
def report_lines(spark, sf_dir):
    """A report as a markdown table."""
    rows = table(spark, sf_dir, "region").join(table(spark, sf_dir, "nation"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("region")).agg(F.count("*").alias("nations"))
    return files.markdown_table(rows, ["region", "nations"], ["region"])


@query("template_slots", """SELECT n_name AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'b' ELSE '' END AS missing, CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE 'c' END AS unused FROM nation""")
def template_slots(spark, sf_dir):
    """Slots that templates use without declaring, and declare without using."""
    key = F.col("n_nationkey")
    text = F.concat(F.lit("Dear {a}"), F.when(key % 2 == 0, F.lit(" {b}")).otherwise(F.lit("")), F.when(key % 3 == 0, F.lit(" {c}")).otherwise(F.lit("")))
    slot = F.struct(F.lit("person").alias("type"), F.array(F.lit("x")).alias("choices"))
    rows = table(spark, sf_dir, "nation").select(F.col("n_name").alias("id"), F.create_map(F.lit("a"), slot, F.lit("c"), slot).alias("slots"), F.array(F.struct(F.lit("user").alias("role"), text.alias("text"))).alias("turns"))
    return files.slots_unfilled(rows).select("id", F.array_join("missing", ",").alias("missing"), F.array_join("unused", ",").alias("unused"))


@query("media_payloads", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'text/plain' ELSE 'image/png' END AS mime, CASE WHEN p_partkey % 2 = 0 THEN p_name END AS document, length(p_name) AS n FROM part")
def media_payloads(spark, sf_dir):
    """Data URLs decoded; text types as documents."""
    kind = F.when(F.col("p_partkey") % 2 == 0, F.lit("text/plain")).otherwise(F.lit("image/png"))
    url = F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.base64(F.col("p_name").cast("binary")))
    out = sessions.data_urls(table(spark, sf_dir, "part").select("p_partkey", url.alias("url")), "url")
    return out.select("p_partkey", "mime", "document", F.octet_length("payload").cast("long").alias("n"))

