"""Queries: folders of sessions as a table, events through a sink and out to subscribers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hushframe.operators import history, observe
from hushframe.plans.registry import query
from hushframe.plans.streams import read_stream, run_once
from hushframe.sources import events, session_files, sessions
from hushframe.sources.tables import keep_folder, table, work_folder


def _folder(spark, kind):
    return keep_folder(spark, f"{work_folder(spark)}/{kind}/{uuid.uuid4()}")


def _stored_sessions(spark, sf_dir):
    """Conversations as session files; returns their folder."""
    none = F.lit(None).cast("string")
    columns = (F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("session"), F.col("turn").alias("idx"), "role", F.col("text").alias("content"))
    rows = table(spark, sf_dir, "conversations").select(*columns, none.alias("timestamp"), none.alias("tool_call_id"), none.alias("name"))
    at = _folder(spark, "sessions")
    sessions.write_sessions(rows, at)
    return at


@query("session_folder", """WITH f AS (SELECT conv_id, coalesce(arg_min(text, turn) FILTER (role = 'user'), arg_min(text, turn) FILTER (role = 'assistant')) AS t, count(*) AS messages FROM conversations GROUP BY conv_id)
SELECT 'c' || conv_id AS session, left(trim(regexp_replace(t, '\\s+', ' ', 'g')), 60) AS preview, messages, messages - 1 AS last_idx FROM f""")
def session_folder(spark, sf_dir):
    """The list of sessions from a folder of their files, read by the format `sessions`."""
    rows = session_files.read(spark, _stored_sessions(spark, sf_dir))
    return history.previews(rows, "session", "idx", text="content").select("session", "preview", "messages", F.col("last_turn").alias("last_idx"))


@query("event_sink", "SELECT event_id, event_type, user_id, value, props FROM events")
def event_sink(spark, sf_dir):
    """Events streamed to the sink in several batches, and read back from what the batches committed."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "value", "props")
    at = _folder(spark, "events")
    rows.repartition(3, "event_id").write.parquet(f"{at}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    events.write_events(stream, f"{at}/sink", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return events.read_events(spark, f"{at}/sink", rows.schema)


@query("event_fan_out", """WITH s AS (SELECT n_name AS subscriber, n_nationkey AS place, CASE n_nationkey % 6 WHEN 0 THEN 'click' WHEN 1 THEN 'error' WHEN 2 THEN 'purchase' WHEN 3 THEN 'signup' WHEN 4 THEN 'view' END AS asked FROM nation)
SELECT subscriber, place, event_type, count(*) AS events, sum(event_id)::BIGINT AS ids FROM events JOIN s ON asked IS NULL OR asked = event_type GROUP BY ALL""")
def event_fan_out(spark, sf_dir):
    """Events of a stream, each to the nations that asked for its kind and to those that asked for all."""
    kinds = F.array(*[F.lit(k) for k in ("click", "error", "purchase", "signup", "view")])
    asked = F.when(F.col("n_nationkey") % 6 < 5, F.get(kinds, F.col("n_nationkey") % 6))
    subscriptions = table(spark, sf_dir, "nation").select(F.col("n_name").alias("subscriber"), F.col("n_nationkey").alias("place"), asked.alias("event_type"))
    stream = read_stream(spark, sf_dir, "events").select("event_id", "event_type")
    out = run_once(events.fan_out(stream, subscriptions))
    return out.groupBy("subscriber", "place", "event_type").agg(F.count("*").alias("events"), F.sum("event_id").alias("ids"))


@query("observed_stages", """SELECT 'received' AS stage, count(*) AS rows, sum(value) AS value, max(event_id)::DOUBLE AS last FROM events UNION ALL SELECT 'errors', count(*), sum(value), max(event_id)::DOUBLE FROM events WHERE event_type = 'error'
UNION ALL SELECT 'users', count(*), sum(n)::DOUBLE, NULL FROM (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY user_id)""")
def observed_stages(spark, sf_dir):
    """Counts that hooks got while a stream and a job over its result ran: those of count queries."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "value")
    at = _folder(spark, "observed")
    rows.repartition(2, "event_id").write.parquet(f"{at}/in")
    heard = observe.StageListener()
    spark.streams.addListener(heard)
    metrics = {"value": F.sum("value"), "last": F.max("event_id")}
    stream = observe.watch(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in"), "received", **metrics)
    errors = observe.watch(stream.filter("event_type = 'error'"), "errors", **metrics)
    started = errors.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    started.awaitTermination()
    if not heard.wait(started.id):
        raise TimeoutError("the end of the stream wasn't heard")
    spark.streams.removeListener(heard)
    stages = observe.Stages()
    per = spark.read.schema(rows.schema).parquet(f"{at}/out").groupBy("user_id").agg(F.count("*").alias("n"))
    stages.watch(per, "users", value=F.sum("n")).write.format("noop").mode("overwrite").save()
    every = heard.counts(spark, started.id).unionByName(stages.counts(spark)).filter("rows > 0")
    return every.groupBy("stage").agg(F.sum("rows").alias("rows"), F.sum(F.col("metrics")["value"]).alias("value"), F.max(F.try_element_at("metrics", F.lit("last"))).alias("last"))
