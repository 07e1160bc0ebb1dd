"""Queries that run a stream over what a table holds now, and give back what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hushframe.functions import grammar
from hushframe.operators import vault
from hushframe.plans.detection import _SANITIZED
from hushframe.plans.registry import query
from hushframe.sources.tables import keep_folder, table, work_folder
from hushframe.streaming import chunks
from hushframe.streaming.dispatch import dispatch
from hushframe.streaming.jobs import runs
from hushframe.streaming.sessions import canonical_tokens, known_tokens, sanitize_polls, sanitize_stream, use_state_store


def read_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir) if _one_file(spark, sf_dir, name) else spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parquet")


def _one_file(spark: SparkSession, sf_dir: str, name: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile()


def run_once(stream: DataFrame) -> DataFrame:
    """Run a stream over all there is and read what it wrote; files lie below the folder of spark.checkpoint.dir."""
    spark = stream.sparkSession
    at = keep_folder(spark, f"{work_folder(spark)}/streams/{uuid.uuid4()}")
    stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def _documents_in_chunks(spark, sf_dir, size):
    """Documents as streams of their source's session, a document an hour; one in seven is left open."""
    docs = read_stream(spark, sf_dir, "documents")
    cut = chunks.cut_chunks(docs, "source", "doc_id", "text", size)
    at = F.timestamp_seconds((F.col("stream") + 1) * 3600)  # time 0 is late from the start
    return cut.withColumn("ts", at).withColumn("last", F.col("last") & (F.col("stream") % 7 != 0))


#: Open documents that a timer has closed: silent for 5.5 hours when the watermark, 10 hours behind, came to its end.
_CLOSED = "(doc_id % 7 <> 0 OR doc_id + 5.5 <= (SELECT max(doc_id) FROM documents) - 10)"


def _emitted(spark, sf_dir, size):
    use_state_store(spark)
    return run_once(sanitize_stream(_documents_in_chunks(spark, sf_dir, size), idle="5.5 hours", delay="10 hours"))


def _joined(out, text):
    parts = F.array_sort(F.collect_list(F.struct("seq", "emitted")))
    whole = out.groupBy("session", F.col("stream").alias("doc_id")).agg(F.array_join(F.transform(parts, lambda x: x["emitted"]), "").alias(text), F.max("closed").alias("closed"))
    return whole.filter("closed is not null")


@query("stream_sanitize", f"""WITH RECURSIVE {_SANITIZED} SELECT doc_id, regexp_replace(arg_max(t, k), '<<([A-Z_]+)_[0-9]+>>', '<<\\1>>', 'g') AS sanitized, CASE WHEN doc_id % 7 = 0 THEN 'idle' ELSE 'last' END AS closed
FROM step WHERE {_CLOSED} GROUP BY doc_id""")
def stream_sanitize(spark, sf_dir):
    """Documents sanitised as streams of chunks that share the vault of their source; streams without an end are closed by a timer."""
    out = _joined(_emitted(spark, sf_dir, 1000), "sanitized")
    # In which order streams arrive is open, so numbers of tokens are left out here; stream_tokens compares those.
    return out.select("doc_id", F.regexp_replace("sanitized", "<<([A-Z_]+)_[0-9]+>>", "<<$1>>").alias("sanitized"), "closed")


@query("stream_poll_texts", f"""WITH RECURSIVE {_SANITIZED}, n AS (SELECT doc_id, greatest(1, ceil(length(coalesce(text, '')) / 1500.0))::BIGINT AS polls FROM documents)
SELECT doc_id, regexp_replace(coalesce(arg_max(t, k), ''), '<<([A-Z_]+)_[0-9]+>>', '<<\\1>>', 'g') AS sanitized, any_value(polls) - 1 AS running, 1::BIGINT AS ended FROM step JOIN n USING (doc_id) GROUP BY doc_id""")
def stream_poll_texts(spark, sf_dir):
    """Documents as outputs of running sessions, told poll by poll with status lines: sanitised across polls, each status line where it was."""
    use_state_store(spark)
    cut = chunks.cut_chunks(read_stream(spark, sf_dir, "documents"), "source", "doc_id", "text", 1500)
    name = F.concat(F.lit("d"), F.col("stream").cast("string"))
    status = F.when(F.col("last"), F.lit("Exit code: 0")).otherwise(F.concat(F.lit("Process running. session_id: "), name))
    none = F.lit(None).cast("string")
    result = F.concat("chunk", F.lit("\n"), status)
    results = cut.select("session", F.when(F.col("seq") == 0, "exec").otherwise("write_stdin").alias("tool"), none.alias("call_id"), name.alias("session_id"), none.alias("stream_id"), "seq", result.alias("result"))
    out = run_once(sanitize_polls(results))
    parts = F.array_sort(F.collect_list(F.struct("seq", "emitted")))
    is_running = F.col("shown").rlike(r"(^|\n)Process running\. session_id: d[0-9]+$")
    per = out.groupBy("session", "stream").agg(
        F.array_join(F.transform(parts, lambda x: x["emitted"]), "").alias("text"), F.count_if(is_running).alias("running"), F.count_if(F.col("shown").rlike(r"(^|\n)Exit code: 0$")).alias("ended"),
    )
    keys = table(spark, sf_dir, "documents").select("doc_id", F.xxhash64(F.concat(F.lit("exec_session:d"), F.col("doc_id").cast("string"))).alias("stream"))
    return per.join(keys, "stream").select("doc_id", F.regexp_replace("text", "<<([A-Z_]+)_[0-9]+>>", "<<$1>>").alias("sanitized"), "running", "ended")


@query("stream_tokens", f"""WITH RECURSIVE {_SANITIZED}, last AS (SELECT doc_id, arg_max(t, k) AS t FROM step WHERE {_CLOSED} GROUP BY doc_id),
used AS (SELECT source AS session, unnest(regexp_extract_all(t, '{grammar.PLACEHOLDER}')) AS token FROM last JOIN documents USING (doc_id))
SELECT session, regexp_extract(token, '{grammar.PLACEHOLDER_TAG}', 1) AS tag, count(DISTINCT token) AS tokens, count(DISTINCT token) AS surfaces, 1::BIGINT AS most FROM used GROUP BY ALL""")
def stream_tokens(spark, sf_dir):
    """Over all streams of a session a surface has one token and a token one surface: as many as the batch vault puts into the same texts."""
    out = _emitted(spark, sf_dir, 3000)
    used = _joined(out, "text").select("session", F.explode(grammar.tokens(F.col("text"))).alias("placeholder")).distinct()
    known = known_tokens(out)
    most = known.groupBy("session", "surface").agg(F.count_distinct("placeholder").alias("n"), F.min("placeholder").alias("placeholder"))
    rows = used.join(most, ["session", "placeholder"]).withColumn("tag", grammar.placeholder_tag(F.col("placeholder")))
    return rows.groupBy("session", "tag").agg(F.count_distinct("placeholder").alias("tokens"), F.count("*").alias("surfaces"), F.max("n").alias("most"))


@query("stream_roundtrip", f"SELECT doc_id, coalesce(text, '') AS restored FROM documents WHERE {_CLOSED}")
def stream_roundtrip(spark, sf_dir):
    """Documents sanitised as streams and restored with the tokens that their sessions' streams told: the texts as they were."""
    out = _emitted(spark, sf_dir, 700)
    whole = _joined(out, "text").select("session", "doc_id", "text")
    return vault.restore(whole, canonical_tokens(out), "session", ["doc_id"]).select("doc_id", "restored")


@query("stream_restore", """SELECT o_orderkey, 'Pay ' || c_name || ' of <<ORG_9>> to ' || c_mktsegment || '.' AS restored FROM orders JOIN customer ON c_custkey = o_custkey""")
def stream_restore(spark, sf_dir):
    """Answers that arrive in pieces of 7 characters, restored piece by piece with the vault of their session."""
    orders, customer = read_stream(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    text = F.concat(F.lit("Pay <<PERSON_"), F.col("o_custkey").cast("string"), F.lit(">> of <<ORG_9>> to <<ORG_1"), F.col("o_custkey").cast("string"), F.lit(">>."))
    cut = chunks.cut_chunks(orders.withColumn("text", text), "o_custkey", "o_orderkey", "text", 7)
    token = lambda head: F.concat(F.lit(head), F.col("c_custkey").cast("string"), F.lit(">>"))
    pair = lambda head, c: F.struct(token(head).alias("placeholder"), F.col(c).alias("canonical"))
    known = customer.select(F.col("c_custkey").cast("string").alias("session"), F.inline(F.array(pair("<<PERSON_", "c_name"), pair("<<ORG_1", "c_mktsegment"))))
    out = vault.restore(run_once(chunks.whole_tokens(cut)), known, "session", ["stream", "seq"], text="piece")
    parts = F.array_sort(F.collect_list(F.struct("seq", "restored")))
    return out.groupBy(F.col("stream").alias("o_orderkey")).agg(F.array_join(F.transform(parts, lambda x: x["restored"]), "").alias("restored"))


@query("stream_filter", "SELECT event_id, user_id, event_type FROM events WHERE event_type = 'error' AND value > 5")
def stream_filter(spark, sf_dir):
    events = read_stream(spark, sf_dir, "events")
    return run_once(events.filter("event_type = 'error' and value > 5").select("event_id", "user_id", "event_type"))


@query("session_dispatch", """WITH RECURSIVE e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'priority' WHEN 'signup' THEN 'command' ELSE 'message' END AS kind, event_id % 3 AS taken FROM events),
s AS (SELECT user_id, -1::BIGINT AS seq, NULL::BIGINT AS turn, []::BIGINT[] AS injected, []::BIGINT[] AS waiting, '' AS told FROM (SELECT DISTINCT user_id FROM events) UNION ALL
SELECT e.user_id, e.seq,
    CASE WHEN kind IN ('message', 'command') THEN coalesce(turn, e.seq) WHEN kind = 'done' AND turn IS NOT NULL THEN coalesce(waiting[1], injected[taken + 1]) ELSE turn END,
    CASE WHEN kind = 'message' AND turn IS NOT NULL AND len(injected) < 2 THEN list_append(injected, e.seq) WHEN kind = 'done' AND turn IS NOT NULL THEN CASE WHEN len(waiting) > 0 THEN injected[taken + 1:] ELSE injected[taken + 2:] END ELSE injected END,
    CASE WHEN kind = 'message' AND turn IS NOT NULL AND len(injected) >= 2 THEN list_append(waiting, e.seq) WHEN kind = 'done' AND turn IS NOT NULL THEN waiting[2:] ELSE waiting END,
    CASE WHEN kind = 'priority' OR (kind = 'command' AND turn IS NOT NULL) THEN e.seq || ' inline ' || coalesce(turn::VARCHAR, '-')
        WHEN kind IN ('message', 'command') AND turn IS NULL THEN e.seq || ' start ' || e.seq
        WHEN kind = 'message' THEN e.seq || CASE WHEN len(injected) < 2 THEN ' inject ' ELSE ' wait ' END || turn
        WHEN kind = 'done' AND turn IS NOT NULL THEN e.seq || ' end ' || turn || CASE WHEN coalesce(waiting[1], injected[taken + 1]) IS NULL THEN '' ELSE ', ' || coalesce(waiting[1], injected[taken + 1]) || ' start ' || coalesce(waiting[1], injected[taken + 1]) END
            || coalesce(', ' || nullif(array_to_string(list_transform(CASE WHEN len(waiting) > 0 THEN injected[taken + 1:] ELSE injected[taken + 2:] END, lambda x: x || ' inject ' || coalesce(waiting[1], injected[taken + 1])), ', '), ''), '') ELSE '' END
    FROM s JOIN e ON e.user_id = s.user_id AND e.seq = s.seq + 1)
SELECT user_id::VARCHAR AS session, seq AS at, told AS actions FROM s WHERE told <> ''""")
def session_dispatch(spark, sf_dir):
    """The events of users as messages, commands and ends of turns: taken in order, though their files come in no order, one turn at a time."""
    use_state_store(spark)
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    kind = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "priority").when(F.col("event_type") == "signup", "command").otherwise("message")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session"), number.cast("long").alias("seq"), kind.alias("kind"), (F.col("event_id") % 3).alias("taken"))
    at = keep_folder(spark, f"{work_folder(spark)}/streams/{uuid.uuid4()}")
    # Three batches, each of as many files as there are cores.
    each = spark.sparkContext.defaultParallelism
    rows.repartition(3 * each, F.xxhash64("session", "seq")).write.parquet(f"{at}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", each).parquet(f"{at}/in")
    out = run_once(dispatch(stream, limit=2))
    told = F.concat_ws(" ", F.col("seq").cast("string"), "action", F.coalesce(F.col("turn").cast("string"), F.lit("-")))
    parts = F.array_sort(F.collect_list(F.struct("nth", told.alias("told"))))
    return out.groupBy("session", "at").agg(F.array_join(F.transform(parts, lambda x: x["told"]), ", ").alias("actions"))


@query("timer_runs", """WITH j AS (SELECT user_id, epoch_us(min(ts)) // 1000 AS first, epoch_us(max(ts)) // 1000 AS last FROM events GROUP BY user_id), w AS (SELECT epoch_us(max(ts)) // 1000 - 86400000 AS mark FROM events),
u AS (SELECT *, CASE WHEN user_id % 3 = 0 THEN least(last, greatest(mark, last)) ELSE greatest(mark, last) END AS until FROM j, w)
SELECT user_id::VARCHAR AS job, CASE WHEN user_id % 2 = 0 THEN (until - first) // 7200000 ELSE CASE WHEN first + 86400000 <= until THEN 1 ELSE 0 END END::BIGINT AS runs,
    CASE WHEN user_id % 2 = 0 THEN CASE WHEN until - first >= 7200000 THEN first + 7200000 * ((until - first) // 7200000) END WHEN first + 86400000 <= until THEN first + 86400000 END AS last_due FROM u""")
def timer_runs(spark, sf_dir):
    """Users' first events set jobs up, every two hours or once after a day, their last ones take one in three down: the runs that timers made."""
    use_state_store(spark)
    at = keep_folder(spark, f"{work_folder(spark)}/streams/{uuid.uuid4()}")
    own = Window.partitionBy("user_id")
    first, last = F.min("ts").over(own), F.max("ts").over(own)
    action = F.when(F.col("ts") == first, "add").when((F.col("ts") == last) & (F.col("user_id") % 3 == 0), "remove").otherwise("seen")
    kind = F.when(F.col("user_id") % 2 == 0, "every").otherwise("at")
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("job"), "ts", action.alias("action"), kind.alias("kind"), (F.unix_millis(first) + 86_400_000).alias("at_ms"),
        F.lit(7_200_000).cast("long").alias("every_ms"), F.lit(None).cast("string").alias("expr"), F.lit(None).cast("string").alias("zone"), (F.col("user_id") % 5 == 0).alias("once"),
    )
    rows.repartition(spark.sparkContext.defaultParallelism, "job").write.parquet(f"{at}/in")
    out = run_once(runs(spark.readStream.schema(rows.schema).parquet(f"{at}/in"), delay="1 day"))
    per = out.groupBy("job").agg(F.count("*").alias("runs"), F.max("due_ms").alias("last_due"))
    return rows.select("job").distinct().join(per, "job", "left").select("job", F.coalesce("runs", F.lit(0).cast("long")).alias("runs"), "last_due")
