import json

import pytest
from pyspark.sql import functions as F

from hushframe.sources import events, session_files
from hushframe.sources.storage import files_below, put_json, read_text, storage

EVENT = "event_id long, event_type string, at timestamp, tags array<string>"


def table_of(spark, ids):
    return spark.createDataFrame([(i, "ab"[i % 2], None, [str(i)]) for i in ids], EVENT)


def ids(df):
    return sorted(r.event_id for r in df.collect())


def test_a_batch_that_is_run_again_counts_once(spark, tmp_path):
    for i in range(3):
        table_of(spark, range(10 * i, 10 * i + 10)).coalesce(2).write.mode("append").parquet(str(tmp_path / "in"))
    sink, state = str(tmp_path / "sink"), tmp_path / "state"
    assert ids(events.read_events(spark, sink, EVENT)) == []

    def run():
        stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        events.write_events(stream, f"file://{sink}", str(state)).trigger(availableNow=True).start().awaitTermination()
        return ids(events.read_events(spark, sink, EVENT))

    assert run() == list(range(30))
    batches = {r.batch: r.rows for r in events.committed(spark, sink).collect()}
    files = len(files_below(f"{sink}/data", ".parquet"))
    assert sum(batches.values()) == 30 and len(batches) == 6
    # The stream forgets that its last batch was committed, as after a failure right then: the batch runs again under its number.
    last = sorted((state / "commits").glob("[0-9]*"), key=lambda p: int(p.name))[-1]
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    assert run() == list(range(30))
    assert {r.batch: r.rows for r in events.committed(spark, sink).collect()} == batches and len(files_below(f"{sink}/data", ".parquet")) > files


def test_tables_append_and_overwrite(spark, tmp_path):
    events.register(spark)
    path = str(tmp_path / "sink")
    table_of(spark, range(5)).write.format("events").mode("append").option("path", path).save()
    table_of(spark, range(5, 8)).write.format("events").mode("append").option("path", path).save()
    assert ids(events.read_events(spark, path, EVENT)) == list(range(8))
    table_of(spark, [99]).write.format("events").mode("overwrite").option("path", path).save()
    assert ids(events.read_events(spark, path, EVENT)) == [99]
    table_of(spark, []).write.format("events").mode("append").option("path", path).save()
    assert ids(events.read_events(spark, path, EVENT)) == [99]


def test_files_of_a_failed_job_count_for_nothing(spark, tmp_path):
    events.register(spark)
    path = str(tmp_path / "sink")
    fails = table_of(spark, range(50)).repartition(4).withColumn("event_id", F.when(F.col("event_id") == 33, F.raise_error(F.lit("broken"))).otherwise(F.col("event_id")))
    with pytest.raises(Exception, match="broken"):
        fails.write.format("events").mode("append").option("path", path).save()
    assert ids(events.read_events(spark, path, EVENT)) == []
    messages = [events._write(path, iter(table_of(spark, [1]).toArrow().to_batches())), events._write(path, iter([])), None]
    assert messages[1].file is None
    events.StreamSink(path).abort(messages, 7)
    assert not [f for f, _ in files_below(f"{path}/data", ".parquet") if messages[0].file in f]


def test_fan_out(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "c")], "event_id long, event_type string")
    subscriptions = spark.createDataFrame([("x", "a", 1), ("y", None, 2), ("x", None, 3), ("z", "b", 4), ("nobody", "q", 5)], "subscriber string, event_type string, place int")
    for limit in (events.BROADCAST_SUBSCRIPTIONS, 0):
        events.BROADCAST_SUBSCRIPTIONS, before = limit, events.BROADCAST_SUBSCRIPTIONS
        got = sorted((r.event_id, r.place) for r in events.fan_out(df, subscriptions).collect())
        events.BROADCAST_SUBSCRIPTIONS = before
        assert got == [(1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (2, 4), (3, 2), (3, 3), (4, 2), (4, 3)]
    assert events.fan_out(df, subscriptions.limit(0)).count() == 0


def test_handlers_get_their_kind_in_order_and_fail_alone(spark, tmp_path):
    table_of(spark, range(6)).coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    handlers = [("a", lambda df, n: seen.append(("a", ids(df)))), (None, lambda df, n: 1 / 0), (None, lambda df, n: seen.append(("all", ids(df))))]
    stream = spark.readStream.schema(EVENT).parquet(str(tmp_path / "in"))
    events.deliver(stream, handlers).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert seen == [("a", [0, 2, 4]), ("all", [0, 1, 2, 3, 4, 5])]


def session_folder(folder):
    lines = {
        "websocket_t1": [{"_type": "metadata", "created_at": "2024-01-01", "last_consolidated": 2}, {"role": "user", "content": "hi"}, {"role": "assistant", "content": None, "tool_calls": [{"id": "c", "function": {"name": "grep"}}]}, {"no": "role"}],
        "empty": [],
        "t2": [{"role": "user", "content": ["blocks"], "name": 3}],
    }
    for name, rows in lines.items():
        (folder / f"{name}.jsonl").write_text("\n".join(map(json.dumps, rows)) + ("\n{broken\n[1]\n" if name == "t2" else ""))
    (folder / "session=a%2Fb").mkdir()
    for part in range(2):
        (folder / "session=a%2Fb" / f"part-{part}.json").write_text(json.dumps({"role": "user", "content": f"m{part}"}))
    (folder / "_SUCCESS").write_text("")
    (folder / ".hidden.jsonl").write_text('{"role": "user"}')
    return str(folder)


def test_a_folder_of_sessions(spark, tmp_path):
    rows = session_files.read(spark, session_folder(tmp_path), task_bytes=1).collect()
    got = {(r.session, r.idx): r for r in rows}
    assert set(got) == {("websocket_t1", 0), ("websocket_t1", 1), ("t2", 0), ("a/b", 0), ("a/b", 1)}
    call = got["websocket_t1", 1]
    assert call.content is None and [tuple(c) for c in call.tool_calls] == [("c", "grep")] and (call.created_at, call.last_consolidated, call.broken) == ("2024-01-01", 2, 0)
    assert got["t2", 0].content == '["blocks"]' and got["t2", 0].name == "3" and got["t2", 0].broken == 2 and got["a/b", 1].content == "m1"
    assert session_files.read(spark, str(tmp_path / "nothing")).count() == 0


def test_a_filter_on_the_session_opens_its_files_alone(spark, tmp_path):
    rows = session_files.read(spark, session_folder(tmp_path))
    (tmp_path / "t2.jsonl").chmod(0)
    one = rows.filter("session = 'websocket_t1' and role = 'user'")
    assert [(r.session, r.content) for r in one.collect()] == [("websocket_t1", "hi")]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo" in plan or "session" in plan.split("PythonDataSource")[-1] or "PushedFilters" in plan
    reader = session_files.SessionReader(str(tmp_path), 1 << 20)
    left = list(reader.pushFilters([session_files.EqualTo(("session",), "t2"), session_files.In(("session",), ("t2", "x")), session_files.EqualTo(("role",), "user"), session_files.StringStartsWith(("session",), "t")]))
    assert [type(f).__name__ for f in left] == ["EqualTo", "StringStartsWith"] and [s for p in reader.partitions() for s, _ in p.files] == ["t2"]
    assert rows.filter("session = 'nobody'").count() == 0 and rows.filter("session in ('a/b', 'empty')").count() == 2


def test_storage(tmp_path):
    assert storage(f"file://{tmp_path}/x/")[1] == storage(f"file:{tmp_path}/x")[1] == storage(f"{tmp_path}/x")[1] == f"{tmp_path}/x"
    put_json(str(tmp_path), "a.json", [1])
    put_json(f"file://{tmp_path}", "a.json", [2])
    files, inner = storage(str(tmp_path))
    assert read_text(files, f"{inner}/a.json") == "[2]" and files_below(str(tmp_path), ".json") == [(f"{tmp_path}/a.json", 3)] and files_below(f"{tmp_path}/none", "") == []
