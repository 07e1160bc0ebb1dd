import base64

from hushframe.sources import sessions


def test_session_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"_type": "metadata", "created_at": "2024", "last_consolidated": 3}\n{"role": "user", "content": "hi"}\nbroken {\n{"role": "assistant", "content": "yes"}\n')
    (tmp_path / "b.jsonl").write_text('{"role": "user", "content": "ho"}\n')
    got = [(r.session, r.idx, r.role, r.content) for r in sessions.read_sessions(spark, str(tmp_path)).orderBy("session", "idx").collect()]
    assert got == [("a", 0, "user", "hi"), ("a", 1, "assistant", "yes"), ("b", 0, "user", "ho")]
    assert [(r.session, r.last_consolidated) for r in sessions.read_metadata(spark, str(tmp_path)).collect()] == [("a", 3)]
    assert sorted((r.file[-7:], r.broken) for r in sessions.broken_lines(spark, str(tmp_path)).collect()) == [("a.jsonl", 1), ("b.jsonl", 0)]
    sessions.write_sessions(sessions.read_sessions(spark, str(tmp_path)), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3


def test_history_cursor(spark):
    history = spark.createDataFrame([("1", "a"), ("x", "b"), ("7", "c")], "cursor string, content string")
    new = spark.createDataFrame([("d", 1), ("e", 2)], "content string, at int")
    assert [(r.cursor, r.content) for r in sessions.append_history(history, new, "at").orderBy("at").collect()] == [(8, "d"), (9, "e")]
    assert [r.content for r in sessions.unread(history, 1).collect()] == ["c"]


def test_long_history_entries(spark):
    history = spark.createDataFrame([("1", "a")], "cursor string, content string")
    new = spark.createDataFrame([("x" * 20_000 + "end", 1), ("y" * 64_000, 2), ("z" * 64_001, 3), (None, 4)], "content string, at int")
    got = [r.content for r in sessions.append_history(history, new, "at").orderBy("at").collect()]
    assert got == ["x" * 20_000 + "end", "y" * 64_000, "z" * 64_000 + sessions.CUT, None]


def test_data_urls(spark):
    url = "data:text/plain;charset=utf-8;base64," + base64.b64encode("grüße".encode()).decode()
    df = spark.createDataFrame([(url,), ("http://x",), ("data:image/png;base64,AAAA",)], "url string")
    rows = sessions.data_urls(df, "url").collect()
    assert [(r.mime, r.document) for r in rows] == [("text/plain", "grüße"), (None, None), ("image/png", None)]
