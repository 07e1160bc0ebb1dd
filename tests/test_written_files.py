"""Files written by tasks, a file for each name."""

from pathlib import Path

from pyspark.sql import functions as F

from hushframe.plans import registry
from hushframe.sources import session_files, sessions, storage, tables


def test_rows_of_a_file_go_to_it_in_order(spark, tmp_path):
    rows = spark.createDataFrame([("a.txt", 1, "one"), ("d/b.txt", 1, "ü\nx"), ("a.txt", 2, ""), ("a.txt", 3, None), ("a.txt", 4, "two")], "file string, n int, line string")
    for _ in range(2):  # a run again replaces its files
        storage.write_files(rows.repartition(4, "file").sortWithinPartitions("file", "n"), f"file://{tmp_path}/out")
    found = {str(p.relative_to(tmp_path / "out")): p.read_text() for p in (tmp_path / "out").rglob("*") if p.is_file()}
    assert found == {"a.txt": "one\n\ntwo\n", "d/b.txt": "ü\nx\n"}
    storage.write_files(rows.limit(0), str(tmp_path / "none"))
    assert list((tmp_path / "none").iterdir()) == []


def test_transcripts_are_written_by_as_many_tasks_as_a_shuffle_has(spark, monkeypatch):
    from hushframe.plans import files

    seen = []

    def write(rows, path):
        seen.append((rows.select(F.spark_partition_id()).distinct().count(), path))
        storage.write_files(rows, path)

    monkeypatch.setattr(files, "write_files", write)
    assert registry.queries()["transcript_lines"](spark, "/root/testdata/sf0.01").count() > 0
    assert seen[0][0] > tables.tasks(spark) // 2
    written = list(Path(seen[0][1].removeprefix("file://")).glob("s*.jsonl"))
    assert max(p.stat().st_size for p in written) > 200_000 and len(written) >= 100


def test_sessions_of_any_name_are_read_again(spark, tmp_path):
    names = ["a/b", "ü:%2F?{x}", "plain", "a b.c\\", "[^]'\"#*=\x7f\n"]
    rows = spark.createDataFrame([(s, i, "user", f"{s}{i}") for s in names for i in range(3)], "session string, idx long, role string, content string")
    for _ in range(2):  # in place of what is there
        sessions.write_sessions(rows, str(tmp_path / "out"))
    assert sorted(tuple(r) for r in session_files.read(spark, str(tmp_path / "out")).select(*rows.columns).collect()) == sorted(tuple(r) for r in rows.collect())
    assert [p.name for p in tmp_path.iterdir()] == ["out"] and spark.read.json(str(tmp_path / "out")).filter(F.col("content") == F.concat("session", "idx")).count() == 15


def test_a_task_opens_some_hundred_files_however_small(tmp_path):
    for i in range(1100):
        (tmp_path / f"s{i}.jsonl").write_text("{}\n")
    sizes = [len(p.files) for p in session_files.SessionReader(str(tmp_path), session_files.TASK_BYTES).partitions()]
    assert sum(sizes) == 1100 and len(sizes) == 3 and max(sizes) <= 512
