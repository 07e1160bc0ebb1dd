import hashlib
import uuid

import pytest

from hushframe.llm import exactdedup
from hushframe.llm.exactdedup import DigestIndex, dedup, judge


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/index"


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def brute(rows):
    """(id, keep_id, group_size, sha) of each row, and the number of rows that stay by text."""
    groups: dict = {}
    for d, t in rows:
        groups.setdefault(t or "", []).append(d)
    best = {t: max((d for d in ids if d is not None), default=None) for t, ids in groups.items()}
    return sorted(((d, best[t or ""], len(groups[t or ""]), sha(t)) for d, t in rows), key=str)


ROWS = [(1, "a"), (2, "a"), (7, "b"), (5, "A"), (None, "a"), (3, None), (4, ""), (None, "only"), (None, "none"), (None, "none"), (9, "é"), (9, "é"), (10, "é"), (11, "a "), (12, "x" * 200_000), (13, "x" * 200_000)]


def test_matches_brute_force_and_keeps_one_row_a_text(spark, path, monkeypatch):
    rows = ROWS + [(100 + i, "hot") for i in range(500)]
    df = spark.createDataFrame([(d, t, 1, "c", i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, digest int, KEPT string, row long").repartition(5)
    answers = []
    for limit in (exactdedup.BROADCAST_BYTES, -1):  # all decisions broadcast; the hot ones alone, the others by shuffle
        monkeypatch.setattr(exactdedup, "BROADCAST_BYTES", limit)
        monkeypatch.setattr(exactdedup, "HOT", 20)
        out = judge(df, DigestIndex(spark, f"{path}{limit}", 3), "one")
        assert out.columns == ["doc_id", "text", "digest", "row", "keep_id", "group_size", "kept", "text_sha256"]
        got = out.collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute(rows)
        stays = [r for r in got if r.kept]
        assert sorted(r.text_sha256 for r in stays) == sorted({sha(t) for _, t in rows}) and all(r.doc_id == r.keep_id for r in stays)
        answers.append(len(got))
    assert answers == [len(rows)] * 2


def test_new_data_meets_the_index(spark, path):
    table = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    first = DigestIndex(spark, path, 4)
    assert sorted(r.doc_id for r in dedup(table([(1, "a"), (2, "b"), (3, "a")]), first, "day 1").collect()) == [2, 3]
    first.close()
    index = DigestIndex(spark, path, 99)  # found again by its path, with the buckets that it was made with
    assert index.buckets == 4 and sorted((r.keep_id, r.copies, r.batch) for r in index.rows().collect()) == [(2, 1, "day 1"), (3, 2, "day 1")]
    second = table([(9, "a"), (8, "c"), (7, "c"), (6, "b"), (6, "b")])
    want = [(6, 2, 3, False), (6, 2, 3, False), (7, 8, 2, False), (8, 8, 2, True), (9, 3, 3, False)]
    for _ in range(2):  # run again under its name, as after a failure, it gets the same answer and adds nothing
        assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in judge(second, index, "day 2").collect()) == want
        assert sorted((r.keep_id, r.batch) for r in index.rows().collect()) == [(2, "day 1"), (3, "day 1"), (8, "day 2")]
    third = table([(20, "c"), (21, "d")])
    assert [(r.doc_id, r.text) for r in dedup(third, index, "day 3").collect()] == [(21, "d")]


def test_the_index_is_not_shuffled(spark, path):
    index = DigestIndex(spark, path, 4)
    digest = exactdedup.digest()
    groups = spark.createDataFrame([(i, str(i)) for i in range(50)], "keep_id long, text string").select(digest.alias("digest"), "keep_id", exactdedup.F.lit(1).cast("long").alias("copies"))
    index.append(groups.limit(30), "one")
    plan = index.missing(groups)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan
    scan = next(i for i, line in enumerate(plan.split("\n")) if "Bucketed: true" in line)
    # above the scan: sort and filter up to the join, no exchange
    above = plan.split("\n")[:scan]
    join = max(i for i, line in enumerate(above) if "SortMergeJoin" in line)
    left = [i for i, line in enumerate(above) if "Exchange" in line and i > join]
    assert len(left) == 1
    assert index.missing(groups).count() == 20
    details = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE FORMATTED {index.name}").collect()}
    assert details["Num Buckets"] == "4" and "digest" in details["Bucket Columns"] and "digest" in details["Sort Columns"]
    assert len(spark.read.parquet(index.path).inputFiles()) <= 4


def test_without_rows(spark, path):
    index = DigestIndex(spark, path, 2)
    df = spark.createDataFrame([], "doc_id long, text string")
    assert judge(df, index, "none").collect() == [] and dedup(df, index, "none").columns == ["doc_id", "text"] and index.rows().count() == 0


def test_no_python_on_the_path(spark, path):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    out = judge(df, DigestIndex(spark, path + uuid.uuid4().hex, 2), "one")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
