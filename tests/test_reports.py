from pyspark.sql import functions as F

from hushframe.operators import leak, report


def test_lines_of_tokens(spark):
    rows = [("<<PERSON_2>> and <<EMAIL_1>>, <<PERSON_1>> or <<PERSON_2>>",), ("none",), ("",), (None,)]
    got = [r.l for r in spark.createDataFrame(rows, "t string").select(report.placeholders_line(F.col("t")).alias("l")).collect()]
    assert got == ["`EMAIL` x1 (`<<EMAIL_1>>`), `PERSON` x2 (`<<PERSON_2>>`, `<<PERSON_1>>`)", "", "", ""]


def test_reports_of_turns(spark):
    rows = [("s", 1, "math", "pay <<FINANCE_1>>", True, "<<FINANCE_1>>"), ("s", 2, "chat", "hello", False, None), ("s", 3, "chat", "<<X_1>>", False, "bye"), (None, None, "chat", None, False, "<<X_1>>")]
    turns = spark.createDataFrame(rows, "session string, turn long, intent string, sanitized_input string, was_sanitized boolean, sanitized_output string")
    found = spark.createDataFrame([("s", 1, "financial"), ("s", 1, "Email"), ("s", 1, "email"), (None, None, "robot"), ("t", 9, "email")], "session string, turn long, entity_type string")
    got = {(r.session, r.turn): r.report.split("\n") for r in report.privacy_reports(turns, found, found.filter("entity_type = 'robot'")).collect()}
    title = "### \U0001f512 Privacy Report  "
    none = "├─ Tool-output detections: _none_  "
    assert got["s", 1] == [
        title, "├─ Intent: `math`  ", "├─ Input protection: _sanitized before remote LLM_  ", "│  > `FINANCE` x1 (`<<FINANCE_1>>`)  ", "├─ Newly detected this turn: `EMAIL` (high) x2, `FINANCIAL` (high) x1  ",
        none, "├─ Restored in final output: `FINANCE` x1 (`<<FINANCE_1>>`)  ", "└─ Status: _tokens restored for display_",
    ]
    assert got["s", 2] == [title, "├─ Intent: `chat`  ", "├─ Input protection: _no placeholders sent to the remote LLM_  ", "├─ Newly detected this turn: _none_  ", none, "└─ Status: _no restoration needed_"]
    assert got["s", 3][2:4] == ["├─ Input protection: _placeholder-preserving input_  ", "│  > `X` x1 (`<<X_1>>`)  "] and got["s", 3][-1] == "└─ Status: _nothing restored in final output_"
    assert got[None, None][3:] == ["├─ Newly detected this turn: `ROBOT` (medium) x1  ", "├─ Tool-output detections: `ROBOT` (medium) x1  ", "├─ Restored in final output: `X` x1 (`<<X_1>>`)  ", "└─ Status: _tokens restored for display_"] or got[None, None][3] == "├─ Newly detected this turn: `ROBOT` (medium) x1  "
    assert len(got) == 4


def test_rollup_of_long_documents(spark):
    sessions = spark.createDataFrame([("a", 3, 0), ("b", 1, 1), ("c", None, None), ("d", 6, 2)], "session string, chunks_total long, chunks_failed long")
    seams = spark.createDataFrame([("a", 10), ("a", 300), ("d", 301)], "session string, distance long")
    carried = spark.createDataFrame([("a", True), ("d", False), ("d", True), ("d", None)], "session string, carried boolean")
    got = leak.long_rollup(sessions, seams, carried, band=300).first().asDict()
    assert got == {
        "sessions": 4, "chunker_activated": 2, "chunks_failed_sessions": 2, "p50_chunks": 3.0, "max_chunks": 6, "seam_leaks": 3, "seam_leaks_within_overlap": 2,
        "cross_path_checked": 4, "cross_path_carried": 2, "cross_path_rate": 0.5,
    }
    none = leak.long_rollup(sessions.limit(0), seams.limit(0), carried.limit(0), band=300).first()
    assert none.sessions == none.seam_leaks == none.cross_path_checked == 0 and none.p50_chunks is None and none.cross_path_rate is None


def test_replay_and_timelines(spark):
    rows = [("s", 1, "t1", "a.detect.done", 2, 5, 70), ("s", 1, "t1", "a.detect.done", 1, 9, 50), ("s", 1, "t0", "a.restore.done", 0, 2, None), ("s", 1, "t1", "plain", 3, 20, 1), (None, None, "t9", "x.y.z", 1, 1, None)]
    df = spark.createDataFrame(rows, "session string, turn long, trace_id string, event_type string, sequence int, s int, duration_ms long").withColumn("timestamp", F.timestamp_seconds("s"))
    got = {(r.session, r.turn): r for r in report.turn_timelines(df, ["session", "turn"]).collect()}
    one = got["s", 1]
    assert (one.trace_id, one.events, one.total_duration_ms, one.stage_durations_ms) == ("t0", 4, 18_000, {"detect": 70, "plain": 1})
    assert (got[None, None].total_duration_ms, got[None, None].stage_durations_ms) == (0, {}) and len(got) == 2
    placed = {(r.session, r.sequence): r.place for r in report.replay(df, ["session"]).collect()}
    assert placed == {("s", 0): 1, ("s", 1): 2, ("s", 2): 3, ("s", 3): 4, (None, 1): 1}


def test_spans_of_tokens(spark):
    from hushframe.functions import grammar
    from hushframe.operators.vault import protected

    texts = ["<<A_1>><<B_2>> x <<C_D_33>>", "none", "", "\U0001f512 <<A_1>>", "<<a_1>> <<A_1"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string").select("i", grammar.spans(F.col("t")).alias("s")).orderBy("i").collect()
    assert [[tuple(x) for x in r.s] for r in rows[:-1]] == [protected(t) for t in texts] and rows[-1].s is None
