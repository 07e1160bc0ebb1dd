import time

from pyspark.sql import functions as F

from hushframe.operators import guarded, turn_pipeline
from hushframe.operators.guarded import Switches, Worker

VAULT = "session string, placeholder string, entity_type string, canonical string, aliases array<string>, value double, created_turn long, last_seen_turn long"
TURNS = "session string, turn long, text string"


def detector(text):
    if "hang" in text:
        time.sleep(3)
    if "boom" in text:
        raise RuntimeError("no model")
    if "odd" in text:
        return [("jo@ex.org", 5)]
    if "null" in text:
        return None
    return [(" jo@ex.org ", "EMAIL"), ("Zoe", "person"), ("Ann", "robot"), ("Ann", "person")]


def test_calls_fail_alone_and_in_time():
    started = time.monotonic()
    got = guarded._calls(detector, ["jo@ex.org", "hang", "boom", "odd", "null", "hang", "x"], 0.5, 2)
    assert time.monotonic() - started < 2.5
    assert [(failed, reason) for _, failed, reason in got] == [(False, None), (True, "timeout"), (True, "RuntimeError"), (True, "TypeError"), (True, "TypeError"), (True, "timeout"), (False, None)]
    assert [len(e) for e, _, _ in got] == [4, 0, 0, 0, 0, 0, 4] and guarded._calls(detector, [], 1, 3) == []


def test_a_text_goes_out_only_if_all_its_chunks_were_read(spark):
    rows = [("s", 1, "Ann wrote to jo@ex.org"), ("s", 2, "x" * 30 + " boom"), ("s", 3, "plain"), ("s", 4, None), ("s", 5, ""), (None, None, "jo@ex.org"), ("s", 6, "odd jo@ex.org")]
    turns, empty = spark.createDataFrame(rows, TURNS), spark.createDataFrame([], VAULT)
    done, after, traces = guarded.sanitize(turns, empty, detector, F.lit("grep"), chunk_chars=25)
    got = {(r.session, r.turn): (r.sanitized, r.failed) for r in done.collect()}
    note = "[tool output omitted; privacy detection failed on one or more chunks for tool 'grep']"
    assert got == {("s", 1): ("<<PERSON_1>> wrote to <<EMAIL_1>>", False), ("s", 2): (note, True), ("s", 3): ("plain", False), ("s", 4): (None, False), ("s", 5): ("", False), (None, None): ("<<EMAIL_1>>", False), ("s", 6): (note, True)}
    # What a model made up, or gave a type that isn't one, is nobody.
    assert {(r.session, r.canonical) for r in after.collect()} == {("s", "Ann"), ("s", "jo@ex.org"), (None, "jo@ex.org")}
    assert {(r.turn, r.idx): r.reason for r in traces.collect() if r.failed} == {(2, 1): "RuntimeError", (6, 0): "TypeError"}
    opened, _, _ = guarded.sanitize(turns, empty, detector, fail_open=True, chunk_chars=25)
    # Open to failure, a text that failed goes out, with what other texts made known replaced.
    assert {r.turn: r.sanitized for r in opened.filter("session = 's'").collect()}[6] == "odd <<EMAIL_1>>"


def test_switches(spark):
    name = "hushframe.privacy"
    assert Switches.of(spark) == Switches(True, False)
    for told, want in (("false", False), ("FALSE ", False), ("off", True), ("", True), ("true", True)):
        spark.conf.set(name, told)
        assert Switches.of(spark).privacy is want
    spark.conf.unset(name)
    spark.conf.set("hushframe.visual", "true")
    assert Switches.of(spark).visual
    spark.conf.unset("hushframe.visual")


def test_workers_share_the_vault(spark):
    turns = spark.createDataFrame([("s", 1, "sum $5 of jo@ex.org"), ("s", 2, "hello jo@ex.org"), ("s", 3, "other")], TURNS)

    def math(rows, entities):
        done, after = turn_pipeline.prepare(rows, entities)
        return done.withColumn("remote_text", F.concat("remote_text", F.lit(" [compute]"))), after

    workers = {"math": Worker(prepare=math), "chat": Worker()}
    intent = F.when(F.col("text").startswith("sum"), "math").when(F.col("text") == "other", "unheard of").otherwise("chat")
    done, after = guarded.prepare(turns, spark.createDataFrame([], VAULT), workers, intent)
    assert {r.turn: (r.intent, r.remote_text) for r in done.collect()} == {1: ("math", "sum <<FINANCE_1>> of <<EMAIL_1>> [compute]"), 2: ("chat", "hello <<EMAIL_1>>"), 3: ("chat", "other")}
    off, same = guarded.prepare(turns, after, workers, intent, Switches(privacy=False))
    assert {r.turn: r.remote_text for r in off.collect()}[2] == "hello jo@ex.org" and same is after
    answer = spark.createDataFrame([("s", 1, "<python_snippet_1>FINANCE_1 * 2</python_snippet_1> for <<EMAIL_1>>")], TURNS)
    assert workers["math"].finalize(answer, after).first().display_text == "10 for jo@ex.org"


def test_what_a_cut_goes_through_is_found(spark):
    """An address across the end of a chunk gives way as a whole, not its rest alone; the chunks stay as many."""
    from hushframe.plans.values import _unsure

    schema = "session string, placeholder string, entity_type string, canonical string, aliases array<string>, value double, created_turn long, last_seen_turn long"
    text = "x" * 5985 + " write to longname@mail.example.org now"
    turns = spark.createDataFrame([("s", 1, text), ("s", 2, "y" * 5999 + "$ " + "z" * 10)], "session string, turn long, text string")
    done, _, traces = guarded.sanitize(turns, spark.createDataFrame([], schema), _unsure)
    got = {r.turn: r for r in done.collect()}
    assert got[1].sanitized.startswith("x" * 5985 + " write to <<EMAIL_") and got[1].sanitized.endswith(">> now")
    assert not got[1].failed and got[2].failed and traces.filter("failed").count() == 1 and traces.count() == 4
