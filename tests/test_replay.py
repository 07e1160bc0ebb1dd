import json

import pytest

from hushframe.operators import replay
from hushframe.operators.replay import Thread

EDIT = {"version": 1, "call_id": "call-write", "tool": "write_file", "path": "foo.txt", "phase": "end", "added": 2, "deleted": 1, "approximate": False, "status": "done"}


def fold(*records, **hooks):
    thread = Thread(**hooks)
    for i, r in enumerate(records):
        thread.take(i, r)
    return thread.done()


def user(text="q"):
    return {"event": "user", "text": text}


def hint(text, *events, kind="tool_hint"):
    return {"event": "message", "kind": kind, "text": text} | ({"tool_events": list(events)} if events else {})


def call(phase, name="write_file", call_id="call-write", **more):
    return {"phase": phase, "call_id": call_id, "name": name, "arguments": {"path": "foo.txt", "content": "hello\n"}} | more


def edits(**changes):
    return {"event": "file_edit", "edits": [EDIT | changes]}


def test_chunks_and_the_end_of_a_turn():
    got = fold(user(), {"event": "reasoning_delta", "text": "think"}, {"event": "reasoning_end"}, {"event": "delta", "text": "a"}, {"event": "stream_end"}, {"event": "turn_end", "latency_ms": 42})
    assert [(m.role, m.content, m.reasoning, m.latency) for m in got] == [("user", "q", None, None), ("assistant", "a", "think", 42)]


def test_the_final_text_of_a_stream_counts():
    got = fold(user(), {"event": "delta", "text": "x"}, {"event": "stream_end", "text": "![D](/m)"}, {"event": "stream_end", "text": "more"})
    assert [m.content for m in got] == ["q", "![D](/m)", "more"]


@pytest.mark.parametrize(("name", "kind"), [("intro.mp4", "video"), ("chart.svg", "image"), ("index.html", "file"), ("", "file")])
def test_media_of_an_answer(name, kind):
    record = {"event": "message", "text": "ready", "media_urls": [{"url": "/old", "name": name}, {"name": "no url"}, "x"]}
    assert fold(user(), record)[1].media == [{"kind": kind, "url": "/old", "name": name}]
    signed = lambda paths: [{"kind": "video", "url": "/new/" + paths[0].split("/")[-1], "name": "intro.mp4"}]
    assert fold(user(), record | {"media": ["/tmp/intro.mp4"]}, assistant_media=signed)[1].media[0]["url"] == "/new/intro.mp4"
    assert fold(user(), record | {"media": ["/tmp/intro.mp4"]}, assistant_media=lambda p: [])[1].media == []
    # After media, what repeats the answer is left out until the turn ends.
    got = fold(record, {"event": "delta", "text": "ready"}, hint("late"), {"event": "stream_end", "text": "ready"}, {"event": "turn_end"}, {"event": "delta", "text": "next"})
    assert [m.content for m in got] == ["ready", "next"]


def test_an_edit_stands_apart_from_a_plain_hint():
    got = fold(user(), hint('write_file({"path":"foo.txt"})'), edits())
    assert [m.trace for m in got] == [False, True, True] and got[1].traces == ['write_file({"path":"foo.txt"})'] and not got[1].edits
    assert got[2].traces == [] and list(got[2].edits.values()) == [EDIT] and got[2].segment not in (None, got[1].segment)


def test_an_edit_takes_the_place_of_its_call():
    got = fold(hint("x", call("start")), edits(phase="start"), hint("", call("end", result="ok"), kind="progress"))
    assert len(got) == 1 and got[0].traces == [] and got[0].events == {} and got[0].content == "" and list(got[0].edits.values()) == [EDIT | {"phase": "start"}]


def test_an_answer_that_work_interrupts_was_reasoning():
    got = fold({"event": "delta", "text": "I will look."}, {"event": "stream_end"}, hint('exec({"cmd":"ls"})'), {"event": "stream_end", "text": "Done."})
    assert [(m.role, m.content, m.reasoning) for m in got] == [("assistant", "", "I will look."), ("tool", 'exec({"cmd":"ls"})', None), ("assistant", "Done.", None)]


def test_calls_are_told_once_and_keep_their_latest_phase():
    run, read = {"name": "exec", "call_id": "a", "arguments": {"cmd": "ls"}}, {"name": "read_file", "call_id": "b", "arguments": {"path": "notes.md"}}
    got = fold(hint("x", run | {"phase": "start"}), hint("", run | {"phase": "end", "result": "ok"}, read | {"phase": "end"}, kind="progress"), hint("", run | {"phase": "start"}))
    assert len(got) == 1 and got[0].traces == ['exec({"cmd": "ls"})', 'read_file({"path": "notes.md"})']
    assert [(e["phase"], e.get("result")) for e in got[0].events.values()] == [("end", "ok"), ("end", None)]
    got = fold(hint("", run | {"phase": "start"}), hint("", run | {"phase": "error", "error": "not found"}))
    assert got[0].traces == ['exec({"cmd": "ls"})'] and next(iter(got[0].events.values()))["error"] == "not found"
    named = {"phase": "end", "function": {"name": "grep", "arguments": '{"q":1}'}}
    assert fold(hint("", named, {"phase": "thinking", "name": "x"}, "junk"))[0].traces == ['grep({"q":1})'] and fold(hint("text", {"phase": "x", "name": "y"}))[0].traces == ["text"]


def test_an_edit_that_goes_on_after_other_work_is_one():
    got = fold(user("edit"), hint("w"), edits(phase="start", added=12, status="editing"), hint("still working", kind="progress"), edits(added=30))
    held = [m for m in got if m.edits]
    assert len(held) == 1 and list(held[0].edits.values()) == [EDIT | {"added": 30}]


def test_a_pending_edit_gets_its_path():
    got = fold(user(), edits(path="", phase="start", pending=True), edits(added=12))
    assert [list(m.edits.values()) for m in got[1:]] == [[EDIT | {"added": 12}]]


def test_edits_and_reasoning_keep_their_order():
    got = fold(user(), edits(call_id="one", path="one.txt"), {"event": "reasoning_delta", "text": "Check next."}, {"event": "reasoning_end"}, edits(call_id="two", path="two.txt"))
    assert [next(iter(m.edits.values()))["path"] if m.edits else m.reasoning for m in got[1:]] == ["one.txt", "Check next.", "two.txt"]
    assert len({m.segment for m in got if m.edits}) == 2


def test_reasoning_without_an_answer_goes_unless_work_follows():
    think = [{"event": "reasoning_delta", "text": "hm"}, {"event": "reasoning_end"}]
    assert [m.role for m in fold(user(), *think, {"event": "turn_end"})] == ["user"]
    assert [m.role for m in fold(user(), *think, hint("ls"), {"event": "turn_end"}, user(), *think, {"event": "turn_end"})] == ["user", "assistant", "tool", "user"]
    # reasoning that was never ended stays
    assert len(fold(user(), think[0], {"event": "turn_end"})) == 2


def test_odd_records_change_nothing():
    odd = [{}, {"event": 3}, {"event": ["user"]}, {"event": "delta", "text": 5}, {"event": "reasoning_delta", "text": ""}, {"event": "file_edit", "edits": "x"}, {"event": "file_edit", "edits": [1]}, hint(""), {"event": "turn_end", "latency_ms": "x"}]
    assert fold(*odd) == [] and fold(user(None))[0].content == ""


def test_replay_of_a_table(spark):
    rows = [("a", 2, json.dumps({"event": "delta", "text": "![D](d.png)"})), ("a", 1, json.dumps(user("draw") | {"media_paths": ["x.png", None, "y.png"], "cli_apps": [{"n": 1}, 2]})), ("a", 3, "[1]"), ("a", 4, "{broken"), ("a", 5, None), (None, 1, json.dumps(user("n"))), ("empty", 1, "null")]
    df = spark.createDataFrame(rows, "session string, line_no long, line string")
    signed = lambda paths: [{"kind": "image", "url": "/u/" + p, "name": p} for p in paths]
    out = replay.replay(df, user_media=signed, assistant_text=lambda t: t.replace("d.png", "/api/d"))
    got = {(r.session, r.n): r for r in out.withColumn("images", replay.images(out["media"])).collect()}
    assert set(got) == {("a", 0), ("a", 1), (None, 0)}
    assert got["a", 1].content == "![D](/api/d)" and got["a", 0].apps == '[{"n": 1}]' and got["a", 0].presets is None
    assert [tuple(x) for x in got["a", 0].images] == [("/u/x.png", "x.png"), ("/u/y.png", "y.png")] and got["a", 1].images is None
    whole = {r.session: r for r in replay.threads(out).collect()}
    assert whole["a"].schema_version == 3 and [m.role for m in whole["a"].messages] == ["user", "assistant"]
    assert replay.replay(df.limit(0)).count() == 0


def test_a_long_transcript_takes_time_in_proportion():
    import time

    def seconds(n):
        started = time.time()
        got = fold(*[hint("", call("start", "exec", f"c{i}", arguments=f"{i}")) for i in range(n)], *[r for i in range(n) for r in ({"event": "reasoning_end"}, {"event": "delta", "text": "x"}, {"event": "turn_end"})])
        assert len(got[0].traces) == n and len(got) == n + 1
        return time.time() - started

    assert seconds(40_000) < 5
