import json
import os
import random

import pandas as pd
import pytest
from pyspark.sql import Row

from hushframe.operators.vault import Vault, restore
from hushframe.plans.streams import run_once
from hushframe.streaming import chunks
from hushframe.streaming.dispatch import BLOCK, Dispatcher, Queue, dispatch, in_flight
from hushframe.streaming.jobs import Job, Scheduler, runs
from hushframe.streaming.sessions import SessionSanitizer, canonical_tokens, known_tokens, sanitize_polls, sanitize_stream, use_state_store

SCHEMA = "session string, stream long, seq long, chunk string, last boolean, ts timestamp"


class Feed:
    """A folder that a stream reads, a file a batch."""

    def __init__(self, spark, folder):
        use_state_store(spark)
        self.spark, self.folder, self.files = spark, folder, 0
        (folder / "in").mkdir()

    def run(self, batches, **options):
        """Give the stream some batches of rows (session, stream, seq, chunk, last, minute) and return all that it has written so far."""
        for rows in batches:
            lines = [json.dumps(dict(zip(("session", "stream", "seq", "chunk", "last"), r[:5], strict=True)) | {"ts": f"2024-01-01T{r[5] // 60:02d}:{r[5] % 60:02d}:00Z"}) for r in rows]
            file = self.folder / "in" / f"{self.files:03d}.json"
            file.write_text("\n".join(lines))
            self.files += 1
            os.utime(file, (1_700_000_000 + self.files,) * 2)  # files are taken by their time
        chunks = self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(self.folder / "in"))
        out = sanitize_stream(chunks, **options)
        query = out.writeStream.format("parquet").option("path", str(self.folder / "out")).option("checkpointLocation", str(self.folder / "state"))
        query.trigger(availableNow=True).start().awaitTermination()
        return self.spark.read.schema(out.schema).parquet(str(self.folder / "out"))


def texts(out):
    found = {}
    for r in out.orderBy("session", "stream", "seq").collect():
        found[r.session, r.stream] = found.get((r.session, r.stream), "") + r.emitted
    return found


def test_streams_of_a_session_share_their_tokens(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    first = [("s", 1, 0, "mail jo@", False, 1), ("s", 2, 0, "mail ann@ex.org", True, 1), ("r", 1, 0, "ann@ex.org", True, 1), (None, None, 0, "x@ex.org", True, 1)]
    second = [("s", 1, 1, "ex.org and ann@ex.org", True, 2), ("s", 3, 0, "jo@ex.org", True, 2), ("s", 3, 0, "jo@ex.org", True, 2)]
    out = feed.run([first, second])
    got = texts(out)
    assert got["s", 2] == "mail <<EMAIL_1>>" and got["s", 1] == "mail <<EMAIL_2>> and <<EMAIL_1>>" and got["s", 3] in ("<<EMAIL_2>>", "<<EMAIL_2>><<EMAIL_2>>")
    assert got["r", 1] == "<<EMAIL_1>>" and got[None, -1] == "<<EMAIL_1>>"
    known = {(r.session, r.surface): r.placeholder for r in known_tokens(out).collect()}
    assert known == {("s", "ann@ex.org"): "<<EMAIL_1>>", ("s", "jo@ex.org"): "<<EMAIL_2>>", ("r", "ann@ex.org"): "<<EMAIL_1>>", (None, "x@ex.org"): "<<EMAIL_1>>"}


def test_a_silent_stream_is_closed_by_a_timer(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    out = feed.run([[("s", 1, 0, "call jo@ex.org or jo@", False, 1), ("s", 2, 1, "ex.org, behind a gap", False, 1), ("s", 3, 0, "still open", False, 50)]], idle="10 minutes")
    # By minute 50 the first two have been silent for more than ten; the third still holds back what may go on.
    assert texts(out) == {("s", 1): "call <<EMAIL_1>> or jo@", ("s", 2): "ex.org, behind a gap", ("s", 3): ""}
    out = feed.run([[("t", 1, 0, "later", True, 100)]], idle="10 minutes")
    got = texts(out)
    assert got == {("s", 1): "call <<EMAIL_1>> or jo@", ("s", 2): "ex.org, behind a gap", ("s", 3): "still open", ("t", 1): "later"}
    assert {(r.stream, r.closed) for r in out.filter("closed is not null and session = 's'").collect()} == {(1, "idle"), (2, "idle"), (3, "idle")}
    # A stream of that number may begin anew, and still knows its session's tokens.
    out = feed.run([[("s", 1, 0, "jo@ex.org", True, 101)]], idle="10 minutes")
    assert texts(out)["s", 1] == "call <<EMAIL_1>> or jo@<<EMAIL_1>>" or texts(out)["s", 1].count("<<EMAIL_1>>") == 2


def test_a_stream_starts_from_the_vault_of_its_session(spark, tmp_path):
    vault = spark.createDataFrame([("s", "<<PERSON_7>>", "Ann Lee", ["Ann Lee", "A. Lee"]), ("s", "<<EMAIL_2>>", "jo@ex.org", None)], "session string, placeholder string, canonical string, aliases array<string>")
    out = Feed(spark, tmp_path).run([[("s", 1, 0, "Ann Lee and A. Lee wrote to jo@ex.org, ann@ex.org", True, 1), ("r", 1, 0, "Ann Lee", True, 1)]], vault=vault)
    assert texts(out) == {("s", 1): "<<PERSON_7>> and <<PERSON_7>> wrote to <<EMAIL_2>>, <<EMAIL_3>>", ("r", 1): "Ann Lee"}


def test_any_cut_and_order_restores(spark, tmp_path):
    dice, rows, whole = random.Random(4), [], {}
    people = [f"user{i}@ex{i % 3}.org" for i in range(12)]
    for s in ("a", "b"):
        for stream in range(4):
            text = " ".join(dice.choice(people) if dice.random() < 0.2 else f"word{dice.randrange(50)}" for _ in range(150))
            whole[s, stream] = text
            cuts = sorted(dice.sample(range(1, len(text)), 12))
            parts = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
            rows += [(s, stream, i, p, i == len(parts) - 1, 1) for i, p in enumerate(parts)]
    dice.shuffle(rows)
    out = Feed(spark, tmp_path).run([rows[:40], rows[40:70], rows[70:]])
    got = texts(out)
    assert got.keys() == whole.keys() and not any(p in t for t in got.values() for p in people)
    known = [(r.session, r.surface, r.placeholder) for r in known_tokens(out).collect()]
    assert len({(s, x) for s, x, _ in known}) == len({(s, t) for s, _, t in known}) == len(known)
    df = spark.createDataFrame([(s, i, t) for (s, i), t in got.items()], "session string, i long, text string")
    back = {(r.session, r.i): r.restored for r in restore(df, canonical_tokens(out), "session", ["i"]).collect()}
    assert back == whole


def test_a_ttl_goes_by_the_clock(spark):
    stream = spark.readStream.format("rate").load().selectExpr("'s' AS session", "1L AS stream", "value AS seq", "'x' AS chunk", "false AS last", "timestamp AS ts")
    with pytest.raises(ValueError):
        sanitize_stream(stream, idle="1 minute", ttl="1 hour")


def in_order(events, limit):
    """The actions of events taken one by one, session by session."""
    out = []
    for session in {e[0] for e in events}:
        queue = Queue(limit)
        for _, seq, kind, taken in sorted({e for e in events if e[0] == session}, key=lambda e: e[1]):
            out += [(session, seq, nth, *x) for nth, x in enumerate(queue.take(seq, kind, taken))]
    return sorted(out, key=str)


def test_a_queue_serves_one_turn_at_a_time():
    queue = Queue(limit=2)
    assert queue.take(0, "command") == [(0, "start", 0)] and queue.take(1, "message") == [(1, "inject", 0)]
    assert queue.take(2, "command") == [(2, "inline", 0)] and queue.take(3, "priority") == [(3, "inline", 0)]
    assert queue.take(4, "message") == [(4, "inject", 0)] and queue.take(5, "message") == [(5, "wait", 0)] and queue.take(6, "message") == [(6, "wait", 0)]
    # What waited comes first; what the turn didn't take in goes to the next.
    assert queue.take(7, "done", 1) == [(7, "end", 0), (5, "start", 5), (4, "inject", 5)]
    assert queue.take(8, "done", None) == [(8, "end", 5), (6, "start", 6)] and queue.take(9, "done") == [(9, "end", 6)]
    assert queue.take(10, "done") == [] and queue.take(11, "unheard of") == [] and queue.take(12, "priority") == [(12, "inline", None)]
    assert queue.take(13, None) == []


class Counted(dict):
    """Value and map state of one session that counts how often it is asked."""

    asked = 0

    def __call__(self, *_):
        return self

    getValueState = getMapState = __call__  # noqa: N815

    def get(self, key=None):
        self.asked += 1
        return super().get(key)

    def update(self, value):
        self.updateValue(None, value)

    def updateValue(self, key, value):  # noqa: N802
        self.asked += 1
        self[key] = value

    def removeKey(self, key):  # noqa: N802
        self.asked += 1
        self.pop(key, None)

    getValue = get  # noqa: N815


def test_early_events_ask_their_state_by_the_block():
    state, event, out = Counted(), Row("session", "seq", "kind", "taken"), []
    dispatcher = Dispatcher(2)
    dispatcher.init(state)
    dice = random.Random(5)
    events = [event("a", seq, dice.choice(("message", "done", "priority", None)), dice.choice((None, 0, 1))) for seq in range(6 * BLOCK)]
    order = [*events[1:], events[0], *events[:3]]
    for batch in (order[::2], order[1::2]):
        for row in dispatcher.handleInputRows(("a",), iter(batch), None):
            out += zip([row.session] * len(row.at), row.at, row.nth, row.seq, row.action, row.turn, strict=True)
    assert sorted(out, key=str) == in_order([tuple(e) for e in events], 2)
    # Two batches over six blocks; an event at a time it would be thousands of calls.
    assert state.asked <= 40 and list(state) == [None]


def test_sessions_are_taken_in_order_whatever_order_they_come_in(spark, tmp_path):
    use_state_store(spark)
    dice = random.Random(6)
    events = [(s, seq, dice.choices(("message", "command", "priority", "done"), (6, 1, 1, 3))[0], dice.choice((None, 0, 1, 2))) for s in ("a", "b", "c", None) for seq in range(60)]
    want = in_order(events, 3)
    rows = [*events, *dice.sample(events, 20)]  # some come twice
    dice.shuffle(rows)
    (tmp_path / "in").mkdir()
    for i in range(5):
        file = tmp_path / "in" / f"{i}.json"
        file.write_text("\n".join(json.dumps(dict(zip(("session", "seq", "kind", "taken"), r, strict=True))) for r in [*rows[i::5], (None, None, "done", None)]))
        os.utime(file, (1_700_000_000 + i,) * 2)
    stream = spark.readStream.schema("session string, seq long, kind string, taken long").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    out = run_once(dispatch(stream, limit=3))
    assert sorted(((r.session, r.at, r.nth, r.seq, r.action, r.turn) for r in out.collect()), key=str) == want
    # No session ever has two turns in flight.
    turns = {}
    for session, _, _, _, action, turn in sorted(want, key=lambda r: (str(r[0]), r[1], r[2])):
        if action == "start":
            assert turns.get(session) is None
            turns[session] = turn
        elif action == "end":
            assert turns.pop(session) == turn
    assert {r.session: r.turn for r in in_flight(out).collect()} == turns


HOUR = 3_600_000


def test_a_job_by_itself():
    job = Job()
    assert job.act("enable", 0, {}) == [] and job.act("run", 0, {}) == [] and job.advance(10, True) == []
    job.act("add", 5, {"kind": "every", "every_ms": 10})
    assert job.advance(14, True) == [] and job.advance(36, True) == [(15, 1, "timer"), (25, 2, "timer"), (35, 3, "timer")]
    job.act("disable", 40, {})
    assert job.advance(100, True) == []
    job.act("enable", 100, {})
    assert job.next_run == 110 and job.advance(150, False) == [(110, 4, "timer")] and job.next_run == 160
    assert job.act("run", 155, {}) == [(155, 5, "manual")] and job.next_run == 165
    job.act("remove", 156, {})
    assert job.advance(1000, True) == [] and job.gone
    for once in (True, False):
        job = Job()
        job.act("add", 0, {"kind": "at", "at_ms": 7, "once": once})
        assert job.advance(7, True) == [(7, 1, "timer")] and job.advance(99, True) == [] and job.gone == once and not job.enabled
    job.act("add", 8, {"kind": "at", "at_ms": 7})
    assert job.next_run is None
    job.act("add", 0, {"kind": "cron", "expr": "30 * * * *", "zone": "UTC"})
    assert [due for due, _, _ in job.advance(2 * HOUR, True)] == [HOUR // 2, HOUR + HOUR // 2]
    job.act("add", 0, {"kind": "cron", "expr": "nonsense"})
    assert job.next_run is None and job.act("unheard of", 0, {}) == []


def test_jobs_run_once_each_over_batches(spark, tmp_path):
    use_state_store(spark)
    (tmp_path / "in").mkdir()
    add = lambda job, minute, **more: {"job": job, "ts": f"2024-01-01T{minute // 60:02d}:{minute % 60:02d}:00Z", "action": "add"} | more
    batches = [
        [add("a", 0, kind="every", every_ms=10 * 60_000), add("b", 1, kind="at", at_ms=1704067200000 + 30 * 60_000, once=True), add("c", 2, kind="every", every_ms=60_000, **{"action": "disable"})],
        [add("a", 25, action="disable"), add("a", 28, action="enable"), add("d", 20, kind="at", at_ms=1704067200000 + 21 * 60_000)],
        [add("a", 26, action="remove"), add("z", 60, action="seen"), {"job": None, "ts": None, "action": "add"}],
        [add("z", 90, action="seen")],
    ]
    for i, rows in enumerate(batches):
        file = tmp_path / "in" / f"{i}.json"
        file.write_text("\n".join(map(json.dumps, rows)))
        os.utime(file, (1_700_000_000 + i,) * 2)
    schema = "job string, ts timestamp, action string, kind string, at_ms long, every_ms long, expr string, zone string, once boolean"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    out = run_once(runs(stream, delay="5 minutes"))
    got = sorted((r.job, (r.due_ms - 1704067200000) // 60_000, r.run) for r in out.collect())
    # a: every ten minutes up to its pause, then from its return on; the action that came too late does nothing
    assert got == [("a", 10, 1), ("a", 20, 2), *[("a", 28 + 10 * k, 2 + k) for k in range(1, 6)], ("b", 30, 1), ("d", 21, 1)]


def test_polls_of_tools(spark, tmp_path):
    use_state_store(spark)
    (tmp_path / "in").mkdir()
    poll = lambda seq, result, tool="write_stdin", session_id="7", **more: {"session": "s", "tool": tool, "session_id": session_id, "seq": seq, "result": result} | more
    batches = [
        [poll(0, "mail jo@\nProcess running. session_id: 7", "exec", None), poll(2, "bye\nExit code: 0"), poll(0, "ann@ex.org", "grep", None, call_id="c1"), poll(5, "jo@ex.org alone", "shell", None)],
        [poll(1, "ex.org now\nProcess running. session_id: 7"), poll(0, None, "grep", None, call_id="c2"), poll(0, "Exit code: 1", "exec", "9")],
    ]
    for i, rows in enumerate(batches):
        file = tmp_path / "in" / f"{i}.json"
        file.write_text("\n".join(map(json.dumps, rows)))
        os.utime(file, (1_700_000_000 + i,) * 2)
    schema = "session string, tool string, call_id string, session_id string, stream_id string, seq long, result string"
    out = run_once(sanitize_polls(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))))
    found = {}
    for r in out.orderBy("stream", "seq").collect():
        found.setdefault(r.stream, []).append(r.shown)
    tokens = {r.surface: r.placeholder for r in known_tokens(out).collect()}
    assert set(tokens) == {"ann@ex.org", "jo@ex.org"} and len(set(tokens.values())) == 2
    jo, ann = tokens["jo@ex.org"], tokens["ann@ex.org"]
    # A poll's end is held back while its session runs; what was cut between two polls is one address.
    running = next(v for v in found.values() if len(v) == 3)
    assert "".join(x.replace("Process running. session_id: 7", "").rstrip("\n") for x in running[:2]) + running[2] == f"mail {jo} nowbye\nExit code: 0"
    assert all(x.endswith("Process running. session_id: 7") for x in running[:2]) and "@" not in "".join(running)
    assert sorted(v[0] for v in found.values() if len(v) == 1) == sorted([ann, f"{jo} alone", "", "Exit code: 1"])


def test_streams_of_a_group_are_cut_apart(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(chunks, "GROUPS", 1)  # all streams, over two batches, share one group's state
    schema = "session string, stream long, seq long, chunk string, last boolean"
    first = [("a", 1, 1, "SON_1>> x <", False), ("a", 1, 0, "to <<PER", False), ("b", 1, 0, "no <<", False), (None, 2, 0, "one", True), (None, 2, 0, "one", True)]
    then = [("a", 1, 2, "<ORG_2>>", True), ("b", 1, 1, "A_7>> end", True), ("b", 1, 0, "no <<", False)]
    for i, rows in enumerate((first, then)):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    chunks.whole_tokens(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = {}
    for r in sorted(spark.read.parquet(f"{tmp_path}/out").collect(), key=lambda r: r.seq):
        got.setdefault((r.session, r.stream), []).append(r.piece)
    assert got == {("a", 1): ["to ", "<<PERSON_1>> x ", "<<ORG_2>>"], ("b", 1): ["no ", "<<A_7>> end"], (None, 2): ["one"]}


class _Held:
    def __init__(self):
        self.value, self.timers = None, []

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)


def test_rows_that_do_nothing_only_tell_the_time():
    held, scheduler = _Held(), Scheduler(True)
    scheduler.state = scheduler.handle = held
    what = {"action": "add", "kind": "every", "at_ms": None, "every_ms": 10, "expr": None, "zone": None, "once": False}
    row = Row("job", "ms", "what")
    take = lambda *rows: [tuple(r) for r in scheduler.handleInputRows(("j",), iter([row("j", *x) for x in rows]), None)]
    # All runs of a batch leave as one row; those that come late or tell of no time that has passed give none.
    assert take((35, None), (5, what), (7, None), (26, None)) == [("j", [15, 25, 35], [1, 2, 3], ["timer"] * 3)] and held.timers == [45]
    assert take((20, None), (30, what | {"action": "remove"})) == [] and take((44, None)) == []
    assert take((50, what | {"action": "run"}), (50, None), (61, None)) == [("j", [45, 50, 60], [4, 5, 6], ["timer", "manual", "timer"])]
    assert take((62, what | {"action": "remove"}), (99, None)) == [] and held.timers == [45, 45, 45, 70]


class _State:
    """Maps and timers of one session that count how often all of a map is read."""

    def __init__(self):
        self.maps, self.timers, self.read = {}, [], 0

    def getMapState(self, name, *_):  # noqa: N802
        return self.maps.setdefault(name, _Map(self))

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)


class _Map(Counted):
    def __init__(self, of):
        self.of = of

    def exists(self):
        return bool(self)

    def iterator(self):
        self.of.read += 1
        return iter(list(self.items()))


class _Time:
    def __init__(self, mark):
        self.mark = mark

    def getExpiryTimeInMs(self):  # noqa: N802
        return self.mark

    getCurrentWatermarkInMs = getExpiryTimeInMs  # noqa: N815


def test_one_timer_closes_all_streams_of_a_session_that_are_silent():
    state, sanitizer = _State(), SessionSanitizer(10, None, by_event=True)
    sanitizer.init(state)
    rows = [(7, 2, "never came", 1000), *((n, 0, f"jo@ex.org and {n}", 1000 + n) for n in range(300))]
    part = pd.DataFrame([(n, seq, text, False, at, None) for n, seq, text, at in rows], columns=["stream", "seq", "chunk", "last", "at", "trailer"])
    list(sanitizer.handleInputRows(("s",), iter([part[part["stream"] != 7]]), None))
    list(sanitizer.handleInputRows(("s",), iter([part[part["stream"] == 7].drop(index=0), part[:1].assign(seq=2)]), None))
    assert len(state.timers) == 2 and len(state.maps["streams"]) == 300
    state.read = 0
    closed = pd.concat(sanitizer.handleExpiredTimer(("s",), _Time(1209), _Time(1010)))
    # 200 streams at once, in the order in which they fell silent; what waited behind a gap follows; the others have one timer more.
    assert closed["stream"].tolist() == list(range(200)) and set(closed["closed"]) == {"idle"}
    assert closed["emitted"].tolist() == [f"<<EMAIL_1>> and {n}" + ("never came" if n == 7 else "") for n in range(200)]
    assert state.timers[2:] == [1210] and len(state.maps["streams"]) == 100 and not state.maps["waiting"] and state.read <= 3
    # A timer that comes for nothing doesn't read the vault.
    assert list(sanitizer.handleExpiredTimer(("s",), _Time(1209), _Time(1017))) == [] and state.read <= 4


def test_known_surfaces_are_found_as_by_looking_for_each():
    dice = random.Random(9)
    parts = ["jo@", "ex.org", "+1 (555) ", "123-4567", "$5", "0", "Ann", " Lee", "\U0001f4b3", "\ud83d", "/usr", "e", "http://x", " "]
    word = lambda most: "".join(dice.choices(parts, k=dice.randint(1, most)))
    for bare in (False, True):
        vault = Vault()
        for i in range(150):
            surface = word(5) if bare else word(3) + "$5" + word(2)
            vault.hold(surface, f"<<ENTITY_{i}>>")
        for _ in range(200):
            text = word(12) if dice.random() < 0.7 else dice.choice(["", "e", "plain words", " Lee"])
            assert sorted(vault.within(text)) == sorted(s for s in vault.by_surface if s in text)
