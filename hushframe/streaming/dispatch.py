"""Messages of sessions, one turn of a session at a time: an ordered queue for each session as streaming state.

Events of a session carry a number without holes and are taken in its order, whatever order they arrive in; sessions are
independent of each other and run side by side. While a turn is in flight, messages that follow are injected into it, up to
a limit; beyond it they wait for the turn after. When a turn ends, what it hasn't taken in is dealt out anew.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Messages that a running turn may be given (a fixed value).
LIMIT = 20
#: Numbers of early events that lie in one value of the state, and rows of a session that a task holds at a time.
BLOCK, ROWS = 256, 10_000
_BLOCK = "seqs array<long>, kinds array<string>, takens array<long>"
_TOLD, _NONE = Row("session", "at", "nth", "seq", "action", "turn"), object()


class Queue:
    """What a session has in flight: the turn, the messages injected into it, and those that wait for the next."""

    def __init__(self, limit: int = LIMIT, turn: int | None = None, injected: list[int] | None = None, waiting: list[int] | None = None):
        self.limit, self.turn, self.injected, self.waiting = limit, turn, injected or [], waiting or []

    def take(self, seq: int, kind: str, taken: int | None = None) -> list[tuple[int, str, int | None]]:
        """What follows from an event: (message, action, turn).

        kind: 'message'; 'command', which a running turn doesn't hold up; 'priority', which nothing holds up; 'done', the end
        of the turn in flight, which took in the first `taken` injected messages (null: all). Other kinds do nothing.
        """
        if kind == "priority" or (kind == "command" and self.turn is not None):
            return [(seq, "inline", self.turn)]
        if kind in ("message", "command"):
            return [self._deal(seq)]
        if kind == "done" and self.turn is not None:
            return self._end(seq, taken)
        return []

    def _deal(self, seq: int) -> tuple[int, str, int | None]:
        if self.turn is None:
            self.turn = seq
            return seq, "start", seq
        if len(self.injected) < self.limit:
            self.injected.append(seq)
            return seq, "inject", self.turn
        self.waiting.append(seq)
        return seq, "wait", self.turn

    def _end(self, seq: int, taken: int | None) -> list[tuple[int, str, int | None]]:
        left = self.injected[len(self.injected) if taken is None else max(0, taken) :]
        out: list[tuple[int, str, int | None]] = [(seq, "end", self.turn)]
        self.turn, self.injected = None, []
        # Those that waited come first, then what was injected too late; both in the order of their arrival.
        following = self.waiting[:1]
        self.waiting = self.waiting[1:]
        return out + [self._deal(s) for s in following + left]


class Dispatcher(StatefulProcessor):
    """A session's queue; state: events that came too early, in blocks of their numbers, and the number that follows with the queue and its own block, read and written once a batch."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", f"following long, turn long, injected array<long>, waiting array<long>, {_BLOCK}")
        self.early = handle.getMapState("early", "block long", _BLOCK)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        head = self.head.get()
        following, turn, injected, waiting, *near = head if head is not None else (0, None, [], [], [], [], [])
        queue, out = Queue(self.limit, turn, list(injected), list(waiting)), []
        early = _Early(self.early, following // BLOCK, near)
        while part := sorted(islice(rows, ROWS), key=lambda r: r.seq):
            for _, seq, kind, taken in part:
                if seq > following:
                    early.add(seq, kind, taken)
                elif seq == following:
                    while kind is not _NONE:
                        out += [(following, nth, *x) for nth, x in enumerate(queue.take(following, kind, taken))]
                        following += 1
                        kind, taken = early.pop(following)
            near = early.store(following // BLOCK)
            if out:
                # A row for many actions: each row that leaves Python costs as much as taking an event does.
                yield _TOLD(key[0], *map(list, zip(*out, strict=True)))
                out = []
        self.head.update((following, queue.turn, queue.injected, queue.waiting, *near))


class _Early:
    """Events of one session that came too early; of their state it reads and writes whole blocks, each once, and none that isn't asked for."""

    def __init__(self, state, number: int, near: list):
        self.state, self.blocks, self.changed, self.number = state, {number: _opened(near)}, set(), number

    def _block(self, seq: int) -> dict[int, tuple]:
        number = seq // BLOCK
        if number not in self.blocks:
            held = self.state.getValue((number,))
            self.blocks[number] = {} if held is None else _opened(held)
        return self.blocks[number]

    def add(self, seq: int, kind: str | None, taken: int | None) -> None:
        block = self._block(seq)
        if seq not in block:
            block[seq] = (kind, taken)
            self.changed.add(seq // BLOCK)

    def pop(self, seq: int) -> tuple:
        """Kind and taken of an event, which goes; (_NONE, None) if it hasn't come."""
        block = self._block(seq)
        if seq not in block:
            return _NONE, None
        self.changed.add(seq // BLOCK)
        return block.pop(seq)

    def store(self, near: int) -> list:
        """Write what has changed but for the block `near`, and give that back; other blocks are let go."""
        if near != self.number:
            own = self._block(near)
            # It moves out of the map, the one before has been walked through.
            self.changed.add(near)
            self.blocks[near] = {}
        else:
            own = self.blocks[near]
            self.changed.discard(near)
        for number in self.changed - {self.number}:
            if block := self.blocks[number]:
                self.state.updateValue((number,), _closed(block))
            else:
                self.state.removeKey((number,))
        self.blocks, self.changed, self.number = {near: own}, set(), near
        return list(_closed(own))


def _opened(held) -> dict[int, tuple]:
    return {s: (kind, taken) for s, kind, taken in zip(*held, strict=True)}


def _closed(block: dict[int, tuple]) -> tuple[list, list, list]:
    return list(block), [x[0] for x in block.values()], [x[1] for x in block.values()]


def dispatch(events: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Streaming events(session, seq, kind, taken) to actions (session, at, nth, seq, action, turn), as of `Queue.take`.

    seq: from 0 without holes in each session; an event that comes twice counts once. at: the event that an action follows
    from, nth: its place among those; seq: the message it is about; turn: the message that began the turn it belongs to. Null
    sessions are one session; an event without a number is left out, one without a kind does nothing.
    """
    rows = events.select(F.col("session").cast("string").alias("session"), F.col("seq").cast("long").alias("seq"), "kind", F.col("taken").cast("long").alias("taken"))
    told = "session string, at array<long>, nth array<int>, seq array<long>, action array<string>, turn array<long>"
    out = rows.filter("seq is not null").groupBy("session").transformWithState(Dispatcher(limit), told, "append", "None")
    return out.select("session", F.inline(F.arrays_zip("at", "nth", "seq", "action", "turn")))


def in_flight(actions: DataFrame) -> DataFrame:
    """(session, turn): turns that have begun and not ended."""
    of = lambda action: F.max(F.when(F.col("action") == action, F.struct("at", "nth", "turn")))
    last = actions.groupBy("session").agg(of("start").alias("s"), of("end").alias("e"))
    began_last = F.col("e").isNull() | (F.struct("s.at", "s.nth") > F.struct("e.at", "e.nth"))
    return last.filter(F.col("s").isNotNull() & began_last).select("session", F.col("s.turn").alias("turn"))
