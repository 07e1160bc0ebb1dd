"""Windows over conversations and event runs: tails, budgets, boundaries, coalescing, suppression."""

from __future__ import annotations

import datetime as dt
import difflib
from functools import lru_cache
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushframe.functions import grammar
from hushframe.sources.tables import keep


def _by(key: str, order: str, desc: bool = False):
    return Window.partitionBy(key).orderBy(F.col(order).desc() if desc else F.col(order))


def tail(messages: DataFrame, key: str, order: str, n: int, role: str = "role") -> DataFrame:
    """The last n messages of each session, from the first message of the user among them on (all of them if there is none)."""
    last = messages.withColumn("_r", F.row_number().over(_by(key, order, desc=True))).filter(F.col("_r") <= n)
    first = F.min(F.when(F.col(role) == "user", F.col(order))).over(Window.partitionBy(key))
    return last.withColumn("_first", first).filter(F.col("_first").isNull() | (F.col(order) >= F.col("_first"))).drop("_r", "_first")


def budget(messages: DataFrame, key: str, order: str, tokens: Column, limit: int) -> DataFrame:
    """The longest suffix of each session within a token budget; the last message stays in any case. Adds tokens and running."""
    back = _by(key, order, desc=True)
    df = messages.withColumn("tokens", tokens).withColumn("running", F.sum("tokens").over(back.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_r", F.row_number().over(back))
    return df.filter((F.col("running") <= limit) | (F.col("_r") == 1)).drop("_r")


def boundary(messages: DataFrame, key: str, order: str, tokens: Column, target: int, role: str = "role") -> DataFrame:
    """Where to cut each session: the first later user turn with at least `target` tokens before it, else the last user turn."""
    before = F.coalesce(F.sum(tokens).over(_by(key, order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = F.min(order).over(Window.partitionBy(key))
    users = messages.withColumn("before", before).withColumn("_start", start).filter((F.col(role) == "user") & (F.col(order) > F.col("_start")))
    return users.groupBy(key).agg(F.coalesce(F.min(F.when(F.col("before") >= target, F.col(order))), F.max(order)).alias("boundary"))


def suffix_counts(messages: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """Messages that `tail` keeps and drops of each session."""
    kept = tail(messages, key, order, n).groupBy(key).agg(F.count("*").alias("kept"), F.min(order).alias("first_kept"))
    return messages.groupBy(key).agg(F.count("*").alias("total")).join(kept, key).withColumn("dropped", F.col("total") - F.col("kept"))


def previews(messages: DataFrame, key: str, order: str, limit: int = 60, role: str = "role", text: str = "text") -> DataFrame:
    """Each session's preview: its first user message, else its first one of the assistant, space collapsed and cut."""
    first = lambda who: F.min_by(F.when(F.col(role) == who, F.col(text)), F.when(F.col(role) == who, F.col(order)))
    shown = F.coalesce(first("user"), first("assistant"))
    return messages.groupBy(key).agg(F.left(grammar.collapse(shown), F.lit(limit)).alias("preview"), F.max(order).alias("last_turn"), F.count("*").alias("messages"))


def runs(rows: DataFrame, key: str, order: list[str], same: Column) -> DataFrame:
    """Number the runs of equal `same` within each key (gaps and islands): adds run."""
    w = Window.partitionBy(key).orderBy(*order)
    df = rows.withColumn("_new", F.when(F.lag(same).over(w).eqNullSafe(same), 0).otherwise(1))
    return df.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def joined_runs(rows: DataFrame, key: str, order: list[str], same: Column, text: str, ends: Column | None = None) -> DataFrame:
    """Deltas put together: a row per run of equal `same`, its texts joined in order. ends: closes a run after the row it holds for.

    Returns (key, run, text, parts). A run is what one receiver gets at once, so its texts are gathered.
    """
    numbered = rows.withColumn("_ends", F.coalesce(ends, F.lit(False)) if ends is not None else F.lit(False))
    w = Window.partitionBy(key).orderBy(*order)
    new = F.lag(same).over(w).eqNullSafe(same) & ~F.coalesce(F.lag("_ends").over(w), F.lit(True))
    df = numbered.withColumn("_new", F.when(new, 0).otherwise(1)).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ordered = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_t"))))
    return df.groupBy(key, "run").agg(F.array_join(F.transform(ordered, lambda x: x["_t"]), "").alias(text), F.count("*").alias("parts"))


def suppress_repeats(rows: DataFrame, keys: list[str], order: list[str], text: str) -> DataFrame:
    """Whether a message repeats the one before it of the same key, space aside: adds fingerprint and suppressed."""
    w = Window.partitionBy(*keys).orderBy(*order)
    df = rows.withColumn("fingerprint", F.sha1(grammar.collapse(F.col(text))))
    return df.withColumn("suppressed", F.coalesce(F.col("fingerprint") == F.lag("fingerprint").over(w), F.lit(False)))


def microcompact(messages: DataFrame, key: str, order: str, compactable: Column, text: str, keep: int = 10, least: int = 500, stub: str | Column = "[cleared]") -> DataFrame:
    """Replace all but the last `keep` compactable messages of a session by a stub where they are long: adds compacted.

    stub: a text, or a column that names what was there, such as the tool.
    """
    place = F.row_number().over(Window.partitionBy(key, compactable).orderBy(F.col(order).desc()))
    df = messages.withColumn("_place", place)
    return df.withColumn("compacted", F.when(compactable & (F.col("_place") > keep) & (F.length(text) >= least), F.lit(stub) if isinstance(stub, str) else stub).otherwise(F.col(text))).drop("_place")


def latest(rows: DataFrame, key: list[str], rank: Column, order: str, value: list[str]) -> DataFrame:
    """The row of highest rank of each key, of equal ranks the latest."""
    return rows.groupBy(*key).agg(F.max_by(F.struct(*value), F.struct(rank, order)).alias("_v")).select(*key, "_v.*")


def orphans(messages: DataFrame, key: str, order: str, is_result: Column, is_call: Column) -> DataFrame:
    """Results that no call declares right before them."""
    calls = messages.filter(is_call).select(key, (F.col(order) + 1).alias(order))
    return messages.filter(is_result).join(calls, [key, order], "left_anti")


def idle(rows: DataFrame, key: str, ts: str, now: Column, minutes: int) -> DataFrame:
    """Sessions whose last event is at least `minutes` before now."""
    last = rows.groupBy(key).agg(F.max(ts).alias("last_seen"), F.count("*").alias("events"))
    return last.withColumn("idle_ms", F.unix_millis(now) - F.unix_millis("last_seen")).filter(F.col("idle_ms") >= minutes * 60_000)


def next_run(kind: Column, at_ms: Column, every_ms: Column, now_ms: Column) -> Column:
    """Next run of an `at` or `every` schedule; null where none is due any more."""
    return F.when((kind == "at") & (at_ms > now_ms), at_ms).when((kind == "every") & (every_ms > 0), now_ms + every_ms)


def _cron_sets(expr: str) -> list[set[int]] | None:
    """Minutes, hours, days, months and weekdays that a schedule of five fields names; None if it doesn't make sense."""
    bounds = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))
    fields = (expr or "").split()
    if len(fields) != 5:
        return None
    out = []
    for field, (low, high) in zip(fields, bounds, strict=True):
        own: set[int] = set()
        for part in field.split(","):
            span, _, step = part.partition("/")
            first, _, last = span.partition("-")
            try:
                start = low if span == "*" else int(first)
                stop = high if span == "*" or (step and not last) else int(last or first)
                every = int(step or 1)
            except ValueError:
                return None
            if every < 1 or not low <= start <= stop <= high:
                return None
            own |= set(range(start, stop + 1, every))
        out.append(own)
    out[4] = {d % 7 for d in out[4]}
    return out


@lru_cache(maxsize=1024)
def _cron_fields(text: str) -> list | None:
    own = _cron_sets(text)
    return own and [sorted(own[0]), sorted(own[1]), *own[2:], text.split()[2] != "*", text.split()[4] != "*"]


def cron_after(text: str | None, ms: int | None, name: str | None) -> int | None:
    """`cron_next` of one schedule."""
    own = _cron_fields(text) if text and ms is not None else None
    if not own:
        return None
    minutes, hours, days, months, weekdays, day_given, weekday_given = own
    tz = ZoneInfo(name or "UTC")
    now = dt.datetime.fromtimestamp(ms / 1000, dt.UTC).astimezone(tz)
    for ahead in range(366 * 5):
        day = now.date() + dt.timedelta(days=ahead)
        by_day, by_week = day.day in days, (day.weekday() + 1) % 7 in weekdays
        if day.month not in months or not (by_day or by_week if day_given and weekday_given else by_day and by_week):
            continue
        for hour in hours:
            for minute in minutes:
                at = dt.datetime(day.year, day.month, day.day, hour, minute, tzinfo=tz)
                utc = at.astimezone(dt.UTC)
                if utc.timestamp() * 1000 > ms and utc.astimezone(tz).replace(tzinfo=None) == at.replace(tzinfo=None):
                    return int(utc.timestamp() * 1000)
    return None


def cron_next(expr: Column, now_ms: Column, zone: Column) -> Column:
    """Next run of a cron schedule after now, in milliseconds: minute, hour, day, month, weekday (0 or 7 for Sunday) in a time zone; null for a wrong one.

    Where both day and weekday are given, either will do. A time that a change of clocks leaves out is skipped, of one that
    comes twice the first counts.
    """
    run = lambda e, n, z: pd.Series([cron_after(x, None if pd.isna(v) else int(v), y) for x, v, y in zip(e, n, z, strict=True)], dtype="Int64")
    return F.pandas_udf(run, "long")(expr, now_ms, zone)


def advanced(jobs: DataFrame, now_ms: Column) -> DataFrame:
    """jobs(id, kind, enabled, at_ms, every_ms, once, next_run) after the due ones ran: a run `at` a time is over (and gone, if once), others have their next run."""
    due = F.coalesce(F.col("enabled") & (F.col("next_run") <= now_ms), F.lit(False))
    over = due & (F.col("kind") == "at")
    rest = jobs.filter(~(over & F.coalesce("once", F.lit(False))))
    following = F.when(over, F.lit(None).cast("long")).when(due, next_run(F.col("kind"), F.col("at_ms"), F.col("every_ms"), now_ms)).otherwise(F.col("next_run"))
    return rest.withColumns({"enabled": F.col("enabled") & ~over, "next_run": following})


def page(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """A page of rows in order, a top-k by design."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def place(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Number all rows from 1 in an order, which has to be total: adds `name`.

    Rows are dealt to ranges of the order, numbered within them, and moved by the rows of the ranges before, so no task sees
    all rows. Ranges are written, as a second sampling might draw other bounds.
    """
    ranged = keep(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))  # a row per range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.withColumn("_before", before).drop("_n"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.join(offsets, "_part").withColumn(name, own + F.col("_before")).drop("_part", "_before")


def legal_start(messages: Column) -> Column:
    """How many messages at the front of an array have to go so that no tool result stands without the call that asked for it.

    messages: array<struct<role, calls array<string>, call_id, ...>> in order; bounded, as of a window's last n.
    """
    none = F.array().cast("array<string>")
    state = lambda declared, start, i: F.struct(declared.alias("declared"), start.cast("int").alias("start"), i.cast("int").alias("i"))

    def step(s, m):
        orphan = (m["role"] == "tool") & (m["call_id"] != "") & ~F.array_contains(s["declared"], m["call_id"])
        after = s["i"] + 1
        called = F.when(m["role"] == "assistant", F.concat(s["declared"], F.coalesce(m["calls"], none))).otherwise(s["declared"])
        return F.when(F.coalesce(orphan, F.lit(False)), state(none, after, after)).otherwise(state(called, s["start"], after))

    return F.aggregate(messages, state(none, F.lit(0), F.lit(0)), step, lambda s: s["start"])


def _let(value: Column, use) -> Column:
    """use(value), with value worked out once however often it is used: projections that are merged would repeat it."""
    return F.transform(F.array(value), use)[0]


def _from(messages: Column, skip: Column) -> Column:
    """An array without its first `skip` elements."""
    return F.slice(messages, skip + 1, F.greatest(F.size(messages) - skip, F.lit(0)))


def _first_user(messages: Column) -> Column:
    """Place from 0 of the first message of the user, null without any."""
    at = F.array_position(F.transform(messages, lambda m: m["role"] == "user"), True)
    return F.when(at > 0, (at - 1).cast("int"))


def _gathered(rows: DataFrame, key: str) -> DataFrame:
    """One array of messages a session, in order; rows hold at most a window's n of each."""
    rest = [c for c in rows.columns if c not in (key, "idx")]
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("idx", *rest))).alias("m"))


def indexed(messages: DataFrame, key: str, order: str) -> DataFrame:
    """Messages with idx, their place in their session from 0."""
    return messages.withColumn("idx", F.row_number().over(_by(key, order)) - 1)


def replay(messages: DataFrame, key: str, n: int, max_tokens: int, consolidated: Column | None = None) -> DataFrame:
    """What of each session is replayed: its last n messages from a user's on, legal at the front, within a token budget from the tail.

    messages: (key, idx, role, tokens, calls, call_id, ...), idx from `indexed`; consolidated: how many of a session's first
    messages are left aside. If the budget leaves no message of the user, the nearest one comes back with all after it.
    Returns the messages kept. A session is gathered only after it was cut to n messages.
    """
    open_ = messages if consolidated is None else messages.filter(F.col("idx") >= consolidated)
    last = open_.withColumn("_r", F.row_number().over(_by(key, "idx", desc=True))).filter(F.col("_r") <= n).drop("_r")
    state = lambda used, kept, stop: F.struct(used.cast("long").alias("used"), kept.cast("int").alias("kept"), stop.alias("stop"))

    def step(s, x):
        stop = s["stop"] | ((s["kept"] > 0) & (s["used"] + x["tokens"] > max_tokens))
        return state(F.when(stop, s["used"]).otherwise(s["used"] + x["tokens"]), F.when(stop, s["kept"]).otherwise(s["kept"] + 1), stop)

    def within_budget(m):
        kept = F.aggregate(F.reverse(m), state(F.lit(0), F.lit(0), F.lit(False)), step, lambda s: s["kept"])
        return _let(_from(m, F.size(m) - kept), lambda tail: _let(_first_user(tail), lambda user: F.when(user.isNotNull(), _from(tail, user)).otherwise(recovered(m, tail))))

    def recovered(m, tail):
        return _let(_first_user(F.reverse(m)), lambda back: F.when(back.isNotNull(), _from(m, F.size(m) - back - 1)).otherwise(tail))

    shown = _let(_let(_user_and_legal(F.col("m")), within_budget), lambda m: _from(m, legal_start(m)))
    return _gathered(last, key).select(key, F.inline(shown))


def _user_and_legal(messages: Column) -> Column:
    """An array from its first message of the user on, if there is one, and legal at the front."""
    aligned = _let(messages, lambda m: _from(m, F.coalesce(_first_user(m), F.lit(0))))
    return _let(aligned, lambda m: _from(m, legal_start(m)))


def legal_suffix(messages: DataFrame, key: str, n: int, consolidated: Column | None = None) -> DataFrame:
    """Messages with retained: the last n of each session from a user's on; without one, n from the session's last user on; legal at the front.

    Sessions within n messages keep all. Adds was_consolidated, whether the message lies in the session's first `consolidated`.
    """
    w, back = Window.partitionBy(key), _by(key, "idx", desc=True)
    df = messages.withColumn("_n", F.count("*").over(w)).withColumn("_r", F.row_number().over(back))
    tail = F.col("_r") <= n
    df = df.withColumn("_user", F.max(F.when(F.col("role") == "user", F.col("idx"))).over(w)).withColumn("_has", F.max((tail & (F.col("role") == "user")).cast("int")).over(w))
    window = F.when((F.col("_has") == 1) | F.col("_user").isNull(), tail).otherwise((F.col("idx") >= F.col("_user")) & (F.col("idx") < F.col("_user") + n))
    chosen = df.filter((F.col("_n") > n) & window).select(*messages.columns)
    legal = F.transform(_user_and_legal(F.col("m")), lambda x: x["idx"])
    kept = _gathered(chosen, key).select(key, F.explode(legal).alias("idx"), F.lit(True).alias("_kept"))
    out = df.join(kept, [key, "idx"], "left").withColumn("retained", (F.col("_n") <= n) | F.coalesce("_kept", F.lit(False)))
    early = F.col("idx") < consolidated if consolidated is not None else F.lit(False)
    return out.withColumn("was_consolidated", early).select(*messages.columns, "retained", "was_consolidated")


def suffix_report(judged: DataFrame, key: str) -> DataFrame:
    """Per session of `legal_suffix`: kept, dropped, dropped that were consolidated, those left to archive, and the new count of consolidated ones."""
    gone, early = ~F.col("retained"), F.col("was_consolidated")
    counts = {"kept": F.col("retained"), "dropped": gone, "already": gone & early, "to_archive": gone & ~early, "consolidated": F.col("retained") & early}
    return judged.groupBy(key).agg(*[F.count_if(c).alias(n) for n, c in counts.items()])


def consolidation(messages: DataFrame, key: str, consolidated: Column, to_remove: Column) -> DataFrame:
    """(key, boundary, removed): where to cut each session, at the first user's message after its consolidated ones with enough tokens before it, else at the last.

    removed: tokens between the consolidated messages and the cut. Sessions without such a message, or with nothing to remove, have no row.
    """
    rest = messages.withColumn("_c", consolidated).withColumn("_t", to_remove).filter((F.col("idx") >= F.col("_c")) & (F.col("_t") > 0))
    before = F.coalesce(F.sum("tokens").over(_by(key, "idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    users = rest.withColumn("_b", before).filter((F.col("role") == "user") & (F.col("idx") > F.col("_c")))
    enough = F.min(F.when(F.col("_b") >= F.col("_t"), F.struct("idx", F.col("_b").alias("b"))))
    best = users.groupBy(key).agg(F.coalesce(enough, F.max(F.struct("idx", F.col("_b").alias("b")))).alias("x"))
    return best.select(key, F.col("x.idx").alias("boundary"), F.col("x.b").alias("removed"))


def consolidate(messages: DataFrame, key: str, budget: int, target: int, rounds: int = 5) -> DataFrame:
    """(key, consolidated, tokens) after up to `rounds` cuts: while a session's open tokens exceed budget, enough of them are archived to come down to target."""
    state = messages.groupBy(key).agg(F.lit(0).cast("long").alias("consolidated"), F.sum("tokens").alias("tokens"))
    for _ in range(rounds):
        joined = messages.join(state.withColumnRenamed("tokens", "_all").filter(F.col("_all") > budget), key)
        cut = consolidation(joined, key, F.col("consolidated"), F.col("_all") - target)
        state = keep(state.join(cut, key, "left").select(key, F.coalesce("boundary", "consolidated").cast("long").alias("consolidated"), (F.col("tokens") - F.coalesce("removed", F.lit(0))).alias("tokens")))
    return state


def replay_overflow(messages: DataFrame, key: str, n: int) -> DataFrame:
    """(key, boundary): for sessions of more than n messages, the first message that a replay of n would show, where some before it are hidden."""
    shown = replay(messages, key, n, 2**62)
    sizes = messages.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > n)
    first = shown.groupBy(key).agg(F.min("idx").alias("_first"))
    return sizes.join(first, key, "left").select(key, F.coalesce("_first", "_n").cast("int").alias("boundary")).filter("boundary > 0")


def oldest(rows: DataFrame, keys: list[str], age: str, keep_n: int) -> DataFrame:
    """Rows of each key beyond the keep_n latest by `age`: those to be pruned."""
    latest_first = Window.partitionBy(*keys).orderBy(F.col(age).desc())
    return rows.withColumn("_r", F.row_number().over(latest_first)).filter(F.col("_r") > keep_n).drop("_r")


def merged_events(rows: DataFrame, key: list[str], rank: Column, order: str, fields: list[str]) -> DataFrame:
    """One row of each key whose fields are each the latest known one, events of lower rank than one before them left aside.

    A row counts if no earlier one has a higher rank; of the rows that count, later fields win where they aren't null.
    """
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    df = rows.withColumn("_rank", rank).withColumn("_top", F.max("_rank").over(w)).filter(F.col("_top").isNull() | (F.col("_rank") >= F.col("_top")))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c)
    return df.groupBy(*key).agg(*[last(c) for c in fields])


def usage(rows: DataFrame, keys: list[str], counts: str = "usage") -> DataFrame:
    """(keys, name, total): sums of a map of counters, name by name; rows: (keys, usage map<string, bigint>)."""
    return rows.select(*keys, F.explode(counts).alias("name", "n")).groupBy(*keys, "name").agg(F.sum("n").alias("total"))


def line_diff(before: Column, after: Column) -> Column:
    """Lines added and deleted between two texts, as struct<added, deleted>; null texts have none. The diff of a pair is a small task of its own."""

    def one(a, b):
        if a is None or b is None:
            return 0, 0
        old, new = a.replace("\r\n", "\n").splitlines(), b.replace("\r\n", "\n").splitlines()
        moves = [x for x in difflib.SequenceMatcher(a=old, b=new, autojunk=False).get_opcodes() if x[0] != "equal"]
        return sum(j2 - j1 for _, _, _, j1, j2 in moves), sum(i2 - i1 for _, i1, i2, _, _ in moves)

    return F.pandas_udf(lambda x, y: pd.DataFrame([one(a, b) for a, b in zip(x, y, strict=True)], columns=["added", "deleted"]), "added int, deleted int")(before, after)


def paired(left: DataFrame, right: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of two lists paired by their place within a key, the left ones all kept: the columns of both. Names must differ but for keys and order."""
    number = lambda df: df.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    return number(left).join(number(right).drop(order), [*keys, "_i"], "left").drop("_i")


def timeline_payload(turns: DataFrame, events: DataFrame, counts: DataFrame, session: str, turn: str) -> DataFrame:
    """A turn with its events in order and its session's counts, as one JSON text: (session, turn, payload).

    turns: (session, turn, ...); events: (session, turn, sequence, ...); counts: (session, ...), a row a session.
    """
    rest = [c for c in events.columns if c not in (session, turn)]
    per = events.groupBy(session, turn).agg(F.array_sort(F.collect_list(F.struct("sequence", *[c for c in rest if c != "sequence"]))).alias("events"))
    own = [c for c in turns.columns if c not in (session, turn)]
    held = counts.select(session, F.struct(*[c for c in counts.columns if c != session]).alias("snapshot"))
    df = turns.join(per, [session, turn], "left").join(held, session, "left")
    return df.select(session, turn, F.to_json(F.struct(F.struct(*own).alias("turn"), F.coalesce("events", F.array().cast(dict(per.dtypes)["events"])).alias("timeline"), "snapshot")).alias("payload"))
