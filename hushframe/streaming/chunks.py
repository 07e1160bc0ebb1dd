"""Texts that arrive in chunks: sanitising and restoring them while they grow.

Chunks carry a sequence number and are taken in its order, whatever order they arrive in. What is emitted, joined, restores to the
whole raw text, and no entity is ever emitted raw, however the text was cut. `sessions.sanitize_stream` does it for
streams of chunks, with a vault a session.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from hushframe.functions import taxonomy
from hushframe.operators import detect
from hushframe.operators.vault import RARE, Vault, restore

#: Characters held back while a stream is live, so that what follows a match is seen before it is taken as final.
HOLD = 256
#: No rule has more characters before the last blank inside it.
OPEN = 64
#: Characters of an unfinished token held back by the restorer.
TOKEN_HOLD = 128
#: Groups that streams are dealt to by a hash; a group's state holds those of its streams that haven't ended.
GROUPS = 4096
_PARTIAL = re.compile(r"<(?:<[A-Z0-9_]*>?)?\Z")
_RULES = [(slug, re.compile(pattern), group) for slug, pattern, group, _ in detect.RULES if slug != "email"]
#: Rules with a blank inside: a cut at a blank may lie within one that isn't complete yet.
_BLANK_INSIDE = [regex.compile(pattern) for _, pattern, _, _ in detect.RULES if " " in pattern]
#: What stands before the first blank inside these rules, or with it: a text that ends with a blank and holds none of them leaves no rule open.
_BEFORE_BLANK = ("+", "token ", "password ", "secret ", "api_key ")
#: What a text must hold for a rule to match at all, as `detect.NEEDLES`; the other rules want a digit, and all of them a rare sign.
_NEEDLES = {slug: (needle,) for slug, needle in detect.NEEDLES.items()} | {"local_path": ("/", "\\")}
_DIGIT = re.compile("[0-9]")
_LOCAL, _DOMAIN = re.compile(r"[A-Za-z0-9._%+-]"), re.compile(r"[A-Za-z0-9.-]+\.[A-Za-z]{2,}")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Places of the e-mail rule's matches, found from their @ signs: a long run without one costs nothing."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text[start - 1]):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def entities(text: str) -> list[tuple[str, str, int, int]]:
    """(surface, type, start, end) of the rules' matches; of one surface the type of highest priority."""
    if RARE.search(text) is None:
        return []
    best: dict[str, tuple[str, str, int, int]] = {}
    spans = [(text[a:b], "email", a, b) for a, b in emails(text)]
    digits = _DIGIT.search(text) is not None
    for slug, pattern, group in _RULES:
        for m in pattern.finditer(text) if (any(n in text for n in _NEEDLES[slug]) if slug in _NEEDLES else digits) else ():
            surface = m.group(group)
            if slug == "local_path":
                surface = surface.rstrip(detect.PATH_TRAILING)
            if surface:
                spans.append((surface, slug, m.start(group), m.start(group) + len(surface)))
    for span in spans:
        surface, slug = span[:2]
        if surface not in best or taxonomy.PRIORITY[slug] > taxonomy.PRIORITY[best[surface][1]]:
            best[surface] = span
    return [(s, best[s][1], a, b) for s, _, a, b in spans]


def _open_rule(text: str) -> int:
    """Where a rule begins that the end of `text` leaves incomplete, or len(text)."""
    tail = text[-OPEN:]
    if tail[-1:].isspace() and not any(word in tail for word in _BEFORE_BLANK):
        return len(text)
    starts = [m.start() for rule in _BLANK_INSIDE for m in rule.finditer(tail, partial=True) if m.partial and m.end() > m.start()]
    return len(text) - len(tail) + min(starts, default=len(tail))


class Sanitizer:
    """Sanitises a growing text: feed returns what can be shown so far."""

    def __init__(self, raw: str = "", vault: Vault | None = None):
        self.raw, self.vault = raw, vault or Vault()

    def feed(self, chunk: str, last: bool = False) -> str:
        self.raw += chunk
        found = entities(self.raw)
        cut = len(self.raw) if last else self._cut(found)
        ready, self.raw = self.raw[:cut], self.raw[cut:]
        return self.vault.sanitize(ready, [(s, t, None) for s, t, a, b in found if b <= cut]) if ready else ""

    def _cut(self, found: list[tuple[str, str, int, int]]) -> int:
        """The last place before which everything is final: after a blank, in no match, in no rule that may still be completed, in no known surface."""
        reach = self.vault.longest_spaced()
        cut = max(0, len(self.raw) - HOLD)
        while cut:
            at = cut
            cut = next((i for i in range(cut, 0, -1) if self.raw[i - 1].isspace()), 0)
            cut = min([a for _, _, a, b in found if a < cut < b], default=cut)
            cut = min(cut, _open_rule(self.raw[max(0, cut - OPEN) : cut]) + max(0, cut - OPEN))
            # A surface that reaches over the cut holds the characters on either side of it.
            for s in self.vault.within(self.raw[max(0, cut - reach) : cut + reach]) if reach and self.raw[max(0, cut - 1) : cut + 1] in self.vault.joints else ():
                held = self.raw.find(s, max(0, cut - len(s) + 1), cut + len(s) - 1)
                cut = held if 0 <= held < cut and any(map(str.isspace, s)) else cut
            if cut == at:
                break
        return cut


class Restorer:
    """Restores a growing text: an unfinished token at its end waits."""

    def __init__(self, canonical: dict[str, str], held: str = ""):
        self.vault, self.held = Vault(canonical=canonical), held

    def feed(self, chunk: str, last: bool = False) -> str:
        text = self.held + chunk
        cut = len(text) if last else _token_cut(text)
        self.held = text[cut:]
        return self.vault.restore(text[:cut])


def _token_cut(text: str) -> int:
    """Where an unfinished token at the end of a text begins, or its length."""
    m = _PARTIAL.search(text)
    return m.start() if m and len(text) - m.start() <= TOKEN_HOLD else len(text)


def whole_tokens(chunks: DataFrame) -> DataFrame:
    """Streaming chunks(session, stream, seq, chunk, last) to (session, stream, seq, piece): cut anew so that no token is split.

    Only the tail of a stream that may be the start of a token waits, so state is a few characters a stream. A piece can be
    restored on its own by `vault.restore`, as `restore_stream` does.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # Streams of a hash come as one group: a call and a state of its own cost each stream more than its text.
        live = {(session, stream): [following, held, {n: rest for n, *rest in waiting}] for session, stream, following, held, waiting in json.loads(state.get[0] if state.exists else "[]")}
        ended = set()  # in this batch: what comes again of them is a repetition
        for part in parts:
            out = []
            for session, stream, seq, chunk, last in zip(*(part[c].tolist() for c in ("session", "stream", "seq", "chunk", "last")), strict=True):
                own = (session, stream)
                if own in ended:
                    continue
                of = live.setdefault(own, [0, "", {}])
                if seq >= of[0]:
                    of[2].setdefault(seq, [chunk or "", bool(last)])
                while of[0] in of[2]:
                    text, done = of[2].pop(of[0])
                    text = of[1] + text
                    cut = len(text) if done else _token_cut(text)
                    out.append((session, stream, of[0], text[:cut]))
                    of[0], of[1] = of[0] + 1, text[cut:]
                    if done:
                        ended.add(own)
                        del live[own]
                        break
            yield pd.DataFrame(out, columns=["session", "stream", "seq", "piece"])
        if live:
            state.update((json.dumps([[*own, following, held, [[n, *rest] for n, rest in waiting.items()]] for own, (following, held, waiting) in live.items()]),))
        elif state.exists:
            state.remove()

    schema = "session string, stream long, seq long, piece string"
    group = F.pmod(F.xxhash64("session", "stream"), F.lit(GROUPS))
    return chunks.withColumn("_group", group).groupBy("_group").applyInPandasWithState(step, schema, "live string", "append", GroupStateTimeout.NoTimeout)


def restore_stream(chunks: DataFrame, vault: DataFrame, write) -> DataStreamWriter:
    """A streaming query, not started, that restores chunks with `vault`(session, placeholder, canonical).

    write(batch, id) gets each micro-batch: (session, stream, seq, piece, restored).
    """

    def batch(pieces: DataFrame, number: int) -> None:
        write(restore(pieces, vault, "session", ["stream", "seq"], text="piece"), number)

    return whole_tokens(chunks).writeStream.foreachBatch(batch)


def cut_chunks(docs: DataFrame, session: str, stream: str, text: str, size: int) -> DataFrame:
    """A text column as chunks(session, stream, seq, chunk, last) of `size` characters; an empty text is one empty chunk."""
    n = F.greatest(F.lit(1), F.ceil(F.length(F.coalesce(text, F.lit(""))) / size).cast("int"))
    cut = docs.select(F.col(session).cast("string").alias("session"), F.col(stream).cast("long").alias("stream"), F.coalesce(text, F.lit("")).alias("_t"), n.alias("_n"))
    cut = cut.withColumn("seq", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return cut.select("session", "stream", F.col("seq").cast("long").alias("seq"), F.substring("_t", F.col("seq") * size + 1, F.lit(size)).alias("chunk"), (F.col("seq") == F.col("_n") - 1).alias("last"))


def first_of_key(events: DataFrame, ts: str, keys: list[str], delay: str) -> DataFrame:
    """Streaming: drop later rows of the same keys; the watermark bounds the state."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)
