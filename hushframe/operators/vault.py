"""The vault: stable placeholders per session, with aliases; sanitise and restore.

Two ways give the same tokens where no surface is another's alias. `apply_minted` is set based: surfaces are numbered once
per session, and each text is rewritten on its own. `sanitize_sessions` is sequential: it walks a session's turns in order
and reuses a token for a surface that an earlier turn has made an alias of it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.functions import grammar, taxonomy
from hushframe.operators import detect


#: So many surfaces are looked for one by one.
FEW = 32
#: Signs that few words hold and most surfaces do, those of all rules among them: a text without any can't hold such a surface.
RARE = re.compile(r"""[0-9@$%+=/\\]""")
#: Bits of a hash by which beginnings of surfaces are marked, its base, and what spreads it.
BITS, _BASE, _SPREAD, _WORD = 20, 0x01000193, 0x9E3779B1, 0xFFFFFFFF


def alias_key(text: str) -> str:
    plain = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", text or ""))
    low = " ".join("".join(c for c in plain if not unicodedata.combining(c)).split()).lower()
    return re.sub(r"[^\w\s]", "", low) or low


def protected(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in grammar.PLACEHOLDER_RE.finditer(text)]


def free_positions(text: str, surface: str) -> list[int]:
    """Starts of a surface's occurrences that touch no token and one another."""
    spans, out, at = protected(text), [], text.find(surface)
    while at >= 0:
        end = at + len(surface)
        hit = next((e for s, e in spans if s < end and at < e), None)
        if hit is None:
            out.append(at)
        at = text.find(surface, end if hit is None else at + 1)
    return out


def replace_all(text: str, pairs: list[tuple[str, str]]) -> str:
    """Put tokens in place of surfaces, longer surfaces first, never inside a token."""
    for surface, token in sorted(pairs, key=lambda p: -len(p[0])):
        if not surface or grammar.PLACEHOLDER_RE.search(surface) or surface not in text:
            continue
        for at in reversed(free_positions(text, surface)):
            text = text[:at] + token + text[at + len(surface) :]
    return text


def _mark(head: str) -> int:
    """Where a surface's beginning is marked: as `_marks` has it of each place of a text."""
    value = 0
    for c in head:
        value = (value * _BASE + ord(c)) & _WORD
    return (value * _SPREAD & _WORD) >> 32 - BITS


def _marks(text: str, sizes: Iterable[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(n, marks of the n characters from each place of a text) for those of the sizes, powers of two, that fit in."""
    values, n, base = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), 1, _BASE
    most = min(len(text), max(sizes, default=0))
    while n <= most:
        if n in sizes:
            yield n, values * np.uint32(_SPREAD) >> np.uint32(32 - BITS)
        values = values[:-n] * np.uint32(base) + values[n:]
        n, base = 2 * n, base * base & _WORD


@dataclass
class Vault:
    """What one session knows: tokens by surface and by alias key, canonical surfaces, values and counters."""

    by_surface: dict[str, str] = field(default_factory=dict)
    #: The surfaces as they came, so that the new ones are found without walking through all.
    order: list[str] = field(default_factory=list)
    by_key: dict[str, str] = field(default_factory=dict)
    keys: dict[str, list[str]] = field(default_factory=dict)
    canonical: dict[str, str] = field(default_factory=dict)
    values: dict[str, float] = field(default_factory=dict)
    counters: dict[str, int] = field(default_factory=dict)
    #: Numbers are told apart by their whole text, so that $1,200.50 and $120,050 stay two (False: by alias key).
    strict: bool = True
    #: Lengths of surfaces by their first 1, 2, 4, 8, ... characters, and how many surfaces are among them.
    heads: dict[int, dict[str, set[int]]] = field(default_factory=dict)
    marked: dict[int, np.ndarray] = field(default_factory=dict)
    indexed: int = 0
    #: How many of these hold no rare sign.
    bare: int = 0
    #: Length of the longest surface with a blank inside, pairs of neighbours in such surfaces, and how many surfaces were measured.
    spaced: int = 0
    joints: set[str] = field(default_factory=set)
    measured: int = 0

    def known(self, surface: str, tag: str) -> str | None:
        if surface in self.by_surface:
            return self.by_surface[surface]
        if self.strict and taxonomy.SLUGS.get(tag) in taxonomy.COMPUTABLE:
            return None
        key = alias_key(surface)
        if key in self.by_key:
            return self.by_key[key]
        if tag not in taxonomy.ALIAS_TAGS or not key:
            return None
        fits = [t for t, keys in self.keys.items() if t.startswith(f"<<{tag}_") and any(stem(key, k) for k in keys)]
        return fits[0] if len(fits) == 1 else None

    def hold(self, surface: str, token: str) -> None:
        """Know a surface by its token; the first surface of a token is the canonical one."""
        tag, number = token[2:-2].rsplit("_", 1)
        self.counters[tag] = max(self.counters.get(tag, 0), int(number))
        self.canonical.setdefault(token, surface)
        if surface not in self.by_surface:
            self.by_surface[surface] = token
            self.order.append(surface)
        key = alias_key(surface)
        if key and not (self.strict and taxonomy.SLUGS.get(tag) in taxonomy.COMPUTABLE):
            self.by_key.setdefault(key, token)
            if key not in self.keys.setdefault(token, []):
                self.keys[token].append(key)

    def token(self, surface: str, tag: str) -> str:
        token = self.known(surface, tag) or f"<<{tag}_{self.counters.get(tag, 0) + 1}>>"
        self.hold(surface, token)
        return token

    def sanitize(self, text: str, entities: list[tuple[str, str, float | None]]) -> str:
        """Known surfaces and new entities (surface, type, value), longer ones first: a known one never cuts a longer new one."""
        known = [(s, None, None) for s in self.within(text)]
        for surface, slug, value in sorted([*known, *entities], key=lambda e: -len(e[0])):
            if slug is None:
                text = replace_all(text, [(surface, self.by_surface[surface])])
                continue
            if not surface or ("<<" in surface and ">>" in surface) or not free_positions(text, surface):
                continue
            token = self.token(surface, taxonomy.TAGS.get(slug, "ENTITY"))
            if value is not None:
                self.values[token] = value
            text = replace_all(text, [(surface, token)])
        return text

    def longest_spaced(self) -> int:
        """Length of the longest known surface with a blank inside, 0 without any."""
        for s in self.order[self.measured :]:
            if any(map(str.isspace, s)):
                self.spaced = max(self.spaced, len(s))
                self.joints.update(map("".join, pairwise(s)))
        self.measured = len(self.order)
        return self.spaced

    def within(self, text: str) -> list[str]:
        """Known surfaces that stand in a text. Of many, only those are looked at that begin as some place of the text does.

        Which places those may be is told by hashes of all places at once: looking at each would cost a long text more than all else.
        """
        if len(self.by_surface) <= FEW:
            return [s for s in self.by_surface if s in text]
        for s in self.order[self.indexed :]:
            self.bare += RARE.search(s) is None
            head = s[: 1 << (len(s).bit_length() - 1)] if s else ""
            self.heads.setdefault(len(head), {}).setdefault(head, set()).add(len(s))
            if len(head) not in self.marked:
                self.marked[len(head)] = np.zeros(1 << BITS, bool)
            self.marked[len(head)][_mark(head)] = True
        self.indexed = len(self.order)
        if not self.bare and RARE.search(text) is None:
            return []
        found = dict.fromkeys([""] if "" in self.by_surface else [])
        for n, marks in _marks(text, self.heads.keys()):
            for i in self.marked[n][marks].nonzero()[0].tolist():
                for size in self.heads[n].get(text[i : i + n], ()):
                    if text[i : i + size] in self.by_surface:
                        found[text[i : i + size]] = None
        return list(found)

    def restore(self, text: str) -> str:
        return grammar.PLACEHOLDER_RE.sub(lambda m: self.canonical.get(m.group(), m.group()), text)


def stem(key: str, other: str) -> bool:
    """Whether one alias key is part of the other: a single word as a whole word, more words at either end."""
    words = key.split()
    if len(words) == 1:
        return len(key) >= 2 and key in other.split()
    return key.startswith(other) or key.endswith(other) or other.startswith(key) or other.endswith(key)


def apply_minted(docs: DataFrame, found: DataFrame, minted: DataFrame, session: str, turn: str, text: str = "text") -> DataFrame:
    """Rewrite each text with its own surfaces' tokens: adds sanitized and modified. Only texts with entities go through Python.

    A turn is one of its session: turns of the same number in other sessions, or without a session, have tokens of their own.
    """
    s, t, surface = "_session", "_turn", "_surface"
    known = minted.select(F.col(session).alias(s), F.col("canonical").alias(surface), "placeholder")
    used = found.select(F.col(session).alias("_own"), F.col(turn).alias(t), "entity_text")
    tokens = used.join(known, F.col("_own").eqNullSafe(F.col(s)) & (F.col("entity_text") == F.col(surface)))
    per_text = tokens.groupBy(s, t).agg(F.collect_list(F.struct("entity_text", "placeholder")).alias("_pairs"))

    @F.pandas_udf("string")
    def rewrite(texts: pd.Series, pairs: pd.Series) -> pd.Series:
        return pd.Series([None if ps is None else replace_all(t, [(p["entity_text"], p["placeholder"]) for p in ps]) for t, ps in zip(texts, pairs, strict=True)])

    joined = docs.join(per_text, docs[session].eqNullSafe(F.col(s)) & docs[turn].eqNullSafe(F.col(t)), "left")
    # Texts without entities are null on their way to Python and back.
    rewritten = rewrite(F.when(F.col("_pairs").isNotNull(), F.col(text)), "_pairs")
    joined = joined.withColumn("sanitized", F.coalesce(rewritten, F.col(text)))
    return joined.withColumn("modified", F.coalesce(F.col("sanitized") != F.col(text), F.lit(False))).drop("_pairs", s, t)


#: So many surfaces or tokens of a session at most go along with each of its texts as one array; those of larger sessions are joined one by one.
MOST = 256
#: A sign for each of them that stands in a text for its token while others are still looked for.
_SIGNS = "".join(chr(0xE000 + i) for i in range(MOST))


def large(counted: DataFrame) -> DataFrame | None:
    """(_s) of the sessions in counted(session, n) whose sum is more than MOST, None where there are none."""
    session, n = counted.columns
    big = counted.groupBy(F.col(session).alias("_s")).agg(F.sum(n).alias("_n")).filter(F.col("_n") > MOST).select("_s")
    return None if big.isEmpty() else big


def by_session(rows: DataFrame, session: str, columns: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """(_k struct<session>, _own array<struct<columns>>) of sessions with up to MOST rows, and (_s) of the others, None where there are none.

    A struct is equal to another that holds a null too, so a join on _k needs no shuffle of the arrays beyond that of their grouping.
    """
    big = large(rows.select(session, F.lit(1).alias("_n")))
    rest = rows if big is None else rows.join(big, rows[session].eqNullSafe(F.col("_s")), "left_anti")
    return rest.groupBy(F.struct(F.col(session).alias("session")).alias("_k")).agg(F.collect_set(F.struct(*columns)).alias("_own")), big


def replaced(text: Column, pairs: Column) -> Column:
    """`replace_all` in the JVM: pairs(array<struct<surface, placeholder>>), no more than MOST; null where a text holds what could be or touch a token."""
    first = F.array_sort(F.transform(pairs, lambda p: F.struct((-F.length(p["surface"])).alias("shorter"), p["surface"].alias("surface"), p["placeholder"].alias("placeholder"))))
    signed = F.transform(first, lambda p, i: F.struct(p["surface"].alias("surface"), F.substr(F.lit(_SIGNS), i + 1, F.lit(1)).alias("sign"), p["placeholder"].alias("placeholder")))
    # Longer ones first; a sign is part of no surface, so what has given way is safe from those that follow.
    out = F.aggregate(signed, text, lambda a, p: F.replace(a, p["surface"], p["sign"]))
    out = F.aggregate(signed, out, lambda a, p: F.replace(a, p["sign"], p["placeholder"]))
    return F.when(~text.rlike("[<>\ue000-\uf8ff]"), out)


def restore(texts: DataFrame, vault: DataFrame, session: str, keys: list[str], text: str = "text") -> DataFrame:
    """Put canonical surfaces back for known tokens; unknown ones stay: adds restored. vault: (session, placeholder, canonical).

    keys tell the texts of a session apart. Texts meet their session's tokens once, as one array; only those of sessions
    with very many tokens are taken apart to meet them one by one.
    """
    known = vault.select(F.col(session).alias("_of"), "placeholder", "canonical")
    few, big = by_session(known, "_of", ["placeholder", "canonical"])
    rest = texts if big is None else texts.join(big, texts[session].eqNullSafe(F.col("_s")), "left_anti")
    joined = rest.join(few, F.struct(rest[session].alias("session")) == F.col("_k"), "left")
    used = F.map_from_entries(F.filter("_own", lambda x: F.contains(F.col(text), x["placeholder"])))
    out = joined.withColumn("_map", F.when(F.contains(F.col(text), F.lit("<<")) & F.col("_own").isNotNull(), used))
    out = out.withColumn("restored", F.when(F.col("_map").isNull(), F.col(text)).otherwise(_put_back(text))).drop("_k", "_own", "_map")
    if big is None:
        return out
    return out.unionByName(_restore_each(texts.join(big, texts[session].eqNullSafe(F.col("_s")), "left_semi"), known, session, keys, text))


def _put_back(text: str) -> Column:
    # Pieces between tokens and the tokens themselves, in turn.
    pieces = F.split(F.regexp_replace(F.col(text), f"({grammar.PLACEHOLDER})", "\x00$1\x00"), "\x00", -1)
    return F.array_join(F.transform(pieces, lambda p: F.coalesce(F.try_element_at("_map", p), p)), "")


def _restore_each(texts: DataFrame, known: DataFrame, session: str, keys: list[str], text: str) -> DataFrame:
    used = texts.select(*keys, F.col(session).alias("_mine"), F.explode(grammar.tokens(F.col(text))).alias("_token"))
    pairs = used.join(known, F.col("_mine").eqNullSafe(F.col("_of")) & (F.col("_token") == F.col("placeholder")))
    own = {k: f"_k{i}" for i, k in enumerate([*keys, session])}
    entries = F.map_from_entries(F.collect_set(F.struct("placeholder", "canonical"))).alias("_map")
    pairs = pairs.groupBy(*[F.col("_mine" if k == session else k).alias(v) for k, v in own.items()]).agg(entries)
    on = reduce(lambda a, b: a & b, [texts[k].eqNullSafe(F.col(v)) for k, v in own.items()])
    joined = texts.join(pairs, on, "left")
    return joined.withColumn("restored", F.when(F.col("_map").isNull(), F.col(text)).otherwise(_put_back(text))).drop("_map", *own.values())


def _parts(c, least: int = 1):
    """All beginnings and ends of a string of at least `least` characters, itself included."""
    sizes = F.sequence(F.lit(least), F.greatest(F.lit(least), F.length(c)))
    return F.concat(F.transform(sizes, lambda n: F.left(c, n)), F.transform(sizes, lambda n: F.right(c, n)))


def resolve_aliases(asked: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """The token that a surface is an alias of, if exactly one fits: (keys, placeholder).

    asked: (keys, session, surface); known: (session, placeholder, alias); surfaces and aliases are alias keys. A surface
    fits an equal alias; a single word of two letters or more fits an alias that holds it as a word; several words fit an
    alias that begins or ends with them, or that they begin or end with. Both sides are split to the strings that may be
    equal, so the match is an equality join, whatever the number of aliases of a session.
    """
    wordy = lambda c: F.contains(c, F.lit(" "))
    alias = F.col("alias")
    inside = F.concat(F.filter(F.split(alias, " "), lambda w: F.length(w) >= 2), F.filter(_parts(alias), wordy))
    forms = lambda side, values: F.transform(F.array_distinct(values), lambda x: F.struct(F.lit(side).alias("side"), x.alias("form")))
    held = known.select("session", "placeholder", F.inline(F.concat(forms("part", inside), forms("whole", F.array(alias)))))
    surface = F.col("surface")
    around = F.when(wordy(surface), _parts(surface)).otherwise(F.array(surface))
    said = asked.select(*keys, "session", F.inline_outer(F.concat(forms("part", F.array(surface)), forms("whole", around))))
    found = said.join(held, ["session", "side", "form"], "left").groupBy(*keys)
    return found.agg(F.count_distinct("placeholder").alias("_n"), F.min("placeholder").alias("_p")).select(*keys, F.when(F.col("_n") == 1, F.col("_p")).alias("placeholder"))


def sanitize_sessions(turns: DataFrame, strict: bool = True) -> DataFrame:
    """turns(session, turn, text) with sanitized, modified and restored, each session walked in the order of its turns.

    A session's vault lives in one task, as every token depends on the turns before. Turns without a session are one session,
    turns without a number come last, and have together what is detected in any of them; a null text stays null.
    """
    numeric = detect.number_value(F.col("entity_text"), F.col("entity_type"))
    found = detect.by_priority(detect.detect(turns.select("session", "turn", "text")), ["session", "turn"]).withColumn("value", numeric)
    entity = F.struct("detect_rank", "entity_text", "entity_type", "value")
    own = found.groupBy(F.col("session").alias("_s"), F.col("turn").alias("_t")).agg(F.array_sort(F.collect_list(entity)).alias("entities"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, vault = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if at != (row["session"],):
                    at, vault = (row["session"],), Vault(strict=strict)
                text, clean = row["text"], None
                if text is not None:
                    clean = vault.sanitize(text, [(e["entity_text"], e["entity_type"], e["value"]) for e in row["entities"] or []])
                restored = None if clean is None else vault.restore(clean)
                out.append({"session": row["session"], "turn": row["turn"], "text": text, "sanitized": clean, "modified": clean != text, "restored": restored})
            yield pa.RecordBatch.from_pylist(out, schema=walked)

    text, names = pa.string(), ("session", "turn", "text", "sanitized", "modified", "restored")
    walked = pa.schema(list(zip(names, (text, pa.int64(), text, text, pa.bool_(), text), strict=True)))
    rows = turns.select(F.col("session").cast("string").alias("session"), F.col("turn").cast("long").alias("turn"), F.col("text").cast("string").alias("text"))
    joined = rows.join(own, F.col("session").eqNullSafe(F.col("_s").cast("string")) & F.col("turn").eqNullSafe(F.col("_t").cast("long")), "left").drop("_s", "_t")
    schema = "session string, turn long, text string, sanitized string, modified boolean, restored string"
    # Sessions one after the other in a partition: a task holds one session's vault, never its texts.
    return joined.repartition("session").sortWithinPartitions("session", F.col("turn").asc_nulls_last()).mapInArrow(walk, schema)
