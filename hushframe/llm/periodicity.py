"""Detection of periodic runs of words: stretches that repeat a block of words, over and over.

A run is a maximal stretch with a smallest period. Every run has a Lyndon root in one of two orders of the words (one the
reverse of the other): a block that is the longest Lyndon word at its place. So a stack scanned from right to left, once an
order, names at most one candidate a place: the stretch from there to the next smaller suffix. A candidate is a run if it
can be extended far enough to both sides.

Comparing two suffixes and extending a candidate are both a longest common extension. It is looked for word by word first,
then by binary search over prefix hashes (modulo 2^61 - 1, built only for texts that need them); inside a run that is
already known it follows from the run's end. What is reported was compared word by word: no run rests on a hash.

Texts are independent of each other: no shuffle, and a task holds the words of one text at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hushframe.llm.common import free_name

#: A run has at least LEAST words, and its period at least TIMES times.
LEAST, TIMES = 6, 4
#: Words compared one by one before hashes are asked.
NEAR = 8
_PRIME, _BASE = (1 << 61) - 1, 0x1B873593CC9E2D51 % ((1 << 61) - 1)


class Extensions:
    """Longest common extensions of positions of a sequence of numbers, to the right and to the left."""

    def __init__(self, ids: list[int], near: int = NEAR):
        self.ids, self.n, self.near = ids, len(ids), near
        self.prefix: list[int] = []
        self.powers: list[int] = []

    def _hash(self, start: int, end: int) -> int:
        return (self.prefix[end] - self.prefix[start] * self.powers[end - start]) % _PRIME

    def _prepare(self) -> None:
        if not self.prefix:
            # 0 stands for no word, so that a longer stretch has another hash
            self.prefix = list(accumulate(self.ids, lambda h, x: (h * _BASE + x + 1) % _PRIME, initial=0))
            self.powers = list(accumulate(range(self.n), lambda h, _: h * _BASE % _PRIME, initial=1))

    def right(self, i: int, j: int) -> int:
        """How many words from i on equal those from j on; i < j."""
        ids, most = self.ids, self.n - j
        k, near = 0, min(self.near, most)
        while k < near and ids[i + k] == ids[j + k]:
            k += 1
        if k < near or k == most:
            return k
        self._prepare()
        low, high = k, most  # the first `low` are equal
        while low < high:
            mid = (low + high + 1) // 2
            if self._hash(i + low, i + mid) == self._hash(j + low, j + mid):
                low = mid
            else:
                high = mid - 1
        return low

    def left(self, i: int, j: int) -> int:
        """How many words before i equal those before j; i < j."""
        ids, most = self.ids, i
        k, near = 0, min(self.near, most)
        while k < near and ids[i - k - 1] == ids[j - k - 1]:
            k += 1
        if k < near or k == most:
            return k
        self._prepare()
        low, high = k, most
        while low < high:
            mid = (low + high + 1) // 2
            if self._hash(i - mid, i - low) == self._hash(j - mid, j - low):
                low = mid
            else:
                high = mid - 1
        return low


def _scan(ids: list[int], reach: Extensions, least: int, times: int, found: dict[tuple[int, int], int], ends: dict[int, tuple[int, int]]) -> None:
    """Add to `found` (start, period): end of every run whose Lyndon root is one in the order of `ids`.

    ends: of each period the run found last, as (start, end); `reach` may stand for any sequence with the same equalities.
    """
    n = len(ids)
    smaller = [n] * n  # where the next smaller suffix starts; the end of the sequence is smaller than any word
    for i in range(n - 1, -1, -1):
        word, j, same = ids[i], i + 1, 0
        while j < n:
            other = ids[j]
            if other < word:
                same = 0
                break
            if other == word:
                known = ends.get(j - i)
                # Both lie in one run of that period: they agree up to its end.
                same = known[1] - j if known and known[0] <= i and j < known[1] else reach.right(i, j)
                if j + same == n or ids[j + same] < ids[i + same]:
                    break
                same = 0
            j = smaller[j]
        smaller[i] = j
        period = j - i
        # The first root of a run is followed by times - 2 more periods at least; one is enough to look closer.
        if times == 2 or j < n and same >= period:
            known = ends.get(period)
            if known and known[0] <= i and j < known[1]:
                continue
            start, end = i - reach.left(i, j), j + same
            if end - start >= max(least, times * period):
                found[start, period] = end
                ends[period] = (start, end)


def runs(words: list, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence, by start, then period.

    A run is a stretch with smallest period q, of max(least, times * q) words or more (times is 2 at least), which no
    neighbour extends. A sequence too short for one has none.
    """
    if times < 2:
        raise ValueError("a run holds its period twice at least")
    if len(words) < max(least, times):
        return []
    number: dict = {}
    ids = [number.setdefault(w, len(number)) for w in words]
    if len(number) == len(ids):
        return []
    # Checked word by word; a stretch that fails owes itself to a collision of hashes, and the text is done again without them.
    for near in (NEAR, len(ids)):
        reach, found, ends = Extensions(ids, near), {}, {}
        _scan(ids, reach, least, times, found, ends)
        _scan([-x for x in ids], reach, least, times, found, ends)
        if all(ids[s : e - p] == ids[s + p : e] for (s, p), e in found.items()):
            break
    return sorted((s, e - s, p) for (s, p), e in found.items())


def collapsed(words: list, found: list[tuple[int, int, int]]) -> list:
    """The words that no run contains after its first period."""
    if not found:
        return words
    change = [0] * (len(words) + 1)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    return [w for w, depth in zip(words, accumulate(change)) if depth == 0]


def periodic_runs(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), least: int = LEAST, times: int = TIMES) -> DataFrame:
    """keep..., n_words, runs (array of start, length, period) and collapsed: the text without what its runs repeat.

    Words are maximal stretches without space, tab, newline, vertical tab, form feed or carriage return, numbered from 0 and
    compared byte by byte. runs: as of `runs`; runs of different periods may overlap, and a run that
    repeats inside another is a run as well. collapsed: the words that stay, joined by one space, whether or not any goes. A
    null or empty text has no words, no runs and collapses to ''. Rows are judged one by one: repeated rows
    and ids fare alike, in any number; an empty table gives no rows. keep: columns to carry along; those named like an added
    one are replaced.
    """
    added = ("n_words", "runs", "collapsed")
    carried = [c for c in keep if c.lower() not in added]
    given = F.struct(*[F.col(f"`{c}`") for c in carried]) if carried else F.lit(0)
    rows = docs.select(given.alias("given"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))
    schema = StructType([rows.schema["given"], *StructType.fromDDL("n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string").fields])
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, own, kept = [], [], []
            for text in batch.column("text"):
                words = (text.as_py() or b"").split()  # splits bytes at just those six
                hits = runs(words, least, times)
                counts.append(len(words))
                own.append([{"start": s, "length": k, "period": p} for s, k, p in hits])
                kept.append(b" ".join(collapsed(words, hits)))
            texts = pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("given"), pa.array(counts, pa.int64()), pa.array(own, run_type), texts], names=["given", *added])

    out = rows.mapInArrow(read, schema)
    return out.select(*[F.col(f"given.`{c}`").alias(c) for c in carried], *added)


def planted(docs: DataFrame, doc_id: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with a periodic tail put into the texts whose crc32(decimal id) ends in 0, by the rule of the query.

    With h the checksum, g = floor(h / 10) and n words: from word a = g % n on, the text repeats the p = 1 + floor((n - a) / (3 + g % 8))
    words there. Other texts, those without a word, and rows without an id stay as they are; changed ones are joined by one space.
    """
    h, text = free_name(docs, "_h"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    docs = docs.withColumn(h, F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")))
    g = F.floor(F.col(h) / 10).cast("long")

    def repeated(words):
        n = F.size(words).cast("long")
        a = g % n
        p = F.lit(1).cast("long") + F.floor((n - a) / (F.lit(3) + g % 8)).cast("long")
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, place(i).cast("int"))), " ")).otherwise("")

    # The words are bound as the one element of an array, so that they aren't split again for each place.
    split = F.array(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), ""))
    return docs.withColumn(text_col, F.when(F.col(h) % 10 == 0, F.get(F.transform(split, repeated), F.lit(0))).otherwise(F.col(f"`{text_col}`"))).drop(h)
