"""Packing of documents into sequences by Karmarkar-Karp multiway differencing.

Every document is tokenised and closed with a separator id. Whole runs of `capacity` ids are sequences of their own. What
is left over of each document is cut into pieces of at most `piece` ids, and blocks of such pieces are dealt into windows
by multiway differencing: every piece starts as a partial partition, and the two partial partitions with the largest
spread are merged, the fullest window of one with the emptiest of the other, until one partition with near-equal windows
is left. If its fullest window is above capacity, the block is dealt again into more windows.

A task packs what it reads, in the order it reads it, so nothing is shuffled and a task that runs again gives the same
sequences as long as it reads the same rows in the same order (files do; cut the lineage after a shuffle).
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PACKED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("sequence_tokens", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]
)
_ARROW = pa.schema([(f.name, pa.binary() if f.name == "ids" else pa.int64()) for f in PACKED])
#: A text with this string is tokenised by the slower library, which knows it as one special id.
SPECIAL = "<|endoftext|>"
_encoders: dict = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str):
    """A function from text to ids, equal to `Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids`.

    Where the folder has the same vocabulary as ranks (`.tiktoken` beside `.json`), the faster library reads that file.
    """
    if path not in _encoders:
        import os

        from tokenizers import Tokenizer

        slow, ranks_path = [], path.removesuffix(".json") + ".tiktoken"

        def exact(text: str) -> list[int]:
            if not slow:
                slow.append(Tokenizer.from_file(path))
            return slow[0].encode(text, add_special_tokens=False).ids

        if os.path.exists(ranks_path):
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            fast = tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            _encoders[path] = lambda text: exact(text) if SPECIAL in text else fast(text)
        else:
            _encoders[path] = exact
    return _encoders[path]


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Deal items into `windows` near-equal windows by multiway differencing; each window lists its items' positions."""
    made: list[tuple[int, int]] = []  # node len(sizes)+k joins these two
    total = len(sizes)

    def single(i: int):
        sums, nodes = np.zeros(windows, np.int64), np.full(windows, -1, np.int64)
        sums[-1], nodes[-1] = sizes[i], i
        return sums, nodes

    # (-spread, tie breaker, sums in ascending order, nodes)
    heap = [(-int(sizes[i]) if windows > 1 else 0, i, None, None) for i in range(total)]
    heapq.heapify(heap)
    turn = total
    while len(heap) > 1:
        _, i, a, an = heapq.heappop(heap)
        _, j, b, bn = heapq.heappop(heap)
        if a is None:
            a, an = single(i)
        if b is None:
            b, bn = single(j)
        b, bn = b[::-1], bn[::-1]
        sums = a + b
        both = np.flatnonzero((an >= 0) & (bn >= 0))
        nodes = np.where(an >= 0, an, bn)
        if len(both):
            nodes[both] = np.arange(total + len(made), total + len(made) + len(both))
            made.extend(zip(an[both].tolist(), bn[both].tolist(), strict=True))
        order = np.argsort(sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        heapq.heappush(heap, (int(sums[0] - sums[-1]), turn, sums, nodes))
        turn += 1
    _, i, sums, nodes = heap[0]
    if sums is None:
        sums, nodes = single(i)
    out = []
    for node in nodes.tolist():
        items, stack = [], [node] if node >= 0 else []
        while stack:
            x = stack.pop()
            if x < total:
                items.append(x)
            else:
                stack.extend(made[x - total])
        out.append(sorted(items))
    return out


def windows_for(sizes: list[int], capacity: int, slack: float = 0.01) -> list[list[int]]:
    """Deal items, none above capacity, into as few near-equal windows as hold them; the count rises while one is overfull."""
    count = max(1, -(-sum(sizes) // int(capacity * (1 - slack)))) if len(sizes) > 1 else 1
    while True:
        dealt = difference(sizes, count)
        if max(sum(sizes[i] for i in items) for items in dealt) <= capacity:
            return [items for items in dealt if items]
        count += 1


class _Out:
    """Rows gathered into Arrow batches of bounded size."""

    def __init__(self):
        self.rows, self.size = [], 0

    def put(self, row: tuple) -> None:
        self.rows.append(row)
        self.size += len(row[-1])

    def take(self) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.rows, strict=True), _ARROW, strict=True)], schema=_ARROW)
        self.rows, self.size = [], 0
        return batch


def pack(docs: DataFrame, capacity: int = 1024, piece: int = 341, block: int = 512, separator: int = 0, tokenizer: str | None = None, batch_bytes: int = 4 << 20) -> DataFrame:
    """Pack `docs(doc_id, text)` into sequences of at most `capacity` ids; returns one row per piece, with its ids.

    ids are unsigned little-endian 32-bit, `start` counts the document's ids before the piece, `offset` those of the
    sequence. Rows with a null or empty text are documents of the separator alone. Repeated rows and repeated or null
    doc_ids are packed each on their own; an empty table gives no rows; other columns are ignored. A text of any length is
    cut into as many pieces as it needs. capacity, piece: ids; block: pieces dealt together.
    """
    path = tokenizer or default_tokenizer()
    piece = min(piece, capacity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, out = encoder(path), _Out()
        part, given = TaskContext.get().partitionId(), 0
        waiting: list[tuple[int | None, int, int, bytes]] = []  # doc_id, start, ids of the document, ids

        def settle() -> None:
            nonlocal given, waiting
            sizes = [len(x[-1]) // 4 for x in waiting]
            for items in windows_for(sizes, capacity):
                offset, filled = 0, sum(sizes[i] for i in items)
                for i in items:
                    doc, start, whole, ids = waiting[i]
                    out.put((doc, start, sizes[i], whole, (part << 40) | given, offset, filled, ids))
                    offset += sizes[i]
                given += 1
            waiting = []

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "")
                ids.append(separator)
                whole = len(ids)
                data = np.array(ids, "<u4").tobytes()
                full = whole - whole % capacity
                for start in range(0, full, capacity):
                    out.put((doc, start, capacity, whole, (part << 40) | given, 0, capacity, data[4 * start : 4 * (start + capacity)]))
                    given += 1
                for start in range(full, whole, piece):
                    waiting.append((doc, start, whole, data[4 * start : 4 * min(start + piece, whole)]))
                if len(waiting) >= block:
                    settle()
                if out.size >= batch_bytes:
                    yield out.take()
        if waiting:
            settle()
        if out.rows:
            yield out.take()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PACKED)
