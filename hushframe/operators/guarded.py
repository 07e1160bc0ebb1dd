"""Detectors that may fail: called chunk by chunk, with a time limit, and believed only where the text bears them out.

A detector here is any Python function of a text that returns entities (surface, type), a model behind it or not. What goes
wrong in a call, an exception, a time limit passed, an answer of another shape, fails its chunk, with the reason; one failed
chunk fails its text, which then doesn't go out. `Switches` turns the whole off only where a session says so in so many words, and
`Worker` is the pair of ways, out and back, that an intent's turns go.
"""

from __future__ import annotations

import queue
import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hushframe.operators import chunk, detect, forms, turn_pipeline
from hushframe.sources.tables import keep, release

#: Seconds that a detector has for a chunk, and calls that a task has in flight (fixed values).
SECONDS, AT_ONCE = 30.0, 4
#: Characters on either side of a cut that a detector sees once more together, for what the cut goes through.
SEAM = 1000
_ENTITY = pa.list_(pa.struct([("entity_text", pa.string()), ("entity_type", pa.string())]))
_FOUND = "entities array<struct<entity_text:string,entity_type:string>>, failed boolean, reason string, across array<struct<entity_text:string,entity_type:string>>, seam_failed boolean"


def _answer(value) -> list[dict]:
    """Entities of a detector's answer; a TypeError if it isn't a list of pairs of texts."""
    if not isinstance(value, list | tuple):
        raise TypeError("no list of entities")
    out = []
    for pair in value:
        if not isinstance(pair, list | tuple) or len(pair) != 2 or not all(isinstance(x, str) for x in pair):
            raise TypeError("no pair of surface and type")
        out.append({"entity_text": pair[0], "entity_type": pair[1]})
    return out


def _calls(call: Callable, texts: list[str], seconds: float, at_once: int) -> list[tuple[list[dict], bool, str | None]]:
    """Call a detector on texts, some at once; each call has its seconds from when it begins. A call that hangs is left behind."""
    results: list = [None] * len(texts)
    done: queue.Queue = queue.Queue()

    def one(i: int) -> None:
        try:
            done.put((i, (_answer(call(texts[i])), False, None)))
        except Exception as e:  # noqa: BLE001  any failure fails the chunk
            done.put((i, ([], True, type(e).__name__)))

    running: dict[int, float] = {}
    following = 0
    while following < len(texts) or running:
        while following < len(texts) and len(running) < at_once:
            running[following] = time.monotonic() + seconds
            threading.Thread(target=one, args=(following,), daemon=True).start()
            following += 1
        try:
            i, result = done.get(timeout=max(0.0, min(running.values()) - time.monotonic()))
            if running.pop(i, None) is not None:
                results[i] = result
        except queue.Empty:
            now = time.monotonic()
            for i in [i for i, until in running.items() if until <= now]:
                running.pop(i)
                results[i] = ([], True, "timeout")
    return results


def _crosses(surface: str, text: str, at: int) -> bool:
    """Whether a surface stands in a text across a place."""
    return bool(surface) and 0 <= text.find(surface, max(0, at - len(surface) + 1), at + len(surface) - 1)


def detect_chunks(texts: DataFrame, call: Callable[[str], list], keys: list[str], chunk_chars: int = chunk.MAX_CHARS, seconds: float = SECONDS, at_once: int = AT_ONCE) -> DataFrame:
    """Chunks of texts(keys, text) with what a detector found in each: (keys, idx, chunk, after, entities, failed, reason, across, seam_failed).

    call runs in the tasks, on one chunk at a time, at_once of them side by side. reason: 'timeout', or the name of the
    exception (TypeError for an answer that is no list of pairs of texts). Null and empty texts have no chunks.
    What a cut goes through is looked for in a call of its own, over the SEAM characters before it and after it: across are the
    surfaces that stand there across the cut between this chunk and the next, seam_failed says that the call failed.
    """
    cut = chunk.hard_cut(texts.select(*keys, "text", F.col("text").alias("_whole")), max_chars=chunk_chars)
    cut = cut.select(F.struct(*keys).alias("k"), "idx", "chunk", F.substring("_whole", F.col("span_end") + 1, F.lit(SEAM)).alias("after"))
    schema = StructType([*cut.schema.fields, *StructType.fromDDL(_FOUND).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, after = batch.column("chunk").to_pylist(), batch.column("after").to_pylist()
            found = _calls(call, texts, seconds, at_once)
            entities, failed, reason = ([x[i] for x in found] for i in range(3))
            cuts = [i for i, a in enumerate(after) if a]
            seams = [texts[i][-SEAM:] + after[i] for i in cuts]
            across, seam_failed = [[] for _ in texts], [False] * len(texts)
            for i, seam, (own, wrong, _) in zip(cuts, seams, _calls(call, seams, seconds, at_once), strict=True):
                across[i] = [e for e in own if _crosses(e["entity_text"], seam, min(SEAM, len(texts[i])))]
                seam_failed[i] = wrong
            columns = [*batch.columns, pa.array(entities, _ENTITY), pa.array(failed, pa.bool_()), pa.array(reason, pa.string()), pa.array(across, _ENTITY), pa.array(seam_failed, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["k", "idx", "chunk", "after", "entities", "failed", "reason", "across", "seam_failed"])

    out = cut.mapInArrow(run, schema)
    return out.select(*[F.col(f"k.`{k}`").alias(k) for k in keys], "idx", "chunk", "after", "entities", "failed", "reason", "across", "seam_failed")


def believed(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Entities of `detect_chunks` that stand in their chunk, or across its end, and have a known type, each surface of a text once: as a detector's rows."""
    rows = chunks.select(*keys, "idx", "chunk", F.posexplode(F.concat("entities", "across")).alias("nth", "e")).select(*keys, "idx", "nth", "chunk", "e.*")
    own = forms.checked(rows, chunks.select(*keys, "idx", F.concat("chunk", "after").alias("text")), [*keys, "idx"])
    rank = F.col("idx").cast("long") * 1_000_000_000 + F.col("nth")
    return detect.by_priority(own.select(*keys, F.lit(0).alias("source_rank"), rank.alias("detect_rank"), "entity_text", "entity_type"), keys)


def sanitize(turns: DataFrame, entities: DataFrame, call: Callable[[str], list], tool: Column | None = None, fail_open: bool = False, **how) -> tuple[DataFrame, DataFrame, DataFrame]:
    """`turn_pipeline.sanitize` with a detector that may fail: (turns with sanitized, modified and failed; entities; traces).

    A text of which a chunk failed gives way to a note (see `turn_pipeline.on_failure`); with fail_open it goes out with what is
    known replaced. traces: (session, turn, idx, entities, failed, reason), a row per chunk. how: as of `detect_chunks`.
    """
    keys = ["session", "turn"]
    chunks = keep(detect_chunks(turns, call, keys, **how))
    done, after = turn_pipeline.sanitize(turns, entities, believed(chunks, keys))
    flags = turn_pipeline.failed_texts(chunks.withColumn("failed", F.col("failed") | F.col("seam_failed")), keys).select(F.col("session").alias("_s"), F.col("turn").alias("_t"), F.col("failed").alias("failed"))
    joined = done.join(flags, done["session"].eqNullSafe(F.col("_s")) & done["turn"].eqNullSafe(F.col("_t")), "left").drop("_s", "_t")
    joined = joined.withColumn("failed", F.coalesce("failed", F.lit(False)))
    shown = joined if fail_open else turn_pipeline.on_failure(joined, F.col("failed"), tool)
    return shown, after, chunks.select(*keys, "idx", F.size("entities").alias("entities"), "failed", "reason")


@dataclass(frozen=True)
class Switches:
    """Whether turns are sanitised at all, and images too."""

    privacy: bool = True
    visual: bool = False

    @classmethod
    def of(cls, spark: SparkSession) -> Switches:
        """From the session's hushframe.privacy and hushframe.visual. Privacy is off only if it says 'false', images are covered only if it says 'true'."""
        told = lambda name: (spark.conf.get(f"hushframe.{name}", None) or "").strip().lower()
        return cls(told("privacy") != "false", told("visual") == "true")


@dataclass(frozen=True)
class Worker:
    """A way out and a way back: prepare(turns, entities) to rows with remote_text and the entities after, finalize(answers, entities)."""

    prepare: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]] = turn_pipeline.prepare
    finalize: Callable[[DataFrame, DataFrame], DataFrame] = turn_pipeline.finalize


def prepare(turns: DataFrame, entities: DataFrame, workers: dict[str, Worker], intent: Column, switches: Switches = Switches()) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """Turns by their intent's worker ('chat' for others): (session, turn, intent, remote_text, was_sanitized, tokens), and the entities after all.

    The vault goes from one worker to the next, so that all share tokens. With privacy off, texts go out as they are.
    """
    rows = keep(turns.withColumn("intent", F.when(intent.isin(*workers), intent).otherwise(F.lit("chat"))))
    if not switches.privacy:
        plain = F.array().cast("array<string>")
        return rows.select("session", "turn", "intent", F.col("text").alias("remote_text"), F.lit(False).alias("was_sanitized"), plain.alias("tokens")), entities
    parts = []
    for name, worker in workers.items():
        done, entities = worker.prepare(rows.filter(F.col("intent") == name).drop("intent"), entities)
        parts.append(done.withColumn("intent", F.lit(name)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    out = keep(out.select("session", "turn", "intent", "remote_text", "was_sanitized", "tokens"))
    release(rows)
    return out, entities
