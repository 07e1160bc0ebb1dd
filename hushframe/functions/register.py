"""Functions of this library by name, for SQL: a chunker that returns rows, and text functions.

A host adds detectors, sanitisers or chunkers of its own the same way; `CHUNKERS` maps a content type to a function of a
payload and a size, and may be given anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from hushframe.operators import chunk, vault

CHUNKERS: dict[str, Callable[[str, int], list[str]]] = {
    "text": lambda text, size: [c for c, _, _ in chunk.paragraphs(text, size)],
    "json": lambda text, size: chunk.json_chunks(text, size),
    "markdown": lambda text, size: chunk.markdown_chunks(text, size),
}


def register(spark: SparkSession, chunkers: dict | None = None, sanitize: Callable[[str], str] | None = None) -> None:
    """Make chunk_payload(kind, payload, size) a table function of (idx, chunk), and alias_key(text) a function; with sanitize, also sanitize_text(text).

    A kind without a chunker is cut as text.
    """
    known = dict(CHUNKERS if chunkers is None else chunkers)

    class Chunker:
        def eval(self, kind: str, payload: str, size: int):
            if payload:
                yield from enumerate(known.get(kind, known["text"])(payload, size))

    spark.udtf.register("chunk_payload", udtf(Chunker, returnType="idx int, chunk string"))
    spark.udf.register("alias_key", vault.alias_key, "string")
    if sanitize is not None:
        spark.udf.register("sanitize_text", sanitize, "string")
