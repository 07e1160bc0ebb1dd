"""Named queries over the test tables, each with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under a name, with its DuckDB SQL."""

    def put(function):
        if name in QUERIES:
            raise ValueError(f"a query is called {name} already")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return put


def _load() -> None:
    from hushframe.plans import connectors, conversations, detection, evaluation, files, histories, payloads, scalars, streams, transcripts, turns, values, vaults, visuals  # noqa: F401  they register themselves


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict:
    _load()
    return dict(ORACLES)
