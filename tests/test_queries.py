"""Every query of the library against its SQL in DuckDB, over the smallest tables."""

import math

import duckdb
import pytest

from hushframe.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    return f"{x:.9g}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, FOLDER)
    order = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    if name not in registry.oracle_sql():
        assert got
        return
    rel = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == order
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in order) for r in rel.fetchall())
