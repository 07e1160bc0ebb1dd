import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from hushframe.llm import linededup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, least):
    """Lines of every run of whole lines with `least` words that occurs at an earlier place, by comparing all places."""
    docs = sorted(((d, t) for d, t in rows), key=lambda x: (x[0] is None, x[0] or 0))
    solid = []
    for d, t in docs:
        lines = (t or "").split("\n")
        solid.append([(i, tuple(WORD.findall(x))) for i, x in enumerate(lines) if WORD.search(x)])
    gone = {i: set() for i in range(len(docs))}
    for x in range(len(docs)):
        for i in range(len(solid[x])):
            for y in range(x + 1):
                for j in range(len(solid[y])):
                    if (y, j) >= (x, i):
                        continue
                    n = 0
                    while i + n < len(solid[x]) and j + n < len(solid[y]) and solid[x][i + n][1] == solid[y][j + n][1]:
                        n += 1
                    if n and sum(len(w) for _, w in solid[x][i : i + n]) >= least:
                        gone[x] |= set(range(solid[x][i][0], solid[x][i + n - 1][0] + 1))
    return {docs[x][0]: sorted(g) for x, g in gone.items()}


def run(spark, rows, least):
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, n_lines long")
    return {r.doc_id: r for r in linededup.dedup(df, least).collect()}


def corpus(seed):
    dice = random.Random(seed)
    pool = [" ".join(dice.choices("abcdefgh", k=dice.randint(0, 4))) for _ in range(9)]
    return [(i if i else None, "\n".join(dice.choices(pool, k=dice.randint(0, 14))) if i % 9 else None) for i in range(25)]


def test_removed_lines_match_brute_force(spark):
    for seed in range(3):
        rows = corpus(seed)
        got = run(spark, rows, 5)
        want = brute(rows, 5)
        assert {d: r.removed for d, r in got.items()} == want
        for d, t in rows:
            lines = t.split("\n") if t else []
            assert got[d].n_lines == len(lines)
            if want[d]:
                assert got[d].kept_text == "\n".join(x for i, x in enumerate(lines) if i not in want[d])
            else:
                assert got[d].kept_text == t


def test_long_passage_is_caught_once(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, f"own start\n{passage}\nown end"), (2, passage), (3, f"x\n{passage}"), (4, "clean text of its own"), (5, "\n\n"), (6, "")]
    got = run(spark, rows, 50)
    assert {d: r.removed for d, r in got.items()} == {1: [], 2: [0], 3: [1], 4: [], 5: [], 6: []}
    assert got[3].kept_text == "x" and got[1].kept_text == rows[0][1]


def test_repeated_rows_and_ids(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    df = spark.createDataFrame([(1, passage), (1, passage), (2, passage + "\nz")], "doc_id long, text string")
    out = [(r.doc_id, r.removed) for r in linededup.dedup(df).orderBy("doc_id").collect()]
    assert out == [(1, []), (1, []), (2, [0])]
    assert linededup.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 9), max_size=14), st.integers(1, 20))
def test_runs_cover_every_passage(sizes, least):
    import numpy as np

    lines = np.arange(len(sizes), dtype=np.uint64)
    _, _, first, last = linededup.runs(lines, np.array(sizes, np.int64), least)
    spans = list(zip(first, last))
    for a in range(len(sizes)):
        for b in range(a, len(sizes)):
            inside = {i for f, t in spans if a <= f and t <= b for i in range(f, t + 1)}
            assert inside == (set(range(a, b + 1)) if sum(sizes[a : b + 1]) >= least else set())


def test_shared_and_null_ids_keep_what_occurs_once(spark):
    passage = lambda p: " ".join(f"{p}{i}" for i in range(60))
    own = [(None, f"head {k}\n{passage(k)}\ntail {k}") for k in "abc"] + [(7, f"{passage('d')}\n{passage('e')}"), (7, f"one\ntwo\n{passage('f')}")]
    rows = [*own, (None, f"late\n{passage('a')}"), (8, f"{passage('f')}\nend"), (None, f"last\n{passage('d')}")]
    df = spark.createDataFrame([(d, t, i, "x") for i, (d, t) in enumerate(rows)], "doc_id long, text string, _spans int, _cut string")
    out = {r["_spans"]: r for r in linededup.dedup(df, 50).collect()}
    assert len(out) == len(rows) and out[0]["_cut"] == "x"
    # rows of one id are documents of their own: only what occurred before goes
    assert [out[i].removed for i in (1, 2, 3, 4, 6, 7)] == [[], [], [], [], [0], [1]]
    # the passage shared by two rows with a null id stays in one of them
    assert sorted(map(tuple, (out[0].removed, out[5].removed))) == [(), (1,)]
    assert all((r.kept_text == rows[i][1]) == (not r.removed) for i, r in out.items())
