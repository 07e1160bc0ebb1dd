import hashlib
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from hushframe.llm import periodicity, queries
from hushframe.llm.periodicity import Extensions, collapsed, periodic_runs, runs


def brute(words, least=6, times=4):
    """Every period by itself: maximal stretches of words that equal the one a period later, without those of a smaller period."""
    number, n, out = {}, len(words), []
    ids = np.array([number.setdefault(w, len(number)) for w in words])
    for q in range(1, n // times + 1):
        same = np.concatenate([[False], ids[:-q] == ids[q:], [False]])
        starts, ends = np.flatnonzero(~same[:-1] & same[1:]), np.flatnonzero(same[:-1] & ~same[1:])
        for s, e in zip(starts.tolist(), (ends + q).tolist(), strict=True):
            if e - s >= max(least, times * q) and not any((ids[s : e - p] == ids[s + p : e]).all() for p in range(1, q)):
                out.append((s, e - s, q))
    return sorted(out)


def test_runs_match_brute_force():
    dice = random.Random(5)
    for k in range(1500):
        words = dice.choices("abcd"[: dice.randint(1, 4)], k=dice.randint(0, 60))
        if k % 3 == 0:  # repeats of repeats
            part = dice.choices("abc", k=dice.randint(1, 5)) * dice.randint(1, 6)
            words = (words[:4] + part) * dice.randint(1, 5) + words
        assert runs(words) == brute(words), words
        assert runs(words, 4, 2) == brute(words, 4, 2), words


@pytest.mark.parametrize("words", [["a"] * 3000, list("ab") * 900 + ["a"], [chr(97 + bin(i).count("1") % 2) for i in range(2048)], (list("aab") * 40 + ["c"]) * 9])
def test_runs_of_long_repeats(words):
    assert runs(words) == brute(words)
    assert runs(words, 2, 2) == brute(words, 2, 2)


def test_a_text_of_a_million_words():
    words = [f"p{i % 7}" for i in range(400_000)] + [str(i) for i in range(300_000)] + ["x"] * 300_000
    assert runs(words) == [(0, 400_000, 7), (700_000, 300_000, 1)]


def test_extensions_are_those_of_the_words():
    dice = random.Random(2)
    ids = dice.choices([0, 1], k=40) * 6 + dice.choices([0, 1], k=50)
    reach = Extensions(ids)
    for _ in range(3000):
        i, j = sorted(dice.sample(range(len(ids)), 2))
        right = next((k for k in range(len(ids) - j) if ids[i + k] != ids[j + k]), len(ids) - j)
        left = next((k for k in range(i) if ids[i - k - 1] != ids[j - k - 1]), i)
        assert (reach.right(i, j), reach.left(i, j)) == (right, left)


def test_a_hash_that_lies_costs_nothing(monkeypatch):
    words = list("abcabcabcabcabcabcabcabcxabcabcabcabcabcabcabcabcabcabcyab") * 3
    want = brute(words)
    monkeypatch.setattr(Extensions, "_hash", lambda self, start, end: 0)
    assert runs(words) == want


def test_bounds_are_checked():
    assert runs(["a"] * 5) == [] and runs(["a"] * 6) == [(0, 6, 1)] and runs(list("ab") * 4) == [(0, 8, 2)] and runs(list("ababababa")) == [(0, 9, 2)]
    assert collapsed(list("xababababay"), runs(list("xababababay"))) == list("xaby")
    with pytest.raises(ValueError):
        runs(["a"], 1, 1)


def test_rows_of_any_kind(spark):
    texts = [None, "", " \t\n", "a " * 7, "ä\x85b " * 5, "one two\x0bone\x0ctwo\rone two one two", "a " * 7, "x y " * 6]
    rows = [(i % 4 or None, t, 7, "c") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs int, `a b.c` string")
    out = periodic_runs(df, keep=("doc_id", "runs", "a b.c")).collect()
    assert out[0].__fields__ == ["doc_id", "a b.c", "n_words", "runs", "collapsed"]
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in out]
    a, b = [(0, 7, 1)], [(0, 8, 2)]
    want = [(None, 0, [], ""), (1, 0, [], ""), (2, 0, [], ""), (3, 7, a, "a"), (None, 5, [], " ".join(["ä\x85b"] * 5)), (1, 8, b, "one two"), (2, 7, a, "a"), (3, 6, [(0, 6, 1)], "x y")]
    assert got == want
    assert periodic_runs(df.limit(0)).count() == 0 and periodic_runs(df, keep=()).count() == 8


def expected(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    gone = {i for s, k, q in found for i in range(s + q, s + k)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    lines = digest("".join(f"{s},{k},{q}\n" for s, k, q in found).encode())
    kept = digest(b" ".join(w for i, w in enumerate(words) if i not in gone))
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], lines, kept)


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_query_matches_brute_force(spark, folder):
    docs = pq.read_table(f"/root/testdata/{folder}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    got = sorted(tuple(r) for r in queries.op13_periodic_runs(spark, f"/root/testdata/{folder}").collect())
    assert got == sorted(expected(d["doc_id"], d["text"]) for d in docs)
    assert sum(r[1] > 0 for r in got) > 5


def test_planted_tails(spark):
    rows = [(i, t) for i in range(60) for t in ("a b c d e f g h i j k l m n o p", "", None, " one ")] + [(None, "x y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("text", "body")
    got = sorted(((r.doc_id, r.body) for r in periodicity.planted(df, text_col="body").collect()), key=str)
    want = []
    for d, t in rows:
        words, h = (t or "").split(), zlib.crc32(str(d).encode())
        if d is not None and h % 10 == 0:
            n, g = len(words), h // 10
            a = g % n if n else 0
            t = " ".join(words[i] if i < a else words[a + (i - a) % (1 + (n - a) // (3 + g % 8))] for i in range(n))
        want.append((d, t))
    assert got == sorted(want, key=str)
