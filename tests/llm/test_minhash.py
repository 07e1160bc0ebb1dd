import random

import numpy as np

from hushframe.llm import common, minhash
from hushframe.llm.graph import components


def brute(rows, k, percent):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return sorted(((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows)), key=str)


def found(spark, rows, k, percent=80):
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n long")
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, k, percent).collect()), key=str)


def corpus(seed=4):
    dice, rows = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(300)]
    for g in range(6):
        base = dice.choices(vocabulary, k=dice.randint(30, 120))
        for _ in range((3, 5, 2, 8, 1, 60)[g]):
            words = list(base)
            for _ in range(dice.randint(0, 6)):
                words[dice.randrange(len(words))] = dice.choice(vocabulary)
            rows.append(" ".join(words).replace("w1", dice.choice(["w1", "W1"])))
    rows += ["one", "One", "two words", "", None, " \n ", "two  words", "two\x85words", rows[0], "z " * 4000]
    return [(i if i % 17 else None, t) for i, t in enumerate(rows)] + [(5, "repeated id and another text")]


def test_components_match_brute_force(spark, monkeypatch):
    rows = corpus()
    want = brute(rows, 2, 80)
    assert found(spark, rows, 2) == want
    # small blocks, so that long lists, centres and blocks of large groups are used as well
    monkeypatch.setattr(minhash, "SHORT", 4)
    monkeypatch.setattr(minhash, "BLOCK", 7)
    assert found(spark, rows, 2) == want


def test_without_documents_or_links(spark):
    assert found(spark, [], 5) == []
    assert found(spark, [(1, "a b c d e f"), (2, None)], 5) == [(1, 2, 1), (2, 0, 2)]


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}


def test_word_hashes_tell_words_apart():
    words = [f"ciónra{i}" for i in range(3000)] + ["a", "A", "é", "É"]
    text = " \n".join(words).encode()
    hashes, starts, begin = common.word_hashes(np.frombuffer(text, np.uint8), np.array([0, len(text)]), True)
    assert len(hashes) == len(words) and len(set(hashes.tolist())) == len(words) - 1 and begin.tolist() == [0, len(words)]


def test_signatures_estimate_similarity():
    dice = np.random.default_rng(1)
    a = dice.integers(0, 2**63, 1000).astype(np.uint64)
    b = np.concatenate([a[:900], dice.integers(0, 2**63, 100).astype(np.uint64)])
    same = np.mean([np.mean(minhash.signature(a ^ np.uint64(s), 64) == minhash.signature(b ^ np.uint64(s), 64)) for s in range(60)])
    assert abs(same - 900 / 1100) < 0.03


def test_recall_at_the_threshold():
    # pairs of word-pair sets at a similarity of just 0.8, of many sizes; a pair is found if enough coordinates match
    dice, missed, total = np.random.default_rng(9), 0, 0
    for n in (9, 18, 90, 450, 1800):
        for _ in range(600):
            words = np.unique(dice.integers(0, 2**63, n * 12 // 9 + 9).astype(np.uint64))
            dice.shuffle(words)
            shared, own = n * 8 // 9, n // 9
            a, b = words[: shared + own], np.concatenate([words[:shared], words[shared + own : shared + 2 * own]])
            assert 100 * shared >= 80 * (shared + 2 * own)
            total += 1
            missed += (minhash.signature(a, minhash.COORDS) == minhash.signature(b, minhash.COORDS)).sum() < minhash.MATCHES
    assert total == 3000 and missed <= 2


def test_one_row_of_each_group_stays(spark):
    a, b, c = (" ".join(f"{p}{i}" for i in range(40)) for p in "abc")
    near = a.replace("a39", "other")
    rows = [(1, a, 0), (3, near, 1), (3, b, 2), (3, b, 3), (4, b.upper().replace("B", "b"), 4), (None, c, 5), (None, c + " ", 6), (None, c, 7), (9, "", 8), (9, "", 9), (10, None, 10), (11, " ", 11)]
    df = spark.createDataFrame([(d, t, i, "x") for d, t, i in rows], "doc_id long, text string, m1 int, _stays string")
    for limit in (minhash.BROADCAST_BYTES, -1):  # the decisions broadcast, and joined by shuffle
        minhash.BROADCAST_BYTES, before = limit, minhash.BROADCAST_BYTES
        got = minhash.keep_one(df)
        assert got.columns == df.columns
        out = sorted((r.doc_id or 0, r.m1) for r in got.collect())
        minhash.BROADCAST_BYTES = before
        assert len(out) == 6 and out[1] == (1, 0) and out[2] in ((3, 2), (3, 3)) and out[0][1] in (5, 6, 7) and [d for d, _ in out[3:]] == [9, 10, 11]
    assert minhash.keep_one(df.limit(0)).count() == 0
