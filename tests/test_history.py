import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hushframe.functions import scalars
from hushframe.operators import history, vault_table, visual
from hushframe.sources import files

SCHEMA = "s int, idx int, role string, tokens long, calls array<string>, call_id string"


def legal(messages):
    declared, start = set(), 0
    for i, m in enumerate(messages):
        if m[2] == "assistant":
            declared |= set(m[4])
        elif m[2] == "tool" and m[5] and m[5] not in declared:
            start, declared = i + 1, set()
    return messages[start:]


def brute_replay(messages, n, budget):
    kept = messages[-n:]
    user = next((i for i, m in enumerate(kept) if m[2] == "user"), 0)
    out = legal(kept[user:])
    tail, used = [], 0
    for m in reversed(out):
        if tail and used + m[3] > budget:
            break
        tail, used = [m, *tail], used + m[3]
    user = next((i for i, m in enumerate(tail) if m[2] == "user"), None)
    if user is None:
        back = next((i for i in range(len(out) - 1, -1, -1) if out[i][2] == "user"), None)
        return legal(out[back:] if back is not None else tail)
    return legal(tail[user:])


def sessions(seed, n=40):
    dice, out = random.Random(seed), []
    for s in range(n):
        for i in range(dice.randint(1, 30)):
            role = dice.choice(("user", "assistant", "assistant", "tool", "tool") if s % 4 else ("assistant", "tool"))
            calls = [f"k{dice.randrange(6)}" for _ in range(dice.randrange(3))] if role == "assistant" else []
            out.append((s, i, role, dice.randint(1, 30), calls, f"k{dice.randrange(6)}" if role == "tool" and dice.random() < 0.9 else None))
    return out


def test_replay_matches_a_walk(spark):
    rows = sessions(1)
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.s, r.idx) for r in history.replay(df, "s", 10, 70).collect())
    want = sorted((m[0], m[1]) for s in {r[0] for r in rows} for m in brute_replay([r for r in rows if r[0] == s], 10, 70))
    assert got == want and len(want) > 50


def test_suffix_matches_a_walk(spark):
    rows = sessions(2)
    judged = history.legal_suffix(spark.createDataFrame(rows, SCHEMA), "s", 6, F.lit(4)).collect()
    for s in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == s]
        kept = own[-6:]
        user = next((i for i, m in enumerate(kept) if m[2] == "user"), None)
        last = next((i for i in range(len(own) - 1, -1, -1) if own[i][2] == "user"), None)
        kept = kept[user:] if user is not None else own[last : last + 6] if last is not None else kept
        want = {m[1] for m in (legal(kept) if len(own) > 6 else own)}
        assert {r.idx for r in judged if r.s == s and r.retained} == want
        assert {r.idx for r in judged if r.s == s and r.was_consolidated} == {m[1] for m in own if m[1] < 4}


def test_consolidation_in_rounds(spark):
    rows = sessions(3)
    got = {r.s: (r.consolidated, r.tokens) for r in history.consolidate(spark.createDataFrame(rows, SCHEMA), "s", 120, 60, rounds=4).collect()}
    for s in {r[0] for r in rows}:
        own, start = [r for r in rows if r[0] == s], 0
        for _ in range(4):
            left = sum(m[3] for m in own[start:])
            if left <= 120:
                break
            removed, best = 0, None
            for m in own[start:]:
                if m[1] > start and m[2] == "user":
                    best = (m[1], removed)
                    if removed >= left - 60:
                        break
                removed += m[3]
            start = best[0] if best else start
        assert got[s] == (start, sum(m[3] for m in own[start:]))


def test_places_are_numbered_in_order(spark):
    dice = random.Random(1)
    values = dice.sample(range(10**6), 500)
    placed = history.place(spark.createDataFrame([(v,) for v in values], "v int"), [F.col("v")], "n").collect()
    assert sorted((r.n, r.v) for r in placed) == list(enumerate(sorted(values), 1))


@settings(max_examples=15, deadline=None)
@given(st.integers(0, 10**6))
def test_needles_match_brute_force(spark, seed):
    dice = random.Random(seed)
    words = [(0, i, w, w, i, 0, i + 1, 1) for i, w in enumerate(dice.choices(["a1", "b2", "c3", "longtoken1", "longtoken12", "d4"], k=30))]
    needles = [(0, f"n{k}", dice.choices(["a1", "b2", "c3", "longtoken1", "zz"], k=dice.randint(1, 5))) for k in range(6)]
    df = spark.createDataFrame(words, "image int, place int, text string, token string, left int, top int, right int, bottom int")
    asked = spark.createDataFrame(needles, "image int, needle string, tokens array<string>")
    got = sorted((r.needle, r.first, r.left, r.right) for r in visual.match_needles(df, asked, "image").collect())
    tokens, want = [w[3] for w in words], []
    for _, name, t in needles:
        if len(t) == 1:
            want += [(name, i, i, i + 1) for i, w in enumerate(tokens) if w == t[0] or (min(len(w), len(t[0])) >= 8 and (w in t[0] or t[0] in w))]
            continue
        spans = range(len(tokens) - len(t) + 1)
        good = [i for i in spans if tokens[i : i + len(t)] == t]
        if not good and len(t) >= 3:
            good = [i for i in spans if sum(w in t for w in tokens[i : i + len(t)]) >= max(2, (len(t) * 7 + 9) // 10)]
        want += [(name, i, i, i + len(t)) for i in good]
    assert got == sorted(want)


def test_vault_numbers_go_on(spark):
    known = spark.createDataFrame([("s", "<<EMAIL_4>>", "email", "a@b.org", ["a@b.org", "<<X_1>>"], None, 1, 1), ("s", "<<EMAIL_9>>", "email", "<<EMAIL_1>>", [], None, 1, 1)], "session string, placeholder string, entity_type string, canonical string, aliases array<string>, value double, created_turn long, last_seen_turn long")
    clean = vault_table.prune(known)
    assert [(r.placeholder, r.aliases) for r in clean.collect()] == [("<<EMAIL_4>>", ["a@b.org"])]
    found = spark.createDataFrame([("s", 2, 5, "c@d.org", "email"), ("s", 2, 1, "longer@d.org", "email"), ("t", 1, 0, "x@y.org", "email")], "session string, turn long, detect_rank long, entity_text string, entity_type string")
    assert {(r.session, r.canonical): r.placeholder for r in vault_table.mint_into(found, clean).collect()} == {("s", "longer@d.org"): "<<EMAIL_5>>", ("s", "c@d.org"): "<<EMAIL_6>>", ("t", "x@y.org"): "<<EMAIL_1>>"}


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"role": "user"}\nbroken {\n[1]\n{"role": "x"}\n')
    (tmp_path / "b.jsonl").write_text('{"pad": "' + "x" * 5000 + '"}')
    lines = files.read_transcripts(spark, str(tmp_path), limit=1000).collect()
    assert [(r.session, r.line_no) for r in lines] == [("a", 0), ("a", 3)]
    (tmp_path / "d").mkdir()
    for name, data in {"u.txt": "é".encode(), "l.txt": "é".encode("latin-1"), "z.txt": b"a\x00", "p.exe": b"x"}.items():
        (tmp_path / "d" / name).write_bytes(data)
    read = files.read_files(spark, str(tmp_path / "d"))
    got = {r.path[-5:]: (r.document, r.refused) for r in files.documents(read).collect()}
    assert got == {"u.txt": ("é", None), "l.txt": ("é", None), "z.txt": (None, "binary"), "p.exe": (None, "no extractor")}
    assert [r.entry for r in files.listing(read, str(tmp_path / "d"), limit=2).collect()] == ["l.txt", "p.exe"]
    assert spark.range(1).select(scalars.mime_of(F.lit("a.TXT"))).first()[0] == "text/plain"


def test_cron(spark):
    import datetime as dt

    ms = lambda *a: int(dt.datetime(*a, tzinfo=dt.UTC).timestamp() * 1000)
    cases = [
        ("0 12 * * *", ms(2024, 1, 1, 12), "UTC", ms(2024, 1, 2, 12)),
        ("0 12 * * 7", ms(2024, 1, 1, 0), "UTC", ms(2024, 1, 7, 12)),
        ("0 0 13 * 5", ms(2024, 9, 1, 0), "UTC", ms(2024, 9, 6, 0)),
        ("30 2 * * *", ms(2024, 3, 30, 12), "Europe/Berlin", ms(2024, 4, 1, 0, 30)),
        ("30 2 * * *", ms(2024, 10, 26, 12), "Europe/Berlin", ms(2024, 10, 27, 0, 30)),
        ("5-20/5,50 0 29 2 *", ms(2023, 1, 1), "UTC", ms(2024, 2, 29, 0, 5)),
        ("61 * * * *", ms(2023, 1, 1), "UTC", None),
        (None, ms(2023, 1, 1), "UTC", None),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, e string, n long, z string, want long")
    out = df.select("i", "want", history.cron_next(F.col("e"), F.col("n"), F.col("z")).alias("got")).orderBy("i").collect()
    assert [r.got for r in out] == [r.want for r in out]
