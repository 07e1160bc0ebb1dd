import json
import random

import pytest
from pyspark.sql import functions as F

from hushframe.operators import calc, turn_pipeline, turns, vault, vault_table
from hushframe.streaming.chunks import entities as surfaces_in

VAULT = "session string, placeholder string, entity_type string, canonical string, aliases array<string>, value double, created_turn long, last_seen_turn long"
TURNS = "session string, turn long, text string"


def empty(spark):
    return spark.createDataFrame([], VAULT)


def shown(df):
    return {(r.session, r.turn): r.sanitized for r in df.collect()}


def nothing_known_is_left(texts, after):
    known = {}
    for r in after.collect():
        known.setdefault(r.session, set()).update([r.canonical, *(r.aliases or [])])
    for session, text in texts:
        left = [s for s in known.get(session, ()) if vault.free_positions(text, s)]
        assert not left, (session, text, left)
        assert not [s for s, slug, _, _ in surfaces_in(text) if slug == "email"], text


def test_a_known_surface_never_goes_out_whatever_the_order(spark):
    first = [("s", 9, "mail jo@ex.org today"), (None, None, "mail nul@ex.org"), (None, 3, None), ("r", 1, "plain")]
    done, after = turn_pipeline.sanitize(spark.createDataFrame(first, TURNS), empty(spark))
    assert shown(done) == {("s", 9): "mail <<EMAIL_1>> today", (None, None): "mail <<EMAIL_1>>", (None, 3): None, ("r", 1): "plain"}
    second = [("s", 4, "mail jo@ex.org"), ("s", 5, "and ann@ex.org, jo@ex.org"), (None, 1, "nul@ex.org"), (None, None, "nul@ex.org, new@ex.org"), ("r", 2, "jo@ex.org")]
    done, last = turn_pipeline.sanitize(spark.createDataFrame(second, TURNS), after)
    got = shown(done)
    assert got == {("s", 4): "mail <<EMAIL_1>>", ("s", 5): "and <<EMAIL_2>>, <<EMAIL_1>>", (None, 1): "<<EMAIL_1>>", (None, None): "<<EMAIL_1>>, <<EMAIL_2>>", ("r", 2): "<<EMAIL_1>>"}
    nothing_known_is_left([(s, t) for (s, _), t in got.items()], last)
    back = vault.restore(spark.createDataFrame([(s, t, x) for (s, t), x in got.items()], TURNS), last, "session", ["turn"])
    assert {(r.session, r.turn): r.restored for r in back.collect()} == {(s, t): x for s, t, x in second}


def test_arguments_before_messages(spark):
    text = json.dumps({"to": ["jo@ex.org", {"cc": "ann@ex.org", "n": 5}], "note": "jo@ex.org"})
    calls = spark.createDataFrame([("s", 5, text), ("s", None, '["x@ex.org"]'), (None, 5, '["jo@ex.org"]'), ("s", 6, "not json jo@ex.org")], "session string, turn long, arguments string")
    done, after = turn_pipeline.sanitize_nested(calls, empty(spark))
    got = {(r.session, r.turn): r.sanitized for r in done.collect()}
    assert json.loads(got["s", 5]) == {"to": ["<<EMAIL_2>>", {"cc": "<<EMAIL_3>>", "n": 5}], "note": "<<EMAIL_2>>"} or json.loads(got["s", 5])["note"].startswith("<<EMAIL_")
    assert got[None, 5] == '["<<EMAIL_1>>"]' and got["s", None].startswith('["<<EMAIL_')
    assert {r.created_turn for r in after.collect()} == {5, None}
    back = turn_pipeline.restore_nested(done.select("session", "turn", done["sanitized"].alias("arguments")), after)
    assert {(r.session, r.turn): r.restored for r in back.collect()}["s", 5] == text
    later, _ = turn_pipeline.sanitize(spark.createDataFrame([("s", 6, "write to jo@ex.org now"), ("s", 1, "jo@ex.org")], TURNS), after)
    token = json.loads(got["s", 5])["note"]
    assert shown(later) == {("s", 6): f"write to {token} now", ("s", 1): token}


def test_numbers_minted_are_computed_with(spark):
    turns = spark.createDataFrame([("s", 1, "I paid $1,200.50 and 10%")], TURNS)
    done, after = turn_pipeline.prepare(turns, empty(spark))
    assert {r.placeholder: r.value for r in after.collect()} == {"<<FINANCE_1>>": 1200.5, "<<PERCENTAGE_1>>": 0.1}
    answer = spark.createDataFrame([("s", 1, "So <python_snippet_1>FINANCE_1 * 2</python_snippet_1> and <<FINANCE_1>>")], TURNS)
    assert turn_pipeline.finalize(answer, after).first().display_text == "So 2401 and $1,200.50"


@pytest.mark.parametrize("way", ["set", "walk"])
def test_rows_without_keys(spark, way):
    rows = [(None, 1, "a@ex.org"), (None, None, "b@ex.org a@ex.org"), ("s", None, "c@ex.org"), ("s", 2**60 + 1, "c@ex.org"), ("s", 2**60, None), (None, 2, "")]
    turns = spark.createDataFrame(rows, TURNS)
    out = turn_pipeline.sanitize(turns, empty(spark))[0] if way == "set" else vault.sanitize_sessions(turns)
    got = shown(out)
    assert set(got) == {(s, t) for s, t, _ in rows} and got["s", 2**60] is None and got[None, 2] == ""
    assert not any("@" in (t or "") for t in got.values())
    a = got[None, 1]
    assert got[None, None].endswith(" " + a) and got["s", None] == got["s", 2**60 + 1] == "<<EMAIL_1>>"


def test_tables_of_a_step_go_with_it(spark):
    from hushframe.sources import tables

    before = set(tables._kept)
    turn_pipeline.sanitize(spark.createDataFrame([("s", 1, "a@ex.org")], TURNS), empty(spark))
    assert len(set(tables._kept) - before) == 1  # the vault afterwards
    assert vault_table.COLUMNS


def test_numbers_with_the_same_digits_are_told_apart_turn_after_turn(spark):
    """$1234.5 and $123.45 have one alias key, but are two numbers."""
    _, after = turn_pipeline.sanitize(spark.createDataFrame([("s", 1, "paid $1234.5")], TURNS), empty(spark))
    done, after = turn_pipeline.sanitize(spark.createDataFrame([("s", 2, "paid $123.45")], TURNS), after)
    assert done.first().sanitized == "paid <<FINANCE_2>>"
    assert {r.canonical: r.value for r in after.collect()} == {"$1234.5": 1234.5, "$123.45": 123.45}


def test_balances_of_zero(spark):
    """Zeros keep their sign, and two expressions that read alike with values put in are two calculations."""
    answers = spark.createDataFrame([("s", 2, "<python_snippet_1>CALC_1 + 1</python_snippet_1> <python_snippet_2>A_1 + 1</python_snippet_2>"), ("s", 1, "<python_snippet_1>A_1 * 2</python_snippet_1>"), (None, None, "<python_snippet_1>2 * 2</python_snippet_1>")], TURNS)
    values = spark.createDataFrame([("s", {"A_1": -0.0})], "session string, values map<string,double>")
    got = {r.turn: r for r in calc.apply(answers, values).collect()}
    assert [got[1].display, got[2].display, got[None].display] == ["-0", "1 1", "4"]
    assert [r.placeholder for r in got[2].computations] == ["<<CALC_2>>", "<<CALC_3>>"]


def test_protecting_equals_the_comparison_of_all_pairs(spark):
    """Parts that all surfaces share, parts that few share, nulls, and surfaces and values of many parts."""
    rng = random.Random(3)
    words = lambda: [rng.choice(["all", "a", "b", "c", "d", "e", "f", "g", "h", None]) for _ in range(rng.choice((1, 2, 3, 5, 9, 14)))]
    known = [(f"<<ORG_{i}>>", "x" * rng.randint(1, 4) + str(i), words()) for i in range(60)]
    values = [(f"v{i}", words()) for i in range(60)]
    v = spark.createDataFrame([("s", *k) for k in known], "session string, placeholder string, canonical string, parts array<string>")
    a = spark.createDataFrame([("s", *x) for x in values], "session string, value string, own array<string>")
    got = {r.value: (r.shared, r.placeholder) for r in turns.protecting(a, v, "session", "value", F.col("own"), F.col("parts")).collect()}
    expected = {}
    for name, own in values:
        fits = [(len(set(own) & set(parts) - {None}), len(canonical), token) for token, canonical, parts in known]
        n, _, token = max(fits)
        if n:
            expected[name] = (n, token)
    assert got == expected


def test_texts_meet_their_sessions_surfaces_once(spark, monkeypatch):
    turns = spark.createDataFrame([("s", 1, "Ann Lee, Ann, a$5 and $5.50 on 2024-01-02"), ("s", 2, "<b>Ann</b> $5 <<PERSON_1>> Ann"), (None, None, "Ann $7 $7"), ("t", 3, None), ("t", 4, "1 PERSON $1")], "session string, turn long, text string")
    people = [(s, f"<<PERSON_{i}>>", "person", n, [n], None, None, None) for s in ("s", None) for i, n in enumerate(("Ann", "Ann Lee"), 1)] + [("t", "<<PERSON_1>>", "person", "1", ["1"], None, None, None)]
    schema = "session string, placeholder string, entity_type string, canonical string, aliases array<string>, value double, created_turn long, last_seen_turn long"
    want = [
        (None, None, "<<PERSON_1>> <<FINANCE_1>> <<FINANCE_1>>"), ("s", 1, "<<PERSON_2>>, <<PERSON_1>>, a<<FINANCE_2>> and <<FINANCE_1>> on <<DATE_1>>"),
        ("s", 2, "<b><<PERSON_1>></b> <<FINANCE_2>> <<PERSON_1>> <<PERSON_1>>"), ("t", 3, None), ("t", 4, "<<PERSON_1>> PERSON <<FINANCE_1>>"),
    ]
    for most in (vault.MOST, 2):  # the larger sessions take the other way
        monkeypatch.setattr(vault, "MOST", most)
        done, after = turn_pipeline.sanitize(turns, spark.createDataFrame(people, schema))
        assert sorted(((r.session, r.turn, r.sanitized) for r in done.collect()), key=lambda r: (r[0] or "", r[1] or 0)) == want
        back = vault.restore(done.select("session", "turn", "sanitized"), after, "session", ["turn"], text="sanitized")
        assert {(r.session, r.turn): r.restored for r in back.collect()}[("s", 1)] == "Ann Lee, Ann, a$5 and $5.50 on 2024-01-02"
        joins = [x for x in done._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
        assert most == 2 or not any("Contains" in x or "contains" in x for x in joins)


def test_a_surface_that_comes_often_is_one_row_of_what_is_kept(spark, monkeypatch):
    written = []

    def counted(df):
        out = keep(df)
        written.append(out.count())
        return out

    keep = turn_pipeline.keep
    monkeypatch.setattr(turn_pipeline, "keep", counted)
    turns = spark.createDataFrame([(s, i, "jo@ex.org paid $5") for s in ("s", None) for i in range(50)], TURNS)
    done, after = turn_pipeline.sanitize(turns, empty(spark))
    again, last = turn_pipeline.sanitize(turns, after)
    # 100 texts with two surfaces each: what is kept is a row a surface of a session.
    assert written and max(written) == 4 and after.count() == last.count() == 4
    assert {r.sanitized for r in done.unionByName(again).collect()} == {"<<EMAIL_1>> paid <<FINANCE_1>>"}
