import json
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from hushframe.operators import detect
from hushframe.operators.vault import Vault, apply_minted, replace_all, resolve_aliases, restore
from hushframe.plans.streams import run_once
from hushframe.streaming.chunks import HOLD, Restorer, Sanitizer, entities
from hushframe.streaming.sessions import sanitize_stream, use_state_store


def test_apply():
    assert Vault().sanitize("Alice alice@example.com", [("Alice", "person", None), ("alice@example.com", "email", None)]) == "<<PERSON_1>> <<EMAIL_1>>"
    assert Vault().sanitize("张伟明和张伟", [("张伟", "person", None), ("张伟明", "person", None)]).startswith("<<PERSON_1>>和")
    v = Vault()
    assert v.sanitize("Hello Alice", [("Alice", "person", None)]) == "Hello <<PERSON_1>>" and v.sanitize("Alice again", []) == "<<PERSON_1>> again"
    assert v.counters == {"PERSON": 1}
    assert Vault().sanitize("<<PERSON_1>> has 1 cat", [("1", "amount", 1.0)]) == "<<PERSON_1>> has <<AMOUNT_1>> cat"
    assert Vault().sanitize("Amount is $<<AMOUNT_1>>", [("$<<AMOUNT_1>>", "amount", None)]) == "Amount is $<<AMOUNT_1>>"


def test_aliases():
    v = Vault()
    assert v.token("Laurie Luo", "PERSON") == v.token("Laurie", "PERSON") == "<<PERSON_1>>"
    assert v.token("An", "PERSON") == "<<PERSON_2>>"
    assert v.token("Café X", "ORG") == v.token("Cafe X", "ORG")
    v.token("Laurie Smith Jones", "PERSON")
    assert v.known("Laurie", "PERSON") == "<<PERSON_1>>"
    strict, loose = Vault(), Vault(strict=False)
    assert strict.token("$1,200.50", "FINANCE") != strict.token("$120,050", "FINANCE")
    assert loose.token("$1,200.50", "FINANCE") == loose.token("$120,050", "FINANCE")


def test_restore():
    v = Vault(canonical={"<<PERSON_10>>": "Bob", "<<PERSON_1>>": "Alice"})
    assert v.restore("<<PERSON_10>> and <<PERSON_1>>, PERSON_1, <<PERSON_2>>") == "Bob and Alice, PERSON_1, <<PERSON_2>>"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab<>_PERSON1 ", max_size=60), st.lists(st.sampled_from(["a", "ab", "aba", "PERSON", "b a"]), max_size=4))
def test_replacing_never_breaks_tokens(text, surfaces):
    pairs = [(s, f"<<X_{i}>>") for i, s in enumerate(dict.fromkeys(surfaces), 1)]
    back = replace_all(text, pairs)
    for s, t in pairs:
        back = back.replace(t, s)
    assert back == replace_all(text, []) or "<<X_" in text


def test_stream_never_shows_an_entity():
    secret = "someone.else@example.org"
    whole = "plain words " * 300 + secret + " and more words" * 300
    dice = random.Random(1)
    for _ in range(40):
        machine, out, at = Sanitizer(), [], 0
        while at < len(whole):
            n = dice.choice((1, 7, 100, 4096))
            out.append(machine.feed(whole[at : at + n], at + n >= len(whole)))
            at += n
        joined = "".join(out)
        assert secret not in joined and joined.count("<<EMAIL_1>>") == 1 and machine.vault.restore(joined) == whole
    assert len(secret) < HOLD and entities(secret)[0][:2] == (secret, "email")


def test_stream_restores_at_every_split():
    text, known = "a <<PERSON_1>> b <<X_2>> c < d << e", {"<<PERSON_1>>": "Alice"}
    want = Vault(canonical=known).restore(text)
    for i in range(len(text)):
        r = Restorer(known)
        assert r.feed(text[:i]) + r.feed(text[i:], True) == want


def test_sanitize_stream_takes_chunks_in_order(spark, tmp_path):
    parts = [("s", 1, 1, "example.com bye", True), ("s", 1, 0, "write to me@", False), ("s", 2, 0, "nothing", True)]
    for i, p in enumerate(parts):
        (tmp_path / f"{i}.json").write_text(json.dumps(dict(zip(("session", "stream", "seq", "chunk", "last"), p, strict=True))))
    stream = spark.readStream.schema("session string, stream long, seq long, chunk string, last boolean").option("maxFilesPerTrigger", 1).json(str(tmp_path))
    out = {}
    use_state_store(spark)
    for r in run_once(sanitize_stream(stream)).orderBy("stream", "seq").collect():
        out[r.stream] = out.get(r.stream, "") + r.emitted
    assert out == {1: "write to <<EMAIL_1>> bye", 2: "nothing"}


def test_sessions_keep_their_own_tokens(spark):
    rows = [("s1", 1, "a@b.org c@d.org"), ("s2", 1, "c@d.org"), ("s2", 2, "a@b.org and c@d.org"), (None, 1, "e@f.org c@d.org"), ("s3", 1, "nothing"), ("s3", None, "x@y.org")]
    docs = spark.createDataFrame(rows, "session string, turn long, text string")
    found = detect.by_priority(detect.detect(docs), ["session", "turn"])
    minted = detect.mint(found, "session", "turn")
    out = {(r.session, r.turn): (r.sanitized, r.modified) for r in apply_minted(docs, found, minted, "session", "turn").collect()}
    assert out["s2", 1] == ("<<EMAIL_1>>", True) and out["s3", 1] == ("nothing", False) and out["s3", None] == ("<<EMAIL_1>>", True)
    assert out["s1", 1][0] == "<<EMAIL_1>> <<EMAIL_2>>" and out["s2", 2][0] == "<<EMAIL_2>> and <<EMAIL_1>>" and out[None, 1][0].count("<<EMAIL_") == 2
    clean = spark.createDataFrame([(s, t, x) for (s, t), (x, _) in out.items() if s], "session string, turn long, text string")
    back = {(r.session, r.turn): r.restored for r in restore(clean, minted, "session", ["turn"]).collect()}
    assert all(back[s, t] == x for s, t, x in rows if s and t)


def test_aliases_by_join_are_those_of_the_vault(spark):
    known = [("s", "<<ORG_1>>", "anthropic inc"), ("s", "<<ORG_2>>", "laurie luo"), ("s", "<<ORG_3>>", "laurie smith jones"), ("s", "<<ORG_4>>", "an")]
    asked = ["anthropic", "laurie", "luo", "smith jones", "laurie smith", "anthropic inc of america", "an", "a", "new anthropic inc", "jones laurie", "thropic inc", "an apple"]
    held = spark.createDataFrame(known, "session string, placeholder string, alias string")
    df = spark.createDataFrame([(i, "s", a) for i, a in enumerate(asked)] + [(99, "t", "an")], "i int, session string, surface string")
    got = {r.i: r.placeholder for r in resolve_aliases(df, held, ["i"]).collect()}
    vault = Vault()
    for _, token, alias in known:
        vault.keys[token] = [alias]
        vault.by_key.setdefault(alias, token)
    assert got[99] is None and [got[i] for i in range(len(asked))] == [vault.known(a, "ORG") for a in asked]
    assert got[0] == "<<ORG_1>>" and got[1] is None and got[3] == "<<ORG_3>>"


def test_no_cut_of_a_stream_shows_a_secret():
    secrets = ['api_key = "' + "Zk9" * 110 + '"', "+49 (151) 555-1234", "https://example.org/" + "path/" * 90, "/srv/data/" + "x" * 300, "someone@" + "sub." * 80 + "example.org", "4111111111111111"]
    whole = " filler words here ".join(secrets) + " the end"
    whole = whole + " " + "more text " * 80 + whole
    surfaces = {s for s, *_ in entities(whole)}
    assert set(secrets[:1]) <= surfaces and len(surfaces) >= 6
    dice = random.Random(2)
    for trial in range(30):
        machine, out, at = Sanitizer(), [], 0
        while at < len(whole):
            n = dice.choice((1, 3, 50, 300, 4096)) if trial else 1
            out.append(machine.feed(whole[at : at + n], at + n >= len(whole)))
            at += n
        joined = "".join(out)
        assert not any(s in joined for s in surfaces) and machine.vault.restore(joined) == whole
        assert "Zk9Zk9" not in joined and "555-1234" not in joined


def test_a_known_surface_never_cuts_a_longer_new_one():
    v = Vault()
    assert v.sanitize("paid $1234.5", [("$1234.5", "financial", None)]) == "paid <<FINANCE_1>>"
    assert v.sanitize("paid $1234.56, $1234.5", [("$1234.56", "financial", None)]) == "paid <<FINANCE_2>>, <<FINANCE_1>>"


def test_many_known_surfaces_are_found_as_a_few_are():
    rng = random.Random(5)
    v = Vault()
    for i in range(3000):
        v.hold("".join(rng.choice("ab c") for _ in range(rng.randint(1, 40))), f"<<ORG_{i + 1}>>")
    for _ in range(50):
        text = "".join(rng.choice("ab c") for _ in range(200))
        assert set(v.within(text)) == {s for s in v.by_surface if s in text}
    assert v.longest_spaced() == max(len(s) for s in v.by_surface if " " in s)
