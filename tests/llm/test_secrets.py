import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from hushframe.llm import queries, secrets


def brute(text):
    out = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m.group(2)) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["token", "API_KEY", "apikey", "Secret", "ſecret", "toKen", "=", ":", " ", '"', "'", "abc123", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "x.y", "é", "😀", "\n", "pass", "word", "passwd"]), max_size=14).map("".join))
def test_base_spans_match_brute_force(text):
    assert secrets.base_spans(text) == brute(text)


def test_models_tell_random_strings_from_identifiers():
    models = secrets.Models.train(secrets.sample(3000, seed=1))
    fresh = secrets.sample(1000, seed=2)
    long_enough = [(t, r) for t, r in fresh if len(t) >= 16]
    right = sum((models.score(t) > 0.5) == r for t, r in long_enough)
    assert right / len(long_enough) > 0.97
    assert models.score("InternationalCommunicationServer2019") < 0.5 < models.score("q7Zk2XvB9tLw4RmN8sYd1HcJ")


def test_scan(spark):
    key = "q7Zk2XvB9tLw4RmN8sYd1HcJ"
    texts = [None, "", f"😀 see {key} there", "token = abcdef", "token = abc", "AKIA" + "Q" * 16, "plain words only " * 5000 + "secret: hunter2hunter2"]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(None, "x", 0)], "doc_id long, text string, spans int")
    rows = {r.doc_id: r.spans for r in secrets.scan(df).collect()}
    assert len(rows) == 8 and rows[None] == rows[0] == rows[1] == rows[4] == []
    assert [(s.kind, s.start, s.end, s.base, s.secret) for s in rows[2]] == [("random", 6, 6 + len(key), False, key)]
    assert [s.kind for s in rows[3]] == ["assign"] and [s.kind for s in rows[5]] == ["access"] and rows[6][0].secret == "secret: hunter2hunter2"
    assert secrets.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_secrets_of_letters_alone_are_found():
    import random
    import string

    dice, models = random.Random(4), secrets.default_models()
    found = lambda tokens: sum(len(secrets.model_spans(f"x {t} y", [], models, 0.5)) for t in tokens)
    for letters in (string.ascii_letters, string.ascii_lowercase, string.ascii_uppercase):
        assert found("".join(dice.choices(letters, k=24)) for _ in range(500)) >= 490
    words = "Kraftfahrzeughaftpflichtversicherung anticonstitutionnellement incomprehensibilities internationalization XMLHttpRequestEventTarget Donaudampfschifffahrtsgesellschaft"
    assert not found([*words.split(), "=" * 40, "-" * 16, "_" * 30, "a" * 20, "1234567890123456"])


def test_the_query_against_brute_force(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    out = queries.op2_secrets(spark, "/root/testdata/sf0.01").collect()
    joined = lambda spans: ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in spans)
    assert sorted(r.doc_id for r in out) == sorted(docs)
    for r in out:
        want = brute(docs[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in want) for i in range(3))
        assert r.base_sha256 == hashlib.sha256(joined(want).encode()).hexdigest()
        own = [x for x in r.spans.split(",") if x]
        assert [x for x in own if not x.startswith("random")] == [x for x in joined(want).split(",") if x]
        places = [(int(s), secrets.KINDS.index(k), int(e)) for k, s, e in (x.split(":") for x in own)]
        assert places == sorted(places)
        for s, k, e in places:
            assert k < 3 or (re.fullmatch(r"[A-Za-z0-9+/_=-]{16,}", docs[r.doc_id][s:e]) and secrets.default_models().score(docs[r.doc_id][s:e]) > 0.5)


def test_public_identifiers_are_no_secrets():
    import uuid

    import numpy as np

    dice = np.random.default_rng(3)
    tokens = [str(uuid.UUID(bytes=dice.bytes(16))) for _ in range(400)]
    tokens += [t.upper() for t in tokens[:100]] + [f"2024-{m:02d}-{d:02d}T12-30-{d:02d}" for m in range(1, 13) for d in range(1, 29)]
    tokens += [f"src/main/java/org/example/Module{i}/ServiceHandler" for i in range(100)] + [f"invoice-2023-{i:06d}-final" for i in range(100)]
    models = secrets.default_models()
    assert sum(models.score(t) > 0.5 for t in tokens) <= 0.01 * len(tokens)


SURROUNDINGS = ("/static/user/profile/image/{}", "/var/lib/application/data/uploads/customers/documents/{}", "session_cookie_value={}", "/api/users/{}/profile/settings", "backup-key-{}", "static/{}/file/name/list")


def test_keys_behind_paths_and_names_are_found():
    import random
    import string

    dice, models = random.Random(12), secrets.default_models()
    for letters in (string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_lowercase + string.digits, string.ascii_letters):
        for around in SURROUNDINGS:
            found = 0
            for _ in range(200):
                key = "".join(dice.choices(letters, k=20))
                text = "see " + around.format(key) + " there"
                at = text.index(key)
                spans = secrets.model_spans(text, [], models, 0.5)
                found += any(min(e, at + 20) - max(s, at) >= 16 for s, _, e in spans)
                assert all(e - s >= 16 for s, _, e in spans)
            assert found >= 190, (letters, around, found)


def test_ordinary_tokens_have_no_random_parts():
    import uuid

    import numpy as np

    dice, models = np.random.default_rng(5), secrets.default_models()
    tokens = [around.format(uuid.UUID(bytes=dice.bytes(16))) for around in SURROUNDINGS for _ in range(100)]
    tokens += [around.format(word) for around in SURROUNDINGS for word in ("internationalization", "2024-05-17T12-30-59", "customer_name_index_1984", "000123456789-000123")]
    assert sum(bool(secrets.model_spans(t, [], models, 0.5)) for t in tokens) <= 0.02 * len(tokens)


def test_stretches_are_those_of_the_definition():
    import random

    dice = random.Random(3)

    def brute(gains):
        # the stretch of largest sum (shortest of equal ones), then what lies left and right of it
        best = max(((sum(gains[i:j]), i - j, -i, i, j) for i in range(len(gains)) for j in range(i + 1, len(gains) + 1)), default=(0,))
        if best[0] <= 0:
            return []
        i, j = best[3:]
        return brute(gains[:i]) + [(i, j)] + [(a + j, b + j) for a, b in brute(gains[j:])]

    for _ in range(300):
        gains = [dice.choice((-3.1, -1.7, -0.4, 0.9, 1.3, 2.6)) * dice.random() for _ in range(dice.randint(0, 14))]
        assert secrets.stretches(gains) == brute(gains)


def test_a_very_long_token_takes_time_in_proportion():
    import time

    models, text = secrets.default_models(), "the_quick_brown_fox/" * 30_000 + "q7Zk2XvB9tLw4RmN8sYd1HcJ" + "/and/more/words" * 1000
    started = time.time()
    spans = secrets.model_spans(text, [], models, 0.5)
    assert time.time() - started < 10 and any("q7Zk2XvB9tLw4RmN8sYd" in text[s:e] for s, _, e in spans)
