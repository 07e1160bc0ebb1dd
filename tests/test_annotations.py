from hushframe.operators import annotations, turn_pipeline

VAULT = "session string, placeholder string, entity_type string, canonical string, aliases array<string>, value double, created_turn long, last_seen_turn long"
TURNS = "session string, turn long, text string"


def marked(spark, answers, vault=(), **options):
    entities = spark.createDataFrame([(*v, 1, 1) for v in vault], VAULT)
    rows = turn_pipeline.finalize_annotated(spark.createDataFrame(answers, TURNS), entities, **options).collect()
    for r in rows:
        wide = r.display_text.encode("utf-16-le") if r.display_text is not None else b""
        for a in r.annotations:
            assert wide[2 * a.start : 2 * a.end].decode("utf-16-le") == a.text
        assert [(a.start, a.end) for a in r.annotations] == sorted((a.start, a.end) for a in r.annotations)
    return {(r.session, r.turn): r for r in rows}


ALICE = ("s", "<<PERSON_1>>", "person", "Alice Chen", ["Alice Chen", "@alice"], None)


def test_restored_spans(spark):
    got = marked(spark, [("s", 1, "Hello <<PERSON_1>>"), ("s", 2, "\U0001f4c4 <<PERSON_1>><<PERSON_1>> and <<ORG_2>>"), ("s", 3, ""), ("s", 4, None), (None, None, "<<PERSON_1>>"), ("t", 1, "<<PERSON_1>> <<X_9>>")], [ALICE, (None, "<<PERSON_1>>", "robot", "R2", None, 2.0)])
    a = got["s", 1].annotations[0]
    assert (a.start, a.end, a.entity_type, a.severity, a.canonical, a.aliases, a.annotation_type, a.formula) == (6, 16, "person", "high", "Alice Chen", ["Alice Chen", "@alice"], "entity", None)
    assert [(a.start, a.end) for a in got["s", 2].annotations] == [(3, 13), (13, 23)] and got["s", 2].display_text.endswith("and <<ORG_2>>")
    assert got["s", 3].annotations == got["s", 4].annotations == got["t", 1].annotations == [] and got["s", 4].display_text is None
    a = got[None, None].annotations[0]
    assert (a.text, a.severity, a.aliases, a.value) == ("R2", "medium", ["R2"], 2.0)


def test_results_are_marked_with_their_formula(spark):
    money = ("s", "<<FINANCE_1>>", "financial", "$205M", ["$205M"], 205_000_000.0)
    first = "The updated value is <python_snippet_1>FINANCE_1 * 1.23</python_snippet_1>. \U0001f4b3 <<PERSON_1>>, again <python_snippet_2>FINANCE_1*1.23</python_snippet_2> of <<FINANCE_1>>"
    got = marked(spark, [("s", 1, first), ("s", 2, "As told: <<CALC_1>>, so <python_snippet_1>CALC_1 / 2</python_snippet_1>; bad <python_snippet_2>open(1)</python_snippet_2>")], [ALICE, money])
    one = got["s", 1]
    assert one.display_text == "The updated value is 252150000. \U0001f4b3 Alice Chen, again 252150000 of $205M" and one.history_text.count("<<CALC_1>>") == 2
    assert [(a.annotation_type, a.placeholder, a.text, a.severity, a.formula, a.value) for a in one.annotations] == [
        ("local_computation", "<python_snippet_1>", "252150000", "low", "205000000 * 1.23", 252150000.0),
        ("entity", "<<PERSON_1>>", "Alice Chen", "high", None, None),
        ("entity", "<<FINANCE_1>>", "$205M", "high", None, 205_000_000.0),
    ]
    two = got["s", 2]
    assert two.display_text == "As told: 252150000, so 126075000; bad open(1)"
    assert [(a.annotation_type, a.placeholder, a.entity_type, a.severity) for a in two.annotations] == [("entity", "<<CALC_1>>", "calc", "medium"), ("local_computation", "<python_snippet_1>", "local_computation", "low")]
    every = marked(spark, [("s", 1, first)], [ALICE, money], repeats=True)["s", 1]
    assert [a.text for a in every.annotations].count("252150000") == 2


def test_cut(spark):
    df = spark.createDataFrame([("a\U0001f4b3bc", 0, 1, "a"), ("a\U0001f4b3bc", 1, 3, "\U0001f4b3"), ("a\U0001f4b3bc", 3, 5, "bc"), (None, 0, 1, None)], "t string, s long, e long, want string")
    assert all(r.got == r.want for r in df.withColumn("got", annotations.cut(df["t"], df["s"], df["e"])).collect())


def test_tokens_of_a_text_are_shuffled_once(spark):
    """Spans, calculations, first places and the array of a text come together by one key."""
    schema = "session string, placeholder string, entity_type string, canonical string, aliases array<string>, value double, created_turn long, last_seen_turn long"
    vault = spark.createDataFrame([("s", "<<EMAIL_1>>", "email", "jo@ex.org", None, None, 1, 1)], schema)
    texts = spark.createDataFrame([("s", 1, "to <<EMAIL_1>>"), (None, None, "<<EMAIL_1>>")], "session string, turn long, text string")
    record = "array<struct<placeholder string, formatted string, result double, snippet int, resolved string>>"
    done = spark.createDataFrame([("s", 1, None)], f"session string, turn long, computations {record}")
    marks = annotations.annotations(texts, vault, done)
    plan = marks._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("hashpartitioning(_k") <= 2  # the tokens, and what was calculated
    assert plan.count("hashpartitioning(session") + plan.count("hashpartitioning(coalesce(session") <= 4
    assert [(r.session, r.turn, len(r.annotations)) for r in marks.collect()] == [("s", 1, 1)]
