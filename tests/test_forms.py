import random

import pytest
from pyspark.sql import functions as F

from hushframe.operators import forms, turn_pipeline


def column(spark, values, function):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.r for r in df.select("i", function(F.col("t")).alias("r")).orderBy("i").collect()]


def found(spark, text):
    rows = forms.entities(spark.createDataFrame([(1, text)], "i int, text string")).collect()
    return {r.kind: [x for x in rows if x.kind == r.kind] for r in rows}


def test_separators(spark):
    cases = {"1,234.56": 1234.56, "1.234,56": 1234.56, "1 234,56": 1234.56, "1'234.50": 1234.5, "1,234,567": 1234567, "1.234.567,8": 1234567.8, "1,234": 1234, "0,234": 0.234, "12,5": 12.5, "12.5": 12.5, "1234.567": 1234.567, "7": 7, "": None, "a": None}
    assert column(spark, list(cases), forms.number) == [None if v is None else pytest.approx(v) for v in cases.values()]


def test_amounts(spark):
    cases = {"$1,200.50": (1200.5, "USD"), "US$ 5 million": (5e6, "USD"), "3,5 Mio. €": (3.5e6, "EUR"), "€2k": (2000, "EUR"), "12 dollars": (12, "USD"), "£7": (7, "GBP"), "1.000 CHF": (1000, "CHF"), "2 millones de euros": (2e6, "EUR"), "1,5 Milliarden Euro": (1.5e9, "EUR"), "12 bananas": None}
    for text, want in cases.items():
        got = found(spark, f"x {text}, y").get("financial", [])
        assert [(r.value, r.unit) for r in got] == ([want] if want else []), text


def test_dates(spark):
    good = {
        "2024-02-29": "2024-02-29", "29.2.2024": "2024-02-29", "3/4/2024": "2024-03-04", "13/4/2024": "2024-04-13", "4/13/2024": "2024-04-13", "May 3, 2024": "2024-05-03", "3 May 2024": "2024-05-03",
        "1. März 2024": "2024-03-01", "14 juillet 1789": "1789-07-14", "6 juin 1944": "1944-06-06", "1er": None, "2 de enero de 2020": "2020-01-02", "24. Dezember 1999": "1999-12-24", "Sept. 5, 2021": "2021-09-05", "15 août 2023": "2023-08-15", "12 agosto 2001": "2001-08-12",
    }
    for text, want in good.items():
        assert [str(r.day) for r in found(spark, f"on {text} or so").get("temporal", [])] == ([want] if want else []), text
    assert not found(spark, "30.02.2024 2024-13-01 31 April 2024 99/99/2024 12 Monkeys 1995")
    assert column(spark, ["3/4/2024"], lambda c: forms.date(c, day_first=True).cast("string")) == ["2024-04-03"]


def check(digits):
    total = sum((d * 2 - 9 if d > 4 else d * 2) if i % 2 else d for i, d in enumerate(map(int, reversed(digits))))
    return total % 10 == 0


def test_check_digits(spark):
    dice = random.Random(1)
    cards = ["".join(dice.choices("0123456789", k=dice.choice((12, 13, 16, 19, 20)))) for _ in range(400)] + ["4111 1111 1111 1111", "4111-1111-1111-1112", "0" * 16]
    want = [13 <= len(c.replace(" ", "").replace("-", "")) <= 19 and check(c.replace(" ", "").replace("-", "")) and len(set(c)) > 1 for c in cards]
    assert column(spark, cards, forms.luhn) == want and sum(want) > 20
    accounts = ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "FR1420041010050500013M02606", "NL91ABNA0417164300", "DE88 3704 0044 0532 0130 00", "GB82WEST12345698765423", "XX00"]
    assert column(spark, accounts, forms.iban) == [True] * 4 + [False] * 3


def test_cards_accounts_phones_and_credentials(spark):
    text = "card 4111 1111 1111 1111 or 4111111111111112, IBAN DE89 3704 0044 0532 0130 00, call 555-123-4567, (555) 123-4567 or +49 30 1234567; secret: hunter22 and api_key=\"abc123def\". Order 1234567, 12-34."
    got = found(spark, text)
    assert {k: [r.entity_text for r in v] for k, v in got.items()} == {
        "card": ["4111 1111 1111 1111"], "account": ["DE89 3704 0044 0532 0130 00"], "phone": ["555-123-4567", "(555) 123-4567", "+49 30 1234567"], "credential": ["secret: hunter22", 'api_key="abc123def'],
    }
    assert {r.entity_type for v in got.values() for r in v} == {"identifier", "financial", "phone", "credential"}


def test_texts_without_any(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "plain words, no number", 5), (4, "1" * 100_000, 5), (5, "a: b; c = d", 5)], "i int, text string, place int")
    assert forms.entities(df.drop("place")).count() == 0 and forms.entities(df.select("i", "text").limit(0)).count() == 0


def test_a_detector_is_held_to_its_text(spark):
    docs = spark.createDataFrame([(1, "Ann met Bob"), (None, "Eve"), (2, None)], "doc_id long, text string")
    rows = [(1, " Ann ", "PERSON", 0.5), (1, "Zoe", "person", 1.0), (1, "Bob", "robot", 1.0), (1, "", "person", 1.0), (None, "Eve", " Person", 1.0), (2, "x", "person", 1.0), (1, None, "person", 1.0), (1, "Bob", None, 1.0)]
    got = forms.checked(spark.createDataFrame(rows, "doc_id long, entity_text string, entity_type string, score double"), docs, ["doc_id"]).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted([(1, "Ann", "person", 0.5), (None, "Eve", "person", 1.0)], key=str)


def test_turns_with_forms(spark):
    turns = spark.createDataFrame([("s", 1, "Pay 1.234,56 € to DE89 3704 0044 0532 0130 00 by 3. Mai 2024"), ("s", 2, "the 1.234,56 € again, card 4111 1111 1111 1111")], "session string, turn long, text string")
    empty = spark.createDataFrame([], "session string, placeholder string, entity_type string, canonical string, aliases array<string>, value double, created_turn long, last_seen_turn long")
    done, _ = turn_pipeline.sanitize(turns, empty, turn_pipeline.detect_turns(turns, detector=forms.detector))
    got = {r.turn: r.sanitized for r in done.collect()}
    assert got == {1: "Pay <<FINANCE_2>> to <<FINANCE_1>> by <<DATE_1>>", 2: "the <<FINANCE_2>> again, card <<ID_1>>"}


def test_a_value_is_worked_out_once_a_match(spark):
    text = spark.createDataFrame([("Paid $1,200.50 on May 3, 2024.",)], "text string")
    for kind, most in (("financial", 24), ("temporal", 30)):
        plan = text.select(forms.matches(F.col("text"), kind))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_") + plan.count("RLIKE") <= most, kind
