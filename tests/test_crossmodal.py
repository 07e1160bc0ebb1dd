from pyspark.sql import functions as F

from hushframe.operators import crossmodal, visual

VAULT = "session string, placeholder string, entity_type string, canonical string, aliases array<string>, value double, created_turn long, last_seen_turn long"


def pages(spark, texts):
    """(image, session, turn, text) and their words, ten to a line."""
    images = spark.createDataFrame([(i, s, t, x) for i, (s, t, x) in enumerate(texts)], "image long, session string, turn long, text string")
    raw = [(i, 0, 0, k // 10, k % 10, w, 60 * (k % 10), 20 * (k // 10), 50, 15) for i, (_, _, x) in enumerate(texts) for k, w in enumerate((x or "").split())]
    words = visual.reading_order(spark.createDataFrame(raw, "image long, block int, par int, line int, word int, text string, left int, top int, width int, height int"), "image")
    return images, words


def test_what_either_side_knows_is_covered_on_both(spark):
    images, words = pages(spark, [("s", 1, "Pay to DMIT Inc today jo@ex.org amount $1,200.50"), ("s", 2, "again DMIT Inc and Ann Lee call"), ("r", 1, "DMIT Inc"), (None, None, "jo@ex.org"), ("e", 1, None), ("e", 2, "")])
    entities = spark.createDataFrame([("s", "<<ORG_3>>", "org", "DMIT Inc", ["DMIT Inc"], None, 1, 1)], VAULT)
    items = spark.createDataFrame([(1, "Ann Lee", "person"), (1, " ", "person"), (9, "nobody", "person")], "image long, text string, label string")
    texts, boxes, after = crossmodal.cover(images, words, entities, items)
    got = {r.image: (r.sanitized, r.modified) for r in texts.collect()}
    want = {0: "Pay to <<ORG_3>> today <<EMAIL_1>> amount <<FINANCE_1>>", 1: "again <<ORG_3>> and <<PERSON_1>> call", 2: "DMIT Inc", 3: "<<EMAIL_1>>", 4: None, 5: ""}
    assert {k: t for k, (t, _) in got.items()} == want and [k for k, (_, m) in sorted(got.items()) if m] == [0, 1, 3]
    found = {(r.image, r.place, r.placeholder): (r.label, r.left, r.right) for r in boxes.collect()}
    assert found == {
        (0, 2, "<<ORG_3>>"): ("org", 120, 230), (0, 5, "<<EMAIL_1>>"): ("email", 300, 350), (0, 7, "<<FINANCE_1>>"): ("amount", 420, 470),
        (1, 1, "<<ORG_3>>"): ("org", 60, 170), (1, 4, "<<PERSON_1>>"): ("person", 240, 350), (3, 0, "<<EMAIL_1>>"): ("email", 0, 50),
    }
    known = {(r.session, r.placeholder): r.canonical for r in after.collect()}
    assert known["s", "<<PERSON_1>>"] == "Ann Lee" and known["s", "<<FINANCE_1>>"] == "$1,200.50" and ("r", "<<ORG_3>>") not in known


def test_regions_of_what_was_covered(spark):
    images, words = pages(spark, [("s", 1, "jo@ex.org or jo@ex.org")])
    _, boxes, _ = crossmodal.cover(images, words, spark.createDataFrame([], VAULT))
    region = visual.regions(boxes, "image").collect()
    assert [(r.token, r.label, r.left, r.right, r.merged, r["first"]) for r in region] == [("<<EMAIL_1>>", "email", 0, 170, 2, 0)]


def test_without_images(spark):
    images, words = pages(spark, [("s", 1, "x y")])
    texts, boxes, after = crossmodal.cover(images.filter(F.lit(False)), words.filter(F.lit(False)), spark.createDataFrame([], VAULT))
    assert texts.count() == boxes.count() == after.count() == 0


def test_words_are_worked_out_once(spark):
    images, words = pages(spark, [("s", 1, "Pay DMIT Inc jo@ex.org $1,200.50 USD"), ("s", 2, "DMIT Inc again and 01/02/2024")])
    entities = spark.createDataFrame([("s", "<<ORG_3>>", "org", "DMIT Inc", ["DMIT Inc"], None, 1, 1)], VAULT)
    told = spark.sparkContext.accumulator(0)

    def same(token):
        told.add(1)
        return token

    counted = words.withColumn("token", F.udf(same, "string").asNondeterministic()("token"))
    _, boxes, _ = crossmodal.cover(images, counted, entities)
    assert sorted({(r.image, r.place) for r in boxes.collect()}) == [(0, 1), (0, 3), (0, 4), (1, 0), (1, 4)]
    assert told.value == words.count() == 11


def test_only_a_usd_right_behind_an_amount_goes_with_it(spark):
    _, words = pages(spark, [("s", 1, "$5 and USD $7 USD $9"), ("s", 2, "USD $8")])
    got = sorted((r.image, r.place, r.value, r.left, r.right) for r in visual.word_forms(words, "image").collect())
    assert got == [(0, 0, "$5", 0, 50), (0, 3, "$7 USD", 180, 290), (0, 5, "$9", 300, 350), (1, 1, "$8", 60, 110)]
