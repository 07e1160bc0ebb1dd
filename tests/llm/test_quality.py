import re

from hypothesis import given, settings
from hypothesis import strategies as st

from hushframe.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + d for i, w in enumerate(windows) if windows.count(w) > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    stops = {w for s in quality.STOP_WORDS.values() for w in s}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(lines), sum(w.lower() in stops for w in words))


def measured(spark, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_words string")
    rows = quality.judge(df).orderBy("doc_id").collect()
    return rows, [tuple(r[c] for c in quality.COUNTS) for r in rows]


CASES = [None, "", " \n\t", "a b c a b c", "a a a a", "one", "the x\nthe x\n \nthe  x", "# * $ a|b", "é 😀 \x85 x y " * 30, "w%d " * 10, "of the and " * 400]


def test_counts_match_brute_force(spark):
    assert measured(spark, CASES)[1] == [brute(t) for t in CASES]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t|é", max_size=60), min_size=5, max_size=20))
def test_counts_match_brute_force_on_any_text(spark, texts):
    assert measured(spark, texts)[1] == [brute(t) for t in texts]


def test_verdicts(spark):
    clean = " ".join(f"the word{i} of plain{i} prose" for i in range(30))
    junk = " ".join(f"x{i}$$$ %%% ###" for i in range(60))
    repeated = "same line of words here\n" * 40
    rows, _ = measured(spark, [clean, junk, repeated, None])
    assert [(r.base_failed, r.kept) for r in rows] == [(False, True), (False, False), (True, False), (True, False)]
    assert quality.judge(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_columns_of_the_table_stay(spark):
    df = spark.createDataFrame([(1, "a b c\na b c\na b c", "keep", 7)], "doc_id long, text string, _words string, _windows int")
    got = quality.judge(df).first()
    assert (got["_words"], got["_windows"], got.n_repeat_words, got.n_dup_lines) == ("keep", 7, 9, 2)
