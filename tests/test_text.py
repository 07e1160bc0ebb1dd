import random
import re

import pytest
from pyspark.sql import functions as F

from hushframe.functions import grammar, policy, scalars
from hushframe.operators import calc, chunk, compaction, detect, turns, vault


def column(spark, values, expression):
    df = spark.createDataFrame(list(enumerate(values)), "i int, s string")
    return [r.x for r in df.select("i", expression(F.col("s")).alias("x")).orderBy("i").collect()]


def test_tokens(spark):
    texts = ["<<PERSON_1>>", "<<PERSON_1>>\n", "<<LOCAL_PATH_12>>", "<<person_1>>", "a <<ID_2>> b", ""]
    assert column(spark, texts, grammar.is_placeholder) == [True, False, True, False, False, False]
    assert column(spark, texts, grammar.placeholder_type) == ["person", None, "local_path", None, None, None]
    assert column(spark, ["<<A_1>> <<B_2>> <<A_1>>"], grammar.tokens) == [["<<A_1>>", "<<B_2>>"]]
    assert column(spark, [" <<A_1>>  <<B_2>> ", "<<A_1>> x", " "], grammar.only_placeholders) == [True, False, False]


def test_alias_keys(spark):
    values = ["Anthropic, Inc.", "Café X", "Cafe  x", "ＡＢＣ", "!!!", ""]
    assert column(spark, values, grammar.alias_key) == ["anthropic inc", "cafe x", "cafe x", "abc", "!!!", ""]
    assert [vault.alias_key(v) for v in values] == ["anthropic inc", "cafe x", "cafe x", "abc", "!!!", ""]


def test_text_functions(spark):
    assert column(spark, ["abcdef", "abc"], lambda c: grammar.truncate(c, 4, "~")) == ["abcd~", "abc"]
    assert column(spark, ["<think>x</think> yes", "a <thought>b</thought> c"], grammar.strip_think) == ["yes", "a  c"]
    assert column(spark, ["a😀b"], grammar.utf16_length) == [4]
    assert column(spark, ["", "x" * 100], grammar.token_estimate) == [4, 29]


def test_policy(spark):
    names = ["read_file", "write_file", "web_search", "run_cli_app", "mcp_x", "totally_new_uploader", "brand_new_unknown_x", "", None, "read_file_v2"]
    assert column(spark, names, policy.privacy_class) == ["local", "side_effect", *["external"] * 7, "local"]
    assert column(spark, ["read_file", "zz"], lambda c: policy.requires_approval(c, {"zz": "local"})) == [False, False]
    assert column(spark, ["read_file", "zz", ""], lambda c: policy.requires_approval(c, {"zz": ("local", True), "read_file": ("external", False), "": "local"})) == [False, True, True]
    assert column(spark, ["read_file", "zz", ""], lambda c: policy.privacy_class(c, {"zz": ("local", True), "read_file": ("external", False)})) == ["external", "local", "external"]
    prompt = ["<<FINANCE_1>>", "<<PERSON_1>>", "<<ENTITY_1>>", "none"]
    assert column(spark, prompt, policy.high_severity_prompt) == [True, True, False, False]
    assert column(spark, prompt, lambda c: policy.high_severity_prompt(c, parity=True)) == [False, True, False, False]


def test_sniff(spark):
    texts = ['{"a": 1}', "[1, 2", "<html><p>x", "# Title\ntext", "plain", "", "  \n", "a\n## b\n- c"]
    assert column(spark, texts, chunk.sniff) == ["json", "text", "html", "markdown", "text", "text", "text", "markdown"]


def test_paragraph_chunks():
    assert chunk.paragraphs("hello world") == [("hello world", 0, 11)]
    text = "A" * 6050 + "\n\n" + "B" * 100
    parts = chunk.paragraphs(text, overlap=20)
    assert len(parts) >= 2 and parts[0] == ("A" * 6000, 0, 6052)
    assert all(len(c) <= 5 for c, _, _ in chunk.paragraphs("ab\n\ncd\n\nef", 5, 1))
    assert [c for c, _, _ in chunk.paragraphs("x" * 10, 4, 1, overlap_on_cut=True)][:2] == ["xxxx", "xxxx"]


def test_json_and_markdown_chunks():
    text = '{"users":[{"name":"Alice","email":"alice@example.com"},{"name":"Bob"}],"count":2,"none":null}'
    assert chunk.json_chunks(text) == ["$.users[0].name: Alice\n$.users[0].email: alice@example.com\n$.users[1].name: Bob\n$.count: 2"]
    assert chunk.json_chunks('{"a":null}') == []
    parts = chunk.markdown_chunks("# A\nxxxxxxxxxx\n# B\nyyyyyyyyyy\n# C\nz", 20)
    assert parts == ["# A\nxxxxxxxxxx", "# B\nyyyyyyyyyy\n# C\nz"]  # sections are packed as long as they fit
    fenced = "# A\n```\ncode\n# not a heading to cut at\nmore\n```\ntext"
    assert all(p.count("```") % 2 == 0 for p in chunk.markdown_chunks(fenced, 500))


def test_math():
    assert calc.evaluate(calc.expression("result = V1 + V2"), {"V1": 2, "V2": 3}) == 5.0
    assert calc.evaluate("max(a, b) // 2 - abs(-1)", {"a": 9, "b": 4}) == 3.0
    for bad in ("2 ** 2 ** 2", "pow(2, pow(2, 9))", "x + 1", "'a'", "True", "__import__('os')", "9 ** 9999", "1 / 0", "[1][0]"):
        try:
            calc.evaluate(calc.expression(bad), {})
        except calc.Refused:
            continue
        raise AssertionError(bad)
    for bad in ("1e308 * 10", "1e999 - 1e999", "-" * 5000 + "1", "(" * 90 + "1" + ")" * 90 + "+" + "+".join("1" * 90), "x" * 5000, "2 ** 63 ** 2", "round(1.5, None)", "max()"):
        with pytest.raises(calc.Refused):
            calc.evaluate(bad, {"x": 1.0})
    assert [calc.shown(v) for v in (2.0, 0.1 + 0.2, 1e20)] == ["2", "0.3", "100000000000000000000"]
    assert calc.resolved("A_1 + A_10", {"A_1": 2.0, "A_10": 3.5}) == "2 + 3.5"


def test_summary_guard(spark):
    df = spark.createDataFrame([("keeps <<PERSON_1>>  and <<SSN_9>> <<EMAIL_7>>", ["<<PERSON_1>>", "<<EMAIL_1>>"])], "s string, a array<string>")
    r = df.select(compaction.check(F.col("s"), F.col("a")).alias("c"), compaction.strip(F.col("s"), F.array(F.lit("<<SSN_9>>"), F.lit("<<EMAIL_7>>"))).alias("t")).first()
    assert (r.c.kept, r.c.foreign, r.c.renumbered) == (["<<PERSON_1>>"], ["<<SSN_9>>", "<<EMAIL_7>>"], ["<<EMAIL_7>>"])
    assert r.t == "keeps <<PERSON_1>> and"


def test_detector(spark):
    text = "mail a.b@x.org or 10.0.0.1, read /Users/me/invoice.jpg, pay $1,200.50 at 15% token INV_2024"
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    found = detect.by_priority(detect.detect(df), ["doc_id"]).select("entity_text", "entity_type", detect.number_value(F.col("entity_text"), F.col("entity_type")).alias("v")).collect()
    assert {(r.entity_text, r.entity_type, r.v) for r in found} == {("a.b@x.org", "email", None), ("10.0.0.1", "ip_address", None), ("/Users/me/invoice.jpg", "local_path", None), ("$1,200.50", "financial", 1200.5), ("15%", "percentage", 0.15)}


THOUGHTS = {
    "Hello <thought>reasoning</thought> World": "Hello  World",
    "<thought>ongoing...": "",
    "<thought>a < 3 and b > 2</thought>result": "result",
    "<thought/>some text": "<thought/>some text",
    "strip `<think>` tags from output.": "strip `<think>` tags from output.",
    "  <think>reasoning...": "",
    "<think广场照明灯": "广场照明灯",
    "<think The fountain opens at 09:00": "The fountain opens at 09:00",
    "<thinker>content</thinker>": "<thinker>content</thinker>",
    "answer</think>": "answer",
    "</think>answer": "answer",
    "<channel|>喷泉": "喷泉",
    "<|channel|>answer": "answer",
    "喷泉策略说明 <thin": "喷泉策略说明",
    "answer <think>": "answer",
    "answer <|chan": "answer",
    "<think-foo>bar</think-foo>": "<think-foo>bar</think-foo>",
    "<think:foo>bar</think:foo>": "<think:foo>bar</think:foo>",
    "Use `</think>` to close a thinking block.": "Use `</think>` to close a thinking block.",
    "": "",
}


def test_reasoning_is_stripped_at_the_edges_only(spark):
    assert column(spark, list(THOUGHTS), grammar.strip_think) == list(THOUGHTS.values())
    assert column(spark, ["<think> a </think>b<thought>\nc</thought>", "none"], grammar.extract_think) == ["a\n\nc", None]


def test_split_message(spark):
    dice = random.Random(3)
    texts = ["", None, "x" * 25, "aaaa\nbbbbb cccc\nddd", "a" * 10 + "\n" + "b" * 9, " " * 30, "one two\n\n  three" * 3]
    texts += ["".join(dice.choices("ab \n", k=dice.randint(0, 60))) for _ in range(60)]

    def want(text, limit=10):
        out = []
        while text:
            if len(text) <= limit:
                return [*out, text]
            head = text[:limit]
            at = max(head.rfind("\n"), 0) or max(head.rfind(" "), 0) or limit
            out.append(text[:at])
            text = text[at:].lstrip()
        return out

    got = column(spark, texts, lambda c: turns.split_message(c, 10))
    assert got == [want(t) if t is not None else got[1] for t in texts] and not got[1]


def test_email_rule_takes_linear_time_and_finds_the_same(spark):
    dice = random.Random(5)
    texts = ["".join(dice.choices(["a", "b.", "@", "x.org", "_", "%", " ", "ä", "co", "-"], k=dice.randint(0, 16))) for _ in range(1500)]
    plain = next(re.compile(p) for slug, p, _, _ in detect.RULES if slug == "email")
    found = column(spark, texts, lambda c: detect.matches(c, "email"))
    assert found == [plain.findall(t) for t in texts] and sum(map(len, found)) > 50
    # a run of a million characters, which the plain pattern would read as often as it is long
    assert column(spark, ["a" * 1_000_000 + " b@c.org"], lambda c: detect.matches(c, "email")) == [["b@c.org"]]


def test_scalars(spark):
    assert column(spark, ["&lt;b&gt; &#39;x&#x27; &amp;amp; &#128512; &nope;"], scalars.unescaped) == ["<b> 'x' &amp; 😀 &nope;"]
    assert column(spark, ["<h2>A <i>b</i></h2><a href='u'>c</a><p>d<br>e</p>"], scalars.markdown) == ["## A b\n[c](u)d\ne"]
    assert column(spark, ["2-5", "3", "9-99"], lambda c: scalars.page_range(c, F.lit(10))) == [(1, 4), (2, 2), (8, 9)]
    assert column(spark, ["a/b.py", "b.py", "x/src/c.md", "src/a/c.md"], lambda c: scalars.matches_glob(c, "*.py")) == [True, True, False, False]
    assert column(spark, ["x/src/c.md", "src/a/c.md"], lambda c: scalars.matches_glob(c, "src/*.md")) == [True, False]
    hosts = ["10.0.0.1", "172.31.255.255", "172.32.0.0", "8.8.8.8", "[::1]", "fe80::1", "::ffff:10.0.0.1", "localhost", "example.com"]
    assert column(spark, hosts, scalars.private_host) == [True, True, False, False, True, True, True, True, False]


def test_an_address_is_worked_out_once_a_row(spark):
    """However often a URL's parts are asked for, the URL itself stands in the plan a few times only."""
    rows = spark.createDataFrame([("http://10.1.2.3/x",)], "u string").select(scalars.url_refused(F.concat("u", F.lit("#once"))).alias("r"))
    assert rows.first().r == "private"
    plan = rows._jdf.queryExecution().analyzed().toString()
    assert plan.count("#once") == 1
