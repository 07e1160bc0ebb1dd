from hushframe.llm import urlfilter

URLS = {
    None: ("", "", None, "allow"),
    "no scheme.com/": ("", "", None, "allow"),
    "https://WWW.Example.com/en/1": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
    "https://blog.example.com/en/1?x#y": ("blog.example.com", "/en/1", "example.com/en/", "block"),
    "https://a.b.org": ("a.b.org", "", None, "allow"),
    "http://x.net/es/": ("x.net", "/es/", "net/es/", "block"),
    "http://xnet/es/": ("xnet", "/es/", None, "allow"),
    "http://x.net/de/cheap-pills": ("x.net", "/de/cheap-pills", None, "block"),
    "http://x.org/free/track": ("x.org", "/free/track", None, "block"),
    "http://x.org/free/free": ("x.org", "/free/free", None, "allow"),
    "http://x.org/freedom/trackside": ("x.org", "/freedom/trackside", None, "allow"),
    "http://x.com/casino": ("x.com", "/casino", "com/", "allow"),
    "http://x.com?casino": ("x.com", "", None, "block"),
    "://://": (":", "//", None, "allow"),
    "http://x.org/" + "a" * 50000 + "/porn": ("x.org", "/" + "a" * 50000 + "/porn", None, "block"),
}


def test_judge(spark):
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)] + [(None, None, "h")], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(df).collect()}
    assert got == dict(enumerate(URLS.values())) | {None: ("", "", None, "allow")}
    assert urlfilter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_boundaries():
    machine = urlfilter.automaton({"bad": 2, "bad-er": 2, "mild": 1})
    assert urlfilter.hits(machine, "http://BAD.com/bad-er/xbad/bad1/mild?mild") == (3, 1, 5)


def test_weights_of_different_terms_add_up(spark):
    urls = ["http://a.org/x", "http://a.org/x/x", "http://a.org/x/y", "http://a.org/y/z", "http://a.org/zz"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    judged = urlfilter.judge(df, vocabulary={"x": 1, "y": 2, "z": 3}, limit=4).collect()
    assert {r.page_id: (r.weight, r.verdict) for r in judged} == {0: (1, "allow"), 1: (1, "allow"), 2: (3, "allow"), 3: (5, "block"), 4: (0, "allow")}
    assert all(r.verdict == "allow" for r in urlfilter.judge(df, vocabulary={}).collect())
    assert max(urlfilter.VOCABULARY.values()) == urlfilter.LIMIT and 80 <= len(urlfilter.VOCABULARY) <= 200
