from protolens.llm import url_filter as U

URLS = [
    ("https://WWW.Example.com/en/x?q=1", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
    ("http://a.example.com/en/", "a.example.com", "/en/", "example.com/en/", "block"),
    ("http://example.com/en", "example.com", "/en", "com/", "allow"),
    ("http://x.net/es/1#top", "x.net", "/es/1", "net/es/", "block"),
    ("http://x.net?u=http://y.com/", "x.net", "", None, "allow"),
    ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
    ("http://com/", "com", "/", "com/", "allow"),
    ("http://a.com", "a.com", "", None, "allow"),
    ("no scheme.com/en/", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("ftp://ÄB.org:80/p", "Äb.org:80", "/p", None, "allow"),
    ("a://b://c/d", "b:", "//c/d", None, "allow"),
]


def test_rules(spark):
    pages = spark.createDataFrame([(i, u[0], "h", 1) for i, u in enumerate(URLS)] * 2, "page_id long, url string, host string, rule int")
    none = spark.createDataFrame([(1, None), (None, True), (99, True)], "page_id long, bad boolean")
    got = U.judge(pages, none, U.rule_table(spark)).collect()
    assert len(got) == 2 * len(URLS)
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == URLS[r["page_id"]][1:]
    assert U.judge(pages.limit(0), none, U.rule_table(spark)).count() == 0


def test_reputation(spark):
    rows = [(i, f"http://h{i % 5}.bad.org/{i}") for i in range(200)] + [(1000 + i, f"http://h{i % 5}.good.org/{i}") for i in range(200)]
    rows += [(2000, "http://new.bad.org/"), (2001, "http://new.good.org/"), (2002, "http://few.good.org/1")]
    out = [(i, i // 5 % 10 != 0) for i in range(200)] + [(1000 + i, i // 5 % 10 == 0) for i in range(200)] + [(2002, True)]
    pages, outcomes = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(out, "page_id long, bad boolean")
    got = {r["page_id"]: r for r in U.judge(pages, outcomes, U.rule_table(spark)).collect()}
    assert all(got[i]["verdict"] == "block" for i in range(200))
    assert all(got[1000 + i]["verdict"] == "allow" for i in range(200))
    assert got[2000]["mean"] > 0.7 > 0.4 > got[2001]["mean"]
    assert got[2002]["verdict"] == "allow"  # one outcome does not outweigh the domain


def test_domains(spark):
    hosts = ["a.b.co.uk", "co.uk", "uk", "x.y.com", "com", "a.b.de:8080", "", "q.com.au"]
    d, s = U.domain_and_suffix(U.F.col("h"))
    got = [tuple(r) for r in spark.createDataFrame([(h,) for h in hosts], "h string").select(d, s).collect()]
    assert got == [("b.co.uk", "co.uk"), ("co.uk", "uk"), ("uk", "uk"), ("y.com", "com"), ("com", "com"), ("b.de", "de"), ("", ""), ("q.com.au", "com.au")]


def test_suffix_rules(spark):
    """Rules of a suffix list: plain, wildcard and exception."""
    rules = ["com", "co.uk", "*.ck", "!www.ck"]
    hosts = ["a.b.co.uk", "co.uk", "uk", "x.y.com:80", "a.b.c.ck", "c.ck", "www.ck", "a.www.ck", "q.org", ""]
    got = {r["host"]: (r["domain"], r["suffix"]) for r in U.by_suffix_rules(spark.createDataFrame([(h,) for h in hosts], "host string"), rules).collect()}
    assert got == {"a.b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "uk": ("uk", "uk"), "x.y.com:80": ("y.com", "com"), "a.b.c.ck": ("b.c.ck", "c.ck"), "c.ck": ("c.ck", "c.ck"), "www.ck": ("www.ck", "ck"), "a.www.ck": ("www.ck", "ck"), "q.org": ("q.org", "org"), "": ("", "")}


def test_very_long_hosts(spark):
    """A host of many labels costs as many rows as the deepest rule has labels."""
    host = ".".join(["x"] * 20_000) + ".example.com"
    pages = spark.createDataFrame([(1, f"http://{host}/en/")], "page_id long, url string")
    none = spark.createDataFrame([], "page_id long, bad boolean")
    r = U.judge(pages, none, U.rule_table(spark)).first()
    assert (r["rule"], r["verdict"]) == ("example.com/en/", "block")
