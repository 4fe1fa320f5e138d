from corpusloom.llm import urls

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr", "allow"), ("a.org", "/fr/x", "block"), (None, "/", "block"), ("EXAMPLE.com", "/de/", "block")]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host, path = rest[:cut].lower(), rest[cut:]
    path = path[: min([i for i in (path.find(c) for c in "?#") if i >= 0], default=len(path))]
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in RULES if h and h == h.lower() and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


def test_like_brute_force(spark):
    hosts = ["a.net", "net", "xnet", "WWW.Example.NET", "example.com", "m.example.com", "a.org", "b.a.org", "", "x.net:80", "x..org"]
    paths = ["", "/", "/en/1", "/de/", "/de", "/fr/x/y", "/frx", "?q=/en/", "#/de/", "/en/?a://b", "/a//b\nc"]
    rows = [(i, f"https://{h}{p}") for i, (h, p) in enumerate((h, p) for h in hosts for p in paths)] + [(None, None), (1, ""), (1, "nothing"), (5, "://"), (6, "http://a.net/" + "d/" * 3000), (6, "http://a.net/" + "d/" * 3000)]
    pages = spark.createDataFrame([(*r, "h", "b") for r in rows], "page_id long, url string, host string, verdict string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = urls.judge(pages, rules)
    assert sorted(map(repr, ((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got.collect()))) == sorted(repr((i, *brute(u))) for i, u in rows)


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    assert urls.judge(pages, rules).count() == 0
    one = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert [r.verdict for r in urls.judge(one, rules).collect()] == ["allow"]


def test_many_labels_and_tied_rules(spark):
    deep = "x." * 20_000 + "a.net"
    pages = spark.createDataFrame([(1, f"http://{deep}/p"), (2, "http://b.net/p"), (2, "http://b.net/p"), (3, "http://\u212a.net/"), (4, "http://ab.net/cd")], "page_id long, url string")
    # for page 4 rules of equal length: the longer host wins; of two verdicts of one rule, block
    rules = spark.createDataFrame([("a.net", "/", "block"), ("b.net", "/p", "allow"), ("b.net", "/p", "block"), ("k.net", "/", "block"), ("net", "/cd", "allow"), ("ab.net", "", "block")], "host string, path string, verdict string")
    got = sorted((r.page_id, r.host, r.rule, r.verdict) for r in urls.judge(pages, rules).collect())
    assert got == [
        (1, deep, "a.net/", "block"), (2, "b.net", "b.net/p", "block"), (2, "b.net", "b.net/p", "block"),
        (3, "\u212a.net", None, "allow"), (4, "ab.net", "ab.net", "block"),
    ]
