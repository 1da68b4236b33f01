from shelfwright.llm import url_filter as U
from shelfwright.llm.queries import URL_RULES


def test_split():
    assert U.split_url(None) == ("", "") and U.split_url("no scheme/x") == ("", "")
    assert U.split_url("http://A.Exämple.COM/De/?q#f") == ("a.exämple.com", "/De/")
    assert U.split_url("x://h?a/b") == ("h", "") and U.split_url("://#") == ("", "") and U.split_url("a://b/c://d") == ("b", "/c://d")


def brute(url, rules):
    host, path = U.split_url(url)
    fit = [(len(r.partition("/")[0]), len(r), r, v) for v, r in rules
           if host and ("." + host).endswith("." + r.partition("/")[0]) and path.startswith("/" * ("/" in r) + r.partition("/")[2])]
    return max(fit)[2:] if fit else (None, None)


def test_longest_rule_wins():
    rules = URL_RULES + [("block", "a.example.net"), ("allow", "a.example.net/en"), ("block", "a.example.net/en/x"), ("allow", "com")]
    hosts = ["net", "example.net", "a.example.net", "b.a.example.net", "xexample.net", "example.com", "org", "a.org", "com.", "", ".net"]
    paths = ["", "/", "/en", "/en/", "/english", "/en/x", "/en/xy", "/en/x/y", "/de/", "/fr/", "/fr", "//en/"]
    trie = U.build_trie(rules)
    for h in hosts:
        for p in paths:
            for tail in ("", "?q", "#x/y"):
                url = f"https://{h}{p}{tail}"
                assert U.judge(trie, url)[2:] == brute(url, rules), url


def test_rows(spark):
    pages = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (2, "", "x"), (3, "http://q.net/", "x"), (None, "http://q.net", "x"),
                                   (4, "http://example.net/en/" + "y" * 100_000, "x")], "page_id long, url string, rule string")
    got = [(r.page_id, r.rule, r.verdict) for r in U.filter_urls(pages, URL_RULES).collect()]
    assert sorted(got, key=str) == sorted([(1, None, "allow"), (1, None, "allow"), (2, None, "allow"), (3, "net/", "block"),
                                           (None, None, "allow"), (4, "example.net/en/", "allow")], key=str)
    assert U.filter_urls(pages.limit(0), URL_RULES).count() == 0


def test_rule_list_is_bounded(monkeypatch):
    monkeypatch.setattr(U, "MAX_RULE_BYTES", 10)
    try:
        U.build_trie([("block", "a" * 11)])
    except ValueError:
        return
    raise AssertionError("no error")
