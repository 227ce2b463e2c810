"""Operator 3 against a plain reading of the rules."""

import re

from tidegauge.llm import url_filter

URLS = [
    None, "", "no scheme", "http://", "http:///x", "HTTP://WWW.Example.ORG/es/a?b#c", "https://example.org/en/1", "https://example.org/en/12", "https://a.example.org/en/2", "http://org/", "http://org", "http://notorg/es/",
    "http://x.com/fr/", "http://x.com/de/q", "http://x.com/dex", "http://a.b.c.d.example.org/es/", "http://x.com?u=/de/", "http://x.com#/de/", "ftp://u@x.org:80/p", "x://y://z.org/", "http://x.com/" + "a" * 5000, "http://" + "a." * 2000 + "org/z", "http://ÄB.org/ü",
]


def plain(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    return re.sub("[A-Z]", lambda m: m.group().lower(), host), path


def judged(url, rules=url_filter.QUERY_RULES):
    host, path = plain(url)
    fits = [(len(h) + len(p), v, h + p) for v, h, p in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits) if fits else None
    return host, path, best and best[2], best[1] if best else "allow"


def pages(spark):
    return spark.createDataFrame([(n, u, "x", "y") for n, u in enumerate(URLS + URLS[5:8])] + [(None, URLS[5], "x", "y")], "page_id long, url string, html string, host string")


def test_rules(spark):
    rows = url_filter.filter_urls(pages(spark), url_filter.rules_frame(spark, url_filter.QUERY_RULES)).collect()
    assert len(rows) == len(URLS) + 4
    for r in rows:
        url = URLS[5] if r.page_id is None else (URLS + URLS[5:8])[r.page_id]
        assert (r.host, r.path, r.rule, r.verdict) == judged(url), url


def test_ties_and_repeated_rules(spark):
    rules = [("allow", "x.com", "/a"), ("block", "x.com", "/a"), ("block", "x.com", "/a"), ("allow", "com", "/abcdefgh")]
    rows = url_filter.filter_urls(spark.createDataFrame([(1, "http://x.com/ab")], "page_id long, url string"), url_filter.rules_frame(spark, rules)).collect()
    assert [(r.rule, r.verdict, r.n_rules) for r in rows] == [("x.com/a", "block", 1)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.filter_urls(none, url_filter.rules_frame(spark, url_filter.QUERY_RULES)).collect() == []
    rows = url_filter.filter_urls(pages(spark), url_filter.rules_frame(spark, [])).collect()
    assert len(rows) == len(URLS) + 4 and {(r.rule, r.verdict) for r in rows} == {(None, "allow")}
