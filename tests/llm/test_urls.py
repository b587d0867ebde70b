from __future__ import annotations

import pytest

from loomwright.llm import urls


def brute(url, rules):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        k = min([i for i, c in enumerate(rest) if c in "/?#"], default=len(rest))
        host, tail = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:k]), rest[k:]
        path = tail[: min([i for i, c in enumerate(tail) if c in "?#"], default=len(tail))]
    fit = [r for r in rules if None not in r and (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fit, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]), r[2]), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


URLS = [
    None, "", "no scheme", "://", "http://", "http://COM/", "http://a.example.com/en/1?x#y", "https://www.Example.com/en/", "https://www.example.com/en", "http://x.net/es/9", "http://net/fr/", "http://xnet/fr/",
    "http://a.net?/fr/", "http://a.net#/fr/", "ftp://u://v.com/a", "http://a..com//en//x", "http://com.net/fr/\nline", "http://é.com/è/", "http://example.com/en/deep/er/path.html", "http://a.b.c.d.e.f.example.com/en/x/", "http://" + "a." * 300 + "com/" + "p/" * 300,
]


@pytest.mark.parametrize("rules", [urls.RULES, [], [*urls.RULES, ("example.com", "/en/de", "allow"), ("com", "", "block"), (None, "/", "block"), ("com", "/", "block"), ("", "", "block"), ("c.d.e.f.example.com", "/en/x", "allow")]])
def test_rules(spark, rules):
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(URLS)] + [(3, URLS[3], "z"), (None, URLS[6], None)], "page_id long, url string, rule string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = sorted((tuple(r) for r in urls.judge(pages, table).collect()), key=str)
    want = [(i, *brute(u, rules)) for i, u in enumerate(URLS)] + [(3, *brute(URLS[3], rules)), (None, *brute(URLS[6], rules))]
    assert got == sorted(want, key=str)


def test_no_pages(spark):
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame(urls.RULES, "host string, path string, verdict string")).count() == 0


def test_long_rule_lists_are_joined_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(urls, "MOST_BROADCAST", 1)
    test_rules(spark, urls.RULES)
