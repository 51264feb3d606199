import random

import pytest

from tessera.llm.queries import URL_RULES
from tessera.llm.url_filter import Rule, host_reputation, judge_urls, labelled_outcomes

URLS = [
    None, "", "no scheme", "http://A.Example.NET/en/x?y#z", "https://example.net", "https://example.net/?q", "https://b.example.com/de/1", "x://y.org/fr/", "x://y.org?/fr/",
    "http://u.org#://v.net/", "://net/", "http://notnet/", "http://q.co.uk/a//b", "http://h/" + "p" * 9000, "http://ÀB.net/É", "a\nb://c.net/\nd",
]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, rest = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
    path = rest[: min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(r.name), default=None)


def test_rules(spark):
    pages = spark.createDataFrame([(i, u, "h", "x") for i, u in enumerate(URLS)], "page_id long, url string, html string, host string")
    none = spark.createDataFrame([], "host string, bad int")
    rows = {r.page_id: r for r in judge_urls(pages, none, URL_RULES).collect()}
    assert len(rows) == len(URLS)
    for i, u in enumerate(URLS):
        host, path, rule = brute(u)
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, rule and rule.name), u
        assert rows[i].verdict == (rule.verdict if rule else "allow")
    assert judge_urls(pages.limit(0), none, ()).count() == 0


def test_reputation_shrinks_and_blocks(spark):
    rng = random.Random(2)
    rows = [(f"good{i}.ok.com", int(rng.random() < 0.05)) for i in range(40) for _ in range(30)] + [(f"bad{i}.spam.org", int(rng.random() < 0.95)) for i in range(20) for _ in range(25)] + [("one.ok.com", 1), (None, 1), ("x.ok.com", None)]
    outcomes = spark.createDataFrame(rows, "host string, bad int")
    hosts, domains, suffixes, overall = host_reputation(outcomes)
    h = {r.host: r for r in hosts.collect()}
    assert len(h) == 61 and h["one.ok.com"].mean < 0.9 and h["one.ok.com"].low < 0.5 < h["bad0.spam.org"].low
    assert overall == pytest.approx((sum(b or 0 for n, b in rows if n) + 0.5) / (len(rows) - 2 + 1))
    pages = spark.createDataFrame([(1, "http://bad3.spam.org/"), (2, "http://good1.ok.com/"), (3, "http://new.spam.org/x"), (4, "http://one.ok.com/"), (5, "http://new.else.net/")], "page_id long, url string")
    v = {r.page_id: r.verdict for r in judge_urls(pages, outcomes, (Rule("block", "else.net"),)).collect()}
    assert v == {1: "block", 2: "allow", 3: "block", 4: "allow", 5: "block"}


def test_outcomes(spark):
    pages = spark.createDataFrame([(1, "http://a.com/en/5.html?x"), (2, "http://a.com/en/6/"), (3, None), (4, "http://b.com/x"), (5, "http://b.com/7#t")], "page_id long, url string")
    labels = spark.createDataFrame([(5, 0, 0), (5, 1, 0), (6, 1, 0), (7, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, labelled_outcomes(pages, labels).collect())) == [("a.com", 0), ("a.com", 1), ("b.com", 1)]
