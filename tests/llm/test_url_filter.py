from __future__ import annotations

import pytest
from helpers import rows
from pyspark.sql import functions as F

from tillsight.llm import url_filter
from tillsight.llm.queries import URL_RULES
from tillsight.llm.storage import Scratch
from tillsight.llm.url_filter import Rule

URLS = [
    ("http://a.COM/x", "a.com", "/x", "com/", "allow"),
    ("https://example.com/en/1?q", "example.com", "/en/1", "example.com/en/", "block"),
    ("https://WWW.example.com/en/1#t", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
    ("https://m.www.example.com/en/", "m.www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("https://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
    ("x://host.net/es/?a://b.com/", "host.net", "/es/", "net/es/", "block"),
    ("http://other.com", "other.com", "", None, "allow"),
    ("no scheme", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("://", "", "", None, "allow"),
    ("http://ÄB.org/É\n/x", "Äb.org", "/É\n/x", None, "allow"),
]


def pages(spark, data):
    return spark.createDataFrame([(i, *p) for i, p in enumerate(data)], "page_id long, url string, html string, verdict string")


def test_rules_hosts_and_paths(spark):
    found = url_filter.judge(pages(spark, [(u[0], None, "clash") for u in URLS]), URL_RULES)
    expected = [(i, *u[1:]) for i, u in enumerate(URLS)]
    assert rows(found, "page_id", "host", "path", "rule", "verdict") == sorted(expected, key=repr)


def test_empty_table(spark):
    assert url_filter.judge(pages(spark, []), URL_RULES).collect() == []


def test_distrust_reaches_those_that_link_to_blocked_hosts(spark):
    rules = [Rule("block", "bad.org", "/"), Rule("allow", "good.org", "/")]
    data = [
        ("http://bad.org/", "<a href='http://bad.org/2'>", ""),
        ("http://farm.org/", '<a href="http://bad.org/">x</a><A HREF="//bad.org/a">', ""),
        ("http://friend.org/", "", ""),
        ("http://good.org/", '<a href="http://friend.org/">', ""),
        ("http://lone.org/", '<a href="#top"><a href="mailto:x@bad.org">', ""),
    ]
    found = rows(url_filter.judge(pages(spark, data), rules), "host", "verdict", "by_host")
    assert found == [
        ("bad.org", "block", False),
        ("farm.org", "block", True),
        ("friend.org", "allow", True),
        ("good.org", "allow", False),
        ("lone.org", "allow", True),
    ]


def test_ranks_match_power_iteration(spark):
    links = [("a", "b", 2), ("a", "c", 1), ("b", "c", 1), ("c", "a", 3), ("d", "d", 1), ("e", "a", 1)]
    seeds = {"a": (1, 0), "d": (3, 2), "e": (0, 2)}
    hosts = spark.createDataFrame([(h, *s) for h, s in seeds.items()], "host string, allowed long, blocked long")
    edges = spark.createDataFrame(links, "src string, dst string, links long")
    found = url_filter.propagate(hosts, edges, Scratch(spark, "t"), tolerance=1e-9)
    names = "abcde"

    def ranks(edges, seed):
        total = sum(seed.values())
        seed = {h: seed.get(h, 0) / total for h in names}
        rank = dict(seed)
        for _ in range(300):
            flow = dict.fromkeys(names, 0.0)
            for h in names:
                out = [(d, n) for s, d, n in edges if s == h] or [(h, 1)]
                for d, n in out:
                    flow[d] += rank[h] * n / sum(k for _, k in out)
            rank = {h: 0.15 * seed[h] + 0.85 * flow[h] for h in names}
        return rank

    trust = ranks(links, {h: s[0] for h, s in seeds.items()})
    distrust = ranks([(d, s, n) for s, d, n in links], {h: s[1] for h, s in seeds.items()})
    for row in found.collect():
        assert row["trust"] == pytest.approx(trust[row["host"]])
        assert row["distrust"] == pytest.approx(distrust[row["host"]])


def test_distrust_reaches_hosts_many_links_away(spark):
    rules = [Rule("block", "h0.org", "/")]
    data = [(f"http://h{i}.org/", f"<a href=http://h{i - 1}.org/x>" if i else None, "") for i in range(16)]
    found = url_filter.judge(pages(spark, data), rules, threshold=0.0)
    assert {r["verdict"] for r in found.collect()} == {"block"}
    hosts = spark.createDataFrame([("h0.org", 0, 1)], "host string, allowed long, blocked long")
    edges = spark.createDataFrame([(f"h{i}.org", f"h{i - 1}.org", 1) for i in range(1, 40)], "src string, dst string, links long")
    ranks = {r["host"]: r["distrust"] for r in url_filter.propagate(hosts, edges, Scratch(spark, "t")).collect()}
    assert sum(ranks.values()) == pytest.approx(1.0, abs=1e-5)
    assert ranks["h39.org"] == pytest.approx(0.85**39, rel=1e-3)


def test_values_of_links_in_any_quotes(spark):
    html = """<a href=http://a.org/x><a HREF = 'http://b.org/"q"'><a href="//c.org/it's"><link href=/own><a href=http://d.org><a href=>"""
    found = url_filter.host_edges(spark.createDataFrame([("me.org", html), ("me.org", None)], "host string, html string"))
    assert rows(found, "src", "dst", "links") == [("me.org", h, 1) for h in ("a.org", "b.org", "c.org", "d.org", "me.org")]


def test_repeated_pages_and_very_long_html(spark):
    long_html = "<p>x</p>" * 100_000 + "<a href='http://bad.org/'>"
    data = [("http://farm.org/", long_html, ""), ("http://farm.org/", long_html, ""), ("http://farm.org/", None, ""), ("http://bad.org/", None, "")]
    found = url_filter.judge(pages(spark, data), [Rule("block", "bad.org", "/")], threshold=0.1)
    assert rows(found, "page_id", "verdict") == [(i, "block") for i in range(4)]


def test_equally_long_rules_go_to_the_longer_host(spark):
    row = spark.range(1).select(F.lit("a.com").alias("host"), F.lit("/bc/").alias("path"))
    rules = [Rule("block", "com", "/bc"), Rule("allow", "a.com", "/")]
    assert row.select(url_filter.by_rules(rules, F.col("host"), F.col("path"))[0]).first()[0] == "a.com/"
