from __future__ import annotations

import random
import re

import pytest

from formicary.llm.urls import ActiveRules, judge_urls
from tests.llm.helpers import frame

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"), ("block", "a.example.com", ""), ("allow", "a.example.com", "/x/y"), ("block", "example.com", "/x/")]


def brute_force(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p), len(h), a, h + p) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[2] if best else "allow"


def urls():
    draw = random.Random(1)
    hosts = ["net", "example.net", "EXAMPLE.com", "a.example.com", "b.a.example.com", "xexample.com", "org", "x.org", "com", "example.com:80", "", "a..b", "-.example.net", "é.org"]
    paths = ["", "/", "/en/", "/en/x", "/de/", "/de", "/x/y", "/x/yz", "/fr/?q", "/fr/#a", "?q=/en/", "/X/y"]
    out = [draw.choice(["http://", "https://", "x://", ""]) + draw.choice(hosts) + draw.choice(paths) for _ in range(400)]
    return [*out, None, "", "://", "http://", "no scheme", "http://a://b/c", *["http://hot.example.net/en/1"] * 300]


@pytest.mark.parametrize("ranges", [1, 3, 16])
def test_verdicts_are_those_of_brute_force(spark, ranges):
    rows = [(k, u) for k, u in enumerate(urls())] + [(None, "http://x.org/fr/"), (7, "http://net/")]
    pages = frame(spark, rows, "page_id long, url string")
    rules = spark.createDataFrame([*RULES, ("allow", None, "/")], "action string, host string, path string")
    got = judge_urls(pages.withColumn("rule", pages.url), rules, ["page_id"], ranges=ranges).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(((k, *brute_force(u, RULES)) for k, u in rows), key=repr)


def test_long_urls_and_odd_characters(spark):
    long = "http://a.example.com/x/" + "y" * 100_000
    rows = [(k, u) for k, u in enumerate([long, long + "z", "http://" + "a." * 20_000 + "net/", "http://x\x1fy.net/", "http://é\u2028.org/fr/\x1f", *[long] * 40])]
    rules = spark.createDataFrame(RULES, "action string, host string, path string")
    got = judge_urls(frame(spark, rows, "page_id long, url string"), rules, ["page_id"], ranges=6).collect()
    assert sorted(tuple(r) for r in got) == sorted((k, *brute_force(u, RULES)) for k, u in rows)


def test_many_rules_meet_many_ranges(spark):
    draw = random.Random(2)
    rules = [(draw.choice(["block", "allow"]), ".".join(draw.choice("abc") for _ in range(draw.randint(1, 4))), draw.choice(["/", "/p/", "/p/q", ""])) for _ in range(80)]
    rules = list({r[1:]: r for r in rules}.values())
    rows = [(k, "http://" + ".".join(draw.choice("abc") for _ in range(draw.randint(1, 5))) + draw.choice(["/", "/p/q", "/p/", ""])) for k in range(300)]
    got = judge_urls(frame(spark, rows, "page_id long, url string"), spark.createDataFrame(rules, "action string, host string, path string"), ["page_id"], ranges=12)
    assert sorted(tuple(r) for r in got.select("page_id", "verdict").collect()) == sorted((k, brute_force(u, rules)[3]) for k, u in rows)


def test_empty_tables(spark):
    rules = spark.createDataFrame([], "action string, host string, path string")
    assert judge_urls(frame(spark, [], "page_id long, url string"), rules, ["page_id"]).collect() == []
    (row,) = judge_urls(frame(spark, [(1, "http://a/b")], "page_id long, url string"), rules, ["page_id"]).collect()
    assert (row.rule, row.verdict) == (None, "allow")


def test_the_stack_holds_nested_hosts_only():
    active = ActiveRules()
    active.enter(b"net.", b"/", "net/", "block")
    active.enter(b"net.a.", b"/", "a.net/", "allow")
    assert active.longest(b"net.a.b./", b"/") == ("allow", "a.net/")
    active.enter(b"org.", b"/", "org/", "block")
    assert len(active.stack) == 1 and active.longest(b"net.a./", b"/") is None
