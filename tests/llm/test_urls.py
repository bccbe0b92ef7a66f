from __future__ import annotations

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import queries, urls

SCHEMA = "page_id long, url string, html string, host int, rule string, verdict int"


def expected(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate({i: i + 32 for i in range(65, 91)}), m[2]) if m else ("", "")
    best = max(
        (r for r in urls.RULES if (host == r.name.partition("/")[0] or host.endswith("." + r.name.partition("/")[0])) and path.startswith("/" + r.name.partition("/")[2])),
        key=lambda r: len(r.name), default=None,
    )
    word = None if best else min((r.name for r in urls.WORDS if r.name in re.findall("[A-Za-z0-9]+", host + path)), default=None)
    return host, path, best and best.name, word, best.verdict if best else "block" if word else "allow"


URLS = [
    None, "", "no scheme", "http://", "HTTP://A.Example.COM/en/7", "http://example.com/en/77?x=1", "http://example.com/en/", "x://com/en/",
    "http://xcom/en/1", "http://com", "http://a.net/de/8#f", "http://m.example.net/de/80", "http://example.net/de/9", "http://org/es/?q", "http://a.org/es",
    "http://a.b/casino/x", "http://casino.net/de/", "http://a.b/Casino", "a://b://com/en/", "http://a.com\n/en/", "http://a.net:80/de/", "http://a.b/login.html?cart",
]


def test_every_url_like_brute_force(spark):
    rows = [(i, u, None, 1, "x", 2) for i, u in enumerate(URLS)] + [(0, None, None, 1, "x", 2), (None, URLS[4], "h", 1, "x", 2)]
    found = urls.filter_urls(spark.createDataFrame(rows, SCHEMA)).collect()
    key = lambda r: tuple(map(repr, r))
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.pattern, r.verdict) for r in found), key=key) == sorted(((i, *expected(u)) for i, u, *_ in rows), key=key)


def test_rarest_token_and_rules_without_one(spark):
    rules = (
        urls.Rule("any", "block", "tail$", (), 1), urls.Rule("two", "allow", "^a\\.b/(x|y)/common", ("common", "rare"), 2), urls.word_rule("block", "common", 3),
    )
    pages = spark.createDataFrame([(1, "http://a.b/x/common/rare"), (2, "http://a.b/z/retail"), (3, "http://c.d/")], "page_id long, url string")
    found = {r.page_id: (r.rule, r.verdict) for r in urls.filter_urls(pages, rules).select("page_id", "rule", "pattern", "verdict").collect()}
    assert found == {1: (None, "block"), 2: ("any", "block"), 3: (None, "allow")}


def test_no_rules_and_no_rows(spark):
    pages = spark.createDataFrame([(1, "http://com/en/")], "page_id long, url string")
    assert [(r.rule, r.verdict) for r in urls.filter_urls(pages, ()).collect()] == [(None, "allow")]
    assert urls.filter_urls(pages.where("false")).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("abz/.-7"), max_size=12))
def test_whole_tokens_are_in_every_match(text):
    rule = urls.host_rule("block", "a.b/z/7")
    if re.search(rule.pattern, text):
        assert set(rule.tokens) <= set(re.findall(urls.TOKEN, text))


def test_sql_is_given():
    assert "op7_filter_urls" in queries.SQL and "op9_mix" in queries.SQL
