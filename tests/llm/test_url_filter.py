"""URL rules: index choice, longest rule, odd urls, against trying every rule."""
import re

import pytest

from paylake.llm import url_filter as U

URLS = ["http://a.org/x", "https://example.org/es/1", "https://www.Example.ORG/es/", "http://example.org/en/178", "http://xexample.org/es/1",
        "http://b.com/fr/1?x#y", "http://com/de/", "http://b.com/de", "http://b.com/de/", "http://b.com:80/de/", "ftp://org", "http://org?x=/es/",
        None, "", "no scheme", "://", "http://spam-farm.example.net/en/1", "http://x.spam.org/a", "http://spammer.net/", "HTTP://CHEAP-PILLS.COM/en/",
        "a://b://org/es", "http://é.example.org/es/ü", "http://casino.net", "http://casino.net:8080/x", "http://a.org/" + "x" * 20000]


def brute(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    hits = sorted((-r.priority, r.name is not None, r.name or "", r.action, r.pattern) for r in rules if re.search(r.pattern, host + path))
    if not hits:
        return host, path, None, U.DEFAULT
    return host, path, hits[0][2] or None, hits[0][3]


@pytest.mark.parametrize("index_bytes", [U.INDEX_BYTES, 0])
def test_equals_trying_every_rule(spark, monkeypatch, index_bytes):
    monkeypatch.setattr(U, "INDEX_BYTES", index_bytes)
    rows = [(i, u) for i, u in enumerate(URLS)] + [(None, URLS[1]), (1, URLS[1]), (1, URLS[1]), (1, URLS[2])]
    df = spark.createDataFrame([(i, u, "t", "h") for i, u in rows], "page_id long, url string, token string, host string")
    rules = (*U.DEFAULT_RULES, U.Rule("any-xx", "block", "x{50}", (), 5))
    key = lambda r: tuple((v is None, v or "") if not isinstance(v, int) else (False, str(v)) for v in r)
    got = sorted((tuple(r) for r in U.judge(df, rules).collect()), key=key)
    assert got == sorted(((i, *brute(u, rules)) for i, u in rows), key=key)
    assert U.judge(df.filter("false")).collect() == []


def test_rules_of_the_task():
    v = {u: brute(u, U.DEFAULT_RULES)[2:] for u in URLS}
    assert v["http://example.org/en/178"] == ("example.org/en/1", "block")
    assert v["https://www.Example.ORG/es/"] == ("example.org/es/", "block")
    assert v["http://xexample.org/es/1"] == ("org/", "allow")
    assert v["http://b.com/de"] == (None, "allow") and v["http://b.com/de/"] == ("com/de/", "block")
    assert v["http://b.com:80/de/"] == (None, "allow") and v["http://com/de/"] == ("com/de/", "block")
    assert v["http://spam-farm.example.net/en/1"] == (None, "block") and v["http://x.spam.org/a"] == ("org/", "allow")


def test_rules_are_filed_under_the_rarest_token(spark):
    urls = spark.createDataFrame([(["", "org", "example", "es"],), (["", "org", "es"],), (["", "org"],)], "tokens array<string>")
    rules = spark.createDataFrame([(0, ["example", "org", "es"]), (1, ["org"]), (2, [])], "no long, tokens array<string>")
    got = {r.no: r.token for r in U.index(urls, rules).collect()}
    assert got == {0: "example", 1: "org", 2: ""}
