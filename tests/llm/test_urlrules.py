from __future__ import annotations

import random

import pytest

from kpiloom.llm import urlrules
from kpiloom.llm.queries import URL_RULES
from kpiloom.llm.urlrules import Rule, judge_urls, rule_tokens
from tests.helpers import plan_text

PAGES = "page_id long, url string, html string"


def by_hand(url, rules):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut], rest[cut:]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    best = None
    for rule in rules:
        where, slash, start = rule.pattern.partition("/")
        if (host == where or host.endswith("." + where)) and path.startswith(slash + start):
            best = max([b for b in (best, (len(rule.pattern), rule.pattern, rule.verdict)) if b])
    return host, path, best[1] if best else None, best[2] if best else "allow"


URLS = [
    "http://a.example.org/es/1", "https://EXAMPLE.org/en/12", "http://example.org/en/21", "http://notexample.org/es/x", "ftp://org/", "http://org",
    "http://x.com/fr/", "http://x.com/fr", "http://x.com/de/a?b=/fr/", "http://com/de/#x", "http://x.net/de/", "nothing", "", None, "://", "a://b://c/d",
    "http://x.com?/fr/", "http://example.org/es/\nx", "http://ÉX.org/a", "http://a.org:80/", "http://..org/", "http://org.//",
]


@pytest.mark.parametrize("broadcast", [True, False])
def test_given_rules(docs, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(urlrules, "BROADCAST_RULES", 0)
    rows = [(i, u, "x") for i, u in enumerate(URLS * 2)] + [(None, "http://x.com/de/", None)] * 2
    got = sorted([(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in judge_urls(docs(rows, PAGES), URL_RULES).collect()], key=repr)
    assert got == sorted([(i, *by_hand(u, URL_RULES)) for i, u, _ in rows], key=repr)


def test_many_rules(docs):
    draw = random.Random(8)
    part = lambda: "".join(draw.choices("abc.", k=draw.randint(1, 3)))
    rules = {p: Rule(draw.choice(["allow", "block"]), p) for p in (f"{part()}/{'/'.join(part() for _ in range(draw.randint(0, 3)))}" for _ in range(200))}
    rows = [(i, f"http://{part()}.{part()}/{'/'.join(part() for _ in range(draw.randint(0, 4)))}", "x") for i in range(400)]
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in judge_urls(docs(rows, PAGES), list(rules.values())).collect())
    want = sorted((i, *by_hand(u, rules.values())) for i, u, _ in rows)
    assert [tuple(map(str, g)) for g in got] == [tuple(map(str, w)) for w in want]


def test_tokens_are_complete():
    assert rule_tokens("example.org/en/1") == ["h:example", "h:org", "p:en"]
    assert rule_tokens("org/") == ["h:org"]
    assert rule_tokens("/") == ["*"]


def test_only_native_operators(docs):
    df = judge_urls(docs([(1, "http://x.org/", "x")], PAGES), URL_RULES)
    df.collect()
    assert not any(word in plan_text(df) for word in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))


def test_edges(docs):
    assert judge_urls(docs([], PAGES), URL_RULES).collect() == []
    got = judge_urls(docs([(1, None, None)], PAGES), []).first()
    assert (got["host"], got["path"], got["rule"], got["verdict"]) == ("", "", None, "allow")
    long = "http://x.org/" + "a/" * 200_000
    assert judge_urls(docs([(1, long, None)], PAGES), URL_RULES).first()["rule"] == "org/"
