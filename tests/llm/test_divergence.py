from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from kpiloom.llm import divergence
from kpiloom.llm.divergence import share, source_divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def by_hand(rows, documents=3, ranks=200):
    """The contract, every term of every pair."""
    groups, df, words = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, *_ in rows:
        text, lang, source = text or "", lang or "", source or ""
        terms = TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        groups[lang, source].update(terms)
        df[lang].update(set(terms))
        words[lang].update(terms)
    out = []
    for lang in {lang for lang, _ in groups}:
        kept = [t for t in df[lang] if df[lang][t] >= documents]

        def shares(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + 1) // (total + len(kept)) for t in kept}

        p = {source: shares(counts) for (at, source), counts in groups.items() if at == lang}
        q = shares(words[lang])
        for source in p:
            pairs = [(sum((p[source][t] - p[b][t]) ** 2 // p[b][t] for t in kept), b) for b in p if b != source]
            terms = [((p[source][t] - q[t]) ** 2 // q[t], t) for t in kept if groups[lang, source][t] and p[source][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, ranks)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, source, part, item, value, i + 1) for i, (value, item) in enumerate(found[:most])]
    return sorted(out)


def result(df, **how):
    out = source_divergence(df, **how)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in out.collect())


def drawn(seed, n=200):
    draw, copies = random.Random(seed), ["same text here", "Kopie der Kopie"]
    vocabulary = ["alpha", "Beta", "BETA", "gamma1delta", "é", "Éa", "日本", "x-y", "don't", "zeta", "eta", "𝒜b"]
    rows = []
    for i in range(n):
        text = draw.choice(copies) if draw.random() < 0.4 else " ".join(draw.choices(vocabulary, k=draw.randint(0, 30)))
        rows.append((i, text, draw.choice(["en", "de", None]), draw.choice(["a", "b", "b", "c", None]), 0))
    return rows


@pytest.mark.parametrize(("seed", "documents", "ranks"), [(1, 3, 200), (2, 1, 2), (3, 40, 3)])
def test_against_every_term(docs, seed, documents, ranks):
    rows = drawn(seed)
    assert result(docs(rows), documents=documents, ranks=ranks) == by_hand(rows, documents, ranks)


def test_edges(docs, edge_rows):
    assert result(docs(edge_rows)) == by_hand(edge_rows)
    assert result(docs(edge_rows), documents=1) == by_hand(edge_rows, 1)
    assert result(docs([])) == []


def test_languages_without_terms(docs):
    rows = [(1, None, "en", "a", 0), (2, "12 34", "en", "b", 0), (3, "rare", "en", "c", 0)]
    got = result(docs(rows))
    assert got == by_hand(rows) and len(got) == 6 and {r[4] for r in got} == {0}


def test_copies_of_one_text_in_many_sources(docs):
    rows = [(i, "one text for all", "en", f"s{i % 30}", 0) for i in range(300)] + [(i, f"own{'abc'[i % 3]} text", "en", "s1", 0) for i in range(9)]
    assert result(docs(rows)) == by_hand(rows)


@pytest.mark.parametrize(("holders", "held"), [(1, 1), (2, 10)])
def test_parts_change_nothing(docs, monkeypatch, holders, held):
    monkeypatch.setattr(divergence, "HOLDERS", holders)
    monkeypatch.setattr(divergence, "HELD", held)
    rows = drawn(4)
    assert result(docs(rows)) == by_hand(rows)


def test_large_counts_stay_exact(spark):
    n, total, v = 9 * 10**17, 9 * 10**18, 10**6
    got = spark.range(1).select(share(F.lit(n), F.lit(total), F.lit(v)).alias("p")).first()["p"]
    assert got == 1 + 1_000_000_000 * (n + 1) // (total + v)
