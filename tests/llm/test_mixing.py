from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from kpiloom.llm.mixing import mix, random_share, sample_ends, sample_spans, word_targets


def targets_by_hand(sizes, weights=(5, 2, 1), most=3):
    """Reshare the excess until no target is above its limit."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in fixed]
        level = (total - sum(fixed.values())) / (sum(weight[s] for s in open_) or 1)
        over = [s for s in open_ if weight[s] * level > most * sizes[s]]
        if not over:
            return fixed | {s: weight[s] * level for s in open_}
        fixed |= {s: most * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 1000, "c": 1000}, {"a": 1, "b": 1, "c": 1000, "d": 5, None: 50}, {"z": 7}, {"a": 0, "b": 10, "c": 3},
    {"B": 30, "a": 20, "é": 10, "Z": 1, "~": 900}, {"a": 0},
])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in word_targets(df, (5, 2, 1), 3).collect()}
    want = targets_by_hand(sizes)
    assert got == pytest.approx(want)


def rows_of(n, seed):
    draw = random.Random(seed)
    return [(i, "w " * min(int(draw.paretovariate(0.8) * 5), 3000), "en", draw.choice(["a", "a", "a", "b", "c", "d", None]), 0) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_words_come_near_the_targets(docs, seed):
    rows = rows_of(800, seed)
    got = mix(docs(rows)).collect()
    assert [tuple(r) for r in sorted(got)] == [tuple(r) for r in sorted(mix(docs(rows[::-1])).collect())]
    size, source = {r[0]: len(r[1].split()) for r in rows}, {r[0]: r[3] for r in rows}
    sizes = {s: sum(size[i] for i in size if source[i] == s) for s in {*source.values()}}
    want = targets_by_hand(sizes)
    assert len(got) == len(rows)
    for s in sizes:
        mine = [r for r in got if source[r["doc_id"]] == s]
        assert {(r["source_size"], round(r["target"], 6)) for r in mine} == {(sizes[s], round(want[s], 6))}
        assert abs(sum(r["taken"] for r in mine) - want[s]) < 0.02 * want[s] + 2
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["taken"] == r["size"] * r["copies"] <= 3 * r["size"]
        assert r["copies"] - int(r["target"] / r["source_size"]) in (0, 1)


def test_ends_against_sorting(spark):
    draw = random.Random(3)
    rows = [(s, draw.getrandbits(50) if draw.random() < 0.9 else 77, draw.randint(0, 40)) for s in (1, 2, 3) for _ in range(200)]
    quotas = {1: 900, 2: 0, 3: 10**6}
    df = spark.createDataFrame(rows, "source_no long, key long, words long")
    got = {r["source_no"]: (r["at"], r["gap"]) for r in sample_ends(df, spark.createDataFrame(list(quotas.items()), "source_no long, quota long")).collect()}
    for s, quota in quotas.items():
        by_key = {}
        for n, key, words in rows:
            if n == s:
                by_key[key] = by_key.get(key, 0) + words
        taken, sum_ = set(), 0
        for key in sorted(by_key):
            if sum_ + by_key[key] > quota:
                break
            sum_ += by_key[key]
            taken.add(key)
        if len(taken) == len(by_key):
            assert s not in got
        else:
            at, gap = got[s]
            assert {k for k in by_key if k <= at} == taken and gap == quota - sum_


def test_shares_are_even(spark):
    got = [r[0] for r in spark.range(4000).select(random_share(F.col("id"))).collect()]
    assert all(0 < x < 1 for x in got) and abs(sum(got) / len(got) - 0.5) < 0.02


def test_edges(docs, edge_rows):
    got = mix(docs(edge_rows)).collect()
    assert len(got) == len(edge_rows)
    want = sorted((str(r[0]), len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))) for r in edge_rows)
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == want
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    assert {r["copies"] for r in got if r["source_size"] == 0} == {1}
    assert mix(docs([])).collect() == []


def test_no_words_at_all(docs):
    got = mix(docs([(1, "", "", "a", 0), (2, None, "", None, 0)])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in got] == [(0, 0.0, 0)] * 2


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_spans_against_taking_one_by_one(spark, seed):
    draw = random.Random(seed)
    rows = [(s, k, draw.choice([0, 1, 3, 5, 40, 700])) for s in (1, 2, 3) for k in draw.sample(range(1 << 50), 300)]
    quotas = {1: 5000, 2: 0, 3: 10**6}
    df = spark.createDataFrame(rows, "source_no long, key long, words long")
    spans = sample_spans(df, spark.createDataFrame(list(quotas.items()), "source_no long, quota long")).collect()
    got = {(r["source_no"], k, n) for r in spans for a, upto, fits in r["spans"] for s, k, n in rows if s == r["source_no"] and a < k <= upto and n <= fits and (n or a < 0)}
    want, left, crossed = set(), dict(quotas), set()
    for s, k, n in sorted(rows):
        if n <= left[s] and (n or s not in crossed):
            want.add((s, k, n))
            left[s] -= n
        elif n:
            crossed.add(s)
    assert got == want


@pytest.mark.parametrize("hot", [False, True])
def test_short_documents_fill_behind_a_long_one(docs, hot):
    rows = [(None if hot else i, f"{i} " + "w " * (i % 20 + 1), "en", "b", 0) for i in range(1000)]
    rows += [(5000 + i, "w " * 20_000 + str(i), "en", "b", 0) for i in range(4)] + [(9000, "w " * 75_000, "en", "a", 0)]
    got = mix(docs(rows)).collect()
    mine = [r for r in got if r["source_size"] != 75_000]
    assert len(mine) == 1004 and abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 2


def test_repeated_ids_are_drawn_one_by_one(docs):
    rows = [(None, f"w {i}", "en", "ab"[i % 2], 0) for i in range(1000)] + [(1, "w w", "en", "a", 0)] * 200
    got = mix(docs(rows)).collect()
    assert {r["copies"] for r in got if r["doc_id"] == 1} in ({0, 1}, {1, 2})
    for size in {r["source_size"] for r in got}:
        mine = [r for r in got if r["source_size"] == size]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 2
