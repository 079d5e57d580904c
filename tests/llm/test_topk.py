from __future__ import annotations

import math
import random

import numpy as np
import pytest

from kpiloom.llm import topk
from kpiloom.llm.topk import ImpactIndex, block_of, top_k

VECTORS = "vec_id long, embedding array<float>, label int"


def by_hand(rows, k=5, step=50):
    whole = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in ((r[0], r[1]) for r in rows)
             if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in {(i, tuple(v)) for i, v in whole if i % step == 0}:
        scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in whole if j != i)
        out += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def result(df, step=50, k=5):
    return sorted(tuple(r) for r in top_k(df, df.where(f"vec_id % {step} = 0"), k=k).collect())


@pytest.mark.parametrize(("block", "queries"), [(8192, 512), (40, 3)])
def test_against_all_pairs(docs, monkeypatch, block, queries):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "QUERIES", queries)
    draw = np.random.default_rng(1)
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(draw.normal(0, 0.2, (300, 16)))]
    rows += [(i + 300, rows[7][1], 0) for i in range(40)]  # ties
    assert result(docs(rows, VECTORS), 20) == by_hand(rows, step=20)


def test_no_member_is_passed_over():
    draw = np.random.default_rng(3)
    vectors = np.floor(draw.normal(0, 40, (2000, 32))).astype(np.int64)
    vectors[::7] = 0
    index, queries = ImpactIndex(vectors), np.floor(draw.normal(0, 40, (32, 60))).astype(np.int64)
    may = index.candidates(queries, 5)
    scores = vectors @ queries
    for q in range(60):
        top = np.argsort(-scores[:, q], kind="stable")[:5]
        assert may[top, q].all()
    assert may.mean() < 0.2


def test_postings_are_in_order_of_impact():
    index = ImpactIndex(np.array([[5, -300, 0], [130, 4, 299]]))
    sizes = [abs(w) for held in index.segments for _, _, ws in held for w in ws]
    assert sizes == sorted(sizes, reverse=True)


def test_edges(docs):
    nan, inf = float("nan"), float("inf")
    good = [0.5, -0.25, 1.0]
    rows = [(0, good, 1), (0, good, 1), (50, [0.0, 0.0, 0.0], 1), (1, good, None), (1, good, None), (2, None, 1), (3, [nan, 0.0, 0.0], 1), (4, [inf, 0.0, 0.0], 1),
            (5, [None, 0.1, 0.1], 1), (None, good, 1), (6, [-1.0], 1), (7, [], 1), (100, [nan], 1), (8, good, 1)]
    assert result(docs(rows, VECTORS)) == by_hand(rows)
    assert result(docs([], VECTORS)) == []
    assert result(docs([(0, good, 1)], VECTORS)) == []
    assert result(docs([(0, good, 1), (1, good, 1)], VECTORS)) == [(0, 1, 1, 86016)]


def test_ties_go_to_the_smaller_id(docs):
    rows = [(i, [random.Random(i % 2).random()], 0) for i in range(60)]
    assert result(docs(rows, VECTORS), 10) == by_hand(rows, step=10)


@pytest.mark.parametrize("copies", [1, 2, 5, 8, 40])
def test_own_copies_hide_no_neighbour(copies):
    draw = np.random.default_rng(5)
    unit = draw.normal(size=(4000, 64))
    vectors = np.floor(256 * unit / np.linalg.norm(unit, axis=1)[:, None]).astype(np.int64)
    ids = np.arange(4000)
    for q in range(3):
        vectors[100 * q : 100 * q + copies], ids[100 * q : 100 * q + copies] = vectors[100 * q], 100 * q
    own = np.array([0, 100, 200])
    queries = vectors[own].T
    want = []
    for q in range(3):
        at = np.flatnonzero(ids != own[q])
        scores = vectors[at] @ queries[:, q]
        want += [(q, int(ids[at[i]]), int(scores[i])) for i in np.lexsort((ids[at], -scores))[:5]]
    index = ImpactIndex(vectors)
    assert index.best(queries, ids, own, 5) == want
    assert index.candidates(queries, 5, ids[:, None] == own[None, :]).mean() < 0.2


def test_own_copies_in_a_block_of_thousands(docs):
    draw = np.random.default_rng(6)
    unit = draw.normal(size=(2000, 32))
    rows = [(i + 1, [float(x) for x in v / np.linalg.norm(v)], 0) for i, v in enumerate(unit)]
    rows += [(500, rows[499][1], 0)] * 7
    assert result(docs(rows, VECTORS), 500) == by_hand(rows, step=500)


def test_repeated_rows_are_dealt_out(docs):
    from pyspark.sql import functions as F

    held = docs([(1, [1.0], 0)] * 4000, VECTORS).select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.monotonically_increasing_id().alias("nth"))
    sizes = [r["count"] for r in held.select(block_of(8)).groupBy("block").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 650


def test_large_components(docs):
    """Products beyond 52 and beyond 63 bits, and components beyond the long range."""
    draw = np.random.default_rng(8)
    rows = [(i, [float(x) for x in draw.normal(0, 10.0 ** draw.integers(0, 9), 12)], 0) for i in range(200)]
    huge = [(300, [1e6] * 12, 0), (301, [1e300, *[0.5] * 11], 0), (302, [-1e300] * 12, 0), (350, [1e300, *[0.0] * 11], 0)]
    rows += huge
    kind = "vec_id long, embedding array<double>, label int"
    most, ends = 1 << 53, (-(1 << 63), (1 << 63) - 1)
    whole = {i: [max(-most, min(most, math.floor(256 * x))) for x in v] for i, v, _ in rows}
    want = []
    for q in [i for i in whole if i % 50 == 0]:
        scores = sorted((-sum(a * b for a, b in zip(whole[q], v)), j) for j, v in whole.items() if j != q)
        want += [(q, rank + 1, j, max(ends[0], min(ends[1], -s))) for rank, (s, j) in enumerate(scores[:5])]
    assert result(docs(rows, kind)) == sorted(want)


def test_each_vector_is_shuffled_once(docs, monkeypatch):
    monkeypatch.setattr(topk, "QUERIES", 3)
    rows = [(i, [float(i % 7), 1.0], 0) for i in range(60)]
    df = docs(rows, VECTORS)
    out = top_k(df, df.where("vec_id % 5 = 0"), k=2)
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" not in text and text.count("Generate explode") == 1
    assert sorted(tuple(r) for r in out.collect()) == by_hand(rows, k=2, step=5)
