from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from kpiloom.llm import whitening
from kpiloom.llm.whitening import Centred, jacobi_davidson, minres, orthonormal, whiten

VECTORS = "vec_id long, embedding array<float>, label int"
OUT = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def integers(rows):
    """Id and integer vector of the rows that take part."""
    kept = [(r[0], [float(np.float32(x)) if x is not None else None for x in r[1]]) for r in rows if r[1]]
    kept = [(i, v) for i, v in kept if all(x is not None and math.isfinite(x) for x in v)]
    width = max(map(len, (v for _, v in kept)), default=0)
    return [(i, [math.floor(1024 * x) + 100_000 for x in v] + [100_000] * (width - len(v))) for i, v in kept]


def check(df, rows, k):
    got = df.collect()
    assert df.columns == OUT
    held = integers(rows)
    x = np.array([v for _, v in held], object)
    n, sums = len(x), x.sum(axis=0)
    z = np.array([[float(Fraction(int(n * a - s), n)) for a, s in zip(row, sums)] for row in x])
    cov = z.T @ z / n
    values, turn = np.linalg.eigh(cov)
    values, turn = values[::-1][:k], turn[:, ::-1][:, :k]
    deviation = [sum(int(n * a - s) ** 2 for a, s in zip(row, sums)) for row in x]
    assert len(got) == n * k and {r["n"] for r in got} == {n}
    for c in range(k):
        part = sorted((r["vec_id"] if r["vec_id"] is not None else -1, int(r["deviation"]), r["whitened"]) for r in got if r["component"] == c + 1)
        want = sorted(zip([i if i is not None else -1 for i, _ in held], deviation, z @ turn[:, c] / math.sqrt(values[c])))
        assert [p[:2] for p in part] == [w[:2] for w in want]
        one, other = np.array([p[2] for p in part]), np.array([w[2] for w in want])
        assert min(np.abs(one - other).max(), np.abs(one + other).max()) < 1e-8
    assert {r["component"]: r["explained"] for r in got} == pytest.approx({c + 1: v / np.trace(cov) for c, v in enumerate(values)}, rel=1e-10)
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9


def drawn(seed, n, width, scale=0.3):
    draw = np.random.default_rng(seed)
    mixed = draw.normal(0, scale, (n, width)) * np.linspace(2, 1, width)
    return [(i, [float(v) for v in row], 0) for i, row in enumerate(mixed)]


@pytest.mark.parametrize(("n", "width", "k"), [(400, 24, 8), (300, 5, 5), (60, 40, 8)])
def test_against_dense_eigenvectors(docs, n, width, k):
    rows = drawn(n, n, width)
    check(whiten(docs(rows, VECTORS)), rows, k)


def test_edges(docs, spark):
    nan, inf = float("nan"), float("inf")
    rows = drawn(3, 60, 6)
    rows += [rows[0], rows[0], (None, [1.0, 2.0], 1), (7, [0.5] * 6, None), (100, None, 0), (101, [None] * 6, 0), (102, [nan] * 6, 0), (103, [inf] + [0.0] * 5, 0), (104, [], 0)]
    check(whiten(docs(rows, VECTORS)), rows, 6)
    assert whiten(docs([], VECTORS)).collect() == []
    assert whiten(docs([(1, None, 0)], VECTORS)).collect() == []


def test_components_without_variance(docs):
    assert whiten(docs([(1, [0.5, 1.0], 0)] * 3, VECTORS)).collect() == []
    rows = drawn(4, 4, 12)
    check(whiten(docs(rows, VECTORS)), rows, 3)


def test_huge_entries(docs):
    rows = [(i, [v * 1e30 if i == 3 else v for v in row], 0) for i, row, _ in drawn(5, 20, 4)]
    got = whiten(docs(rows, VECTORS), components=1).collect()
    n, far = 20, 1 << 53
    assert len(got) == 20 and got[0]["explained"] == pytest.approx(1)
    assert all(math.isfinite(r["whitened"]) for r in got)
    assert max(int(r["deviation"]) for r in got) == pytest.approx(4 * (n - 1) ** 2 * far**2, rel=1e-6)


def test_deviations_are_exact():
    draw = np.random.default_rng(0)
    for size, n in ((1000, 50), (1 << 40, 50), (1 << 53, 7)):
        rows = draw.integers(-size, size, (n, 9))
        sums = [int(s) for s in rows.astype(object).sum(axis=0)]
        want = [sum((n * int(x) - s) ** 2 for x, s in zip(row, sums)) for row in rows]
        assert Centred(n, sums).deviations(rows) == want


def test_minres_solves():
    draw = np.random.default_rng(1)
    turn = np.linalg.qr(draw.normal(size=(30, 30)))[0]
    a = (turn * np.linspace(1, 9, 30)) @ turn.T
    right, shifts = draw.normal(size=(30, 3)), np.array([0.0, 4.05, 12.0])
    got = minres(lambda b: a @ b, lambda b: b, shifts, right, 60, 1e-13)
    want = np.column_stack([np.linalg.solve(a - s * np.eye(30), right[:, k]) for k, s in enumerate(shifts)])
    assert np.abs(got - want).max() < 1e-8


@pytest.mark.parametrize("spectrum", ["flat", "close", "steep", "double", "zero"])
def test_jacobi_davidson_spectra(spectrum):
    width = 90
    values = {
        "flat": np.r_[5.0, np.ones(width - 1)],
        "close": np.linspace(1, 1.2, width),
        "steep": np.logspace(0, -9, width),
        "double": np.repeat(np.linspace(1, 4, width // 2), 2),
        "zero": np.zeros(width),
    }[spectrum]
    turn = np.linalg.qr(np.random.default_rng(2).normal(size=(width, width)))[0]
    a = (turn * values) @ turn.T
    got, vectors = jacobi_davidson(lambda b: a @ b, width, 8)
    assert np.abs(got - np.sort(values)[::-1][:8]).max() < 1e-12
    assert np.linalg.norm(a @ vectors - vectors * got, axis=0).max() < 1e-12
    assert np.abs(vectors.T @ vectors - np.eye(8)).max() < 1e-12


def test_orthonormal_leaves_dependent_columns_out():
    block = np.array([[1.0, 2.0, 0.0], [0.0, 0.0, 0.0], [0.0, 0.0, 3.0]])
    assert orthonormal(block).shape == (3, 2)
    assert orthonormal(block, np.eye(3)[:, :1]).shape == (3, 1)


def test_blocks_change_nothing(docs, monkeypatch):
    monkeypatch.setattr(whitening, "_CHUNK", 50)
    rows = drawn(6, 150, 10)
    check(whiten(docs(rows, VECTORS)), rows, 8)


def test_query_on_the_given_table(spark, sf_dir):
    from kpiloom.llm.queries import QUERIES

    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    df = QUERIES["op11_embedding_whitening"](spark, sf_dir)
    assert dict(df.dtypes)["deviation"] == "bigint"
    check(df, rows, 8)
