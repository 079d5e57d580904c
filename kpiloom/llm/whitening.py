"""Embedding whitening by a block Jacobi-Davidson method.

The covariance is never formed: each step multiplies it with a few vectors in
one pass over the rows, which are centred exactly before they are multiplied.
The driver holds a basis of at most ``BASIS`` vectors per component, each of the
embedding's width.

A Rayleigh-Ritz step on the basis gives the approximate components. For each
that is not yet exact, the correction equation, projected off all approximate
and locked components, is solved by some steps of MINRES; all equations share
the passes. The corrections extend the basis. Components are locked from the
largest eigenvalue on, when their residual is at the rounding error of a pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiloom.llm.common import written

#: An entry c becomes floor(STEPS * c) + OFFSET.
STEPS = 1024
OFFSET = 100_000

#: Entries beyond count as this large.
LARGEST = float(1 << 53)

#: Vectors in the basis for each wanted component, and those kept at a restart.
BASIS = 6
KEPT = 3

#: Steps of MINRES for one correction, and the share of the residual that ends them.
INNER = 3
SHARE = 0.05

#: Extensions of the basis, at most.
OUTER = 300

#: Residual that counts as rounding, in units of eps, the largest eigenvalue and
#: the square root of the width.
PRECISION = 8

#: Entries of rows that are multiplied at once.
_CHUNK = 1 << 19

Product = Callable[[np.ndarray], np.ndarray]


def quantised(vector: Column) -> Column:
    """The vector's longs; null for a vector that is null or holds null, NaN or
    infinite entries."""
    c = vector.cast("array<double>")
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    steps = F.transform(c, lambda x: F.floor(F.greatest(F.least(x * STEPS, F.lit(LARGEST)), F.lit(-LARGEST))) + OFFSET)
    return F.when(~bad, steps)


def _matrices(batch: pa.RecordBatch, column: int, width: int) -> Iterator[np.ndarray]:
    """Rows of longs; entries that a shorter row lacks are those of zero."""
    lists = batch.column(column)
    rows = max(1, _CHUNK // max(width, 1))
    for at in range(0, len(lists), rows):
        part = lists.slice(at, rows)
        sizes = np.diff(part.offsets.to_numpy())
        out = np.full((len(part), width), OFFSET, np.int64)
        out[np.arange(width)[None, :] < sizes[:, None]] = part.flatten().to_numpy()
        yield out


class Centred:
    """Integer rows about their mean: exact integer distances from the mean
    rounded down, less its fraction."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums, self.width = n, sums, len(sums)
        self.whole = np.array([s // n for s in sums], np.int64)
        self.part = np.array([s % n / n for s in sums])

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        return (rows - self.whole) - self.part

    def deviations(self, rows: np.ndarray) -> list[int]:
        """Exact sum of (n x - S) ** 2 per row."""
        far = rows - self.whole
        most = (int(np.abs(far).max(initial=0)) + 1) * self.n
        rest = np.array([s % self.n for s in self.sums], object if self.width * most**2 >= 1 << 63 else np.int64)
        exact = far.astype(rest.dtype) * self.n - rest
        return [int(v) for v in (exact * exact).sum(axis=1)]


def column_sums(held: DataFrame) -> tuple[int, list[int]]:
    """Rows and exact sum of each entry of ``x``, in two halves of 32 bits."""
    width = held.agg(F.max(F.size("x"))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(width, np.int64), np.zeros(width, np.int64)
        for batch in batches:
            for rows in _matrices(batch, 0, width):
                n += len(rows)
                high += (rows >> 32).sum(axis=0)
                low += (rows & 0xFFFFFFFF).sum(axis=0)
        size = np.full(width, n, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (np.arange(width), size, high, low)], names=["at", "n", "high", "low"])

    parts = held.select("x").mapInArrow(run, "at long, n long, high long, low long")
    exact = {c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "high", "low")}
    total = parts.groupBy("at").agg(*exact.values()).orderBy("at").collect()
    return (int(total[0]["n"]) if total else 0), [(int(r["high"]) << 32) + int(r["low"]) for r in total]


def summed(held: DataFrame, centred: Centred, each: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """Sum of ``each`` (a matrix of ``shape``) over blocks of centred rows: a
    matrix per task, added by row, so that the driver gets one."""
    height, width = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for rows in _matrices(batch, 0, centred.width):
                total += each(centred(rows))
        columns = [pa.array(np.arange(height))] + [pa.array(np.ascontiguousarray(c)) for c in total.T]
        yield pa.RecordBatch.from_arrays(columns, names=["at", *names])

    names = [f"c{k}" for k in range(width)]
    parts = held.select("x").mapInArrow(run, ", ".join(["at long", *[f"{c} double" for c in names]]))
    rows = parts.groupBy("at").agg(*[F.sum(c).alias(c) for c in names]).collect()
    return np.array([r[1:] for r in sorted(rows)]).reshape(shape)


def orthonormal(block: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """Orthonormal columns of ``block`` off those of ``against``; columns that
    depend on others are left out."""
    out = np.zeros((len(block), 0))
    for column in block.T:
        size = np.linalg.norm(column)
        for _ in range(3):
            for basis in (*against, out):
                column = column - basis @ (basis.T @ column)
        if np.linalg.norm(column) > 1e-10 * size > 0:
            out = np.column_stack([out, column / np.linalg.norm(column)])
    return out


def minres(product: Product, project: Callable[[np.ndarray], np.ndarray], shifts: np.ndarray, right: np.ndarray, steps: int, share: float) -> np.ndarray:
    """For each column an approximate solution t of P (A - shift) P t = right by
    MINRES: the Lanczos recurrence and one plane rotation per step. Columns
    whose residual is down to ``share`` of the first leave the products."""
    answer = np.zeros_like(right)
    first = np.linalg.norm(right, axis=0)
    at = np.flatnonzero(first > 0)
    v = right[:, at] / first[at]
    old_v, w, old_w = np.zeros_like(v), np.zeros_like(v), np.zeros_like(v)
    beta, rest = np.zeros(len(at)), first[at].copy()
    c, old_c, s, old_s = np.ones(len(at)), np.ones(len(at)), np.zeros(len(at)), np.zeros(len(at))
    for _ in range(steps):
        if not len(at):
            break
        u = project(product(v) - v * shifts[at]) - old_v * beta
        alpha = (u * v).sum(axis=0)
        u = u - v * alpha
        u = project(u - v * (u * v).sum(axis=0))
        next_beta = np.linalg.norm(u, axis=0)
        # the new column of the tridiagonal matrix, turned by the last two rotations
        top, middle = old_s * beta, old_c * beta
        diagonal, below = c * middle + s * alpha, c * alpha - s * middle
        size = np.hypot(below, next_beta)
        known = size > 0
        new_c, new_s = np.where(known, below / np.where(known, size, 1), 1.0), np.where(known, next_beta / np.where(known, size, 1), 0.0)
        new_w = np.where(known, (v - w * diagonal - old_w * top) / np.where(known, size, 1), 0.0)
        answer[:, at] += new_w * (new_c * rest)
        rest = -new_s * rest
        go = known & (np.abs(rest) > share * first[at]) & (next_beta > 1e-14 * np.abs(shifts[at]))
        old_v, v = v[:, go], (u / np.where(next_beta > 0, next_beta, 1))[:, go]
        old_w, w = w[:, go], new_w[:, go]
        old_c, c, old_s, s = c[go], new_c[go], s[go], new_s[go]
        beta, rest, at = next_beta[go], rest[go], at[go]
    return answer


def jacobi_davidson(product: Product, width: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a symmetric matrix of nonnegative
    eigenvalues, falling, and their unit vectors as columns."""
    wanted = min(wanted, width)
    most = min(width, max(BASIS * wanted, 16))
    draw = np.random.default_rng(42)
    basis = orthonormal(draw.normal(size=(width, min(most, 2 * wanted))))
    images = product(basis)
    locked, values = np.zeros((width, 0)), []
    for _ in range(OUTER):
        left = wanted - len(values)
        inner = basis.T @ images
        ritz, turn = np.linalg.eigh((inner + inner.T) / 2)
        ritz, turn = ritz[::-1], turn[:, ::-1]
        basis, images = basis @ turn, images @ turn
        scale = max([*values, ritz[0]])
        limit = PRECISION * np.finfo(float).eps * np.sqrt(width) * scale
        residuals = images[:, :left] - basis[:, :left] * ritz[:left]
        residuals -= locked @ (locked.T @ residuals)
        exact = np.linalg.norm(residuals, axis=0) <= limit
        done = left if exact.all() else int(np.argmin(exact))
        if done:
            locked = np.column_stack([locked, basis[:, :done]])
            values += ritz[:done].tolist()
            basis, images, ritz, residuals = basis[:, done:], images[:, done:], ritz[done:], residuals[:, done:]
            left -= done
        if not left:
            order = np.argsort(values)[::-1]
            return np.array(values)[order], locked[:, order]
        approximate = basis[:, :left]

        def project(block: np.ndarray) -> np.ndarray:
            for known in (locked, approximate, locked, approximate):
                block = block - known @ (known.T @ block)
            return block

        todo = np.linalg.norm(residuals, axis=0) > limit
        corrections = minres(product, project, ritz[:left][todo], project(-residuals[:, todo]), INNER, SHARE)
        if basis.shape[1] + corrections.shape[1] + len(values) > most:
            keep = max(left, min(KEPT * wanted, most - corrections.shape[1] - len(values)))
            basis, images = basis[:, :keep], images[:, :keep]
        more = orthonormal(corrections, locked, basis)
        if not more.shape[1]:  # the corrections lie in the basis: go on with another direction
            more = orthonormal(draw.normal(size=(width, 1)), locked, basis)
        if more.shape[1]:
            image = product(more)
            basis, images = np.column_stack([basis, more]), np.column_stack([images, image - locked @ (locked.T @ image)])
        else:  # the basis is the whole space
            images = product(basis)
            images -= locked @ (locked.T @ images)
    raise ArithmeticError(f"{wanted - len(values)} components are not exact after {OUTER} extensions")


def whiten(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = 8) -> DataFrame:
    """For each vector that takes part and each of the largest ``components``
    principal components: the id, ``component`` (from 1, by falling eigenvalue),
    ``n`` vectors, ``deviation`` (exact sum of (n x - S) ** 2, a decimal),
    ``whitened`` (score over the component's standard deviation), ``explained``
    (share of the total variance) and ``identity_error`` (largest absolute entry
    of the scores' covariance less the identity).

    An entry c counts as the integer x = floor(1024 c) + 100000, entries beyond
    2 ** 53 steps as that large; S are the sums. A deviation of more than 38
    digits is null. Vectors that are null or hold null or non-finite entries take
    no part; a shorter vector counts as filled with zeros. Null and repeated ids and repeated rows take part as they are.
    A component of no variance (equal vectors, fewer vectors than components) is
    left out. An empty table gives an empty result; other columns are not read.
    """
    source = vectors.select(F.col(f"`{id}`").alias("id"), quantised(F.col(f"`{vector}`")).alias("x"))
    held = written(source.where("x is not null and size(x) > 0"), "integer-vectors")
    kind = source.schema["id"].dataType.simpleString()
    out = f"id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    n, sums = column_sums(held)
    if not n:
        return vectors.sparkSession.createDataFrame([], out).withColumnRenamed("id", id)
    centred = Centred(n, sums)
    trace = float(summed(held, centred, lambda z: np.array([[(z * z).sum()]]), (1, 1))[0, 0]) / n

    def product(block: np.ndarray) -> np.ndarray:
        return summed(held, centred, lambda z: z.T @ (z @ block), block.shape) / n

    values, turn = jacobi_davidson(product, centred.width, components)
    real = values > centred.width * np.finfo(float).eps * trace
    values, turn = values[real], turn[:, real]
    scale = turn / np.sqrt(values)
    k = len(values)
    if k:
        moments = summed(held, centred, lambda z: np.vstack([(z @ scale).T @ (z @ scale), (z @ scale).sum(axis=0)]), (k + 1, k)) / n
        error = float(np.abs(moments[:k] - np.outer(moments[k], moments[k]) - np.eye(k)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for rows in _matrices(batch, 1, centred.width):
                size = len(rows)
                spread = pa.array([Decimal(v) if v < 10**38 else None for v in centred.deviations(rows)], pa.decimal128(38, 0))
                each = pa.array(np.repeat(np.arange(size), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, size).take(each),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)),
                        pa.array(np.full(size * k, n)),
                        spread.take(each),
                        pa.array((centred(rows) @ scale).ravel()),
                        pa.array(np.tile(values / trace, size)),
                        pa.array(np.full(size * k, error)),
                    ],
                    names=[f.split()[0] for f in out.split(", ")],
                )
                at += size

    if not k:
        return vectors.sparkSession.createDataFrame([], out).withColumnRenamed("id", id)
    return held.mapInArrow(run, out).withColumnRenamed("id", id)
