"""Exact top-k search on an impact-ordered index, score at a time.

Vectors are dealt into blocks. Each block has an index of its own: for every
component a posting list, cut into segments by the quantised size of its
entries (its impact). A task answers the queries on one block in batches: it takes
the segments of all components by descending impact and adds query times
quantised impact to the vectors' scores. After each impact, what a score can
still change by is bounded by the norms of the query and of the vector's rest
(Cauchy and Schwarz). Work on a block stops only when that proves all but a few
vectors out of the query's best k; those few are rescored exactly. The best k of
all blocks are merged by query.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiloom.llm.common import written

#: Vectors in a block of the index on average, and queries answered together.
BLOCK = 8192
QUERIES = 512

#: Quantised components beyond count as this large.
LARGEST = 1 << 53

#: Quantised impacts of a block.
LEVELS = 64

#: Work stops when at most this share of a block's vectors may be members.
RESCORE = 0.02


def quantised(vector: Column) -> Column:
    """floor(256 x) of every component, at most ``LARGEST`` either way; null for
    a vector that takes no part."""
    most = F.lit(float(LARGEST))
    whole = F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * 256, most), -most)))
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(vector.isNotNull() & sound, whole)


class ImpactIndex:
    """Impact-ordered postings of one block of integer vectors."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        size = np.abs(vectors)
        self.width = max(1, -(-int(size.max(initial=0) + 1) // LEVELS))
        level = size // self.width
        self.segments: list[list[tuple[int, np.ndarray, np.ndarray]]] = []
        rest = vectors.astype(np.float64)
        self.rest = [np.sqrt((rest**2).sum(axis=1))]
        for impact in range(int(level.max(initial=0)), 0, -1):
            held = []
            for d in range(vectors.shape[1]):
                at = np.flatnonzero(level[:, d] == impact)
                if len(at):
                    weight = np.sign(vectors[at, d]) * (impact * self.width)
                    held.append((d, at, weight.astype(np.float64)))
                    rest[at, d] -= weight
            self.segments.append(held)
            self.rest.append(np.sqrt((rest**2).sum(axis=1)))

    def candidates(self, queries: np.ndarray, k: int, own: np.ndarray | None = None) -> np.ndarray:
        """Vectors (rows) by queries (columns) that may be among the best k.

        ``queries`` are columns of whole numbers; the bounds allow for the
        rounding of their sums in double. ``own`` marks the pairs that take no part, however many: they
        neither count among the k nor raise the bound."""
        n = len(self.vectors)
        score = np.zeros((n, queries.shape[1]))
        norm = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=0))
        rounding = self.rest[0] * (4 * (self.vectors.shape[1] + len(self.segments)) * np.finfo(float).eps)
        weights = queries.astype(np.float64)
        others = np.ones(score.shape, bool) if own is None else ~own
        if n <= k:
            return others
        may = others
        looked = np.inf
        for left, held in zip(range(len(self.segments) - 1, -1, -1), self.segments):
            for d, at, weight in held:
                score[at] += weight[:, None] * weights[d][None, :]
            rest = self.rest[len(self.segments) - left]
            if left and np.median(rest) > 0.7 * looked:  # too little changed for another look
                continue
            looked = np.median(rest)
            slack = np.outer(rest + rounding, norm) * (1 + 1e-9) + 1e-6
            proven = np.partition(np.where(others, score - slack, -np.inf), n - k, axis=0)[n - k]
            may = others & (score + slack >= proven)
            if may.sum() <= max(RESCORE * may.size, 8 * k * queries.shape[1]):
                break
        return may

    def best(self, queries: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> list[tuple[int, int, int]]:
        """Query column, id and exact score of each query's best k but its own id."""
        out = []
        for q, may in enumerate(self.candidates(queries, k, ids[:, None] == own[None, :]).T):
            at = np.flatnonzero(may)
            exact = _products(self.vectors[at], queries[:, q])
            for i in sorted(range(len(at)), key=lambda i: (-exact[i], ids[at[i]]))[:k]:
                out.append((q, int(ids[at[i]]), exact[i]))
        return out


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), np.int64)
    sizes = np.diff(column.offsets.to_numpy())
    out[np.arange(width)[None, :] < sizes[:, None]] = column.flatten().to_numpy()
    return out


def _products(vectors: np.ndarray, query: np.ndarray) -> list[int]:
    """Exact inner products of integer rows, beyond 64 bits where they are."""
    sizes = [int(np.abs(v).max(initial=0)) for v in (vectors, query)]
    if sizes[0] * sizes[1] * max(1, len(query)) >= 1 << 63:
        vectors, query = vectors.astype(object), query.astype(object)
    return [int(v) for v in vectors @ query]


def block_of(blocks: int) -> Column:
    """Block of a row, repeated rows dealt out by their number ``nth``."""
    return F.pmod(F.xxhash64("id", "nth"), F.lit(blocks)).cast("int").alias("block")


def top_k(vectors: DataFrame, queries: DataFrame, id: str = "vec_id", vector: str = "embedding", k: int = 5) -> DataFrame:
    """The ``k`` highest integer inner products of every row of ``queries`` with
    the rows of ``vectors``: ``query_id``, ``rank`` (from 1), the candidate's id,
    ``score``; ties go to the smaller id.

    Components become floor(256 x), those beyond 2**53 count as that large.
    Ranks are by the exact product; ``score`` is the end of the long range where
    the product exceeds it. Rows with a null id, a null vector, or null
    or non-finite components take no part. A shorter vector counts as filled
    with zeros. Rows with the query's id are its own and no candidates; a
    repeated query row is answered once, and a repeated candidate row counts as
    often as it occurs. Fewer than ``k`` candidates give all. Empty tables give
    an empty result; other columns are not read.
    """

    def sound(rows: DataFrame) -> DataFrame:
        return rows.select(F.col(f"`{id}`").cast("long").alias("id"), quantised(F.col(f"`{vector}`")).alias("v")).where("id is not null and v is not null")

    held = written(sound(vectors).withColumn("nth", F.monotonically_increasing_id()), "vectors")  # deals repeated rows out
    asked = written(sound(queries).distinct(), "queries")
    n = held.agg(F.count("*"), F.max(F.size("v"))).first()
    width = max(n[1] or 0, asked.agg(F.max(F.size("v"))).first()[0] or 0, 1)
    blocks = max(1, -(-n[0] // BLOCK))
    names = ["query_id", "id", "score"]

    def answer(index: ImpactIndex, ids: np.ndarray, own: np.ndarray, asked_: np.ndarray) -> pa.RecordBatch:
        out: list[tuple[int, int, int]] = []
        for at in range(0, len(own), QUERIES):
            part = slice(at, at + QUERIES)
            out += [(int(own[at + q]), i, s) for q, i, s in index.best(asked_[part].T, ids, own[part], k)]
        columns = list(zip(*out)) if out else [()] * 3
        scores = pa.array([Decimal(s) for s in columns[2]], pa.decimal128(38, 0))
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns[:2]] + [scores], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's vectors come before the queries: its index is built once,
        and the queries stream past it."""
        block, ids, vectors, index = None, [], [], None
        for batch in batches:
            number, query = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((np.diff(number) != 0) | (np.diff(query) != 0)) + 1
            for low, high in zip([0, *edges.tolist()], [*edges.tolist(), len(number)]):
                if low == high:
                    continue
                if number[low] != block:
                    block, ids, vectors, index = number[low], [], [], None
                part = batch.slice(low, high - low)
                own, rows = part.column(2).to_numpy(), _matrix(part.column(3), width)
                if not query[low]:
                    ids.append(own)
                    vectors.append(rows)
                elif ids:
                    index = index or ImpactIndex(np.concatenate(vectors))
                    yield answer(index, np.concatenate(ids), own, rows)

    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    rows = held.select(block_of(blocks), F.lit(False).alias("query"), "id", "v").unionByName(asked.select(every, F.lit(True).alias("query"), "id", "v"))
    found = rows.repartition(blocks, "block").sortWithinPartitions("block", "query").mapInArrow(run, "query_id long, id long, score decimal(38,0)")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    ends = [F.lit(e).cast("decimal(38,0)") for e in (-(1 << 63), (1 << 63) - 1)]
    score = F.greatest(F.least("score", ends[1]), ends[0]).cast("long").alias("score")
    return ranked.select("query_id", "rank", F.col("id").alias(id), score)
