"""Quality classifier: a factorisation machine over hashed words, structure
statistics and metadata.

The score is the logistic of w0 + sum w_i x_i + sum over factors of
((sum v_i x_i)^2 - sum (v_i x_i)^2) / 2, linear in the text's length. It is
fitted on a bounded sample of labelled rows in one task, and applied to whole
texts in all partitions.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, FloatType, IntegerType, StructField, StructType

from kpiloom.llm.common import filled, whole_digest

#: Labelled rows that the fit reads at most; a documented bound.
FIT_ROWS = 12_000

#: Hashed words have so many weights, each statistic so many steps.
WORD_BITS = 14
STEPS = 10

RANK = 4

#: Passes over the rows; more where they make fewer updates than these.
EPOCHS = 8
BATCH = 256
UPDATES = 240
RATE = 0.05
DECAY = 1e-4

#: Words in a window whose statistics are taken apart from the text's.
WINDOW = 64

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = bytes(range(48, 58))
_STOP = b".,;:?'\"-()"
_MARK = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in _STOP)


def _share(raw: bytes, kinds: bytes) -> float:
    return (len(raw) - len(raw.translate(None, kinds))) / len(raw) if raw else 0.0


def statistics(text: str, n_chars: int | None) -> list[float]:
    """Structure of the whole text, and its recorded length."""
    raw = text.encode("utf-8", "replace")
    words = text.split()
    n = len(words) or 1
    counts = Counter(words)
    repeats = np.fromiter(map(eq, words, words[1:]), np.float64, max(len(words) - 1, 0))
    bare = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    plain = np.fromiter(map(str.isalnum, words), np.float64, len(words))
    upper = np.fromiter(map(str.isupper, words), np.float64, len(words))
    worst = [
        max((float(v[k : k + WINDOW].sum()) / WINDOW for k in range(0, len(v), WINDOW)), default=0.0) if turn > 0
        else 1 - min((float(v[k : k + WINDOW].mean()) for k in range(0, len(v), WINDOW)), default=1.0)
        for v, turn in ((repeats, 1), (upper, 1), (plain, -1))
    ]
    lines = text.split("\n")
    return [
        float(np.log1p(len(raw))),
        float(np.log1p(n_chars)) if n_chars is not None and n_chars >= 0 else -1.0,
        float(len(counts)) / n,
        max(counts.values(), default=0) / n,
        float(repeats.mean()) if len(repeats) else 0.0,
        float(upper.mean()) if words else 0.0,
        float(plain.mean()) if words else 0.0,
        float(bare.mean()),
        float(bare.std()),
        _share(raw, _UPPER),
        _share(raw, _LOWER),
        _share(raw, _DIGIT),
        _share(raw, _STOP),
        _share(raw, _MARK),
        len(set(lines)) / len(lines),
        float(np.log1p(len(words) / len(lines))),
        *worst,
    ]


def hashed_words(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the lower-cased words and their damped counts, of length 1."""
    counts = Counter(text.lower().split())
    mask = (1 << WORD_BITS) - 1
    at = np.fromiter((crc32(w.encode("utf-8", "replace")) & mask for w in counts), np.int64, len(counts))
    value = 1 + np.log(np.fromiter(counts.values(), np.float64, len(counts)))
    return at, value / max(np.sqrt((value**2).sum()), 1e-9)


class Machine:
    """Factorisation machine with the steps of its statistics."""

    def __init__(self, cuts: np.ndarray, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.cuts, self.bias, self.weights, self.factors = cuts, bias, weights, factors

    def vector(self, words_at: np.ndarray, words: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        step = (stats[:, None] > self.cuts).sum(axis=1)
        at = (1 << WORD_BITS) + np.arange(len(stats)) * STEPS + step
        return np.concatenate([words_at, at]), np.concatenate([words, np.full(len(stats), 0.5)])

    def score(self, at: np.ndarray, value: np.ndarray) -> float:
        inner = self.factors[at] * value[:, None]
        total = self.bias + self.weights[at] @ value + 0.5 * ((inner.sum(axis=0) ** 2).sum() - (inner**2).sum())
        return float(1 / (1 + np.exp(-np.clip(total, -60, 60))))

    def packed(self) -> tuple[bytes, bytes, float, bytes]:
        return self.cuts.tobytes(), self.weights.tobytes(), float(self.bias), self.factors.tobytes()

    @classmethod
    def unpacked(cls, cuts: bytes, weights: bytes, bias: float, factors: bytes) -> Machine:
        return cls(
            np.frombuffer(cuts).reshape(-1, STEPS - 1), bias, np.frombuffer(weights), np.frombuffer(factors).reshape(-1, RANK)
        )


def fit_machine(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]) -> Machine:
    """Fit by Adam on the logistic loss; rows hold word buckets, word values,
    statistics and the label. One class only, or no rows: a constant score."""
    n_stats = len(statistics("", None))
    stats = np.array([r[2] for r in rows]).reshape(len(rows), n_stats)
    labels = np.array([r[3] for r in rows], np.float64)
    cuts = np.quantile(stats, np.arange(1, STEPS) / STEPS, axis=0).T if len(rows) else np.zeros((n_stats, STEPS - 1))
    size = (1 << WORD_BITS) + n_stats * STEPS
    draw = np.random.default_rng(7)
    rate = float(np.clip((labels.sum() + 0.5) / (len(labels) + 1), 0.01, 0.99))
    params = [np.array([np.log(rate / (1 - rate))]), np.zeros(size), draw.normal(0, 0.05, (size, RANK))]
    machine = Machine(np.ascontiguousarray(cuts), 0.0, params[1], params[2])
    if not 0 < labels.sum() < len(labels):
        machine.bias, machine.factors = float(params[0][0]), np.zeros((size, RANK))
        return machine
    vectors = [machine.vector(*r[:3]) for r in rows]
    first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(max(EPOCHS, -(-UPDATES * BATCH // len(rows)))):
        order = draw.permutation(len(rows))
        for k in range(0, len(order), BATCH):
            part = order[k : k + BATCH]
            sizes = np.array([len(vectors[i][0]) for i in part])
            at = np.concatenate([vectors[i][0] for i in part])
            x = np.concatenate([vectors[i][1] for i in part])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            row = np.repeat(np.arange(len(part)), sizes)
            inner = params[2][at] * x[:, None]
            sums = np.add.reduceat(inner, starts, axis=0)
            z = params[0][0] + np.add.reduceat(params[1][at] * x, starts)
            z += 0.5 * ((sums**2).sum(axis=1) - np.add.reduceat((inner**2).sum(axis=1), starts))
            g = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - labels[part]) / len(part)
            gx = g[row] * x
            used, place = np.unique(at, return_inverse=True)
            grad_w = np.bincount(place, gx, len(used)) + DECAY * params[1][used]
            pull = gx[:, None] * (sums[row] - inner)
            grad_v = np.stack([np.bincount(place, pull[:, f], len(used)) for f in range(RANK)], axis=1)
            grad_v += DECAY * params[2][used]
            t += 1
            for j, (rows_, grad) in enumerate(((slice(None), np.array([g.sum()])), (used, grad_w), (used, grad_v))):
                first[j][rows_] = 0.9 * first[j][rows_] + 0.1 * grad
                second[j][rows_] = 0.999 * second[j][rows_] + 0.001 * grad**2
                step = RATE * (first[j][rows_] / (1 - 0.9**t)) / (np.sqrt(second[j][rows_] / (1 - 0.999**t)) + 1e-8)
                params[j][rows_] -= step
    machine.bias, machine.weights, machine.factors = float(params[0][0]), params[1], params[2]
    return machine


def held_out(id: Column) -> Column:
    """Rows whose labels are never learned from; false for a null id."""
    return F.coalesce(F.crc32(id.cast("string")) % 5 == 0, F.lit(False))


def _features(docs: DataFrame) -> DataFrame:
    """``docs`` has text, n_chars, label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, n, label in zip(*(c.to_pylist() for c in batch.columns)):
                at, value = hashed_words(text or "")
                out.append((at.tolist(), value.tolist(), statistics(text or "", n), label))
            columns = list(zip(*out)) if out else [()] * 4
            types = [pa.list_(pa.int32()), pa.list_(pa.float32()), pa.list_(pa.float64()), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=["at", "words", "stats", "label"])

    schema = StructType(
        [
            StructField("at", ArrayType(IntegerType())),
            StructField("words", ArrayType(FloatType())),
            StructField("stats", ArrayType(DoubleType())),
            StructField("label", IntegerType()),
        ]
    )
    return docs.mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, id: str, text: str, n_chars: str | None, label: str, fit_rows: int = FIT_ROWS) -> Machine:
    """The machine fitted on at most ``fit_rows`` labelled ids that are not held
    out, chosen by a hash of the id. Of the rows that share an id, that with the
    smallest digest of its text, then the smallest recorded length, is learned."""
    known = (
        labels.select(F.col(f"`{id}`").alias("id"), F.col(f"`{label}`").cast("int").alias("label"))
        .where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("id")))
        .groupBy("id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(fit_rows)
    )
    body = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"), _length(docs, n_chars))
    one = F.min(F.struct(whole_digest(filled("text")).alias("digest"), "n_chars", "text")).alias("row")
    chosen = body.join(F.broadcast(known), "id").groupBy("id", "label").agg(one).select("row.*", "label")  # ``fit_rows`` ids
    schema = StructType(
        [StructField(n, BinaryType()) for n in ("cuts", "weights")] + [StructField("bias", DoubleType()), StructField("factors", BinaryType())]
    )

    def train(part: pa.Table) -> pa.Table:
        rows = [
            (np.array(at, np.int64), np.array(words, np.float64), np.array(stats), y)
            for at, words, stats, y in zip(*(part[c].to_pylist() for c in ("at", "words", "stats", "label")))
        ]
        rows.sort(key=lambda r: (r[3], len(r[0]), r[0].tolist(), r[1].tolist(), r[2].tolist()))
        cuts, weights, bias, factors = fit_machine(rows).packed()
        return pa.table({"cuts": [cuts], "weights": [weights], "bias": [bias], "factors": [factors]})

    found = _features(chosen.select("text", "n_chars", "label")).withColumn("all", F.lit(0)).groupBy("all").applyInArrow(train, schema).first()
    return Machine.unpacked(*found) if found else fit_machine([])


def _length(docs: DataFrame, n_chars: str | None) -> Column:
    have = n_chars is not None and n_chars in docs.columns
    return (F.col(f"`{n_chars}`").cast("long") if have else F.lit(None).cast("long")).alias("n_chars")


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    n_chars: str | None = "n_chars",
    label: str = "quality",
    threshold: float = 0.3,
    train_docs: DataFrame | None = None,
    fit_rows: int = FIT_ROWS,
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row per row of ``docs``: its id, ``held_out``, ``score`` (0 to 1),
    ``predicted`` (1 from ``threshold`` on), and the columns named in ``carry``.

    Labels come from rows that are not held out, and texts for them from
    ``train_docs`` (``docs`` when None). Null texts score as empty ones, and
    repeated rows alike; a null recorded length is a step of its own. Without
    labels of both kinds all rows get one score. Ids, languages, sources and
    labels are no inputs of the score; other columns are not read.
    """
    machine = fit(train_docs if train_docs is not None else docs, labels, id, text, n_chars, label, fit_rows)
    held = docs.sparkSession.sparkContext.broadcast(machine.packed())

    source = docs.select(
        F.col(f"`{id}`").alias("id"),
        held_out(F.col(f"`{id}`")).alias("held_out"),
        F.col(f"`{text}`").alias("text"),
        _length(docs, n_chars),
        *[F.col(f"`{c}`").alias(f"carried_{i}") for i, c in enumerate(carry)],
    )
    out = StructType([source.schema["id"], source.schema["held_out"], StructField("score", DoubleType()), *source.schema.fields[4:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Machine.unpacked(*held.value)
        for batch in batches:
            scores = []
            for body, n in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                at, value = hashed_words(body or "")
                scores.append(model.score(*model.vector(at, value, np.array(statistics(body or "", n)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), *batch.columns[4:]], names=out.names)

    scored = source.mapInArrow(run, out)
    carried = [F.col(f"carried_{i}").alias(c) for i, c in enumerate(carry)]
    return scored.select(F.col("id").alias(id), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *carried)
