"""Best-fit packing of tokenised documents into sequences.

Only lengths decide a packing, and there are at most ``capacity`` of them. So
the driver packs counts per length: bins of one content are one pattern with a
multiplicity. Lengths above a third of the capacity pair at most twice per bin,
the largest with the largest that fits; shorter ones fill the tightest gap that
holds them, longest first. The pieces then find their place by their rank among
the pieces of their length, counted in buckets, so that no length gathers in one
task.
"""

from __future__ import annotations

import json
from bisect import bisect_left, insort
from collections.abc import Iterator, Mapping
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from kpiloom.llm.common import written
from kpiloom.llm.tokens import byte_alphabet

#: Pieces of a length are ranked in so many buckets.
BUCKETS = 1024

#: The pre-token rule of the byte-level vocabulary files.
BYTE_PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteEncoder:
    """Ids of texts under a byte-level BPE file, as the tokenizers library gives
    them. When the file's merges are in the order of their ids, which is checked,
    the same vocabulary runs as ranks; other files, and texts with special
    strings, go to the library."""

    def __init__(self, spec: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        parts = json.loads(spec)
        self.special = [t["content"] for t in parts["added_tokens"]]
        alphabet, model = byte_alphabet(), parts["model"]
        ranks = {bytes(alphabet[c] for c in t): i for t, i in model["vocab"].items() if t not in self.special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [model["vocab"][a + b] for a, b in merges]
        pre = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        self.same = made == sorted(made) and len(ranks) == len(made) + 256 and parts["pre_tokenizer"] == pre and not parts["normalizer"]
        self.ranks = tiktoken.Encoding("ranks", pat_str=BYTE_PRE_TOKEN, mergeable_ranks=ranks, special_tokens={}) if self.same else None

    def ids(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.ranks is None or any(s in text for s in self.special):
            return self.library.encode(text, add_special_tokens=False).ids
        return self.ranks.encode_ordinary(text)


_ENCODERS: dict[int, ByteEncoder] = {}


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces; all but the first are full."""
    first = (length - 1) % capacity + 1
    return [(0, first), *((s, capacity) for s in range(first, length, capacity))]


def pieces(docs: DataFrame, spec: str, capacity: int, id: str, text: str, end: int) -> DataFrame:
    """Pieces of every document's whole text with the id ``end`` behind it."""
    key = hash(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _ENCODERS:
            _ENCODERS[key] = ByteEncoder(spec)
        encoder = _ENCODERS[key]
        for batch in batches:
            row, out = [], []
            for i, body in enumerate(batch.column(1)):
                ids = np.array([*encoder.ids(body.as_py()), end], "<u4")
                for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                    row.append(i)
                    out.append((piece, start, length, crc32(ids[start : start + length].tobytes())))
            columns = list(zip(*out)) if out else [()] * 4
            made = [pa.array(list(c), t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int32())), *made], names=["id", "piece", "start", "length", "ids_crc32"])

    source = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    schema = StructType(
        [source.schema["id"], StructField("piece", IntegerType())]
        + [StructField(n, LongType()) for n in ("start", "length", "ids_crc32")]
    )
    return source.mapInArrow(run, schema)


class Pattern(NamedTuple):
    """``bins`` sequences that hold, from the front, runs of pieces of one length."""

    bins: int
    runs: tuple[tuple[int, int], ...]


def pack_counts(counts: Mapping[int, int], capacity: int) -> list[Pattern]:
    """Patterns that hold ``counts[length]`` pieces of each length.

    The work depends on the distinct lengths alone: taking a length either uses
    a pattern up or ends with that length.
    """
    left = {k: v for k, v in counts.items() if v}
    third = capacity / 3
    large = sorted(k for k in left if k > third)
    patterns: list[Pattern] = []
    while large:
        a = large[-1]
        fit = bisect_left(large, capacity - a + 1) - 1
        if fit < 0:
            patterns.append(Pattern(left[a], ((a, 1),)))
            left[a] = 0
        elif large[fit] == a:
            if left[a] > 1:
                patterns.append(Pattern(left[a] // 2, ((a, 2),)))
            left[a] %= 2
            if left[a]:
                below = large[fit - 1] if fit else None
                patterns.append(Pattern(1, ((a, 1), (below, 1)) if below else ((a, 1),)))
                left[a] = 0
                if below:
                    left[below] -= 1
        else:
            b = large[fit]
            n = min(left[a], left[b])
            patterns.append(Pattern(n, ((a, 1), (b, 1))))
            left[a] -= n
            left[b] -= n
        large = [k for k in large if left[k]]
    gaps: list[tuple[int, int]] = []
    open_: dict[int, Pattern] = {}

    def put(pattern: Pattern) -> None:
        k = len(open_)
        open_[k] = pattern
        insort(gaps, (capacity - sum(length * n for length, n in pattern.runs), k))

    for pattern in patterns:
        put(pattern)
    for length in sorted((k for k in left if left[k] and k <= third), reverse=True):
        todo = left[length]
        while todo:
            at = bisect_left(gaps, (length, -1))
            if at == len(gaps):
                each = capacity // length
                if todo >= each:
                    put(Pattern(todo // each, ((length, each),)))
                if todo % each:
                    put(Pattern(1, ((length, todo % each),)))
                break
            gap, k = gaps.pop(at)
            bins, runs = open_[k]
            open_[k] = Pattern(0, ())
            each = gap // length
            full = min(bins, todo // each)
            rest = min(todo - full * each, each - 1) if full < bins else 0
            if full:
                put(Pattern(full, (*runs, (length, each))))
            if rest:
                put(Pattern(1, (*runs, (length, rest))))
            if bins - full - bool(rest):
                put(Pattern(bins - full - bool(rest), runs))
            todo -= full * each + rest
    return [p for p in open_.values() if p.bins]


def placements(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """For each run of a pattern the ranks that it takes among its length's
    pieces, in order of length and first rank."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for bins, runs in patterns:
        offset = 0
        for length, each in runs:
            first = taken.get(length, 0)
            rows.append((length, first, each, sequence, offset))
            taken[length] = first + bins * each
            offset += length * each
        sequence += bins
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "each", "sequence", "offset"), table.T))


def pack(docs: DataFrame, spec: str, capacity: int = 2048, id: str = "doc_id", text: str = "text", end: int = 0) -> DataFrame:
    """One row per piece: its id, ``piece``, ``start``, ``length``,
    ``ids_crc32``, ``sequence_id`` and ``offset``.

    ``spec`` is the JSON text of the tokenizer file. A null or empty text is the
    id ``end`` alone. Only documents of more than ``capacity`` ids are cut, from
    the back. Repeated rows are packed as often as they occur; null ids stay.
    Other columns are not read. An empty table gives an empty result.
    """
    cut = pieces(docs, spec, capacity, id, text, end)
    made = written(cut.withColumn("row", F.monotonically_increasing_id()), "pieces")
    rows = made.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(BUCKETS)).cast("int"))  # equal rows too are dealt out
    counted = written(rows.groupBy("length", "bucket").agg(F.count("*").alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    places = placements(pack_counts(counts, capacity))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(counted.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "ranks")
    within = Window.partitionBy("length", "bucket").orderBy("row")
    ranked = (
        rows.withColumn("nth", F.row_number().over(within) - 1)
        .join(starts, ["length", "bucket"])
        .select("id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    )
    held = docs.sparkSession.sparkContext.broadcast(places)  # bounded by the distinct lengths

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = held.value
        lengths, index = np.unique(place["length"], return_index=True)
        ends = np.append(index, len(place["length"]))
        for batch in batches:
            length = batch.column(3).to_numpy()
            rank = batch.column(5).to_numpy()
            at = np.empty(len(length), np.int64)
            for k in np.unique(length).tolist():
                mine = length == k
                j = int(np.searchsorted(lengths, k))
                lo, hi = int(ends[j]), int(ends[j + 1])
                at[mine] = lo + np.searchsorted(place["first"][lo:hi], rank[mine], side="right") - 1
            nth = rank - place["first"][at]
            sequence = place["sequence"][at] + nth // place["each"][at]
            offset = place["offset"][at] + nth % place["each"][at] * length
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    schema = StructType([*cut.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    placed = ranked.mapInArrow(run, schema)
    return placed.select(F.col("id").alias(id), *schema.names[1:])
