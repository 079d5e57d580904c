"""Exact dedup against an index of historical digests under a minimal perfect hash.

The distinct digests are dealt by hash into shards of about ``SHARD_KEYS`` of the
historical or the newer rows, whichever are more. Each shard gets a minimal perfect hash function (levels
of bit arrays: a key owns the slot of the first level where it alone hit its
bit), and its slots hold the full digest and the locator of the group's best
row. Digests of newer rows look up their slot; a slot counts only when its
digest is equal byte by byte. Members join their group, the others form groups
of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from kpiloom.llm.common import BLANK, filled, written

#: Digests in a shard of the index, on average.
SHARD_KEYS = 4096

#: Bits per key in each level; more make lookups shorter and the function larger.
LEVEL_BITS = 2


def text_digest(text: str | Column) -> Column:
    """SHA-256 of the text without its ASCII blanks; null counts as empty."""
    return F.unhex(F.sha2(F.regexp_replace(filled(text), f"[{BLANK}]+", ""), 256))


def _words(digests: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(digests).view("<u8")


def _hash(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """A position below ``size`` for each key, by another mix on each level."""
    h = np.full(len(words), (level * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1), np.uint64)
    for k in range(words.shape[1]):
        h ^= words[:, k]
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(33)
    return (h % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Minimal perfect hash over distinct fixed-width keys."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.ranks = np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])

    @classmethod
    def build(cls, digests: np.ndarray) -> PerfectHash:
        sizes, levels, rest = [], [], _words(digests)
        while len(rest):
            size = LEVEL_BITS * len(rest)
            at = _hash(rest, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            rest = rest[~alone[at]]
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, bool))

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """The slot of each key of the set; any slot or -1 for other keys."""
        words, out = _words(digests), np.full(len(digests), -1, np.int64)
        open_ = np.arange(len(digests))
        for level, size in enumerate(self.sizes):
            if not len(open_):
                break
            at = self.starts[level] + _hash(words[open_], level, size)
            hit = self.bits[at]
            out[open_[hit]] = self.ranks[at[hit]]
            open_ = open_[~hit]
        return out

    def packed(self) -> bytes:
        return np.packbits(self.bits).tobytes()

    @classmethod
    def unpacked(cls, sizes: list[int], packed: bytes) -> PerfectHash:
        return cls(sizes, np.unpackbits(np.frombuffer(packed, np.uint8), count=sum(sizes)).astype(bool))


def _digests(column: pa.ChunkedArray) -> np.ndarray:
    """Digests of 32 bytes as rows of an array."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def _shard(digest: str, shards: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(shards)).cast("int")


def best_rows(digests: DataFrame) -> DataFrame:
    """One row per digest: its best row (longest, then smallest id, null ids
    last) and the number of rows. Combines on the map side."""
    best = F.min(F.struct((-F.col("length")).alias("shorter"), F.col("id").isNull().alias("no_id"), F.col("id")))
    return (
        digests.groupBy("digest")
        .agg(best.alias("best"), F.count("*").alias("n"))
        .select("digest", (-F.col("best.shorter")).alias("length"), F.col("best.id").alias("id"), "n")
    )


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """The index over distinct historical digests (``best_rows``): per shard
    the hash function and, in slot order, digests and locators."""
    id_type = history.schema["id"].dataType
    schema = StructType(
        [
            StructField("shard", IntegerType()),
            StructField("sizes", ArrayType(LongType())),
            StructField("bits", BinaryType()),
            StructField("digests", BinaryType()),
            StructField("lengths", ArrayType(LongType())),
            StructField("ids", ArrayType(id_type)),
            StructField("counts", ArrayType(LongType())),
        ]
    )

    def build(part: pa.Table) -> pa.Table:
        digests = _digests(part["digest"])
        function = PerfectHash.build(digests)
        order = pa.array(np.argsort(function.slots(digests)))
        part = part.take(order)
        return pa.table(
            {
                "shard": part["shard"].slice(0, 1),
                "sizes": pa.array([function.sizes], pa.list_(pa.int64())),
                "bits": pa.array([function.packed()], pa.binary()),
                "digests": pa.array([_digests(part["digest"]).tobytes()], pa.binary()),
                "lengths": pa.array([part["length"].to_pylist()], pa.list_(pa.int64())),
                "ids": pa.array([part["id"].to_pylist()], pa.list_(part["id"].type)),
                "counts": pa.array([part["n"].to_pylist()], pa.list_(pa.int64())),
            }
        )

    return history.withColumn("shard", _shard("digest", shards)).groupBy("shard").applyInArrow(build, schema)


def merge_newer(index: DataFrame, newer: DataFrame, shards: int) -> DataFrame:
    """Groups of all rows: each slot of the index with the newer rows
    (``best_rows``) found in it, and the digests that no slot holds."""
    fields = StructType([newer.schema[c] for c in ("digest", "length", "id", "n")])
    fields = StructType([StructField(f.name, f.dataType, True) for f in fields])

    def look_up(slots: pa.Table, rows: pa.Table) -> pa.Table:
        digest, length, ident, n = (rows[c].to_pylist() for c in ("digest", "length", "id", "n"))
        out: list[tuple] = []
        member = np.zeros(len(digest), bool)
        if slots.num_rows:
            entry = slots.to_pylist()[0]
            held = np.frombuffer(entry["digests"], np.uint8).reshape(-1, 32)
            lengths, ids, counts = entry["lengths"], entry["ids"], entry["counts"]
            if len(digest):
                keys = _digests(rows["digest"])
                slot = PerfectHash.unpacked(entry["sizes"], entry["bits"]).slots(keys)
                member = (slot >= 0) & (held[np.maximum(slot, 0)] == keys).all(axis=1)
                for i in np.flatnonzero(member).tolist():
                    s = int(slot[i])
                    counts[s] += n[i]
                    if (-length[i], ident[i] is None, ident[i] or 0) < (-lengths[s], ids[s] is None, ids[s] or 0):
                        lengths[s], ids[s] = length[i], ident[i]
            out = [(held[s].tobytes(), lengths[s], ids[s], counts[s]) for s in range(len(counts))]
        out += [(digest[i], length[i], ident[i], n[i]) for i in np.flatnonzero(~member).tolist()]
        columns = list(zip(*out)) if out else [()] * 4
        types = [rows.schema.field(c).type for c in ("digest", "length", "id", "n")]
        return pa.table({f.name: pa.array(list(c), t) for f, c, t in zip(fields, columns, types)})

    keyed = newer.withColumn("shard", _shard("digest", shards))
    return index.groupBy("shard").cogroup(keyed.groupBy("shard")).applyInArrow(look_up, fields)


def digest_table(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Id, code points and digest of every row."""
    body = F.col(f"`{text}`")
    return docs.select(F.col(f"`{id}`").alias("id"), F.length(filled(body)).cast("long").alias("length"), text_digest(body).alias("digest"))


def exact_groups(rows: DataFrame, history: DataFrame) -> DataFrame:
    """Group of every digest of ``rows`` and ``history`` (both ``digest_table``)."""
    old, new = written(best_rows(history), "history"), written(best_rows(rows), "newer")
    shards = max(1, -(-max(old.count(), new.count()) // SHARD_KEYS))
    index = written(build_index(old, shards), "digest-index")
    return written(merge_newer(index, new, shards), "digest-groups")


def exact_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", newer_share: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: its id, ``keep_id``, ``group_size``,
    ``kept``, ``text_sha256``.

    Texts are equal when they differ in ASCII blanks only; null counts as
    empty. The row with the most code points stays, then the smallest id (null
    ids last). Of repeated equal rows exactly one is kept. All rows take part:
    a share of ``newer_share``, dealt by a hash of id and digest, is looked up in the
    index that the others make; the split changes no result. Other columns are
    not read. An empty table gives an empty result.
    """
    digests = written(digest_table(docs, id, text), "digests")
    newer = F.pmod(F.xxhash64("id", "digest"), F.lit(1000)) < int(1000 * newer_share)
    groups = exact_groups(digests.where(newer), digests.where(~newer))
    groups = groups.select("digest", F.col("length").alias("best_length"), F.col("id").alias("keep_id"), F.col("n").alias("group_size"))
    repeated = digests.groupBy("id", "length", "digest").agg(F.count("*").alias("repeats"))
    best = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("length") == F.col("best_length"))
    return (
        repeated.join(groups, "digest")
        .select("*", F.explode(F.sequence(F.lit(1).cast("long"), "repeats")).alias("repeat"))
        .select(
            F.col("id").alias(id),
            "keep_id",
            "group_size",
            (best & (F.col("repeat") == 1)).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
    )
