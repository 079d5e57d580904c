"""MinHash near-dedup with fast similarity sketches.

A sketch of t coordinates is filled in rounds: round r hashes every shingle to
one of the t bins and to a value that is larger than all of the rounds before,
and a bin keeps its smallest value. Once every bin is filled later rounds change
nothing, so a set of n shingles costs some n + t log t hashes. Bins still empty
after t rounds take the smallest hash of all shingles in a round of their own,
so each coordinate is filled. Two sets agree in a coordinate with a chance equal
to their Jaccard similarity, and the coordinates concentrate at least as well as
independent ones.

Bands of coordinates propose pairs, and the whole shingle sets decide. Copies
with equal sets are one node. In a band's bucket of up to ``BUCKET`` nodes all
pairs are tested. In a larger one every node is first tested against the node
that shares most buckets with others, then against others outside its component
while this still merges some. What is then left between components is compared
by way of the bucket's first node, its hub: two sets have in common what both
share with the hub, at most the smaller of the two shares, and what they share
outside it. Only pairs whose sum may suffice are tested, so that no proposed
link is lost and sets just below the threshold are not paired with all others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from kpiloom.llm.common import whole_digest, written
from kpiloom.llm.components import components

SEED = 42

#: Bands, and coordinates in each. At a similarity of 0.8 a pair shares none of
#: the bands with a chance of 4e-9.
BANDS = 64
ROWS = 6

#: Largest chance to miss a pair just at the threshold.
MISS = 1e-6

#: Nodes of a bucket that are all paired at once.
BUCKET = 16

#: Rounds in which a large bucket's nodes are tested against one other each.
STARS = 8

#: Rounds in which crowded buckets with common nodes agree on a hub.
MEETINGS = 2

#: Pairs of one hub that are tested in one group.
PARTNERS = 2048

#: Hashes computed at once.
_CHUNK = 1 << 18
_GOLD = 0x9E3779B97F4A7C15
_EMPTY = np.iinfo(np.uint64).max


def shingle_set(text: bytes | None, words: int) -> set[bytes]:
    """Distinct shingles of the lower-cased (A-Z) text; fewer words than a
    shingle are one, no words are none."""
    parts = (text or b"").lower().split()
    if len(parts) <= words:
        return {b" ".join(parts)} if parts else set()
    return {b" ".join(s) for s in zip(*(parts[k:] for k in range(words)))}


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _seeds(rounds: np.ndarray) -> np.ndarray:
    return _mix((rounds.astype(np.uint64) + np.uint64(1)) * np.uint64(_GOLD))


def sketch(hashes: np.ndarray, size: int) -> np.ndarray:
    """Fast similarity sketch of a set of 64-bit hashes: ``size`` coordinates."""
    out = np.full(size, _EMPTY, np.uint64)
    n, done = len(hashes), 0
    if not n:
        return out
    expected = math.ceil(size * (math.log(size) + 2) / n)
    while done < size and (out == _EMPTY).any():
        rounds = np.arange(done, min(size, done + max(1, min(expected, _CHUNK // n))))
        h = _mix(hashes[None, :] ^ _seeds(rounds)[:, None])
        bins = ((h >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)
        value = (_mix(h) >> np.uint64(16)) | (rounds.astype(np.uint64) << np.uint64(48))[:, None]
        np.minimum.at(out, bins.ravel().astype(np.int64), value.ravel())
        done += len(rounds)
    for bin in np.flatnonzero(out == _EMPTY):
        own = np.array([size + bin])
        out[bin] = (_mix(_mix(hashes ^ _seeds(own))) >> np.uint64(16)).min() | (own.astype(np.uint64) << np.uint64(48))[0]
    return out


def band_keys(coordinates: np.ndarray, bands: int) -> np.ndarray:
    """One long per band, from its number and coordinates."""
    key = _seeds(np.arange(bands))
    for column in coordinates.reshape(bands, -1).T:
        key = _mix(key * np.uint64(_GOLD) ^ column)
    return key.view(np.int64)


def sketched(docs: DataFrame, id: str, text: str, words: int, bands: int, rows: int) -> DataFrame:
    """Id, ``sha`` of the text, ``n`` shingles, ``digest`` of their set and the
    keys of its ``bands``; no digest and no bands for a set of none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            counts, digests, keys = [], [], []
            for value in batch.column(2):
                shingles = shingle_set(value.as_py(), words)
                hashes = np.sort(np.fromiter((xxh64_intdigest(s, SEED) for s in shingles), np.uint64, len(shingles)))
                counts.append(len(shingles))
                digests.append(blake2b(hashes.tobytes(), digest_size=16).digest() if shingles else None)
                keys.append(band_keys(sketch(hashes, bands * rows), bands) if shingles else [])
            columns = [pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=schema.names)

    body = F.col(f"`{text}`")
    source = docs.select(F.col(f"`{id}`").alias("id"), whole_digest(body).alias("sha"), body.cast("binary").alias("text"))
    fields = [StructField("n", LongType()), StructField("digest", BinaryType()), StructField("bands", ArrayType(LongType()))]
    schema = StructType([*source.schema.fields[:2], *fields])
    return source.mapInArrow(run, schema)


def _met(pairs: DataFrame, texts: DataFrame, *more: str) -> DataFrame:
    """The pairs ``u``, ``v`` with both texts, and the columns ``more``.

    The text of ``v`` moves to that of ``u``, which should be the node of more
    pairs; a node of many pairs has its text in several groups.
    """
    groups = F.ceil(F.col("count") / PARTNERS).cast("int")
    hubs = written(pairs.groupBy("u").count().select("u", groups.alias("groups")), "hubs")
    first = hubs.join(texts.withColumnRenamed("node", "u"), "u").select(
        "u", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"), F.col("text").alias("text_u")
    )
    second = (
        pairs.join(hubs, "u")
        .select("u", F.pmod(F.xxhash64("v"), F.col("groups")).cast("int").alias("part"), F.col("v").alias("node"), *more)
        .join(texts, "node")
    )
    return second.join(first, ["u", "part"]).select("u", F.col("node").alias("v"), "text_u", "text", *more)


def _confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs ``u``, ``v`` whose whole sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(maxsize=8)
        def shingles(raw: bytes) -> set[bytes]:
            return shingle_set(raw, words)

        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3)):
                one, other = shingles(a.as_py()), shingle_set(b.as_py(), words)
                common = len(one & other)
                keep.append(100 * common >= percent * (len(one) + len(other) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return _met(pairs, texts).mapInArrow(run, "u long, v long")


def _shares(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """For a hub ``u`` and a node ``v``: the node's ``root``, whether it is
    ``outside`` the hub's, its ``n`` shingles, ``common`` ones with the hub, and
    hashes of the ``others``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        @lru_cache(maxsize=8)
        def shingles(raw: bytes) -> set[bytes]:
            return shingle_set(raw, words)

        for batch in batches:
            sizes, common, others = [], [], []
            for a, b in zip(batch.column(2), batch.column(3)):
                one, other = shingles(a.as_py()), shingle_set(b.as_py(), words)
                rest = other - one
                sizes.append(len(other))
                common.append(len(other) - len(rest))
                others.append(np.fromiter((xxh64_intdigest(s, SEED) for s in rest), np.uint64, len(rest)).view(np.int64))
            columns = [pa.array(sizes, pa.int64()), pa.array(common, pa.int64()), pa.array(others, pa.list_(pa.int64()))]
            kept = [batch.column(i) for i in (0, 1, 4, 5)]
            yield pa.RecordBatch.from_arrays([*kept, *columns], names=["u", "v", "root", "outside", "n", "common", "others"])

    schema = "u long, v long, root long, outside boolean, n long, common long, others array<long>"
    return _met(pairs, texts, "root", "outside").mapInArrow(run, schema)


def _large_enough(a: str, b: str, percent: int) -> Column:
    """Sizes that allow the similarity."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _pairs(entries: DataFrame, percent: int, different: str) -> DataFrame:
    """All pairs within the buckets whose column ``different`` differs; ``u`` is
    the node that shares more buckets with others."""
    one = entries.select("bucket", F.col("node").alias("a"), F.col("n").alias("na"), F.col("rank").alias("ra"), F.col(different).alias("da"))
    two = entries.select("bucket", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("rank").alias("rb"), F.col(different).alias("db"))
    met = one.join(two, "bucket").where("a < b and da <> db").where(_large_enough("na", "nb", percent))
    a_first = (F.col("ra") >= F.col("rb"))
    return met.select(F.when(a_first, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(a_first, F.col("b")).otherwise(F.col("a")).alias("v")).distinct()


def _stars(entries: DataFrame, order: Column, different: str, percent: int) -> DataFrame:
    """In each bucket the node that comes first in ``order`` is offered to those
    whose column ``different`` is not its own; a node takes the first it is
    offered, so that each has one pair at most."""
    entry = F.struct(order.alias("order"), F.col("node"), F.col("n"), F.col(different).alias("part"))
    first = written(entries.groupBy("bucket").agg(F.max(entry).alias("first")), "first-nodes")
    offered = entries.join(first, "bucket").where(F.col(different) != F.col("first.part"))
    picked = offered.where(_large_enough("n", "first.n", percent)).groupBy("node").agg(F.max("first").alias("hub"))
    return picked.select(F.col("hub.node").alias("u"), F.col("node").alias("v"))


def _through_hubs(entries: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs of nodes of different ``root`` that share a bucket's hub and may be
    similar enough: all that are, and few others."""
    first = written(entries.groupBy("bucket").agg(F.max(F.struct("rank", "node", "root")).alias("first")), "hub-nodes")
    # Any set serves as a bucket's hub, if all its nodes take the same one. Buckets take the
    # highest that their nodes meet elsewhere, so that a node has few hubs, not one a band.
    for _ in range(MEETINGS):
        met = entries.select("bucket", "node").join(first, "bucket")
        best = met.groupBy("node").agg(F.max("first").alias("first"))
        first = written(entries.select("bucket", "node").join(best, "node").groupBy("bucket").agg(F.max("first").alias("first")), "hub-nodes")
    outside = (F.col("root") != F.col("first.root")).alias("outside")
    seen = entries.join(first, "bucket").select(F.col("first.node").alias("u"), F.col("node").alias("v"), "root", outside).distinct()
    members = written(_shares(written(seen, "hub-members"), texts, words), "hub-shares")

    def enough(common: Column, sizes: Column) -> Column:
        return (100 + percent) * common >= percent * sizes

    def side(rows: DataFrame, name: str, *more: str) -> DataFrame:
        columns = [c for c in ("v", "n", "common", "root", "rest") if c in rows.columns]
        return rows.select("u", *more, *[F.col(c).alias(f"{c}_{name}") for c in columns])

    least, sizes = F.least("common_a", "common_b"), F.col("n_a") + F.col("n_b")
    fitting = (F.col("root_a") != F.col("root_b")) & _large_enough("n_a", "n_b", percent)
    # Similar sets share at least ``fewest`` others. Ordered by how many members have
    # them, two such sets meet among all but the last ``fewest`` - 1; what follows the
    # first they share bounds how many it can be. Sets that need none meet at the hub.
    least_common = F.ceil(F.col("n") * percent / 100)
    near = members.where(F.col("common") >= least_common).drop("others")
    by_hub = side(near.where("outside"), "a").join(side(near, "b"), "u").where(fitting & enough(least, sizes)).select("v_a", "v_b")
    fewest = F.greatest(F.lit(1), least_common - F.col("common"))
    listed = members.withColumns({"fewest": fewest, "size": F.size("others")}).where("size >= fewest").withColumn("shingle", F.explode("others")).drop("others")
    posted = listed.withColumn("held", F.count("*").over(W.partitionBy("u", "shingle")))
    place = F.row_number().over(W.partitionBy("u", "v").orderBy("held", "shingle"))
    posted = posted.withColumn("place", place).where("place <= size - fewest + 1 AND held > 1").withColumn("rest", F.col("size") - F.col("place"))
    posted = written(posted, "shingles-outside")
    possible = enough(least + 1 + F.least("rest_a", "rest_b"), sizes)
    by_rest = side(posted.where("outside"), "a", "shingle").join(side(posted, "b", "shingle"), ["u", "shingle"]).where(fitting & possible).select("v_a", "v_b")
    return by_hub.unionByName(by_rest).select(F.least("v_a", "v_b").alias("u"), F.greatest("v_a", "v_b").alias("v")).distinct()


def confirmed_links(nodes: DataFrame, raw: DataFrame, words: int, percent: int) -> DataFrame:
    """Links ``u``, ``v`` with the same components as all similar pairs that
    share a band. ``nodes`` has ``node``, ``n``, ``sha`` and ``bands``; ``raw``
    has the ``text`` of each ``sha``, at least once."""
    entries = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    sizes = written(entries.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "bucket-sizes")
    shared = written(entries.join(sizes, "bucket"), "shared")
    rank = written(shared.groupBy("node").agg(F.sum("size").alias("rank")), "ranks")
    shared = written(shared.join(rank, "node"), "shared-ranked")
    candidates = written(nodes.join(rank, "node").select("node", "sha"), "candidates")
    texts = written(raw.join(candidates, "sha").groupBy("node").agg(F.first("text").alias("text")), "candidate-texts")
    large = shared.where(F.col("size") > BUCKET)

    tested = _pairs(shared.where(F.col("size") <= BUCKET), percent, "node")
    crowded = not large.isEmpty()
    if crowded:
        tested = tested.unionByName(_stars(large, F.col("rank"), "node", percent)).distinct()
    found = written(_confirmed(written(tested, "pairs"), texts, words, percent), "links")
    star, left = 0, large
    while crowded:
        roots = components(found).select(F.col("u").alias("node"), F.col("v").alias("root"))
        rooted = left.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        open_ = rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
        left = written(rooted.join(open_.select("bucket"), "bucket"), "open-buckets")
        shares = left.groupBy("bucket", "root").agg(F.count("*").cast("double").alias("c")).groupBy("bucket")
        crossing = ((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))) / 2).alias("pairs")
        pairs, rows = shares.agg(crossing, F.sum("c").alias("c")).agg(F.sum("pairs"), F.sum("c")).first()
        if not rows:
            break
        few, last = pairs <= rows, star >= STARS
        star += 1
        if few:
            tested = _pairs(left, percent, "root")
        elif last:
            tested = _through_hubs(left, texts, words, percent)
        else:
            tested = _stars(left, F.xxhash64("node", F.lit(star)), "root", percent)
        more = written(_confirmed(written(tested, "pairs"), texts, words, percent), "links")
        if few or last:
            return found.unionByName(more)
        if more.isEmpty():
            star = STARS
        found = written(found.unionByName(more), "links")
    return found


def minhash_duplicates(
    docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 2, percent: int = 80, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """One row per row of ``docs``: its id, ``n_shingles`` (distinct shingles of
    ``words`` words), ``component_id`` (the smallest id reachable over links of
    at least ``percent`` per cent Jaccard similarity) and ``kept`` (the id is
    the component's).

    Null texts and texts without words have no shingles, link with nothing and
    are kept; a text of up to ``words`` words is one shingle. Equal texts and
    repeated rows share a component. Null ids are passed over by the smallest
    id; where a component has no other its id is null and its rows are kept.
    Other columns are not read. An empty table gives an empty result.

    Links are confirmed on the whole sets, so none is wrong. One at the
    threshold goes unproposed with a chance of (1 - similarity ** rows) **
    bands, which must be below ``MISS``; it falls fast above the threshold.
    """
    if (1 - (percent / 100) ** rows) ** bands > MISS:
        raise ValueError(f"{bands} bands of {rows} rows miss more than {MISS} of the pairs at {percent} %")
    table = written(sketched(docs, id, text, words, bands, rows), "sketches")
    sets = table.where("n > 0").groupBy("digest").agg(F.min("id").alias("low"), F.min("sha").alias("sha"), F.min("n").alias("n"), F.first("bands").alias("bands"))
    sets = written(sets.withColumn("node", F.monotonically_increasing_id()), "sets")
    body = F.col(f"`{text}`")
    raw = docs.select(whole_digest(body).alias("sha"), body.cast("binary").alias("text"))
    roots = components(confirmed_links(sets, raw, words, percent))
    rooted = sets.join(roots.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left")
    rooted = written(rooted.select("digest", "low", F.coalesce("root", "node").alias("root")), "rooted-sets")
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component"))
    named = written(rooted.join(lowest, "root").select("digest", "component"), "components")
    out = table.select("id", "n", "digest").join(named, "digest", "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias(id), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept")
    )
