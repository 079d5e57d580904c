"""Mixing sources to target weights by Pareto order sampling.

Every source has a word target. Each of its documents gets the same expected
number of copies, target over size; the whole part is allocated for certain,
and the rest is the inclusion odds of a sample: documents are ranked by random
odds over inclusion odds, and each is taken in that order if its words fit what
is left, until no document fits; at last the smallest one left, if that comes
nearer to the target.

Random numbers are digests of id, text and repeat number, so that reruns agree
and null or repeated ids are drawn one by one. The point where a document first
does not fit is found by counting words per digit of the rank key, digit after
digit, so that no source gathers in one task; the same goes on behind it with
the documents that still fit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiloom.llm.common import null_safe, whole_digest, word_count, written

#: Bits of the rank key that one counting pass resolves, and passes.
DIGIT_BITS = 10
DIGITS = 5
KEY_BITS = DIGIT_BITS * DIGITS


def word_targets(sizes: DataFrame, weights: Sequence[int], most: float) -> DataFrame:
    """Target of each source: ``sizes`` has one row per source with
    ``source_size``. The total is shared by weight, which go round the sources
    in code point order, null last; a target stops at ``most`` times the size,
    and the excess is reshared until none is above.

    That is the water level over the sources in order of limit over weight: a
    window over the table of sources, not of documents.
    """
    place = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(float(w)) for w in weights])
    listed = sizes.withColumn("weight", F.element_at(turn, ((F.row_number().over(place) - 1) % len(weights) + 1).cast("int")))
    limit = F.col("source_size") * float(most)
    rows = listed.withColumn("limit", limit).withColumn("level", F.col("limit") / F.col("weight"))
    by_level = Window.orderBy("level", F.col("source").asc_nulls_last())
    total = F.sum("source_size").over(Window.partitionBy()).cast("double")
    capped = F.coalesce(F.sum("limit").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight_left = F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    water = rows.withColumn("water", (total - capped) / weight_left).withColumn("open", F.col("level") >= F.col("water"))
    level = F.min(F.when(F.col("open"), F.struct("level", "water"))).over(Window.partitionBy())
    return water.select(
        "source",
        "source_size",
        F.when(F.col("source_size") == 0, F.lit(0.0))
        .otherwise(F.least(F.col("limit"), F.coalesce(F.col("weight") * level["water"], F.col("limit"))))
        .alias("target"),
    )


def random_share(name: Column) -> Column:
    """A number above 0 and below 1 for each name, from 52 bits of its digest."""
    digits = F.substring(F.md5(F.coalesce(name.cast("string"), F.lit(""))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def pareto_key(share: Column, odds: Column) -> Column:
    """Rank key of Pareto sampling: random odds over inclusion odds, as a whole
    number below 2**50. q / (1 + q) keeps the order of q."""
    q = (share / (1 - share)) / (odds / (1 - odds))
    return F.least(F.floor(q / (1 + q) * float(1 << KEY_BITS)), F.lit((1 << KEY_BITS) - 1)).cast("long")


def sample_ends(rows: DataFrame, quotas: DataFrame) -> DataFrame:
    """Per source the rank key up to which documents fit the quota (``at``), and
    the words still missing there (``gap``). ``rows`` has source_no, key, words;
    ``quotas`` has source_no, quota. Each pass counts the words by the next digit
    of the key, within the digits that the quota has led to so far, and the last
    one is that which finds a single key there in every source."""
    prefix = quotas.select("source_no", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"), "quota")
    for step in range(DIGITS):
        shift = KEY_BITS - DIGIT_BITS * (step + 1)
        inside = rows.join(prefix.select("source_no", "prefix", "before", "quota"), "source_no").where(F.shiftright("key", shift + DIGIT_BITS) == F.col("prefix"))
        by_digit = inside.groupBy("source_no", "before", "quota", F.shiftright("key", shift).alias("digit")).agg(
            F.sum("words").alias("words"), F.min("key").alias("low"), F.max("key").alias("high")
        )
        upto = F.sum("words").over(Window.partitionBy("source_no").orderBy("digit"))
        crossed = by_digit.withColumn("after", F.col("before") + upto).where("after > quota")
        first = crossed.groupBy("source_no").agg(F.min(F.struct("digit", (F.col("after") - F.col("words")).alias("before"), "quota", "low", "high")).alias("f"))
        prefix = written(first.select("source_no", F.col("f.digit").alias("prefix"), "f.before", "f.quota", "f.low", "f.high"), "digits")
        if prefix.where("low < high").isEmpty():
            break
    return prefix.select("source_no", (F.col("low") - 1).alias("at"), (F.col("quota") - F.col("before")).alias("gap"))


def sample_spans(rows: DataFrame, quotas: DataFrame) -> DataFrame:
    """Per source the ``spans`` of rank keys in which documents are taken: those
    above ``after``, up to ``upto``, of at most ``fits`` words. Arguments are
    those of ``sample_ends``. A span ends at the first document that does not
    fit; the next one goes on behind it with those that fit what is left there,
    until none does. Documents without words are of the first span only."""
    left = quotas.select("source_no", "quota", F.lit(-1).cast("long").alias("after"), F.lit((1 << 63) - 1).alias("fits"))
    spans, rest = None, rows
    while spans is None or not rest.isEmpty():
        ends = written(sample_ends(rest, left), "ends")
        upto = F.coalesce("at", F.lit(1 << KEY_BITS))
        found = left.join(ends, "source_no", "left").select("source_no", F.struct("after", upto.alias("upto"), "fits").alias("span"))
        spans = found if spans is None else spans.unionByName(found)
        left = ends.select("source_no", F.col("gap").alias("quota"), (F.col("at") + 1).alias("after"), F.col("gap").alias("fits"))
        behind = rest.join(left.select("source_no", "after", "fits"), "source_no").where("key > after and words > 0 and words <= fits")
        rest = written(behind.select("source_no", "key", "words"), "behind")
    return written(spans.groupBy("source_no").agg(F.collect_list("span").alias("spans")), "spans")


def drawn(docs: DataFrame, id: str, text: str, source: str, weights: Sequence[int], most: int) -> DataFrame:
    """The rows of ``mix`` with its columns, ``id`` as "id", and the ``source``
    and ``digest`` (``whole_digest``) of each."""
    body = F.col(f"`{text}`")
    raw = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{source}`").alias("source"), word_count(body).alias("size"), whole_digest(body).alias("digest"))
    sized = raw.groupBy("id", "source", "size", "digest").agg(F.count("*").alias("n"))
    sized = written(sized.select("id", "source", "size", "digest", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("repeat")), "sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rate = F.when(F.col("source_size") == 0, F.lit(1.0)).otherwise(F.col("target") / F.col("source_size"))
    certain = F.floor(F.col("rate") + 1e-9).cast("long")
    targets = word_targets(totals, weights, most).withColumn("rate", rate).withColumn("certain", certain)
    targets = targets.withColumn("odds", F.greatest(F.col("rate") - F.col("certain"), F.lit(0.0)))
    targets = written(targets.withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long")), "targets")
    name = F.concat_ws("/", F.coalesce(F.col("id").cast("string"), F.lit("")), F.hex("digest"), "repeat")
    key = F.when(F.col("odds") > 1e-9, pareto_key(random_share(name), F.col("odds")))
    rows = sized.join(targets, null_safe(sized, targets, ["source"]), "inner").drop(targets["source"])
    rows = written(rows.withColumn("key", key), "ranked")
    quota = F.round(F.col("target") - F.col("certain") * F.col("source_size")).cast("long").alias("quota")
    quotas = targets.where("odds > 1e-9").select("source_no", quota)
    spans = sample_spans(rows.where("key is not null").select("source_no", "key", F.col("size").alias("words")), quotas)
    within = F.exists("spans", lambda s: (F.col("key") > s["after"]) & (F.col("key") <= s["upto"]) & (F.col("size") <= s["fits"]) & ((F.col("size") > 0) | (s["after"] < 0)))
    placed = written(rows.join(spans, "source_no", "left").withColumn("taken", F.coalesce(within, F.lit(False))).drop("spans"), "placed")
    filled = placed.where("key is not null").groupBy("source_no").agg(
        F.sum(F.when(F.col("taken"), F.col("size")).otherwise(0)).alias("words"),
        F.min(F.when(~F.col("taken") & (F.col("size") > 0), F.struct("size", "key"))).alias("least"),
    )
    gap = F.col("quota") - F.col("words")
    over = filled.join(quotas, "source_no").where(F.col("least.size") - gap < gap).select("source_no", "least.size", "least.key", F.lit(True).alias("over"))
    copies = F.col("certain") + (F.col("taken") | F.coalesce("over", F.lit(False))).cast("long")
    return placed.join(written(over, "over"), ["source_no", "size", "key"], "left").select(
        "id", "source", "digest", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken")
    )


def mix(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[int] = (5, 2, 1),
    most: int = 3,
) -> DataFrame:
    """One row per row of ``docs``: its id, ``size``, ``source_size``,
    ``target`` (its source's), ``copies``, ``taken`` (size times copies).

    Sizes count runs of non-blank characters; null and empty texts have none. A
    null source is a source of its own; a source without words keeps one copy of
    each row. Every row is drawn on its own, also those of null and repeated ids.
    Other columns are not read. An empty table gives an empty result.
    """
    rows = drawn(docs, id, text, source, weights, most)
    return rows.select(F.col("id").alias(id), "size", "source_size", "target", "copies", "taken")
