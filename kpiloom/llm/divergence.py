"""Source divergence audit: which sources of a language use which terms.

Identical texts of a language are collapsed into one, with the number of copies
that each source holds. Each distinct text is tokenised once; its terms count
for a source as often as the source holds the text. So a text that fills a third
of the rows is one tokenised text and one entry per source. A task sums its
texts per term and source before anything is shuffled.

Shares are integers, p = 1 + floor(SCALE * (count + 1) / (N + V)), so all sums
are exact. A term that neither source of a pair uses adds the same value, one
that only one of them uses a value that depends on that source's count: the sum
over all V terms is found from the terms used (``pair_values``).
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kpiloom.llm.common import filled, whole_digest, written

#: Terms are runs of ASCII letters and characters beyond ASCII.
#: A-Z become a-z, every other ASCII character a blank; UTF-8 writes characters
#: beyond ASCII in bytes from 0x80 on, which stay.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

SCALE = 1_000_000_000

#: Documents of a language that a kept term occurs in, at least.
DOCUMENTS = 3

#: Rows of part ``term`` per source.
RANKS = 200

#: Sources of one text in one row; a text of more is tokenised once for each so many.
HOLDERS = 4096

#: Sums that a task holds before it sends them on.
HELD = 1 << 19


def share(count: Column, total: Column, terms: Column) -> Column:
    """p of a term. In decimals of 38 digits: SCALE * count may exceed a long."""
    scaled = ((count + 1) * F.lit(SCALE).cast("decimal(18,0)")).cast("decimal(38,0)")
    return 1 + F.call_function("div", scaled, (total + terms).cast("decimal(20,0)"))


def distance(p: Column, q: Column) -> Column:
    """floor((p - q) ** 2 / q); the square of a share fits a long."""
    return F.call_function("div", (p - q) * (p - q), q)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per language and term of the task's texts: the sources that use it, with
    occurrences and documents."""
    words: dict[tuple, Counter] = defaultdict(Counter)
    documents: dict[tuple, Counter] = defaultdict(Counter)

    def drained() -> Iterator[pa.RecordBatch]:
        for lang in {lang for lang, _ in words}:
            rows: dict[bytes, tuple[list, list, list]] = defaultdict(lambda: ([], [], []))
            for at, source in [key for key in words if key[0] == lang]:
                df = documents[at, source]
                for term, n in words[at, source].items():
                    row = rows[term]
                    row[0].append(source)
                    row[1].append(n)
                    row[2].append(df[term])
            lists = [pa.array([row[k] for row in rows.values()], pa.list_(pa.int64())) for k in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(rows), pa.string()), pa.array(list(rows), pa.string()), *lists], names=["lang", "term", "group", "n", "df"])
        words.clear()
        documents.clear()

    held = 0
    for batch in batches:
        for lang, text, holders in zip(*(c for c in batch.columns)):
            lang, terms = lang.as_py(), text.as_py().translate(PLAIN).split()
            if not terms:
                continue
            counts = None
            for holder in holders.as_py():
                key, copies = (lang, holder["group"]), holder["copies"]
                n, df = words[key], documents[key]
                held -= len(n)
                if copies == 1:
                    n.update(terms)
                    df.update(set(terms))
                else:
                    counts = counts or Counter(terms)
                    for term, c in counts.items():
                        n[term] += c * copies
                        df[term] += copies
                held += len(n)
                if held > HELD:
                    yield from drained()
                    held = 0
    yield from drained()


def term_counts(docs: DataFrame, lang: str, source: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The groups that occur, as ``group``, ``lang`` and ``source``; and per
    language and term its occurrences ``n`` and documents ``df`` in a group."""
    named = docs.select(filled(F.col(f"`{lang}`")).alias("lang"), filled(F.col(f"`{source}`")).alias("source"), filled(F.col(f"`{text}`")).alias("text"))
    keyed = named.withColumn("digest", whole_digest("text"))
    copies = written(keyed.groupBy("lang", "digest", "source").agg(F.count("*").alias("copies")), "copies")
    groups = written(copies.select("lang", "source").distinct().withColumn("group", F.monotonically_increasing_id()), "groups")
    parts = F.ceil(F.count("*") / HOLDERS).cast("int").alias("parts")
    sizes = copies.groupBy("lang", "digest").agg(parts)
    part = F.pmod(F.xxhash64("group"), F.col("parts"))
    spread = copies.join(groups, ["lang", "source"]).join(sizes, ["lang", "digest"]).withColumn("part", part)
    holders = written(spread.groupBy("lang", "digest", "part").agg(F.collect_list(F.struct("group", "copies")).alias("holders")), "holders")
    once = keyed.groupBy("lang", "digest").agg(F.first("text").alias("text"))
    texts = once.join(holders, ["lang", "digest"]).select("lang", F.col("text").cast("binary").alias("text"), "holders")
    sums = texts.mapInArrow(_sums, "lang string, term string, group array<long>, n array<long>, df array<long>").repartition("lang", "term")
    flat = sums.select("lang", "term", F.inline(F.arrays_zip("group", "n", "df")))
    return groups, flat.groupBy("lang", "term", "group").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def pair_values(used: DataFrame, groups: DataFrame) -> DataFrame:
    """``value`` of every ordered pair ``source``, ``item`` of a language.

    ``used`` has the terms with a count above zero and their share ``p``,
    ``groups`` the share ``p0`` of a term without one and the number ``v`` of
    kept terms. With d(a, b) the distance of a term's shares, 0 for "unused":
    sum = v d(0, 0) + sum over a's terms of (d(p, 0) - d(0, 0)) + sum over b's of
    (d(0, q) - d(0, 0)) + sum over common ones of (d(p, q) - d(p, 0) - d(0, q) + d(0, 0)).
    The middle sums take each distinct count once.
    """
    a = groups.select("lang", "source", F.col("p0").alias("a0"), "v")
    b = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("b0"))
    both = written(a.join(b, "lang").where("source <> item"), "source-pairs")
    levels = written(used.groupBy("lang", "source", "p").agg(F.count("*").alias("terms")), "levels")
    none = distance(F.col("a0"), F.col("b0"))
    left = both.join(levels, ["lang", "source"]).select("lang", "source", "item", (F.col("terms") * (distance(F.col("p"), F.col("b0")) - none)).alias("value"))
    right = both.join(levels.withColumnRenamed("source", "item"), ["lang", "item"]).select(
        "lang", "source", "item", (F.col("terms") * (distance(F.col("a0"), F.col("p")) - none)).alias("value")
    )
    one = used.select("lang", "term", "source", "p", F.col("p0").alias("a0"))
    two = used.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("b0"))
    p, q, a0, b0 = F.col("p"), F.col("q"), F.col("a0"), F.col("b0")
    common = one.join(two, ["lang", "term"]).where("source <> item").select(
        "lang", "source", "item", (distance(p, q) - distance(p, b0) - distance(a0, q) + distance(a0, b0)).alias("value")
    )
    unused = both.select("lang", "source", "item", (F.col("v") * none).alias("value"))
    parts = unused.unionByName(left).unionByName(right).unionByName(common)
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def source_divergence(
    docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", documents: int = DOCUMENTS, ranks: int = RANKS
) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value`` and ``rank`` of every
    source of every language.

    Part ``pair``: every other source, by the sum of squared differences of the
    terms' shares over the other's. Part ``term``: the ``ranks`` terms that the
    source uses most above its language. Ranks fall by value, then by item in
    UTF-8 order. Terms are those in at least ``documents`` documents of the
    language, copies counted.

    Null text, lang and source are ''. A group without terms, or of a language
    without kept terms, has its pairs all the same (value 0 in the latter), and
    no part ``term``. Repeated rows count as often as they occur. Other columns
    are not read. An empty table gives an empty result.
    """
    groups, counts = term_counts(docs, lang, source, text)
    whole = W.partitionBy("lang", "term")
    kept = counts.withColumns({"all": F.sum("n").over(whole), "in_lang": F.sum("df").over(whole)}).where(F.col("in_lang") >= documents)
    counts = written(kept.select("lang", "term", "group", "n", "all"), "kept-counts")
    totals = counts.groupBy("group").agg(F.sum("n").alias("total"))
    langs = counts.groupBy("lang", "term").agg(F.max("all").alias("all")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("all").alias("lang_total"))
    groups = groups.join(totals, "group", "left").join(langs, "lang", "left").fillna(0, ["total", "v", "lang_total"])
    p0 = F.when(F.col("v") > 0, share(F.lit(0), F.col("total"), F.col("v"))).otherwise(1)
    groups = written(groups.withColumn("p0", p0.cast("long")), "source-groups")
    used = counts.join(groups.drop("lang"), "group").withColumn("p", share(F.col("n"), F.col("total"), F.col("v")))
    pairs = pair_values(used, groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    q = share(F.col("all"), F.col("lang_total"), F.col("v"))
    above = used.withColumn("q", q).where("p > q")
    terms = above.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    by = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [part.withColumn("rank", F.row_number().over(by)) for part in (pairs, terms)]
    return ranked[0].unionByName(ranked[1].where(F.col("rank") <= ranks))
