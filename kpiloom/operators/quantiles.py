"""Exact quantiles without gathering a column in one task."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Accuracy of the sketch that places the bounds around a rank.
ACCURACY = 10_000

#: Distinct values between two bounds that one task ranks.
MOST = 100_000


@dataclass(frozen=True)
class Spot:
    """A wanted quantile and the values between which it is known to lie:
    ``before`` rows are below ``low``, ``inside`` rows from there to ``high``."""

    column: int
    p: float
    first: int
    second: int
    weight: float
    low: float
    high: float
    before: int
    inside: int
    distinct: int

    def holds(self) -> bool:
        return self.before <= self.first and self.second < self.before + self.inside


def known(c: str | Column) -> Column:
    """The value as a double; NaN counts as missing."""
    v = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(~F.isnan(v), v)


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], accuracy: int = ACCURACY, most: int = MOST
) -> DataFrame:
    """Linear-interpolated quantiles: one row per (metric, p); columns without
    known values give none.

    Each pass reads all columns once. The first counts; then a mergeable sketch
    of the values between the bounds, and a count of the rows below and between
    the ones it proposes, narrow them some ``accuracy``-fold, until they hold
    at most about ``most`` distinct values. Those are counted on the map side
    and ranked. Bounds follow the ranks and not the range, so that a heavy tail
    does not widen them; bounds that turn out to miss a rank are not taken.
    The driver sees a few numbers per column and quantile.
    """
    values = df.select(*[known(c).alias(f"v{i}") for i, c in enumerate(columns)])
    spots = _narrowed(values, _whole(values, len(columns), probs), accuracy, most)
    schema = "metric string, p double, value double"
    if not spots:
        return df.sparkSession.createDataFrame([], schema)
    return _ranked(values, spots, columns)


def _whole(values: DataFrame, columns: int, probs: Sequence[float]) -> list[Spot]:
    """Every spot between the smallest and the largest value."""
    row = values.agg(
        *[f(f"v{i}").alias(f"{name}{i}") for i in range(columns) for name, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]
    ).first()
    spots = []
    for i in range(columns):
        n = row[f"n{i}"]
        for p in probs if n else ():
            h = p * (n - 1)
            spots.append(Spot(i, float(p), math.floor(h), math.ceil(h), h - math.floor(h), row[f"lo{i}"], row[f"hi{i}"], 0, n, n))
    return spots


def _inside(spot: Spot) -> Column:
    v = F.col(f"v{spot.column}")
    return F.when((v >= F.lit(spot.low)) & (v <= F.lit(spot.high)), v)


def _narrowed(values: DataFrame, spots: list[Spot], accuracy: int, most: int) -> list[Spot]:
    """Narrow the bounds of all spots until few distinct values are left."""
    open_ = [k for k, s in enumerate(spots) if s.low < s.high]
    while open_:
        proposed = _sketched(values, [spots[k] for k in open_], accuracy)
        counted = _counted(values, proposed)
        left = []
        for k, spot in zip(open_, counted):
            narrower = spot.holds() and spot.inside < spots[k].inside
            if narrower:
                spots[k] = spot
            if narrower and spot.distinct > most and spot.low < spot.high:
                left.append(k)
        open_ = left
    return spots


def _sketched(values: DataFrame, spots: list[Spot], accuracy: int) -> list[Spot]:
    """Bounds from a sketch of the rows inside, two of its errors apart."""
    sketches, sides = [], []
    for k, s in enumerate(spots):
        margin = 2.0 / accuracy
        a = (s.first - s.before) / s.inside - margin
        b = (s.second + 1 - s.before) / s.inside + margin
        sides.append((a > 0, b < 1))
        sketches.append(F.percentile_approx(_inside(s), [max(a, 0.0), min(b, 1.0)], accuracy).alias(f"q{k}"))
    row = values.agg(*sketches).first()
    return [
        replace(s, low=row[f"q{k}"][0] if lower else s.low, high=row[f"q{k}"][1] if upper else s.high)
        for k, (s, (lower, upper)) in enumerate(zip(spots, sides))
    ]


def _counted(values: DataFrame, spots: list[Spot]) -> list[Spot]:
    """Rows below and between the bounds, and about how many distinct values."""
    parts = []
    for k, s in enumerate(spots):
        parts += [
            F.count_if(F.col(f"v{s.column}") < F.lit(s.low)).alias(f"b{k}"),
            F.count(_inside(s)).alias(f"n{k}"),
            F.approx_count_distinct(_inside(s)).alias(f"d{k}"),
        ]
    row = values.agg(*parts).first()
    return [replace(s, before=row[f"b{k}"], inside=row[f"n{k}"], distinct=row[f"d{k}"]) for k, s in enumerate(spots)]


def _ranked(values: DataFrame, spots: list[Spot], columns: Sequence[str]) -> DataFrame:
    """Rank the distinct values between the bounds, and interpolate."""
    spark = values.sparkSession
    hits = F.array(*[F.struct(F.lit(k).alias("spot"), _inside(s).alias("v")) for k, s in enumerate(spots)])
    inside = values.select(F.explode(F.filter(hits, lambda h: h["v"].isNotNull())).alias("h")).select("h.spot", "h.v")
    counted = inside.groupBy("spot", "v").agg(F.count(F.lit(1)).alias("n"))
    upto = W.partitionBy("spot").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    rows = [(k, columns[s.column], s.p, s.first - s.before, s.second - s.before, s.weight) for k, s in enumerate(spots)]
    wanted = spark.createDataFrame(rows, "spot int, metric string, p double, r0 long, r1 long, weight double")
    places = counted.withColumn("after", F.sum("n").over(upto)).join(F.broadcast(wanted), "spot")
    at = lambda rank: F.min(F.when(F.col("after") > F.col(rank), F.col("v")))
    found = places.groupBy("spot", "metric", "p", "weight").agg(at("r0").alias("v0"), at("r1").alias("v1"))
    return found.select("metric", "p", (F.col("v0") + (F.col("v1") - F.col("v0")) * F.col("weight")).alias("value"))
