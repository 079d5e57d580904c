"""URL filter rules, indexed by their rarest literal token.

A rule ``host/path`` fits the host and its subdomains when the path starts with
the rule's. Each rule stands in the index under one of its complete literal
tokens: the one that the fewest URLs hold. The tokens of a URL fetch candidate
rules, and only those run their regular expression. DataFrame functions only.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Up to so many rules (some 200 bytes each) the index is broadcast.
BROADCAST_RULES = 50_000

#: Token of rules without a complete literal token; every URL has it.
ANY = "*"


class Rule(NamedTuple):
    verdict: str
    pattern: str


def host_of(url: Column) -> Column:
    """Text after the first ``://`` up to ``/``, ``?``, ``#``; A-Z lower-cased."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """Text after the host up to ``?`` or ``#``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct complete tokens: labels of the host, segments of the path."""
    labels = F.transform(F.split(host, r"\."), lambda t: F.concat(F.lit("h:"), t))
    segments = F.transform(F.split(path, "/"), lambda t: F.concat(F.lit("p:"), t))
    return F.array_distinct(F.concat(labels, segments, F.array(F.lit(ANY))))


def rule_tokens(pattern: str) -> list[str]:
    """Tokens that every URL fitting the rule holds as complete ones."""
    host, _, path = pattern.partition("/")
    tokens = [f"h:{t}" for t in host.split(".") if t] + [f"p:{t}" for t in path.split("/")[:-1] if t]
    return tokens or [ANY]


def rule_regex(pattern: str) -> str:
    host, slash, path = pattern.partition("/")
    start = rf"^(?:[^/]*\.)?{re.escape(host)}" if host else "^[^/]*"
    return start + re.escape(slash + path)


def rules_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    rows = [(r.pattern, r.verdict, rule_regex(r.pattern), rule_tokens(r.pattern)) for r in rules]
    return spark.createDataFrame(rows, "rule string, verdict string, regex string, tokens array<string>")


def rarest_token_index(rules: DataFrame, tokens: DataFrame, small: bool) -> DataFrame:
    """Each rule under its token with the lowest count in ``tokens`` (one row
    per URL and token); ties go to the token first in order."""
    wanted = rules.select(F.explode("tokens").alias("token")).distinct()
    counted = tokens.join(F.broadcast(wanted) if small else wanted, "token", "left_semi").groupBy("token").count()
    return (
        rules.select("rule", "verdict", "regex", F.explode("tokens").alias("token"))
        .join(counted, "token", "left")
        .groupBy("rule", "verdict", "regex")
        .agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), F.col("token").alias("token"))).alias("rarest"))
        .select("rule", "verdict", "regex", F.col("rarest.token").alias("token"))
    )


def judge_urls(pages: DataFrame, rules: Sequence[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """All rows and columns of ``pages`` but earlier ones of the names below,
    with host, path, rule and verdict.

    The longest fitting rule decides, of equally long ones the one last in
    order; without one, rule is null and the verdict is ``default``. A null URL,
    or one without ``://``, has an empty host and path and fits no rule with a
    host. Repeated rows stay; each distinct URL is judged once. No rules: all
    rows get ``default``.
    """
    made = ("host", "path", "rule", "verdict")
    kept = [c for c in pages.columns if c not in made]
    address = F.col(f"`{url}`")
    parsed = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), host_of(address).alias("host"), path_of(address).alias("path"))
    given = [F.col(f"row.`{c}`") for c in kept]
    if not rules:
        return parsed.select(*given, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    small = len(rules) <= BROADCAST_RULES
    listed = rules_table(pages.sparkSession, rules)
    urls = parsed.select("host", "path").distinct()
    tokens = urls.select("host", "path", F.explode(url_tokens(F.col("host"), F.col("path"))).alias("token"))
    index = rarest_token_index(listed, tokens.select("token"), small)
    decided = (
        tokens.join(F.broadcast(index) if small else index, "token")
        .where(F.expr("rlike(concat(host, path), regex)"))
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("rule").alias("n"), F.col("rule"), F.col("verdict"))).alias("best"))
    )
    return parsed.join(decided, ["host", "path"], "left").select(
        *given,
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
