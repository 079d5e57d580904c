"""The named queries of this subpackage, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiloom.llm.common import table
from kpiloom.llm.divergence import source_divergence
from kpiloom.llm.exact import exact_dedup
from kpiloom.llm.licenses import TEMPLATES, scan_licenses
from kpiloom.llm.minhash import minhash_duplicates
from kpiloom.llm.mixing import mix
from kpiloom.llm.packing import pack
from kpiloom.llm.quality import score_quality
from kpiloom.llm.simhash import near_duplicates
from kpiloom.llm.tokens import count_tokens
from kpiloom.llm.topk import top_k
from kpiloom.llm.urlrules import Rule, judge_urls
from kpiloom.llm.warc import archive_round_trip
from kpiloom.llm.whitening import whiten

#: The rules of the URL filter.
URL_RULES = (
    Rule("allow", "org/"),
    Rule("block", "example.org/es/"),
    Rule("block", "example.org/en/1"),
    Rule("allow", "com/fr/"),
    Rule("block", "com/de/"),
)


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, distance=2)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates of all documents, and which row of each group stays."""
    return exact_dedup(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), label="quality", threshold=0.3)


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from every document."""
    return mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), most=3).drop("copies")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices, headers and texts anywhere in all documents."""
    found = scan_licenses(table(spark, sf_dir, "documents"), TEMPLATES, threshold=0.8)
    return found.withColumn("dice", F.round("dice", 6))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the address of every page."""
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    spec = Path(vocabulary("byte_bpe_50k.json")).read_text()
    return pack(table(spark, sf_dir, "documents"), spec, capacity=2048)


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best neighbours of every fiftieth vector among all others."""
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def op9_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to WARC archives and read back."""
    return archive_round_trip(table(spark, sf_dir, "pages"), shortest=1000)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole document under the word-end vocabulary."""
    spec = Path(vocabulary("word_bpe_49k.json")).read_text()
    return count_tokens(table(spark, sf_dir, "documents"), spec, limit=2048)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors on the eight largest principal components, whitened."""
    scores = whiten(table(spark, sf_dir, "embeddings"), components=8)
    return scores.withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share four fifths of their word pairs."""
    return minhash_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language are apart, and by which terms."""
    return source_divergence(table(spark, sf_dir, "documents"), documents=3, ranks=200)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_simhash_neardup,
        op2_exact_dedup,
        op3_quality_classifier,
        op4_source_mix,
        op5_license_scan,
        op6_url_filter,
        op7_best_fit_packing,
        op8_exact_topk,
        op9_warc_round_trip,
        op10_token_counts,
        op11_embedding_whitening,
        op12_minhash_neardup,
        op13_source_divergence,
    )
}

_TEMPLATES = ", ".join(f"('{name}', {i}, '{text}')" for name, texts in TEMPLATES.items() for i, text in enumerate(texts))
_WORDS = (
    r"list_filter(string_split(regexp_replace(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    r"'abcdefghijklmnopqrstuvwxyz'), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '')"
)

ORACLES: dict[str, str] = {
    "op2_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), r AS (
  SELECT *, row_number() OVER w AS place, first_value(doc_id) OVER w AS keep_id,
    count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id ASC NULLS LAST)
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM r""",
    "op5_license_scan": rf"""
WITH tw AS (
  SELECT license, template, {_WORDS.format(text="body")} AS w FROM (VALUES {_TEMPLATES}) AS v(license, template, body)
), t AS (
  SELECT license, template, floor(len(w) * 1.5 + 1e-9) - 1 AS longest,
    list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS pairs FROM tw
), tp AS (SELECT license, template, longest, len(pairs) AS b, unnest(pairs) AS pair FROM t
), d AS (
  SELECT row_number() OVER () AS r, doc_id, sha256(coalesce(text, '')) AS text_sha256, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents
), p AS (SELECT r, unnest(range(1, len(w))) AS i, w FROM d WHERE len(w) > 1
), pos AS MATERIALIZED (SELECT r, i, w[i] || ' ' || w[i + 1] AS pair FROM p
), h AS MATERIALIZED (
  SELECT pos.r, i, license, template, pair, b, longest FROM pos JOIN tp USING (pair)
  QUALIFY count(DISTINCT pair) OVER (PARTITION BY pos.r, license, template) >= b / 1.5 - 1e-9
), win AS (
  SELECT x.r, x.license, x.template, x.b, x.i AS s, y.i AS e
  FROM h AS x JOIN h AS y ON x.r = y.r AND x.license = y.license AND x.template = y.template
    AND y.i BETWEEN x.i AND x.i + x.longest - 1
), shared AS (
  SELECT win.r, win.license, win.template, win.b, s, e, count(DISTINCT pair) AS c
  FROM win JOIN h ON h.r = win.r AND h.license = win.license AND h.template = win.template AND h.i BETWEEN s AND e
  GROUP BY ALL HAVING c >= win.b / 1.5 - 1e-9
), sized AS (
  SELECT shared.r, license, template, b, s, e, c, count(DISTINCT pair) AS a
  FROM shared JOIN pos ON pos.r = shared.r AND pos.i BETWEEN s AND e GROUP BY ALL
), judged AS (
  SELECT *, CAST(2 * c AS DOUBLE) / CAST(a + b AS DOUBLE) AS dice FROM sized
)
SELECT doc_id, text_sha256, license, round(dice, 6) AS dice, CAST(template AS INTEGER) AS template, s - 1 AS start,
  CAST(e - s + 2 AS INTEGER) AS words
FROM judged JOIN d USING (r) WHERE dice >= 0.8
QUALIFY row_number() OVER (PARTITION BY r, license ORDER BY dice DESC, template, s, e) = 1""",
    "op6_url_filter": r"""
WITH rules(rule, verdict, host, path) AS (VALUES
  ('org/', 'allow', 'org', '/'), ('example.org/es/', 'block', 'example.org', '/es/'),
  ('example.org/en/1', 'block', 'example.org', '/en/1'), ('com/fr/', 'allow', 'com', '/fr/'),
  ('com/de/', 'block', 'com', '/de/')
), p AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), u AS (SELECT DISTINCT host, path FROM p), b AS (
  SELECT u.host, u.path, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS verdict
  FROM u JOIN rules AS r
    ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
  GROUP BY u.host, u.path
)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict
FROM p LEFT JOIN b ON p.host = b.host AND p.path = b.path""",
    "op8_exact_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op9_warc_round_trip": """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT payload_digest, max(page_id) AS response FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN response IS DISTINCT FROM page_id AND response IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN response IS DISTINCT FROM page_id THEN response END AS refers_to
FROM p LEFT JOIN g USING (payload_digest)""",
    "op13_source_divergence": r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), t AS (
  SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), k AS (
  SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 3
), l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang
), c AS (
  SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN k ON t.lang = k.lang AND t.term = k.term GROUP BY ALL
), g AS (
  SELECT s.lang, s.source, coalesce(sum(c.n), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM d) AS s LEFT JOIN c ON s.lang = c.lang AND s.source = c.source GROUP BY ALL
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1) // CAST(g.total + l.v AS HUGEINT) AS p,
    1 + CAST(1000000000 AS HUGEINT) * (k.n + 1) // CAST(l.total + l.v AS HUGEINT) AS q
  FROM g JOIN k ON g.lang = k.lang JOIN l ON l.lang = g.lang
    LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), f AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
  FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q
), o AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM o WHERE part = 'pair' OR rank <= 200""",
}
