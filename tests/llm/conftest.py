from __future__ import annotations

import pytest

#: Every stage's own names, as extra columns of its input.
CLASHES = (
    "id fp digest length size n key words component_id fingerprint keep_id group_size kept target taken copies score "
    "held_out predicted label host path rule verdict piece start sequence_id offset n_bytes n_tokens record_type "
    "payload rank value segment bucket source_no at odds u v root low best"
).split()


def with_clashes(df):
    """``df`` with extra columns that operators use as names of their own."""
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHES if c not in df.columns])


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    def make(rows, schema=DOCS):
        return with_clashes(spark.createDataFrame(rows, schema))

    return make


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    long_text = "word " * 200_000
    return [
        (1, "one two three four", "en", "a", 18),
        (1, "one two three four", "en", "a", 18),
        (2, None, None, None, None),
        (3, "", "en", None, 0),
        (None, "one  two three\nfour", None, "a", None),
        (None, None, None, None, None),
        (4, long_text, "en", "b", len(long_text)),
        (5, long_text + "end", "en", "b", -1),
        (6, " \t\n", "de", "b", 3),
        (7, "ONE two three four", "en", "a", 18),
        (8, "ñandú Ærø 日本 \x1c <|endoftext|> ½", "es", "c", 9),
    ]


@pytest.fixture(scope="session")
def larger_dir(sf_dir):
    """Tables with enough labels for a fit."""
    return f"{sf_dir.rsplit('/', 1)[0]}/sf0.01"
