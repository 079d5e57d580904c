from __future__ import annotations

import random
from pathlib import Path

import pytest

from kpiloom.llm.packing import ByteEncoder
from kpiloom.llm.queries import vocabulary
from kpiloom.llm.tokens import WordCounter, count_tokens

ODD = ["", " ", "a", "don't I'LL'S", "<|endoftext|>a<|startoftext|> b", "<|ENDOFTEXT|>", "İstanbul ΣΑΣ ½ ² ³", "日本語 text", "á é", "\x1c\x85\xa0x",
       "__a_1_", "'''s", "x" * 3000, "ﬁ ŉ ſ ª º µ", "café 123 4,5%", " a b"]


@pytest.fixture(scope="module")
def word_spec():
    return Path(vocabulary("word_bpe_49k.json")).read_text()


def library(spec, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(spec)
    return [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def noise(seed, n):
    draw = random.Random(seed)
    alphabet = "aB'sStTé ñ_1 9\n\t\xa0!?.ßŉſªºµÀŸ\xad<|>éd"
    return ["".join(draw.choices(alphabet, k=draw.randint(0, 40))) for _ in range(n)]


def test_counts_are_the_library_s(word_spec, spark, sf_dir):
    texts = ODD + noise(1, 3000) + [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    counter = WordCounter(word_spec)
    assert counter.plain and len(counter.whole) > 10_000
    want = [len(i) for i in library(word_spec, texts)]
    assert counter.counts(texts) == want
    assert counter.counts(texts) == want  # from the cache


def test_whole_tokens_are_proven(word_spec):
    whole = list(WordCounter(word_spec).whole)[::97]
    assert all(len(i) == 1 for i in library(word_spec, whole))


def test_other_vocabularies_go_to_the_library():
    spec = Path(vocabulary("byte_bpe_50k.json")).read_text()
    counter = WordCounter(spec)
    assert not counter.plain
    assert counter.counts(ODD) == [len(i) for i in library(spec, ODD)]


def test_edges(docs, edge_rows, word_spec):
    got = [tuple(r) for r in count_tokens(docs(edge_rows), word_spec).collect()]
    counts = [len(i) for i in library(word_spec, [r[1] for r in edge_rows])]
    want = [(r[0], len((r[1] or "").encode()), n, n > 2048) for r, n in zip(edge_rows, counts)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert count_tokens(docs([]), word_spec).collect() == []


def test_byte_ids_are_the_library_s(spark, sf_dir):
    spec = Path(vocabulary("byte_bpe_50k.json")).read_text()
    texts = ODD + noise(2, 3000) + [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    encoder = ByteEncoder(spec)
    assert encoder.same
    assert [encoder.ids(t) for t in texts] == library(spec, texts)
