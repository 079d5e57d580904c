"""Exact token counts with a shortcut for whole-token words.

The vocabulary strings that encode alone as exactly one token are found once,
by encoding each of them. A text is cut into the tokenizer's pre-tokens; those
found in that set count one each, and only the rest is merged, each distinct
one once per cache. Texts with special strings, or with characters for which
the library's Unicode rules could differ from Python's, go to the library whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

WORD_END = "</w>"

#: Merged words that a Python worker keeps before it starts anew.
CACHE_WORDS = 300_000

#: The pre-token rule of the vocabulary file, and the same for
#: lower-cased texts of characters in PLAIN.
PRE_TOKEN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
PLAIN_TOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")

#: Latin letters, ASCII and blanks; not the Latin-1 digits and fractions, the
#: dotted capital I, nor control characters.
OTHER = re.compile("[^\t\n\r\x20-\x7e -±´-¸º»¿-įı-ſ]")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class WordCounter:
    """Token counts of texts under a word-end BPE vocabulary; one per process."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        parts = json.loads(spec)
        self.special = re.compile("|".join(re.escape(t["content"]) for t in parts["added_tokens"]) or r"(?!)")
        vocab = parts["model"]["vocab"]
        self.plain = parts["model"].get("end_of_word_suffix") == WORD_END and parts["pre_tokenizer"] == {
            "type": "Sequence",
            "pretokenizers": [
                {"type": "Split", "pattern": {"Regex": PRE_TOKEN}, "behavior": "Removed", "invert": True},
                {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
            ],
        }
        self.ends = {i for token, i in vocab.items() if token.endswith(WORD_END)}
        self.whole = dict.fromkeys(self._whole_tokens(vocab), 1) if self.plain else {}
        self.merged: dict[str, int] = {}

    def _whole_tokens(self, vocab: dict[str, int]) -> Iterator[str]:
        """Words proven to encode alone as one token, by encoding each."""
        alphabet = byte_alphabet()
        words = []
        for token in vocab:
            body = token.removesuffix(WORD_END)
            if token.endswith(WORD_END) and body and all(c in alphabet for c in body):
                try:
                    word = bytes(alphabet[c] for c in body).decode()
                except UnicodeDecodeError:
                    continue
                if word == word.lower() and not OTHER.search(word) and PLAIN_TOKEN.fullmatch(word):
                    words.append(word)
        for word in words:
            if len(self.tokenizer.encode(word, add_special_tokens=False).ids) == 1:
                yield word

    def _by_library(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _merge(self, words: list[str]) -> None:
        """Count distinct pre-tokens in one call; each ends with its word-end token."""
        ids = self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids
        ends = [i for i, t in enumerate(ids) if t in self.ends]
        if len(ends) != len(words):
            self.merged.update((w, self._by_library(w)) for w in words)
            return
        last = -1
        for word, end in zip(words, ends):
            self.merged[word] = end - last
            last = end

    def counts(self, texts: Iterable[str | None]) -> list[int]:
        """Tokens of each text; null counts as empty."""
        out: list[int | None] = []
        waiting: list[tuple[int, list[str]]] = []
        for i, text in enumerate(texts):
            if not text:
                out.append(0)
            elif not self.plain or OTHER.search(text) or self.special.search(text):
                out.append(self._by_library(text))
            else:
                out.append(None)
                waiting.append((i, PLAIN_TOKEN.findall(text.lower())))
                if sum(len(words) for _, words in waiting[-64:]) > 500_000 or len(waiting) >= 64:
                    self._settle(waiting, out)
                    waiting = []
        self._settle(waiting, out)
        return out

    def _settle(self, waiting: list[tuple[int, list[str]]], out: list[int | None]) -> None:
        if len(self.merged) > CACHE_WORDS:
            self.merged = {}
        rest = set(chain.from_iterable(words for _, words in waiting)) - self.whole.keys() - self.merged.keys()
        if rest:
            self._merge(list(rest))
        whole, merged = self.whole, self.merged
        for i, words in waiting:
            ones = [merged[w] for w in words if w not in whole]
            out[i] = len(words) - len(ones) + sum(ones)


_COUNTERS: dict[int, WordCounter] = {}


def count_tokens(
    docs: DataFrame, spec: str, id: str = "doc_id", text: str = "text", limit: int = 2048
) -> DataFrame:
    """One row per row of ``docs``: its id, ``n_bytes``, ``n_tokens``, ``over_limit``.

    ``spec`` is the JSON text of the tokenizer file, read by the caller. Null
    and empty texts have no bytes and no tokens; null ids and repeated rows
    stay; other columns are not read. Whole texts are counted.
    """
    key = hash(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _COUNTERS:
            _COUNTERS[key] = WordCounter(spec)
        counter = _COUNTERS[key]
        for batch in batches:
            counts = pa.array(counter.counts(batch.column(2).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), counts], names=["id", "n_bytes", "n_tokens"])

    source = docs.select(
        F.col(f"`{id}`").alias("id"),
        F.octet_length(F.coalesce(F.col(f"`{text}`"), F.lit(""))).cast("long").alias("n_bytes"),
        F.col(f"`{text}`").alias("text"),
    )
    out = StructType([source.schema["id"], StructField("n_bytes", LongType()), StructField("n_tokens", LongType())])
    return source.mapInArrow(run, out).select(
        F.col("id").alias(id), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
