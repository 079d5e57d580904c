from __future__ import annotations

import random
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from pathlib import Path
from zlib import crc32

import numpy as np
import pytest

from kpiloom.llm.packing import cut, pack, pack_counts, placements
from kpiloom.llm.queries import vocabulary


def best_fit_decreasing(lengths, capacity):
    gaps, bins = [], 0
    for length in sorted(lengths, reverse=True):
        at = bisect_left(gaps, length)
        if at == len(gaps):
            bins += 1
            insort(gaps, capacity - length)
        else:
            insort(gaps, gaps.pop(at) - length)
    return bins


@pytest.mark.parametrize("seed", range(40))
def test_counts_are_packed_well(seed):
    draw = random.Random(seed)
    capacity = draw.choice([7, 12, 60, 100])
    lengths = [draw.randint(1, capacity if draw.random() < 0.6 else max(1, capacity // 4)) for _ in range(draw.randint(0, 400))]
    patterns = pack_counts(Counter(lengths), capacity)
    held = Counter()
    for bins, runs in patterns:
        assert bins > 0 and sum(n * k for n, k in runs) <= capacity
        assert sum(k for n, k in runs if 3 * n > capacity) <= 2
        for n, k in runs:
            held[n] += bins * k
    assert held == Counter(lengths)
    assert sum(p.bins for p in patterns) <= max(best_fit_decreasing(lengths, capacity), 0) * 1.02 + 1


def test_work_follows_the_lengths_alone():
    patterns = pack_counts({n: 10**9 + n for n in range(1, 2049)}, 2048)
    assert len(patterns) < 3 * 2048 and len(placements(patterns)["length"]) < 6 * 2048


def test_cut():
    assert cut(1, 4) == [(0, 1)] and cut(4, 4) == [(0, 4)] and cut(5, 4) == [(0, 1), (1, 4)] and cut(8, 4) == [(0, 4), (4, 4)]


def checked(rows, got, capacity, spec):
    from tokenizers import Tokenizer

    tokenizer, want = Tokenizer.from_str(spec), []
    for ident, text, *_ in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        want += [(ident, i, s, n, crc32(ids[s : s + n].tobytes())) for i, (s, n) in enumerate(cut(len(ids), capacity))]
    assert sorted([tuple(r)[:5] for r in got], key=repr) == sorted(want, key=repr)
    by_sequence = defaultdict(list)
    for r in got:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    assert len(by_sequence) <= best_fit_decreasing([w[3] for w in want], capacity) * 1.02 + 1


@pytest.mark.parametrize("capacity", [8, 64, 2048])
def test_documents_are_packed_whole(docs, spark, sf_dir, capacity):
    spec = Path(vocabulary("byte_bpe_50k.json")).read_text()
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(120).collect()]
    checked(rows, pack(docs(rows), spec, capacity).collect(), capacity, spec)


def test_edges(docs, edge_rows):
    spec = Path(vocabulary("byte_bpe_50k.json")).read_text()
    rows = edge_rows + [(i, "same text", "en", "a", 9) for i in range(50)]
    checked(rows, pack(docs(rows), spec).collect(), 2048, spec)
    assert pack(docs([]), spec).collect() == []
