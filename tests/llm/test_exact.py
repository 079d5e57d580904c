from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from kpiloom.llm import exact
from kpiloom.llm.exact import PerfectHash, digest_table, exact_dedup, exact_groups


def digests(n, seed=0):
    return np.frombuffer(b"".join(hashlib.sha256(f"{seed}-{i}".encode()).digest() for i in range(n)), np.uint8).reshape(-1, 32)


@pytest.mark.parametrize("n", [0, 1, 2, 17, 5000])
def test_hash_is_minimal_and_perfect(n):
    keys = digests(n)
    function = PerfectHash.build(keys)
    again = PerfectHash.unpacked(function.sizes, function.packed())
    assert sorted(again.slots(keys).tolist()) == list(range(n))
    others = again.slots(digests(1000, 1))
    assert ((others >= -1) & (others < max(n, 1))).all()


def by_hand(rows):
    groups = {}
    for row in rows:
        bare = re.sub(r"[\x20\x09-\x0D]", "", row[1] or "")
        groups.setdefault(hashlib.sha256(bare.encode()).hexdigest(), []).append(row)
    out = []
    for digest, group in groups.items():
        order = sorted(group, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        out += [(r[0], order[0][0], len(group), k == 0, digest) for k, r in enumerate(order)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("share", [0.0, 0.3, 0.5, 1.0])
def test_split_changes_nothing(docs, monkeypatch, share):
    monkeypatch.setattr(exact, "SHARD_KEYS", 8)
    draw = random.Random(1)
    rows = [(i, draw.choice(["a b", "ab", " a b ", "", "é", "e", "x" * i, "x" * 5]), "en", "s", 1) for i in range(150)]
    got = sorted([tuple(r) for r in exact_dedup(docs(rows), newer_share=share).collect()], key=repr)
    assert got == by_hand(rows)


def test_edges(docs, edge_rows):
    got = sorted([tuple(r) for r in exact_dedup(docs(edge_rows)).collect()], key=repr)
    assert got == by_hand(edge_rows)
    assert exact_dedup(docs([])).collect() == []


def test_newer_rows_against_a_history(docs):
    old = digest_table(docs([(1, "a b", "", "", 0), (2, "c", "", "", 0)]))
    new = digest_table(docs([(3, "ab", "", "", 0), (4, "d", "", "", 0), (5, "a  b", "", "", 0)]))
    got = {r["id"]: (r["length"], r["n"]) for r in exact_groups(new, old).collect()}
    assert got == {5: (4, 3), 2: (1, 1), 4: (1, 1)}


def test_slots_are_checked_byte_by_byte(spark):
    keys = digests(50)
    function = PerfectHash.build(keys)
    strangers = digests(500, 9)
    slots = function.slots(strangers)
    hits = slots >= 0
    assert hits.any()
    assert not (keys[slots[hits]] == strangers[hits]).all(axis=1).any()


def test_shards_follow_the_larger_side(docs, monkeypatch):
    seen, merge = [], exact.merge_newer
    monkeypatch.setattr(exact, "SHARD_KEYS", 10)
    monkeypatch.setattr(exact, "merge_newer", lambda index, newer, shards: seen.append((newer.count(), shards)) or merge(index, newer, shards))
    rows = [(None, f"text {i}", "en", "a", 1) for i in range(200)]
    assert exact.exact_dedup(docs(rows)).where("kept").count() == 200
    newer, shards = seen.pop()
    assert 60 < newer < 140 and shards >= 10
    assert exact.exact_dedup(docs(rows), newer_share=1.0).where("kept").count() == 200
    assert seen == [(200, 20)]
