"""Hubs of crowded buckets: few for each set, and no link lost."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from kpiloom.llm import minhash
from kpiloom.llm.minhash import minhash_duplicates, shingle_set


def expected_components(texts: list[str]) -> int:
    sets = [shingle_set(t.encode(), 2) for t in texts]
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if 100 * common >= 80 * (len(a) + len(sets[j]) - common):
                root[find(i)] = find(j)
    return sum(find(i) == i for i in range(len(sets)))


def test_rows_outside_hubs_grow_with_the_group(spark, monkeypatch):
    """Each set of a group of near copies meets few hubs, not one per band."""
    rng = random.Random(1)
    words = [f"w{i}" for i in range(5000)]
    base = [rng.choice(words) for _ in range(120)]
    texts = [" ".join(rng.choice(words) if rng.random() < 0.045 else w for w in base) for _ in range(240)]
    members, kept = [], minhash.written

    def written(df, name):
        out = kept(df, name)
        if name == "hub-members":
            members.append((out.count(), out.select("v").distinct().count()))
        return out

    monkeypatch.setattr(minhash, "written", written)
    got = minhash_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert got.agg(F.count_distinct("component_id")).first()[0] == expected_components(texts)
    assert len(members) == 1 and members[0][0] <= 1.5 * members[0][1]
