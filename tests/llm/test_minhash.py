from __future__ import annotations

import random
import re

import numpy as np
import pytest

from kpiloom.llm import minhash
from kpiloom.llm.minhash import band_keys, minhash_duplicates, shingle_set, sketch

OUT = ("doc_id", "n_shingles", "component_id", "kept")


def slow_set(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if len(words) < 2:
        return {tuple(words)} if words else set()
    return set(zip(words, words[1:]))


def slow_rows(rows):
    """The contract over all pairs."""
    sets = [slow_set(text) for _, text, *_ in rows]
    roots = list(range(len(rows)))

    def root(i):
        while roots[i] != i:
            i = roots[i]
        return i

    for i, one in enumerate(sets):
        for j in range(i):
            if one and sets[j] and 100 * len(one & sets[j]) >= 80 * len(one | sets[j]):
                roots[root(i)] = root(j)
    out = []
    for i, (id, *_) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        low = (min(ids) if ids else None) if sets[i] else id
        out.append((id, len(sets[i]), low, id == low))
    return out


def order(rows):
    return sorted(map(tuple, rows), key=repr)


def edited(words, draw, share):
    return [draw.choice("pqrstuvwxyz") * 3 + str(draw.random())[2:6] if draw.random() < share else w for w in words]


def clusters(seed, n=60):
    """Texts with edits around the threshold, copies among them."""
    draw, out = random.Random(seed), []
    for _ in range(n):
        words = [f"w{draw.randrange(400)}" for _ in range(draw.choice([1, 2, 3, 8, 40, 150]))]
        for _ in range(draw.choice([1, 1, 2, 5])):
            out.append(" ".join(edited(words, draw, draw.choice([0, 0.01, 0.05, 0.08]))))
    draw.shuffle(out)
    return [(i, t, "en", "a", len(t)) for i, t in enumerate(out)]


def test_shingles_by_hand():
    for text in ["", " \t", "one", "One TWO", "a b c a b", "É é\x0bx  y\tz", "\x1cq w e"]:
        assert shingle_set(text.encode(), 2) == {" ".join(s).encode() for s in slow_set(text)}
    assert shingle_set(None, 2) == set()


@pytest.mark.parametrize("n", [1, 3, 50, 5000])
def test_sketch_is_the_smallest_over_all_rounds(n):
    draw = np.random.default_rng(n)
    hashes = draw.integers(0, 2**63, n).astype(np.uint64)
    size = 48
    got = sketch(hashes, size)
    want = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    for r in range(2 * size):
        seed = minhash._seeds(np.array([r]))
        h = minhash._mix(hashes ^ seed)
        bins = [int(x >> 32) * size >> 32 for x in h.tolist()] if r < size else [r - size] * n
        for b, x in zip(bins, minhash._mix(h).tolist()):
            want[b] = min(int(want[b]), (x >> 16) | (r << 48))
    assert (got == want).all()


def test_sketch_chunks_change_nothing(monkeypatch):
    hashes = np.random.default_rng(1).integers(0, 2**63, 20).astype(np.uint64)
    whole = sketch(hashes, 384)
    monkeypatch.setattr(minhash, "_CHUNK", 1)
    assert (sketch(hashes, 384) == whole).all()


def test_coordinates_agree_as_often_as_the_sets():
    draw = np.random.default_rng(3)
    for n in (10, 100, 3000):
        errors = []
        for _ in range(20):
            a = draw.integers(0, 2**63, n).astype(np.uint64)
            b = np.concatenate([a[: int(0.8 * n)], draw.integers(0, 2**63, n - int(0.8 * n)).astype(np.uint64)])
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            errors.append((sketch(a, 384) == sketch(b, 384)).mean() - true)
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_band_keys_differ_by_band():
    assert len(set(band_keys(np.zeros(384, np.uint64), 64).tolist())) == 64


@pytest.mark.parametrize(("bucket", "stars"), [(16, 8), (1, 8), (1, 0), (3, 1)])
def test_against_all_pairs(spark, docs, monkeypatch, bucket, stars):
    monkeypatch.setattr(minhash, "BUCKET", bucket)
    monkeypatch.setattr(minhash, "STARS", stars)
    rows = clusters(7 + bucket + stars)
    got = minhash_duplicates(docs(rows)).select(*OUT).collect()
    assert order(got) == order(slow_rows(rows))
    assert any(a != c for a, _, c, _ in map(tuple, got))


def test_large_group_of_near_copies(spark, docs, monkeypatch):
    """Copies that link to their original and hardly to each other."""
    monkeypatch.setattr(minhash, "PARTNERS", 16)
    draw = random.Random(5)
    words = [f"w{draw.randrange(5000)}" for _ in range(120)]
    texts = [" ".join(words)] + [" ".join(edited(words, draw, 0.05)) for _ in range(150)]
    draw.shuffle(texts)
    rows = [(i, t, "en", "a", 0) for i, t in enumerate(texts)]
    assert order(minhash_duplicates(docs(rows)).select(*OUT).collect()) == order(slow_rows(rows))


@pytest.mark.parametrize("seed", [11, 12])
def test_no_similar_pair_is_lost_by_way_of_a_hub(spark, seed):
    """All nodes in one bucket, each its own root."""
    draw = random.Random(seed)
    base = [f"w{draw.randrange(5000)}" for _ in range(60)]
    other = edited(base, draw, 0.3)
    texts = [" ".join(edited(draw.choice([base, other]), draw, draw.choice([0, 0.03, 0.05, 0.1]))) for _ in range(120)]
    sets = [slow_set(t) for t in texts]
    entries = spark.createDataFrame([(1, i, len(s), (i * 7) % 120, i) for i, s in enumerate(sets)], "bucket long, node long, n long, rank long, root long")
    raw = spark.createDataFrame([(i, t.encode()) for i, t in enumerate(texts)], "node long, text binary")
    got = {tuple(r) for r in minhash._through_hubs(entries, raw, 2, 80).collect()}
    want = {(i, j) for j, b in enumerate(sets) for i, a in enumerate(sets[:j]) if 100 * len(a & b) >= 80 * len(a | b)}
    assert want <= got and len(got) < 4 * len(want) < 120 * 119 / 2


def test_edges(spark, docs, edge_rows):
    got = minhash_duplicates(docs(edge_rows))
    assert got.columns == list(OUT)
    want = [(i, n, c, i == c) for i, n, c, _ in slow_rows(edge_rows)]
    assert order(got.collect()) == order(want)
    assert minhash_duplicates(docs([])).collect() == []


def test_too_few_bands():
    with pytest.raises(ValueError, match="miss more"):
        minhash_duplicates(None, bands=4, rows=6)


def test_query_on_the_given_table(spark, sf_dir):
    from kpiloom.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert order(QUERIES["op12_minhash_neardup"](spark, sf_dir).select(*OUT).collect()) == order(slow_rows(rows))
