from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from kpiloom.llm.quality import Machine, fit_machine, hashed_words, score_quality, statistics


def rows_of(n, seed=0):
    draw, out, labels = random.Random(seed), [], []
    for i in range(n):
        words = [f"{draw.choice('abcdef')}{draw.choice('lmnop')}{draw.randint(0, 30)}" for _ in range(draw.randint(20, 80))]
        good = int(i % 4 != 0)
        text = " ".join(words) + "." if good else " ".join([words[0]] * len(words)) if i % 8 else "!! ".join(w.upper() for w in words)
        out.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, good))
    return out, labels


def test_pairs_are_summed_in_linear_time():
    draw = np.random.default_rng(2)
    machine = Machine(np.zeros((1, 1)), 0.3, draw.normal(size=50), draw.normal(size=(50, 4)))
    at, value = draw.choice(50, 9, replace=False), draw.normal(size=9)
    pairs = sum(machine.factors[at[i]] @ machine.factors[at[j]] * value[i] * value[j] for i in range(9) for j in range(i))
    z = 0.3 + machine.weights[at] @ value + pairs
    assert machine.score(at, value) == pytest.approx(1 / (1 + np.exp(-z)))


def test_held_out_accuracy(spark, docs):
    rows, labels = rows_of(800)
    got = score_quality(docs(rows), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    truth = dict(labels)
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)


def test_given_labels(spark, larger_dir):
    docs, labels = (spark.read.parquet(f"{larger_dir}/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in score_quality(docs, labels).collect()}
    held = [r for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    assert held and np.mean([got[r["doc_id"]]["predicted"] == r["quality"] for r in held]) > 0.9


def test_held_out_labels_are_not_learned(spark, docs):
    rows, labels = rows_of(300)
    turned = [(i, 1 - y) if zlib.crc32(str(i).encode()) % 5 == 0 else (i, y) for i, y in labels]
    a, b = (score_quality(docs(rows), spark.createDataFrame(x, "doc_id long, quality int")) for x in (labels, turned))
    assert sorted(r["score"] for r in a.collect()) == sorted(r["score"] for r in b.collect())


def test_edges(spark, docs, edge_rows):
    rows, labels = rows_of(60)
    known = spark.createDataFrame([(i + 1000, y) for i, y in labels] + [(None, 1), (1001, None), (5000, 1), (1002, 1)], "doc_id long, quality int")
    train = [(r[0] + 1000, *r[1:]) for r in rows]
    got = score_quality(docs(edge_rows + train), known).collect()
    assert len(got) == len(edge_rows) + len(train)
    same = [r["score"] for r in got if r["doc_id"] == 1]
    assert len(same) == 2 and same[0] == same[1]
    assert all(r["score"] is not None for r in got)
    assert score_quality(docs([]), known).collect() == []


@pytest.mark.parametrize("labels", [[], [(1, 1), (2, 1)], [(1, 0)]])
def test_one_class_gives_one_score(spark, docs, edge_rows, labels):
    got = score_quality(docs(edge_rows), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len({r["score"] for r in got}) == 1


def test_carried_columns(spark, docs, edge_rows):
    got = score_quality(docs(edge_rows), spark.createDataFrame([], "doc_id long, quality int"), carry=("text", "source")).collect()
    assert sorted((str(r["doc_id"]), str(r["source"]), len(r["text"] or "")) for r in got) == sorted(
        (str(r[0]), str(r[3]), len(r[1] or "")) for r in edge_rows
    )


def test_fit_depends_on_nothing_but_the_rows():
    rows = [(*hashed_words(t), np.array(statistics(t, n)), i % 2) for i, (_, t, _, _, n) in enumerate(rows_of(40)[0])]
    assert fit_machine(rows).packed() == fit_machine(rows).packed()


@pytest.mark.parametrize("fit_rows", [12_000, 200_000])
def test_repeated_ids_are_learned_alike_in_any_order(spark, docs, fit_rows):
    rows, labels = rows_of(90)
    rows = [(i % 30, *rest) for i, *rest in rows]  # three texts share an id
    known = spark.createDataFrame(labels[:30], "doc_id long, quality int")
    scores = []
    for turn in (rows, rows[::-1], rows[31:] + rows[:31]):
        got = score_quality(docs(turn).repartition(len(scores) + 1), known, fit_rows=fit_rows, carry=("text",)).collect()
        scores.append({r["text"]: r["score"] for r in got})
    assert scores[0] == scores[1] == scores[2] and len(set(scores[0].values())) > 10


def test_query_against_a_plain_fit(spark, larger_dir):
    """Every document's score from a machine fitted in this process."""
    from kpiloom.llm.queries import QUERIES

    rows = spark.read.parquet(f"{larger_dir}/documents.parquet").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{larger_dir}/labels.parquet").collect() if r.quality is not None}
    train = [(*hashed_words(r.text), np.array(statistics(r.text, r.n_chars)), labels[r.doc_id]) for r in rows
             if r.doc_id in labels and zlib.crc32(str(r.doc_id).encode()) % 5]
    train = [(np.asarray(at, np.int64), np.asarray(words, np.float64), stats, y) for at, words, stats, y in train]
    train.sort(key=lambda r: (r[3], len(r[0]), r[0].tolist(), r[1].tolist(), r[2].tolist()))
    machine = fit_machine(train)
    got = {r["doc_id"]: r for r in QUERIES["op3_quality_classifier"](spark, larger_dir).collect()}
    assert len(got) == len(rows)
    for r in rows:
        at, value = hashed_words(r.text)
        want = machine.score(*machine.vector(at, value, np.array(statistics(r.text, r.n_chars))))
        assert got[r.doc_id]["score"] == pytest.approx(want, rel=1e-5)
        assert got[r.doc_id]["predicted"] == int(got[r.doc_id]["score"] >= 0.3)
