"""Operator 11 against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalist.llm import hard_negatives as hn


def brute(rows, anchors, positives=5, negatives=10, low=30, high=90):
    """rows: (id, label, vector); Python integers all the way."""
    usable = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        usable[i] = min(usable.get(i, (label, v)), (label, v))
    q = {i: (label, [math.floor(256 * x) for x in v]) for i, (label, v) in usable.items()}
    out = []
    for a in filter(anchors, q):
        scored = [(-sum(x * y for x, y in zip(q[a][1], v, strict=False)), i, label) for i, (label, v) in q.items() if i != a]
        for p, pid, _ in sorted(x for x in scored if x[2] == q[a][0])[:positives]:
            fits = sorted((n, i) for n, i, label in scored if label != q[a][0] and low * -p <= 100 * -n <= high * -p)
            out += [(a, pid, k + 1, i, -p, -n) for k, (n, i) in enumerate(fits[:negatives])]
    return sorted(out)


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 70, 5), (64, 64, 64), (130, 67, 257), (200, 128, 99)])
def test_strassen_is_exact(shape):
    rng = np.random.default_rng(sum(shape))
    m, k, n = shape
    a, b = rng.integers(-(2**24), 2**24, (m, k)), rng.integers(-(2**24), 2**24, (n, k))
    assert (hn.strassen(a, b) == a @ b.T).all()


def test_heaps_merge_in_any_order():
    rng = np.random.default_rng(3)
    scores = rng.integers(-3, 4, (4, 900))  # many ties
    one, two, three = (hn.Heaps(4, 7) for _ in range(3))
    ids, every = np.arange(900), np.ones((4, 900), bool)
    one.push(np.arange(4), scores, ids, every)
    two.push(np.arange(4), scores[:, 500:], ids[500:], every[:, 500:])
    three.push(np.arange(4), scores[:, :500], ids[:500], every[:, :500])
    two.merge(np.arange(4), three.scores, three.ids)
    want = [sorted((-s, i) for i, s in enumerate(row))[:7] for row in scores.tolist()]
    for h in (one, two):
        assert [[(-s, i) for s, i in zip(a, b, strict=True)] for a, b in zip(h.scores.tolist(), h.ids.tolist(), strict=True)] == want


def rows_of(n, dim, seed, labels=3):
    rng = np.random.default_rng(seed)
    v = np.round(rng.normal(0, 0.3, (n, dim)), 2)
    v[rng.random(n) < 0.33] = v[0]  # one common vector
    return [(i, int(rng.integers(labels)), x.tolist()) for i, x in enumerate(v)]


@pytest.mark.parametrize("block", [2, 1000])
def test_all_rows_equal_brute_force(spark, block):
    rows = rows_of(400, 9, 1)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(5)
    rows = [(r.vec_id, r.label, r.embedding) for r in df.collect()]
    got = hn.hard_negatives(df, F.col("id") % 40 == 0, block=block)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 40 == 0)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = rows_of(60, 4, 2, labels=2) + [
        (None, 1, [1.0] * 4), (100, None, [1.0] * 4), (101, 1, None), (102, 1, [1.0, None, 0.0, 0.0]), (103, 0, [nan, 0.0, 0.0, 0.0]), (104, 0, [inf, 0.0, 0.0, 0.0]),
        (105, 1, []), (106, 0, [0.5, 0.25]), (5, 1, [0.5] * 4), (5, 1, [0.5] * 4), (20, 0, [0.1] * 6),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<double>, id string, score int")
    got = hn.hard_negatives(df, F.col("id") % 10 == 0)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 10 == 0)


def test_empty_and_alone(spark):
    kinds = "vec_id long, label int, embedding array<float>"
    assert hn.hard_negatives(spark.createDataFrame([], kinds), F.lit(True)).collect() == []
    assert hn.hard_negatives(spark.createDataFrame([(0, 1, [1.0]), (1, 2, [0.5])], kinds), F.lit(True)).collect() == []  # no positives
    with pytest.raises(Exception, match="too long"):
        hn.hard_negatives(spark.createDataFrame([(0, 1, [1e9]), (1, 1, [1e9])], kinds), F.lit(True)).collect()
