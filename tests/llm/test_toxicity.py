"""Operator 12: interactions that additive weights miss, held-out accuracy, and odd rows."""

from __future__ import annotations

import math
import zlib
from dataclasses import replace

import numpy as np
import pytest

from stratalist.llm import toxicity as tx

DOCS, LABELS = "doc_id long, text string, lang string", "doc_id long, toxic int"


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def made(n, seed=0):
    """Toxic where an insult meets the name of a group; two insults or two groups are not."""
    rng = np.random.default_rng(seed)
    insults, groups, rest = ["vermin", "filth", "plague"], ["martians", "lunarians", "venusians"], [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)]
    out = []
    for i in range(n):
        words = rng.choice(rest, 12).tolist()
        kind = int(rng.integers(4))
        a, b = rng.permutation(3)[:2]
        words += [[insults[a], groups[b]], [insults[a], insults[b]], [groups[a], groups[b]], []][kind]
        out.append((i, " ".join(words), int(kind == 0)))
    return out


def test_pairs_tell_what_single_weights_cannot(spark):
    rows = made(1_500)
    docs = spark.createDataFrame([(i, t, "en") for i, t, _ in rows], DOCS).repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], LABELS)
    right = {}
    for factors in (0, 8):
        model = tx.fit_model(docs, labels, replace(tx.Fit(), factors=factors, steps=3_000))
        found = {r.doc_id: r for r in tx.classify(docs, model).collect()}
        own = [(y, found[i].predicted) for i, _, y in rows if held(i)]
        right[factors] = sum(a == b for a, b in own) / len(own)
        assert all(found[i].held_out == held(i) for i, _, _ in rows)
    assert right[8] > 0.97 and right[8] > right[0] + 0.1


def test_the_value_is_the_sum_of_all_pairs():
    rng = np.random.default_rng(1)
    m = tx.Model(8, {i: i for i in range(6)}, 0.3, rng.normal(size=6), rng.normal(size=(6, 3)))
    rows = [[], [2], [0, 3, 5], [1, 2, 3, 4], []]
    want = [m.bias + sum(m.weights[i] for i in r) + sum(m.factors[i] @ m.factors[j] for i in r for j in r if i < j) for r in rows]
    assert np.allclose(tx.probabilities(rows, m), 1 / (1 + np.exp(-np.array(want))))


def test_counts_of_terms_equal_brute_force(spark):
    texts = [(1, "Bad bad weather"), (0, "weather"), (1, None), (0, ""), (1, "weathering bad")]
    got = {r.bucket: (r.toxic, r.clean) for r in tx._term_counts(spark.createDataFrame(texts, "toxic int, text string").repartition(3), tx.Fit()).collect()}
    want: dict = {}
    for toxic, t in texts:
        words = set((t or "").lower().split())
        for b in {zlib.crc32(x.encode()) % tx.Fit().buckets for w in words for x in ["=" + w, *("^" + w[:n] for n in (4, 5, 6) if len(w) >= n)]}:
            k = want.setdefault(b, [0, 0])
            k[1 - toxic] += 1
    assert got == {b: tuple(k) for b, k in want.items()}


def test_likelihood_ratio(spark):
    a, b, n, m = 7, 2, 20, 30
    part = lambda k, n, p: k * math.log(p) + (n - k) * math.log(1 - p)
    want = part(a, n, a / n) + part(b, m, b / m) - part(a, n, (a + b) / (n + m)) - part(b, m, (a + b) / (n + m))
    row = spark.sql(f"select {a} a, {b} b").select(tx.likelihood_ratio(*(tx.F.col(c) for c in "ab"), n, m).alias("x")).first()
    assert row.x == pytest.approx(want)


def test_held_out_documents_of_the_smoke_tables(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = tx.classify(docs, tx.fit_model(docs, labels)).join(labels, "doc_id").collect()
    assert docs.count() == tx.op12_toxicity(spark, sf).count()
    clean = [r for r in rows if r.held_out and r.toxic == 0]
    assert sum(r.predicted for r in clean) / len(clean) < 0.02
    seen = [r for r in rows if not r.held_out and r.toxic == 1]
    assert sum(r.predicted for r in seen) / len(seen) > 0.9


def test_odd_rows(spark):
    rows = made(300, 3)
    more = [(900, None), (901, ""), (902, "vermin martians " * 50_000), (903, "vermin martians"), (903, "vermin martians"), (None, "vermin martians"), (904, "퟿ é 漢字漢字漢字漢字 " * 20)]
    docs = spark.createDataFrame([(i, t, "en", "x", 1) for i, t, *_ in rows + more], DOCS + ", score string, features int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(0, 1), (0, 0), (None, 1), (7, None), (5_000, 1)], LABELS)
    model = tx.fit_model(docs, labels, replace(tx.Fit(), rows=200))
    got = tx.classify(docs, model).collect()
    assert len(got) == len(rows) + len(more)
    by = {r.doc_id: r.score for r in got}
    assert by[900] == by[901] == pytest.approx(1 / (1 + math.exp(-model.bias)))
    assert by[902] == pytest.approx(by[903]) and all(0 <= r.score <= 1 for r in got)
    assert {r.predicted for r in got if r.doc_id == 903} == {int(by[903] >= 0.5)} and None in by
    again = tx.fit_model(docs, labels, replace(tx.Fit(), rows=200))
    assert again.feature == model.feature and np.array_equal(again.weights, model.weights)


def test_no_or_one_class(spark):
    docs = spark.createDataFrame([(1, "a b", "en"), (3, None, "en")], DOCS)
    for labels, want in (([], 0.5), ([(1, 1), (3, 1)], 1.0), ([(1, 0), (3, 0)], 0.0)):
        scores = [r.score for r in tx.classify(docs, tx.fit_model(docs, spark.createDataFrame(labels, LABELS))).collect()]
        assert scores == pytest.approx([want] * 2, abs=1e-9)
    none = spark.createDataFrame([], DOCS)
    assert tx.classify(none, tx.fit_model(none, spark.createDataFrame([], LABELS))).collect() == []
