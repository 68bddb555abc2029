from __future__ import annotations

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalist.llm import mixing as mx
from stratalist.llm.shared import table

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def rated(spark):
    labels = mx.labelled_domains(table(spark, SF, "labels"))
    return mx.op4_mixing(spark, SF).join(labels, "doc_id", "left").toPandas()


def test_expected_tokens_match_the_targets(rated):
    p = rated[["p_plain", "p_toxic", "p_junk"]].to_numpy()
    assert np.allclose(p.sum(axis=1), 1, atol=1e-6) and (rated.rate >= 0).all()
    share = (rated.rate * rated.n_tokens).to_numpy() @ p / rated.n_tokens.sum()
    assert np.allclose(share, list(mx.TARGETS.values()), atol=1e-4)
    drawn = (rated.copies * rated.n_tokens).to_numpy() @ p / rated.n_tokens.sum()
    assert np.allclose(drawn, list(mx.TARGETS.values()), atol=0.01)


def test_posteriors_tell_the_domains(rated):
    own = rated[rated.domain.notna()]
    guess = own[["p_plain", "p_toxic", "p_junk"]].to_numpy().argmax(axis=1)
    assert (np.array(["plain", "toxic", "junk"])[guess] == own.domain).mean() > 0.9


def test_least_squares_against_brute_force(spark):
    rng = np.random.default_rng(2)
    p, t = rng.dirichlet([0.3, 0.3, 0.3], 300).round(9), rng.integers(1, 100, 300)
    rows = spark.createDataFrame([(int(x), *map(float, q)) for x, q in zip(t, p, strict=True)], "__tokens long, __p0 double, __p1 double, __p2 double")
    for target in ([0.2, 0.3, 0.5], [0.9, 0.05, 0.05], [0.0, 0.0, 1.0]):
        got = np.array([r[0] for r in rows.select(mx.rate_of(mx.fit_steps(rows, target))).collect()])
        r, x = np.ones(300), t / t.sum()
        for _ in range(5_000):
            r = np.maximum(0, r - p @ ((r * x) @ p - target))
        best = np.sum(((r * x) @ p - target) ** 2)
        assert (got >= 0).all() and np.sum(((got * x) @ p - target) ** 2) <= best + 1e-5


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "s", 1), (2, "", "s", 2), (3, "a b " * 30_000, None, 3), (3, "a b " * 30_000, None, 3)], "doc_id long, text string, source string, rate int")
    none = spark.createDataFrame([], "doc_id long, domain string")
    got = mx.document_rates(docs, none, {"x": 1.0, "y": 1.0}).collect()
    assert sorted((r.doc_id, r.n_tokens, r.p_x, r.rate) for r in got) == [(1, 0, 0.5, 1.0), (2, 0, 0.5, 1.0), (3, 60_000, 0.5, 1.0), (3, 60_000, 0.5, 1.0)]
    one = spark.createDataFrame([(3, "x"), (3, "y"), (1, "z"), (None, "x")], "doc_id long, domain string")
    mixed = mx.mix(docs, one, {"x": 1.0})
    assert mixed.columns == docs.columns and mixed.count() == 4
    assert mx.document_rates(docs.limit(0), none, {"x": 1.0}).count() == 0
    assert mx.mix(docs.where(F.lit(False)), one, {"x": 1.0}).count() == 0


def test_classifier_against_brute_force(spark):
    small = "/root/testdata/sf0.01"
    docs, domains = table(spark, small, "documents"), ["plain", "toxic", "junk"]
    labels = mx.labelled_domains(table(spark, small, "labels"))
    model = mx.fit_classifier(docs, labels, domains)
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    lowest: dict[int, int] = {}
    for r in labels.where("domain is not null").collect():
        lowest[r.doc_id] = min(domains.index(r.domain), lowest.get(r.doc_id, 9))
    own = {i: d for i, d in lowest.items() if i in text}

    def words(t: str) -> list[str]:
        return re.findall(r"[^ \t\n\x0b\f\r]+", t.lower())

    def bins(t: str) -> list[int]:
        w, n = words(t), max(len(t), 1)
        tokens = max(len(w), 1)
        share = lambda letters: sum(c in letters for c in t) / n
        found = [min(math.floor(share(mx.UPPER) * 20), 10), min(math.ceil(share(mx.SYMBOLS) * 50), 10), math.floor(len(set(w)) / tokens**0.75 * 4), min(n // tokens, 20)]
        return [max(0, min(b, 40)) for b in found]

    n = [sum(d == k for d in own.values()) for k in range(3)]
    seen: dict = {}
    for i, d in own.items():
        for f, b in enumerate(bins(text[i])):
            seen.setdefault((f, b), [0, 0, 0])[d] += 1
    assert set(seen) == set(model.bins)
    for k, v in seen.items():
        assert [math.log((c + 0.5) / (x + 20)) for c, x in zip(v, n, strict=True)] == pytest.approx(model.bins[k])
    here: dict = {}
    for i, d in own.items():
        for w in set(words(text[i])):
            here.setdefault(w, [0, 0, 0])[d] += 1
    base = [math.log(x / sum(n)) for x in n]
    assert 0 < len(model.words) <= mx.WORDS
    for w, weight in model.words.items():
        q = [(c + 0.25) / (x + 1) for c, x in zip(here[w], n, strict=True)]
        assert weight == pytest.approx([math.log(x / (1 - min(x, 0.999))) for x in q])
        base = [b + math.log(1 - min(x, 0.999)) for b, x in zip(base, q, strict=True)]
    assert base == pytest.approx(model.base)
    got = {r.doc_id: r for r in mx.document_rates(docs, labels, dict.fromkeys(domains, 1.0)).collect()}
    for i, t in text.items():
        logs = [model.base[d] + sum(model.bins[f, b][d] if (f, b) in model.bins else model.unseen[d] for f, b in enumerate(bins(t))) + sum(model.words[w][d] for w in set(words(t)) if w in model.words) for d in range(3)]
        p = np.exp(np.array(logs) - max(logs))
        assert np.allclose([got[i][f"p_{x}"] for x in domains], p / p.sum(), atol=1e-8)


def test_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b", "own", 5), (2, "c", None, 6)], "doc_id long, text string, __tokens string, __i int")
    labels = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, domain string")
    assert mx.document_rates(docs, labels, {"x": 1.0, "y": 1.0}).where("source is null").count() == 2
    got = mx.mix(docs, labels, {"x": 1.0, "y": 1.0})
    assert got.columns == docs.columns and {(r["__tokens"], r["__i"]) for r in got.collect()} <= {("own", 5), (None, 6)}
