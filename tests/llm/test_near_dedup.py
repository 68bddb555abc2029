from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from stratalist.llm import near_dedup as nd
from stratalist.operators.components import connected_components
from stratalist.llm.shared import table


def brute(rows: list[tuple[int, str | None]], k: int, percent: int) -> dict[int, tuple[int, int]]:
    sets = {}
    for i, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for c in "\t\n\x0b\x0c\r":
            w = w.replace(c, " ")
        w = [x for x in w.split(" ") if x]
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    ids, find = sorted(sets), {i: i for i in sets}

    def root(i):
        while find[i] != i:
            i = find[i]
        return i

    where: dict = {}
    for i in ids:
        for s in sets[i]:
            where.setdefault(s, []).append(i)
    pairs = {(a, b) for v in where.values() for a in v for b in v if a < b}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            find[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def made() -> list[tuple[int, str | None]]:
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base, rows = [word() for _ in range(150)], []
    for i in range(250):  # one group with copies of every strength
        w = [*base]
        for _ in range(rng.randint(0, 12)):
            w[rng.randrange(150)] = word()
        rows.append((1000 + i, rng.choice([" ", "\n"]).join(w)))
    chain = [word() for _ in range(200)]
    for i in range(40):  # each like the next, the ends unlike
        rows.append((100 + i, " ".join(chain)))
        chain = [*chain[8:], *(word() for _ in range(8))]
    rows += [(i, "same words in a row " * 20) for i in range(2000, 2100)]
    rows += [(3000, None), (3001, ""), (3002, " \n"), (3003, "one"), (3004, "ONE"), (3005, "one two"), (3006, "Ä one"), (3007, "ä one"), (3008, "a b"), (3009, "a\xa0b")]
    rows += [(3100, "a a a a a"), (3101, "a a a a a a a"), (3200, " ".join(word() for _ in range(60_000)))]
    return [*rows, rows[3], rows[300]]


def test_equals_brute_force(spark):
    rows = made()
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, component_id string").repartition(5)
    for k in (4, 5):
        want = brute(rows, k, 80)
        got = nd.near_groups(docs, k=k).collect()
        assert len(got) == len(rows)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    kept = nd.drop_near_copies(docs, k=4)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in brute(rows, 4, 80).items() if i == c)


def test_equals_brute_force_on_the_table(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], 4, 80)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.op6_near_dedup(spark, "/root/testdata/sf0.001").collect()}
    assert got == want


def contained(k: int) -> list[tuple[int, str]]:
    """Pairs of a text and a part of it with exactly four fifths of its shingles, of few and of hundreds."""
    rng, rows = random.Random(7), []
    for i, n in enumerate([4, 4, 8, 12, 40, 200, 400, 800]):
        w = ["".join(rng.choice("abcdefghijklmnop") for _ in range(8)) for _ in range(n * 5 // 4 + k - 1)]
        short = w[: n + k - 1] if i % 2 else w[-(n + k - 1) :]
        rows += [(10 * i + i % 2, " ".join(w)), (10 * i + 1 - i % 2, " ".join(short)), (10 * i + 2, " ".join(short[1:]))]
    return rows


def test_sets_of_exactly_four_fifths(spark):
    for k in (4, 5):
        rows = contained(k)
        want = brute(rows, k, 80)
        assert all(want[10 * i + 1][1] == 10 * i for i in range(8))
        got = nd.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), k=k).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
        # Without a third text that could join the two.
        rows = [r for r in rows if r[0] % 10 < 2]
        got = nd.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), k=k).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, k, 80)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert nd.near_groups(docs).count() == 0


def test_likelihood_estimates_the_similarity():
    rng = np.random.default_rng(1)
    for j in (0.5, 0.8, 0.95):
        n = 3_000
        both = int(2 * n * j / (1 + j))
        pool = rng.integers(0, 2**63, 2 * n - both, dtype=np.uint64)
        a, b = nd.sketch(pool[:n]), nd.sketch(pool[n - both :])
        found, _ = nd.estimate_jaccard(a[None], b[None], np.array([n]), np.array([n]), 0.8)
        assert abs(found[0] - j) < 0.12
        assert (nd.sketch(pool) == np.maximum(a, b)).all()  # sketches merge


def test_components_of_a_path_a_star_and_a_cycle(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(500, i) for i in range(400, 480)] + [(701, 700), (700, 702), (702, 701), (9, 9)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 1 for i in range(1, 61)} | {i: 400 for i in [*range(400, 480), 500]} | {i: 700 for i in (700, 701, 702)}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_equals_brute_force_on_the_larger_table(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], 4, 80)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.op6_near_dedup(spark, "/root/testdata/sf0.01").collect()}
    assert got == want


def test_links_that_no_hub_has(spark):
    # Pairs of copies of one text: each pair alike, but too far from the text and from all other pairs.
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    base, rows = [word() for _ in range(120)], []
    for i in range(60):
        own = [*base]
        for at in rng.sample(range(0, 120), 5):
            own[at] = word()
        rows.append((10 * i, " ".join(own)))
        own[rng.randrange(120)] = word()
        rows.append((10 * i + 1, " ".join(own)))
    want = brute(rows, 4, 80)
    assert len({c for _, c in want.values()}) > 20
    got = nd.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), k=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_repeated_and_missing_ids_with_several_texts(spark):
    one, two, three = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, one, "x"), (1, two, "y"), (1, two, "z"), (2, one + " end", "x"), (3, two + " end", "x"), (None, three, "x"), (None, three + " end", "y"), (None, None, "n"), (None, "own words " * 9, "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, own_0 string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in nd.near_groups(docs, k=4).collect())
    assert [x for x in got if x[0]] == [(1, 57, 1, True), (1, 57, 1, True), (1, 57, 1, True), (2, 58, 1, False), (3, 58, 1, False)]
    kept = nd.drop_near_copies(docs, k=4)
    assert kept.columns == docs.columns
    texts = sorted((r.text or "", r.own_0) for r in kept.collect())
    assert len(texts) == 5 and {one, two, "", "own words " * 9} <= {t for t, _ in texts}


def test_workers_look_at_few_rows_at_a_time():
    batch = pa.RecordBatch.from_pydict({"text": [f"t{i}" for i in range(1300)]})
    parts = [*nd._parts([batch, batch.slice(0, 0)])]
    assert max(p.num_rows for p in parts) <= nd.AT_ONCE < 1300
    assert [t for p in parts for t in p.column("text").to_pylist()] == batch.column("text").to_pylist()


def test_band_keys_are_not_broadcast(spark, monkeypatch):
    plans, keep = {}, nd.materialize
    monkeypatch.setattr(nd, "materialize", lambda df, name: plans.update({name: df._jdf.queryExecution().executedPlan().toString()}) or keep(df, name))
    rows = [(i, " ".join(f"w{i // 2 * 40 + j}" for j in range(40))) for i in range(20)]
    got = nd.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), k=4).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i // 2 * 2 for i in range(20)}
    assert "SortMergeJoin" in plans["buckets"] and "Broadcast" not in plans["buckets"]
