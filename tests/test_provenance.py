"""Provenance against a sequential union-find in plain Python, on permuted inputs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from stratalist.operators import provenance as pv
from stratalist.plans.resolution_queries import _listings

DDL = "left long, right long, stage string, confidence double, rank struct<s: int, a: bigint, b: bigint, c: bigint>, verdict string, reason string"
STAGES = ["exact_id", "url", "ats_identity", "fingerprint", "content_hash", "similarity"]


class Forest:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.get(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[b] = a
        return a != b


def sequential(evidence, ask=None, budget=0, least=0.8):
    """All evidence one by one in its order; links have the verdict ``link``."""
    forest, methods, records = Forest(), {}, []
    for left, right, stage, confidence, rank, verdict, reason in sorted(evidence, key=lambda e: e[4]):
        if forest.find(left) == forest.find(right):
            continue
        if verdict == "uncertain" and budget > 0 and ask:
            budget -= 1
            said, sure = ask(left, right) or (None, 0.0)
            stage, confidence = "llm", sure
            if said == "SAME" and sure >= least:
                verdict = "link"
            else:
                records.append((left, right, stage, confidence, said.lower() if said else "uncertain"))
                continue
        if verdict == "link":
            forest.join(left, right)
            methods.setdefault(right, (stage, confidence))
        records.append((left, right, stage, confidence, "same" if verdict == "link" else verdict))
    return methods, sorted(records)


def made(seed, n=40, m=120):
    rng, out, seen = random.Random(seed), [], set()
    while len(out) < m:
        left, right = sorted(rng.sample(range(n), 2))
        s = rng.randrange(6)
        rank = (s, right, 0, 0) if s < 3 else (s, left, right, 0) if s < 5 else (s, left // 7, left, right)
        if rank in seen:
            continue
        seen.add(rank)
        verdict = "link" if s < 3 or rng.random() < 0.35 else "different" if s < 5 else "uncertain"
        out.append((left, right, STAGES[s], round(rng.random(), 3), rank, verdict, "r"))
    return out


def frames(spark, rows, seed=0):
    rows = [*rows]
    random.Random(seed).shuffle(rows)
    df = spark.createDataFrame(rows, DDL).repartition(3)
    return df.where("verdict = 'link'").select(*pv.EDGE), df.where("verdict <> 'link'")


def told(records):
    return sorted((r.left, r.right, r.stage, r.confidence, r.verdict) for r in records.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_methods_and_records_equal_the_sequential_rule(spark, seed):
    rows = made(seed)
    want, records = sequential(rows)
    nodes = spark.range(45).withColumnRenamed("id", "n")
    for shuffled in (0, 5):
        links, doubts = frames(spark, rows, shuffled)
        methods, found = pv.trace(nodes, "n", links, doubts)
        assert {r.n: (r.method, r.confidence) for r in methods.collect()} == {i: want.get(i, ("primary", 1.0)) for i in range(45)}
        assert told(found) == records


@pytest.mark.parametrize("budget", [0, 4, 1000])
def test_adjudicator_is_asked_as_if_one_by_one(spark, budget):
    rows = made(7, 30, 80)
    asked = []

    def answer(left, right):
        return {0: ("SAME", 0.95), 1: ("SAME", 0.5), 2: ("DIFFERENT", 0.9), 3: None}[(left * 31 + right) % 4]

    def ask(pairs):
        own = [(r.left, r.right) for r in pairs.collect()]
        asked.extend(own)
        said = [(*p, *answer(*p)) for p in own if answer(*p)]
        return spark.createDataFrame(said, "left long, right long, verdict string, confidence double")

    calls = []
    want, records = sequential(rows, lambda a, b: calls.append((a, b)) or answer(a, b), budget)
    links, doubts = pv.adjudicate(*frames(spark, rows), ask, budget)
    assert sorted(asked) == sorted(calls) and len(asked) <= budget
    methods, found = pv.trace(spark.range(30).withColumnRenamed("id", "n"), "n", links, doubts)
    assert {r.n: (r.method, r.confidence) for r in methods.collect() if r.method != "primary"} == want
    # a link's record says the stage in which it counted; doubts about pairs that were joined first are gone
    assert told(found) == records


def test_all_orders_equal_the_sequential_rule(spark):
    listings = _listings(spark, "/root/testdata/sf0.001")
    links, doubts = pv.evidence(listings, "node", similar=False)
    rows = [(*r, "link", "") for r in links.collect()] + [tuple(r) for r in doubts.collect()]
    want, records = sequential(rows)
    methods, found = pv.trace(listings, "node", links, doubts)
    got = {r.node: (r.method, r.confidence) for r in methods.collect()}
    assert got == {n: want.get(n, ("primary", 1.0)) for n in got} and len(got) == listings.count()
    assert told(found) == records and {m for m, _ in got.values()} >= {"primary", "exact_id", "fingerprint", "content_hash"}


def test_no_evidence(spark):
    links, doubts = frames(spark, [])
    methods, records = pv.trace(spark.range(2).select(F.col("id").alias("n")), "n", links, doubts)
    assert sorted(tuple(r) for r in methods.collect()) == [(0, "primary", 1.0), (1, "primary", 1.0)] and records.count() == 0


def test_listings_with_an_adjudicator(spark):
    from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType, TimestampNTZType

    place = StructType([StructField(c, StringType()) for c in ("city", "state", "country", "metro")] + [StructField("remote", BooleanType()), StructField("key", StringType())])
    texts, lists = ["source", "source_key", "canonical_url", "ats_identity", "company_slug", "fingerprint", "content_hash", "requisition_id", "employment_type", "location_key"], ["discriminators", "title_tokens", "shingles"]
    schema = StructType([StructField("node", LongType()), *[StructField(c, StringType()) for c in texts], *[StructField(c, ArrayType(StringType())) for c in lists], StructField("location", place), StructField("date_posted", TimestampNTZType()), StructField("salary_min", DoubleType())])

    def listing(i, source, title, grams, **more):
        base = dict.fromkeys(texts, "") | {"node": i, "source": source, "source_key": f"{source}/{i}", "company_slug": "acme", "employment_type": "unknown", "discriminators": [], "title_tokens": title.split(), "shingles": [f"g{g}" for g in grams], "location": (None, None, None, None, False, ""), "date_posted": None, "salary_min": None}
        return tuple((base | more)[f.name] for f in schema.fields)

    rows = [
        listing(0, "a", "fpga intern x y", range(10), canonical_url="u1"), listing(1, "b", "fpga intern x y", range(10), canonical_url="u1"),  # one url
        listing(2, "c", "fpga intern x y", range(10)),  # alike
        listing(3, "d", "fpga intern x z", range(1, 11)), listing(4, "e", "other words of work", range(50, 60)), listing(5, "f", "fpga intern x y", range(10), requisition_id="9"), listing(6, "f", "fpga intern x y", range(10), requisition_id="8"),
    ]
    df = spark.createDataFrame(rows, schema).repartition(2)
    clusters, methods, records = pv.resolve_with_records(df, "node")
    assert {r.node: r.cluster_id for r in clusters.collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 0, 6: 0}
    assert {r.node: r.method for r in methods.collect()} == {0: "primary", 1: "url", 2: "similarity", 3: "primary", 4: "primary", 5: "similarity", 6: "similarity"}
    assert {(r.left, r.right, r.verdict) for r in records.collect() if r.verdict == "uncertain"} >= {(0, 3, "uncertain")}
    same = lambda pairs: pairs.select("left", "right", F.lit("same").alias("verdict"), F.lit(0.9).alias("confidence"))
    clusters, methods, records = pv.resolve_with_records(df, "node", ask=same, budget=1)
    assert {r.node: r.cluster_id for r in clusters.collect()}[3] == 0 and {r.node: r.method for r in methods.collect()}[3] == "llm"
    assert not [r for r in records.collect() if r.verdict == "uncertain"]  # the one answer joined all that was in doubt


def test_stars_of_the_first_stage_need_no_round(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(pv, "connected_components", lambda *a, own=pv.connected_components: rounds.append(1) or own(*a))
    stars = [(h, h + i, "exact_id", 1.0, (0, h + i, 0, 0), "link", "") for h in (0, 10, 20) for i in (1, 2, 3)]
    more = [(3, 12, "fingerprint", 0.95, (3, 3, 12, 0), "link", ""), (1, 11, "content_hash", 0.97, (4, 1, 11, 0), "link", "")]
    doubts = [(1, 2, "fingerprint", 0.0, (3, 1, 2, 0), "different", "r"), (2, 13, "fingerprint", 0.0, (3, 2, 13, 0), "different", "r"), (2, 13, "content_hash", 0.0, (4, 2, 13, 0), "different", "r"), (1, 22, "content_hash", 0.0, (4, 1, 22, 0), "different", "r")]
    nodes = spark.range(25).withColumnRenamed("id", "n")
    for rows, least in ((stars, 0), (stars + more + doubts, 1)):
        rounds.clear()
        want, records = sequential(rows)
        links, asked = frames(spark, rows)
        methods, found = pv.trace(nodes, "n", links, asked)
        assert len(rounds) == least
        assert {r.n: (r.method, r.confidence) for r in methods.collect()} == {i: want.get(i, ("primary", 1.0)) for i in range(25)} and told(found) == records


def test_methods_do_without_the_doubts(spark):
    listings = _listings(spark, "/root/testdata/sf0.001")
    links, doubts = pv.evidence(listings, "node", similar=False, doubted=False)
    both = pv.evidence(listings, "node", similar=False)
    assert doubts is None and sorted(map(tuple, links.collect())) == sorted(map(tuple, both[0].collect()))
    forest = pv.spanning_forest(links)[0]
    assert sorted(map(tuple, pv.methods(listings, "node", forest).collect())) == sorted(map(tuple, pv.trace(listings, "node", *both)[0].collect()))
