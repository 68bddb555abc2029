"""Payloads, relative dates, seeds, windows, clamps, stored rows and orders that no query shows."""

from __future__ import annotations

import json
import random
import zlib
from datetime import datetime
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from stratalist.functions import text
from stratalist.operators import analytics, discovery, normalize, overlap, resolve
from stratalist.sources import payloads
from stratalist.streaming import incremental


def column(spark, expr, values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "a string").coalesce(1).select(expr(F.col("a"))).collect()]


def test_greenhouse(spark):
    page = {"jobs": [{"id": 7, "title": "FPGA Intern", "absolute_url": "https://x/7", "location": {"name": "Austin"}, "content": "<p>a</p>", "first_published": "2026-01-02T03:04:05Z", "departments": [{"name": "Chips"}]}, {"id": 8, "title": "SWE", "location": None, "departments": []}]}
    rows = payloads.read_board(spark.createDataFrame([(json.dumps(page), "acme", "Acme Inc")], "payload string, board_token string, company_name string"), "greenhouse")
    got = {r.source_job_id: r for r in rows.collect()}
    assert set(got) == {"acme:7", "acme:8"} and (got["acme:7"].title, got["acme:7"].company, got["acme:7"].location, got["acme:7"].department, got["acme:7"].date_posted) == ("FPGA Intern", "Acme Inc", "Austin", "Chips", datetime(2026, 1, 2, 3, 4, 5))
    assert got["acme:8"].location is None and got["acme:8"].date_posted is None


def test_relative_dates_and_clamps(spark):
    assert column(spark, payloads.posted_days_ago, ["Posted Today", "Posted Yesterday", "Posted 3 Days Ago", "Posted 30+ Days Ago", "soon", None]) == [0, 1, 3, 30, None, None]
    assert column(spark, lambda c: text.clamp(c, 5), ["12345", "123456", "", None]) == ["12345", "1234…", "", None]


def test_seeds(spark):
    companies = spark.createDataFrame([("acme labs",), ("nvidia",)], "slug string")
    known = spark.createDataFrame([("lever", "acme-labs"), ("ashby", "other")], "provider string, board string")
    got = sorted((r.provider, r.board, r.slug) for r in discovery.seed_boards(companies, known).collect())
    want = {(p, b, s) for p in ("greenhouse", "lever", "ashby") for b, s in (("acmelabs", "acme labs"), ("acme-labs", "acme labs"), ("nvidia", "nvidia"))} - {("lever", "acme-labs", "acme labs")}
    assert got == sorted(want)


def test_windows_of_a_stream(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    at = lambda h, m: datetime(2026, 1, 1, h, m)
    rows = [(at(1, 5), "a"), (at(1, 50), "a"), (at(1, 59), "b"), (at(2, 0), "a"), (at(9, 0), "z")]
    spark.createDataFrame(rows, "ts timestamp, kind string").write.parquet(src)
    counts = incremental.windowed_counts(spark.readStream.schema("ts timestamp, kind string").parquet(src), "ts", "kind")
    incremental.run_available(counts, out, ck).awaitTermination()
    got = sorted((r.start, r.kind, r.n) for r in spark.read.parquet(out).collect())
    assert got == [(at(1, 0), "a", 2), (at(1, 0), "b", 1), (at(2, 0), "a", 1)]  # the window of the last row is still open


def test_stored_jobs_can_be_scored(spark):
    kinds = "job_id long, company_name string, title string, title_core string, requirements string, description string, skills array<string>, employment_type string, posting_url string, experience_required_years double"
    jobs = spark.createDataFrame([(1, "NVIDIA Corporation", "FPGA Intern", None, "", "verification team", None, None, "u", 2.0), (2, "Acme", "SWE", "swe", "design", "verification", ["c"], "internship", None, None)], kinds)
    got = {r.source_job_id: r for r in normalize.scoreable(jobs).collect()}
    assert (got["1"].company_slug, got["1"].title_core, got["1"].discriminators, got["1"].skills, got["1"].employment_type, got["1"].url, got["1"].years, got["1"].source) == ("nvidia", "FPGA Intern", ["hardware", "intern", "verification"], [], "unknown", "u", 2.0, "stored")
    assert (got["2"].discriminators, got["2"].employment_type, got["2"].deadline_is_explicit) == (["design", "software"], "internship", False)


def test_health(spark):
    health = spark.createDataFrame([("a", 1, 4.0, 2), ("b", 1, 4.0, 2), ("c", 1, 4.0, 2), ("d", 1, 4.0, 2)], "source string, runs int, avg_new double, failures int")
    run = spark.createDataFrame([("a", True, False, 8, True), ("b", False, False, 0, True), ("c", False, False, 0, False)], "source string, ok boolean, partial boolean, new int, configured boolean")
    got = {r.source: (r.runs, r.avg_new, r.failures, r.status) for r in discovery.source_health(health, run).collect()}
    assert got == {"a": (2, 6.0, 0, "ok"), "b": (2, 2.0, 3, "failed"), "c": (1, 4.0, 2, "unconfigured"), "d": (1, 4.0, 2, "idle")}


def test_orders(spark):
    clusters = spark.createDataFrame([(1, 2, "b", "x"), (2, 3, "z", "x"), (3, 2, "a", "y"), (4, 2, "a", "x")], "cluster_id long, members long, company_slug string, title_core string")
    assert [r.cluster_id for r in clusters.orderBy(*resolve.cluster_order()).collect()] == [2, 4, 3, 1]
    jobs = spark.createDataFrame([("Beta", True, "internship"), ("gamma", True, "full_time")], "company string, is_active boolean, employment_type string")
    names = spark.createDataFrame([("Beta",), ("gamma",), ("alpha",), ("Alef",)], "name string")
    assert [(r.name, r.state) for r in analytics.preferred_coverage(jobs, names).collect()] == [("Alef", "missing"), ("alpha", "missing"), ("gamma", "no_internships"), ("Beta", "ok")]
    at = datetime(2026, 1, 1)
    applied = spark.createDataFrame([("a", at, None), ("b", at, at), ("c", at, None), ("c", at, None)], "category string, applied_at timestamp_ntz, interview_at timestamp_ntz").withColumns({"offer_at": F.lit(None).cast("timestamp_ntz"), "rejected_at": F.lit(None).cast("timestamp_ntz")})
    assert [r.category for r in analytics.outcome_insights(applied).collect()] == ["b", "c", "a"]


def test_pairs_are_intersected_once_and_stand_on_axes_by_row(spark):
    from stratalist.functions import text

    assert str(text.jaccard(F.col("a"), F.col("b"))).count("array_intersect") == 1
    score = str(resolve.pair_score(resolve.side("a"), resolve.side("b")))
    assert score.count("shingles") == str(text.jaccard(F.col("a.shingles"), F.col("b.shingles"))).count("shingles") + 2
    assert "array_intersect" not in str(resolve.axes_veto(resolve.side("a"), resolve.side("b")))
    tags = [[], ["summer"], ["fall", "design"], ["design"], ["design", "fall"], ["phd"], None]
    place = F.struct(*[F.lit(None).cast("string").alias(c) for c in ("city", "state", "country", "metro")], F.lit(False).alias("remote"), F.lit("").alias("key"))
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(tags)], "i int, discriminators array<string>").withColumns({c: F.lit("x") for c in ("company_slug", "requisition_id", "ats_identity", "source", "canonical_url", "employment_type")} | {"location": place})
    rows = resolve.with_axes(rows)
    a, b = resolve.side("a"), resolve.side("b")
    both = rows.alias("a").crossJoin(rows.alias("b")).select(resolve.merge_veto(a, b).alias("x"), resolve.axes_veto(a, b).alias("y")).collect()
    assert all(r.x == r.y for r in both) and any(r.x for r in both)


def test_unlike_sets_of_a_rare_token_are_not_compared_in_full(spark, monkeypatch):
    kept, write = {}, resolve.materialize
    monkeypatch.setattr(resolve, "materialize", lambda df, name: kept.setdefault(name, write(df, name)))
    own = lambda i, n: [f"w{i}_{j}" for j in range(n)]
    often = [f"often{j}" for j in range(40)]
    # Sets of 140 tokens with 40 frequent ones and one that only some of them have; 30 and 31 share 100 of 140, and 32 and 33 one less than enough.
    rows = [(i, [f"rare{i // 5}", *often, *own(i, 99)]) for i in range(30)] + [(30, own(30, 140)), (31, own(30, 100) + own(31, 40)), (32, own(32, 140)), (33, own(32, 97) + own(33, 43))]
    got = [(r.left, r.right, r.score) for r in resolve.similar_sets(spark.createDataFrame(rows, "id long, t array<string>"), "id", "t").collect()]
    assert got == [(30, 31, 100 / 140)] and kept["pairs"].count() <= 2


def test_candidates_of_similar_sets_are_not_dealt_out(spark, monkeypatch):
    plans, keep = {}, resolve.materialize
    monkeypatch.setattr(resolve, "materialize", lambda df, name: plans.update({name: df._jdf.queryExecution().executedPlan().toString()}) or keep(df, name))
    # One set of 200 rows, which end up in several partitions, and three that share 9, 8 and 6 of its 10 tokens.
    word = lambda i: f"w{i:02}"
    rows = [(i, [*map(word, range(10))]) for i in range(10, 210)] + [(1, [*map(word, range(9)), "x"]), (500, [*map(word, range(8)), "y", "z"]), (600, [*map(word, range(6)), *"abcd"]), (None, ["w00"]), (700, []), (701, None)]
    got = {(r.left, r.right): r.score for r in resolve.similar_sets(spark.createDataFrame(rows, "id long, t array<string>").repartition(7), "id", "t").collect()}
    assert got == {(10, i): 1.0 for i in range(11, 210)} | {(1, 10): 0.9, (10, 500): 0.8, (1, 500): 0.8}
    assert "Join" not in plans["pairs"] and "Exchange" not in plans["pairs"]


def test_sets_in_blocks_equal_brute_force(monkeypatch):
    rng = random.Random(4)
    for name, value in (("AT_ONCE", 300), ("BYTES", 2500), ("SETS", 40)):
        monkeypatch.setattr(overlap, name, value)
    sets = [sorted({f"t{int(rng.paretovariate(0.4)) % 3000}" for _ in range(rng.randint(1, 70))}) for _ in range(150)]
    for _ in range(60):  # near copies, some of which only just share enough
        of = rng.choice(sets[:12])
        sets.append(sorted({w if rng.random() < 0.85 else f"n{rng.randrange(10**6)}" for w in of}))
    sets = sorted({tuple(x) for x in sets}, key=lambda x: (len(x), x))
    hashes = [[zlib.crc32(w.encode()) * 7919 for w in x] for x in sets]
    counts = np.bincount(np.concatenate(hashes) % overlap.COUNTED, minlength=overlap.COUNTED)
    given = pa.RecordBatch.from_pydict({"node": [*range(len(sets))], "n": [*map(len, sets)], "set": [" ".join(x) for x in sets], "words": [" ".join(x) for x in sets], "hashes": hashes})
    monkeypatch.setattr(overlap.TaskContext, "get", staticmethod(lambda: SimpleNamespace(partitionId=lambda: 3)))
    rows = pa.Table.from_batches(overlap.placed(lambda: counts, 70)(iter([given.slice(0, 0), given.slice(0, 50), given.slice(49)])))
    assert rows.column("node").to_pylist() == [*range(len(sets))]  # the repeated row is no second set
    of = rows.to_pandas()
    pieces = [(x.place.min(), x.place.max(), x.n.min(), x.n.max(), x.words.map(len).sum(), len(x)) for _, x in of.groupby("piece")]
    cut = overlap.blocks(pieces)
    assert len(pieces) > len(cut) > 4 and all(((of.place >= a) & (of.place <= b)).sum() <= 40 for a, b, _, _ in cut)
    got = {}
    for first, last, low, high in cut:
        block = overlap.Block.of(rows.filter(pa.array((of.place >= first) & (of.place <= last))))
        like = rows.filter(pa.array((of.place > first) & (of.n >= -(-70 * low // 100)) & (of.n <= 100 * high // 70)))
        for found in overlap.matched(lambda b=block: b, 70, 0.7)(iter(like.to_batches())):
            pairs = [*zip(*(c.to_pylist() for c in found.columns), strict=True)]
            assert not any((a, b) in got for a, b, _ in pairs)
            got |= {(a, b): s for a, b, s in pairs}
    share = lambda a, b: len({*a} & {*b}) / max(len(a), len(b))
    assert got == {(i, j): s for j, b in enumerate(sets) for i, a in enumerate(sets[:j]) if (s := share(a, b)) >= 0.7} and len(got) > 60
    assert any(s == 0.7 for s in got.values()) and overlap.repeated([(5, "a", "b"), (9, "b", "b"), (12, "b", "c"), (20, "d", "d")]) == [9, 12]
