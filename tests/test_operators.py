from __future__ import annotations

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from stratalist.functions import facts, text
from stratalist.operators import resolve, score, state
from stratalist.operators.components import connected_components
from stratalist.storage import materialize
from stratalist.operators.filters import ListFilter, pages
from stratalist.sources import payloads
from stratalist.streaming import incremental

NOW = datetime(2026, 8, 18, 12)


def test_filter_round_trip():
    f = ListFilter.from_query({"view": "nonsense", "min_score": "80.5", "page": "0", "per_page": "900", "max_score": "x", "has_salary": "on", "q": " fpga "})
    assert (f.view, f.min_score, f.max_score, f.page, f.per_page, f.has_salary, f.q) == ("review", 80.5, None, 1, 100, True, "fpga")
    assert ListFilter.from_query(f.to_query()) == f
    assert [pages(n, 25) for n in (0, 25, 26)] == [1, 1, 2]


def _row(**more):
    base = {"company_slug": "a", "requisition_id": "", "ats_identity": "", "source": "s1", "canonical_url": "", "discriminators": ["design"], "employment_type": "unknown", "place": ""}
    return base | more


def test_merge_vetoes_are_symmetric(spark):
    cases = [
        (_row(), _row(source="s2"), None), (_row(), _row(company_slug="b"), "company"), (_row(requisition_id="R1"), _row(requisition_id="r2"), "requisition"), (_row(requisition_id="R1"), _row(requisition_id=" r1"), None),
        (_row(ats_identity="x:1"), _row(ats_identity="x:2"), "ats identity"), (_row(canonical_url="u"), _row(canonical_url="v"), "same source"), (_row(discriminators=["design", "verification"]), _row(source="s2"), "axis: verification"),
        (_row(employment_type="internship"), _row(employment_type="full_time"), "employment"), (_row(place="Austin, TX"), _row(place="San Jose, CA"), "location"),
        (_row(place="Springfield"), _row(source="s2", place="Springfield, IL"), None),
    ]
    ddl = "company_slug string, requisition_id string, ats_identity string, source string, canonical_url string, discriminators array<string>, employment_type string, place string"
    rows = [(i, *(dict(zip(_row(), x.values(), strict=True)) for x in pair)) for i, (*pair, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, f"i int, a struct<{ddl.replace(' ', ':').replace(',:', ',')}>, b struct<{ddl.replace(' ', ':').replace(',:', ',')}>")
    for c in "ab":
        df = df.withColumn(c, F.col(c).withField("location", facts.parse_location(F.col(c)["place"])))
    a, b = resolve.side("a"), resolve.side("b")
    got = {r.i: (r.x, r.y) for r in df.select("i", resolve.merge_veto(a, b).alias("x"), resolve.merge_veto(b, a).alias("y")).collect()}
    assert got == {i: (why, why) for i, (_, _, why) in enumerate(cases)}


def test_clusters_survivors_and_urls(spark):
    rows = spark.createDataFrame([(1, "k", "ats", "", None, ["x"]), (2, "k", "company_careers", "body", 50.0, ["y", "x"]), (3, None, "ats", "b", 1.0, []), (4, "", "ats", "c", None, [])], "id long, key string, kind string, body string, pay double, skills array<string>")
    edges = resolve.star_edges(rows, "key", "id", "exact_id", 1.0).select("left", "right")
    members = resolve.clusters(rows, "id", edges).join(rows, "id")
    members = members.withColumn("rank", resolve.authority_rank("cluster_id", F.col("kind"), F.col("body"), F.lit("s"), "id"))
    got = {r.cluster_id: r for r in resolve.survivors(members, "cluster_id", "rank", first=["pay", "body"], lists=["skills"], leader=["kind"]).collect()}
    assert set(got) == {1, 3, 4} and (got[1].members, got[1].pay, got[1].kind, got[1].skills) == (2, 50.0, "company_careers", ["y", "x"])
    urls = spark.createDataFrame([(1, "https://jobs.lever.co/n", "ats", "ats", True, 1), (1, "https://nvidia.com/j", "company_careers", "ats", False, 2), (1, "", "unknown", "ats", True, 3)], "cluster int, url string, host_class string, kind string, is_apply boolean, rank int")
    assert resolve.elect_url(urls, "cluster").first().url == "https://nvidia.com/j"


def test_components_do_not_depend_on_order(spark):
    edges = [(i, i + 1) for i in range(0, 30, 2)] + [(i, i + 3) for i in range(1, 20, 4)]
    one = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    two = {r.node: r.component for r in connected_components(spark.createDataFrame([(b, a) for a, b in edges[::-1]], "a long, b long")).collect()}
    assert one == two


def test_components_end_once_only_stars_are_left(spark):
    kept = []

    def keep(df, name):
        kept.append(materialize(df, name))
        return kept[-1]

    star = spark.createDataFrame([(1, i) for i in range(2, 40)] + [(50, 51)], "a long, b long")
    assert {r.node: r.component for r in connected_components(star, keep=keep).collect()} == {**{i: 1 for i in range(1, 40)}, 50: 50, 51: 50} and len(kept) == 1
    path = spark.createDataFrame([(i, i + 1) for i in range(4)], "a long, b long")
    kept.clear()
    assert {r.component for r in connected_components(path, keep=keep).collect()} == {0} and len(kept) <= 3


def test_similarity_band_and_adjudicator(spark):
    rows = spark.createDataFrame([(1, "c", "fpga design intern team one"), (2, "c", "fpga design intern team two"), (3, "c", "sales")], "id long, block string, title string")
    rows = rows.withColumn("t", text.title_tokens(F.col("title")))
    pairs = resolve.similar_pairs(rows, "block", "id", lambda a, b: text.token_set_ratio(a("t"), b("t")))
    assert [(r.left, r.right, r.verdict) for r in pairs.collect()] == [(1, 2, "uncertain")]
    say = lambda same, sure: lambda p: p.select("left", "right", F.lit(same).alias("same"), F.lit(sure).alias("confidence"))
    assert [resolve.adjudicated(pairs, f, n).count() for f, n in ((None, 5), (say(True, 0.95), 5), (say(False, 0.95), 5), (say(True, 0.4), 5), (say(True, 0.95), 0))] == [0, 1, 0, 0, 0]


def test_similarity_without_blocks(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(20)]
    rows = [(i, " ".join([*base[:-4], *(word() if rng.random() < 0.5 else w for w in base[-4:])])) for i in range(70)]
    rows += [(100 + i, rows[0][1]) for i in range(5)] + [(200, " ".join(["other", "head", *base[2:]])), (201, ""), (202, None), (203, word())]
    tenth = [word() for _ in range(10)]  # exactly seven tenths, and less
    rows += [(300, " ".join(tenth)), (301, " ".join(tenth[:7])), (302, " ".join([*tenth[3:], word()])), (303, " ".join(tenth[4:]))]
    sets, heads, want = {i: frozenset((t or "").split()) for i, t in rows}, {}, set()
    for i in sorted(sets):
        if sets[i] and heads.setdefault(sets[i], i) != i:
            want.add((heads[sets[i]], i, 1.0))
    for x, i in heads.items():
        want |= {(i, j, round(len(x & y) / max(len(x), len(y)), 6)) for y, j in heads.items() if i < j and len(x & y) / max(len(x), len(y)) >= 0.7}
    df = spark.createDataFrame(rows, "id long, text string").withColumn("block", F.substring("text", 1, 20))
    df = df.withColumn("t", text.title_tokens(text.normalize_ascii(F.col("text"))))
    got = [(r.left, r.right, round(r.score, 6)) for r in resolve.similar_sets(df, "id", "t").collect()]
    assert len(got) == len(set(got)) and set(got) == want and (300, 301, 0.7) in want and any(200 in x for x in want)
    by_block = resolve.similar_pairs(df, "block", "id", lambda a, b: text.token_set_ratio(a("t"), b("t"))).collect()
    assert not any(r.left < 200 for r in by_block)  # the block of 75 is skipped, and reported
    assert [r.skipped for r in resolve.skipped_blocks(df, "block").collect()] == [75]


def test_blend_shares_unmeasured_weight(spark):
    df = spark.createDataFrame([(80.0, None, 50.0), (None, None, 40.0), (None, None, None), (80.0, 40.0, 100.0)], "role_match double, technical_skills double, freshness double")
    got = [r[0] for r in df.coalesce(1).select(score.blend({c: F.col(c) for c in df.columns}, score.WEIGHTS)).collect()]
    assert got == [pytest.approx(80 * 0.85), pytest.approx(40.0), 0.0, pytest.approx(60.0)]
    bands = [r[0] for r in spark.createDataFrame([(x,) for x in (95.0, 85.0, 75.0, 65.0, 30.0)], "s double").coalesce(1).select(score.priority_band(F.col("s"))).collect()]
    assert bands == ["apply_now", "strong_match", "worth_considering", "maybe", "skip"]


def test_material_changes(spark):
    df = spark.createDataFrame([(50.0, 70.0, "A  b", "A b"), (50.0, None, "a", "b"), (None, 5.0, "", "x"), (5.0, 5.0, "a b", "A b")], "o_salary_min double, n_salary_min double, o_requirements string, n_requirements string")
    got = [r[0] for r in df.coalesce(1).select(state.material_changes(("salary_min", "requirements"))).collect()]
    assert got == [["salary_min"], ["requirements"], [], ["requirements"]]


def test_board_payloads(spark):
    lever = '[{"id":"1","text":"FPGA Intern","hostedUrl":"https://jobs.lever.co/a/1","categories":{"location":"Austin"},"createdAt":1767225600000}]'
    ashby = '{"jobs":[{"id":"2","title":"SWE","jobUrl":"u","publishedAt":"2026-01-01T00:00:00Z"}]}'
    curated = '[{"id":"3","company_name":"C","title":"T","url":"v","active":true,"locations":["X"]},{"id":"4","title":"T","active":false}]'
    frames = [payloads.read_board(spark.createDataFrame([(x,), ("broken",)], "payload string"), p) for p, x in (("lever", lever), ("ashby", ashby), ("curated", curated))]
    got = sorted((r.source, r.source_job_id, r.title, r.date_posted) for r in payloads.union_sources(frames).collect())
    assert got == [("ashby", "2", "SWE", datetime(2026, 1, 1)), ("curated", "3", "T", None), ("lever", "1", "FPGA Intern", datetime(2026, 1, 1))]


def test_stream_of_events(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "event_id")
    e.repartition(2).write.parquet(src)
    rows = incremental.first_listings(spark.readStream.schema(e.schema).parquet(src), ["event_id"], "ts")
    incremental.run_available(rows, out, ck).awaitTermination()
    assert spark.read.parquet(out).count() == e.count()
