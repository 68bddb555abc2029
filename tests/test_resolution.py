from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from stratalist.functions import queries
from stratalist.operators import normalize, records, resolve

BODY = "Build chips with SystemVerilog and Python in a team that ships silicon every year. " * 4
RAW = [
    ("s1", "job_board", "1", "NVIDIA Corporation", "FPGA Design Intern (Summer 2026)", "Santa Clara, CA", BODY + "\nRequirements:\nPhD. 3+ years of relevant experience. $45 - $60 per hour.", "https://boards.greenhouse.io/nvidia/jobs/77?utm_source=x"),
    ("s2", "ats", "9", "Nvidia", "FPGA Design Intern", "Sunnyvale, CA", BODY, "https://boards.greenhouse.io/nvidia/jobs/77"),
    ("s3", "curated_list", "5", "Nvidia", "FPGA Design Intern", "Austin, TX", BODY, "https://nvidia.com/careers/5"),
    ("s3", "curated_list", "6", "nvidia inc", "FPGA Verification Intern", "Santa Clara, CA", BODY, "https://nvidia.com/careers/6"),
    ("s4", "ats", "1", "", "No company", None, "x", "https://x.example"),
    ("s4", "ats", "2", "Acme", " ", None, "x", "https://x.example"),
]
DDL = "source string, source_kind string, source_job_id string, company string, title string, location string, description string, url string"


def listings(spark):
    rows = normalize.normalize_listings(spark.createDataFrame(RAW, DDL), F.lit("2026-05-01").cast("date"))
    key = F.concat_ws("/", "source", "source_job_id")
    node = {f"{r[0]}/{r[2]}": i for i, r in enumerate(RAW)}
    return rows.withColumns({"source_key": key, "node": F.create_map(*[F.lit(x) for kv in node.items() for x in kv])[key], "title_tokens": F.split("title_core", " ")})


def test_raw_rows_become_typed_listings(spark):
    rows = {r.node: r for r in listings(spark).collect()}
    assert set(rows) == {0, 1, 2, 3}
    a = rows[0]
    assert (a.company_slug, a.title_core, a.location_key, a.country, a.employment_type, a.years, a.degrees, a.terms) == ("nvidia", "fpga design intern", "bay_area", "US", "internship", 3.0, ["PhD"], ["Summer 2026"])
    assert (a.salary_min, a.salary_max, a.salary_period, a.ats_identity, a.requisition_id) == (45.0, 60.0, "hourly", "greenhouse:nvidia:77", "77")
    assert a.requirements.startswith("PhD.") and "SystemVerilog" in [s for s in a.skills] or "systemverilog" in [s.lower() for s in a.skills]
    raw = spark.createDataFrame(RAW, DDL)
    assert tuple(normalize.normalize_counts(raw).first()) == (4, 2)


def test_stages_with_guards(spark):
    rows = listings(spark)
    got = {r.node: r.cluster_id for r in resolve.resolve(rows, "node").collect()}
    # One posting on two boards is one job; another city, and another kind of work, stay apart.
    assert got == {0: 0, 1: 0, 2: 2, 3: 3}


def test_fold_takes_what_each_member_states(spark):
    members = resolve.resolve(listings(spark), "node").join(listings(spark), "node")
    members = members.withColumn("rank", resolve.authority_rank("cluster_id", F.col("source_kind"), F.col("description"), F.col("source"), "node"))
    one = {r.cluster_id: r for r in resolve.fold(members, "cluster_id", "rank").collect()}[0]
    assert (one.members, one.source, one.salary_min, one.salary_max, one.years, one.location_raw) == (2, "s2", 45.0, 60.0, 3.0, "Sunnyvale, CA")
    assert one.locations == ["Sunnyvale, CA", "Santa Clara, CA"] and one.degrees == ["PhD"]


def test_search_phrases():
    assert queries.expand("FPGA Engineer Intern")[:3] == ["FPGA Engineer Intern", "FPGA engineer", "FPGA design"] and queries.expand("Pilot Intern") == ["Pilot Intern", "pilot"] and queries.expand(" ") == []
    pairs = queries.search_phrases(["Pilot"], ["uvm"], ["Austin"], limit=5)
    assert pairs == [("Pilot intern", None), ("uvm intern", None), ("Pilot intern", "Austin"), ("uvm intern", "Austin")]
    assert queries.search_phrases([]) == [("engineering intern", None)] and queries.keep_first(["A b", "a  B", "", "c"]) == ["A b", "c"]


def test_failed_digests_leave_no_trace(spark):
    state = spark.createDataFrame([(1, 10, "new", None), (2, 10, "new", None)], "user_id long, job_id long, status string, notified_at timestamp_ntz")
    chosen = spark.createDataFrame([(1, 10, 1), (2, 10, 1), (2, 11, 2)], "user_id long, job_id long, rank int")
    sent = spark.createDataFrame([(1, False), (2, True)], "user_id long, ok boolean")
    items, after = records.dispatch(state, chosen, sent, datetime(2026, 1, 1))
    assert items.count() == 2
    assert {(r.user_id, r.job_id): r.notified_at is not None for r in after.collect()} == {(1, 10): False, (2, 10): True, (2, 11): True}
