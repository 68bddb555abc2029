"""Two runs written over each other: what is new, changed, unchanged, back again, and left out."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from stratalist.operators.persist import persist_run

DAY = datetime(2026, 8, 18, 12)
HEAD = (
    "cluster long, fingerprint string, company_slug string, requisition_id string, ats_identity string, discriminators array<string>, canonical_url string, excluded boolean, score double, title string, description string, "
    "location_raw string, salary_min double, salary_max double, application_url string, posting_url string, requirements string, deadline timestamp_ntz, deadline_is_explicit boolean"
)
FIELDS = [f.split()[0] for f in HEAD.split(", ")]


def head(i, **more):
    base = {"cluster": i, "fingerprint": f"f{i}", "company_slug": "acme", "requisition_id": "", "ats_identity": "", "discriminators": [], "canonical_url": f"u{i}", "excluded": False, "score": 80.0, "title": f"t{i}", "description": "d", "location_raw": "Austin", "salary_min": 50.0, "salary_max": 60.0, "application_url": f"https://a/{i}", "posting_url": None, "requirements": "r s", "deadline": None, "deadline_is_explicit": False}
    return tuple((base | more)[f] for f in FIELDS)


def run(spark, heads, members, jobs, listings, now, **options):
    h = spark.createDataFrame(heads, HEAD)
    m = spark.createDataFrame(members, "cluster long, member int, source_key string, ats_identity string, url_hash string")
    return persist_run(h, m, jobs, listings, spark.createDataFrame([(1, "acme")], "company_id long, company_slug string"), now, **options)


def test_two_runs(spark):
    jobs = spark.createDataFrame([], f"job_id long, {HEAD.split(', ', 1)[1]}, is_active boolean, freshness string, first_seen timestamp_ntz, last_seen timestamp_ntz")
    listings = spark.createDataFrame([], "job_id long, source_key string, ats_identity string, url_hash string, first_seen timestamp_ntz, last_seen timestamp_ntz")
    first = [head(1), head(2), head(3), head(4), head(5, excluded=True), head(6, score=10.0), head(7, application_url=""), head(8, deadline=DAY, deadline_is_explicit=False)]
    one = run(spark, first, [(i, 0, f"s/{i}", "", f"h{i}") for i in range(1, 9)], jobs, listings, DAY, min_score=50.0)
    assert tuple(one.outcome.first()) == (5, 0, 0, 0, 3) and {r.event_type for r in one.events.collect()} == {"discovered"}
    stored = {r.title: r for r in one.jobs.collect()}
    assert set(stored) == {"t1", "t2", "t3", "t4", "t8"} and stored["t8"].deadline is None and all(r.freshness == "new" for r in stored.values())
    ids = {t: r.job_id for t, r in stored.items()}
    assert {r.source_key: r.job_id for r in one.listings.collect()} == {f"s/{t[1:]}": i for t, i in ids.items()}

    # What the next run needs of the stored rows; the third job has gone inactive since.
    keep = jobs.columns
    full = one.jobs
    full = full.withColumns({c: F.lit(None).cast(jobs.schema[c].dataType) for c in keep if c not in full.columns}).select(*keep).withColumn("is_active", F.col("title") != "t3")
    old_listings = one.listings.select(*listings.columns)
    later = DAY + timedelta(days=2)
    second = [head(11, title="t1 new", description="", salary_min=70.0, salary_max=None), head(12, title="t2", description=None, location_raw=None, requirements="r   s", application_url="https://a/2"), head(13, title="t3"), head(14, fingerprint="other", title="t9"), head(15, title="t1 last", salary_min=None, salary_max=5.0, requirements="r S", application_url="https://a/1")]
    members = [(11, 0, "s/1", "", ""), (12, 0, "x/2", "", "h2"), (13, 0, "s/3", "", ""), (14, 0, "s/9", "", "h9"), (15, 0, "y/1", "", "h1")]
    two = run(spark, second, members, full, old_listings, later)
    got = {r.job_id: r for r in two.jobs.collect()}
    t1, t2, t3 = (got[ids[t]] for t in ("t1", "t2", "t3"))
    assert len(got) == 6 and tuple(two.outcome.first()) == (1, 1, 1, 1, 0)
    # two clusters found the first job; the last one speaks: its title, and the old pay, since it states no lower bound (its upper one is news all the same)
    assert (t1.title, t1.event, t1.description, t1.salary_min, t1.salary_max, t1.change) == ("t1 last", "updated", "d", 50.0, 60.0, ["requirements", "salary_max"])
    assert (t2.event, t2.location_raw, t2.description, t2.requirements, t2.change, t2.freshness) == ("seen", "Austin", "d", "r   s", [], "old")
    assert (t3.event, t3.freshness, t3.is_active) == ("reposted", "reposted", True) and got[ids["t4"]].event == "unseen" and got[ids["t4"]].freshness == "new"
    where = {r.source_key: r.job_id for r in two.listings.collect()}
    assert where["x/2"] == ids["t2"] and where["y/1"] == where["s/1"] == ids["t1"] and where["s/4"] == ids["t4"] and len(where) == 8
