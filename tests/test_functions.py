from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from stratalist.functions import facts, text, urls


def values(spark, column, rows, ddl="a string, b string, c string"):
    n = len(ddl.split(","))
    full = [(*r, *[None] * (n - len(r))) for r in rows]
    return [r[0] for r in spark.createDataFrame(full, ddl).coalesce(1).select(column).collect()]


def test_normalize_and_titles(spark):
    assert values(spark, text.normalize_text(F.col("a")), [("  Éclair  Café\xa0X ",), (None,), ("PLAIN\tText",)]) == ["eclair cafe x", "", "plain text"]
    titles = [("FPGA Design Intern (Summer 2026) - REQ12345",), ("Software/Hardware Engineer, Remote",), (None,)]
    assert values(spark, text.title_core(F.col("a")), titles) == ["fpga design intern", "software hardware engineer", ""]
    names = [("NVIDIA Corporation",), ("The Jump Trading Group",), ("AT&T Inc.",), ("Meta Platforms",), ("Group Holdings",), ("",)]
    assert values(spark, text.slugify_company(F.col("a")), names) == ["nvidia", "jump", "at and t inc.", "meta", "group holdings", ""]


def test_role_affinity_orders_titles(spark):
    tokens = text.role_tokens(text.title_core(F.col("a")))
    titles = [("Silicon Design Engineering Intern/Co-Op",), ("Hardware Engineer Intern",), ("Mechanical Engineer, Robotics Hardware",), ("Project Engineer Intern",), ("",)]
    got = values(spark, text.role_affinity(tokens, "Hardware Engineer Intern"), titles)
    assert got[1] == pytest.approx(1.0) and 0.8 < got[0] < 1.0 and got[2:] == [0.0, 0.0, 0.0]


def test_shingles_and_similarity(spark):
    s = text.shingles(F.col("a"))
    got = values(spark, s, [("a b c d e f",), ("a b",), ("",), (" ".join(f"w{i}" for i in range(400)),)])
    assert got[:3] == [["a b c d e", "b c d e f"], ["a b"], []] and len(got[3]) == 150
    pair = text.jaccard(text.shingles(F.col("a")), text.shingles(F.col("b")))
    assert values(spark, pair, [("a b c d e f", "a b c d e g"), ("a", "")]) == [pytest.approx(1 / 3), 0.0]


def test_discriminators_and_truncate(spark):
    assert values(spark, text.discriminators(F.col("a")), [("fpga verification intern",), ("systems test",), ("",)]) == [["hardware", "intern", "verification"], ["masters"], []]
    assert values(spark, text.truncate(F.col("a"), 12), [("one two three four",), ("short",)]) == ["one two…", "short"]


def test_strip_html(spark):
    html = "<p>Hi &amp; bye</p><script>x()</script><ul><li>One</li><li>Two</li></ul>"
    out = values(spark, text.strip_html(F.col("a")), [(html,), (None,), ("plain  text",)])
    assert "Hi & bye" in out[0] and "* One" in out[0] and "x()" not in out[0] and out[1:] == ["", "plain text"]


def test_canonical_urls(spark):
    rows = [
        ("https://job-boards.greenhouse.io/acme/jobs/12345?gh_src=abc&utm_source=x",), ("http://www.Example.com:80/a/?b=2&a=1&ref=q#top",), ("//example.com",), ("",), (None,),
        ("https://www.google.com/url?q=https%3A%2F%2Facme.com%2Fjob%3Fid%3D7%26utm_medium%3Dx",), ("https://boards.greenhouse.io/acme?gh_jid=5&token=1",),
    ]
    assert values(spark, urls.canonicalize_url(F.col("a")), rows) == [
        "https://job-boards.greenhouse.io/acme/jobs/12345", "https://example.com/a?a=1&b=2", "https://example.com/", None, None, "https://acme.com/job?id=7", "https://boards.greenhouse.io/acme?gh_jid=5&token=1",
    ]


def test_identities_and_hosts(spark):
    rows = [("https://boards.greenhouse.io/acme/jobs/12345",), ("https://jobs.lever.co/beta/ab-12",), ("https://acme.com/careers?gh_jid=9",), ("https://nvidia.wd5.myworkdayjobs.com/en-US/Site/job/CA/Intern_JR-1_R123",), ("https://x.example.com/a",)]
    assert values(spark, urls.ats_key(urls.ats_identity(F.col("a"))), rows) == ["greenhouse:acme:12345", "lever:beta:ab-12", "greenhouse:acme:9", "workday:nvidia:r123", None]
    assert values(spark, urls.classify_host(F.col("a")), [("https://jobs.lever.co/x",), ("www.linkedin.com/jobs",), ("https://nvidia.com",), (None,)]) == ["ats", "job_board", "company_careers", "unknown"]


def test_facts(spark):
    s = values(spark, facts.salary(F.col("a")), [("$45 - $60 per hour",), ("$120,000-$150,000 annually",), ("5+ years",), (None,)])
    assert [(x.min, x.max, x.period) if x else None for x in s] == [(45.0, 60.0, "hourly"), (120000.0, 150000.0, "yearly"), None, None]
    assert values(spark, facts.sponsorship(F.col("a")), [("US citizenship required; visa sponsorship available",), ("We will sponsor visas",), ("nothing",)]) == ["citizenship_required", "offered", "unknown"]
    assert values(spark, facts.terms(F.col("a")), [("Summer 2026 or autumn",)]) == [["Summer 2026", "Fall"]]
    assert values(spark, facts.employment_type(F.col("a"), F.col("b"), F.col("c")), [("FPGA Intern", "", "Full-time"), ("Engineer Co-op", "", None), ("Engineer", "our internship", None), ("Engineer", "", None)]) == ["internship", "co_op", "internship", "unknown"]
    due = values(spark, facts.deadline(F.col("a"), F.lit("2026-08-18").cast("date")), [("Apply by December 15, 2026",), ("applications closed March 1",), ("deadline is 2030-01-01",)])
    assert due == [datetime(2026, 12, 15, 23, 59, 59), None, None]
    places = values(spark, facts.parse_location(F.col("a")), [("Santa Clara, CA",), ("Remote",), ("Springfield, Illinois",), (None,)])
    assert [(p.city, p.state, p.key) for p in places] == [("Santa Clara", "CA", "bay_area"), (None, None, "remote"), ("Springfield", "IL", "springfield|il"), (None, None, "")]
    fit = facts.locations_compatible(facts.parse_location(F.col("a")), facts.parse_location(F.col("b")))
    assert values(spark, fit, [("Austin, TX", "Santa Clara, CA"), ("Austin, TX", None), ("Sunnyvale, CA", "San Jose, CA")]) == [False, True, True]


def test_locations_of_every_shape(spark):
    rows = [("Austin / TX",), ("Berlin, DE",), ("London|UK",), ("New York",), ("California",), ("Remote - US",), ("Remote",), ("Paris, Atlantis",), ("Dover, DE",), ("Portland, OR, USA",)]
    got = values(spark, facts.parse_location(F.col("a")), rows)
    assert [(p.city, p.state, p.country) for p in got] == [
        ("Austin", "TX", "US"), ("Berlin", "DE", "US"), ("London", None, "GB"), (None, "NY", None), (None, "CA", None), ("Remote - US", None, None), (None, None, None), ("Paris", None, "Atlantis"),
        ("Dover", "DE", "US"), ("Portland", "OR", "US"),
    ]
    assert values(spark, facts.country_code(F.col("a")), [("U.S.A",), (" united  kingdom ",), ("Narnia",), (None,)]) == ["US", "GB", "NARNIA", ""]


def test_sections(spark):
    text_ = "About us\nRequirements:\nC++\n\nNice to have\nRust\nWhat you'll do\nBuild things\n# Requirements\nlater"
    got = values(spark, facts.split_sections(F.col("a")), [(text_,), ("plain",), (None,)])
    assert (got[0].requirements, got[0].preferred, got[0].responsibilities) == ("C++", "Nice to have\nRust", "Build things")  # a blank line before a heading is the line that goes
    assert tuple(got[1]) == ("", "", "") == tuple(got[2])
