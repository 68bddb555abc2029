"""HTML, model replies, table functions, resumes and how things are told."""

from __future__ import annotations

import io
import json
import time
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stratalist.functions import display, html, model_output, table_functions
from stratalist.operators import records
from stratalist.sources.resumes import read_resumes

NOW = datetime(2026, 8, 18, 12)


def column(spark, expr, values, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"a {kind}").coalesce(1)
    return [r[0] for r in df.select(expr(F.col("a"))).collect()]


def test_html(spark):
    cases = {
        "<p>One</p><p>Two &amp; three</p>": "One\n\nTwo & three", "<ul><li>a<li>b</li></ul>": "* a\n* b", "x<script>if (a < b) { '</p>' }</script>y": "x y", "x<script>never ends": "x", "x<style>p{}</STYLE >y": "x y",
        "a<!-- <p>no</p> -- > -->b": "a b", "a<!-- open": "a<!-- open", "<p>a<!-- open": "a", '<a title="x > y" href=\'>\'>link</a>': "link", "<a title=it's>ok</a>": "ok", '<a title="open>lost': "", "1 < 2 <b>bold</b>": "1 < 2 bold",
        "<b>&eacute;&#233;&#xe9;&hellip;&notanentity;</b>": "ééé...¬anentity;", "<!DOCTYPE html><p>x": "x", "ﬁ<br>ﬁ": "fi\nfi", "a  b\n\n\n c": "a b\n\n c", "5 &lt; 6": "5 &lt; 6", "<p>nbsp&nbsp;here": "nbsp here", "<>a</>b": "<>a b", "no tag < at all": "no tag < at all",
    }
    got = column(spark, html.strip_html, [*cases, None])
    assert dict(zip(cases, got, strict=False)) == cases and got[-1] == ""


@pytest.mark.parametrize("text", ["<" * 1_000_000, "<!--" * 250_000, "<a b='" * 160_000, "<script>" * 120_000, "=" * 1_000_000 + "<a " + "=" * 500_000, "<a " + "= " * 400_000, "<li>" * 250_000, "&" * 1_000_000, "</script" * 120_000, "<p" + " " * 900_000])
def test_html_of_a_megabyte_is_read_at_once(text):
    at = time.process_time()
    html.read(text)
    assert time.process_time() - at < 5


REPLIES = {
    "ok": '{"skills": [" FPGA ", "fpga", "Teamwork", "", 5, "%s"], "domain": "ML", "seniority": "new grad", "is_internship": true, "sponsorship": "Offered", "min_years_experience": 2, "terms": ["Summer 2027 and many more words", " "], "summary": " a \\n b "}' % ("x" * 41),
    "fence": '```json\n{"domain": "hardware", "is_internship": "true", "min_years_experience": "3.5"}\n``` and {more', "words": 'Here: {"domain": "cooking", "min_years_experience": 31, "skills": "c"} ok', "nested": '{"skills": [{"a": 1}], "summary": {"x": [1, {"y": 2}]}, "terms": "Summer"}',
    "broken": '{"skills": ["a", }', "cut": '{"skills": ["a"', "none": "no braces", "array": '[{"domain": "ml"}', "reversed": "} {", "empty": "  ", "null": None, "long": '{"a": "' + "x" * 100_001 + '"}', "deep": "{" + '"a":{' * 400 + "}" * 401, "list": '["a"]', "null_years": '{"min_years_experience": null, "skills": null}',
}


def test_replies(spark):
    rows = spark.createDataFrame(list(REPLIES.items()), "k string, reply string")
    got = {r.k: r for r in model_output.with_reply(rows, "reply").withColumn("f", model_output.facts(F.col("reply_json"))).withColumn("a", model_output.assessment(F.col("reply_json"))).drop("reply_json").collect()}
    status = {k: r.reply_status for k, r in got.items()}
    assert {k for k, s in status.items() if s == "ok"} == {"ok", "fence", "words", "nested", "array", "null_years"} | ({"deep"} if status["deep"] == "ok" else set())
    assert (status["broken"], status["cut"], status["none"], status["reversed"], status["empty"], status["null"], status["long"], status["list"]) == ("broken", "no_object", "no_object", "no_object", "empty", "empty", "oversized", "no_object")
    f = got["ok"].f
    assert (f.skills, f.domain, f.seniority, f.is_internship, f.sponsorship, f.min_years_experience, f.terms, f.summary) == (["fpga", "5"], "ml", "new_grad", True, "offered", 2.0, ["Summer 2027 and many mor"], "a b")
    assert (got["fence"].f.domain, got["fence"].f.is_internship, got["fence"].f.min_years_experience) == ("hardware", None, 3.5)
    assert (got["words"].f.domain, got["words"].f.skills, got["words"].f.min_years_experience) == ("unknown", [], None) and got["nested"].f.terms == [] and got["broken"].f is None
    assert got["null_years"].f.min_years_experience is None and got["null_years"].f.skills == []


def test_assessments_and_facts_feed_the_rest(spark):
    said = [json.dumps(x) for x in ({"relevance": 1.7, "role_match": True, "sponsorship": "Offered", "recommendation": "apply", "reason": "r" * 500}, {"relevance": "high", "recommendation": "buy", "sponsorship": "citizenship_required"})]
    rows = model_output.with_reply(spark.createDataFrame(list(enumerate(said)), "k int, reply string").coalesce(1), "reply")
    a, b = (r[0] for r in rows.select(model_output.assessment(F.col("reply_json"))).collect())
    assert (a.relevance, a.role_match, a.sponsorship, a.recommendation, len(a.reason)) == (1.0, True, "offered", "APPLY", 400) and (b.relevance, b.recommendation, b.sponsorship) == (0.0, "SKIP", "unknown")
    jobs = spark.createDataFrame([(1, ["Python"], [], None, "h1"), (2, ["C"], ["Fall"], 1.0, "h2")], "job_id long, skills array<string>, terms array<string>, years double, content_hash string")
    replies = spark.createDataFrame([(1, '{"skills": ["python", "Rust"], "terms": ["Summer"], "min_years_experience": 2}'), (2, "broken {")], "job_id long, reply string")
    got = {r.job_id: r for r in records.apply_facts(jobs, model_output.read_facts(replies, "job_id", "reply"), "m", NOW).collect()}
    assert (got[1].skills, got[1].terms, got[1].years, got[1].enrichment_hash) == (["Python", "rust"], ["Summer"], 2.0, "h1") and (got[2].skills, got[2].enriched_at) == (["C"], None)


def test_table_functions(spark):
    table_functions.register(spark)
    got = [tuple(r) for r in spark.sql("select * from search_phrases(array('Pilot'), array('uvm'), array('Austin'), 5)").collect()]
    assert got == [("Pilot intern", None), ("uvm intern", None), ("Pilot intern", "Austin"), ("uvm intern", "Austin")]
    assert [tuple(r) for r in spark.sql("select * from search_phrases(array())").collect()] == [("engineering intern", None)]
    with pytest.raises(Exception, match="array of strings"):
        spark.sql("select * from search_phrases('Pilot')").collect()
    seen = spark.createDataFrame([("lever", "a", "B", "s2", "x", 2), ("lever", "a", "A", "s1", "", 1), ("lever", "a", "C", "s3", "y", 3), ("ashby", "a", "D", "s4", None, 1)], "provider string, board string, company string, source string, extra string, at long").repartition(3)
    rows = spark.sql("select * from harvest_boards(table({seen}))", seen=seen).collect()
    assert sorted(map(tuple, rows), key=str) == [("ashby", "a", "D", "s4", None, 1), ("lever", "a", "A", "s1", "x", 3)]
    folded = table_functions.fold_seen(seen.unionByName(seen.where("at = 3")))  # at most two rows of a board reach Python
    assert sorted(tuple(r) for r in folded.select("provider", "company", "n").collect()) == [("ashby", "D", 1), ("lever", "A", 4), ("lever", "B", 0)]
    rows = spark.sql("select * from harvest_boards(table({seen}))", seen=folded).collect()
    assert sorted(map(tuple, rows), key=str) == [("ashby", "a", "D", "s4", None, 1), ("lever", "a", "A", "s1", "x", 4)]
    with pytest.raises(Exception, match="it lacks at"):
        spark.sql("select * from harvest_boards(table({seen}))", seen=seen.drop("at")).collect()


def test_resumes(spark, tmp_path):
    doc = io.BytesIO()
    with zipfile.ZipFile(doc, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:t>Rust</w:t><w:t>and Ada</w:t></w:p></w:document>')
    files = {"a.txt": "Python\nC".encode(), "b.MD": b"# x", "c.docx": doc.getvalue(), "d.docx": b"no zip", "e.pdf": rb"%PDF BT (Go \(lang\)) Tj (Erlang) Tj", "f.png": b"x", "g.txt": b"", "i.txt": b" ", "h.txt": b"\xff ok"}
    for name, raw in files.items():
        (tmp_path / name).write_bytes(raw)
    got = {r.name: (r.text, r.status) for r in read_resumes(spark, str(tmp_path)).collect()}
    assert got["d.docx"][1].startswith("BadZipFile") and got.pop("d.docx")[0] == ""
    assert got == {"a.txt": ("Python\nC", "ok"), "b.MD": ("# x", "ok"), "c.docx": ("Rust and Ada", "ok"), "e.pdf": ("Go (lang) Erlang", "ok"), "f.png": ("", "unknown"), "h.txt": (" ok", "ok"), "i.txt": (" ", "empty")}


def test_times_and_pay(spark):
    ago = lambda **k: NOW - timedelta(**k)
    cases = {None: "unknown", ago(seconds=-5): "just now", ago(seconds=59): "just now", ago(minutes=61): "1h ago", ago(minutes=5): "5m ago", ago(hours=25): "yesterday", ago(days=29): "29 days ago", ago(days=30): "1 month ago", ago(days=364): "12 months ago", ago(days=800): "2 years ago"}
    assert column(spark, lambda c: display.time_ago(c, NOW), list(cases), "timestamp_ntz") == list(cases.values())
    badge = lambda c: display.deadline_badge(c, F.lit(True), NOW)
    rows = column(spark, badge, [None, ago(seconds=1), ago(hours=-47), ago(hours=-71), ago(days=-7), ago(days=-8)], "timestamp_ntz")
    assert [tuple(r) for r in rows] == [("none", "No deadline listed"), ("passed", "Deadline passed"), ("urgent", "Deadline in 1 day"), ("urgent", "Deadline in 2 days"), ("soon", "Deadline in 7 days"), ("ok", "Deadline in 8 days")]
    assert column(spark, lambda c: display.deadline_badge(c, F.lit(False), NOW)["level"], [ago(days=-1)], "timestamp_ntz") == ["none"]
    times = [None, datetime(2026, 8, 19, 3, 30), datetime(2026, 8, 19, 12, 0), datetime(2026, 12, 1, 15, 5)]
    assert column(spark, lambda c: display.when_text(c, "America/New_York", NOW), times, "timestamp_ntz") == ["", "today at 23:30", "tomorrow at 08:00", "Tue 01 Dec at 10:05"]
    assert column(spark, lambda c: display.local_hour(c, "America/New_York"), times[2:], "timestamp_ntz") == [8, 10]
    pay = spark.createDataFrame([(None, 5.0, None, None), (45.5, 60.0, None, "hourly"), (120000.0, 120000.0, "GBP", "yearly"), (1000.5, 2000.0, "CHF", "x"), (50.0, None, "EUR", "monthly")], "l double, h double, c string, p string").coalesce(1)
    assert [r[0] for r in pay.select(display.salary_text(*(F.col(c) for c in "lhcp"))).collect()] == ["Not listed", "$45.5–$60/hr", "£120,000/yr", "1,000–2,000", "€50/mo"]
    assert column(spark, display.humanize, ["worth_considering", None]) == ["Worth Considering", ""] and column(spark, display.score_class, [90.0, 69.9, None], "double") == ["score-90", "score-60", "score-low"]
