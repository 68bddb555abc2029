from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import functions as F

from stratalist.sources import payloads as p
from stratalist.streaming import incremental, stateful


def frame(spark, payload, **board):
    rows = [(json.dumps(payload), *board.values()), ("broken", *board.values())]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in ("payload", *board)))


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_smartrecruiters_with_details(spark):
    item = {"id": "7", "name": "FPGA Intern", "company": {"name": "Acme"}, "location": {"city": "Austin", "region": "", "country": "us", "remote": True}, "releasedDate": "2026-01-02T03:04:05.000Z"}
    rows = p.read_board(frame(spark, {"content": [item, {"id": "", "name": "x"}]}, board_token="acme"), "smartrecruiters")
    ad = {"jobAd": {"sections": {"companyDescription": {"text": "We build."}, "jobDescription": {"text": "You build."}, "qualifications": {"text": "Verilog"}}}}
    details = spark.createDataFrame([("acme:7", json.dumps(ad))], "source_job_id string, payload string")
    r = one(p.with_details(rows, details))
    assert (r.source_job_id, r.url, r.location, r.remote_status) == ("acme:7", "https://jobs.smartrecruiters.com/acme/7", "Austin, us", "remote")
    assert (r.description, r.requirements, r.date_posted) == ("We build.\n\nYou build.", "Verilog", datetime(2026, 1, 2, 3, 4, 5))
    assert one(rows).description is None


def test_workable_and_recruitee(spark):
    w = one(p.read_board(frame(spark, {"results": [{"shortcode": "AB", "title": "T", "city": "Oslo", "country": "NO", "published_on": "2026-02-01"}]}, board_token="t", company_name="Tee"), "workable"))
    assert (w.source_job_id, w.company, w.url, w.location, w.date_posted) == ("t:AB", "Tee", "https://apply.workable.com/t/j/AB/", "Oslo, NO", datetime(2026, 2, 1))
    r = one(p.read_board(frame(spark, {"offers": [{"id": 5, "title": "T", "careers_apply_url": "u", "requirements": ""}]}, board_token="t", company_name=""), "recruitee"))
    assert (r.source_job_id, r.company, r.url, r.requirements) == ("t:5", "t", "u", None)


def test_open_boards_filter_by_terms(spark):
    terms = p.query_terms("FPGA of Design")
    assert terms == ["design", "fpga"]
    muse = [{"id": 1, "name": "FPGA Intern", "company": {"name": "A"}, "locations": [{"name": "X"}, {"name": "Y"}]}, {"id": 2, "name": "Designer", "company": {"name": "A"}}, {"id": 3, "name": "FPGA", "company": {"name": ""}}]
    assert one(p.read_board(frame(spark, {"results": muse}), "themuse", terms=terms)).locations == ["X", "Y"]
    arbeit = [{"slug": "s", "title": "Designer", "company_name": "B", "job_types": ["full"]}, {"slug": "u", "title": "Cook", "company_name": "B", "tags": ["Kitchen"]}]
    assert one(p.read_board(frame(spark, {"data": arbeit}), "arbeitnow", terms=terms)).employment_type == "full"
    r = one(p.read_board(frame(spark, {"jobs": [{"id": 1, "title": "T", "company_name": "C", "salary": ""}]}), "remotive"))
    assert (r.location, r.remote_status, r.salary_raw) == ("Remote", "remote", None)


def test_curated_lists_keep_the_first_of_an_id(spark):
    a = {"id": "1", "company_name": " C ", "title": "T", "url": "u", "sponsorship": "Offers Sponsorship"}
    rows = [a, a | {"title": "Later"}, a | {"id": "2", "active": False}, a | {"id": "3", "company_name": ""}, a | {"id": None, "url": "v", "sponsorship": "Other"}]
    got = sorted((r.source_job_id, r.company, r.title, r.sponsorship_hint) for r in p.read_board(frame(spark, rows, board_token="list"), "curated").collect())
    assert got == [("list:1", "C", "T", "We offer visa sponsorship."), ("list:v", "C", "T", None)]


def test_threads(spark):
    good = "<p>Acme Corp | Austin, TX | FPGA Engineer | <a href='x'>https:&#x2F;&#x2F;acme.example</a><p>Apply at https:&#x2F;&#x2F;jobs.lever.co&#x2F;acme&#x2F;1, fully remote"
    prose = "We are a very long winded company that writes prose | and not headers, sorry about that one"
    plain = "Beta - Cook - Paris, France - and a long enough line of text to be read at all"
    thread = {"created_at": "2026-01-01T00:00:00Z", "children": [{"id": 1, "text": good}, {"id": 2, "text": prose}, {"id": 3, "text": "short | one"}, {"id": 4, "text": plain}]}
    got = {r.source_job_id: r for r in p.read_thread(frame(spark, thread), datetime(2026, 2, 1)).collect()}
    assert sorted(got) == ["hn:1", "hn:4"]
    assert (got["hn:1"].title, got["hn:1"].location, got["hn:1"].remote_status) == ("FPGA Engineer", "Austin, TX", "remote")
    assert got["hn:1"].url.startswith("https://jobs.lever.co/acme/1")
    assert (got["hn:4"].company, got["hn:4"].title, got["hn:4"].location, got["hn:4"].url) == ("Beta", "Cook", "Paris, France", "https://news.ycombinator.com/item?id=4")
    assert p.read_thread(frame(spark, thread), datetime(2026, 6, 1)).count() == 0


def stream(spark, path, rows, schema):
    """A file source of one file a batch, in order of time."""
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{path}/b={i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(*[f"{path}/b=*"])


def at(day, hour=0):
    return datetime(2026, 1, day, hour)


def test_cool_down_over_batches(spark, tmp_path):
    rows = [[("a", at(1)), ("a", at(2)), ("b", at(1))], [("a", at(3, 23)), ("a", at(4)), ("b", at(9))]]
    out = stateful.cool_down(stream(spark, str(tmp_path / "in"), rows, "k string, ts timestamp"), "k", "ts")
    incremental.run_available(out, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("key", F.timestamp_millis("ms").cast("timestamp_ntz").alias("t")).collect()
    assert sorted((r.key, r.t) for r in got) == [("a", at(1)), ("a", at(4)), ("b", at(1)), ("b", at(9))]


def test_unseen_expire(spark, tmp_path):
    rows = [[("a", at(1)), ("b", at(1))], [("b", at(9))], [("c", at(18))], [("c", at(18, 1))]]
    out = stateful.expire_unseen(stream(spark, str(tmp_path / "in"), rows, "k string, ts timestamp"), "k", "ts")
    incremental.run_available(out, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.key, r.expired_ms - r.last_seen_ms) for r in got] == [("a", 10 * 24 * 3_600_000)]


def test_boards_are_given_up(spark, tmp_path):
    rows = [[("a", at(1), False), ("a", at(2), False), ("b", at(1), True)], [("a", at(3), False), ("b", at(2), False)], [("a", at(4), True)]]
    out = stateful.board_backoff(stream(spark, str(tmp_path / "in"), rows, "k string, ts timestamp, good boolean"), "k", "ts", "good", most=3)
    seen = []
    out.writeStream.foreachBatch(lambda df, i: seen.extend((i, *r) for r in df.drop("last_ok_ms").collect())).outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    last = {k: (n, on) for _, k, n, on in sorted(seen)}
    assert last == {"a": (0, False), "b": (1, True)}
