"""Recorded boards with push-down, sent digests, versions, streaming upserts and identity look-up."""

from __future__ import annotations

import json
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from stratalist.operators import records, state
from stratalist.sources import boards, digests
from stratalist.streaming.upserts import merged, upsert_stream
from stratalist.versions import Conflict, VersionedTable

NOW = datetime(2026, 8, 18, 12)


@pytest.fixture
def run(spark, tmp_path):
    boards.register(spark)
    path = str(tmp_path / "run")
    pages = [
        ("lever", "a", json.dumps([{"id": "1", "text": "FPGA Intern", "descriptionPlain": "x"}, {"id": 2, "text": "Sales Intern"}])), ("lever", "a", json.dumps([{"id": "3", "text": None}])),
        ("lever", "bad", '[{"id": "4", '), ("lever", "odd", json.dumps({"jobs": 5})), ("ashby", "c", json.dumps({"jobs": [{"id": "5", "title": "Engineer"}]})), ("ashby", "none", json.dumps({"jobs": []})),
    ]
    boards.record(spark.createDataFrame(pages, "provider string, board string, payload string"), path)
    registry = [("lever", "a", False), ("lever", "bad", False), ("lever", "odd", True), ("ashby", "c", False), ("ashby", "none", False), ("greenhouse", "gone", False), ("greenhouse", "guess", True)]

    def load(**options):
        return spark.read.format("recorded_boards").options(path=path, boards=boards.registry_option(registry), **options).load()

    return load


def test_boards_fail_alone(run):
    rows = {(r.board, r.source_job_id): r for r in run().collect()}
    assert set(rows) == {("a", "1"), ("a", "2"), ("a", "3"), ("c", "5")} and json.loads(rows["a", "1"].posting)["descriptionPlain"] == "x"
    status = {r.board: r for r in run(mode="status").collect()}
    assert {b: (r.ok, r.found) for b, r in status.items()} == {"a": (True, 3), "bad": (False, 0), "odd": (False, 0), "c": (True, 1), "none": (True, 0), "gone": (False, 0), "guess": (False, 0)}
    assert status["gone"].error == "FileNotFoundError: no recorded payload" and status["bad"].error.startswith("JSONDecodeError")
    health = {r.source: r for r in boards.source_status(run(mode="status"), {"usajobs": ["key", "mail"], "adzuna": ["id"]}, ["id", "key"], ["workable"]).collect()}
    assert {s: (r.status, r.attempted, r.succeeded, r.found) for s, r in health.items()} == {
        "lever": ("degraded", 2, 1, 3), "ashby": ("ok", 2, 2, 1), "greenhouse": ("failed", 1, 0, 0), "usajobs": ("unconfigured", 0, 0, 0), "adzuna": ("ok", 0, 0, 0), "workable": ("ok", 0, 0, 0),
    }
    assert health["lever"].error == "1/2 boards succeeded" and health["usajobs"].error == "missing credentials: mail" and health["greenhouse"].error.startswith("all 1 registered boards failed: gone: FileNotFound")
    assert sorted(tuple(r) for r in boards.board_yield(run(mode="status")).collect()) == [("ashby", "c", 1), ("ashby", "none", 0), ("lever", "a", 3)]


def test_a_recorded_registry_reads_alike_in_few_partitions(spark, tmp_path):
    boards.register(spark)
    many = [("lever", f"b{i}", json.dumps([{"id": f"{i}-{j}", "text": f"Intern {j}"}])) for i in range(300) if i % 9 for j in range(2)]
    many += [("lever", "b5", "[{"), ("lever", "b6", "  "), ("ashby", "c", json.dumps({"jobs": [{"id": "5", "title": "a\tb"}]})), ("ashby", "stray", json.dumps({"jobs": [{"id": "6"}]}))]
    registry = [("lever", f"b{i}", i % 7 == 0) for i in range(300)] + [("ashby", "c", False), ("ashby", "tab\tname", True)]
    payloads = spark.createDataFrame(many, "provider string, board string, payload string")
    one, both = str(tmp_path / "one"), str(tmp_path / "both")
    boards.record(payloads, one)
    boards.record_run(payloads, spark.createDataFrame(registry, "provider string, board string, speculative boolean"), both)
    old = lambda **o: spark.read.format("recorded_boards").options(path=one, boards=boards.registry_option(registry), **o).load()
    new = lambda **o: spark.read.format("recorded_boards").options(path=both, **o).load()
    for o in ({}, {"mode": "status"}):
        assert sorted(map(str, new(**o).collect())) == sorted(map(str, old(**o).collect()))
    assert new(mode="status").rdd.getNumPartitions() < 100 < old(mode="status").rdd.getNumPartitions()
    assert [r.source_job_id for r in new().where("provider = 'ashby' and board in ('c', 'x')").collect()] == ["5"]


def test_queries_fail_only_together(spark):
    rows = [("x", f"q{i}", i, i == 13, 5) for i in range(14)] + [("y", "a", 0, True, 2), ("y", "b", 1, False, 9)]
    got = {r.source: (r.attempted, r.succeeded, r.found, r.status, r.error) for r in boards.query_status(spark.createDataFrame(rows, "source string, query string, at int, ok boolean, found long")).collect()}
    assert got == {"x": (12, 0, 0, "failed", "all 12 queries failed"), "y": (2, 1, 2, "ok", None)}


def test_filters_reach_the_reader(spark, run):
    wanted = F.contains("title", F.lit("Intern")) & (F.col("provider") == "lever") & (F.length("title") < 12)
    own = run().where(wanted)
    assert [r.source_job_id for r in own.collect()] == ["1"]
    every = run()
    assert [r.source_job_id for r in spark.createDataFrame(every.collect(), every.schema).where(wanted).collect()] == ["1"]  # the same rows when Spark judges alone
    above = own._jdf.queryExecution().executedPlan().toString().split("BatchScan")[0]
    assert "length(title" in above and "Contains(title" not in above and "provider" not in above.split("Filter")[-1]
    assert {r.source_job_id for r in run(title_terms='["fpga", "engineer"]').collect()} == {"1", "5"}
    assert {r.source_job_id for r in run(intern_titles='["fpga"]').collect()} == {"1", "3"}  # an empty title passes; sales is off the domain


def test_dropped_postings_are_never_read():
    class Posting(dict):
        def __getitem__(self, key):
            raise AssertionError(f"{key} was read")

        def get(self, key, default=None):
            assert key in ("id", "text"), f"{key} was read"
            return super().get(key, default)

    page = [Posting(id=i, text=t, descriptionPlain="long") for i, t in enumerate(["Intern", "Engineer", None])]
    reader = boards.BoardReader({"path": "p", "boards": '[["lever", "a", false], ["ashby", "b", false]]'})
    from pyspark.sql.datasource import EqualTo, Not, StringContains

    filters = [StringContains(("title",), "Intern"), EqualTo(("provider",), "lever"), Not(EqualTo(("title",), "x")), EqualTo(("posting",), "x")]
    assert list(reader.pushFilters(filters)) == filters[2:] and [b.board for b in reader.partitions()] == ["a"]
    kept = boards.postings(page, "lever", boards.title_judge(reader.on_title, [], None))
    assert [(k, t) for k, t, _ in kept] == [("0", "Intern")]


def test_digests_are_written_once(spark, tmp_path):
    path = str(tmp_path / "sent")
    rows = spark.createDataFrame([(f"t{i}", "s", "täxt\nx", [i, i + 1]) for i in range(5)], "at string, subject string, text string, job_ids array<long>").repartition(3)
    digests.append_digests(rows, path, "one")
    digests.append_digests(rows, path, "one")  # a replay
    digests.append_digests(rows.limit(1), path, "two")
    assert digests.read_digests(spark, path).count() == 6 and digests.read_digests(spark, path).where("text = 'täxt\nx'").count() == 6
    assert len([f for f in os.listdir(path) if f.endswith(".jsonl")]) == sum(map(len, digests.recorded(path).values()))
    fails = rows.withColumn("text", F.when(F.col("at") == "t3", F.raise_error(F.lit("no"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="no"):
        digests.append_digests(fails, path, "three")
    assert digests.read_digests(spark, path).count() == 6 and "batch-three" not in digests.recorded(path)
    assert digests.read_digests(spark, str(tmp_path / "empty")).count() == 0


KINDS = "k long, v string, at long"


def frame(spark, *rows):
    return spark.createDataFrame(rows, KINDS)


def take(store, new, order="at"):
    return store.write(lambda known: merged(known, new, store.key, order), new)


def content(df):
    return sorted(tuple(r) for r in df.collect())


def test_versions(spark, tmp_path):
    store = VersionedTable(spark, f"file://{tmp_path}/t", "k", buckets=8)
    assert store.read() is None and store.versions() == []
    assert take(store, frame(spark, *[(i, "a", 1) for i in range(50)])) == 1
    assert take(store, frame(spark, (3, "b", 2), (4, "old", 0), (99, "n", 1), (99, "m", 2))) == 2
    want = sorted([(i, "a", 1) for i in range(50) if i != 3] + [(3, "b", 2), (99, "m", 2)])
    assert content(store.read()) == want and content(store.read(1)) == sorted((i, "a", 1) for i in range(50))
    one, two = store.manifest(1)["buckets"], store.manifest(2)["buckets"]
    assert 0 < sum(one[b] != two[b] for b in one) <= 3  # only what was touched
    assert content(store.changes(1, 2)) == [(3, "changed"), (99, "added")] and content(store.changes(2, 1)) == [(3, "changed"), (99, "removed")]
    # A writer that fails midway leaves the last version as it was.
    with pytest.raises(Exception, match="midway"):
        store.write(lambda known: known.withColumn("v", F.raise_error(F.lit("midway")).cast("string")), frame(spark, (3, "c", 3)))
    assert store.versions() == [1, 2] and content(store.read()) == want
    # Of two writers from one version the second fails.
    late = store.manifest()
    take(store, frame(spark, (5, "c", 3)))
    with pytest.raises(Conflict):
        store._publish({**late, "version": late["version"] + 1})
    store.expire(1)
    assert store.versions() == [3] and len(content(store.read())) == 51
    with pytest.raises(ValueError, match="touched"):
        store.write(lambda known: frame(spark, *[(i, "z", 9) for i in range(40)]), frame(spark, (1, "z", 9)))
    assert take(store, frame(spark)) == 4 and len(content(store.read())) == 51


def test_streams_into_versions(spark, tmp_path):
    store = VersionedTable(spark, f"file://{tmp_path}/t", "k", buckets=4)
    src, checkpoint = f"{tmp_path}/in", f"{tmp_path}/ck"
    frame(spark, (1, "a", 1), (2, "a", 1), (None, "x", 1)).write.parquet(src)
    stream = lambda: spark.readStream.schema(KINDS).parquet(src)
    upsert_stream(stream(), store, "at", checkpoint, "s").awaitTermination()
    frame(spark, (2, "b", 2), (3, "c", 1), (1, "older", 0)).write.mode("append").parquet(src)
    upsert_stream(stream(), store, "at", checkpoint, "s").awaitTermination()
    assert content(store.read()) == [(1, "a", 1), (2, "b", 2), (3, "c", 1)] and store.versions() == [1, 2]
    # The same batch again, as after a failure between the table's commit and the checkpoint's.
    batch = frame(spark, (2, "replayed", 9))
    assert store.write(lambda known: merged(known, batch, store.key, "at"), batch, ("s", 1)) == 2 and content(store.read())[1] == (2, "b", 2)
    both = VersionedTable(spark, f"file://{tmp_path}/u", "k", buckets=4)
    take(both, spark.read.schema(KINDS).parquet(src).dropna(subset=["k"]))
    assert content(both.read()) == content(store.read())


def test_identities(spark):
    guards = "company_slug string, requisition_id string, ats_identity string, discriminators array<string>"
    heads = spark.createDataFrame([(i, "f", "c", req, ats, tags) for i, req, ats, tags in ((1, "", "", []), (2, "", "", []), (3, "r9", "", []), (4, "", "", ["summer"]), (5, "", "", []), (6, " R1 ", "", []))], f"cluster long, fingerprint string, {guards}")
    heads = heads.withColumn("company_slug", F.when(F.col("cluster") == 5, "other").otherwise(F.col("company_slug")))
    members = spark.createDataFrame([(1, 0, "s/1", "g:1", "u1"), (2, 0, "s/none", "g:2", "u1"), (2, 1, "s/2", "", ""), (3, 0, "", "g:1", ""), (3, 1, "", "g:3", "")], "cluster long, member int, source_key string, ats_identity string, url_hash string")
    jobs = spark.createDataFrame([(10, "", "c", "", "g:3", []), (11, "f", "c", "r1", "", ["fall"]), (12, "f", "c", "r1", "", ["fall"])], f"job_id long, fingerprint string, {guards}").select("job_id", "fingerprint", *records.GUARDED)
    listings = spark.createDataFrame([(20, "s/1", "g:1", "u1"), (19, "s/0", "", "u1"), (21, "s/2", "", "")], "job_id long, source_key string, ats_identity string, url_hash string")
    companies = spark.createDataFrame([(7, "c"), (8, "d")], "company_id long, company_slug string")
    got = {r.cluster: tuple(r)[1:] for r in records.lookup_identities(members, heads, jobs, listings, companies).collect()}
    # a later member's source key goes before an earlier one's url; the first member's listing identity before the second's job identity
    assert got == {1: (20, "source_key", 7), 2: (21, "source_key", 7), 3: (20, "listing_ats", 7), 4: (None, None, 7), 5: (None, None, None), 6: (11, "fingerprint", 7)}


def test_pay_is_filled_as_a_pair(spark):
    kinds = "k long, low double, high double"
    old = spark.createDataFrame([(1, 5.0, 9.0, True, NOW, NOW), (2, 5.0, 9.0, True, NOW, NOW)], f"{kinds}, is_active boolean, first_seen timestamp_ntz, last_seen timestamp_ntz")
    rows = state.upsert(old, spark.createDataFrame([(1, 7.0, None), (2, None, 8.0), (3, 1.0, 2.0)], kinds), "k", [], [], NOW, (("low", "high"),))
    assert sorted((r.k, r.low, r.high) for r in rows.collect()) == [(1, 7.0, None), (2, 5.0, 9.0), (3, 1.0, 2.0)]
