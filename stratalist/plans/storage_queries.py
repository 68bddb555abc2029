"""Recorded boards, versions of a table, and look-ups of stored identities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import records, state
from ..sources import boards
from ..storage import new_path, table
from ..versions import VersionedTable
from . import bindings as b
from . import listing_queries as lq

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Postings on a page of a board.
PAGE = 50


def _run(spark, sf):
    """A recorded run: suppliers are boards, the lines they ship are postings. Every tenth board has a page that is no JSON, every eleventh was
    not recorded; every seventh is a guess."""
    s = table(spark, sf, "supplier").select("s_suppkey", F.element_at(F.array(*map(F.lit, ("lever", "ashby", "greenhouse"))), (F.col("s_nationkey") % 3 + 1).cast("int")).alias("provider"), F.concat(F.lit("b"), "s_suppkey").alias("board"))
    i = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    i = i.withColumns({"key": F.concat_ws("-", "l_orderkey", "l_linenumber"), "title": F.concat_ws(" ", F.element_at(F.array(*map(F.lit, ("air", "mail", "rail", "truck"))), (F.col("l_partkey") % 4 + 1).cast("int")), F.when(F.col("l_returnflag") == "N", "intern").otherwise("engineer"))})
    # Pages by a hash, so that no board is gathered in one row however many postings it has.
    per = i.groupBy("l_suppkey").agg(F.ceil(F.count("*") / PAGE).alias("n_pages"))
    rows = i.join(per, "l_suppkey").join(s, i["l_suppkey"] == s["s_suppkey"]).withColumn("page", F.pmod(F.xxhash64("key"), F.col("n_pages")))
    rows = rows.where("s_suppkey % 11 <> 5")
    jobs = rows.groupBy("provider", "board", "s_suppkey", "page").agg(F.collect_list(F.struct("key", "title")).alias("jobs"))
    # The id and title go under the names that each provider uses.
    named = lambda title: F.transform("jobs", lambda x: F.struct(x["key"].alias("id"), x["title"].alias(title)))
    payload = F.when(F.col("provider") == "lever", F.to_json(named("text"))).otherwise(F.to_json(F.struct(named("title").alias("jobs"))))
    broken = (F.col("s_suppkey") % 10 == 3) & (F.col("page") == 0)
    path = new_path(spark, "boards")
    pages = jobs.select("provider", "board", F.when(broken, F.substring(payload, 1, 20)).otherwise(payload).alias("payload"))
    boards.record_run(pages, s.select("provider", "board", (F.col("s_suppkey") % 7 == 0).alias("speculative")), path)
    return path


def _read(spark, sf, **options):
    boards.register(spark)
    return spark.read.format("recorded_boards").options(path=_run(spark, sf), **options).load()


_BOARDS_SQL = """i AS (SELECT *, l_orderkey || '-' || l_linenumber AS key, (['air', 'mail', 'rail', 'truck'])[l_partkey % 4 + 1] || ' ' || CASE WHEN l_returnflag = 'N' THEN 'intern' ELSE 'engineer' END AS title FROM lineitem),
s AS (SELECT s_suppkey, (['lever', 'ashby', 'greenhouse'])[s_nationkey % 3 + 1] AS provider, 'b' || s_suppkey AS board, s_suppkey % 7 = 0 AS speculative FROM supplier),
n AS (SELECT l_suppkey, count(*) AS found FROM lineitem GROUP BY 1), st AS (SELECT s.*, n.found IS NOT NULL AND s_suppkey % 11 <> 5 AND s_suppkey % 10 <> 3 AS ok, CASE WHEN n.found IS NOT NULL AND s_suppkey % 11 <> 5 AND s_suppkey % 10 <> 3 THEN n.found ELSE 0 END AS found
  FROM s LEFT JOIN n ON n.l_suppkey = s.s_suppkey)"""


@query(f"""WITH {_BOARDS_SQL}, g AS (SELECT provider AS source, count(*) FILTER (NOT speculative) AS attempted, count(*) FILTER (ok AND NOT speculative) AS succeeded, CAST(sum(found) AS BIGINT) AS found FROM st GROUP BY 1)
SELECT source, attempted, succeeded, CASE WHEN attempted > 0 AND succeeded = 0 THEN 0 ELSE found END AS found, CASE WHEN attempted > 0 AND succeeded = 0 THEN 'failed' WHEN succeeded < attempted THEN 'degraded' ELSE 'ok' END AS status FROM g
UNION ALL SELECT 'usajobs', 0, 0, 0, 'unconfigured' UNION ALL SELECT 'workable', 0, 0, 0, 'ok'""")
def board_runs(spark, sf):
    """The health of each source after a run in which boards are missing and broken."""
    status = _read(spark, sf, mode="status")
    return boards.source_status(status, needs={"usajobs": ["usajobs_key"]}, sources=["workable"]).select("source", "attempted", "succeeded", "found", "status")


@query(f"WITH {_BOARDS_SQL} SELECT provider, board, found FROM st WHERE ok AND NOT speculative")
def board_yields(spark, sf):
    return boards.board_yield(_read(spark, sf, mode="status"))


@query(f"WITH {_BOARDS_SQL} SELECT provider, board, key AS source_job_id, title FROM i JOIN st ON l_suppkey = s_suppkey WHERE ok AND provider <> 'lever' AND contains(title, 'intern') AND title LIKE 'a%'")
def board_postings(spark, sf):
    """Postings by title and source; the reader drops the others before it makes them."""
    rows = _read(spark, sf).where(F.col("provider").isin("ashby", "greenhouse") & F.contains("title", F.lit("intern")) & F.startswith("title", F.lit("a")))
    return rows.select("provider", "board", "source_job_id", "title")


@query(lq._DAYS_SQL + """, a AS (SELECT o_orderkey, price, level, deadline, requirements FROM old), z AS (SELECT o_orderkey, price, level, deadline, requirements FROM m)
SELECT z.o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'added' ELSE 'changed' END AS change FROM z LEFT JOIN a ON a.o_orderkey = z.o_orderkey
WHERE a.o_orderkey IS NULL OR a.price IS DISTINCT FROM z.price OR a.level IS DISTINCT FROM z.level OR a.deadline IS DISTINCT FROM z.deadline OR a.requirements IS DISTINCT FROM z.requirements""")
def snapshot_changes(spark, sf):
    """Two versions of a table, the second by a run that rewrites only the buckets it touches, and what differs between them."""
    old, new = lq._days(spark, sf)
    columns = ["o_orderkey", "price", "level", "deadline", "requirements"]
    store = VersionedTable(spark, new_path(spark, "versions"), "o_orderkey")
    store.write(lambda _: old.select(*columns), old)
    stamped = lambda rows: rows.withColumns({"is_active": F.lit(True), "first_seen": F.lit(b.NOW).cast("timestamp_ntz"), "last_seen": F.lit(b.NOW).cast("timestamp_ntz")})
    store.write(lambda known: state.upsert(stamped(known), new, "o_orderkey", lq._FILL, ["level"], b.NOW).select(*columns), new)
    return store.changes(1, 2)


def _stored(spark, sf):
    """Orders of odd keys are stored jobs with listings; those of even keys are clusters of a run, with two members each."""
    o = table(spark, sf, "orders")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    facts = o.select(
        k.alias("id"), c.alias("c"), text("co", c % 300).alias("company_slug"), F.md5(text(c % 300, "|", F.col("o_orderpriority"))).alias("fingerprint"), F.when(k % 5 == 0, text("R", k % 3)).alias("requisition_id"),
        F.when(k % 13 == 0, text("g:", c % 800)).otherwise("").alias("ats_identity"), F.when(k % 4 < 2, F.array(F.lit("summer"))).otherwise(F.array(F.lit("fall"), F.lit("design"))).alias("discriminators"),
        text("s/", c % 1000, "/", F.floor(k / 2) % 40).alias("source_key"), F.when(k % 9 == 0, text("u", c % 900)).alias("url_hash"), F.when(k % 7 == 0, text("l:", c % 500)).alias("listing_ats"),
    )
    old, new = facts.where("id % 2 = 1"), facts.where("id % 2 = 0")
    jobs = old.select(F.col("id").alias("job_id"), "fingerprint", *records.GUARDED)
    listings = old.select(F.col("id").alias("job_id"), "source_key", F.col("listing_ats").alias("ats_identity"), "url_hash")
    heads = new.select(F.col("id").alias("cluster"), "fingerprint", *records.GUARDED)
    first = F.struct(F.lit(0).alias("member"), F.col("source_key"), F.col("ats_identity"), F.lit("").alias("url_hash"))
    second = F.struct(F.lit(1).alias("member"), F.lit("").alias("source_key"), F.coalesce("listing_ats", F.lit("")).alias("ats_identity"), F.coalesce("url_hash", F.lit("")).alias("url_hash"))
    members = new.select(F.col("id").alias("cluster"), F.explode(F.array(first, second)).alias("m")).select("cluster", "m.*")
    companies = old.groupBy("company_slug").agg(F.min("c").alias("company_id"))
    return members, heads, jobs, listings, companies


@query("""WITH f AS (SELECT o_orderkey AS id, o_custkey AS c, 'co' || o_custkey % 300 AS slug, md5(o_custkey % 300 || '|' || o_orderpriority) AS fp, CASE WHEN o_orderkey % 5 = 0 THEN 'R' || o_orderkey % 3 END AS req, CASE WHEN o_orderkey % 13 = 0 THEN 'g:' || o_custkey % 800 END AS ats,
CASE WHEN o_orderkey % 4 < 2 THEN 'summer' ELSE 'fall' END AS season, 's/' || o_custkey % 1000 || '/' || (o_orderkey // 2) % 40 AS sk, CASE WHEN o_orderkey % 9 = 0 THEN 'u' || o_custkey % 900 END AS url, CASE WHEN o_orderkey % 7 = 0 THEN 'l:' || o_custkey % 500 END AS lats FROM orders),
o AS (SELECT * FROM f WHERE id % 2 = 1), n AS (SELECT * FROM f WHERE id % 2 = 0),
h AS (SELECT n.id AS cluster, 0 AS p, 'source_key' AS kind, o.id AS job_id FROM n JOIN o ON o.sk = n.sk
  UNION ALL SELECT n.id, 10, 'job_ats', o.id FROM n JOIN o ON o.ats = n.ats UNION ALL SELECT n.id, 11, 'listing_ats', o.id FROM n JOIN o ON o.lats = n.ats
  UNION ALL SELECT n.id, 12, 'job_ats', o.id FROM n JOIN o ON o.ats = n.lats UNION ALL SELECT n.id, 13, 'listing_ats', o.id FROM n JOIN o ON o.lats = n.lats
  UNION ALL SELECT n.id, 20, 'url_hash', o.id FROM n JOIN o ON o.url = n.url
  UNION ALL SELECT n.id, 30, 'fingerprint', o.id FROM n JOIN o ON o.fp = n.fp AND o.slug = n.slug AND o.season = n.season AND coalesce(o.req = n.req, true) AND coalesce(o.ats = n.ats, true)),
w AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY p, job_id) AS rn FROM h), co AS (SELECT slug, min(c) AS company_id FROM o GROUP BY 1)
SELECT n.id AS cluster, w.job_id, w.kind AS matched_by, co.company_id FROM n LEFT JOIN w ON w.cluster = n.id AND w.rn = 1 LEFT JOIN co ON co.slug = n.slug""")
def identity_lookup(spark, sf):
    """The stored job and company of each cluster by identities of six kinds, in one join."""
    return records.lookup_identities(*_stored(spark, sf))
