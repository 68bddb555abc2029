"""Queries of the list, counters, facets, state and digest."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analytics, digest, state
from ..operators.filters import ListFilter, apply_filters, page_of, with_user_state
from ..storage import table
from . import bindings as b
from .bindings import NOW, NOW_SQL, WITH

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def eff(spark: SparkSession, sf: str) -> DataFrame:
    return with_user_state(b.jobs(spark, sf), b.user_state(spark, sf))


@query(WITH + f"""SELECT job_id, company, eff_score, eff_status FROM eff WHERE is_active AND eff_status IN ('new', 'saved') AND eff_score >= 60 AND eff_score <= 95 AND lower(company) LIKE '%1%'
AND lower(title) LIKE '%intern%' AND remote_status = 'remote' AND salary_min IS NOT NULL AND date_posted >= {NOW_SQL} - INTERVAL 2000 DAY""")
def filter_multi_predicate(spark, sf):
    f = ListFilter(min_score=60, max_score=95, company="1", role="intern", remote_status="remote", has_salary=True, posted_within_days=2000)
    return apply_filters(b.jobs(spark, sf), f, NOW, b.user_state(spark, sf)).select("job_id", "company", "eff_score", "eff_status")


@query(WITH + f"SELECT job_id, deadline FROM eff WHERE is_active AND eff_status IN ('new', 'saved') AND deadline BETWEEN {NOW_SQL} AND {NOW_SQL} + INTERVAL 20 DAY")
def filter_deadline(spark, sf):
    return apply_filters(b.jobs(spark, sf), ListFilter(deadline_within_days=20), NOW, b.user_state(spark, sf)).select("job_id", "deadline")


@query("SELECT doc_id, source FROM documents WHERE contains(lower(text), 'tion') AND contains(lower(text), 'license')")
def filter_text_search(spark, sf):
    d = table(spark, sf, "documents")
    return d.where(F.contains(F.lower("text"), F.lit("tion")) & F.contains(F.lower("text"), F.lit("license"))).select("doc_id", "source")


@query(f"WITH {b.JOBS_SQL}, {b.SKILLS_SQL} SELECT j.job_id, len(skills) AS n_skills FROM jobs j JOIN skills s ON j.job_id = s.job_id WHERE is_active AND list_contains(skills, 'ECONOMY')")
def filter_array_element(spark, sf):
    jobs = b.jobs(spark, sf).join(b.skills(spark, sf), "job_id")
    return apply_filters(jobs, ListFilter(skill="economy"), NOW).select("job_id", F.size("skills").cast("long").alias("n_skills"))


@query(WITH + "SELECT job_id, company FROM eff WHERE is_active AND eff_status IN ('new', 'saved') AND EXISTS (SELECT 1 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_orderkey = job_id AND s_name = 'Supplier#000000003')")
def semi_join_source(spark, sf):
    f = ListFilter(source="Supplier#000000003")
    return apply_filters(b.jobs(spark, sf), f, NOW, b.user_state(spark, sf), b.listings(spark, sf)).select("job_id", "company")


@query(WITH + "SELECT job_id, priority FROM jobs WHERE job_id NOT IN (SELECT job_id FROM all_states WHERE status IN ('applied', 'dismissed'))")
def anti_join_acted_on(spark, sf):
    acted = b.all_states(spark, sf).where(F.col("status").isin("applied", "dismissed")).select("job_id")
    return b.jobs(spark, sf).join(acted, "job_id", "left_anti").select("job_id", "priority")


@query(WITH + "SELECT job_id, eff_status, eff_score, eff_priority FROM eff")
def effective_score_left_join(spark, sf):
    return eff(spark, sf).select("job_id", "eff_status", "eff_score", "eff_priority")


@query(WITH + "SELECT job_id, deadline, eff_score FROM eff WHERE is_active AND eff_status IN ('new', 'saved') ORDER BY deadline ASC NULLS LAST, eff_score DESC, job_id LIMIT 25 OFFSET 50")
def sort_nulls_last_page(spark, sf):
    f = ListFilter(sort="deadline", page=3)
    return page_of(apply_filters(b.jobs(spark, sf), f, NOW, b.user_state(spark, sf)), f).select("job_id", "deadline", "eff_score")


@query(WITH + "SELECT job_id, applied_at FROM eff WHERE eff_status IN ('applied', 'assessment', 'interview', 'offer', 'rejected') ORDER BY applied_at DESC NULLS LAST, eff_score DESC, job_id LIMIT 100")
def sort_activity(spark, sf):
    f = ListFilter(view="applied", sort="applied", per_page=100)
    return page_of(apply_filters(b.jobs(spark, sf), f, NOW, b.user_state(spark, sf)), f).select("job_id", F.col("user_applied_at").alias("applied_at"))


@query(WITH + f"""SELECT count(*) FILTER (is_active AND eff_status IN ('new', 'saved')) AS to_review, count(*) FILTER (is_active AND eff_status = 'new') AS new,
count(*) FILTER (is_active AND eff_status IN ('new', 'saved') AND eff_priority = 'apply_now') AS apply_now, count(*) FILTER (is_active AND eff_status IN ('new', 'saved') AND eff_priority = 'strong_match') AS strong,
count(*) FILTER (is_active AND eff_status = 'new' AND date_discovered >= {NOW_SQL} - INTERVAL 1 DAY) AS new_since_yesterday, count(*) FILTER (eff_status = 'saved') AS saved,
count(*) FILTER (eff_status IN ('applied', 'assessment', 'interview', 'offer', 'rejected')) AS applied, count(*) FILTER (eff_status = 'dismissed') AS dismissed,
count(*) FILTER (eff_status = 'interview') AS interviews, count(*) FILTER (eff_status = 'offer') AS offers, count(*) FILTER (is_active AND eff_status <> 'dismissed') AS total_active FROM eff""")
def dashboard_counts(spark, sf):
    return analytics.dashboard_counts(eff(spark, sf), NOW)


def _facet_sql(column: str) -> str:
    return f"WITH {b.JOBS_SQL} SELECT {column} AS value, count(*) AS n FROM jobs WHERE is_active AND {column} IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 30"


@query(_facet_sql("company"))
def facet_company(spark, sf):
    return analytics.facet(b.jobs(spark, sf).where("is_active"), "company")


@query(_facet_sql("location"))
def facet_location(spark, sf):
    return analytics.facet(b.jobs(spark, sf).where("is_active"), "location")


@query("SELECT s_name AS value, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1")
def facet_source(spark, sf):
    return analytics.facet(b.listings(spark, sf), "source", None)


@query(f"WITH {b.JOBS_SQL}, {b.SKILLS_SQL} SELECT value, count(*) AS n FROM (SELECT unnest(skills) AS value FROM jobs j JOIN skills s ON j.job_id = s.job_id WHERE is_active) GROUP BY 1 ORDER BY n DESC, value LIMIT 30")
def facet_skill(spark, sf):
    return analytics.skill_facet(b.jobs(spark, sf).where("is_active").join(b.skills(spark, sf), "job_id"))


@query(WITH + "SELECT " + ", ".join(f"count(*) FILTER (eff_score >= {x}) AS at_least_{x}" for x in (60, 70, 80, 90)) + " FROM eff WHERE is_active")
def score_threshold_counts(spark, sf):
    return analytics.score_thresholds(eff(spark, sf).where("is_active"))


@query("SELECT count(*) FILTER (n > 1) AS multi_source, CAST(sum(n - 1) AS BIGINT) AS duplicates_removed FROM (SELECT count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_orderkey)")
def multi_source_jobs(spark, sf):
    return analytics.multi_source(b.listings(spark, sf))


@query(WITH + "SELECT count(*) AS total, count(*) FILTER (is_active) AS active, round(avg(score), 4) AS avg_score, count(applied_at) AS applied, count(interview_at) AS interviews, count(offer_at) AS offers FROM eff")
def analytics_summary(spark, sf):
    return analytics.summary(eff(spark, sf))


@query(f"""WITH {b.JOBS_SQL}, y AS (SELECT s_name AS source, count(DISTINCT j.job_id) AS jobs, CAST(sum(CASE WHEN priority IN ('apply_now', 'strong_match') THEN 1 ELSE 0 END) AS BIGINT) AS strong
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN jobs j ON l_orderkey = j.job_id WHERE l_shipdate >= TIMESTAMP '1998-01-01' GROUP BY 1)
SELECT source, jobs, strong, round(100.0 * strong / greatest(sum(strong) OVER (), 1), 1) AS share_of_strong FROM y""")
def source_yield_stats(spark, sf):
    return analytics.source_yield(b.listings(spark, sf), b.jobs(spark, sf), datetime(1998, 1, 1))


@query(f"""WITH {b.JOBS_SQL}, p AS (SELECT DISTINCT c_name AS name, lower(replace(c_name, '#', '#')) AS slug FROM customer),
c AS (SELECT lower(company) AS slug, count(*) AS jobs, count(*) FILTER (employment_type IN ('internship', 'co_op')) AS internships FROM jobs WHERE is_active GROUP BY 1)
SELECT name, p.slug, coalesce(jobs, 0) AS jobs, coalesce(internships, 0) AS internships, CASE WHEN internships > 0 THEN 'ok' WHEN jobs > 0 THEN 'no_internships' ELSE 'missing' END AS state FROM p LEFT JOIN c ON p.slug = c.slug""")
def preferred_coverage(spark, sf):
    return analytics.preferred_coverage(b.jobs(spark, sf), table(spark, sf, "customer").select(F.col("c_name").alias("name")).distinct())


@query(WITH + "SELECT user_id, status, count(*) AS n FROM all_states GROUP BY 1, 2")
def status_counts(spark, sf):
    return b.all_states(spark, sf).groupBy("user_id", "status").agg(F.count("*").alias("n"))


@query(f"WITH {b.JOBS_SQL} SELECT priority, count(*) AS n, count(*) FILTER (is_active) AS active FROM jobs GROUP BY 1")
def priority_counts(spark, sf):
    return b.jobs(spark, sf).groupBy("priority").agg(F.count("*").alias("n"), F.count_if("is_active").alias("active"))


@query(WITH + "SELECT eff_status, job_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY eff_status ORDER BY score DESC, job_id) AS rank FROM eff WHERE eff_status IN ('saved', 'applied', 'interview')) WHERE rank <= 80")
def kanban_top_n(spark, sf):
    return analytics.top_by_status(eff(spark, sf), ["saved", "applied", "interview"]).select("eff_status", "job_id", "score", F.col("rank").cast("long").alias("rank"))


@query(WITH + """, a AS (SELECT s.*, j.title AS category FROM all_states s JOIN jobs j ON j.job_id = s.job_id WHERE applied_at IS NOT NULL),
g AS (SELECT category, count(*) AS applications, count(interview_at) AS interviews, count(saved_at) AS offers, count(dismissed_at) AS rejections, round(100.0 * count(interview_at) / count(*), 4) AS interview_rate FROM a GROUP BY 1),
w AS (SELECT *, sum(applications) OVER () AS total, max(interview_rate) FILTER (applications >= 5) OVER () AS best, min(interview_rate) FILTER (applications >= 5) OVER () AS worst FROM g)
SELECT category, applications, interviews, offers, rejections, interview_rate, total >= 15 AS enough_data, coalesce(total >= 15 AND applications >= 5 AND interview_rate = best AND best > worst * 1.5 AND interviews > 0, false) AS stands_out FROM w""")
def outcome_insights(spark, sf):
    a = b.all_states(spark, sf).join(b.jobs(spark, sf).select("job_id", F.col("title").alias("category")), "job_id")
    return analytics.outcome_insights(a.select("category", "applied_at", "interview_at", F.col("saved_at").alias("offer_at"), F.col("dismissed_at").alias("rejected_at")))


@query("SELECT source, count(*) AS n, min(doc_id) AS first_doc, arg_min(lang, doc_id) AS lang FROM documents GROUP BY 1")
def harvest_first_seen(spark, sf):
    rows = table(spark, sf, "documents").select("source", "doc_id", "lang", F.col("doc_id").alias("first_doc"))
    return analytics.first_seen(rows, "source", "doc_id", ["first_doc", "lang"])


def _reasons_sql(now: str, least: int) -> str:
    """Rows to tell about with their reason, as the digest's rules say."""
    return f"""e AS (SELECT *, CASE WHEN deadline_is_explicit AND floor(epoch(deadline - {now}) / 86400) BETWEEN 0 AND 3 THEN 'deadline' WHEN notified_at IS NOT NULL THEN 'update' ELSE 'new' END AS reason FROM eff
WHERE is_active AND eff_score >= {least} AND eff_status = 'new' AND (notified_at IS NULL OR (freshness = 'updated' AND notified_at <= {now} - INTERVAL 72 HOUR)))"""


#: When actions of the user are three days old or older, so that told jobs come up as updates.
LATER, LATER_SQL = datetime(2024, 1, 20), "TIMESTAMP '2024-01-20 00:00:00'"


@query(WITH + ", " + _reasons_sql(LATER_SQL, 80) + """ SELECT job_id, reason, eff_score, row_number() OVER (ORDER BY CASE reason WHEN 'deadline' THEN 0 ELSE 1 END,
list_position(['apply_now', 'strong_match', 'worth_considering', 'maybe', 'skip'], eff_priority), eff_score DESC, job_id) AS rank FROM e ORDER BY rank LIMIT 7""")
def digest_selection(spark, sf):
    return digest.select_digest(b.jobs(spark, sf), b.user_state(spark, sf), LATER).withColumn("rank", F.col("rank").cast("long"))


@query(WITH + ", " + _reasons_sql(NOW_SQL, 60) + """ SELECT count(*) FILTER (reason = 'new') AS n_new, count(*) FILTER (reason = 'update') AS n_update, count(*) FILTER (reason = 'deadline') AS n_deadline,
count(*) FILTER (eff_priority = 'apply_now') AS n_apply_now, count(*) FILTER (eff_priority = 'strong_match') AS n_strong_match, count(*) AS total FROM e""")
def digest_totals(spark, sf):
    return digest.digest_totals(b.jobs(spark, sf), b.user_state(spark, sf), NOW, 60.0)


#: What a run fills but never empties.
_FILL = ["price", "deadline", "requirements"]
#: A closing time, moved by minutes or hours; required words, in other case or spacing; and how fresh a job was.
def _facts() -> tuple[list, list]:
    k, at = F.col("o_custkey"), F.col("o_orderkey")
    fresh = F.element_at(F.array(*map(F.lit, ("new", "updated", "old", "reposted"))), (k % 4 + 1).cast("int"))
    old = [F.when(k % 3 > 0, F.col("o_orderdate")).alias("deadline"), F.when(k % 4 > 0, F.concat_ws(" ", "o_orderpriority", F.lit("Required"))).alias("requirements"), fresh.alias("freshness")]
    words = F.concat(F.col("o_orderpriority"), F.when(at % 2 == 0, " ").otherwise("  "), F.when(at % 3 == 0, "required").otherwise("Required"))
    return old, [F.timestamp_add("MINUTE", at % 90, "o_orderdate").alias("deadline"), words.alias("requirements")]


def _days(spark, sf):
    """Yesterday's snapshot and today's rows: orders up to 1999, and those from 1998 with some prices changed."""
    o = table(spark, sf, "orders")
    old = o.where("o_orderdate < timestamp_ntz '1999-01-01 00:00:00'").select("o_orderkey", F.col("o_totalprice").alias("price"), F.when(F.col("o_custkey") % 5 > 0, F.col("o_orderpriority")).alias("level"), (F.col("o_orderstatus") != "F").alias("is_active"), F.col("o_orderdate").alias("first_seen"), F.col("o_orderdate").alias("last_seen"), *_facts()[0])
    new = o.where("o_orderdate >= timestamp_ntz '1998-01-01 00:00:00'").select("o_orderkey", F.when(F.col("o_custkey") % 7 > 0, F.col("o_totalprice") + F.when(F.col("o_custkey") % 2 == 0, 10).otherwise(0)).alias("price"), F.col("o_orderpriority").alias("level"), *_facts()[1])
    return old, new


_DAYS_SQL = rf"""WITH old AS (SELECT o_orderkey, o_totalprice AS price, CASE WHEN o_custkey % 5 > 0 THEN o_orderpriority END AS level, o_orderstatus <> 'F' AS is_active, o_orderdate AS first_seen, o_orderdate AS last_seen, CASE WHEN o_custkey % 3 > 0 THEN o_orderdate END AS deadline, CASE WHEN o_custkey % 4 > 0 THEN o_orderpriority || ' Required' END AS requirements, (['new', 'updated', 'old', 'reposted'])[o_custkey % 4 + 1] AS freshness FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01'),
new AS (SELECT o_orderkey, CASE WHEN o_custkey % 7 > 0 THEN o_totalprice + CASE WHEN o_custkey % 2 = 0 THEN 10 ELSE 0 END END AS price, o_orderpriority AS level, o_orderdate + (o_orderkey % 90) * INTERVAL 1 MINUTE AS deadline, o_orderpriority || CASE WHEN o_orderkey % 2 = 0 THEN ' ' ELSE '  ' END || CASE WHEN o_orderkey % 3 = 0 THEN 'required' ELSE 'Required' END AS requirements FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'),
m AS (SELECT coalesce(n.o_orderkey, o.o_orderkey) AS o_orderkey, coalesce(n.price, o.price) AS price, CASE WHEN n.o_orderkey IS NOT NULL THEN n.level ELSE o.level END AS level, coalesce(o.is_active, true) AS was_active,
  n.o_orderkey IS NOT NULL OR coalesce(o.is_active, false) AS is_active, coalesce(o.first_seen, {NOW_SQL}) AS first_seen, CASE WHEN n.o_orderkey IS NOT NULL THEN {NOW_SQL} ELSE o.last_seen END AS last_seen,
  o.o_orderkey IS NOT NULL AS known, n.o_orderkey IS NOT NULL AS seen, o.o_orderkey IS NOT NULL AND n.price IS NOT NULL AND o.price IS DISTINCT FROM n.price AND o.price IS NOT NULL AS price_changed,
  coalesce(abs(epoch(n.deadline - o.deadline)) > 3600, false) AS deadline_changed, coalesce(string_split_regex(o.requirements, '\s+') <> string_split_regex(n.requirements, '\s+'), false) AS requirements_changed,
  coalesce(n.deadline, o.deadline) AS deadline, coalesce(n.requirements, o.requirements) AS requirements, o.freshness AS freshness
  FROM old o FULL JOIN new n ON o.o_orderkey = n.o_orderkey)
"""


@query(_DAYS_SQL + "SELECT o_orderkey, price, level, is_active, first_seen, last_seen, CASE WHEN NOT known THEN 'discovered' WHEN NOT seen THEN 'unseen' WHEN NOT was_active THEN 'reposted' WHEN price_changed OR deadline_changed OR requirements_changed THEN 'updated' ELSE 'seen' END AS event FROM m")
def upsert_snapshot(spark, sf):
    old, new = _days(spark, sf)
    return state.upsert(old, new, "o_orderkey", _FILL, ["level"], NOW).select("o_orderkey", "price", "level", "is_active", "first_seen", "last_seen", "event")


@query(_DAYS_SQL + "SELECT o_orderkey, concat_ws(',', CASE WHEN deadline_changed THEN 'deadline' END, CASE WHEN price_changed THEN 'price' END, CASE WHEN requirements_changed THEN 'requirements' END) AS changes FROM m WHERE seen AND (price_changed OR deadline_changed OR requirements_changed)")
def material_changes(spark, sf):
    old, new = _days(spark, sf)
    rows = state.upsert(old, new, "o_orderkey", _FILL, ["level"], NOW)
    return rows.where(F.size("change") > 0).select("o_orderkey", F.array_join("change", ",").alias("changes"))


@query(_DAYS_SQL + f"""SELECT o_orderkey, CASE WHEN NOT known THEN 'new' WHEN NOT seen THEN freshness WHEN NOT was_active THEN 'reposted' WHEN price_changed OR deadline_changed OR requirements_changed THEN 'updated'
WHEN freshness IN ('new', 'updated') AND first_seen + INTERVAL 1 DAY <= {NOW_SQL} THEN 'old' ELSE freshness END AS freshness FROM m""")
def lifecycle_freshness(spark, sf):
    old, new = _days(spark, sf)
    rows = state.upsert(old, new, "o_orderkey", _FILL, ["level"], NOW).join(old.select(F.col("o_orderkey").alias("known"), "freshness"), F.col("o_orderkey") == F.col("known"), "left")
    return rows.select("o_orderkey", state.freshness_of(F.col("event"), F.col("freshness"), F.col("first_seen"), NOW).alias("freshness"))


@query(WITH + "SELECT job_id, is_active AND NOT (is_active AND date_posted < TIMESTAMP '2001-05-22 12:00:00' AND eff_status NOT IN ('saved', 'applied', 'assessment', 'interview', 'offer')) AS is_active, is_active AND date_posted < TIMESTAMP '2001-05-22 12:00:00' AND eff_status NOT IN ('saved', 'applied', 'assessment', 'interview', 'offer') AS expired FROM eff")
def expire_stale(spark, sf):
    rows = eff(spark, sf).select("job_id", "is_active", F.col("date_posted").alias("last_seen"), F.col("eff_status").alias("status"))
    return state.expire_stale(rows, NOW).select("job_id", "is_active", "expired")


@query(WITH + ", p AS (SELECT job_id FROM jobs WHERE job_id % 3 = 0 AND score >= 50) SELECT coalesce(s.job_id, p.job_id) AS job_id, CASE WHEN p.job_id IS NOT NULL THEN 'saved' ELSE s.status END AS status, p.job_id IS NOT NULL AND coalesce(s.status <> 'saved', true) AS changed FROM state s FULL JOIN p ON s.job_id = p.job_id")
def bulk_status(spark, sf):
    jobs = b.jobs(spark, sf)
    ids = jobs.where("job_id % 3 = 0 and score >= 50").select("job_id").unionByName(spark.range(1).select(F.lit(-1).cast("bigint").alias("job_id")))
    return state.bulk_set_status(b.user_state(spark, sf), jobs, ids, "saved")


@query(WITH + f"SELECT user_id, job_id, 'saved' AS status, coalesce(saved_at, {NOW_SQL}) AS saved_at, applied_at, dismissed_at FROM all_states")
def stamp_first(spark, sf):
    return state.stamp_first(b.all_states(spark, sf), "saved", NOW).select("user_id", "job_id", "status", "saved_at", "applied_at", "dismissed_at")


@query("""WITH new AS (SELECT doc_id, 'd' || (doc_id % 700) AS source_key, md5(text) AS content FROM documents WHERE doc_id % 2 = 0), old AS (SELECT doc_id AS job_id, 'd' || doc_id AS source_key, md5(text) AS content FROM documents WHERE doc_id % 2 = 1),
k AS (SELECT content, min(job_id) AS job_id FROM old GROUP BY 1)
SELECT n.doc_id, coalesce(a.job_id, k.job_id) AS job_id, CASE WHEN a.job_id IS NOT NULL THEN 'source_key' WHEN k.job_id IS NOT NULL THEN 'content' END AS matched_by FROM new n LEFT JOIN old a ON a.source_key = n.source_key LEFT JOIN k ON k.content = n.content""")
def find_existing(spark, sf):
    d = table(spark, sf, "documents").withColumn("content", F.md5("text"))
    new = d.where("doc_id % 2 = 0").select("doc_id", F.concat(F.lit("d"), F.col("doc_id") % 700).alias("source_key"), "content")
    old = d.where("doc_id % 2 = 1").select(F.col("doc_id").alias("job_id"), F.concat(F.lit("d"), "doc_id").alias("source_key"), "content")
    by_content = old.groupBy("content").agg(F.min("job_id").alias("job_id"))
    return state.find_existing(new, [("source_key", old.select("source_key", "job_id")), ("content", by_content)], "doc_id")


_BOARDS_SQL = """boards AS (SELECT s_name AS board, CAST(s_suppkey % 14 AS INT) AS failures, s_acctbal > 0 AS enabled, CASE WHEN s_suppkey % 6 > 0 THEN last_seen END AS last_crawled
FROM supplier LEFT JOIN (SELECT l_suppkey, max(l_shipdate) AS last_seen FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey)"""


def _boards(spark, sf):
    seen = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.max("l_shipdate").alias("last_seen"))
    s = table(spark, sf, "supplier")
    rows = s.join(seen, s["s_suppkey"] == seen["l_suppkey"], "left")
    return rows.select(F.col("s_name").alias("board"), (F.col("s_suppkey") % 14).cast("int").alias("failures"), (F.col("s_acctbal") > 0).alias("enabled"), F.when(F.col("s_suppkey") % 6 > 0, F.col("last_seen")).alias("last_crawled"))


@query(f"""WITH {_BOARDS_SQL}, p AS (SELECT *, row_number() OVER (ORDER BY failures, last_crawled IS NOT NULL, last_crawled, board) AS position, coalesce(last_crawled >= {NOW_SQL} - INTERVAL 3 DAY, false) AS recent FROM boards WHERE enabled AND failures < 8)
SELECT board, failures, last_crawled, recent FROM p WHERE position <= 40 AND (position <= 20 OR NOT recent)""")
def board_rotation(spark, sf):
    return state.board_rotation(_boards(spark, sf), 40, NOW)


@query(f"""WITH {_BOARDS_SQL}, r AS (SELECT board, failures % 2 = 0 AS ok FROM boards WHERE failures % 3 > 0), n AS (SELECT b.*, CASE WHEN ok IS NULL THEN failures WHEN ok THEN 0 ELSE failures + 1 END AS now FROM boards b LEFT JOIN r ON r.board = b.board)
SELECT board, now AS failures, enabled AND now < 12 AS enabled FROM n""")
def prune_boards(spark, sf):
    boards = _boards(spark, sf)
    results = boards.where("failures % 3 > 0").select("board", (F.col("failures") % 2 == 0).alias("ok"), F.lit(1).alias("found"))
    return state.board_health(boards.withColumn("last_ok", F.lit(None).cast("timestamp_ntz")), results, NOW).select("board", "failures", "enabled")
