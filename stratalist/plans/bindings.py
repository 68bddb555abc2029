"""The given tables in the roles of listings, jobs, sources and users, in Spark and as SQL views.

orders are jobs, customers companies, nations locations, lineitems the listings of a job by supplier, events the actions
of users on jobs, documents the bodies of listings.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.score import priority_band
from ..storage import table

NOW = datetime(2001, 6, 1, 12, 0, 0)
NOW_SQL = "TIMESTAMP '2001-06-01 12:00:00'"
USER = 7
STATUS_OF = {"view": "new", "click": "saved", "purchase": "applied", "error": "dismissed", "signup": "interview"}


def jobs(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """more: columns of orders that come along as they are."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    # Companies and places are dimension tables; Spark broadcasts them when their size is small.
    rows = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    score = F.floor(F.col("o_totalprice") / 500) / 10
    return rows.select(
        F.col("o_orderkey").alias("job_id"), F.col("c_name").alias("company"), F.col("n_name").alias("location"),
        F.concat(F.lower("c_mktsegment"), F.when(F.col("o_orderpriority") == "5-LOW", " intern").otherwise(" engineer")).alias("title"),
        F.concat_ws(" ", "o_orderpriority", "c_mktsegment").alias("description"), score.alias("score"), priority_band(score).alias("priority"),
        F.lit("new").alias("status"), (F.col("o_orderstatus") != "F").alias("is_active"), F.col("o_orderdate").alias("date_posted"), F.col("o_orderdate").alias("date_discovered"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.timestamp_add("HOUR", F.lit(24 * 30) + F.col("o_orderkey") % 24, "o_orderdate")).alias("deadline"),
        (F.col("o_custkey") % 5 > 0).alias("deadline_is_explicit"),
        F.when(F.col("o_orderpriority") == "5-LOW", "internship").when(F.col("o_orderpriority") == "2-HIGH", "full_time").otherwise("unknown").alias("employment_type"),
        F.when(F.col("o_orderstatus") == "P", "remote").otherwise("onsite").alias("remote_status"), F.when(F.col("o_custkey") % 3 == 0, F.col("o_totalprice")).alias("salary_min"),
        F.when(F.col("o_custkey") % 4 == 0, "updated").otherwise("new").alias("freshness"), *more,
    )


JOBS_SQL = """jobs AS (SELECT *, CASE WHEN score >= 90 THEN 'apply_now' WHEN score >= 80 THEN 'strong_match' WHEN score >= 70 THEN 'worth_considering' WHEN score >= 60 THEN 'maybe' ELSE 'skip' END AS priority
  FROM (SELECT o_orderkey AS job_id, c_name AS company, n_name AS location, lower(c_mktsegment) || CASE WHEN o_orderpriority = '5-LOW' THEN ' intern' ELSE ' engineer' END AS title,
  o_orderpriority || ' ' || c_mktsegment AS description, floor(o_totalprice / 500) / 10 AS score, 'new' AS status, o_orderstatus <> 'F' AS is_active, o_orderdate AS date_posted, o_orderdate AS date_discovered,
  CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderdate + INTERVAL 30 DAY + (o_orderkey % 24) * INTERVAL 1 HOUR END AS deadline, o_custkey % 5 > 0 AS deadline_is_explicit,
  CASE o_orderpriority WHEN '5-LOW' THEN 'internship' WHEN '2-HIGH' THEN 'full_time' ELSE 'unknown' END AS employment_type, CASE WHEN o_orderstatus = 'P' THEN 'remote' ELSE 'onsite' END AS remote_status,
  CASE WHEN o_custkey % 3 = 0 THEN o_totalprice END AS salary_min, CASE WHEN o_custkey % 4 = 0 THEN 'updated' ELSE 'new' END AS freshness
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey))"""


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's actions: user_id, job_id, status, ts, value."""
    e = table(spark, sf_dir, "events")
    job = F.get_json_object("props", "$.k").cast("bigint")
    pairs = F.create_map(*[F.lit(x) for kv in STATUS_OF.items() for x in kv])
    return e.select("user_id", job.alias("job_id"), pairs[F.col("event_type")].alias("status"), "ts", "value", "event_id")


def all_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each user and job: the last status, and when each was first reached."""
    a = actions(spark, sf_dir)
    at = lambda s: F.min(F.when(F.col("status") == s, F.col("ts")))
    last = F.struct("ts", "event_id")
    rows = a.groupBy("user_id", "job_id").agg(F.max_by("status", last).alias("status"), F.max_by("value", last).alias("value"), at("saved").alias("saved_at"), at("applied").alias("applied_at"), at("dismissed").alias("dismissed_at"), at("new").alias("notified_at"), at("interview").alias("interview_at"), F.min(F.when((F.col("status") == "interview") & (F.col("value") > 50), F.col("ts"))).alias("offer_at"))
    return rows.withColumns({"score": F.when(F.col("status") == "new", F.least(F.floor("value") + 60.0, F.lit(100.0))), "priority": F.lit(None).cast("string")}).drop("value")


def user_state(spark: SparkSession, sf_dir: str, user: int = USER) -> DataFrame:
    return all_states(spark, sf_dir).where(F.col("user_id") == user).drop("user_id")


STATE_SQL = f"""actions AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS job_id, CASE event_type WHEN 'view' THEN 'new' WHEN 'click' THEN 'saved' WHEN 'purchase' THEN 'applied' WHEN 'error' THEN 'dismissed' ELSE 'interview' END AS status, ts, value, event_id FROM events),
latest AS (SELECT *, row_number() OVER (PARTITION BY user_id, job_id ORDER BY ts DESC, event_id DESC) AS rn FROM actions),
firsts AS (SELECT user_id, job_id, min(ts) FILTER (status = 'saved') AS saved_at, min(ts) FILTER (status = 'applied') AS applied_at, min(ts) FILTER (status = 'dismissed') AS dismissed_at, min(ts) FILTER (status = 'new') AS notified_at, min(ts) FILTER (status = 'interview') AS interview_at, min(ts) FILTER (status = 'interview' AND value > 50) AS offer_at FROM actions GROUP BY 1, 2),
all_states AS (SELECT l.user_id, l.job_id, l.status, f.saved_at, f.applied_at, f.dismissed_at, f.notified_at, f.interview_at, f.offer_at, CASE WHEN l.status = 'new' THEN least(floor(l.value) + 60.0, 100.0) END AS score
  FROM latest l JOIN firsts f ON l.user_id = f.user_id AND l.job_id = f.job_id WHERE l.rn = 1),
state AS (SELECT * FROM all_states WHERE user_id = {USER}),
eff AS (SELECT j.*, coalesce(s.status, 'new') AS eff_status, coalesce(s.score, j.score) AS eff_score, j.priority AS eff_priority, s.saved_at, s.applied_at, s.dismissed_at, s.notified_at, s.interview_at, s.offer_at, s.status AS user_status FROM jobs j LEFT JOIN state s ON j.job_id = s.job_id)"""
WITH = f"WITH {JOBS_SQL},\n{STATE_SQL}\n"


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    item, s = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    rows = item.join(s, item["l_suppkey"] == s["s_suppkey"])
    return rows.select(F.col("l_orderkey").alias("job_id"), "l_linenumber", F.col("s_name").alias("source"), F.col("l_shipdate").alias("first_seen"), "l_partkey")


def skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job_id and the sorted distinct part types of its listings."""
    item, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    rows = item.join(p, item["l_partkey"] == p["p_partkey"])
    return rows.groupBy(F.col("l_orderkey").alias("job_id")).agg(F.sort_array(F.collect_set("p_type")).alias("skills"))


SKILLS_SQL = "skills AS (SELECT l_orderkey AS job_id, list_sort(list(DISTINCT p_type)) AS skills FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)"
