"""Queries of what runs and users leave behind."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import queries as phrases
from ..operators import records, state
from ..storage import table
from . import bindings as b
from .bindings import NOW, NOW_SQL, WITH
from .listing_queries import _DAYS_SQL, _days

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"""WITH o AS (SELECT l_orderkey, l_linenumber, l_orderkey AS job_id, l_shipdate AS at FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01'),
n AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 10 = 0 THEN l_orderkey + 1 ELSE l_orderkey END AS job_id FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01')
SELECT l_orderkey, l_linenumber, coalesce(n.job_id, o.job_id) AS job_id, coalesce(o.at, {NOW_SQL}) AS first_seen, CASE WHEN n.job_id IS NOT NULL THEN {NOW_SQL} ELSE o.at END AS last_seen,
n.job_id IS NOT NULL AS seen_now, coalesce(n.job_id <> o.job_id, false) AS moved FROM o FULL JOIN n USING (l_orderkey, l_linenumber)""")
def listing_repoint(spark, sf):
    item, keys = table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"]
    old = item.where("l_shipdate < timestamp_ntz '1998-01-01 00:00:00'").select(*keys, F.col("l_orderkey").alias("job_id"), F.col("l_shipdate").alias("first_seen"), F.col("l_shipdate").alias("last_seen"))
    seen = item.where("l_shipdate >= timestamp_ntz '1997-01-01 00:00:00'").select(*keys, (F.col("l_orderkey") + (F.col("l_partkey") % 10 == 0).cast("int")).alias("job_id"))
    return records.repoint_listings(old, seen, keys, NOW)


@query(_DAYS_SQL + f""", e AS (SELECT o_orderkey, CASE WHEN NOT known THEN 'discovered' WHEN NOT seen THEN 'unseen' WHEN NOT was_active THEN 'reposted' WHEN price_changed THEN 'updated' ELSE 'seen' END AS event FROM m)
SELECT o_orderkey, event AS event_type, CASE WHEN event = 'updated' THEN 'price' END AS detail, {NOW_SQL} AS created_at FROM e WHERE event IN ('discovered', 'updated', 'reposted')
UNION ALL SELECT o_orderkey, 'expired', NULL, {NOW_SQL} FROM m WHERE is_active AND last_seen < {NOW_SQL} - INTERVAL 10 DAY""")
def event_append(spark, sf):
    old, new = _days(spark, sf)
    rows = state.upsert(old, new, "o_orderkey", ["price"], ["level"], NOW).withColumn("status", F.lit("new"))
    return records.job_events(state.expire_stale(rows, NOW), "o_orderkey", NOW)


@query("""WITH d AS (SELECT doc_id, md5(lower(text)) AS fingerprint, CASE WHEN doc_id % 4 = 0 THEN '' ELSE source END AS req FROM documents), k AS (SELECT fingerprint, req, min(doc_id) AS job_id FROM d WHERE doc_id % 2 = 1 GROUP BY 1, 2)
SELECT n.doc_id, min(k.job_id) AS job_id FROM d n JOIN k ON n.fingerprint = k.fingerprint AND (n.req = k.req OR n.req = '' OR k.req = '') WHERE n.doc_id % 2 = 0 GROUP BY 1""")
def find_existing_guarded(spark, sf):
    """Stored rows of the same content that the guard lets match: the source stands for the requisition, which some rows don't state."""
    d = table(spark, sf, "documents").select("doc_id", F.md5(F.lower("text")).alias("fingerprint"), F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.col("source")).alias("requisition_id"), F.lit("").alias("ats_identity"), F.array().cast("array<string>").alias("discriminators"))
    known = d.where("doc_id % 2 = 1").withColumnRenamed("doc_id", "job_id")
    return records.guarded_match(d.where("doc_id % 2 = 0"), known, "doc_id", "fingerprint", ["requisition_id", "ats_identity", "discriminators"])


@query("""WITH d AS (SELECT doc_id, source, md5(lower(text)) AS fp, CASE WHEN doc_id % 3 = 0 THEN 'x:' || CAST(doc_id % 997 AS VARCHAR) ELSE '' END AS ats, CASE WHEN doc_id % 5 = 0 THEN 'https://e.example/' || CAST(doc_id % 991 AS VARCHAR) ELSE '' END AS url FROM documents)
SELECT doc_id, substring(sha256(coalesce(nullif(ats, ''), nullif(url, ''), source || '|' || fp)), 1, 24) AS canonical_id FROM d""")
def canonical_ids(spark, sf):
    d = table(spark, sf, "documents")
    ats = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("x:"), (F.col("doc_id") % 997).cast("string"))).otherwise("")
    url = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("https://e.example/"), (F.col("doc_id") % 991).cast("string"))).otherwise("")
    return d.select("doc_id", records.canonical_id(ats, url, F.col("source"), F.md5(F.lower("text"))).alias("canonical_id"))


_COMPANIES_SQL = "c AS (SELECT c_custkey, c_acctbal > 0 AS monitored, max(o_orderdate) AS last_checked FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2)"


@query(f"WITH {_COMPANIES_SQL} SELECT c_custkey, last_checked FROM c WHERE monitored AND (last_checked IS NULL OR last_checked < TIMESTAMP '2000-06-01 12:00:00' - INTERVAL 12 HOUR)")
def stale_monitored(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    last = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last_checked"))
    rows = c.select("c_custkey", (F.col("c_acctbal") > 0).alias("monitored")).join(last, "c_custkey", "left")
    return records.stale_monitored(rows, datetime(2000, 6, 1, 12)).select("c_custkey", "last_checked")


_OUTCOMES_SQL = """o AS (SELECT date_trunc('month', l_shipdate) AS run, l_suppkey, CASE WHEN count(*) FILTER (l_returnflag = 'R') * 2 > count(*) THEN 'failed' WHEN count(*) FILTER (l_returnflag = 'R') > 0 THEN 'degraded' ELSE 'ok' END AS status,
count(*) AS found, count(*) FILTER (l_linestatus = 'O') AS new FROM lineitem GROUP BY 1, 2),
r AS (SELECT run, count(*) FILTER (status IN ('ok', 'degraded')) AS succeeded, count(*) FILTER (status = 'failed') AS failed, CAST(sum(found) AS BIGINT) AS found, CAST(sum(new) AS BIGINT) AS new FROM o GROUP BY 1),
runs AS (SELECT *, CASE WHEN failed = 0 THEN 'success' WHEN succeeded > 0 THEN 'partial' ELSE 'failed' END AS status FROM r)"""


def _runs(spark, sf):
    """Each month is a run, and each supplier a source of it: it failed if most of its lines were returned."""
    item = table(spark, sf, "lineitem")
    returned = F.count_if(F.col("l_returnflag") == "R")
    status = F.when(returned * 2 > F.count("*"), "failed").when(returned > 0, "degraded").otherwise("ok")
    by = item.groupBy(F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("run"), "l_suppkey").agg(status.alias("status"), F.count("*").alias("found"), F.count_if(F.col("l_linestatus") == "O").alias("new"))
    return records.run_report(by, ["run"])


@query(f"WITH {_OUTCOMES_SQL} SELECT run, succeeded, failed, found, new, status FROM runs")
def run_rollup(spark, sf):
    return _runs(spark, sf)


@query(f"WITH {_OUTCOMES_SQL} SELECT run, status FROM runs ORDER BY run DESC LIMIT 20")
def recent_runs(spark, sf):
    return records.recent(_runs(spark, sf), "run", "status", 20).select("run", "status")


def _clicks(spark, sf):
    return b.actions(spark, sf).select("user_id", "job_id", "status", "ts", "event_id")


@query(WITH + f", t AS (SELECT DISTINCT user_id, job_id FROM actions WHERE event_id % 3 = 0), s AS (SELECT * FROM all_states WHERE status <> 'applied') SELECT coalesce(s.user_id, t.user_id) AS user_id, coalesce(s.job_id, t.job_id) AS job_id, coalesce(s.status, 'new') AS status, CASE WHEN t.job_id IS NOT NULL THEN coalesce(s.notified_at, {NOW_SQL}) ELSE s.notified_at END AS opened_at FROM s FULL JOIN t ON s.user_id = t.user_id AND s.job_id = t.job_id")
def mark_opened(spark, sf):
    """The time of the first look stays; a row is added where a user had none."""
    before = b.all_states(spark, sf).where("status <> 'applied'").select("user_id", "job_id", "status", F.col("notified_at").alias("opened_at"))
    return records.mark(before, _clicks(spark, sf).where("event_id % 3 = 0"), "opened_at", NOW, keys=["user_id", "job_id"], once=True).select("user_id", "job_id", "status", "opened_at")


_DECIDED = "(SELECT user_id, job_id, status, ts AS t FROM actions WHERE status IN ('applied', 'interview', 'dismissed') AND event_id % 2 = 0)"


@query(WITH + f", d AS {_DECIDED}, l AS (SELECT user_id, job_id, arg_max(status, (t, status)) AS decided FROM d GROUP BY 1, 2) SELECT coalesce(s.user_id, l.user_id) AS user_id, coalesce(s.job_id, l.job_id) AS job_id, coalesce(decided, s.status) AS status, coalesce(decided <> coalesce(s.status, 'new'), false) AS changed FROM (SELECT * FROM all_states WHERE saved_at IS NOT NULL) s FULL JOIN l ON s.user_id = l.user_id AND s.job_id = l.job_id")
def set_status(spark, sf):
    return _decisions(spark, sf)[0]


@query(WITH + f", d AS {_DECIDED} SELECT user_id, d.job_id, min(t) AS opened_at, arg_max(d.status, (t, d.status)) AS stage, count(*) AS moves, any_value(score) AS score_at_apply FROM d JOIN jobs j ON d.job_id = j.job_id WHERE d.status IN ('applied', 'interview') GROUP BY 1, 2")
def application_cards(spark, sf):
    return _decisions(spark, sf)[1].select("user_id", "job_id", "opened_at", "stage", "moves", "score_at_apply")


def _decisions(spark, sf):
    decided = _clicks(spark, sf).where("status in ('applied', 'interview', 'dismissed') and event_id % 2 = 0").select("user_id", "job_id", "status", F.col("ts").alias("at"))
    before = b.all_states(spark, sf).where("saved_at is not null").select("user_id", "job_id", "status")
    return records.set_status(before, b.jobs(spark, sf), decided, ["user_id", "job_id"])


@query(WITH + ", n AS (SELECT user_id, job_id, ts AS t, CASE WHEN event_id % 4 = 0 THEN ' ' ELSE status || ' ' || CAST(event_id AS VARCHAR) END AS note FROM actions) SELECT user_id, job_id, count(*) AS notes, arg_max(note, (t, note)) AS latest FROM n WHERE trim(note) <> '' GROUP BY 1, 2")
def note_cards(spark, sf):
    note = F.when(F.col("event_id") % 4 == 0, " ").otherwise(F.concat("status", F.lit(" "), F.col("event_id").cast("string")))
    rows = _clicks(spark, sf).withColumns({"note": note, "at": F.col("ts")})
    return records.add_notes(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"), ["user_id", "job_id"])


@query(WITH + f", n AS (SELECT 7 AS user_id, job_id, score + 1 AS score, priority FROM jobs WHERE is_active), s AS (SELECT user_id, job_id, status, score, CAST(NULL AS VARCHAR) AS priority FROM all_states) SELECT coalesce(s.user_id, n.user_id) AS user_id, coalesce(s.job_id, n.job_id) AS job_id, coalesce(s.status, 'new') AS status, coalesce(n.score, s.score) AS score, coalesce(n.priority, s.priority) AS priority, CASE WHEN n.job_id IS NOT NULL THEN {NOW_SQL} END AS scored_at FROM s FULL JOIN n ON s.user_id = n.user_id AND s.job_id = n.job_id")
def user_scores(spark, sf):
    scores = b.jobs(spark, sf).where("is_active").select(F.lit(b.USER).cast("long").alias("user_id"), "job_id", (F.col("score") + 1).alias("score"), "priority")
    before = b.all_states(spark, sf).select("user_id", "job_id", "status", "score", "priority")
    return records.write_scores(before, scores, ["user_id", "job_id"], NOW)


@query(WITH + "SELECT j.job_id, coalesce(s.status, 'new') AS status, coalesce(s.score, j.score) AS score, coalesce(s.priority, j.priority) AS priority, coalesce(s.status IN ('applied', 'assessment'), false) AS awaiting_answer FROM jobs j LEFT JOIN (SELECT job_id, status, score, CAST(NULL AS VARCHAR) AS priority FROM state) s ON s.job_id = j.job_id")
def user_view(spark, sf):
    return records.fallback_view(b.jobs(spark, sf), b.user_state(spark, sf), ["score", "priority"])


_READ_SQL = f"""r AS (SELECT j.job_id, title, is_active, d.text AS description, CASE WHEN j.job_id % 3 > 0 THEN date_posted END AS enriched_at, md5(d.text) AS content_hash, CASE WHEN j.job_id % 2 = 0 THEN md5(d.text) END AS enrichment_hash FROM jobs j LEFT JOIN documents d ON d.doc_id = j.job_id),
n AS (SELECT job_id, title, is_active, coalesce(length(trim(description)) >= 40, false) AND (enriched_at IS NULL OR (coalesce(content_hash, '') <> '' AND enrichment_hash IS DISTINCT FROM content_hash)) AS due FROM r)"""


def _readable(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("job_id"), F.col("text").alias("body"))
    j = b.jobs(spark, sf).drop("description").join(d, "job_id", "left")
    digest = F.md5("body")
    return j.select("job_id", "title", "is_active", F.col("body").alias("description"), F.lit(None).cast("string").alias("requirements"), F.when(F.col("job_id") % 3 > 0, F.col("date_posted")).alias("enriched_at"), digest.alias("content_hash"), F.when(F.col("job_id") % 2 == 0, digest).alias("enrichment_hash"))


@query(f"WITH {b.JOBS_SQL}, {_READ_SQL} SELECT job_id, due FROM n")
def needs_enrichment(spark, sf):
    return _readable(spark, sf).select("job_id", records.needs_enrichment().alias("due"))


@query(f"WITH {b.JOBS_SQL}, {_READ_SQL} SELECT job_id, CASE WHEN contains(title, 'machinery') THEN 1.0 ELSE 0.5 END AS affinity FROM n WHERE is_active AND due AND (contains(title, 'machinery') OR contains(title, 'intern')) ORDER BY affinity DESC, job_id LIMIT 200")
def enrichment_candidates(spark, sf):
    affinity = F.when(F.contains("title", F.lit("machinery")), 1.0).when(F.contains("title", F.lit("intern")), 0.5).otherwise(0.0)
    return records.enrichment_candidates(_readable(spark, sf), affinity, 200).select("job_id", "affinity")


@query(f"""WITH {b.JOBS_SQL}, {b.SKILLS_SQL}, f AS (SELECT o_orderkey AS job_id, ['economy', lower(o_orderpriority)] AS f_skills, CAST(o_custkey % 5 AS DOUBLE) AS f_years FROM orders WHERE o_orderkey % 4 = 0),
r AS (SELECT s.job_id, skills, CASE WHEN f.job_id IS NULL THEN [] ELSE list_filter(f_skills, lambda x: NOT list_contains(list_transform(skills, lambda y: lower(trim(y))), x)) END AS fresh, CASE WHEN s.job_id % 6 = 0 THEN 2.0 END AS years, f_years, f.job_id IS NOT NULL AS read FROM skills s LEFT JOIN f ON f.job_id = s.job_id)
SELECT job_id, array_to_string(list_concat(skills, fresh), ',') AS skills, CAST(len(fresh) AS INT) AS added, coalesce(years, f_years) AS years, CASE WHEN read THEN 'reader' END AS enrichment_model FROM r""")
def apply_facts(spark, sf):
    o = table(spark, sf, "orders").where("o_orderkey % 4 = 0")
    facts = o.select(F.col("o_orderkey").alias("job_id"), F.array(F.lit("economy"), F.lower("o_orderpriority")).alias("f_skills"), F.lit(None).cast("array<string>").alias("f_terms"), (F.col("o_custkey") % 5).cast("double").alias("f_years"))
    jobs = b.skills(spark, sf).withColumns({"terms": F.lit(None).cast("array<string>"), "years": F.when(F.col("job_id") % 6 == 0, 2.0), "content_hash": F.lit("h")})
    return records.apply_facts(jobs, facts, "reader", NOW).select("job_id", F.array_join("skills", ",").alias("skills"), "added", "years", "enrichment_model")


@query(WITH + ", t AS (SELECT job_id, CASE WHEN priority = 'maybe' THEN 'saved' ELSE 'new' END AS status, CASE WHEN job_id % 9 = 0 THEN date_posted END AS opened_at FROM jobs) SELECT user_id, job_id, status, notified_at AS opened_at FROM all_states UNION ALL SELECT 7, job_id, status, opened_at FROM t WHERE (status <> 'new' OR opened_at IS NOT NULL) AND job_id NOT IN (SELECT job_id FROM state WHERE job_id IS NOT NULL)")
def backfill_decisions(spark, sf):
    jobs = b.jobs(spark, sf).select("job_id", F.when(F.col("priority") == "maybe", "saved").otherwise("new").alias("status"), F.when(F.col("job_id") % 9 == 0, F.col("date_posted")).alias("opened_at"))
    before = b.all_states(spark, sf).select("user_id", "job_id", "status", F.col("notified_at").alias("opened_at"))
    return records.backfill_decisions(jobs, before, b.USER)


@query(WITH + "SELECT s.user_id, s.job_id, CASE WHEN s.user_id = 7 THEN coalesce(s.score, j.score) ELSE s.score END AS score FROM all_states s LEFT JOIN jobs j ON j.job_id = s.job_id")
def backfill_score(spark, sf):
    return records.backfill_score(b.all_states(spark, sf).select("user_id", "job_id", "score"), b.jobs(spark, sf), b.USER)


@query(WITH + "SELECT user_id, job_id, status, CASE WHEN status = 'dismissed' AND d_at IS NULL THEN saved_at ELSE d_at END AS dismissed_at FROM (SELECT *, CASE WHEN job_id % 2 = 0 THEN dismissed_at END AS d_at FROM all_states)")
def backfill_dismissed(spark, sf):
    before = b.all_states(spark, sf).select("user_id", "job_id", "status", F.col("saved_at").alias("updated_at"), F.when(F.col("job_id") % 2 == 0, F.col("dismissed_at")).alias("dismissed_at"))
    return records.backfill_dismissed(before).drop("updated_at")


@query(f"""WITH {_COMPANIES_SQL}, b AS (SELECT s_suppkey, s_acctbal > 0 AS enabled, max(l_shipdate) FILTER (l_returnflag <> 'R') AS last_success FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1, 2)
SELECT (SELECT count(*) FROM c) AS companies, count(*) AS boards, count(*) FILTER (enabled) AS active_boards, count(last_success) AS boards_crawled FROM b""")
def discovery_summary(spark, sf):
    from ..operators.discovery import discovery_summary as summary

    ok = table(spark, sf, "lineitem").where("l_returnflag <> 'R'").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.max("l_shipdate").alias("last_success"))
    boards = table(spark, sf, "supplier").select("s_suppkey", (F.col("s_acctbal") > 0).alias("enabled")).join(ok, "s_suppkey", "left")
    return summary(table(spark, sf, "customer"), boards)


@query(f"WITH {b.JOBS_SQL}, {_READ_SQL} SELECT count(*) AS total, count(enriched_at) AS read, count(*) FILTER (length(coalesce(description, '')) < 40) AS unreadable FROM r WHERE is_active")
def reading_coverage(spark, sf):
    rows = _readable(spark, sf).where("is_active")
    return rows.agg(F.count("*").alias("total"), F.count("enriched_at").alias("read"), F.count_if(F.length(F.coalesce("description", F.lit(""))) < records.MIN_BODY_CHARS).alias("unreadable"))


_ITEMS_SQL = """items AS (SELECT user_id, job_id, rank, score FROM (SELECT user_id, job_id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, job_id) AS rank FROM all_states WHERE status = 'new') WHERE rank <= 3),
kept AS (SELECT * FROM items WHERE user_id % 4 > 0)"""


def _dispatched(spark, sf):
    from pyspark.sql import Window

    s = b.all_states(spark, sf)
    order = Window.partitionBy("user_id").orderBy(F.desc("score"), "job_id")
    items = s.where("status = 'new'").withColumn("rank", F.row_number().over(order)).where("rank <= 3").select("user_id", "job_id", "rank", "score")
    sent = items.select("user_id").distinct().withColumn("ok", F.col("user_id") % 4 > 0)
    return records.dispatch(s.select("user_id", "job_id", "status", "notified_at"), items, sent, NOW)


@query(WITH + f", {_ITEMS_SQL} SELECT s.user_id, s.job_id, s.status, CASE WHEN k.job_id IS NOT NULL THEN {NOW_SQL} ELSE s.notified_at END AS notified_at FROM all_states s LEFT JOIN kept k ON k.user_id = s.user_id AND k.job_id = s.job_id")
def dispatch_state(spark, sf):
    return _dispatched(spark, sf)[1].select("user_id", "job_id", "status", "notified_at")


@query(WITH + f", {_ITEMS_SQL} SELECT k.user_id, j.job_id, j.company, rank FROM kept k JOIN jobs j ON j.job_id = k.job_id")
def notification_jobs(spark, sf):
    return _dispatched(spark, sf)[0].join(b.jobs(spark, sf).select("job_id", "company"), "job_id").select("user_id", "job_id", "company", F.col("rank").cast("long").alias("rank"))


@query(WITH + f", {_ITEMS_SQL} SELECT user_id, CAST(count(*) AS VARCHAR) || CASE WHEN count(*) = 1 THEN ' new job' ELSE ' new jobs' END || chr(10) || string_agg(rank || '. ' || j.title || ' - ' || j.company || ' (' || printf('%.1f', k.score) || ')', chr(10) ORDER BY rank) AS body FROM kept k JOIN jobs j ON j.job_id = k.job_id GROUP BY 1")
def digest_text(spark, sf):
    items = _dispatched(spark, sf)[0].join(b.jobs(spark, sf).select("job_id", "title", "company"), "job_id")
    return records.render_digest(items, "user_id", "rank")


@query(WITH + "SELECT user_id, max(ts) AS last_told, count(*) AS told FROM actions a JOIN jobs j ON j.job_id = a.job_id WHERE a.status = 'new' GROUP BY 1")
def last_notified(spark, sf):
    """The latest notification of each user, over its items."""
    told = _clicks(spark, sf).where("status = 'new'").join(b.jobs(spark, sf).select("job_id"), "job_id")
    return told.groupBy("user_id").agg(F.max("ts").alias("last_told"), F.count("*").alias("told"))


@query(WITH + "SELECT event_id, job_id, status, ts FROM actions WHERE user_id = 7 ORDER BY ts DESC, event_id DESC LIMIT 50")
def event_timeline(spark, sf):
    return records.recent(_clicks(spark, sf).where(F.col("user_id") == b.USER), "ts", "event_id", 50).select("event_id", "job_id", "status", "ts")


@query(WITH + "SELECT count(*) AS n FROM eff WHERE is_active AND eff_status IN ('new', 'saved') AND eff_score >= 70 AND (contains(lower(title), 'machinery') OR contains(lower(company), 'machinery') OR contains(lower(description), 'machinery'))")
def list_recount(spark, sf):
    """The number of rows of the list a user looks at, by the same filter that lists them."""
    from ..operators import filters

    f = filters.ListFilter(view="review", min_score=70.0, q="machinery")
    return filters.apply_filters(b.jobs(spark, sf), f, NOW, b.user_state(spark, sf)).agg(F.count("*").alias("n"))


@query("""WITH x AS (SELECT l_suppkey AS board, count(*) AS found FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-06-01' GROUP BY 1)
SELECT s_suppkey AS board, s_name AS company, coalesce(found, 0) AS found, CASE WHEN found > 0 THEN 'ok' WHEN s_acctbal < 5000 THEN 'speculative' ELSE 'empty' END AS state FROM supplier LEFT JOIN x ON board = s_suppkey""")
def board_yield(spark, sf):
    boards = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("board"), F.col("s_name").alias("company"), (F.col("s_acctbal") < 5000).alias("speculative"))
    found = table(spark, sf, "lineitem").where("l_shipdate >= timestamp_ntz '1998-06-01 00:00:00'").select(F.col("l_suppkey").alias("board"))
    return records.board_yield(found, boards).drop("speculative")


@query(r"SELECT doc_id FROM documents WHERE len(list_intersect(regexp_split_to_array(lower(text), '[^a-z0-9+#]+'), ['hardware', 'warranty', 'software', 'licensed'])) > 0")
def client_term_match(spark, sf):
    d = table(spark, sf, "documents")
    return records.matching_terms(d, F.col("text"), ["Hardware", "warranty", "software", "licensed"]).select("doc_id")


_PROJECTS = ["Economy car planner", "Small promo shop", "Standard desk"]


@query(f"""WITH {b.SKILLS_SQL}, o AS (SELECT job_id, skills, list_filter(skills, lambda x: list_contains(['ECONOMY', 'SMALL'], x)) AS own FROM skills),
e AS (SELECT *, CASE WHEN len(own) > 0 THEN own[1:6] ELSE skills[1:5] END AS emphasise FROM o)
SELECT job_id, array_to_string(emphasise, ',') AS emphasise, array_to_string(list_filter({_PROJECTS!r}, lambda p: len(list_filter(skills, lambda s: contains(lower(p), lower(s)))) > 0), ',') AS projects,
array_to_string(list_transform(emphasise[1:4], lambda s: 'Your hands-on experience with ' || s), ',') AS talking_points, array_to_string(skills[1:10], ',') AS interview_topics FROM e""")
def application_assistant(spark, sf):
    rows = records.assistant(b.skills(spark, sf), ["ECONOMY", "SMALL"], _PROJECTS)
    return rows.select("job_id", *[F.array_join(c, ",").alias(c) for c in ("emphasise", "projects", "talking_points", "interview_topics")])


_PHRASES = phrases.search_phrases(["Machinery Engineer Intern", "Building"], ["household"], ["germany", "france"], limit=12)


@query("WITH " + b.JOBS_SQL + ", p(phrase, place) AS (VALUES " + ", ".join(f"('{p}', {repr(at) if at else 'NULL'})" for p, at in _PHRASES) + ") SELECT phrase, place, count(*) AS hits FROM p JOIN jobs ON contains(title, string_split(lower(phrase), ' ')[1]) AND (place IS NULL OR lower(location) = place) GROUP BY 1, 2")
def query_expansion(spark, sf):
    """How many jobs each generated search phrase finds by its first word."""
    pairs = phrases.query_table(spark, _PHRASES)
    first = F.split(F.lower("phrase"), " ")[0]
    # A bounded number of phrases, made from the preferences: broadcast.
    jobs = b.jobs(spark, sf).groupBy("title", "location").agg(F.count("*").alias("n"))
    hits = jobs.join(F.broadcast(pairs), F.contains(F.col("title"), first) & (F.col("place").isNull() | (F.lower("location") == F.col("place"))))
    return hits.groupBy("phrase", "place").agg(F.sum("n").alias("hits"))
