"""What models replied, table functions in SQL, and how jobs are shown."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import display, model_output, table_functions
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


#: The longest reply that is parsed here.
MOST = 5_000


def _replies(spark, sf):
    """A reply for each order, in one of seven shapes: whole, fenced, among words, cut off, none, wrong types, and far too long."""
    o = table(spark, sf, "orders")
    skills = F.transform(F.sequence(F.lit(1), (F.col("o_orderkey") % 25 + 1).cast("int")), lambda i: F.concat(F.lit(" Skill  "), ((F.col("o_custkey") + i) % 30).cast("string")))
    skills = F.concat(skills, F.array(F.lit("Teamwork"), F.lit("skill 1")))
    domain = F.element_at(F.array(*map(F.lit, ("Hardware", "ml", "cooking", "new grad"))), (F.col("o_custkey") % 4 + 1).cast("int"))
    body = F.to_json(F.struct(skills.alias("skills"), domain.alias("domain"), F.lit("New Grad").alias("seniority"), (F.col("o_custkey") % 2 == 0).alias("is_internship"), (F.col("o_custkey") % 40).alias("min_years_experience"), F.array(F.lit("Summer"), F.lit(" "), F.lit("Fall")).alias("terms")))
    odd = F.format_string('{"skills": "c", "domain": 5, "is_internship": "yes", "min_years_experience": "7", "terms": {"a": 1}, "summary": "  two   words %s "}', F.col("o_orderkey"))
    shapes = [body, F.concat(F.lit("```json\n"), body, F.lit("\n```")), F.concat(F.lit("Sure: "), body, F.lit(" Done.")), F.substring(body, 1, 30), F.lit("I cannot tell."), odd, F.concat(body, F.repeat(F.lit(" "), F.lit(MOST + 1)))]
    kind = F.col("o_orderkey") % 7
    reply = F.lit(None).cast("string")
    for i, shape in enumerate(shapes):
        reply = F.when(kind == i, shape).otherwise(reply)
    return o.select("o_orderkey", "o_custkey", reply.alias("reply"))


@query("""WITH k AS (SELECT *, o_orderkey % 7 AS kind FROM orders), s AS (SELECT o_orderkey, list_distinct([x FOR x IN list_concat(['skill ' || (o_custkey + i) % 30 FOR i IN range(1, o_orderkey % 25 + 2)], ['skill 1'])]) AS names FROM k)
SELECT k.o_orderkey, CASE WHEN kind = 3 THEN 'no_object' WHEN kind = 4 THEN 'no_object' WHEN kind = 6 THEN 'oversized' ELSE 'ok' END AS status, CASE WHEN kind <= 2 THEN least(len(names), 20) WHEN kind = 5 THEN 0 END AS n_skills,
CASE WHEN kind <= 2 THEN (['hardware', 'ml', 'unknown', 'unknown'])[o_custkey % 4 + 1] WHEN kind = 5 THEN 'unknown' END AS domain, CASE WHEN kind <= 2 THEN 'new_grad' WHEN kind = 5 THEN 'unknown' END AS seniority,
CASE WHEN kind <= 2 THEN o_custkey % 2 = 0 END AS is_internship, CASE WHEN kind <= 2 AND o_custkey % 40 <= 30 THEN CAST(o_custkey % 40 AS DOUBLE) WHEN kind = 5 THEN 7.0 END AS years,
CASE WHEN kind <= 2 THEN 'Summer,Fall' WHEN kind = 5 THEN '' END AS terms, CASE WHEN kind <= 2 THEN '' WHEN kind = 5 THEN 'two words ' || k.o_orderkey END AS summary FROM k JOIN s ON s.o_orderkey = k.o_orderkey""")
def model_facts(spark, sf):
    """Typed facts of every reply, and what became of those that hold none."""
    rows = model_output.with_reply(_replies(spark, sf), "reply", most=MOST).withColumn("f", model_output.facts(F.col("reply_json")))
    return rows.select(
        "o_orderkey", F.col("reply_status").alias("status"), F.size("f.skills").cast("long").alias("n_skills"), "f.domain", "f.seniority", "f.is_internship", F.col("f.min_years_experience").alias("years"),
        F.array_join("f.terms", ",").alias("terms"), "f.summary",
    ).withColumn("n_skills", F.when(F.col("domain").isNotNull(), F.col("n_skills")))


@query("SELECT 'b' || s_nationkey % 3 AS provider, s_name AS board, arg_min(o_orderstatus, k) AS company, arg_min(l_returnflag, k) AS source, arg_min(l_linestatus, k) FILTER (l_quantity > 45) AS extra, count(*) AS n FROM (SELECT *, o_orderkey * 10 + l_linenumber AS k FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey) GROUP BY 1, 2")
def harvest_in_sql(spark, sf):
    """Boards seen in listings, by the table function."""
    table_functions.register(spark)
    item, o, s = (table(spark, sf, t) for t in ("lineitem", "orders", "supplier"))
    item = item.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    seen = item.join(o, item["l_orderkey"] == o["o_orderkey"]).join(s, item["l_suppkey"] == s["s_suppkey"])
    extra = F.when(F.col("l_quantity") > 45, F.col("l_linestatus")).otherwise("")
    seen = seen.select(F.concat(F.lit("b"), (F.col("s_nationkey") % 3).cast("string")).alias("provider"), F.col("s_name").alias("board"), F.col("o_orderstatus").alias("company"), F.col("l_returnflag").alias("source"), extra.alias("extra"), F.struct((F.col("o_orderkey") * 10 + F.col("l_linenumber")).alias("k"), "file", "row").alias("at"))  # of lines with one number, the first stored
    return spark.sql("SELECT * FROM harvest_boards(TABLE({seen}))", seen=table_functions.fold_seen(seen))


@query(WITH + f""", d AS (SELECT *, CAST(floor(epoch({NOW_SQL} - date_posted) / 86400) AS BIGINT) AS ago, CAST(floor(epoch(deadline - {NOW_SQL}) / 86400) AS BIGINT) AS ahead, CASE WHEN job_id % 5 = 0 THEN salary_min / 10000 ELSE salary_min END AS low FROM eff)
SELECT job_id, CASE WHEN ago < 0 THEN 'just now' WHEN ago = 0 THEN CAST(epoch({NOW_SQL} - date_posted) AS BIGINT) // 3600 || 'h ago' WHEN ago = 1 THEN 'yesterday' WHEN ago < 30 THEN ago || ' days ago' WHEN ago < 365 THEN ago // 30 || ' month' || CASE WHEN ago // 30 = 1 THEN '' ELSE 's' END || ' ago' ELSE ago // 365 || ' year' || CASE WHEN ago // 365 = 1 THEN '' ELSE 's' END || ' ago' END AS posted,
CASE WHEN deadline IS NULL OR NOT deadline_is_explicit THEN 'none' WHEN ahead < 0 THEN 'passed' WHEN ahead <= 2 THEN 'urgent' WHEN ahead <= 7 THEN 'soon' ELSE 'ok' END AS level,
CASE WHEN low IS NULL THEN 'Not listed' ELSE '€' || CASE WHEN low >= 1000 THEN format('{{:,}}', CAST(round_even(low, 0) AS BIGINT)) ELSE regexp_replace(regexp_replace(printf('%.2f', low), '0+$', ''), '\\.$', '') END || CASE WHEN job_id % 2 = 0 THEN '–€' || format('{{:,}}', CAST(round_even(low + 100000, 0) AS BIGINT)) ELSE '' END || '/yr' END AS pay,
CASE WHEN eff_score >= 90 THEN 'score-90' WHEN eff_score >= 80 THEN 'score-80' WHEN eff_score >= 70 THEN 'score-70' WHEN eff_score >= 60 THEN 'score-60' ELSE 'score-low' END AS score_class,
CASE WHEN deadline IS NULL THEN '' WHEN CAST(deadline - INTERVAL 4 HOUR AS DATE) = DATE '2001-06-01' THEN 'today' WHEN CAST(deadline - INTERVAL 4 HOUR AS DATE) = DATE '2001-06-02' THEN 'tomorrow' ELSE strftime(deadline - INTERVAL 4 HOUR, '%a %d %b') END || CASE WHEN deadline IS NULL THEN '' ELSE strftime(deadline - INTERVAL 4 HOUR, ' at %H:%M') END AS closes
FROM d WHERE deadline IS NULL OR month(deadline) IN (5, 6, 7, 8, 9)""")
def job_display(spark, sf):
    """How each job is told: when it was posted, its deadline, its pay and its class of score; summer deadlines where the user is."""
    from ..operators.filters import with_user_state

    rows = with_user_state(b.jobs(spark, sf), b.user_state(spark, sf)).where("deadline is null or month(deadline) in (5, 6, 7, 8, 9)")
    low = F.when(F.col("job_id") % 5 == 0, F.col("salary_min") / 10000).otherwise(F.col("salary_min"))
    high = F.when(F.col("job_id") % 2 == 0, low + 100_000)
    return rows.select(
        "job_id", display.time_ago(F.col("date_posted"), NOW).alias("posted"), display.deadline_badge(F.col("deadline"), F.col("deadline_is_explicit"), NOW)["level"].alias("level"),
        display.salary_text(low, high, F.lit("EUR"), F.lit("yearly")).alias("pay"), display.score_class(F.col("eff_score")).alias("score_class"), display.when_text(F.col("deadline"), "America/New_York", NOW).alias("closes"),
    )
