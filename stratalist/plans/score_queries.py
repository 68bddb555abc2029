"""Scores from their own inputs, with explanations, and list queries by keyword, priority and status."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, urls
from ..operators import analytics, discovery, filters, score
from ..storage import table
from . import bindings as b
from .bindings import NOW, WITH

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


PREFS = score.Preferences(
    roles=[("automobile engineer", 1.0), ("machinery intern", 1.5)], skills=["economy", "small"], positive=["machinery", "urgent"], negative=["household", "urgent"], preferred=["customer#000000003"],
    blacklisted=["customer#000000005"], locations=[("NATION_21", 10.0), ("NATION_15", 6.0)], excluded_locations=["NATION_7"], hard_keywords=["not specified"], industries=["building"], seasons=["Summer"],
    needs_sponsorship=True, sponsorship_required=True, least_hourly=100.0, countries=["US"], max_years=2.0,
)


def _inputs(spark, sf):
    """Jobs with the facts that the components look at, all from the row of the order and the parts of its lines."""
    j = b.jobs(spark, sf, "o_custkey").join(b.skills(spark, sf), "job_id")
    pick = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))
    custkey = F.col("o_custkey")
    return j.withColumns({
        "years": F.when(custkey % 6 > 0, (custkey % 6).cast("double")), "degrees": F.when(custkey % 4 == 0, F.array(F.lit("PhD"))).when(custkey % 4 == 1, F.array(F.lit("Masters"), F.lit("PhD"))).otherwise(F.array().cast("array<string>")),
        "sponsorship": pick(["unknown", "offered", "not_offered", "citizenship_required", "security_clearance_required"], custkey % 5), "terms": F.array(pick(["Winter", "Spring", "Summer", "Fall"], F.quarter("date_posted") - 1)),
        "country": F.when(custkey % 9 == 0, "Canada").when(custkey % 9 == 1, "USA"), "slug": F.lower("company"), "body": F.lower(F.concat_ws(" ", "title", "description", F.lit("at"), "company")),
    })


def _components(rows):
    days = F.timestamp_diff("SECOND", "date_posted", F.lit(NOW).cast("timestamp_ntz")) / 86400
    lower = F.transform("skills", lambda x: F.lower(x))
    return {
        "role_match": score.role_match(F.col("tokens"), PREFS, F.col("title"), F.col("skills"), F.col("best")), "technical_skills": score.technical_skills(lower, F.col("body"), PREFS), "candidate_fit": score.candidate_fit(F.col("years"), F.col("degrees"), PREFS),
        "location": score.location_score(F.col("location"), PREFS, F.col("remote_status")), "company_preference": score.company_preference(F.col("slug"), PREFS, F.col("body")), "freshness": score.freshness_score(days),
        "internship_constraints": score.constraints_score(F.col("employment_type"), PREFS, F.col("terms"), F.col("sponsorship"), F.col("salary_min"), F.lit("yearly")),
    }


def _scored(spark, sf):
    # Columns of their own, which Spark computes once a row: what reads them names them several times.
    rows = _inputs(spark, sf).withColumn("tokens", text.role_tokens(text.title_core(F.col("title"), text.normalize_ascii)))
    rows = rows.withColumn("best", score.best_role(F.col("tokens"), PREFS))
    rows = rows.withColumns({f"p_{n}": x for n, x in _components(rows).items()})
    parts = {n: F.col(f"p_{n}") for n in PREFS.weights}
    blended = score.blend(parts, PREFS.weights)
    return rows.withColumns({"blended": blended, "penalty": score.negative_penalty(F.col("title"), F.col("body"), PREFS)})


_PARTS_SQL = f"""WITH {b.JOBS_SQL}, {b.SKILLS_SQL}, i AS (SELECT j.*, s.skills, o.o_custkey AS ck, lower(title || ' ' || description || ' at ' || company) AS body, greatest(epoch({b.NOW_SQL} - date_posted) / 86400, 0) AS days FROM jobs j JOIN skills s USING (job_id) JOIN orders o ON o_orderkey = j.job_id),
p AS (SELECT *, CASE title WHEN 'automobile engineer' THEN 100.0 WHEN 'automobile intern' THEN 100 / 1.35 WHEN 'machinery engineer' THEN 100 * 0.875 * 1.075 WHEN 'machinery intern' THEN 100.0 ELSE 0.0 END AS p_role_match,
least(100.0, 100 * least(1.0, len(list_filter(skills, lambda x: x IN ('ECONOMY', 'SMALL'))) / 3.0) + 3.0 * (CASE WHEN contains(body, 'machinery') THEN 1 ELSE 0 END + CASE WHEN contains(body, 'urgent') THEN 1 ELSE 0 END)) AS p_technical_skills,
CASE WHEN ck % 6 > 0 OR ck % 4 < 2 THEN 70.0 + CASE WHEN ck % 6 = 0 THEN 0 WHEN ck % 6 <= 2 THEN 15 ELSE -least(50, 12 * (ck % 6 - 2)) END + CASE WHEN ck % 4 = 0 THEN -30 ELSE 0 END END AS p_candidate_fit,
CASE WHEN remote_status = 'remote' THEN 75.0 WHEN contains(lower(location), 'nation_7') THEN 0.0 WHEN location = 'NATION_21' THEN 100.0 WHEN location = 'NATION_15' THEN 80.0 ELSE 60.0 END AS p_location,
CASE WHEN lower(company) = 'customer#000000003' THEN 100.0 WHEN regexp_matches(body, '(^|[^a-z0-9])building([^a-z0-9]|$)') THEN 75.0 ELSE 50.0 END AS p_company_preference,
CASE WHEN days <= 1 THEN 100.0 WHEN days <= 3 THEN 70.0 WHEN days <= 7 THEN 30.0 WHEN days <= 14 THEN 10.0 ELSE 0.0 END AS p_freshness,
greatest(0.0, least(100.0, 50.0 + CASE employment_type WHEN 'internship' THEN 35 WHEN 'unknown' THEN 5 ELSE -35 END + CASE WHEN quarter(date_posted) = 3 THEN 10 ELSE -10 END + ([0, 10, -30, -40, -25])[ck % 5 + 1]
  + CASE WHEN salary_min IS NULL THEN 0 WHEN salary_min / 2080.0 >= 100 THEN 8 ELSE -10 END)) AS p_internship_constraints,
least(40.0, 6.0 * (CASE WHEN contains(title, 'household') THEN 2.0 WHEN contains(body[:4000], 'household') THEN 0.5 ELSE 0 END + CASE WHEN contains(title, 'urgent') THEN 2.0 WHEN contains(body[:4000], 'urgent') THEN 0.5 ELSE 0 END)) AS penalty FROM i),
f AS (SELECT *, (p_role_match * 25 + p_technical_skills * 25) / 50 * (0.7 + 0.3 * ((coalesce(p_candidate_fit * 15, 0) + p_location * 10 + p_company_preference * 5 + p_freshness * 10 + p_internship_constraints * 10) / (CASE WHEN p_candidate_fit IS NULL THEN 0 ELSE 15 END + 35)) / 100) AS blended FROM p)"""


@query(_PARTS_SQL + " SELECT job_id, round(p_role_match, 6) AS role_match, round(p_technical_skills, 6) AS technical_skills, p_candidate_fit AS candidate_fit, p_location AS location, p_company_preference AS company_preference, p_freshness AS freshness, p_internship_constraints AS internship_constraints FROM f")
def score_inputs(spark, sf):
    """All seven components, each from its own inputs."""
    rows = _scored(spark, sf)
    return rows.select("job_id", *[(F.round(f"p_{n}", 6) if n in score.RELEVANCE else F.col(f"p_{n}")).alias(n) for n in PREFS.weights])


@query(_PARTS_SQL + ", s AS (SELECT job_id, greatest(0.0, least(100.0, blended - penalty)) AS exact, round_even(greatest(0.0, least(100.0, blended - penalty)), 1) AS score FROM f) SELECT job_id, score, CASE WHEN exact >= 90 THEN 'apply_now' WHEN exact >= 80 THEN 'strong_match' WHEN exact >= 70 THEN 'worth_considering' WHEN exact >= 60 THEN 'maybe' ELSE 'skip' END AS priority FROM s")
def score_final(spark, sf):
    """The score to one decimal; its priority is that of the unrounded one."""
    exact = score.exact_score(F.col("blended"), F.col("penalty"))
    return _scored(spark, sf).select("job_id", score.final_score(F.col("blended"), F.col("penalty")).alias("score"), score.priority_band(exact).alias("priority"))


@query(_PARTS_SQL + ", s AS (SELECT job_id, round_even(greatest(0.0, least(100.0, blended - penalty)), 1) AS score FROM f), a AS (SELECT job_id, (job_id % 101) / 113.0 + 0.00123 AS relevance FROM s WHERE score >= 60 ORDER BY score DESC, job_id LIMIT 50) SELECT s.job_id, CASE WHEN relevance IS NOT NULL THEN round_even(0.75 * score + 25.0 * relevance, 1) ELSE score END AS score FROM s LEFT JOIN a ON a.job_id = s.job_id")
def score_with_model(spark, sf):
    """The best rows moved by a model, for which a fixed function of the id stands."""
    rows = _scored(spark, sf).select("job_id", score.final_score(F.col("blended"), F.col("penalty")).alias("score"))
    return score.model_blend(rows, lambda asked: asked.select("job_id", ((F.col("job_id") % 101) / 113.0 + 0.00123).alias("relevance")), 50)


@query(_PARTS_SQL + """ SELECT job_id, array_to_string(list_filter(skills, lambda x: x IN ('ECONOMY', 'SMALL')), ',') AS matched, array_to_string(list_filter(skills, lambda x: x NOT IN ('ECONOMY', 'SMALL'))[1:10], ',') AS missing,
concat_ws(',', CASE WHEN ck % 6 > 2 THEN CAST(ck % 6 AS VARCHAR) || '+ years experience' END, CASE WHEN ck % 4 < 2 THEN 'PhD' END) AS requirements,
concat_ws(',', CASE WHEN title LIKE 'automobile %' THEN 'Matches target role: automobile engineer' WHEN title LIKE 'machinery %' THEN 'Matches target role: machinery intern' END, CASE WHEN p_location > 60 THEN 'Good location' END, CASE WHEN p_company_preference >= 100 THEN 'Preferred company' END,
  CASE WHEN p_freshness >= 100 THEN 'Posted today' END, CASE WHEN p_internship_constraints >= 80 THEN 'Internship' END) AS reasons,
concat_ws(',', CASE WHEN p_role_match < 30 THEN 'Title does not match your target roles' END, CASE WHEN p_location = 0 THEN 'Excluded location' END, CASE WHEN p_freshness = 0 THEN 'Posted long ago' END, CASE WHEN p_internship_constraints < 50 THEN 'Not an internship' END) AS concerns FROM f""")
def score_explained(spark, sf):
    """Matched and missing skills, missing requirements, and what speaks for and against a listing."""
    rows = _scored(spark, sf)
    matched, missing = score.skill_gap(F.col("skills"), PREFS)
    good, bad = score.explanations({n: F.col(f"p_{n}") for n in PREFS.weights}, F.col("best"))
    lists = {"matched": matched, "missing": missing, "requirements": score.missing_requirements(F.col("years"), F.col("degrees"), PREFS), "reasons": good, "concerns": bad}
    return rows.select("job_id", *[F.array_join(x, ",").alias(n) for n, x in lists.items()])


@query(_PARTS_SQL + """ SELECT job_id, CASE WHEN lower(company) = 'customer#000000005' THEN 'company' WHEN contains(lower(location), 'nation_7') THEN 'location: NATION_7' WHEN ck % 9 = 0 THEN 'country: Canada'
WHEN contains(body[:4000], 'not specified') THEN 'keyword: not specified' WHEN ck % 5 IN (2, 3) THEN 'sponsorship' END AS reason FROM f""")
def exclusions_full(spark, sf):
    rows = _inputs(spark, sf)
    return rows.select("job_id", score.hard_exclusion(F.col("slug"), F.col("location"), F.col("body"), PREFS, F.col("country"), F.col("sponsorship")).alias("reason"))


@query(WITH + "SELECT job_id, eff_score FROM eff WHERE is_active AND eff_status = 'new' AND eff_priority = 'maybe' AND (contains(lower(title), 'machinery') OR contains(lower(company), 'machinery') OR contains(lower(description), 'machinery')) ORDER BY eff_score DESC, date_posted DESC NULLS LAST, job_id LIMIT 40 OFFSET 40")
def filter_keyword_page(spark, sf):
    """The second page of a list by keyword, priority and status, in the default order."""
    f = filters.ListFilter(view="review", q="machinery", priority="maybe", status="new", page=2, per_page=40)
    return filters.page_of(filters.apply_filters(b.jobs(spark, sf), f, NOW, b.user_state(spark, sf)), f).select("job_id", "eff_score")


@query("SELECT page_id, url AS target FROM pages")
def url_unwrap(spark, sf):
    """Every page's url, wrapped in a redirect, comes out as it was."""
    wrapped = F.concat(F.lit("https://www.google.com/url?sa=t&q="), F.url_encode("url"))
    return table(spark, sf, "pages").select("page_id", urls.unwrap_redirect(wrapped).alias("target"))


@query("SELECT doc_id, CASE WHEN contains(t, 'fpga') OR contains(t, 'programmable logic') THEN 'FPGA' WHEN contains(t, 'verification') OR contains(t, 'uvm') OR contains(t, 'dv ') THEN 'Hardware Verification' WHEN contains(t, 'rtl') OR contains(t, 'digital design') OR contains(t, 'logic design') THEN 'RTL / Digital Design' WHEN contains(t, 'asic') OR contains(t, 'soc') OR contains(t, 'silicon') THEN 'ASIC / SoC' WHEN contains(t, 'architecture') OR contains(t, 'microarchitecture') THEN 'Computer Architecture' WHEN contains(t, 'embedded') OR contains(t, 'firmware') OR contains(t, 'driver') THEN 'Embedded / Firmware' WHEN contains(t, 'hardware security') OR contains(t, 'side channel') OR contains(t, 'secure boot') THEN 'Hardware Security' WHEN contains(t, 'machine learning') OR contains(t, 'deep learning') OR contains(t, 'ml ') OR contains(t, 'ai ') THEN 'Machine Learning' WHEN contains(t, 'software') OR contains(t, 'swe') OR contains(t, 'full stack') OR contains(t, 'backend') OR contains(t, 'frontend') THEN 'Software' ELSE 'Other' END AS category FROM (SELECT doc_id, lower(text) AS t FROM documents)")
def title_categories(spark, sf):
    return table(spark, sf, "documents").select("doc_id", analytics.category_of(F.lower("text")).alias("category"))


@query("SELECT s_nationkey % 3 AS provider, s_name AS board, arg_min(c_name, k) AS company, arg_min(l_returnflag, k) AS source, arg_min(l_linestatus, k) FILTER (l_quantity > 25) AS extra, count(*) AS n FROM (SELECT *, o_orderkey * 1000 + o_custkey * 10 + 0.001 * l_quantity + 0.0000001 * l_partkey AS k FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey) GROUP BY 1, 2")
def board_harvest(spark, sf):
    item, o, c, s = (table(spark, sf, t) for t in ("lineitem", "orders", "customer", "supplier"))
    rows = item.join(o, item["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"]).join(s, item["l_suppkey"] == s["s_suppkey"])
    at = F.col("o_orderkey") * 1000 + F.col("o_custkey") * 10 + 0.001 * F.col("l_quantity") + 0.0000001 * F.col("l_partkey")
    rows = rows.select((F.col("s_nationkey") % 3).alias("provider"), F.col("s_name").alias("board"), F.col("c_name").alias("company"), F.col("l_returnflag").alias("source"), F.when(F.col("l_quantity") > 25, F.col("l_linestatus")).alias("extra"), at.alias("at"))
    return discovery.harvest_boards(rows)
