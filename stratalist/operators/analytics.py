"""Counters, facets, coverage and outcome reports."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import slugify_company
from .filters import VIEWS

# When outcomes are reported, and the families that titles are sorted into (the first that fits).
MIN_APPLICATIONS, MIN_PER_CATEGORY, BETTER = 15, 5, 1.5
CATEGORIES = {
    "FPGA": ["fpga", "programmable logic"], "Hardware Verification": ["verification", "uvm", "dv "], "RTL / Digital Design": ["rtl", "digital design", "logic design"],
    "ASIC / SoC": ["asic", "soc", "silicon"], "Computer Architecture": ["architecture", "microarchitecture"], "Embedded / Firmware": ["embedded", "firmware", "driver"],
    "Hardware Security": ["hardware security", "side channel", "secure boot"], "Machine Learning": ["machine learning", "deep learning", "ml ", "ai "],
    "Software": ["software", "swe", "full stack", "backend", "frontend"],
}


def ntz(at: datetime) -> Column:
    return F.lit(at).cast("timestamp_ntz")


def dashboard_counts(rows: DataFrame, now: datetime) -> DataFrame:
    """All counters in one pass over rows with effective columns."""
    active, status, priority = F.col("is_active"), F.col("eff_status"), F.col("eff_priority")
    review = active & status.isin(VIEWS["review"])
    fresh = active & (status == "new")
    return rows.agg(
        F.count_if(review).alias("to_review"),
        F.count_if(fresh).alias("new"),
        F.count_if(review & (priority == "apply_now")).alias("apply_now"),
        F.count_if(review & (priority == "strong_match")).alias("strong"),
        F.count_if(fresh & (F.col("date_discovered") >= ntz(now - timedelta(days=1)))).alias("new_since_yesterday"),
        F.count_if(status == "saved").alias("saved"),
        F.count_if(status.isin(VIEWS["applied"])).alias("applied"),
        F.count_if(status == "dismissed").alias("dismissed"),
        F.count_if(status == "interview").alias("interviews"),
        F.count_if(status == "offer").alias("offers"),
        F.count_if(active & (status != "dismissed")).alias("total_active"),
    )


def facet(rows: DataFrame, column: str, top: int | None = 30) -> DataFrame:
    """Rows for each value, the most frequent first; ties by name."""
    out = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), "value").limit(top) if top else out


def skill_facet(rows: DataFrame, top: int = 30) -> DataFrame:
    return facet(rows.select(F.explode("skills").alias("skill")), "skill", top)


def score_thresholds(rows: DataFrame, levels: tuple[int, ...] = (60, 70, 80, 90)) -> DataFrame:
    return rows.agg(*[F.count_if(F.col("eff_score") >= x).alias(f"at_least_{x}") for x in levels])


def multi_source(listings: DataFrame) -> DataFrame:
    """How many jobs came from several listings, and how many listings were spared."""
    by = listings.groupBy("job_id").agg(F.count("*").alias("n"))
    return by.agg(F.count_if(F.col("n") > 1).alias("multi_source"), F.sum(F.col("n") - 1).alias("duplicates_removed"))


def summary(rows: DataFrame) -> DataFrame:
    """Totals, mean score and the application funnel: how many reached each step, whatever their status is now."""
    return rows.agg(
        F.count("*").alias("total"), F.count_if("is_active").alias("active"), F.round(F.avg("score"), 4).alias("avg_score"), F.count("user_applied_at").alias("applied"),
        F.count("user_interview_at").alias("interviews"), F.count("user_offer_at").alias("offers"),
    )


def source_yield(listings: DataFrame, jobs: DataFrame, since: datetime) -> DataFrame:
    """Distinct jobs, strong listings and the percentage of all strong listings for each source in a window, the strongest first."""
    recent = listings.where(F.col("first_seen") >= ntz(since)).join(jobs.select("job_id", "priority"), "job_id")
    strong = F.col("priority").isin("apply_now", "strong_match")
    by = recent.groupBy("source").agg(F.countDistinct("job_id").alias("jobs"), F.sum(F.when(strong, 1).otherwise(0)).alias("strong"))
    # One row for each source: the window over all of them is small.
    total = F.greatest(F.sum("strong").over(Window.partitionBy()), F.lit(1))
    return by.select("source", "jobs", "strong", F.round(100.0 * F.col("strong") / total, 1).alias("share_of_strong")).orderBy(F.desc("strong"), "source")


def preferred_coverage(jobs: DataFrame, preferred: DataFrame) -> DataFrame:
    """For each preferred company (name): its active jobs and internships, and what is wrong."""
    counts = jobs.where("is_active").groupBy("company").agg(F.count("*").alias("jobs"), F.count_if(F.col("employment_type").isin("internship", "co_op")).alias("internships"))
    counts = counts.groupBy(slugify_company(F.col("company")).alias("slug")).agg(F.sum("jobs").alias("jobs"), F.sum("internships").alias("internships"))
    out = preferred.withColumn("slug", slugify_company(F.col("name"))).join(counts, "slug", "left")
    state = F.when(F.col("internships") > 0, "ok").when(F.col("jobs") > 0, "no_internships").otherwise("missing")
    out = out.select("name", "slug", F.coalesce("jobs", F.lit(0)).alias("jobs"), F.coalesce("internships", F.lit(0)).alias("internships"), state.alias("state"))
    # What needs action first.
    return out.orderBy(F.array_position(F.array(*map(F.lit, ("missing", "no_internships", "ok"))), F.col("state")), F.lower("name"))


def top_by_status(rows: DataFrame, statuses: list[str], top: int = 80) -> DataFrame:
    """The board: the best rows of each status by shared score."""
    order = Window.partitionBy("eff_status").orderBy(F.desc("score"), "job_id")
    return rows.where(F.col("eff_status").isin(statuses)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def category_of(text: Column) -> Column:
    """The first family of which a needle is in the lower-case text."""
    out = F.lit("Other")
    for name in reversed(CATEGORIES):
        hit = F.lit(False)
        for needle in CATEGORIES[name]:
            hit = hit | F.contains(text, F.lit(needle))
        out = F.when(hit, name).otherwise(out)
    return out


def outcome_insights(applications: DataFrame) -> DataFrame:
    """category, applied_at, interview_at, offer_at, rejected_at: rates, and whether there is enough to compare."""
    rows = applications.where(F.col("applied_at").isNotNull())
    by = rows.groupBy("category").agg(F.count("*").alias("applications"), F.count("interview_at").alias("interviews"), F.count("offer_at").alias("offers"), F.count("rejected_at").alias("rejections"))
    by = by.withColumn("interview_rate", F.round(100.0 * F.col("interviews") / F.col("applications"), 4))
    all_of_it = Window.partitionBy()  # one row for each category
    comparable = F.when(F.col("applications") >= MIN_PER_CATEGORY, F.col("interview_rate"))
    by = by.withColumns({"total": F.sum("applications").over(all_of_it), "best": F.max(comparable).over(all_of_it), "worst": F.min(comparable).over(all_of_it)})
    enough = F.col("total") >= MIN_APPLICATIONS
    stands_out = enough & (comparable == F.col("best")) & (F.col("best") > F.col("worst") * BETTER) & (F.col("interviews") > 0)
    return by.select("category", "applications", "interviews", "offers", "rejections", "interview_rate", enough.alias("enough_data"), F.coalesce(stands_out, F.lit(False)).alias("stands_out")).orderBy(F.desc("interview_rate"), F.desc("applications"), "category")


def first_seen(rows: DataFrame, key: str, order: str, keep: list[str]) -> DataFrame:
    """For each key: the kept columns of its first row by ``order``, and how many rows it has."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), *[F.min_by(c, order).alias(c) for c in keep])
