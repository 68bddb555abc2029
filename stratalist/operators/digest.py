"""Selection of a digest: what is new, changed or about to close, ranked and capped."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .analytics import ntz
from .filters import with_user_state

# Statuses that count as acted on, and the order of priorities.
ACTED_ON = ("saved", "applied", "assessment", "interview", "offer", "rejected", "dismissed")
PRIORITIES = ("apply_now", "strong_match", "worth_considering", "maybe", "skip")
MIN_SCORE, MAX_JOBS, COOLDOWN_HOURS, DEADLINE_DAYS = 80.0, 7, 72, 3


def days_left(deadline: Column, now: datetime) -> Column:
    """Whole days until then, floored: 3 days and 23 hours are 3, an hour ago is -1."""
    return F.floor(F.timestamp_diff("SECOND", ntz(now), deadline) / 86400)


def eligible(jobs: DataFrame, state: DataFrame, now: datetime, min_score: float = MIN_SCORE, *, updates: bool = True, acted_on: bool = False, candidates: DataFrame | None = None) -> DataFrame:
    """Rows to tell about, with reason: new, update or deadline.

    A job that was told before comes again only if it was updated and the cool-down is over (``updates``). Whatever the reason, an explicit
    deadline of at most three whole days ahead makes it a deadline. ``acted_on`` keeps jobs that the user has acted on; ``candidates`` (job_id) restricts them.
    """
    rows = with_user_state(jobs, state).where(F.col("is_active") & (F.col("eff_score") >= min_score))
    if not acted_on:
        rows = rows.where(~F.col("eff_status").isin(list(ACTED_ON)))
    if candidates is not None:
        rows = rows.join(candidates.select("job_id"), "job_id", "left_semi")
    told = F.col("user_notified_at").isNotNull()
    again = F.lit(updates) & (F.col("freshness") == "updated") & (F.col("user_notified_at") <= ntz(now - timedelta(hours=COOLDOWN_HOURS)))
    closing = F.coalesce(F.col("deadline_is_explicit") & days_left(F.col("deadline"), now).between(0, DEADLINE_DAYS), F.lit(False))
    reason = F.when(~told | F.coalesce(again, F.lit(False)), F.when(closing, "deadline").when(told, "update").otherwise("new"))
    return rows.withColumn("reason", reason).where(F.col("reason").isNotNull())


def select_digest(jobs: DataFrame, state: DataFrame, now: datetime, *, min_score: float = MIN_SCORE, max_jobs: int = MAX_JOBS) -> DataFrame:
    """job_id, reason, eff_score and rank of the best rows; deadlines first, then by priority and score."""
    level = F.array_position(F.array(*map(F.lit, PRIORITIES)), F.col("eff_priority"))
    order = [(F.col("reason") != "deadline").cast("int"), F.when(level == 0, len(PRIORITIES) + 1).otherwise(level), F.desc("eff_score"), F.col("job_id")]
    top = eligible(jobs, state, now, min_score).orderBy(*order).limit(max(1, max_jobs))
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy().orderBy(*order))  # at most max_jobs rows
    return top.select("job_id", "reason", "eff_score", rank.alias("rank"))


def digest_totals(jobs: DataFrame, state: DataFrame, now: datetime, min_score: float = MIN_SCORE) -> DataFrame:
    """Totals over all rows that are eligible, not only those that fit."""
    rows = eligible(jobs, state, now, min_score)
    by_reason = [F.count_if(F.col("reason") == r).alias(f"n_{r}") for r in ("new", "update", "deadline")]
    return rows.agg(*by_reason, *[F.count_if(F.col("eff_priority") == p).alias(f"n_{p}") for p in PRIORITIES[:2]], F.count("*").alias("total"))
