"""The list query: filters, views, order and pages over listings with one user's state."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Which statuses a view shows, and the views of decided work, where closed listings stay.
VIEWS = {
    "review": ["new", "saved"],
    "saved": ["saved"],
    "applied": ["applied", "assessment", "interview", "offer", "rejected"],
    "dismissed": ["dismissed"],
}
HISTORY_VIEWS = ("applied", "dismissed")
DEFAULT_VIEW = "review"


@dataclass(frozen=True)
class ListFilter:
    view: str = DEFAULT_VIEW
    q: str = ""
    min_score: float | None = None
    max_score: float | None = None
    company: str = ""
    location: str = ""
    role: str = ""
    priority: str = ""
    status: str = ""
    remote_status: str = ""
    skill: str = ""
    source: str = ""
    has_salary: bool = False
    include_inactive: bool = False
    include_dismissed: bool = False
    posted_within_days: int | None = None
    deadline_within_days: int | None = None
    sort: str = "score"
    page: int = 1
    per_page: int = 25

    @classmethod
    def from_query(cls, values: dict[str, str]) -> ListFilter:
        """Bad numbers count as absent, an unknown view as the default; pages hold 1 to 100 rows."""

        def number(name: str, kind: type):
            try:
                return kind(values.get(name, "").strip())
            except ValueError:
                return None

        def text(name: str) -> str:
            return values.get(name, "").strip()

        def flag(name: str) -> bool:
            return text(name).lower() in ("1", "true", "on", "yes")

        view = text("view") if text("view") in (*VIEWS, "all") else DEFAULT_VIEW
        texts = {k: text(k) for k in ("q", "company", "location", "role", "priority", "status", "remote_status", "skill", "source")}
        flags = {k: flag(k) for k in ("has_salary", "include_inactive", "include_dismissed")}
        page = max(1, number("page", int) or 1)
        per_page = min(100, max(1, number("per_page", int) or 25))
        scores = {k: number(k, float) for k in ("min_score", "max_score")}
        days = {k: number(k, int) for k in ("posted_within_days", "deadline_within_days")}
        return cls(view=view, sort=text("sort") or "score", page=page, per_page=per_page, **texts, **flags, **scores, **days)

    def to_query(self) -> dict[str, str]:
        """Only what differs from the defaults."""
        base = ListFilter()
        own = {k: getattr(self, k) for k in self.__dataclass_fields__}
        return {k: ("1" if v is True else f"{v:g}" if isinstance(v, float) else str(v)) for k, v in own.items() if v != getattr(base, k)}


def with_user_state(jobs: DataFrame, state: DataFrame | None) -> DataFrame:
    """Adds eff_status, eff_score and eff_priority: the user's, else the shared ones. ``state`` has one row for a job."""
    if state is None:
        return jobs.withColumns({"eff_status": F.coalesce("status", F.lit("new")), "eff_score": F.col("score"), "eff_priority": F.col("priority")})
    own = state.select(F.col("job_id").alias("__job"), *[F.col(c).alias(f"user_{c}") for c in state.columns if c != "job_id"])
    joined = jobs.join(own, jobs["job_id"] == own["__job"], "left").drop("__job")
    return joined.withColumns({"eff_status": F.coalesce("user_status", F.lit("new")), "eff_score": F.coalesce("user_score", "score"), "eff_priority": F.coalesce("user_priority", "priority")})


def _has(column: str, text: str) -> Column:
    return F.contains(F.lower(F.col(column)), F.lit(text.lower()))


def predicate(f: ListFilter, now: datetime) -> Column:
    """All conditions but the source, over columns of ``with_user_state``."""
    out = F.lit(True)
    if not f.include_inactive and f.view not in HISTORY_VIEWS:
        out = out & F.col("is_active")
    if f.view != "all" and not f.include_dismissed:
        out = out & F.col("eff_status").isin(VIEWS[f.view])
    if f.q:
        out = out & (_has("title", f.q) | _has("company", f.q) | F.coalesce(_has("description", f.q), F.lit(False)))
    if f.min_score is not None:
        out = out & (F.col("eff_score") >= f.min_score)
    if f.max_score is not None:
        out = out & (F.col("eff_score") <= f.max_score)
    for name, column in (("company", "company"), ("location", "location"), ("role", "title")):
        if getattr(f, name):
            out = out & _has(column, getattr(f, name))
    for name, column in (("priority", "eff_priority"), ("status", "eff_status"), ("remote_status", "remote_status")):
        if getattr(f, name):
            out = out & (F.col(column) == getattr(f, name))
    if f.skill:
        out = out & F.exists("skills", lambda s: F.lower(s) == f.skill.lower())
    if f.has_salary:
        out = out & F.col("salary_min").isNotNull()
    if f.posted_within_days is not None:
        out = out & (F.col("date_posted") >= F.lit(now - timedelta(days=f.posted_within_days)).cast("timestamp_ntz"))
    if f.deadline_within_days is not None:
        at = F.lit(now).cast("timestamp_ntz")
        out = out & F.col("deadline").between(at, F.lit(now + timedelta(days=f.deadline_within_days)).cast("timestamp_ntz"))
    return out


def apply_filters(jobs: DataFrame, f: ListFilter, now: datetime, state: DataFrame | None = None, listings: DataFrame | None = None) -> DataFrame:
    """The rows of ``jobs`` that the filter keeps, with effective columns. A source is a semi-join on the listings."""
    out = with_user_state(jobs, state).where(predicate(f, now))
    if f.source:
        out = out.join(listings.where(F.col("source") == f.source).select("job_id"), "job_id", "left_semi")
    return out


def order_of(sort: str) -> list[Column]:
    """With the id as the last key, so pages never overlap."""
    score, posted = F.desc("eff_score"), F.desc_nulls_last("date_posted")
    known = {
        "date": [posted, score], "deadline": [F.asc_nulls_last("deadline"), score], "company": [F.asc("company"), score], "discovered": [F.desc("date_discovered"), score],
        "saved": [F.desc_nulls_last("user_saved_at"), score], "applied": [F.desc_nulls_last("user_applied_at"), score], "dismissed": [F.desc_nulls_last("user_dismissed_at"), score],
    }
    return [*known.get(sort, [score, posted]), F.asc("job_id")]


def page_of(rows: DataFrame, f: ListFilter) -> DataFrame:
    return rows.orderBy(*order_of(f.sort)).offset((f.page - 1) * f.per_page).limit(f.per_page)


def pages(total: int, per_page: int) -> int:
    return max(1, -(-total // per_page))
