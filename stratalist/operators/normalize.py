"""Raw rows to the typed listing: one select that composes text, URL and fact functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import facts, urls
from ..functions.skills import extract_skills
from ..functions.html import strip_html
from ..functions.text import discriminators, fingerprint, normalize_text, sha256_of, shingles, slugify_company, title_core

#: How sources declare where the work is done, and how much of a text pay, terms and the content hash look at.
DECLARED_REMOTE = {"remote": "remote", "hybrid": "hybrid", "onsite": "onsite", "on-site": "onsite", "on_site": "onsite", "in office": "onsite"}
PAY_CHARS, TERM_CHARS, HASH_CHARS = 4000, 3000, 6000
#: What a raw row has; a source leaves out what it doesn't know.
TEXTS = ["source", "source_kind", "source_job_id", "company", "title", "location", "description", "requirements", "responsibilities", "preferred", "remote_status", "employment_type", "url", "apply_url", "company_url", "requisition_id"]


def _filled(raw: DataFrame) -> DataFrame:
    """The raw rows with every text column, null where the source has none, and locations, date_posted and deadline."""
    rest = {"locations": "array<string>", "date_posted": "timestamp_ntz", "deadline": "timestamp_ntz"}
    missing = {c: F.lit(None).cast("string") for c in TEXTS if c not in raw.columns} | {c: F.lit(None).cast(t) for c, t in rest.items() if c not in raw.columns}
    return raw.withColumns(missing) if missing else raw


def _usable() -> Column:
    return F.coalesce((F.trim("company") != "") & (F.trim("title") != ""), F.lit(False))


def normalize_listings(raw: DataFrame, reference: Column) -> DataFrame:
    """The listings of rows that have a company and a title. ``reference`` is the day that stated dates are read from."""
    rows = _filled(raw).where(_usable()).withColumns({"company": F.trim("company"), "title": F.trim("title")})
    rows = rows.withColumns({c: strip_html(F.col(c)) for c in ("description", "requirements", "responsibilities", "preferred")})
    blob = (F.col("requirements") == "") & (F.col("responsibilities") == "") & (F.col("preferred") == "")
    rows = rows.withColumn("cut", F.when(blob, facts.split_sections(F.col("description"))))
    rows = rows.withColumns({c: F.coalesce(F.col("cut")[c], F.col(c)) for c in ("requirements", "responsibilities", "preferred")}).drop("cut")
    parts = F.filter(F.array("description", "requirements", "responsibilities", "preferred"), lambda p: p != "")
    first = F.coalesce(F.nullif("location", F.lit("")), F.get("locations", F.lit(0)))
    rows = rows.withColumns({"full_text": F.array_join(parts, "\n"), "location_raw": first})
    rows = rows.withColumns({
        "all_locations": F.array_distinct(F.filter(F.concat(F.array("location_raw"), F.coalesce("locations", F.array().cast("array<string>"))), lambda x: F.coalesce(x != "", F.lit(False)))),
        "place": facts.parse_location(F.col("location_raw")), "core": title_core(F.col("title")), "company_slug": slugify_company(F.col("company")),
        "employment": facts.employment_type(F.col("title"), F.col("full_text"), F.col("employment_type")), "pay": facts.salary(F.substring("full_text", 1, PAY_CHARS)),
        "identity": urls.ats_key(F.coalesce(*[urls.ats_identity(F.col(c)) for c in ("apply_url", "url", "company_url")])),
        "canonical_url": urls.canonicalize_url(F.coalesce(F.nullif("url", F.lit("")), F.col("apply_url"))),
    })
    declared = F.try_element_at(F.create_map(*[F.lit(x) for kv in DECLARED_REMOTE.items() for x in kv]), F.lower(F.trim("remote_status")))
    inferred = facts.remote_status(F.concat_ws(" ", "location_raw", "title"))
    remote = F.coalesce(declared, F.when(inferred != "unknown", inferred), F.when(F.col("place.remote"), "remote"), F.lit("unknown"))
    stated = facts.deadline(F.col("full_text"), reference)
    text_or_null = {c: F.nullif(c, F.lit("")).alias(c) for c in ("description", "requirements", "responsibilities", "preferred")}
    return rows.select(
        "source", F.coalesce("source_kind", F.lit("unknown")).alias("source_kind"), "source_job_id", "canonical_url", F.sha1("canonical_url").alias("canonical_url_hash"), F.col("identity").alias("ats_identity"),
        fingerprint(F.col("company_slug"), F.col("core"), F.col("place.key"), F.col("employment")).alias("fingerprint"),
        F.substring(sha256_of(F.col("core"), F.col("company_slug"), F.col("place.key"), F.substring("full_text", 1, HASH_CHARS)), 1, 32).alias("content_hash"),
        "company", "company_slug", "title", F.col("core").alias("title_core"),
        discriminators(normalize_text(F.concat_ws(" ", "title", F.coalesce(F.nullif("requirements", F.lit("")), F.col("description"))))).alias("discriminators"),
        "location_raw", F.col("all_locations").alias("locations"), F.col("place.city").alias("city"), F.col("place.state").alias("state"), F.col("place.country").alias("country"), F.col("place.key").alias("location_key"),
        F.col("place").alias("location"), remote.alias("remote_status"), F.col("employment").alias("employment_type"), *text_or_null.values(),
        shingles(normalize_text(F.coalesce(F.nullif("full_text", F.lit("")), F.col("title")))).alias("shingles"),
        F.col("pay.min").alias("salary_min"), F.col("pay.max").alias("salary_max"), F.col("pay.currency").alias("salary_currency"), F.col("pay.period").alias("salary_period"),
        "url", F.coalesce(F.nullif("apply_url", F.lit("")), F.col("url")).alias("apply_url"), "company_url", "date_posted",
        F.coalesce("deadline", stated).alias("deadline"), (F.col("deadline").isNotNull() | stated.isNotNull()).alias("deadline_is_explicit"),
        F.coalesce(F.nullif("requisition_id", F.lit("")), F.element_at(F.split("identity", ":"), -1)).alias("requisition_id"),
        facts.terms(F.concat_ws(" ", "title", F.substring("full_text", 1, TERM_CHARS))).alias("terms"), extract_skills(F.concat_ws(" ", "title", "full_text")).alias("skills"),
        facts.degrees(F.col("full_text")).alias("degrees"), facts.experience_years(F.col("full_text")).alias("years"), facts.sponsorship(F.col("full_text")).alias("sponsorship"),
    )


#: Facts that a stored job keeps under its own name, and those that it names otherwise.
STORED_AS = {
    "company": "company_name", "url": "posting_url", "apply_url": "application_url", "date_updated": "date_updated_source", "degrees": "degree_requirements", "years": "experience_required_years", "preferred": "preferred_qualifications",
}
SAME_NAME = (
    "ats_identity title location_raw city state country description requirements responsibilities salary_min salary_max salary_currency salary_period salary_raw date_posted deadline requisition_id sponsorship_evidence"
).split()


def scoreable(jobs: DataFrame) -> DataFrame:
    """Stored jobs as listings that can be scored again, without what only deduplication needs: unknown kinds are ``unknown``, missing lists empty, and
    slug and discriminators are made anew from company, title and requirements (else description). Facts that ``jobs`` has no column for are left out."""
    own = set(jobs.columns)
    said = lambda c: F.col(c) if c in own else F.lit(None)
    body = F.coalesce(F.nullif(said("requirements").cast("string"), F.lit("")), said("description").cast("string"), F.lit(""))
    known = lambda c: F.coalesce(F.nullif(said(c).cast("string"), F.lit("")), F.lit("unknown")).alias(c)
    lists = {"locations": "locations", "terms": "terms", "skills": "skills"}
    return jobs.select(
        F.lit("stored").alias("source"), F.lit("unknown").alias("source_kind"), F.col("job_id").cast("string").alias("source_job_id"), slugify_company(F.col(STORED_AS["company"])).alias("company_slug"),
        F.coalesce(F.nullif(said("title_core").cast("string"), F.lit("")), F.col("title")).alias("title_core"), discriminators(normalize_text(F.concat_ws(" ", F.col("title"), body))).alias("discriminators"),
        *[F.coalesce(said(c).cast("string"), F.lit("")).alias(c) for c in ("fingerprint", "content_hash")], *[known(c) for c in ("remote_status", "employment_type", "sponsorship")],
        *[F.coalesce(said(c).cast("array<string>"), F.array().cast("array<string>")).alias(n) for n, c in lists.items()], F.coalesce(said("deadline_is_explicit").cast("boolean"), F.lit(False)).alias("deadline_is_explicit"),
        *[F.col(c) for c in SAME_NAME if c in own], *[F.col(c).alias(n) for n, c in STORED_AS.items() if c in own],
    )


def normalize_counts(raw: DataFrame) -> DataFrame:
    """How many rows become listings, and how many are dropped for want of a company or a title."""
    return _filled(raw).agg(F.count_if(_usable()).alias("normalized"), F.count_if(~_usable()).alias("dropped"))
