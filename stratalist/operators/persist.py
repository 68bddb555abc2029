"""One run written down: clusters become jobs, new or known, with their listings, events and a count of what happened."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from . import records, state

# Fields whose change is news, fields that a run fills but never empties, and fields that it replaces.
MATERIAL = ("deadline", "salary_min", "salary_max", "requirements", "location_raw", "sponsorship", "application_url")
FILLED = "location_raw description requirements responsibilities preferred_qualifications experience_required_years requisition_id ats_identity date_posted date_updated degree_requirements deadline".split()
REPLACED = "title title_core company company_slug fingerprint content_hash locations city state country remote_status employment_type terms skills discriminators sponsorship sponsorship_evidence application_url posting_url score priority".split()
PAY = ("salary_min", "salary_max", "salary_currency", "salary_period")


@dataclass(frozen=True)
class Run:
    jobs: DataFrame  # the next snapshot, with change, changes, event and freshness
    listings: DataFrame
    events: DataFrame
    outcome: DataFrame  # one row


def persist_run(heads: DataFrame, members: DataFrame, jobs: DataFrame, listings: DataFrame, companies: DataFrame, now: datetime, *, min_score: float = 0.0) -> Run:
    """Writes a run's clusters over the stored state.

    heads: cluster, fingerprint, ``records.GUARDED``, canonical_url, excluded, score, and the fields of a job as far as they are known. members: as for
    ``records.lookup_identities``, with source_key. jobs: job_id, the same fields, is_active, freshness, first_seen and last_seen. listings: job_id, source_key,
    ats_identity, url_hash, first_seen and last_seen.

    Clusters that are excluded, score less than ``min_score`` or have no url are left out, with their listings. Clusters that find the same stored
    job become one, the last of them speaking for it. A new job's id is a hash of its canonical identity. A deadline counts only if it was stated (``deadline_is_explicit``).
    """
    reachable = F.coalesce(F.nullif("application_url", F.lit("")), F.nullif("posting_url", F.lit(""))).isNotNull()
    kept = materialize(heads.where(~F.coalesce("excluded", F.lit(False)) & (F.col("score") >= min_score) & reachable), "kept")
    own = members.join(kept.select("cluster"), "cluster", "left_semi")
    found = records.lookup_identities(own, kept, jobs, listings, companies)
    identity = records.canonical_id(F.coalesce("ats_identity", F.lit("")), F.coalesce("canonical_url", F.lit("")), F.col("company_slug"), F.col("fingerprint"))
    made = F.xxhash64(identity).bitwiseAND((1 << 63) - 1)
    rows = kept.join(found.select("cluster", F.col("job_id").alias("known_id")), "cluster").withColumn("job_id", F.coalesce("known_id", made))
    rows = materialize(rows, "matched")
    if "deadline" in rows.columns and "deadline_is_explicit" in rows.columns:
        rows = rows.withColumn("deadline", F.when(F.col("deadline_is_explicit"), F.col("deadline")))
    both = set(rows.columns) & set(jobs.columns)
    fill, replace, pay = ([c for c in of if c in both] for of in (FILLED, REPLACED, PAY))
    fields = [*fill, *replace, *pay]
    new = rows.groupBy("job_id").agg(F.max_by(F.struct(*fields), "cluster").alias("j")).select("job_id", "j.*")
    snapshot = state.upsert(jobs, new, "job_id", fill, replace, now, (tuple(pay),) if pay else (), MATERIAL)
    before = jobs.select(F.col("job_id").alias("old_id"), F.col("freshness").alias("old_freshness"))
    snapshot = snapshot.join(before, F.col("job_id") == F.col("old_id"), "left").drop("old_id")
    snapshot = snapshot.withColumn("freshness", state.freshness_of(F.col("event"), F.col("old_freshness"), F.col("first_seen"), now)).drop("old_freshness")
    snapshot = materialize(snapshot, "jobs")
    identities = F.struct(F.col("ats_identity"), F.col("url_hash"))
    seen = own.where("source_key <> ''").join(rows.select("cluster", "job_id"), "cluster").groupBy("source_key").agg(F.max_by("job_id", "cluster").alias("job_id"), F.max_by(identities, "cluster").alias("i"))
    pointed = records.repoint_listings(listings, seen, ["source_key"], now)
    known = listings.select("source_key", F.struct("ats_identity", "url_hash").alias("o"))
    pointed = pointed.join(seen.select("source_key", "i"), "source_key", "left").join(known, "source_key", "left")
    pointed = pointed.withColumn("both", F.coalesce("i", "o")).select("source_key", "job_id", "both.ats_identity", "both.url_hash", "first_seen", "last_seen", "seen_now", "moved")
    events = records.job_events(snapshot.withColumn("expired", F.lit(False)), "job_id", now)
    happened = {"discovered": "new_jobs", "updated": "updated_jobs", "reposted": "reposted_jobs", "seen": "unchanged_jobs"}
    counts = snapshot.agg(*[F.count_if(F.col("event") == e).alias(n) for e, n in happened.items()]).withColumn("one", F.lit(1))
    left = heads.agg(F.count("*").alias("clusters")).withColumn("one", F.lit(1)).join(kept.agg(F.count("*").alias("kept")).withColumn("one", F.lit(1)), "one")
    outcome = counts.join(left, "one").select(*happened.values(), (F.col("clusters") - F.col("kept")).alias("left_out"))
    return Run(snapshot, pointed, events, outcome)
