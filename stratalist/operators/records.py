"""What runs and users leave behind: listings and events, decisions, notes, scores, facts, reports and back-fills.

Each function takes snapshots and returns the next one (or a report); nothing is updated in place.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import words_array
from .analytics import ntz
from .resolve import EXCLUSIVE_AXES

# When a monitored company is due again, the shortest body worth reading, the least affinity, and statuses that open a card.
MONITOR_HOURS, MIN_BODY_CHARS, MIN_AFFINITY = 12, 40, 0.35
CARD_STATUSES = ("applied", "assessment", "interview", "offer", "rejected")


def repoint_listings(old: DataFrame, seen: DataFrame, keys: list[str], now: datetime) -> DataFrame:
    """Listings (keys, job_id, first_seen, last_seen) after a run that saw (keys, job_id): a listing belongs to the job that it was last seen with."""
    o = old.select(*keys, F.col("job_id").alias("old_job"), "first_seen", "last_seen")
    both = o.join(seen.select(*keys, F.col("job_id").alias("new_job")), keys, "full_outer")
    now_seen = F.col("new_job").isNotNull()
    return both.select(
        *keys, F.coalesce("new_job", "old_job").alias("job_id"), F.coalesce("first_seen", ntz(now)).alias("first_seen"),
        F.when(now_seen, ntz(now)).otherwise(F.col("last_seen")).alias("last_seen"), now_seen.alias("seen_now"),
        F.coalesce(F.col("old_job") != F.col("new_job"), F.lit(False)).alias("moved"),
    )


def job_events(snapshot: DataFrame, key: str, now: datetime) -> DataFrame:
    """The events that a run appends: discovered, updated (with what changed), reposted, expired. snapshot: key, event, change, expired."""
    kinds = F.array_compact(F.array(F.when(F.col("event").isin("discovered", "updated", "reposted"), F.col("event")), F.when(F.col("expired"), F.lit("expired"))))
    rows = snapshot.select(key, "change", F.explode(kinds).alias("event_type"))
    return rows.select(key, "event_type", F.when(F.col("event_type") == "updated", F.array_join("change", ",")).alias("detail"), ntz(now).alias("created_at"))


def stored_conflict(old: str, new: str, axes: list[list[str]] = EXCLUSIVE_AXES) -> Column:
    """Whether a stored row is another opening than the incoming one: requisition, identity or an axis of the title. Columns carry the prefixes."""
    both = lambda c: (F.coalesce(F.col(f"{old}{c}"), F.lit("")) != "") & (F.coalesce(F.col(f"{new}{c}"), F.lit("")) != "")
    out = both("requisition_id") & (F.lower(F.trim(f"{old}requisition_id")) != F.lower(F.trim(f"{new}requisition_id")))
    out = out | (both("ats_identity") & (F.col(f"{old}ats_identity") != F.col(f"{new}ats_identity")))
    for axis in axes:
        left, right = (F.array_sort(F.array_intersect(f"{x}discriminators", words_array(axis))) for x in (old, new))
        out = out | ((F.size(left) > 0) & (F.size(right) > 0) & (left != right))
    return F.coalesce(out, F.lit(False))


def guarded_match(new: DataFrame, known: DataFrame, by: str, key: str, guarded: list[str]) -> DataFrame:
    """``by`` and the lowest job_id of known rows under the same key that do not conflict. Both have the guarded columns.

    Combined by what the guard looks at before the join, so a key that many stored rows share costs its distinct guards.
    """
    known = known.where(F.col(key).isNotNull()).groupBy(key, *guarded).agg(F.min("job_id").alias("job_id"))
    o = known.select(F.col(key), F.col("job_id"), *[F.col(c).alias(f"o_{c}") for c in guarded])
    n = new.select(by, key, *[F.col(c).alias(f"n_{c}") for c in guarded])
    return n.join(o, key).where(~stored_conflict("o_", "n_")).groupBy(by).agg(F.min("job_id").alias("job_id"))


#: Kinds of identities in the order of what they prove; of a member's own, the stored job's goes before its listing's.
IDENTITIES = ["source_key", "job_ats", "listing_ats", "url_hash", "fingerprint"]
GUARDED = ["company_slug", "requisition_id", "ats_identity", "discriminators"]


def lookup_identities(members: DataFrame, heads: DataFrame, jobs: DataFrame, listings: DataFrame, companies: DataFrame) -> DataFrame:
    """cluster, job_id, matched_by and company_id: the stored job and company of each cluster, null where there is none.

    members: cluster, member (its place), source_key, ats_identity, url_hash. heads: cluster, fingerprint and ``GUARDED``. jobs: job_id, fingerprint and
    ``GUARDED``. listings: job_id, source_key, ats_identity, url_hash. companies: company_id, company_slug. All identities of all kinds are
    rows (kind, key) of one table on either side, so one join finds them, however many kinds there are; stored rows are combined by
    key first. Among the hits the order is: source keys, then ATS identities, then urls, each by member; last a fingerprint whose guard finds no conflict.
    """
    guard = F.struct(*GUARDED)
    none = F.lit(None).cast(heads.select(guard.alias("g")).schema["g"].dataType)

    def rows(frame: DataFrame, ident: str, name: str, kinds: list[tuple[str, str, Column, Column]]) -> DataFrame:
        each = [F.struct(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"), place.alias("place"), g.alias("guard")) for kind, key, place, g in kinds]
        return frame.select(F.col(ident).cast("long").alias(name), F.explode(F.array(*each)).alias("i")).select(name, "i.*").where("key <> ''")

    place = lambda step, member=F.lit(0), sub=0: F.struct(F.lit(step).alias("step"), member.cast("long").alias("member"), F.lit(sub).alias("sub"))
    m = F.col("member")
    probes = rows(members, "cluster", "cluster", [("source_key", "source_key", place(0, m), none), ("job_ats", "ats_identity", place(1, m), none), ("listing_ats", "ats_identity", place(1, m, 1), none), ("url_hash", "url_hash", place(2, m), none)])
    probes = probes.unionByName(rows(heads, "cluster", "cluster", [("fingerprint", "fingerprint", place(3), guard), ("company", "company_slug", place(4), none)]))
    known = rows(jobs, "job_id", "id", [("job_ats", "ats_identity", place(0), none), ("fingerprint", "fingerprint", place(0), guard)])
    known = known.unionByName(rows(listings, "job_id", "id", [("source_key", "source_key", place(0), none), ("listing_ats", "ats_identity", place(0), none), ("url_hash", "url_hash", place(0), none)]))
    known = known.unionByName(rows(companies, "company_id", "id", [("company", "company_slug", place(0), none)]))
    known = known.groupBy("kind", "key", F.col("guard").alias("stored")).agg(F.min("id").alias("id"))
    # Two rows under one fingerprint are one opening only if the company is the same and nothing that the guard looks at differs.
    hits = probes.join(known, ["kind", "key"])
    flat = hits.select("*", *[F.col(f"stored.{c}").alias(f"o_{c}") for c in GUARDED], *[F.col(f"guard.{c}").alias(f"n_{c}") for c in GUARDED])
    fits = (F.col("kind") != "fingerprint") | ((F.col("o_company_slug") == F.col("n_company_slug")) & ~stored_conflict("o_", "n_"))
    best = F.min(F.when(F.col("kind") != "company", F.struct("place", "id", "kind"))).alias("best")
    found = flat.where(fits).groupBy("cluster").agg(best, F.min(F.when(F.col("kind") == "company", F.col("id"))).alias("company_id"))
    return heads.select("cluster").join(found, "cluster", "left").select("cluster", F.col("best.id").alias("job_id"), F.col("best.kind").alias("matched_by"), "company_id")


def canonical_id(ats: Column, url: Column, slug: Column, fingerprint: Column) -> Column:
    """24 hexadecimal digits of the strongest identity there is."""
    named = F.coalesce(F.nullif(ats, F.lit("")), F.nullif(url, F.lit("")), F.concat(slug, F.lit("|"), fingerprint))
    return F.substring(F.sha2(named, 256), 1, 24)


def stale_monitored(companies: DataFrame, now: datetime) -> DataFrame:
    due = F.col("last_checked").isNull() | (F.col("last_checked") < ntz(now - timedelta(hours=MONITOR_HOURS)))
    return companies.where(F.col("monitored") & due)


def run_report(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """Outcomes (status, found, new) of the sources of each run, rolled up: success, partial or failed."""
    ok, bad = F.col("status").isin("ok", "degraded"), F.col("status") == "failed"
    rows = outcomes.groupBy(*by).agg(F.count_if(ok).alias("succeeded"), F.count_if(bad).alias("failed"), F.sum("found").alias("found"), F.sum("new").alias("new"))
    return rows.withColumn("status", F.when(F.col("failed") == 0, "success").when(F.col("succeeded") > 0, "partial").otherwise("failed"))


def recent(rows: DataFrame, at: str, key: str, n: int) -> DataFrame:
    """The latest rows, newest first."""
    return rows.orderBy(F.desc(at), F.desc(key)).limit(n)


def mark(state: DataFrame, touched: DataFrame, column: str, now: datetime, *, keys: list[str], once: bool) -> DataFrame:
    """State with a time stamped on the touched rows, which are added where there are none: once, or anew each time."""
    both = state.join(touched.select(*keys).distinct().withColumn("touched", F.lit(True)), keys, "full_outer")
    new = F.when(F.col("touched"), F.coalesce(F.col(column), ntz(now)) if once else ntz(now)).otherwise(F.col(column))
    return both.withColumns({column: new, "status": F.coalesce("status", F.lit("new"))}).drop("touched")


def set_status(state: DataFrame, jobs: DataFrame, decided: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Decisions (keys, status, at), the last of each counting: the new state, and the cards of applications.

    A card opens with the first status of an application and freezes the job's shared score of then; later ones only move its stage.
    """
    last = decided.groupBy(*keys).agg(F.max_by("status", F.struct("at", "status")).alias("decided"), F.max("at").alias("at"))
    both = state.join(last, keys, "full_outer")
    changed = F.coalesce(F.col("decided") != F.coalesce("status", F.lit("new")), F.lit(False))
    after = both.withColumns({"changed": changed, "status": F.coalesce("decided", "status")})
    card = decided.where(F.col("status").isin(list(CARD_STATUSES)))
    card = card.groupBy(*keys).agg(F.min("at").alias("opened_at"), F.max_by("status", F.struct("at", "status")).alias("stage"), F.count("*").alias("moves"))
    cards = card.join(jobs.select("job_id", F.col("score").alias("score_at_apply")), "job_id")
    return after.drop("decided", "at"), cards


def add_notes(notes: DataFrame, added: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the number of notes and the latest one that isn't blank."""
    rows = notes.unionByName(added).where(F.trim("note") != "")
    return rows.groupBy(*keys).agg(F.count("*").alias("notes"), F.max_by("note", F.struct("at", "note")).alias("latest"))


def write_scores(state: DataFrame, scores: DataFrame, keys: list[str], now: datetime) -> DataFrame:
    """State with new scores and priorities. A status is never touched; rows that had none are new."""
    both = state.join(scores.select(*keys, F.col("score").alias("n_score"), F.col("priority").alias("n_priority")), keys, "full_outer")
    scored = F.col("n_score").isNotNull()
    return both.withColumns({
        "status": F.coalesce("status", F.lit("new")), "score": F.coalesce("n_score", "score"), "priority": F.coalesce("n_priority", "priority"), "scored_at": F.when(scored, ntz(now)),
    }).drop("n_score", "n_priority")


def fallback_view(jobs: DataFrame, state: DataFrame, fields: list[str]) -> DataFrame:
    """Every job as a user sees it: each field the user's own, else the shared one; awaiting_answer after an application without a reply."""
    own = state.select("job_id", F.col("status").alias("own_status"), *[F.col(f).alias(f"own_{f}") for f in fields])
    rows = jobs.join(own, "job_id", "left")
    seen = rows.withColumns({f: F.coalesce(f"own_{f}", f) for f in fields}).withColumn("status", F.coalesce("own_status", F.lit("new")))
    return seen.withColumn("awaiting_answer", F.col("status").isin("applied", "assessment")).select("job_id", "status", *fields, "awaiting_answer")


def needs_enrichment() -> Column:
    """A readable body that was never read, or whose content has changed since. Columns: description, requirements, enriched_at, content_hash, enrichment_hash."""
    body = F.trim(F.concat(F.coalesce("description", F.lit("")), F.coalesce("requirements", F.lit(""))))
    moved = (F.coalesce("content_hash", F.lit("")) != "") & ~F.col("enrichment_hash").eqNullSafe(F.col("content_hash"))
    return (F.length(body) >= MIN_BODY_CHARS) & (F.col("enriched_at").isNull() | moved)


def enrichment_candidates(jobs: DataFrame, affinity: Column, limit: int) -> DataFrame:
    """The rows worth reading, best affinity first. The affinity, not the stored score: that is low because they are unread."""
    rows = jobs.where(F.col("is_active") & needs_enrichment()).withColumn("affinity", affinity).where(F.col("affinity") >= MIN_AFFINITY)
    return rows.orderBy(F.desc("affinity"), "job_id").limit(limit)


def apply_facts(jobs: DataFrame, facts: DataFrame, model: str, now: datetime) -> DataFrame:
    """Jobs (job_id, skills, terms, years, content_hash, ...) with facts (job_id, f_skills, f_terms, f_years) read: new skills join the old
    ones, the rest fills only what was unknown. added counts the new skills; jobs that were not read stay as they are."""
    rows = jobs.join(facts, "job_id", "left")
    known = F.transform(F.coalesce("skills", F.array().cast("array<string>")), lambda s: F.lower(F.trim(s)))
    added = F.filter(F.coalesce("f_skills", F.array().cast("array<string>")), lambda s: (s != "") & ~F.array_contains(known, s))
    read = F.col("f_skills").isNotNull()
    return rows.withColumn("fresh", added).select(
        "job_id", F.concat(F.coalesce("skills", F.array().cast("array<string>")), "fresh").alias("skills"), F.size("fresh").alias("added"),
        F.when(F.size(F.coalesce("terms", F.array().cast("array<string>"))) > 0, F.col("terms")).otherwise(F.coalesce("f_terms", "terms")).alias("terms"),
        F.coalesce("years", "f_years").alias("years"), F.when(read, F.lit(model)).alias("enrichment_model"), F.when(read, F.col("content_hash")).alias("enrichment_hash"),
        F.when(read, ntz(now)).alias("enriched_at"),
    )


def backfill_decisions(jobs: DataFrame, state: DataFrame, user: int) -> DataFrame:
    """State with the decisions that were kept on the jobs, for one user: only of jobs that were touched and have no row of that user yet."""
    touched = jobs.where((F.col("status") != "new") | F.col("opened_at").isNotNull())
    own = state.where(F.col("user_id") == user).select("job_id")
    new = touched.join(own, "job_id", "left_anti").select(F.lit(user).cast("long").alias("user_id"), "job_id", "status", "opened_at")
    return state.unionByName(new)


def backfill_score(state: DataFrame, jobs: DataFrame, user: int) -> DataFrame:
    """One user's rows without a score take the shared one; no row is added."""
    shared = jobs.select("job_id", F.col("score").alias("shared"))
    rows = state.join(shared, "job_id", "left")
    return rows.withColumn("score", F.when(F.col("user_id") == user, F.coalesce("score", "shared")).otherwise(F.col("score"))).drop("shared")


def backfill_dismissed(state: DataFrame) -> DataFrame:
    """Dismissed rows without a time take that of their last update."""
    due = (F.col("status") == "dismissed") & F.col("dismissed_at").isNull()
    return state.withColumn("dismissed_at", F.when(due, F.col("updated_at")).otherwise(F.col("dismissed_at")))


def dispatch(state: DataFrame, selected: DataFrame, sent: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame]:
    """After digests (user_id, job_id, rank) were sent to users (user_id, ok): the items that are kept, and the state with notified_at.

    A failed or empty digest leaves no trace, so its jobs come again.
    """
    items = selected.join(sent.where("ok").select("user_id"), "user_id", "left_semi")
    return items, mark(state, items, "notified_at", now, keys=["user_id", "job_id"], once=False)


def render_digest(items: DataFrame, by: str, order: str) -> DataFrame:
    """The text of each digest: a heading and a line for each of its few items, in order. items: by, order, title, company, score."""
    line = F.format_string("%d. %s - %s (%.1f)", F.col(order), "title", "company", "score")
    rows = items.groupBy(by).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), line.alias("line")))).alias("lines"))
    heading = F.concat(F.col("n").cast("string"), F.when(F.col("n") == 1, " new job").otherwise(" new jobs"))
    return rows.select(by, F.concat_ws("\n", heading, F.transform("lines", lambda x: x["line"])).alias("body"))


def assistant(jobs: DataFrame, own_skills: list[str], projects: list[str]) -> DataFrame:
    """For each job (job_id, skills): what to emphasise, the projects that name a skill, and points to talk about; all from what is given."""
    overlap = F.array_intersect("skills", words_array(own_skills))
    emphasise = F.when(F.size(overlap) > 0, F.slice(overlap, 1, 6)).otherwise(F.slice("skills", 1, 5))
    named = F.filter(words_array(projects), lambda p: F.exists("skills", lambda s: F.contains(F.lower(p), F.lower(s))))
    rows = jobs.withColumn("emphasise", emphasise)
    points = F.transform(F.slice("emphasise", 1, 4), lambda s: F.concat(F.lit("Your hands-on experience with "), s))
    topics = F.slice(F.array_sort(F.array_distinct("skills")), 1, 10)
    return rows.select("job_id", "emphasise", F.slice(named, 1, 5).alias("projects"), points.alias("talking_points"), topics.alias("interview_topics"))


def board_yield(rows: DataFrame, boards: DataFrame) -> DataFrame:
    """Rows that each board gave, and its state: speculative boards that gave none are no failure."""
    found = rows.groupBy("board").agg(F.count("*").alias("found"))
    both = boards.join(found, "board", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return both.withColumn("state", F.when(F.col("found") > 0, "ok").when(F.col("speculative"), "speculative").otherwise("empty"))


def matching_terms(rows: DataFrame, text: Column, terms: list[str]) -> DataFrame:
    """Rows of a source that cannot search by itself: those with a word of the terms."""
    words = F.split(F.lower(text), "[^a-z0-9+#]+")
    return rows.where(F.arrays_overlap(words, words_array([t.lower() for t in terms])))
