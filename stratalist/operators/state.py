"""Incremental state: matching, change detection, lifecycle, expiry and per-user decisions, as snapshots."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .analytics import ntz

# The fields whose change is news, the days before an unseen job expires, the statuses that never do.
MATERIAL_FIELDS = ("deadline", "salary_min", "salary_max", "requirements", "location", "sponsorship", "application_url")
EXPIRY_DAYS = 10
PROTECTED = ("saved", "applied", "assessment", "interview", "offer")
BOARD_FAILURES_SELECT, BOARD_FAILURES_PRUNE, BOARD_RECENT_DAYS = 8, 12, 3


def _words_hash(text: Column) -> Column:
    return F.sha2(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), 256)


def material_changes(fields: tuple[str, ...] = MATERIAL_FIELDS, times: tuple[str, ...] = ("deadline",), texts: tuple[str, ...] = ("requirements",)) -> Column:
    """Sorted names of the fields whose new value (n_<field>) is news against the old one (o_<field>).

    A missing new value is no news, nor is one where the old was not known; times differ beyond an hour; texts differ by words.
    """
    out = []
    for f in fields:
        old, new = F.col(f"o_{f}"), F.col(f"n_{f}")
        if f in times:
            changed = F.abs(F.timestamp_diff("SECOND", old, new)) > 3600
        elif f in texts:
            changed = (old != "") & (_words_hash(old) != _words_hash(new))
        else:
            changed = (old.cast("string") != "") & ~old.eqNullSafe(new)
        out.append(F.when(new.isNotNull() & F.coalesce(changed, F.lit(False)), F.lit(f)))
    return F.array_sort(F.array_compact(F.array(*out)))


def change_values(names: Column, fields: tuple[str, ...], texts: tuple[str, ...] = ("requirements",), most: int = 120) -> Column:
    """field: (old, new) of the changed fields, cut to ``most`` characters; of long texts only that they changed."""
    said = lambda f, side: F.lit("(changed)") if f in texts else F.substring(F.col(f"{side}_{f}").cast("string"), 1, most)
    pairs = [F.struct(F.lit(f).alias("key"), F.struct(said(f, "o").alias("old"), said(f, "n").alias("new")).alias("value")) for f in fields]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: F.array_contains(names, p["key"])))


def upsert(old: DataFrame, new: DataFrame, key: str, fill_only: list[str], replace: list[str], now: datetime, pairs: tuple[tuple[str, ...], ...] = (), material: tuple[str, ...] | None = None) -> DataFrame:
    """The next snapshot: full outer join on the key. ``fill_only`` columns take a new value only if there is one.

    material: the fields whose change is news; all if none are named. Each of ``pairs``, such as ("salary_min", "salary_max"), is replaced together where its first column has a new value, and kept together otherwise.

    Adds change (names of the fields), changes (their old and new values) and event: discovered, updated, reposted, seen or unseen. Jobs that come back count as reposted.
    """
    together = [c for pair in pairs for c in pair]
    columns = [*fill_only, *replace, *together]
    o = old.select(F.col(key).alias("o_key"), *[F.col(c).alias(f"o_{c}") for c in columns], "is_active", "first_seen", "last_seen")
    n = new.select(F.col(key).alias("n_key"), *[F.col(c).alias(f"n_{c}") for c in columns])
    both = o.join(n, F.col("o_key") == F.col("n_key"), "full_outer")
    known, seen = F.col("o_key").isNotNull(), F.col("n_key").isNotNull()
    change = F.when(known & seen, material_changes(tuple(columns if material is None else [c for c in material if c in columns]))).otherwise(F.array().cast("array<string>"))
    both = both.withColumn("change", change)
    event = F.when(~known, "discovered").when(~seen, "unseen").when(~F.col("is_active"), "reposted").when(F.size("change") > 0, "updated").otherwise("seen")
    fill = {c: F.coalesce(F.when(F.col(f"n_{c}").cast("string") != "", F.col(f"n_{c}")), F.col(f"o_{c}")) for c in fill_only}
    fill |= {c: F.when(F.col(f"n_{pair[0]}").isNotNull(), F.col(f"n_{c}")).otherwise(F.col(f"o_{c}")) for pair in pairs for c in pair}
    over = {c: F.when(seen, F.col(f"n_{c}")).otherwise(F.col(f"o_{c}")) for c in replace}
    return both.select(
        F.coalesce("n_key", "o_key").alias(key),
        *[x.alias(c) for c, x in (fill | over).items()],
        F.coalesce("is_active", F.lit(True)).alias("was_active"),
        (seen | F.coalesce("is_active", F.lit(False))).alias("is_active"),
        F.coalesce("first_seen", ntz(now)).alias("first_seen"),
        F.when(seen, ntz(now)).otherwise(F.col("last_seen")).alias("last_seen"),
        "change",
        F.when(F.size("change") > 0, change_values(F.col("change"), tuple(columns if material is None else [c for c in material if c in columns]))).alias("changes"),
        event.alias("event"),
    )


def freshness_of(event: Column, old: Column, first_seen: Column, now: datetime) -> Column:
    """new, updated or reposted; new and updated grow old after a full day, but only when the run saw the job unchanged."""
    aged = (event == "seen") & (F.floor(F.timestamp_diff("SECOND", first_seen, ntz(now)) / 86400) >= 1)
    return F.when(event == "reposted", "reposted").when(event == "updated", "updated").when(event == "discovered", "new").when(old.isin("new", "updated") & aged, "old").otherwise(old)


def expire_stale(jobs: DataFrame, now: datetime, days: int = EXPIRY_DAYS, protected: tuple[str, ...] = PROTECTED) -> DataFrame:
    """Adds expired, and clears is_active of active jobs that no run has seen for ``days`` and no status protects."""
    due = F.col("is_active") & (F.col("last_seen") < ntz(now - timedelta(days=days))) & ~F.coalesce(F.col("status").isin(list(protected)), F.lit(False))
    return jobs.withColumn("expired", F.coalesce(due, F.lit(False))).withColumn("is_active", F.col("is_active") & ~F.col("expired"))


def stamp_first(state: DataFrame, status: str, now: datetime) -> DataFrame:
    """Sets the status; a status' time is stamped once; going back to new clears the dismissal."""
    out = state.withColumn("status", F.lit(status))
    for name in ("saved", "applied", "dismissed"):
        at = F.col(f"{name}_at")
        out = out.withColumn(f"{name}_at", F.coalesce(at, ntz(now)) if name == status else F.when(F.lit(name == "dismissed" and status == "new"), None).otherwise(at))
    return out


def bulk_set_status(state: DataFrame, jobs: DataFrame, ids: DataFrame, status: str) -> DataFrame:
    """State after a bulk action over ids that exist; changed tells which rows it really changed."""
    real = ids.select("job_id").distinct().join(jobs.select("job_id"), "job_id", "left_semi").withColumn("picked", F.lit(True))
    both = state.select("job_id", "status").join(real, "job_id", "full_outer")
    picked = F.coalesce("picked", F.lit(False))
    return both.select("job_id", F.when(picked, status).otherwise(F.col("status")).alias("status"), (picked & ~F.coalesce(F.col("status") == status, F.lit(False))).alias("changed"))


def find_existing(new: DataFrame, keys: list[tuple[str, DataFrame]], by: str) -> DataFrame:
    """``new`` with job_id and matched_by of the first key, in order of precedence, under which a job is known.

    keys: (column of ``new``, frame of that column and job_id), each with unique keys.
    """
    out = new
    for i, (column, known) in enumerate(keys):
        side = known.select(F.col(column).alias(f"__k{i}"), F.col("job_id").alias(f"__j{i}"))
        out = out.join(side, F.col(column) == F.col(f"__k{i}"), "left").drop(f"__k{i}")
    hits = [f"__j{i}" for i in range(len(keys))]
    named = F.coalesce(*[F.when(F.col(h).isNotNull(), column) for h, (column, _) in zip(hits, keys, strict=True)])
    return out.select(by, F.coalesce(*hits).alias("job_id"), named.alias("matched_by"))


def board_health(boards: DataFrame, results: DataFrame, now: datetime) -> DataFrame:
    """Failure counters up or reset, last success, and boards with too many failures disabled."""
    out = boards.join(results.select("board", "ok", "found"), "board", "left")
    failures = F.when(F.col("ok").isNull(), F.col("failures")).when(F.col("ok"), 0).otherwise(F.col("failures") + 1)
    out = out.withColumns({"failures": failures, "last_ok": F.when(F.col("ok"), ntz(now)).otherwise(F.col("last_ok"))})
    return out.withColumn("enabled", F.col("enabled") & (F.col("failures") < BOARD_FAILURES_PRUNE)).drop("ok", "found")


def board_rotation(boards: DataFrame, limit: int, now: datetime) -> DataFrame:
    """The boards to crawl next: fewest failures, never crawled, longest ago.

    Of the first ``limit`` in that order, a recently crawled one is taken only while less than half the limit is. As a kept row needs fewer
    kept before it, and others are always kept, running counts over these ``limit`` rows tell it without a loop.
    """
    from pyspark.sql import Window

    picked = boards.where(F.col("enabled") & (F.col("failures") < BOARD_FAILURES_SELECT)).orderBy("failures", F.col("last_crawled").isNotNull(), "last_crawled", "board").limit(limit)
    order = Window.partitionBy().orderBy("failures", F.col("last_crawled").isNotNull(), "last_crawled", "board")  # at most limit rows
    recent = F.coalesce(F.col("last_crawled") >= ntz(now - timedelta(days=BOARD_RECENT_DAYS)), F.lit(False))
    rows = picked.withColumns({"recent": recent, "position": F.row_number().over(order)})
    # Rows are taken one after another until half the limit is reached; from then on only those not recent.
    return rows.where((F.col("position") <= limit // 2) | ~F.col("recent")).select("board", "failures", "last_crawled", "recent")
