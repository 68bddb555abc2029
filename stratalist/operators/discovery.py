"""The registry of companies and boards, resumes against jobs, and reports of runs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_ascii, words_array
from .analytics import ntz

# Where a company's board is looked for, and what a resume's kind in the title adds.
SEED_PROVIDERS = ["greenhouse", "lever", "ashby"]
KIND_BONUS, ALTERNATIVES = 5.0, 3


def harvest_boards(rows: DataFrame) -> DataFrame:
    """provider and board with the first company and source, the first known extra, and the number of rows. rows: provider, board, company, source, extra, at."""
    known = F.when(F.coalesce(F.col("extra"), F.lit("")) != "", F.col("at"))
    return rows.groupBy("provider", "board").agg(F.min_by("company", "at").alias("company"), F.min_by("source", "at").alias("source"), F.min_by("extra", known).alias("extra"), F.count("*").alias("n"))


def register(known: DataFrame, found: DataFrame, keys: list[str], fill: list[str], now: datetime) -> DataFrame:
    """The registry after a run: rows that are new are added, empty facts of known ones are filled, nothing is overwritten."""
    new = found.select(*keys, *[F.col(c).alias(f"__{c}") for c in fill], F.lit(True).alias("__found"))
    both = known.join(new, keys, "full_outer")
    filled = [F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"__{c}")).alias(c) for c in fill]
    return both.select(*keys, *filled, F.coalesce("first_seen", ntz(now)).alias("first_seen"), F.coalesce("__found", F.lit(False)).alias("seen_now"), F.col("first_seen").isNull().alias("is_new"))


def seed_boards(companies: DataFrame, boards: DataFrame) -> DataFrame:
    """Boards to try for companies (slug): the slug without spaces and with hyphens at each provider, but for known boards."""
    names = F.array_distinct(F.array(F.replace("slug", F.lit(" "), F.lit("")), F.replace("slug", F.lit(" "), F.lit("-"))))
    tried = companies.select("slug", F.explode(names).alias("board")).withColumn("provider", F.explode(words_array(SEED_PROVIDERS)))
    return tried.join(boards.select("provider", "board"), ["provider", "board"], "left_anti")


def discovery_summary(companies: DataFrame, boards: DataFrame) -> DataFrame:
    """One row: companies, boards, those enabled and those that were ever crawled. boards: enabled, last_success."""
    n = companies.agg(F.count("*").alias("companies"))
    rows = boards.agg(F.count("*").alias("boards"), F.count_if("enabled").alias("active_boards"), F.count("last_success").alias("boards_crawled"))
    return n.withColumn("one", F.lit(1)).join(rows.withColumn("one", F.lit(1)), "one").drop("one")


def _shown(skills: Column, keywords: Column, text: Column) -> tuple[Column, Column]:
    shows = lambda x: F.array_contains(keywords, x) | ((F.length(x) > 3) & F.contains(text, x))
    return F.filter(skills, shows), F.filter(skills, lambda x: ~shows(x))


def rank_resumes(jobs: DataFrame, resumes: list[tuple[str, list[str], str]]) -> DataFrame:
    """For each job (job_id, title, skills) its resumes, best first: the best and three more, with the job's skills they show and lack.

    resumes: (kind, keywords, text). A skill is shown by a keyword, or by the text if it is longer than three letters. A kind that the title names
    adds to the share, up to 100; ties keep the order of ``resumes``. A job without skills has a share of 0.
    """
    skills = F.transform(F.filter("skills", lambda x: x != ""), normalize_ascii)
    scored = []
    for i, (kind, keywords, said) in enumerate(resumes):
        matched, missing = _shown(skills, words_array([k.strip().lower() for k in keywords]), F.lit(" ".join(said.lower().split())))
        share = F.when(F.size(skills) > 0, 100.0 * F.size(matched) / F.greatest(F.size(skills), F.lit(1))).otherwise(0.0)
        bonus = F.when(F.lit(kind != "") & F.contains(F.lower("title"), F.lit(kind.lower())), KIND_BONUS).otherwise(0.0)
        score = F.when(bonus > 0, F.least(F.lit(100.0), share + bonus)).otherwise(share)
        scored.append(F.struct(score.alias("score"), F.lit(-i).alias("order"), F.lit(kind).alias("kind"), F.slice(matched, 1, 20).alias("matched"), F.slice(missing, 1, 12).alias("missing")))
    # The few resumes of a job are sorted in its own row.
    best = F.slice(F.sort_array(F.array(*scored), asc=False), 1, 1 + ALTERNATIVES)
    return jobs.select("job_id", F.posexplode(best).alias("at", "r")).select("job_id", "r.kind", "r.score", (F.col("at") + 1).alias("rank"), "r.matched", "r.missing")


def source_health(health: DataFrame, run: DataFrame) -> DataFrame:
    """Per source (source, runs, avg_new, failures) after a run (source, ok, partial, new; configured if some were not): status, failures in a row, rolling mean.

    A source that was not configured did not run, so neither its failures nor its mean move.
    """
    unset = ~F.coalesce("configured", F.lit(True)) if "configured" in run.columns else F.lit(False)
    both = health.join(run, "source", "left")
    ran = F.col("ok").isNotNull() & ~unset
    runs = F.col("runs") + ran.cast("int")
    mean = F.when(ran, F.round((F.col("avg_new") * (runs - 1) + F.col("new")) / runs, 2)).otherwise(F.col("avg_new"))
    failures = F.when(~ran, F.col("failures")).when(F.col("ok"), 0).otherwise(F.col("failures") + 1)
    status = F.when(unset, "unconfigured").when(~ran, "idle").when(~F.col("ok"), "failed").when(F.col("partial"), "degraded").otherwise("ok")
    return both.select("source", runs.alias("runs"), mean.alias("avg_new"), failures.alias("failures"), status.alias("status"))
