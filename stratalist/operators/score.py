"""Explainable score of a listing against preferences, as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.facts import country_code
from ..functions.text import role_affinity, words_array
from ..storage import materialize

# Weights, bands and steps of the score.
WEIGHTS = {"role_match": 25.0, "technical_skills": 25.0, "candidate_fit": 15.0, "location": 10.0, "company_preference": 5.0, "freshness": 10.0, "internship_constraints": 10.0}
RELEVANCE = ("role_match", "technical_skills")
#: What of the relevance stands whatever the context, and what the context adds at most: 1 - 0.7 is not the float 0.3.
CONTEXT_FLOOR, CONTEXT_LIFT = 0.70, 0.30
BANDS = [(90.0, "apply_now"), (80.0, "strong_match"), (70.0, "worth_considering"), (60.0, "maybe")]
FRESHNESS = [(1, 10.0), (3, 7.0), (7, 3.0), (14, 1.0)]
UBIQUITOUS = "python java javascript typescript git linux bash sql docker aws gcp azure c c++ react node.js ci/cd jenkins kubernetes numpy pandas".split()
UBIQUITOUS_WEIGHT, SKILLS_FOR_FULL, KEYWORD_STEP, KEYWORD_CAP = 0.35, 3.0, 3.0, 30.0
PENALTY_STEP, PENALTY_CAP = 6.0, 40.0


@dataclass(frozen=True)
class Preferences:
    roles: list[tuple[str, float]] = field(default_factory=list)  # in order of precedence, with weight
    skills: list[str] = field(default_factory=list)
    positive: list[str] = field(default_factory=list)
    negative: list[str] = field(default_factory=list)
    preferred: list[str] = field(default_factory=list)  # company slugs
    blacklisted: list[str] = field(default_factory=list)
    locations: list[tuple[str, float]] = field(default_factory=list)
    excluded_locations: list[str] = field(default_factory=list)
    hard_keywords: list[str] = field(default_factory=list)
    other_location: float = 2.0
    max_years: float = 1.0
    internship_only: bool = True
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    remote_bonus: float = 5.0
    hybrid_bonus: float = 4.0
    unknown_location: float = 2.0
    accept_remote: bool = True
    accept_hybrid: bool = True
    industries: list[str] = field(default_factory=list)
    seasons: list[str] = field(default_factory=list)
    needs_sponsorship: bool = False
    sponsorship_required: bool = False  # refusals are then hard exclusions
    least_hourly: float | None = None
    countries: list[str] = field(default_factory=list)  # two letters; empty allows all


def _clamp(x: Column) -> Column:
    return F.greatest(F.least(x, F.lit(100.0)), F.lit(0.0))


def _hits(text: Column, needles: list[str]) -> Column:
    return sum((F.contains(text, F.lit(n.lower())).cast("int") for n in needles), F.lit(0))


def best_role(tokens: Column, prefs: Preferences) -> Column:
    """Struct (adjusted, affinity, name) of the role that a title covers best: by weighted affinity, then by affinity, then the earlier one."""
    rated = []
    for i, (name, weight) in enumerate(prefs.roles):
        affinity = role_affinity(tokens, name)
        adjusted = affinity * (0.85 + 0.15 * min(weight, 2.0))
        rated.append(F.when(affinity > 0, F.struct(adjusted.alias("adjusted"), affinity.alias("affinity"), F.lit(-i).alias("order"), F.lit(name).alias("name"))))
    return F.array_max(F.array(*rated))


def role_match(tokens: Column, prefs: Preferences, title: Column | None = None, skills: Column | None = None, best: Column | None = None) -> Column:
    """0 to 100: the best role of the preferences that a title covers; 50 without roles. A weak match whose title names one of the skills counts 45.
    best: ``best_role`` of the tokens, where a row has it already."""
    if not prefs.roles:
        return F.lit(50.0)
    value = _clamp(F.coalesce((best_role(tokens, prefs) if best is None else best)["adjusted"], F.lit(0.0)) * 100)
    if title is None:
        return value
    named = F.exists(skills, lambda x: F.contains(F.lower(title), F.lower(x)))
    return F.when((value > 0) & (value < 40) & F.coalesce(named, F.lit(False)), 45.0).otherwise(value)


def technical_skills(skills: Column, text: Column, prefs: Preferences) -> Column:
    """Null where there is nothing to measure: no own skills, no readable body, or none stated."""
    known = F.array_intersect(skills, words_array(prefs.skills))
    mass = F.aggregate(known, F.lit(0.0), lambda a, s: a + F.when(s.isin(UBIQUITOUS), UBIQUITOUS_WEIGHT).otherwise(1.0))
    value = 100 * F.least(F.lit(1.0), mass / SKILLS_FOR_FULL) + F.least(F.lit(KEYWORD_CAP), KEYWORD_STEP * _hits(text, prefs.positive))
    unmeasured = F.lit(not prefs.skills) | (F.length(F.trim(text)) < 40) | (F.size(skills) == 0)
    return F.when(~unmeasured, _clamp(value))


def candidate_fit(years: Column, degrees: Column, prefs: Preferences) -> Column:
    """Null where nothing is stated."""
    by_years = F.when(years.isNull(), 0.0).when(years <= prefs.max_years, 15.0).otherwise(-F.least(F.lit(50.0), 12.0 * (years - prefs.max_years)))
    only = lambda d: (F.size(degrees) == 1) & F.array_contains(degrees, d)
    value = 70.0 + by_years + F.when(only("PhD"), -30.0).when(only("Masters"), -12.0).otherwise(0.0)
    return F.when(years.isNotNull() | (F.size(degrees) > 0), _clamp(value))


def location_score(location: Column, prefs: Preferences, remote: Column | None = None) -> Column:
    """By the rules of the preferences; accepted remote work by its own bonus, hybrid work by the better of rule and bonus."""
    low = F.lower(location)
    top = max([b for _, b in prefs.locations] + ([] if remote is None else [prefs.remote_bonus, 10.0]), default=1.0) or 1.0
    excluded = sum((F.contains(low, F.lit(x.lower())).cast("int") for x in prefs.excluded_locations), F.lit(0)) > 0
    rules = [F.when(F.contains(low, F.lit(p.lower())), b) for p, b in prefs.locations]
    bonus = F.coalesce(F.array_max(F.array(*rules)) if rules else F.lit(None), F.lit(prefs.other_location))
    if remote is None:
        return F.when(excluded, 0.0).otherwise(_clamp(50 + bonus / top * 50))
    bonus = F.when(F.coalesce(low, F.lit("")) == "", prefs.unknown_location).otherwise(bonus)
    scaled = lambda x: _clamp(50 + x / max(top, 1.0) * 50)
    out = F.when(F.lit(prefs.accept_remote) & (remote == "remote"), scaled(F.lit(prefs.remote_bonus)))
    hybrid = F.greatest(F.when(excluded, -999.0).otherwise(bonus), F.lit(prefs.hybrid_bonus))
    out = out.when(F.lit(prefs.accept_hybrid) & (remote == "hybrid"), scaled(hybrid))
    return out.when(F.coalesce(excluded, F.lit(False)), 0.0).otherwise(scaled(bonus))


def company_preference(slug: Column, prefs: Preferences, text: Column | None = None) -> Column:
    """text: company and description in lower case, of which the first 2000 characters are searched for whole words of an industry."""
    out = F.when(slug.isin(prefs.preferred), 100.0) if prefs.preferred else F.when(F.lit(False), 100.0)
    if text is not None and prefs.industries:
        words, head = "|".join(rf"\Q{x.lower()}\E" for x in prefs.industries), F.substring(text, 1, 2000)
        # The pattern looks behind itself at every character, so it is tried only where a word is found at all.
        out = out.when((_hits(head, prefs.industries) > 0) & head.rlike(rf"(?<![a-z0-9])(?:{words})(?![a-z0-9])"), 75.0)
    return out.otherwise(50.0)


def freshness_score(days: Column) -> Column:
    """Of fractional days; null counts as 50."""
    out = F.lit(0.0)
    for limit, bonus in reversed(FRESHNESS):
        out = F.when(F.greatest(days, F.lit(0.0)) <= limit, 100.0 * bonus / FRESHNESS[0][1]).otherwise(out)
    return F.when(days.isNull(), 50.0).otherwise(out)


def constraints_score(employment: Column, prefs: Preferences, terms: Column | None = None, sponsorship: Column | None = None, pay: Column | None = None, period: Column | None = None) -> Column:
    """Kind of employment, then term, visa (only a statement counts, and only if it is needed) and pay by the hour."""
    other = -35.0 if prefs.internship_only else 0.0
    value = 50.0 + F.when(employment.isin("internship", "co_op"), 35.0).when(employment == "unknown", 5.0).otherwise(other)
    if terms is not None and prefs.seasons:
        fits = F.arrays_overlap(F.transform(terms, F.lower), words_array([x.lower() for x in prefs.seasons]))
        value = value + F.when(F.coalesce(F.size(terms), F.lit(0)) <= 0, 0.0).when(fits, 10.0).otherwise(-10.0)
    if sponsorship is not None and prefs.needs_sponsorship:
        value = value + F.when(sponsorship == "not_offered", -30.0).when(sponsorship == "citizenship_required", -40.0).when(sponsorship == "security_clearance_required", -25.0).when(sponsorship == "offered", 10.0).otherwise(0.0)
    if pay is not None and prefs.least_hourly:
        hourly = F.when(period == "yearly", pay / HOURS["yearly"]).when(period == "monthly", pay / HOURS["monthly"]).otherwise(pay)
        value = value + F.when(F.coalesce(pay, F.lit(0.0)) == 0, 0.0).when(hourly >= prefs.least_hourly, 8.0).otherwise(-10.0)
    return _clamp(value)


#: Hours of work in a year and a month.
HOURS = {"yearly": 2080.0, "monthly": 173.0}


def blend(components: dict[str, Column], weights: dict[str, float]) -> Column:
    """Relevance scaled by context; components that are null share their weight among the rest of their group."""

    def mean(names: list[str]) -> Column:
        over = sum((F.when(components[n].isNotNull(), weights[n]).otherwise(0.0) for n in names), F.lit(0.0))
        total = sum((F.coalesce(components[n] * weights[n], F.lit(0.0)) for n in names), F.lit(0.0))
        return F.when(over > 0, total / F.nullif(over, F.lit(0.0)))

    relevance, context = mean([n for n in components if n in RELEVANCE]), mean([n for n in components if n not in RELEVANCE])
    return F.coalesce(F.when(relevance.isNull(), context).when(context.isNull(), relevance).otherwise(relevance * (CONTEXT_FLOOR + CONTEXT_LIFT * context / 100)), F.lit(0.0))


def negative_penalty(title: Column, text: Column, prefs: Preferences) -> Column:
    """title, and text (title and description), in lower case; only the text's first 4000 characters count, and a hit that the title has too counts four times as much."""
    total, head = F.lit(0.0), F.substring(text, 1, 4000)
    for word in prefs.negative:
        total = total + F.when(F.contains(head, F.lit(word)), F.when(F.contains(title, F.lit(word)), 2.0).otherwise(0.5)).otherwise(0.0)
    return F.least(F.lit(PENALTY_CAP), PENALTY_STEP * total)


def priority_band(score: Column) -> Column:
    out = F.lit("skip")
    for limit, name in reversed(BANDS):
        out = F.when(score >= limit, name).otherwise(out)
    return out


def hard_exclusion(slug: Column, location: Column, text: Column, prefs: Preferences, country: Column | None = None, sponsorship: Column | None = None) -> Column:
    """Why a listing is out, or null: company, location, stated country, keyword in the first 4000 characters of ``text`` (title and description), visa."""
    out = F.when(slug.isin(prefs.blacklisted), "company") if prefs.blacklisted else F.when(F.lit(False), "company")
    low = F.lower(location)
    for x in prefs.excluded_locations:
        out = out.when(F.contains(low, F.lit(x.lower())), f"location: {x}")
    if country is not None and prefs.countries:
        code = country_code(country)
        out = out.when((code != "") & ~code.isin(prefs.countries), F.concat(F.lit("country: "), country))
    for x in prefs.hard_keywords:
        out = out.when(F.contains(F.substring(text, 1, 4000), F.lit(x.lower())), f"keyword: {x}")
    if sponsorship is not None and prefs.needs_sponsorship and prefs.sponsorship_required:
        out = out.when(sponsorship.isin("not_offered", "citizenship_required"), "sponsorship")
    return out


def exact_score(blended: Column, penalty: Column) -> Column:
    """Clamped but not rounded, as the bands look at it."""
    return _clamp(blended - penalty)


def final_score(blended: Column, penalty: Column) -> Column:
    """Clamped, to one decimal, halves to even."""
    return F.bround(exact_score(blended, penalty), 1)


def skill_gap(skills: Column, prefs: Preferences, most: int = 10) -> tuple[Column, Column]:
    """The listing's skills that are the candidate's own, and (at most ``most``) those that are not."""
    own = words_array([x.lower() for x in prefs.skills])
    known = lambda x: F.array_contains(own, F.lower(x))
    return F.filter(skills, known), F.slice(F.filter(skills, lambda x: ~known(x)), 1, most)


def missing_requirements(years: Column, degrees: Column, prefs: Preferences, degree: str = "") -> Column:
    """Stated years beyond the preferences', and a PhD that the candidate has not."""
    over = F.when(years > prefs.max_years, F.concat(F.format_string("%.0f", years), F.lit("+ years experience")))
    phd = F.when(F.array_contains(degrees, "PhD") & F.lit("phd" not in degree.lower()), "PhD")
    return F.array_compact(F.array(over, phd))


def explanations(components: dict[str, Column], role: Column) -> tuple[Column, Column]:
    """What speaks for a listing and against it, in the order of the components. role: a struct of ``best_role``."""
    value = lambda n: components[n]
    matched = F.when(role["affinity"] > 0.3, F.concat(F.lit("Matches target role: "), role["name"]))
    good = [matched, F.when(value("location") > 60, F.lit("Good location")), F.when(value("company_preference") >= 100, F.lit("Preferred company")), F.when(value("freshness") >= 100, F.lit("Posted today")), F.when(value("internship_constraints") >= 80, F.lit("Internship"))]
    bad = [F.when(matched.isNull() & (value("role_match") < 30), F.lit("Title does not match your target roles")), F.when(value("location") == 0, F.lit("Excluded location")), F.when(value("freshness") == 0, F.lit("Posted long ago")), F.when(value("internship_constraints") < 50, F.lit("Not an internship"))]
    return F.array_compact(F.array(*good)), F.array_compact(F.array(*bad))


def model_blend(rows: DataFrame, judge: Callable[[DataFrame], DataFrame], budget: int, least: float = 60.0) -> DataFrame:
    """The score moved by a model's relevance (0 to 1) on the best rows: at most ``budget`` of those that score ``least`` or more are asked about.

    judge: (job_id, score) to (job_id, relevance); rows that it says nothing about keep their score. The rows are written once, since they are
    read for the best and for the result.
    """
    rows = materialize(rows, "scored")
    asked = rows.where(F.col("score") >= least).orderBy(F.desc("score"), "job_id").limit(budget)
    said = judge(asked.select("job_id", "score")).select("job_id", "relevance")
    both = rows.join(said, "job_id", "left")
    return both.withColumn("score", F.when(F.col("relevance").isNotNull(), F.bround(0.75 * F.col("score") + 25.0 * F.col("relevance"), 1)).otherwise(F.col("score"))).drop("relevance")


def contributions(components: dict[str, Column], weights: dict[str, float], score: Column) -> dict[str, Column]:
    """The score split over its measured components, summing to it; null for those not measured, and for all where the score is 0.

    The score is first split between relevance and context, by how much context lifts it, then within each group by weighted value.
    """

    def group(inside: bool) -> tuple[Column, Column]:
        own = [n for n in components if (n in RELEVANCE) == inside]
        over = sum((F.when(components[n].isNotNull(), weights[n]).otherwise(0.0) for n in own), F.lit(0.0))
        return over, sum((F.coalesce(components[n] * weights[n], F.lit(0.0)) for n in own), F.lit(0.0))

    (rel_over, rel_total), (ctx_over, ctx_total) = group(True), group(False)
    lift = CONTEXT_LIFT * ctx_total / F.nullif(ctx_over, F.lit(0.0)) / 100
    ctx_share = F.when(rel_over <= 0, score).when(ctx_over <= 0, 0.0).otherwise(score * lift / (CONTEXT_FLOOR + lift))
    out = {}
    for n, c in components.items():
        share, total = (score - ctx_share, rel_total) if n in RELEVANCE else (ctx_share, ctx_total)
        part = F.when(total > 0, share * c * weights[n] / F.nullif(total, F.lit(0.0))).otherwise(0.0)
        out[n] = F.when(c.isNotNull() & (score > 0), part)
    return out
