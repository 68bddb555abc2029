"""Facts and judgements from what a language model replied: typed, of closed vocabularies, and with a status where a reply is unusable.

A reply is text that should hold one JSON object, perhaps in a code fence or among words. It is parsed once, as a VARIANT; each field is
extracted with its type, and whatever is no member of its vocabulary collapses to the safe value, so the worst that a bad reply can do is nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import let

# Vocabularies, words that name no skill, and limits.
DOMAINS = ["hardware", "software", "ml", "firmware", "analog", "research", "other", "unknown"]
SENIORITY = ["intern", "new_grad", "junior", "mid", "senior", "unknown"]
SPONSORSHIP = ["offered", "not_offered", "citizenship_required", "unknown"]
NON_SKILLS = [
    "communication", "teamwork", "leadership", "problem solving", "problem-solving", "collaboration", "time management", "attention to detail", "self-starter", "motivated", "passionate",
    "detail oriented", "written communication", "verbal communication", "interpersonal skills", "critical thinking", "adaptability", "creativity", "work ethic", "unknown", "none", "n/a", "not stated",
]
RECOMMENDATIONS = ["APPLY", "CONSIDER", "SKIP"]
MOST_SKILLS, SKILL_CHARS, MOST_TERMS, TERM_CHARS, SUMMARY_CHARS, REASON_CHARS, MOST_YEARS = 20, 40, 6, 24, 200, 400, 30
#: A longer reply is not parsed.
REPLY_CHARS = 100_000


def _object_text(reply: Column) -> Column:
    """From the first opening to the last closing brace, inside the first code fence if there is one; null without braces."""
    plain = F.trim(F.coalesce(reply, F.lit("")))
    fenced = F.when(F.startswith(plain, F.lit("```")), F.element_at(F.split(F.substr(plain, F.lit(4)), "```", 2), 1)).otherwise(plain)

    def cut(t: Column) -> Column:
        first, last = F.instr(t, "{"), F.length(t) - F.instr(F.reverse(t), "}") + 1
        return F.when((first > 0) & (F.instr(t, "}") > 0) & (first < last), F.substr(t, first, last - first + 1))

    return let(fenced, cut)


def with_reply(rows: DataFrame, reply: str, *, name: str = "reply_json", most: int = REPLY_CHARS) -> DataFrame:
    """Adds the reply's object as VARIANT, and reply_status: ok, empty, oversized, no_object or broken."""
    text = F.col(reply)
    blank, long = F.coalesce(F.trim(text) == "", F.lit(True)), F.length(text) > most
    rows = rows.withColumn("__object", F.when(~blank & ~long, _object_text(text)))
    rows = rows.withColumn(name, F.try_parse_json("__object"))
    # Only a whole object counts.
    rows = rows.withColumn(name, F.when(F.startswith(F.schema_of_variant(name), F.lit("OBJECT")), F.col(name)))
    status = F.when(blank, "empty").when(long, "oversized").when(F.col("__object").isNull(), "no_object").when(F.col(name).isNull(), "broken").otherwise("ok")
    return rows.withColumn("reply_status", status).drop("__object")


def _get(value: Column, key: str, kind: str) -> Column:
    return F.try_variant_get(value, f"$.{key}", kind)


def _squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def _member(value: Column, key: str, allowed: list[str]) -> Column:
    said = F.replace(F.lower(F.trim(_get(value, key, "string"))), F.lit(" "), F.lit("_"))
    return F.when(said.isin(allowed), said).otherwise("unknown")


def facts(value: Column) -> Column:
    """skills, domain, seniority, is_internship, sponsorship, min_years_experience, terms, summary; null for a null object."""
    skills = F.transform(_get(value, "skills", "array<string>"), lambda s: F.lower(_squeezed(s)))
    usable = F.filter(skills, lambda s: (s != "") & (F.length(s) <= SKILL_CHARS) & ~s.isin(NON_SKILLS))
    terms = F.filter(F.transform(_get(value, "terms", "array<string>"), lambda t: F.trim(t)), lambda t: t != "")
    years = _get(value, "min_years_experience", "double")
    flag = _get(value, "is_internship", "variant")
    none = F.array().cast("array<string>")
    out = F.struct(
        F.coalesce(F.slice(F.array_distinct(usable), 1, MOST_SKILLS), none).alias("skills"), _member(value, "domain", DOMAINS).alias("domain"), _member(value, "seniority", SENIORITY).alias("seniority"),
        F.when(F.schema_of_variant(flag) == "BOOLEAN", _get(value, "is_internship", "boolean")).alias("is_internship"), _member(value, "sponsorship", SPONSORSHIP).alias("sponsorship"),
        F.when(years.between(0, MOST_YEARS), years).alias("min_years_experience"), F.coalesce(F.slice(F.transform(terms, lambda t: F.substring(t, 1, TERM_CHARS)), 1, MOST_TERMS), none).alias("terms"),
        F.substring(_squeezed(F.coalesce(_get(value, "summary", "string"), F.lit(""))), 1, SUMMARY_CHARS).alias("summary"),
    )
    return F.when(value.isNotNull(), out)


def assessment(value: Column) -> Column:
    """relevance and three matches (0 to 1), role_match, sponsorship, recommendation and reason; null for a null object."""
    share = lambda key: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(_get(value, key, "double"), F.lit(0.0)))).alias(key)
    said, advice = F.lower(_get(value, "sponsorship", "string")), F.upper(_get(value, "recommendation", "string"))
    out = F.struct(
        share("relevance"), F.coalesce(_get(value, "role_match", "boolean"), F.lit(False)).alias("role_match"), share("skills_match"), share("experience_match"), share("location_match"),
        F.when(said.isin("offered", "not_offered"), said).otherwise("unknown").alias("sponsorship"), F.when(advice.isin(RECOMMENDATIONS), advice).otherwise("SKIP").alias("recommendation"),
        F.substring(F.coalesce(_get(value, "reason", "string"), F.lit("")), 1, REASON_CHARS).alias("reason"),
    )
    return F.when(value.isNotNull(), out)


def read_facts(rows: DataFrame, key: str, reply: str) -> DataFrame:
    """key, f_skills, f_terms, f_years of usable replies, as ``records.apply_facts`` takes them."""
    own = with_reply(rows.select(key, reply), reply).withColumn("f", facts(F.col("reply_json"))).where("f is not null")
    return own.select(key, F.col("f.skills").alias("f_skills"), F.col("f.terms").alias("f_terms"), F.col("f.min_years_experience").alias("f_years"))
