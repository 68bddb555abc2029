"""The cheap filter before anything is normalised: permissive, and open only where the preferences ask for internships."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words of roles that name no domain, bodies too long to decide by one mention, and the patterns of titles and bodies.
COMMON_WORDS = {"intern", "internship", "engineer", "the", "and"}
LONG_BODY = 6000
INTERN_TITLE = (
    r"(?iU)\b(intern|internship|co[\s-]?op|coop|summer analyst|placement student|industrial placement|apprentice|student|trainee|university grad|new grad|early career|campus)\b"
)
INTERN_BODY = r"(?iU)\b(internship|intern\b|co[\s-]?op)\b"
OFF_DOMAIN = (
    r"(?iU)\b(sales|account executive|recruit(er|ing)|talent acquisition|marketing|social media|public relations|human resources|payroll|"
    r"customer (success|support|service)|barista|driver|warehouse|nurse|teacher|paralegal|attorney|legal counsel|janitor|security guard|retail associate|cashier)\b"
)


def domain_terms(roles: list[str], keywords: list[str]) -> list[str]:
    words = {w for r in roles for w in re.split(r"[^a-zA-Z0-9+#]+", r.lower()) if len(w) > 2} - COMMON_WORDS
    return sorted(words | {k.strip().lower() for k in keywords if len(k.strip()) > 1})


def has_term(text: Column, terms: list[str]) -> Column:
    """Whether the text holds any of the terms; without terms every text does."""
    out = F.lit(not terms)
    for t in terms:
        out = out | F.contains(F.lower(text), F.lit(t))
    return out


def off_domain(title: Column, terms: list[str]) -> Column:
    """A title of a trade that is none of the search's, and that names none of its terms."""
    return title.rlike(OFF_DOMAIN) & ~has_term(title, terms)


def title_gate(title: Column, terms: list[str], internship_only: bool = True) -> Column:
    """What may be read further: an empty title, or one that names an internship of no other domain."""
    if not internship_only:
        return F.lit(True)
    return F.coalesce(title == "", F.lit(True)) | (title.rlike(INTERN_TITLE) & ~off_domain(title, terms))


def is_internship(title: Column, declared: Column, terms: Column, body: Column) -> Column:
    """By its title, its declared type, its stated terms, or a mention in a short body."""
    declared, body = F.coalesce(declared, F.lit("")), F.coalesce(body, F.lit(""))
    return title.rlike(INTERN_TITLE) | F.contains(F.lower(declared), F.lit("intern")) | (F.coalesce(F.size(terms), F.lit(0)) > 0) | ((F.length(body) < LONG_BODY) & body.rlike(INTERN_BODY))


def prefilter(rows: DataFrame, terms: list[str], internship_only: bool = True) -> tuple[DataFrame, DataFrame]:
    """The rows that stay, and one row with the two counts of those dropped. rows: title, employment_type, terms, description."""
    title = F.coalesce("title", F.lit(""))
    intern = F.lit(not internship_only) | is_internship(title, F.col("employment_type"), F.col("terms"), F.col("description"))
    other = F.lit(internship_only) & off_domain(title, terms)
    marked = rows.withColumns({"__intern": intern, "__other": other})
    counts = marked.agg(F.count_if(~F.col("__intern")).alias("not_internship"), F.count_if(F.col("__intern") & F.col("__other")).alias("off_domain"), F.count_if(F.col("__intern") & ~F.col("__other")).alias("kept"))
    return marked.where("__intern and not __other").drop("__intern", "__other"), counts
