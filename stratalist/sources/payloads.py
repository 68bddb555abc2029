"""Listings from recorded payloads of boards: JSON in, one common shape out."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import strip_html

# The fields read from each board's payload.
SCHEMAS = {
    "lever": "array<struct<id:string,text:string,hostedUrl:string,applyUrl:string,categories:struct<location:string,commitment:string,team:string>,descriptionPlain:string,createdAt:bigint,workplaceType:string>>",
    "ashby": "struct<jobs:array<struct<id:string,title:string,jobUrl:string,applyUrl:string,location:string,descriptionHtml:string,employmentType:string,isRemote:boolean,publishedAt:string,department:string>>>",
    "greenhouse": "struct<jobs:array<struct<id:bigint,title:string,absolute_url:string,location:struct<name:string>,content:string,first_published:string,updated_at:string,requisition_id:string,departments:array<struct<name:string>>>>>",
    "curated": "array<struct<id:string,company_name:string,title:string,url:string,company_url:string,locations:array<string>,terms:array<string>,active:boolean,is_visible:boolean,date_posted:bigint,sponsorship:string,category:string>>",
    "smartrecruiters": "struct<content:array<struct<id:string,name:string,company:struct<name:string>,applyUrl:string,location:struct<city:string,region:string,country:string,remote:boolean>,typeOfEmployment:struct<label:string>,department:struct<label:string>,releasedDate:string>>>",
    "workable": "struct<results:array<struct<shortcode:string,title:string,city:string,state:string,country:string,url:string,application_url:string,description:string,remote:boolean,employment_type:string,department:string,published_on:string,created_at:string>>>",
    "recruitee": "struct<offers:array<struct<id:string,title:string,careers_url:string,careers_apply_url:string,location:string,description:string,requirements:string,employment_type_code:string,remote:boolean,department:string,published_at:string>>>",
    "themuse": "struct<results:array<struct<id:string,name:string,company:struct<name:string>,locations:array<struct<name:string>>,contents:string,refs:struct<landing_page:string>,categories:array<struct<name:string>>,publication_date:string>>>",
    "remotive": "struct<jobs:array<struct<id:string,title:string,company_name:string,url:string,candidate_required_location:string,description:string,job_type:string,salary:string,publication_date:string,category:string>>>",
    "arbeitnow": "struct<data:array<struct<slug:string,title:string,company_name:string,tags:array<string>,url:string,location:string,description:string,remote:boolean,job_types:array<string>,created_at:string>>>",
}
DETAIL_SCHEMA = "struct<jobAd:struct<sections:struct<companyDescription:struct<text:string>,jobDescription:struct<text:string>,qualifications:struct<text:string>>>>"
THREAD_SCHEMA = "struct<created_at:string,children:array<struct<id:string,text:string,created_at:string>>>"
LISTS = {"smartrecruiters": "content", "workable": "results", "recruitee": "offers", "themuse": "results", "arbeitnow": "data"}
SPONSORSHIP_HINTS = {
    "Does Not Offer Sponsorship": "We do not offer visa sponsorship.",
    "U.S. Citizenship is Required": "U.S. citizenship is required.",
    "Offers Sponsorship": "We offer visa sponsorship.",
}
HEADER_SEPARATOR = r"\s*[|•·—–]\s*|\s+-\s+"
ROLE_WORDS = r"(?i)\b(intern|internship|co-?op|engineer|developer|scientist|designer|architect|analyst)\b"
APPLY_HOSTS = ["greenhouse.io", "lever.co", "ashbyhq.com", "workable.com", "rippling"]
THREAD_DAYS, REMOTE_CHARS = 90, 400

#: The common shape. A board leaves null what it doesn't state.
FIELDS = {name: "string" for name in ("source_job_id", "title", "company", "url", "apply_url", "company_url", "location", "description", "requirements", "employment_type", "remote_status", "department", "salary_raw", "sponsorship_hint")}
FIELDS |= {"locations": "array<string>", "terms": "array<string>", "date_posted": "timestamp_ntz"}


def _iso(text: Column) -> Column:
    return F.try_to_timestamp(F.regexp_replace(F.substring(text, 1, 19), "T", " "), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")


def _epoch(n: Column) -> Column:
    """Seconds, or milliseconds where the number is too large for that."""
    return F.timestamp_seconds(F.when(n > 100_000_000_000, n / 1000).otherwise(n)).cast("timestamp_ntz")


def parse_date(text: Column) -> Column:
    digits = text.rlike(r"^\d{9,}$")
    return F.when(digits, _epoch(text.try_cast("bigint"))).otherwise(_iso(F.when(F.length(text) == 10, F.concat(text, F.lit(" 00:00:00"))).otherwise(text)))


def _place(*parts: str) -> Column:
    """The parts that are stated, with commas; null if none is."""
    kept = F.filter(F.array(*parts), lambda p: F.coalesce(p != "", F.lit(False)))
    return F.nullif(F.array_join(kept, ", "), F.lit(""))


def _filled(text: str) -> Column:
    return F.nullif(F.col(text), F.lit(""))


def _remote(flag: str) -> Column:
    return F.when(F.col(flag), "remote")


def _fields(provider: str) -> dict[str, Column | str]:
    first = lambda array: F.get(F.col(array), F.lit(0))
    return {
        "lever": {"source_job_id": "j.id", "title": "j.text", "url": "j.hostedUrl", "apply_url": "j.applyUrl", "location": "j.categories.location", "description": "j.descriptionPlain", "employment_type": "j.categories.commitment", "department": "j.categories.team", "date_posted": _epoch(F.col("j.createdAt"))},
        "ashby": {"source_job_id": "j.id", "title": "j.title", "url": "j.jobUrl", "apply_url": "j.applyUrl", "location": "j.location", "description": "j.descriptionHtml", "employment_type": "j.employmentType", "department": "j.department", "date_posted": _iso(F.col("j.publishedAt"))},
        "greenhouse": {"source_job_id": "j.id", "title": "j.title", "url": "j.absolute_url", "location": "j.location.name", "description": "j.content", "department": first("j.departments")["name"], "date_posted": _iso(F.col("j.first_published"))},
        "curated": {"source_job_id": F.coalesce(_filled("j.id"), F.col("j.url")), "title": F.trim("j.title"), "company": F.trim("j.company_name"), "url": "j.url", "apply_url": "j.url", "company_url": "j.company_url", "location": first("j.locations"), "locations": "j.locations", "terms": "j.terms", "employment_type": F.lit("internship"), "department": "j.category", "date_posted": _epoch(F.col("j.date_posted")),
                    "sponsorship_hint": F.try_element_at(F.create_map(*[F.lit(x) for kv in SPONSORSHIP_HINTS.items() for x in kv]), F.trim("j.sponsorship"))},
        "smartrecruiters": {"source_job_id": "j.id", "title": "j.name", "company": _filled("j.company.name"), "url": F.coalesce(_filled("j.applyUrl"), F.concat(F.lit("https://jobs.smartrecruiters.com/"), F.col("token"), F.lit("/"), F.col("j.id"))), "apply_url": "j.applyUrl", "location": _place("j.location.city", "j.location.region", "j.location.country"), "employment_type": "j.typeOfEmployment.label", "remote_status": _remote("j.location.remote"), "department": "j.department.label", "date_posted": parse_date(F.col("j.releasedDate"))},
        "workable": {"source_job_id": "j.shortcode", "title": "j.title", "url": F.coalesce(_filled("j.url"), F.concat(F.lit("https://apply.workable.com/"), F.col("token"), F.lit("/j/"), F.col("j.shortcode"), F.lit("/"))), "apply_url": F.coalesce(_filled("j.application_url"), F.col("j.url")), "location": _place("j.city", "j.state", "j.country"), "description": "j.description", "employment_type": "j.employment_type", "remote_status": _remote("j.remote"), "department": "j.department", "date_posted": parse_date(F.coalesce(_filled("j.published_on"), F.col("j.created_at")))},
        "recruitee": {"source_job_id": "j.id", "title": "j.title", "url": F.coalesce(_filled("j.careers_url"), F.col("j.careers_apply_url")), "apply_url": "j.careers_apply_url", "location": "j.location", "description": "j.description", "requirements": _filled("j.requirements"), "employment_type": "j.employment_type_code", "remote_status": _remote("j.remote"), "department": "j.department", "date_posted": parse_date(F.col("j.published_at"))},
        "themuse": {"source_job_id": "j.id", "title": "j.name", "company": "j.company.name", "url": "j.refs.landing_page", "location": first("j.locations")["name"], "locations": "j.locations.name", "description": "j.contents", "department": first("j.categories")["name"], "date_posted": parse_date(F.col("j.publication_date"))},
        "remotive": {"source_job_id": "j.id", "title": "j.title", "company": "j.company_name", "url": "j.url", "location": F.coalesce(_filled("j.candidate_required_location"), F.lit("Remote")), "description": "j.description", "employment_type": "j.job_type", "remote_status": F.lit("remote"), "salary_raw": _filled("j.salary"), "department": "j.category", "date_posted": parse_date(F.col("j.publication_date"))},
        "arbeitnow": {"source_job_id": "j.slug", "title": "j.title", "company": "j.company_name", "url": "j.url", "location": "j.location", "description": "j.description", "employment_type": first("j.job_types"), "remote_status": _remote("j.remote"), "date_posted": parse_date(F.col("j.created_at"))},
    }[provider]


def _shaped(rows: DataFrame, source: str, fields: dict[str, Column | str]) -> DataFrame:
    """The common shape. Where the payload's row names its board, that goes before the id, and its company counts where the posting states none."""
    value = lambda name: F.col(fields[name]) if isinstance(fields.get(name), str) else fields.get(name, F.lit(None))
    own = {name: value(name).cast(kind) for name, kind in FIELDS.items()}
    own["source_job_id"] = F.concat(F.coalesce(F.concat("token", F.lit(":")), F.lit("")), own["source_job_id"])
    own["company"] = F.coalesce(own["company"], "board_company", "token")
    return rows.select(F.lit(source).alias("source"), *[c.alias(name) for name, c in own.items()])


def _with_board(payloads: DataFrame, column: str, *more: Column) -> DataFrame:
    null = F.lit(None).cast("string")
    token = F.col("board_token") if "board_token" in payloads.columns else null
    company = F.nullif("company_name", F.lit("")) if "company_name" in payloads.columns else null
    return payloads.select(token.alias("token"), company.alias("board_company"), F.col(column).alias("payload"), *more)


def read_board(payloads: DataFrame, provider: str, column: str = "payload", terms: list[str] | None = None) -> DataFrame:
    """source and the common fields, one row for each posting; unreadable payloads give no rows.

    ``payloads`` has one row a recorded payload and may name its board_token and company_name. ``terms`` filter the boards that can't
    search (themuse: a word of the title; arbeitnow: a part of title or tags) before any other field is made. Postings without an id go
    where ids name boards, those without a company on the open boards; of a curated id the first stays.
    """
    parsed = F.from_json("payload", SCHEMAS[provider], {"mode": "PERMISSIVE"})
    jobs = parsed if provider in ("lever", "curated") else parsed[LISTS.get(provider, "jobs")]
    j = _with_board(payloads, column).select("token", "board_company", F.posexplode(jobs).alias("at", "j"))
    if provider == "curated":
        j = j.where("coalesce(j.active, true) and coalesce(j.is_visible, true) and trim(j.company_name) != '' and trim(j.title) != '' and j.url != ''")
    elif provider in ("smartrecruiters", "workable", "recruitee"):
        j = j.where(F.coalesce(F.col("j.shortcode" if provider == "workable" else "j.id"), F.lit("")) != "")
    elif provider in ("themuse", "remotive", "arbeitnow"):
        j = j.where(F.coalesce(F.col("j.company.name" if provider == "themuse" else "j.company_name"), F.lit("")) != "")
    if terms and provider == "themuse":
        j = j.where(F.arrays_overlap(F.split(F.lower("j.name"), r"\s+"), F.array(*map(F.lit, terms))))
    if terms and provider == "arbeitnow":
        text = F.lower(F.concat_ws(" ", "j.title", F.array_join(F.coalesce("j.tags", F.array().cast("array<string>")), " ")))
        j = j.where(F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(text, t)))
    if provider == "curated":
        named = j.withColumn("id", F.coalesce(_filled("j.id"), F.col("j.url")))
        j = named.groupBy("token", "id").agg(F.min_by(F.struct("board_company", "j"), F.struct("at", "j.url")).alias("first")).select("token", "first.*")
    return _shaped(j, provider, _fields(provider))


def query_terms(text: str) -> list[str]:
    """The words of a search phrase that filter postings: those of more than two letters."""
    return sorted({w for w in text.lower().split() if len(w) > 2})


def with_details(rows: DataFrame, details: DataFrame, column: str = "payload") -> DataFrame:
    """Postings with description and requirements of their detail payload (source_job_id and payload), where there is one."""
    sections = F.from_json(column, DETAIL_SCHEMA)["jobAd"]["sections"]
    text = F.trim(F.concat_ws("\n\n", sections["companyDescription"]["text"], sections["jobDescription"]["text"]))
    d = details.select("source_job_id", F.nullif(text, F.lit("")).alias("d_text"), F.nullif(sections["qualifications"]["text"], F.lit("")).alias("d_requirements"))
    both = rows.join(d, "source_job_id", "left")
    return both.withColumns({"description": F.coalesce("d_text", "description"), "requirements": F.coalesce("d_requirements", "requirements")}).select(rows.columns)


def read_thread(payloads: DataFrame, now: datetime, column: str = "payload") -> DataFrame:
    """Postings of a hiring thread's comments, whose first line reads company, role, place between separators.

    A comment counts if it has 40 characters, two parts, and a company of at most 60 characters and six words. The role is the first part
    that names one, else the second. A link to a known board is preferred. Postings older than 90 days go.
    """
    thread = F.from_json("payload", THREAD_SCHEMA)
    rows = _with_board(payloads, column, thread.alias("t")).select("token", "board_company", F.col("t.created_at").alias("story_at"), F.explode("t.children").alias("c"))
    rows = rows.where(F.coalesce(F.col("c.id"), F.lit("")) != "").withColumn("text", strip_html(F.col("c.text"))).where(F.length("text") >= 40)
    line = F.get(F.filter(F.transform(F.split("text", "\n"), F.trim), lambda x: x != ""), F.lit(0))
    rows = rows.withColumn("parts", F.filter(F.transform(F.split(line, HEADER_SEPARATOR), F.trim), lambda x: x != "")).where(F.size("parts") >= 2)
    rows = rows.withColumns({"company": F.get("parts", F.lit(0)), "rest": F.slice("parts", 2, 2_147_483_647), "links": F.regexp_extract_all("text", F.lit(r"(https?://[^\s<>\"')]+)"), F.lit(1))})
    rows = rows.where((F.length("company") <= 60) & (F.size(F.split("company", r"\s+")) <= 6))
    named = F.filter(F.transform("rest", lambda x, i: F.when(x.rlike(ROLE_WORDS), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("at", F.coalesce(F.get(named, F.lit(0)), F.lit(0))).withColumn("role", F.get("rest", F.col("at")))
    # A role that had to be cut is read for its place too.
    places = F.filter("rest", lambda x, i: ((i != F.col("at")) | (F.length("role") > 120)) & (x.rlike(r"(?i)\bremote\b") | x.rlike(r"[A-Z]{2}\b|,")))
    remote = F.substring("text", 1, REMOTE_CHARS).rlike(r"(?i)\bremote\b")
    known = F.filter("links", lambda u: F.exists(F.array(*map(F.lit, APPLY_HOSTS)), lambda h: F.contains(u, h)))
    link = F.coalesce(F.get(known, F.lit(0)), F.get("links", F.lit(0)))
    posted = F.coalesce(parse_date(F.col("story_at")), parse_date(F.col("c.created_at")))
    fields = {"source_job_id": F.concat(F.lit("hn:"), F.col("c.id")), "title": F.substring("role", 1, 120), "company": "company", "url": F.coalesce(link, F.concat(F.lit("https://news.ycombinator.com/item?id="), F.col("c.id"))), "apply_url": link, "location": F.coalesce(F.get(places, F.lit(0)), F.when(remote, "Remote")), "description": "text", "remote_status": F.when(remote, "remote"), "date_posted": posted}
    return _shaped(rows, "hackernews", fields).where(F.coalesce(F.col("date_posted") >= F.lit(now - timedelta(days=THREAD_DAYS)).cast("timestamp_ntz"), F.lit(True)))


def posted_days_ago(text: Column) -> Column:
    """Days of a relative date such as "Posted 3 Days Ago", "Posted Today" or "Posted 30+ Days Ago"."""
    low = F.lower(text)
    return F.when(F.contains(low, F.lit("today")), 0).when(F.contains(low, F.lit("yesterday")), 1).otherwise(F.regexp_extract(low, r"(\d+)\+? days? ago", 1).try_cast("int"))


def union_sources(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
