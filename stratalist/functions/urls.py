"""URL functions: canonical form, hash, host class and board identity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, words_array

# Parameters and hosts that decide which urls are one posting.
TRACKING_PARAMS = (
    "utm_source utm_medium utm_campaign utm_term utm_content utm_id utm_name utm_cid utm_reader utm_referrer gclid fbclid msclkid dclid yclid igshid mc_cid mc_eid ref referrer "
    "referer source src campaign trk trkinfo originalsubdomain position pagenum refid rgtk sessionid session_id sid phpsessid jsessionid affiliate affiliateid aff partner "
    "partnerid from at et clickid click_id impressionid recommended eid tk vjk jsa advn sjdu hl gh_src lever_source lever-source lever_via ashby_jid_source source_id iis iisn spa"
).split()
MEANINGFUL_PARAMS = {
    "greenhouse.io": ["gh_jid", "token"], "myworkdayjobs.com": ["jobid"], "icims.com": ["jobid", "job_id"], "taleo.net": ["job", "rid", "jobid"], "smartrecruiters.com": ["oga"],
    "linkedin.com": ["currentjobid"], "indeed.com": ["jk"], "glassdoor.com": ["joblistingid"], "ziprecruiter.com": ["lvk"], "google.com": ["htidocid"],
}
REDIRECT_HOSTS = ["click.appcast.io", "www.google.com", "l.facebook.com", "lnkd.in", "t.co"]
REDIRECT_PARAMS = ["url", "u", "redirect", "target", "dest", "destination", "q"]
REDIRECT_HOPS = 4
ATS_HOSTS = (
    "greenhouse.io lever.co ashbyhq.com smartrecruiters.com workable.com myworkdayjobs.com icims.com jobvite.com recruitee.com taleo.net rippling.com bamboohr.com eightfold.ai "
    "successfactors.com brassring.com avature.net"
).split()
BOARD_HOSTS = (
    "linkedin.com indeed.com glassdoor.com ziprecruiter.com monster.com dice.com simplyhired.com careerbuilder.com adzuna.com themuse.com remotive.com arbeitnow.com wellfound.com "
    "angel.co builtin.com wayup.com handshake.com jooble.org google.com talent.com lensa.com jobs2careers.com simplify.jobs untapped.io ripplematch.com"
).split()
#: Provider, pattern of the board, pattern of the job (both with one group); the first provider whose board is found wins.
PROVIDERS = [
    ("lever", r"(?i)jobs\.(?:eu\.)?lever\.co/([A-Za-z0-9_.-]+)", r"(?i)jobs\.(?:eu\.)?lever\.co/[A-Za-z0-9_.-]+/([A-Za-z0-9-]+)"),
    ("ashby", r"(?i)jobs\.ashbyhq\.com/([A-Za-z0-9_.-]+)", r"(?i)jobs\.ashbyhq\.com/[A-Za-z0-9_.-]+/([A-Za-z0-9-]{20,})"),
    ("smartrecruiters", r"(?i)api\.smartrecruiters\.com/v1/companies/([A-Za-z0-9_-]+)", None),
    ("smartrecruiters", r"(?i)(?:jobs|careers)\.smartrecruiters\.com/([A-Za-z0-9_-]+)", r"(?i)(?:jobs|careers)\.smartrecruiters\.com/[A-Za-z0-9_-]+/(\d+)"),
    ("workable", r"(?i)apply\.workable\.com/([A-Za-z0-9_-]+)", r"(?i)apply\.workable\.com/[A-Za-z0-9_-]+/j/([A-Za-z0-9]+)"),
    ("workday", r"(?i)https?://([a-z0-9-]+)\.wd\d+\.myworkdayjobs\.com/[^/?#]+", r"(?i)myworkdayjobs\.com/(?:[a-z]{2}-[A-Z]{2}/)?[^/?#]+/job/[^/?#]+/([^/?#]+)"),
    ("icims", r"(?i)https?://(?:careers-)?([a-z0-9-]+)\.icims\.com", r"(?i)\.icims\.com.*?/jobs/(\d+)"),
    ("jobvite", r"(?i)jobs\.jobvite\.com/([A-Za-z0-9_-]+)", r"(?i)jobs\.jobvite\.com/[A-Za-z0-9_-]+/job/([A-Za-z0-9]+)"),
    ("recruitee", r"(?i)([A-Za-z0-9-]+)\.recruitee\.com/o/[A-Za-z0-9-]+", r"(?i)\.recruitee\.com/o/([A-Za-z0-9-]+)"),
    ("rippling", r"(?i)ats\.rippling\.com/(?:[a-z-]+/)?([A-Za-z0-9_-]+)/jobs/[A-Za-z0-9-]+", r"(?i)ats\.rippling\.com/(?:[a-z-]+/)?[A-Za-z0-9_-]+/jobs/([A-Za-z0-9-]+)"),
    ("bamboohr", r"(?i)([A-Za-z0-9-]+)\.bamboohr\.com/(?:careers|jobs)/", r"(?i)\.bamboohr\.com/(?:careers|jobs)/(\d+)"),
    ("eightfold", r"(?i)([A-Za-z0-9-]+)\.eightfold\.ai/careers", None),
    ("taleo", r"(?i)([A-Za-z0-9-]+)\.taleo\.net", None),
]


def _part(url: Column, i: int) -> Column:
    """1 host with port, 2 path, 3 query, of an absolute url."""
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)([^?#]*)(?:\?([^#]*))?", i)


def _decoded(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), text)


def _parameters(query: Column) -> Column:
    """Structs (key, value) of parameters with a value, decoded."""
    pairs = F.filter(F.split(query, "&"), lambda p: p.rlike("^[^=]*=."))
    return F.transform(pairs, lambda p: F.struct(_decoded(F.substring_index(p, "=", 1)).alias("key"), _decoded(F.regexp_replace(p, "^[^=]*=", "")).alias("value")))


def _one_hop(url: Column) -> Column:
    def target(found: Column, host: Column) -> Column:
        out = []
        for name in REDIRECT_PARAMS:
            value = _decoded(F.get(F.transform(F.filter(found, _named(name)), lambda p: p["value"]), F.lit(0)))
            elsewhere = host.isin(REDIRECT_HOSTS) | (F.lower(_part(value, 1)) != host)
            out.append(F.when(value.rlike("^https?://") & elsewhere, value))
        return F.coalesce(*out, url)

    return let(_parameters(_part(url, 3)), lambda found: let(F.lower(_part(url, 1)), lambda host: target(found, host)))


def unwrap_redirect(url: Column) -> Column:
    """The destination that a wrapper url carries in its query, up to four hops deep."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(REDIRECT_HOPS)), url, lambda u, _: F.when(_part(u, 3).rlike("(?i)http"), _one_hop(u)).otherwise(u))


def _named(name: str):
    return lambda p: F.lower(p["key"]) == name


def canonicalize_url(url: Column, *, unwrap: bool = True) -> Column:
    """https, lower-case host without www or default port, sorted meaningful parameters, no trailing slash or fragment."""
    def canonical(u: Column) -> Column:
        host = F.regexp_replace(F.regexp_replace(F.lower(_part(u, 1)), r"^www\.", ""), ":(80|443)$", "")
        return let(host, lambda h: F.when(h != "", F.concat(F.lit("https://"), h, _path(u), _query(u, h))))

    u = F.trim(url)
    u = F.when(u.startswith("//"), F.concat(F.lit("https:"), u)).otherwise(u)
    u = F.when(u.rlike("^https?://"), u).otherwise(F.concat(F.lit("https://"), u))
    if unwrap:
        u = F.when(_part(u, 3).rlike("(?i)http"), unwrap_redirect(u)).otherwise(u)
    return F.when(F.length(F.trim(url)) > 0, let(u, canonical))


def _path(u: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(_part(u, 2), "/+$", ""), F.lit("")), F.lit("/"))


def _query(u: Column, host: Column) -> Column:
    """The meaningful parameters, sorted and encoded, with their question mark."""
    keep = F.array().cast("array<string>")
    for domain, names in MEANINGFUL_PARAMS.items():
        keep = F.when(F.contains(host, F.lit(domain)), words_array(names)).otherwise(keep)

    def kept(p: Column) -> Column:
        key = F.lower(p["key"])
        return F.array_contains(keep, key) | ~(key.isin(TRACKING_PARAMS) | key.startswith("utm_"))

    found = F.array_sort(F.filter(_parameters(_part(u, 3)), kept))
    query = F.array_join(F.transform(found, lambda p: F.concat(F.url_encode(p["key"]), F.lit("="), F.url_encode(p["value"]))), "&")
    return F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")


def url_hash(url: Column) -> Column:
    return F.sha1(canonicalize_url(url))


def _under(host: Column, domains: list[str]) -> Column:
    return F.exists(words_array(domains), lambda d: (host == d) | host.endswith(F.concat(F.lit("."), d)))


def classify_host(url: Column) -> Column:
    """ats, job_board, company_careers or unknown."""
    host = F.lower(_part(F.when(F.contains(url, F.lit("://")), url).otherwise(F.concat(F.lit("https://"), url)), 1))
    host = F.regexp_replace(host, r"^www\.", "")
    return F.when(url.isNull() | (host == ""), "unknown").when(_under(host, ATS_HOSTS), "ats").when(_under(host, BOARD_HOSTS), "job_board").otherwise("company_careers")


def ats_identity(url: Column) -> Column:
    """Struct (provider, board, job) of a posting on a known system, or null."""
    some = lambda pattern: F.nullif(F.regexp_extract(url, pattern, 1), F.lit(""))
    board = some(r"(?i)(?:job-boards|boards|boards-api)\.greenhouse\.io/(?:embed/job_app\?for=)?([A-Za-z0-9_-]+)")
    board = F.when(F.lower(board) == "embed", F.coalesce(some(r"(?i)[?&]for=([A-Za-z0-9_-]+)"), board)).otherwise(board)
    jid = some(r"(?i)[?&]gh_jid=(\d+)")
    own = F.split(F.regexp_replace(F.lower(_part(url, 1)), r"^www\.", ""), r"\.")[0]
    out = F.when(board.isNotNull(), _identity("greenhouse", board, F.coalesce(some(r"/jobs/(\d+)"), jid))).when(jid.isNotNull(), _identity("greenhouse", own, jid))
    for provider, board_at, job_at in PROVIDERS:
        job = some(job_at) if job_at else F.lit(None).cast("string")
        if provider == "workday":
            job = F.coalesce(F.nullif(F.regexp_extract(job, r"(?i)_(R-?\d[\w-]*)\b", 1), F.lit("")), job)
        found = F.lower(some(board_at)) if provider == "workday" else some(board_at)
        out = out.when(found.isNotNull(), _identity(provider, found, job))
    return out


def _identity(provider: str, board: Column, job: Column) -> Column:
    return F.struct(F.lit(provider).alias("provider"), board.alias("board"), job.alias("job"))


def ats_key(identity: Column) -> Column:
    """``provider:board:job`` where all are known."""
    return F.when(identity["job"].isNotNull(), F.lower(F.concat_ws(":", identity["provider"], identity["board"], identity["job"])))
