"""Raw rows normalised, resolved and folded, end to end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls
from ..operators import normalize, provenance, resolve
from ..storage import materialize, table
from . import bindings as b

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _raw(spark, sf):
    """Documents as raw rows: the source is the company, the language the place, the text the description. Some rows lack a company or title."""
    d = table(spark, sf, "documents")
    place = F.element_at(F.create_map(*[F.lit(x) for x in ("en", "Austin / TX", "fr", "Paris, France", "de", "Remote", "es", "Madrid | Spain")]), F.col("lang"))
    return d.select(
        F.col("source"), F.lit("job_board").alias("source_kind"), F.col("doc_id").cast("string").alias("source_job_id"), F.when(F.col("doc_id") % 50 > 0, F.col("source")).alias("company"),
        F.when(F.col("doc_id") % 70 == 0, " ").otherwise(F.concat(F.lit("Hardware Design Intern "), F.col("lang"), F.lit(" REQ-"), (10000 + F.col("doc_id")).cast("string"))).alias("title"),
        place.alias("location"), F.col("text").alias("description"),
    )


_INTERN = r"\b(intern|internship|summer analyst|industrial placement)\b"
_RAW_SQL = """r AS (SELECT *, doc_id % 50 > 0 AND source <> '' AND doc_id % 70 > 0 AS usable, lower(source) AS slug FROM documents)"""


@query(f"""WITH {_RAW_SQL} SELECT CAST(doc_id AS VARCHAR) AS source_job_id, 'hardware design intern ' || lang AS title_core, 'internship' AS employment_type,
(MAP {{'en': 'austin', 'fr': 'paris|', 'de': 'remote', 'es': 'madrid|'}})[lang] AS location_key, (MAP {{'en': 'US', 'fr': 'FR', 'es': 'ES'}})[lang] AS country, CASE WHEN lang = 'en' THEN 'TX' END AS state,
CASE WHEN lang = 'de' THEN 'remote' ELSE 'unknown' END AS remote_status, regexp_matches(text, '\\bph\\.?d\\.?', 'i') AS phd_word FROM r WHERE usable""")
def normalize_listings(spark, sf):
    rows = normalize.normalize_listings(_raw(spark, sf), F.lit(b.NOW).cast("date"))
    phd = F.coalesce(F.col("description").rlike(r"(?i)\bph\.?d\.?"), F.lit(False)).alias("phd_word")
    return rows.select("source_job_id", "title_core", "employment_type", "location_key", "country", "state", "remote_status", phd)


@query(f"WITH {_RAW_SQL} SELECT count(*) FILTER (usable) AS normalized, count(*) FILTER (NOT usable) AS dropped FROM r")
def normalize_drops(spark, sf):
    return normalize.normalize_counts(_raw(spark, sf))


def _listings(spark, sf):
    """Orders as listings of companies (some customers to each), with the identities and facts that the stages look at."""
    o = table(spark, sf, "orders")
    key = lambda when, *parts: F.when(when, F.concat(*parts)).otherwise("")
    of = lambda c, n: (F.col(c) % n).cast("string")
    source = F.concat(F.lit("s"), of("o_custkey", 9))
    kind = F.when(F.col("o_orderstatus") == "O", "internship").when(F.col("o_orderstatus") == "F", "full_time").otherwise("unknown")
    city = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("City"), of("o_orderkey", 2)))
    null = F.lit(None).cast("string")
    place = F.struct(city.alias("city"), null.alias("state"), null.alias("country"), null.alias("metro"), F.lit(False).alias("remote"), F.coalesce(F.concat(F.lower(city), F.lit("|")), F.lit("")).alias("key"))
    return o.select(
        F.col("o_orderkey").alias("node"), source.alias("source"), F.concat(source, F.lit("/"), of("o_custkey", 700), F.lit("/"), of("o_orderkey", 40)).alias("source_key"),
        key(F.col("o_orderkey") % 17 == 0, F.lit("u"), of("o_custkey", 400), F.lit("/"), of("o_orderkey", 3)).alias("canonical_url"), key(F.col("o_orderkey") % 11 == 0, F.lit("g:"), of("o_custkey", 900)).alias("ats_identity"),
        F.concat(F.lit("o"), of("o_custkey", 500)).alias("company_slug"), F.md5(F.concat_ws("|", of("o_custkey", 500), "o_orderpriority")).alias("fingerprint"),
        F.md5(F.concat_ws("|", of("o_custkey", 500), F.floor(F.col("o_totalprice") / 20000).cast("string"))).alias("content_hash"), key(F.col("o_orderkey") % 7 == 0, of("o_orderkey", 5)).alias("requisition_id"),
        F.array().cast("array<string>").alias("discriminators"), kind.alias("employment_type"), place.alias("location"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("date_posted"),
    )


def _stage_sql(key: str, guarded: bool) -> str:
    veto = "AND NOT (a.req <> '' AND b.req <> '' AND a.req <> b.req) AND NOT (a.ats <> '' AND b.ats <> '' AND a.ats <> b.ats) AND NOT (a.source = b.source AND a.url <> '' AND b.url <> '' AND a.url <> b.url) AND NOT (a.kind <> 'unknown' AND b.kind <> 'unknown' AND a.kind <> b.kind) AND NOT (a.city <> '' AND b.city <> '' AND a.city <> b.city) AND a.slug = b.slug" if guarded else ""
    return f"SELECT h.head AS x, b.node AS y FROM l b JOIN (SELECT {key} AS k, min(node) AS head FROM l WHERE {key} <> '' GROUP BY 1) h ON h.k = b.{key} JOIN l a ON a.node = h.head WHERE b.node <> h.head {veto}"


_EDGES = " UNION ".join(_stage_sql(k, g) for k, g in (("source_key", False), ("url", False), ("ats", False), ("fingerprint", True), ("content", True)))
_RESOLVED_SQL = f"""WITH RECURSIVE l AS (SELECT o_orderkey AS node, 's' || o_custkey % 9 AS source, 's' || o_custkey % 9 || '/' || o_custkey % 700 || '/' || o_orderkey % 40 AS source_key,
CASE WHEN o_orderkey % 17 = 0 THEN 'u' || o_custkey % 400 || '/' || o_orderkey % 3 ELSE '' END AS url, CASE WHEN o_orderkey % 11 = 0 THEN 'g:' || o_custkey % 900 ELSE '' END AS ats, 'o' || o_custkey % 500 AS slug,
md5(o_custkey % 500 || '|' || o_orderpriority) AS fingerprint, md5(o_custkey % 500 || '|' || CAST(floor(o_totalprice / 20000) AS BIGINT)) AS content, CASE WHEN o_orderkey % 7 = 0 THEN CAST(o_orderkey % 5 AS VARCHAR) ELSE '' END AS req,
CASE o_orderstatus WHEN 'O' THEN 'internship' WHEN 'F' THEN 'full_time' ELSE 'unknown' END AS kind, CASE WHEN o_orderkey % 3 = 0 THEN 'City' || o_orderkey % 2 ELSE '' END AS city, o_totalprice AS price, o_orderdate AS posted FROM orders),
e1 AS MATERIALIZED ({_EDGES}), e AS MATERIALIZED (SELECT x, y FROM e1 UNION SELECT y, x FROM e1),
w AS (SELECT node AS n, node AS m FROM l UNION SELECT w.n, e.y FROM w JOIN e ON w.m = e.x), c AS (SELECT n AS node, min(m) AS cluster_id FROM w GROUP BY 1)"""


@query(_RESOLVED_SQL + " SELECT node, cluster_id FROM c")
def resolve_listings(spark, sf):
    """Every listing with its cluster, over all stages with their guards."""
    return resolve.resolve(_listings(spark, sf), "node", similar=False)


@query(_RESOLVED_SQL + " SELECT cluster_id, count(*) AS members, min(price) AS lowest, min(posted) AS date_posted FROM c JOIN l USING (node) GROUP BY 1 HAVING count(*) > 1")
def resolve_survivors(spark, sf):
    rows = _listings(spark, sf)
    members = resolve.resolve(rows, "node", similar=False).join(rows, "node")
    folded = members.groupBy("cluster_id").agg(F.count("*").alias("members"), F.min("price").alias("lowest"), F.min("date_posted").alias("date_posted"))
    return folded.where("members > 1")


@query(_RESOLVED_SQL.split("e1 AS")[0].rstrip().rstrip(",") + f", v AS ({_stage_sql('fingerprint', False)}), g AS ({_stage_sql('fingerprint', True)}) SELECT x AS \"left\", y AS \"right\", (x, y) IN (SELECT (x, y) FROM g) AS accepted FROM v")
def merge_provenance(spark, sf):
    """The guarded fingerprint stage: each edge to the head of its group, and whether the guard lets it stand."""
    edges = resolve.guarded_edges(_listings(spark, sf), "fingerprint", "node", "fingerprint", 0.95)
    return edges.select("left", "right", F.col("veto").isNull().alias("accepted"))


@query()
def merge_methods(spark, sf):
    """How each listing came into its cluster: the stage of its lowest edge in the spanning forest of all evidence."""
    rows = _listings(spark, sf)
    links, _ = provenance.evidence(rows, "node", similar=False, doubted=False)
    return provenance.methods(rows, "node", provenance.spanning_forest(links)[0])


@query()
def merge_records(spark, sf):
    """The links that counted, and the refused ones whose ends nothing before them had joined."""
    rows = _listings(spark, sf)
    return provenance.trace(rows, "node", *provenance.evidence(rows, "node", similar=False))[1].select("left", "right", "stage", "confidence", "verdict", "reason")


@query(f"WITH {b.JOBS_SQL} SELECT CAST(job_id AS VARCHAR) AS source_job_id, lower(company) AS company_slug, title AS title_core, CASE WHEN contains(title, 'intern') THEN 'intern' ELSE '' END AS discriminators, employment_type, remote_status, deadline_is_explicit FROM jobs")
def scoreable_rows(spark, sf):
    """Stored jobs as rows that can be scored again."""
    rows = normalize.scoreable(b.jobs(spark, sf).withColumnRenamed("company", "company_name"))
    return rows.select("source_job_id", "company_slug", "title_core", F.array_join("discriminators", ",").alias("discriminators"), "employment_type", "remote_status", "deadline_is_explicit")


#: What the listings of a customer differ in, by key.
_KINDS = ["company_careers", "ats", "job_board", "aggregator", "curated_list", "unknown"]
_TAGS = [["summer"], ["fall", "design"], ["design"], ["verification", "design"], [], []]
_WORDS = ["fpga", "asic", "rtl"]
_SITES = ["https://boards.greenhouse.io/acme/jobs/", "https://www.linkedin.com/jobs/view/", "https://careers.acme.example/"]


def _mixed(spark, sf):
    """Orders as listings of their customers, of all kinds of sources, with titles and bodies alike in part, tags, pay, dates and two urls each."""
    o = table(spark, sf, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda values, at: F.element_at(F.array(*[F.lit(v) if isinstance(v, str) else F.array(*map(F.lit, v)).cast("array<string>") for v in values]), (at + 1).cast("int"))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    kind = F.when(F.col("o_orderstatus") == "O", "internship").when(F.col("o_orderstatus") == "F", "full_time").otherwise("unknown")
    city, null = F.when(k % 3 == 0, text("City", k % 2)), F.lit(None).cast("string")
    place = F.struct(city.alias("city"), null.alias("state"), null.alias("country"), null.alias("metro"), F.lit(False).alias("remote"), F.coalesce(F.concat(F.lower(city), F.lit("|")), F.lit("")).alias("key"))
    rows = o.select(
        k.alias("node"), text("s", k % 9).alias("source"), text("s", k % 9, "/", k).alias("source_key"), pick(_KINDS, k % 6).alias("source_kind"), F.when(k % 17 == 0, text("u", c, "/", k % 3)).otherwise("").alias("canonical_url"),
        F.when(k % 11 == 0, text("g:", c)).otherwise("").alias("ats_identity"), text("o", c).alias("company_slug"), F.md5(text(c, "|", F.col("o_orderpriority"), k % 4)).alias("fingerprint"),
        F.md5(text(c, "|", F.floor(F.col("o_totalprice") / 20000))).alias("content_hash"), F.when(k % 7 == 0, text(k % 5)).otherwise("").alias("requisition_id"), pick(_TAGS, k % 6).alias("discriminators"), kind.alias("employment_type"), place.alias("location"),
        F.array(F.lit("intern"), F.lit("engineer"), pick(_WORDS, k % 3), text("t", F.floor(k / 8) % 2)).alias("title_tokens"),
        F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: text("g", i + F.when(i == 9, k % 4 * 10).otherwise(0))).alias("shingles"), F.col("o_orderdate").alias("date_posted"),
        F.when(k % 2 == 0, F.floor(F.col("o_totalprice") / 1000).cast("double")).alias("salary_min"), F.when(k % 2 == 0, F.floor(F.col("o_totalprice") / 500).cast("double")).alias("salary_max"),
        F.when(k % 5 > 0, F.repeat(text("body ", k, " "), (k % 40).cast("int"))).alias("description"), pick([["c"], ["python", "c"], [], ["rust"]], k % 4).alias("skills"), F.timestamp_add("DAY", k % 60, "o_orderdate").alias("deadline"), (k % 4 == 0).alias("deadline_is_explicit"),
        F.when(k % 3 > 0, F.concat(pick(_SITES, F.floor(k / 3) % 3), k.cast("string"))).otherwise("").alias("apply_url"), F.concat(pick(_SITES, F.floor(k / 5) % 3), F.lit("p"), k.cast("string")).alias("url"),
    )
    return rows.withColumn("location_key", F.col("location.key"))


_AXES = " ".join(
    f"OR (len(list_intersect(a.tags, {x!r})) > 0 AND len(list_intersect(b.tags, {x!r})) > 0 AND list_sort(list_intersect(a.tags, {x!r})) <> list_sort(list_intersect(b.tags, {x!r})))" for x in (["summer", "fall", "spring", "winter"], ["verification", "design", "physical", "analog"])
)
_VETO = f"""(a.slug <> b.slug OR (a.req <> '' AND b.req <> '' AND a.req <> b.req) OR (a.ats <> '' AND b.ats <> '' AND a.ats <> b.ats) OR (a.source = b.source AND a.url <> '' AND b.url <> '' AND a.url <> b.url) {_AXES}
OR (a.kind <> 'unknown' AND b.kind <> 'unknown' AND a.kind <> b.kind) OR (a.city <> '' AND b.city <> '' AND a.city <> b.city))"""
_MIXED_SQL = f"""m AS MATERIALIZED (SELECT o_orderkey AS node, o_orderkey AS k, o_custkey AS c, 's' || o_orderkey % 9 AS source, ({_KINDS!r})[o_orderkey % 6 + 1] AS source_kind, CASE WHEN o_orderkey % 17 = 0 THEN 'u' || o_custkey || '/' || o_orderkey % 3 ELSE '' END AS url,
CASE WHEN o_orderkey % 11 = 0 THEN 'g:' || o_custkey ELSE '' END AS ats, 'o' || o_custkey AS slug, md5(o_custkey || '|' || o_orderpriority || o_orderkey % 4) AS fingerprint, md5(o_custkey || '|' || CAST(floor(o_totalprice / 20000) AS BIGINT)) AS content,
CASE WHEN o_orderkey % 7 = 0 THEN CAST(o_orderkey % 5 AS VARCHAR) ELSE '' END AS req, ([['summer'], ['fall', 'design'], ['design'], ['verification', 'design'], [], []])[o_orderkey % 6 + 1] AS tags, CASE o_orderstatus WHEN 'O' THEN 'internship' WHEN 'F' THEN 'full_time' ELSE 'unknown' END AS kind,
CASE WHEN o_orderkey % 3 = 0 THEN 'City' || o_orderkey % 2 ELSE '' END AS city, ['intern', 'engineer', ({_WORDS!r})[o_orderkey % 3 + 1], 't' || (o_orderkey // 8) % 2] AS title, [CASE WHEN i = 9 THEN 'g' || (9 + o_orderkey % 4 * 10) ELSE 'g' || i END FOR i IN range(10)] AS grams, o_orderdate AS posted,
CASE WHEN o_orderkey % 2 = 0 THEN floor(o_totalprice / 1000) END AS low, CASE WHEN o_orderkey % 2 = 0 THEN floor(o_totalprice / 500) END AS high, CASE WHEN o_orderkey % 5 > 0 THEN repeat('body ' || o_orderkey || ' ', CAST(o_orderkey % 40 AS INT)) END AS description,
([['c'], ['python', 'c'], [], ['rust']])[o_orderkey % 4 + 1] AS skills, o_orderdate + (o_orderkey % 60) * INTERVAL 1 DAY AS deadline, o_orderkey % 4 = 0 AS explicit,
CASE WHEN o_orderkey % 3 > 0 THEN ({_SITES!r})[(o_orderkey // 3) % 3 + 1] || o_orderkey ELSE '' END AS apply_url, ({_SITES!r})[(o_orderkey // 5) % 3 + 1] || 'p' || o_orderkey AS page_url, ([1, 2, 0])[(o_orderkey // 3) % 3 + 1] AS apply_class, ([1, 2, 0])[(o_orderkey // 5) % 3 + 1] AS page_class FROM orders),
blocks AS (SELECT slug FROM m GROUP BY 1 HAVING count(*) BETWEEN 2 AND 60),
pairs AS MATERIALIZED (SELECT a.node AS x, b.node AS y, len(list_intersect(a.title, b.title)) / greatest(len(a.title), len(b.title)) AS t, len(list_intersect(a.grams, b.grams)) AS shared, a.req <> '' AND a.req = b.req AS same_req, a.city <> '' AND a.city = b.city AS same_place,
  abs(floor(epoch(a.posted - b.posted) / 86400)) AS days, coalesce(a.low <> 0 AND abs(a.low - b.low) < 0.01, false) AS same_pay FROM m a JOIN m b ON a.slug = b.slug AND a.node < b.node SEMI JOIN blocks ON blocks.slug = a.slug WHERE NOT {_VETO}),
s1 AS (SELECT *, 0.55 * t + 0.45 * (shared / (20 - shared)) AS s FROM pairs), s2 AS (SELECT *, CASE WHEN same_req THEN least(1, s + 0.25) ELSE s END AS s_req FROM s1), s3 AS (SELECT *, CASE WHEN same_place THEN least(1, s_req + 0.05) ELSE s_req END AS s_place FROM s2),
s4 AS (SELECT *, CASE WHEN days <= 3 THEN least(1, s_place + 0.03) WHEN days > 90 THEN s_place - 0.05 ELSE s_place END AS s_days FROM s3),
alike AS MATERIALIZED (SELECT x, y, greatest(0, least(1, CASE WHEN same_pay THEN least(1, s_days + 0.04) ELSE s_days END)) AS score FROM s4)"""


@query(f"WITH {_MIXED_SQL} SELECT x AS \"left\", y AS \"right\", round(score, 6) AS score, CASE WHEN score >= 0.88 THEN 'merge' ELSE 'uncertain' END AS verdict FROM alike WHERE score >= 0.7")
def similar_listings(spark, sf):
    """Pairs of a company that are alike by title, body, requisition, place, dates and pay, and that no guard keeps apart."""
    pairs = resolve.similar_pairs(_mixed(spark, sf), "company_slug", "node", resolve.pair_score, resolve.axes_veto)
    return pairs.select("left", "right", F.round("score", 6).alias("score"), "verdict")


def _star_sql(key: str, guarded: bool) -> str:
    return f"SELECT a.node AS x, b.node AS y FROM m b JOIN (SELECT {key} AS k, min(node) AS head FROM m WHERE {key} <> '' GROUP BY 1) h ON h.k = b.{key} JOIN m a ON a.node = h.head WHERE b.node <> h.head {f'AND NOT {_VETO}' if guarded else ''}"


_MIXED_EDGES = " UNION ".join([*(_star_sql(k, g) for k, g in (("url", False), ("ats", False), ("fingerprint", True), ("content", True))), "SELECT x, y FROM alike WHERE score >= 0.88"])


@query(f"""WITH RECURSIVE {_MIXED_SQL}, e1 AS MATERIALIZED ({_MIXED_EDGES}), e AS MATERIALIZED (SELECT x, y FROM e1 UNION SELECT y, x FROM e1), w AS (SELECT node AS n, node AS to_ FROM m UNION SELECT w.n, e.y FROM w JOIN e ON w.to_ = e.x), c AS (SELECT n AS node, min(to_) AS cluster_id FROM w GROUP BY 1),
r AS (SELECT m.*, cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY list_position({_KINDS!r}, source_kind), CASE WHEN length(coalesce(description, '')) > 200 THEN 0 ELSE 1 END, length(coalesce(description, '')) DESC, source, m.node) AS rk FROM m JOIN c ON c.node = m.node),
u AS (SELECT cluster_id, apply_url AS u, apply_class AS cls, list_position({_KINDS!r}, source_kind) AS kd, 0 AS p, rk FROM r WHERE apply_url <> '' UNION ALL SELECT cluster_id, page_url, page_class, list_position({_KINDS!r}, source_kind), 1, rk FROM r),
best AS (SELECT cluster_id, u, cls, row_number() OVER (PARTITION BY cluster_id ORDER BY cls, kd, p, rk) AS rn FROM u)
SELECT r.cluster_id, count(*) AS members, arg_min(source, rk) AS source, arg_min(source_kind, rk) AS source_kind, md5(coalesce(arg_min(description, rk) FILTER (description <> ''), '')) AS description, arg_min(low, rk) FILTER (low IS NOT NULL) AS salary_min, arg_min(high, rk) FILTER (low IS NOT NULL) AS salary_max,
min(posted) AS date_posted, coalesce(arg_min(deadline, rk) FILTER (explicit), arg_min(deadline, rk)) AS deadline, coalesce(arg_min(kind, rk) FILTER (kind <> 'unknown'), '') AS employment_type, coalesce(arg_min(req, rk) FILTER (req <> ''), '') AS requisition_id,
array_to_string(list_sort(list_distinct(flatten(list(skills)))), ',') AS skills, any_value(b.u) AS application_url, (['company_careers', 'ats', 'job_board'])[any_value(b.cls) + 1] AS host_class, arg_min(page_url, rk) AS posting_url
FROM r JOIN best b ON b.cluster_id = r.cluster_id AND b.rn = 1 GROUP BY 1""")
def cluster_records(spark, sf):
    """One record for each cluster over all stages: who speaks for it, what each member adds, and where to apply."""
    rows = _mixed(spark, sf)
    members = materialize(resolve.resolve(rows, "node").join(rows, "node"), "members")
    body = F.coalesce("description", F.lit(""))
    members = members.withColumn("rank", resolve.authority_rank("cluster_id", F.col("source_kind"), body, F.col("source"), "node"))
    folded = resolve.fold(members, "cluster_id", "rank").join(resolve.with_urls(members, "cluster_id", "rank", urls.classify_host), "cluster_id")
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return folded.select(
        "cluster_id", "members", "source", "source_kind", F.md5(blank("description")).alias("description"), "salary_min", "salary_max", "date_posted", "deadline", blank("employment_type"), blank("requisition_id"),
        F.array_join(F.array_sort("skills"), ",").alias("skills"), "application_url", "host_class", "posting_url",
    )
