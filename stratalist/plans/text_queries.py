"""Queries of text, URL, fact, resolution and score functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import facts, html, text, urls
from ..operators import prefilter as pre
from ..operators import resolve, score
from ..sources import payloads
from ..storage import table
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


#: What normalising text without accents is in SQL.
NORM = r"trim(regexp_replace(lower({0}), '\s+', ' ', 'g'))"
HOST = r"regexp_replace(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)), '^www\.', ''), ':(80|443)$', '')"


def _core_sql(title: str) -> str:
    t = rf"regexp_replace(regexp_replace({title}, '[\(\[\{{][^\)\]\}}]*[\)\]\}}]', ' ', 'g'), '\b[A-Z]{{1,4}}[-_]?\d{{4,}}\b', ' ', 'g')"
    t = f"regexp_replace(translate({NORM.format(t)}, '/-,', '   '), '{text.TITLE_NOISE}', ' ', 'g')"
    return rf"trim(regexp_replace(regexp_replace({t}, '[^a-z0-9+#. ]', ' ', 'g'), '\s+', ' ', 'g'))"


PART_TITLE = "p_name || ' (' || p_brand || ') ' || p_type || ' Engineering/Design Intern - Summer 2026 REQ-' || CAST(10000 + p_partkey AS VARCHAR)"


def _part_titles(spark, sf):
    p = table(spark, sf, "part")
    title = F.concat("p_name", F.lit(" ("), "p_brand", F.lit(") "), "p_type", F.lit(" Engineering/Design Intern - Summer 2026 REQ-"), (F.col("p_partkey") + 10000).cast("string"))
    return p.select("p_partkey", title.alias("title"))


@query(f"SELECT p_partkey, {_core_sql(PART_TITLE)} AS core FROM part")
def title_normalize(spark, sf):
    return _part_titles(spark, sf).select("p_partkey", text.title_core(F.col("title")).alias("core"))


@query(f"WITH t AS (SELECT p_partkey, {_core_sql(PART_TITLE)} AS core FROM part) SELECT p_partkey, list_sort(list_distinct(list_filter(string_split(core, ' '), lambda w: length(w) > 1))) AS tokens FROM t")
def title_tokens(spark, sf):
    return _part_titles(spark, sf).select("p_partkey", F.array_sort(text.title_tokens(text.title_core(F.col("title")))).alias("tokens"))


_FOLDED = r"SELECT doc_id, md5(trim(regexp_replace(lower(strip_accents(text)), '\s+', ' ', 'g'))) AS digest FROM documents"


@query(_FOLDED)
def text_normalize(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.normalize_text(F.col("text"))).alias("digest"))


@query(_FOLDED.replace("SELECT doc_id, md5(", "SELECT doc_id, length(").replace("AS digest", "AS n_chars"))
def text_normalize_accents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.length(text.normalize_text(F.col("text"))).cast("long").alias("n_chars"))


_GROUPS = "[" + ", ".join("CASE WHEN " + " OR ".join("contains(hay, '" + n.replace("'", "''") + "')" for n in needles) + f" THEN '{g}' END" for g, needles in sorted(text.DISCRIMINATORS.items())) + "]"


@query(f"WITH t AS (SELECT p_partkey, ' ' || {NORM.format(PART_TITLE)} || ' ' AS hay FROM part) SELECT p_partkey, array_to_string(list_filter({_GROUPS}, lambda g: g IS NOT NULL), ',') AS groups FROM t")
def discriminators(spark, sf):
    return _part_titles(spark, sf).select("p_partkey", F.array_join(text.discriminators(text.normalize_text(F.col("title"))), ",").alias("groups"))


ROLES = [("Hardware Design Engineer Intern", 1.0), ("Widget Engineer", 1.5), ("Bolt Development", 0.5)]


def _map_sql(table: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in table.items()) + "}"


def _role_sql(role: str) -> str:
    """The affinity of ``tokens`` to a role: the weighted share of its words that are there, and how few others there are."""
    own = text.role_words(role)
    anchors = [w for w in own if w not in text.GENERIC_ROLE_WORDS] or own
    weight = {w: text.GENERIC_WEIGHT if w in text.GENERIC_ROLE_WORDS else 1.0 for w in own}
    got = " + ".join(f"CASE WHEN list_contains(tokens, '{w}') THEN {x} ELSE 0 END" for w, x in weight.items())
    off = f"len(tokens) = 0 OR list_has_any(tokens, {text.FOREIGN_DISCIPLINES!r}) OR NOT list_has_any(tokens, {anchors!r})"
    return f"CASE WHEN {off} THEN 0.0 ELSE ({got}) / {sum(weight.values())} * (0.75 + 0.25 * len(list_intersect(tokens, {own!r})) / len(tokens)) END"


_ROLES_SQL = f"""WITH w AS (SELECT p_partkey, [x FOR x IN string_split({_core_sql(PART_TITLE)}, ' ') IF length(x) > 1] AS words FROM part),
s AS (SELECT p_partkey, [coalesce({_map_sql(text.ROLE_STEMS)}[x], x) FOR x IN words] AS stems FROM w),
t AS (SELECT p_partkey, list_distinct([coalesce({_map_sql(text.ROLE_SYNONYMS)}[x], x) FOR x IN stems IF NOT list_contains({text.ROLE_STOPWORDS!r}, x)]) AS tokens FROM s)
SELECT p_partkey, {", ".join(f"round({_role_sql(r)}, 6) AS role_{i}" for i, (r, _) in enumerate(ROLES))} FROM t"""


@query(_ROLES_SQL)
def role_affinity(spark, sf):
    """Every title against every role of the preferences."""
    t = _part_titles(spark, sf).withColumn("tokens", text.role_tokens(text.title_core(F.col("title"))))
    return t.select("p_partkey", *[F.round(text.role_affinity(F.col("tokens"), r), 6).alias(f"role_{i}") for i, (r, _) in enumerate(ROLES)])


@query(r"""WITH w AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM w)
SELECT doc_id, len(g) AS n_shingles, md5(array_to_string(list_sort(CASE WHEN len(g) <= 150 THEN g ELSE list_transform(list_sort(list_transform(g, lambda x: md5(x) || x))[1:150], lambda y: y[33:]) END), '|')) AS digest FROM g""")
def shingle_set(spark, sf):
    d = table(spark, sf, "documents")
    s = d.select("doc_id", text.grams_of()(text.normalize_ascii(F.col("text"))).alias("s"))
    return s.select("doc_id", F.col("s.n").alias("n_shingles"), F.md5(F.array_join("s.lowest", "|")).alias("digest"))


@query("SELECT o_orderkey, left(sha256(lower(trim(c_name)) || '|' || lower(trim(o_orderpriority)) || '|' || lower(trim(c_mktsegment)) || '|'), 32) AS fingerprint FROM orders JOIN customer ON o_custkey = c_custkey")
def fingerprint(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    rows = o.join(c, o["o_custkey"] == c["c_custkey"])
    return rows.select("o_orderkey", text.fingerprint(F.col("c_name"), F.col("o_orderpriority"), F.col("c_mktsegment"), F.lit(None).cast("string")).alias("fingerprint"))


@query("SELECT doc_id, sha256(lower(trim(text))) AS content_hash FROM documents")
def content_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.sha256_of(F.col("text")).alias("content_hash"))


_TRACKED = ", ".join(f"'{p}'" for p in urls.TRACKING_PARAMS)
_CANON = rf"""SELECT page_id, url, 'https://' || {HOST} || CASE WHEN regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/+$', '') = '' THEN '/' ELSE regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/+$', '') END
|| CASE WHEN len(kept) > 0 THEN '?' || array_to_string(list_sort(kept), '&') ELSE '' END AS canonical FROM (SELECT page_id, url, list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p: regexp_matches(p, '^[^=]*=.') AND NOT (lower(split_part(p, '=', 1)) IN ({_TRACKED}) OR starts_with(lower(split_part(p, '=', 1)), 'utm_'))) AS kept FROM pages)"""


@query(f"SELECT page_id, canonical FROM ({_CANON})")
def url_canonicalize(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.canonicalize_url(F.col("url")).alias("canonical"))


@query(f"SELECT page_id, sha1(canonical) AS url_hash FROM ({_CANON})")
def url_hash(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.url_hash(F.col("url")).alias("url_hash"))


@query(rf"WITH h AS (SELECT page_id, {HOST} AS host FROM pages) SELECT page_id, CASE WHEN host = '' THEN 'unknown' ELSE 'company_careers' END AS host_class FROM h")
def url_host_class(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.classify_host(F.col("url")).alias("host_class"))


_WORD = "regexp_extract(url, '://(?:www\\.|m\\.|blog\\.)?([a-z-]+)', 1)"
_NUMBER = "regexp_extract(url, '/([0-9]+)', 1)"


@query(f"""WITH p AS (SELECT page_id, url, {_WORD} AS w, {_NUMBER} AS n FROM pages)
SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'greenhouse:' || w || ':' || n WHEN 1 THEN 'lever:' || w || ':' || n WHEN 2 THEN 'greenhouse:' || w || ':' || n END AS ats_key, CASE WHEN page_id % 4 < 2 THEN 'ats' ELSE 'company_careers' END AS host_class FROM p WHERE w <> '' AND n <> ''""")
def ats_identity_extract(spark, sf):
    """Postings at three shapes of board url, with the word and the number of each page's own url; every fourth url stays as it is."""
    p = table(spark, sf, "pages")
    w, n = F.regexp_extract("url", r"://(?:www\.|m\.|blog\.)?([a-z-]+)", 1), F.regexp_extract("url", "/([0-9]+)", 1)
    p = p.withColumns({"w": w, "n": n}).where("w <> '' and n <> ''")
    made = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("https://boards.greenhouse.io/"), "w", F.lit("/jobs/"), "n", F.lit("?gh_src=x")))
    made = made.when(F.col("page_id") % 4 == 1, F.concat(F.lit("https://jobs.lever.co/"), "w", F.lit("/"), "n"))
    made = made.when(F.col("page_id") % 4 == 2, F.concat(F.lit("https://"), "w", F.lit(".com/careers?gh_jid="), "n")).otherwise(F.col("url"))
    return p.withColumn("u", made).select("page_id", urls.ats_key(urls.ats_identity(F.col("u"))).alias("ats_key"), urls.classify_host(F.col("u")).alias("host_class"))


@query(r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '<(script|style)\b.*?</(script|style)\s*>', ' ', 'gis'), '<!--.*?-->', ' ', 'gs') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '<li\b[^>]*>', chr(10) || '* ', 'gi'), '</?(br|p|div|h[1-4]|li|ul|ol|tr|table)\b[^>]*>', chr(10), 'gi'), '<[^>]*>', ' ', 'g') AS t FROM a),
c AS (SELECT page_id, regexp_replace(replace(replace(replace(replace(replace(replace(replace(t, '&copy;', '©'), '&middot;', '·'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;?', '&', 'g') AS t FROM b)
SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), '\n\s*\n+', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS digest FROM c""")
def html_strip(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(html.strip_html(F.col("html"))).alias("digest"))


def _postings(spark, sf):
    """A posting for each order, all of whose facts are values of its row."""
    o = table(spark, sf, "orders")
    text_of = lambda c: F.col(c).cast("string")
    pay = F.floor("o_totalprice").cast("long")
    money = F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("Pay is $"), (10 + F.col("o_custkey") % 300).cast("string"), F.lit(" - $"), (400 + F.col("o_custkey") % 90).cast("string"), F.lit(" per hour.")))
    money = money.when(F.col("o_custkey") % 3 == 1, F.concat(F.lit("Salary: $"), (10000 + pay).cast("string"), F.lit(" to $"), (20000 + pay).cast("string"), F.lit(" annually."))).otherwise("Pay is good.")
    season = F.element_at(F.array(*map(F.lit, ["Winter", "spring", "SUMMER", "autumn"])), F.quarter("o_orderdate"))
    years = F.concat((1 + F.col("o_custkey") % 40).cast("string"), F.lit("+ years of "), F.lower("o_orderpriority"), F.lit(" experience"))
    close = F.concat(F.lit("Apply by "), F.date_format("o_orderdate", "MMMM d, yyyy"))
    degree = F.element_at(F.array(*map(F.lit, ["Bachelor's", "M.S. or PhD", "an MBA", "BS, MS"])), (F.col("o_orderkey") % 4 + 1).cast("int"))
    visa = F.element_at(F.array(*map(F.lit, ["We will sponsor visas for clerk ", "No visa sponsorship; clerk ", "Secret clearance, says clerk ", "Ask clerk "])), (F.col("o_custkey") % 4 + 1).cast("int"))
    return o.select("o_orderkey", "o_orderdate", F.concat_ws("\n", money, F.concat(season, F.lit(" "), F.year("o_orderdate").cast("string"), F.lit(" term")), years, close, F.concat(F.lit("Wanted: "), degree), F.concat(visa, text_of("o_custkey"))).alias("said"))


@query("SELECT o_orderkey, CASE o_custkey % 3 WHEN 0 THEN 10.0 + o_custkey % 300 WHEN 1 THEN 10000.0 + floor(o_totalprice) END AS salary_min, CASE o_custkey % 3 WHEN 0 THEN 400.0 + o_custkey % 90 WHEN 1 THEN 20000.0 + floor(o_totalprice) END AS salary_max, CASE o_custkey % 3 WHEN 0 THEN 'hourly' WHEN 1 THEN 'yearly' END AS period FROM orders")
def fact_salary(spark, sf):
    rows = _postings(spark, sf).withColumn("s", facts.salary(F.col("said")))
    # A bare number may read as pay (a year does); only what is stated in dollars counts here.
    stated = lambda c: F.when(F.col("s.currency") == "USD", F.col(f"s.{c}"))
    return rows.select("o_orderkey", stated("min").alias("salary_min"), stated("max").alias("salary_max"), stated("period").alias("period"))


@query("SELECT o_orderkey, (['Winter', 'Spring', 'Summer', 'Fall'])[quarter(o_orderdate)] || CASE WHEN year(o_orderdate) >= 2000 THEN ' ' || year(o_orderdate) ELSE '' END AS terms FROM orders")
def fact_terms(spark, sf):
    return _postings(spark, sf).select("o_orderkey", F.array_join(facts.terms(F.col("said")), ",").alias("terms"))


@query("SELECT o_orderkey, (['Bachelors', 'Masters,PhD', 'MBA', 'Bachelors,Masters'])[o_orderkey % 4 + 1] AS degrees FROM orders")
def fact_degrees(spark, sf):
    return _postings(spark, sf).select("o_orderkey", F.array_join(facts.degrees(F.col("said")), ",").alias("degrees"))


@query("SELECT o_orderkey, CASE WHEN 1 + o_custkey % 40 <= 30 THEN 1.0 + o_custkey % 40 END AS years FROM orders")
def fact_years(spark, sf):
    return _postings(spark, sf).select("o_orderkey", facts.experience_years(F.col("said")).alias("years"))


@query("SELECT o_orderkey, (['offered', 'not_offered', 'security_clearance_required', 'unknown'])[o_custkey % 4 + 1] AS sponsorship FROM orders")
def fact_sponsorship(spark, sf):
    return _postings(spark, sf).select("o_orderkey", facts.sponsorship(F.col("said")).alias("sponsorship"))


@query("SELECT o_orderkey, CASE WHEN CAST(o_orderdate AS DATE) BETWEEN DATE '1999-12-03' AND DATE '2002-01-01' THEN date_trunc('day', o_orderdate) + INTERVAL 86399 SECOND WHEN CAST(o_orderdate AS DATE) + INTERVAL 1 YEAR BETWEEN DATE '1999-12-03' AND DATE '2002-01-01' AND CAST(o_orderdate AS DATE) < DATE '1999-07-06' THEN date_trunc('day', o_orderdate) + INTERVAL 1 YEAR + INTERVAL 86399 SECOND END AS deadline FROM orders")
def fact_deadline(spark, sf):
    return _postings(spark, sf).select("o_orderkey", facts.deadline(F.col("said"), F.lit("2000-01-02").cast("date")).alias("deadline"))


_INTERN, _GRAD = r"\b(intern|internship|summer analyst|industrial placement)\b", r"\b(new grad|university grad|early career|campus hire|graduate program)\b"


@query(rf"SELECT doc_id, CASE WHEN regexp_matches(text, '{_INTERN}', 'i') THEN 'internship' WHEN regexp_matches(text, '{_GRAD}', 'i') THEN 'new_grad' WHEN contains(lower(source), 'part-time') THEN 'part_time' ELSE 'unknown' END AS employment_type, CASE WHEN regexp_matches(text, '\bhybrid\b', 'i') THEN 'hybrid' WHEN regexp_matches(text, '\b(remote|work from home|wfh|virtual|telecommute)\b', 'i') THEN 'remote' WHEN regexp_matches(text, '\b(on[\s-]?site|in[\s-]?office|in person)\b', 'i') THEN 'onsite' ELSE 'unknown' END AS remote_status FROM documents")
def fact_employment(spark, sf):
    """Over whole documents."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", facts.employment_type(F.col("source"), F.col("text"), F.lit(None).cast("string")).alias("employment_type"), facts.remote_status(F.col("text")).alias("remote_status"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN 'GB' WHEN s_suppkey % 3 = 0 THEN 'US' ELSE n_name END AS country,
CASE WHEN s_suppkey % 3 = 0 THEN 'TX' END AS state, CASE WHEN s_suppkey % 5 = 0 THEN 'austin' ELSE 'supplier#' || CAST(s_suppkey AS VARCHAR) || '|' || CASE WHEN s_suppkey % 3 = 0 THEN 'tx' ELSE '' END END AS location_key FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def fact_location(spark, sf):
    """Places made of suppliers and nations, with commas, slashes and bars between. With a known country after it, a state stays what it is."""
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    mark = F.element_at(F.array(*map(F.lit, [", ", " / ", "|"])), (F.col("s_suppkey") % 3 + 1).cast("int"))
    city = F.when(F.col("s_suppkey") % 5 == 0, "Austin").otherwise(F.concat(F.lit("Supplier#"), F.col("s_suppkey").cast("string")))
    raw = F.concat(city, F.when(F.col("s_suppkey") % 3 == 0, F.concat(mark, F.lit("Texas"))).otherwise(""), mark, F.when(F.col("s_suppkey") % 7 == 0, "United Kingdom").otherwise(F.col("n_name")))
    at = s.join(n, s["s_nationkey"] == n["n_nationkey"]).select("s_suppkey", facts.parse_location(raw).alias("at"))
    return at.select("s_suppkey", "at.country", "at.state", F.col("at.key").alias("location_key"))


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS cluster_id FROM documents")
def dedup_exact(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("content"))
    edges = resolve.star_edges(d, "content", "doc_id", "content_hash", 0.97)
    return resolve.clusters(d, "doc_id", edges.select("left", "right"))


@query("""WITH h AS (SELECT md5(text) AS c, min(doc_id) AS head FROM documents GROUP BY 1 HAVING count(*) > 1)
SELECT h.head AS "left", d.doc_id AS "right", CASE WHEN a.lang <> d.lang THEN 'employment' END AS veto FROM documents d JOIN h ON md5(d.text) = h.c JOIN documents a ON a.doc_id = h.head WHERE d.doc_id <> h.head""")
def dedup_content_guarded(spark, sf):
    """Content edges with the reason for which the guard would refuse them; the language stands for the kind of employment."""
    d = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("content"), F.lit("one").alias("company_slug"), F.lit("").alias("requisition_id"), F.lit("").alias("ats_identity"), F.lit("").alias("canonical_url"), F.col("lang").alias("employment_type"), facts.parse_location(F.lit("")).alias("location"), F.array().cast("array<string>").alias("discriminators"), "source")
    edges = resolve.star_edges(d, "content", "doc_id", "content_hash", 0.97).alias("e")
    rows = edges.join(d.alias("a"), F.col("a.doc_id") == F.col("left")).join(d.alias("b"), F.col("b.doc_id") == F.col("right"))
    return rows.select("left", "right", resolve.merge_veto(resolve.side("a"), resolve.side("b")).alias("veto"))


_TOK = r"list_distinct(list_filter(string_split(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), ' '), lambda w: length(w) > 1))"


@query(f"""WITH d AS (SELECT doc_id, lang || '/' || lower(left(text, 20)) AS block, {_TOK} AS t FROM documents),
s AS (SELECT block FROM d GROUP BY 1 HAVING count(*) BETWEEN 2 AND 60),
p AS (SELECT a.doc_id AS "left", b.doc_id AS "right", len(list_intersect(a.t, b.t)) / greatest(len(a.t), len(b.t)) AS score FROM d a JOIN d b ON a.block = b.block AND a.doc_id < b.doc_id WHERE a.block IN (SELECT block FROM s))
SELECT "left", "right", round(score, 6) AS score, CASE WHEN score >= 0.88 THEN 'merge' ELSE 'uncertain' END AS verdict FROM p WHERE score >= 0.70""")
def dedup_similarity(spark, sf):
    """Pairs within blocks of language and opening, by the share of common words; ``dedup_similarity_all`` has no blocks."""
    pairs = resolve.similar_pairs(_openings(spark, sf), "block", "doc_id", lambda a, c: text.token_set_ratio(a("t"), c("t")))
    return pairs.withColumn("score", F.round("score", 6))


def _openings(spark, sf):
    block = F.concat_ws("/", "lang", F.lower(F.substring("text", 1, 20)))
    return table(spark, sf, "documents").select("doc_id", block.alias("block"), text.title_tokens(text.normalize_ascii(F.col("text"))).alias("t"))


@query("SELECT lang || '/' || lower(left(text, 20)) AS block, count(*) AS skipped FROM documents GROUP BY 1 HAVING count(*) > 60")
def dedup_similarity_skipped(spark, sf):
    """The blocks that ``dedup_similarity`` skips, as its rule says, with their rows."""
    return resolve.skipped_blocks(_openings(spark, sf), "block")


@query(f"""WITH d AS (SELECT doc_id, list_sort({_TOK}) AS t FROM documents), h AS (SELECT t, min(doc_id) AS head FROM d WHERE len(t) > 0 GROUP BY 1),
p AS (SELECT a.head AS "left", b.head AS "right", len(list_intersect(a.t, b.t)) / greatest(len(a.t), len(b.t)) AS score FROM h a JOIN h b ON a.head < b.head UNION ALL SELECT head, doc_id, 1.0 FROM d JOIN h ON d.t = h.t WHERE doc_id <> head)
SELECT "left", "right", round(score, 6) AS score, CASE WHEN score >= 0.88 THEN 'merge' ELSE 'uncertain' END AS verdict FROM p WHERE score >= 0.70""")
def dedup_similarity_all(spark, sf):
    """All pairs of different word sets by the share of common words, and of equal ones each with the first."""
    return resolve.similar_sets(_openings(spark, sf), "doc_id", "t").withColumn("score", F.round("score", 6))


@query(r"""WITH RECURSIVE k AS (SELECT doc_id, md5(text) AS c, md5(array_to_string(list_sort(list_distinct(string_split(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), ' '))), ' ')) AS o FROM documents), h AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY c) AS hc, min(doc_id) OVER (PARTITION BY o) AS ho FROM k),
s AS (SELECT doc_id AS x, hc AS y FROM h UNION SELECT doc_id, ho FROM h), e AS (SELECT x, y FROM s WHERE x <> y UNION SELECT y, x FROM s WHERE x <> y),
r AS (SELECT doc_id AS n, doc_id AS m FROM documents UNION SELECT r.n, e.y FROM r JOIN e ON r.m = e.x) SELECT n AS doc_id, min(m) AS cluster_id FROM r GROUP BY 1""")
def dedup_components(spark, sf):
    """Two kinds of evidence over whole texts, one partition: equal texts, and texts of the same words in whatever order and number."""
    words = F.array_sort(F.array_distinct(F.split(text.normalize_ascii(F.col("text")), " ")))
    d = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("content"), F.md5(F.array_join(words, " ")).alias("words"))
    edges = resolve.star_edges(d, "content", "doc_id", "content_hash", 0.97).unionByName(resolve.star_edges(d, "words", "doc_id", "fingerprint", 0.95))
    return resolve.clusters(d, "doc_id", edges.select("left", "right"))


@query("""WITH m AS (SELECT d.*, md5(text) AS c, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id), k AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY source, doc_id) AS rk FROM m)
SELECT min(doc_id) AS cluster_id, count(*) AS members, arg_min(quality, rk) FILTER (quality IS NOT NULL) AS quality, arg_min(source, rk) AS source, max(doc_id) AS last_doc FROM k GROUP BY c""")
def dedup_survivorship(spark, sf):
    """Copies folded into one row: the first known label and the leading member's source."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").withColumn("c", F.md5("text"))
    # The order itself is the rank, so each task folds its own members before they are shuffled: no window over a group of copies.
    d = d.select("c", F.struct("source", "doc_id").alias("rank"), "quality", "source", F.col("doc_id").alias("cluster_id"), F.col("doc_id").alias("last_doc"))
    return resolve.survivors(d, "c", "rank", first=["quality"], lists=[], earliest=["cluster_id"], latest=["last_doc"], leader=["source"]).drop("c")


@query(rf"""WITH p AS (SELECT page_id, url, {HOST} AS host, regexp_extract(url, '/(en|fr|de|es)/', 1) AS lang FROM pages)
SELECT host AS cluster, arg_min(url, page_id) AS url, 'company_careers' AS host_class FROM p WHERE host <> '' GROUP BY 1""")
def apply_url_election(spark, sf):
    p = table(spark, sf, "pages")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract("url", "^[a-zA-Z]+://([^/?#]*)", 1)), r"^www\.", ""), ":(80|443)$", "")
    rows = p.select(host.alias("cluster"), "url", urls.classify_host(F.col("url")).alias("host_class"), F.lit("company_careers").alias("kind"), F.lit(True).alias("is_apply"), F.col("page_id").alias("rank")).where("cluster <> ''")
    return resolve.elect_url(rows, "cluster")


PREFS = score.Preferences(
    roles=[("automobile engineer", 1.0), ("machinery intern", 1.5)], preferred=["customer#000000003"], blacklisted=["customer#000000005"], locations=[("GERMANY", 10.0), ("FRANCE", 6.0)],
    excluded_locations=["CHINA"], negative=["household", "urgent"], hard_keywords=["not specified"],
)


def _scored(spark, sf):
    j = b.jobs(spark, sf)
    days = F.timestamp_diff("SECOND", "date_posted", F.lit(b.NOW).cast("timestamp_ntz")) / 86400
    l = table(spark, sf, "labels").select(F.col("doc_id").alias("job_id"), (100.0 * F.col("quality") - 40.0 * F.col("toxic")).alias("fit"))  # noqa: E741
    rows = j.join(l, "job_id", "left")
    parts = {
        "role_match": F.col("score"), "candidate_fit": F.col("fit"), "location": score.location_score(F.col("location"), PREFS), "company_preference": score.company_preference(F.lower("company"), PREFS),
        "freshness": score.freshness_score(days), "internship_constraints": score.constraints_score(F.col("employment_type"), PREFS),
    }
    return rows.select("job_id", "title", "description", "company", "location", *[x.alias(f"p_{n}") for n, x in parts.items()]), list(parts)


_FRESH = "CASE WHEN d <= 1 THEN 100.0 WHEN d <= 3 THEN 70.0 WHEN d <= 7 THEN 30.0 WHEN d <= 14 THEN 10.0 ELSE 0.0 END"
_PARTS_SQL = f"""WITH {b.JOBS_SQL}, s AS (SELECT j.job_id, title, description, company, location, score AS p_role_match, 100.0 * quality - 40.0 * toxic AS p_candidate_fit,
CASE WHEN contains(lower(location), 'china') THEN 0.0 WHEN location = 'GERMANY' THEN 100.0 WHEN location = 'FRANCE' THEN 80.0 ELSE 60.0 END AS p_location, CASE WHEN lower(company) = 'customer#000000003' THEN 100.0 ELSE 50.0 END AS p_company_preference,
{_FRESH} AS p_freshness, CASE employment_type WHEN 'internship' THEN 85.0 WHEN 'unknown' THEN 55.0 ELSE 15.0 END AS p_internship_constraints
FROM (SELECT *, greatest(epoch({b.NOW_SQL} - date_posted) / 86400, 0) AS d FROM jobs) j LEFT JOIN labels l ON l.doc_id = j.job_id)"""
_BLEND_SQL = """p_role_match * (0.7 + 0.3 * ((coalesce(p_candidate_fit * 15, 0) + p_location * 10 + p_company_preference * 5 + p_freshness * 10 + p_internship_constraints * 10) / (CASE WHEN p_candidate_fit IS NULL THEN 0 ELSE 15 END + 35)) / 100)"""


@query(_PARTS_SQL + " SELECT job_id, p_role_match, p_candidate_fit, p_location, p_company_preference, p_freshness, p_internship_constraints FROM s")
def score_components(spark, sf):
    rows, names = _scored(spark, sf)
    return rows.select("job_id", *[f"p_{n}" for n in names])


@query(_PARTS_SQL + f" SELECT job_id, round({_BLEND_SQL}, 6) AS blended FROM s")
def score_blend(spark, sf):
    rows, names = _scored(spark, sf)
    return rows.select("job_id", F.round(score.blend({n: F.col(f"p_{n}") for n in names}, PREFS.weights), 6).alias("blended"))


@query(_PARTS_SQL + f" SELECT job_id, CASE WHEN x >= 90 THEN 'apply_now' WHEN x >= 80 THEN 'strong_match' WHEN x >= 70 THEN 'worth_considering' WHEN x >= 60 THEN 'maybe' ELSE 'skip' END AS band FROM (SELECT job_id, round({_BLEND_SQL}, 6) AS x FROM s)")
def priority_band(spark, sf):
    return score_blend(spark, sf).select("job_id", score.priority_band(F.col("blended")).alias("band"))


@query(_PARTS_SQL + f""", t AS (SELECT *, coalesce(p_candidate_fit * 15, 0) + p_location * 10 + p_company_preference * 5 + p_freshness * 10 + p_internship_constraints * 10 AS ctx, CASE WHEN p_candidate_fit IS NULL THEN 35 ELSE 50 END AS over, {_BLEND_SQL} AS x FROM s),
u AS (SELECT *, x * (0.3 * ctx / over / 100) / (0.7 + 0.3 * ctx / over / 100) AS ctx_share FROM t)
SELECT job_id, round(CASE WHEN x > 0 THEN CASE WHEN p_role_match > 0 THEN x - ctx_share ELSE 0.0 END END, 6) AS role_match, round(CASE WHEN x > 0 AND p_candidate_fit IS NOT NULL THEN CASE WHEN ctx > 0 THEN ctx_share * p_candidate_fit * 15 / ctx ELSE 0.0 END END, 6) AS candidate_fit,
round(CASE WHEN x > 0 THEN CASE WHEN ctx > 0 THEN ctx_share * p_location * 10 / ctx ELSE 0.0 END END, 6) AS location FROM u""")
def score_contributions(spark, sf):
    rows, names = _scored(spark, sf)
    parts = {n: F.col(f"p_{n}") for n in names}
    split = score.contributions(parts, PREFS.weights, score.blend(parts, PREFS.weights))
    return rows.select("job_id", *[F.round(split[n], 6).alias(n) for n in ("role_match", "candidate_fit", "location")])


@query(_PARTS_SQL + " SELECT job_id, CASE WHEN lower(company) = 'customer#000000005' THEN 'company' WHEN contains(lower(location), 'china') THEN 'location: CHINA' WHEN contains(lower(description), 'not specified') THEN 'keyword: not specified' END AS reason FROM s")
def hard_exclusions(spark, sf):
    rows, _ = _scored(spark, sf)
    return rows.select("job_id", score.hard_exclusion(F.lower("company"), F.col("location"), F.lower("description"), PREFS).alias("reason"))


#: A text that names the second word of the negative ones only beyond the 4,000 characters that count, for every third job.
_BODY_SQL = "lower(title || ' ' || CASE WHEN job_id % 3 = 0 THEN repeat('filler ', 600) ELSE '' END || description)"


@query(_PARTS_SQL + f""" SELECT job_id, least(40.0, 6.0 * ({" + ".join(f"CASE WHEN contains(({_BODY_SQL})[:4000], '{w}') THEN CASE WHEN contains(title, '{w}') THEN 2.0 ELSE 0.5 END ELSE 0 END" for w in ("household", "urgent"))})) AS penalty FROM s""")
def negative_penalty(spark, sf):
    rows, _ = _scored(spark, sf)
    body = F.lower(F.concat(F.col("title"), F.lit(" "), F.when(F.col("job_id") % 3 == 0, "filler " * 600).otherwise(""), F.col("description")))
    return rows.select("job_id", score.negative_penalty(F.col("title"), body, PREFS).alias("penalty"))


#: Kinds of titles, by customer.
_KINDS = ["intern", "sales intern", "campus marketing", "truck driver", "student nurse", "engineer", "machinery sales trainee", "co-op"]


def _trades(spark, sf):
    """Jobs with titles of several trades, declared types, stated terms and bodies short and long."""
    j = b.jobs(spark, sf).withColumn("k", F.regexp_extract("company", "[0-9]+", 0).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("k") % len(_KINDS) + 1).cast("int"))
    long = F.when(F.col("job_id") % 2 == 0, "filler " * 900).otherwise("")
    return j.select(
        "job_id", F.concat(F.element_at(F.split("title", " "), 1), F.lit(" "), kind).alias("title"), F.when(F.col("k") % 7 == 0, "Internship (paid)").alias("employment_type"),
        F.when(F.col("k") % 11 == 0, F.array(F.lit("Summer"))).alias("terms"), F.concat("description", F.lit(" "), long, F.when(F.col("k") % 5 == 0, "our co-op").otherwise("")).alias("description"),
    )


_TRADES_SQL = f"""{b.JOBS_SQL}, raw AS (SELECT *, CAST(regexp_extract(company, '[0-9]+') AS INT) AS k FROM jobs),
postings AS (SELECT job_id, split_part(title, ' ', 1) || ' ' || ({_KINDS!r})[k % {len(_KINDS)} + 1] AS title, k % 7 = 0 AS declared, k % 11 = 0 AS stated,
  description || ' ' || CASE WHEN job_id % 2 = 0 THEN repeat('filler ', 900) ELSE '' END || CASE WHEN k % 5 = 0 THEN 'our co-op' ELSE '' END AS body FROM raw),
marked AS (SELECT *, regexp_matches(title, '{pre.INTERN_TITLE.replace("(?iU)", "(?i)")}') AS intern_title, regexp_matches(title, '{pre.OFF_DOMAIN.replace("(?iU)", "(?i)")}') AND NOT (contains(title, 'machinery') OR contains(title, 'building')) AS other,
  regexp_matches(body, '{pre.INTERN_BODY.replace("(?iU)", "(?i)")}') AND length(body) < 6000 AS intern_body FROM postings)"""
_TERMS = pre.domain_terms(["Machinery Internship"], ["building "])


@query(f"WITH {_TRADES_SQL}, i AS (SELECT *, intern_title OR declared OR stated OR intern_body AS intern FROM marked) SELECT count(*) FILTER (NOT intern) AS not_internship, count(*) FILTER (intern AND other) AS off_domain, count(*) FILTER (intern AND NOT other) AS kept FROM i")
def prefilter_counts(spark, sf):
    return pre.prefilter(_trades(spark, sf), _TERMS)[1]


@query(f"WITH {_TRADES_SQL} SELECT job_id, title FROM marked WHERE intern_title AND NOT other")
def title_gate(spark, sf):
    return _trades(spark, sf).where(pre.title_gate(F.col("title"), _TERMS)).select("job_id", "title")


@query("SELECT CAST(event_id AS VARCHAR) AS source_job_id, event_type AS title, 'https://x.example/' || CAST(event_id AS VARCHAR) AS url, ts - INTERVAL (microsecond(ts) % 1000) MICROSECOND AS date_posted FROM events")
def json_source_scan(spark, sf):
    """Payloads built from the events table, read back as board postings."""
    e = table(spark, sf, "events")
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000)
    one = F.struct(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("text"), F.concat(F.lit("https://x.example/"), F.col("event_id").cast("string")).alias("hostedUrl"), ms.alias("createdAt"))
    return payloads.read_board(e.select(F.to_json(F.array(one)).alias("payload")), "lever").select("source_job_id", "title", "url", "date_posted")


@query(r"""WITH t AS (SELECT doc_id, ' ' || lower(text) || ' ' AS t FROM documents)
SELECT doc_id, contains(t, 'software') AS software_word, regexp_matches(t, '(^|[^a-z0-9+#])git([^a-z0-9+#]|$)') AS git, contains(t, 'linux') AS linux, contains(t, 'networking') AS networking FROM t""")
def skill_tags(spark, sf):
    """Some of the skills tagged in whole documents, against plain searches."""
    from ..functions.skills import extract_skills

    rows = table(spark, sf, "documents").select("doc_id", F.lower("text").alias("t"), extract_skills(F.col("text")).alias("s"))
    has = lambda name: F.exists("s", lambda x: F.lower(x) == name)
    return rows.select("doc_id", F.contains("t", F.lit("software")).alias("software_word"), has("git").alias("git"), has("linux").alias("linux"), has("networking").alias("networking"))


RESUMES = [("machinery", ["ECONOMY", "SMALL"], "Large medium projects."), ("building", ["LARGE", "PROMO", "STANDARD"], ""), ("general", ["ECONOMY", "MEDIUM", "LARGE"], "standard, small")]


def _resume_sql() -> str:
    one = " UNION ALL ".join(
        f"SELECT j.job_id, '{k}' AS kind, {i} AS i, least(100.0, 100.0 * len(list_filter(skills, lambda x: lower(x) IN {tuple(map(str.lower, own))!r} OR (length(x) > 3 AND contains('{said.lower()}', lower(x))))) / len(skills)"
        f" + CASE WHEN contains(lower(title), '{k}') THEN 5.0 ELSE 0 END) AS score FROM jobs j JOIN skills s ON s.job_id = j.job_id"
        for i, (k, own, said) in enumerate(RESUMES)
    )
    return f"WITH {b.JOBS_SQL}, {b.SKILLS_SQL}, r AS ({one}) SELECT job_id, kind, round(score, 6) AS score, row_number() OVER (PARTITION BY job_id ORDER BY score DESC, i) AS rank FROM r"


@query(_resume_sql())
def resume_match(spark, sf):
    from ..operators.discovery import rank_resumes

    jobs = b.jobs(spark, sf).join(b.skills(spark, sf), "job_id")
    return rank_resumes(jobs, RESUMES).select("job_id", "kind", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("""WITH k AS (SELECT c_name AS company, c_mktsegment AS segment FROM customer WHERE c_custkey % 3 > 0), f AS (SELECT c_name AS company, max(c_mktsegment) AS segment FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
SELECT coalesce(k.company, f.company) AS company, coalesce(k.segment, f.segment) AS segment, f.company IS NOT NULL AS seen_now, k.company IS NULL AS is_new FROM k FULL JOIN f ON k.company = f.company""")
def register_companies(spark, sf):
    from ..operators.discovery import register

    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    known = c.where("c_custkey % 3 > 0").select(F.col("c_name").alias("company"), F.col("c_mktsegment").alias("segment"), F.lit(b.NOW).cast("timestamp_ntz").alias("first_seen"))
    found = o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy(F.col("c_name").alias("company")).agg(F.max("c_mktsegment").alias("segment"))
    return register(known, found, ["company"], ["segment"], b.NOW).select("company", "segment", "seen_now", "is_new")


@query("""WITH h AS (SELECT s_name AS source, CAST(s_suppkey % 9 AS INT) AS runs, CAST(s_suppkey % 5 AS DOUBLE) AS avg_new, CAST(s_suppkey % 3 AS INT) AS failures, s_suppkey FROM supplier),
r AS (SELECT l_suppkey, count(*) AS new FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-01-01' GROUP BY 1)
SELECT source, runs + CASE WHEN r.new IS NULL THEN 0 ELSE 1 END AS runs, CASE WHEN r.new IS NULL THEN avg_new ELSE round((avg_new * runs + r.new) / (runs + 1), 2) END AS avg_new,
CASE WHEN r.new IS NULL THEN failures WHEN r.new % 4 > 0 THEN 0 ELSE failures + 1 END AS failures, CASE WHEN r.new IS NULL THEN 'idle' WHEN r.new % 4 = 0 THEN 'failed' WHEN r.new % 2 = 0 THEN 'degraded' ELSE 'ok' END AS status FROM h LEFT JOIN r ON l_suppkey = s_suppkey""")
def source_health(spark, sf):
    from ..operators.discovery import source_health as updated

    s, item = table(spark, sf, "supplier"), table(spark, sf, "lineitem")
    health = s.select(F.col("s_name").alias("source"), (F.col("s_suppkey") % 9).cast("int").alias("runs"), (F.col("s_suppkey") % 5).cast("double").alias("avg_new"), (F.col("s_suppkey") % 3).cast("int").alias("failures"))
    run = item.where("l_shipdate >= timestamp_ntz '2000-01-01 00:00:00'").join(s, item["l_suppkey"] == s["s_suppkey"]).groupBy(F.col("s_name").alias("source")).agg(F.count("*").alias("new"))
    run = run.withColumns({"ok": F.col("new") % 4 > 0, "partial": F.col("new") % 2 == 0})
    return updated(health, run)
