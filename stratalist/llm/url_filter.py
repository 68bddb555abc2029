"""Operator 1 [native]: URL filters by a Bloom filter cascade.

The cascade answers "is this key listed?" exactly for every key of the corpus, without a join at look-up. Level 1
holds the listed keys; level 2 holds the corpus keys that level 1 lets through by mistake; level 3 the listed keys that
level 2 would wrongly drop; and so on, until a level makes no mistake over the complete universe of corpus keys. A key is
listed if the first level that rejects it has an even number. Each level's bits are one literal of the plan; their number follows the
list's size (about 1.44 log2(keys / listed) + 4 bits for each listed key). A longer list is dealt by a hash of the key into as many
cascades as keep each below ``max_bits``, and the urls pass them one after the other.

Keys are of two kinds: rule keys (a host suffix with a path prefix) and hosts. Everything is DataFrame expressions.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and is allowed; repeated
rows give repeated results; ties in length cannot occur between rules that fit the same url unless the rules are equal;
with an empty table, or nothing listed, the cascade has no levels and lists nothing; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let
from .exact_dedup import LOWER, UPPER
from .shared import materialize, table

#: Bits of the levels of one cascade, about: 4 MB of literals in a plan.
MAX_BITS = 1 << 25


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a url, both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


@dataclass(frozen=True)
class Level:
    words: str  # 64-bit words of the bitmap, comma separated
    bits: int
    hashes: int
    seed: int

    def positions(self, key: Column) -> list[Column]:
        start = F.pmod(F.xxhash64(key, F.lit(self.seed)), F.lit(self.bits))
        step = F.pmod(F.xxhash64(key, F.lit(-1 - self.seed)), F.lit(self.bits - 1)) + 1
        return [(start + step * i) % self.bits for i in range(self.hashes)]

    def hold(self, keys: Column) -> Column:
        """Of an array of keys, for each whether the level holds it. The bitmap is bound once for all of them."""

        def tested(words: Column) -> Column:
            def one(key: Column) -> Column:
                test = F.lit(True)
                for p in self.positions(key):
                    test = test & (F.getbit(F.get(words, F.shiftright(p, 6).cast("int")), (p % 64).cast("int")) == 1)
                return test

            return F.transform(keys, one)

        return let(F.split(F.lit(self.words), ",").cast("array<bigint>"), tested)  # folded into one literal


#: Most hashes of a level; the bits make up for the rest of a low rate. It keeps the generated code small.
MAX_HASHES = 6


def level_shape(n: int, rate: float) -> tuple[int, int]:
    """Bits and hashes for ``n`` keys at a false positive rate."""
    hashes = min(MAX_HASHES, math.ceil(-math.log2(rate)))
    bits = -hashes * n / math.log(1 - rate ** (1 / hashes))
    return max(64, 64 * math.ceil(bits / 64)), hashes


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def listed(self, keys: Column) -> Column:
        """Of an array of keys, for each whether it is listed."""
        n = len(self.levels)
        held = F.array(*[level.hold(keys) for level in self.levels]) if n else F.array().cast("array<array<boolean>>")
        # The first level that does not hold the key; one more than there are levels if all do.
        first = lambda h, j: F.aggregate(h, F.lit(1), lambda at, x: F.when((at > 0) & x[j], at + 1).otherwise(-F.abs(at)), F.abs)
        return let(held, lambda h: F.transform(keys, lambda _, j: (first(h, j) % 2 == 0) & F.lit(n > 0)))


def fit_cascade(keys: DataFrame) -> Cascade:
    """From the universe (key, listed), one row a key."""
    n_listed, n_other = (int(x or 0) for x in keys.agg(F.count_if("listed"), F.count_if(~F.col("listed"))).first())
    if not n_listed:
        return Cascade(())
    levels: list[Level] = []
    due = n_listed
    while due:
        rate = min(0.5, math.sqrt(0.5) * n_listed / n_other) if n_other and not levels else 0.5
        bits, hashes = level_shape(due, rate)
        level = Level("", bits, hashes, 2 * len(levels) + 1)
        # The keys of this level have passed every second level before it, counted from the one just below.
        own = _passing(keys, levels)
        bit = own.select(F.explode(F.array(*level.positions(F.col("key")))).alias("p"))
        bit = bit.groupBy(F.floor(F.col("p") / 64).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("b"))
        words = [0] * (bits // 64)
        for r in bit.collect():  # at most bits / 64 rows
            words[r.w] = r.b
        levels.append(Level(",".join(map(str, words)), bits, hashes, level.seed))
        due = _passing(keys, levels).count()
    return Cascade(tuple(levels))


def _passing(keys: DataFrame, levels: list[Level]) -> DataFrame:
    """The keys that the next level has to hold."""
    keys = keys.where(F.col("listed") == (len(levels) % 2 == 0))
    for level in levels[::-1][::2]:
        keys = keys.where(level.hold(F.array("key"))[0])
    return keys


def shards_of(n_listed: int, n_other: int, max_bits: int) -> int:
    """Cascades that a list needs."""
    bits = n_listed * (1.45 * max(0.0, math.log2((n_other + 1) / (n_listed + 1))) + 4)
    return max(1, math.ceil(bits / max_bits))


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str  # allow or block

    @property
    def text(self) -> str:
        return self.host + self.path


def rule_keys(host: Column, path: Column, rules: list[Rule]) -> list[Column]:
    """For each shape of a rule (labels of the host, length of the path), the url's key of that shape or null."""
    labels = F.length(host) - F.length(F.replace(host, F.lit("."))) + 1
    out = []
    for n, size in sorted({(r.host.count(".") + 1, len(r.path)) for r in rules}):
        key = F.concat(F.substring_index(host, ".", -n), F.substring(path, 1, size))
        out.append(F.when((host != "") & (labels >= n) & (F.length(path) >= size), key))
    return out


def judge_urls(pages: DataFrame, rules: list[Rule], listed_hosts: DataFrame, *, id_col: str = "page_id", url_col: str = "url", max_bits: int = MAX_BITS) -> DataFrame:
    """page_id, host, path, rule, verdict for each row. ``listed_hosts``: one string column of blocked hosts.

    The longest rule that fits decides; without one, a listed host is blocked and any other allowed.
    """
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    by_rule = rule_keys(F.col("host"), F.col("path"), rules)
    asked = F.array_compact(F.array(*[F.concat(F.lit("r:"), k) for k in by_rule], F.concat(F.lit("h:"), F.col("host"))))
    universe = urls.select(F.explode(asked).alias("key"), F.lit(False).alias("listed"), F.lit(True).alias("asked"))
    own = urls.sparkSession.createDataFrame([("r:" + r.text, True, False) for r in rules], "key string, listed boolean, asked boolean")
    hosts = listed_hosts.select(F.concat(F.lit("h:"), F.col(listed_hosts.columns[0])).alias("key"), F.lit(True).alias("listed"), F.lit(False).alias("asked")).where("key is not null")
    # One aggregation, combined before its shuffle, tells for each key of the corpus whether it is listed.
    keys = universe.unionByName(own).unionByName(hosts).groupBy("key").agg(F.max("listed").alias("listed"), F.max("asked").alias("asked"))
    keys = materialize(keys.where("asked").select("key", "listed"), "url-keys")
    n_listed, n_other = (int(x or 0) for x in keys.agg(F.count_if("listed"), F.count_if(~F.col("listed"))).first())
    # The first key is the host's; the others are those of the shapes of the rules, null where a url has none.
    asked = F.array(F.concat(F.lit("h:"), F.col("host")), *[F.concat(F.lit("r:"), k) for k in by_rule])
    judged = urls.withColumn("keys", asked).withColumn("listed", F.transform("keys", lambda _: F.lit(False)))
    shards = shards_of(n_listed, n_other, max_bits)
    for i in range(shards):
        own = lambda k: F.pmod(F.xxhash64(k, F.lit(0)), F.lit(shards)) == i  # noqa: B023, E731
        cascade = fit_cascade(keys.where(own(F.col("key"))))
        found = F.zip_with("keys", cascade.listed(F.col("keys")), lambda k, x: F.coalesce(own(k) & x, F.lit(False)))  # noqa: B023
        judged = judged.withColumn("listed", F.zip_with("listed", found, lambda a, b: a | b))
        if shards > 1:
            judged = materialize(judged, "judged")
    fits = [F.when(F.col("listed")[i + 1], k) for i, k in enumerate(by_rule)]
    return _verdicts(judged.withColumn("rule", longest(fits)), F.col("listed")[0], rules)


def longest(keys: list[Column]) -> Column:
    if not keys:
        return F.lit(None).cast("string")
    return F.array_max(F.array(*[F.when(k.isNotNull(), F.struct(F.length(k).alias("n"), k.alias("key"))) for k in keys]))["key"]


def _verdicts(urls: DataFrame, host_listed: Column, rules: list[Rule]) -> DataFrame:
    verdict = F.when(host_listed, "block").otherwise("allow")
    if rules:
        by_rule = F.create_map(*[F.lit(x) for r in rules for x in (r.text, r.verdict)])
        verdict = F.when(F.col("rule").isNull(), verdict).otherwise(by_rule[F.col("rule")])
    return urls.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


#: The rules of the query, the labels that mark a host of advertisements or trackers, and what marks a tracked link.
RULES = [
    Rule("com", "/en/", "block"),
    Rule("example.com", "/en/7", "allow"),
    Rule("net", "/de/", "allow"),
    Rule("example.net", "/de/8", "block"),
    Rule("org", "/es/", "block"),
]
AD_HOST = r"(^|[.-])(ads|adserver|banner|doubleclick|track|tracker|telemetry)([.-]|$)"
TRACKED = "[?&]utm_[a-z]+="


def listed_hosts(pages: DataFrame) -> DataFrame:
    """Hosts of advertisements and trackers, and hosts most of whose links are tracked ones. One row a host, combined before its shuffle."""
    host, _ = host_and_path(F.col("url"))
    links = pages.select(host.alias("host"), F.col("url").rlike(TRACKED).alias("tracked")).where("host <> ''")
    counted = links.groupBy("host").agg(F.count_if("tracked").alias("tracked"), F.count("*").alias("links"))
    return counted.where(F.col("host").rlike(AD_HOST) | (2 * F.col("tracked") > F.col("links"))).select("host")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge_urls(pages, RULES, listed_hosts(pages))


QUERIES = {"op1_url_filters": op1_url_filters}

_CASES = "\n".join(
    f"WHEN (host = '{r.host}' OR host LIKE '%.{r.host}') AND starts_with(path, '{r.path}') THEN '{r.text}'" for r in sorted(RULES, key=lambda r: -len(r.text))
)
ORACLES = {
    "op1_url_filters": f"""
WITH u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path, regexp_matches(url, '{TRACKED}') AS tracked FROM pages),
h AS (SELECT host FROM u WHERE host <> '' GROUP BY host HAVING regexp_matches(host, '{AD_HOST}') OR 2 * count_if(tracked) > count(*)),
r AS (SELECT *, CASE {_CASES} END AS rule FROM u)
SELECT page_id, host, path, rule, CASE {" ".join(f"WHEN rule = '{r.text}' THEN '{r.verdict}'" for r in RULES)}
  WHEN host IN (SELECT host FROM h) THEN 'block' ELSE 'allow' END AS verdict FROM r"""
}
