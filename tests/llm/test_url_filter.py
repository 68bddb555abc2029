from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from stratalist.llm import url_filter as uf

URLS = [
    None, "", "no scheme", "http://", "http://A.Example.COM", "http://a.example.com/en/7x", "http://a.example.com/en/8?x=://net/de/", "https://notexample.com/en/7",
    "https://example.com/en/7", "https://net/de/1", "https://x.net/de/8", "https://example.net/de/8#z", "https://b.example.net?u=/de/8", "https://c.org/es/\n", "https://c.org/es",
    "http://m.ads-track.example.com/fr/1", "http://ads.example.com/en/7", "x://y://z/en/", "https://comcom/en/", "https://.com/en/", "http://" + "a." * 3000 + "com/en/" + "p" * 50_000,
]


def brute(url: str | None) -> tuple:
    rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:cut], rest[cut:]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [r for r in uf.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    rule = max(fits, key=lambda r: len(r.text), default=None)
    labels = set(host.replace("-", ".").split("."))
    method = "block" if labels & {"ads", "adserver", "banner", "doubleclick", "track", "tracker", "telemetry"} else "allow"
    return host, path, rule and rule.text, rule.verdict if rule else method


@pytest.mark.parametrize("max_bits", [uf.MAX_BITS, 8])
def test_judges_like_brute_force(spark, max_bits):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate([*URLS, URLS[5]])], "page_id long, url string, verdict string")
    listed = pages.select(uf.host_and_path(F.col("url"))[0].alias("h")).where(F.col("h").rlike(uf.AD_HOST))
    got = {r.page_id: tuple(r)[1:] for r in uf.judge_urls(pages, uf.RULES, listed, max_bits=max_bits).collect()}
    assert got == {i: brute(u) for i, u in enumerate([*URLS, URLS[5]])}


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert uf.judge_urls(pages, uf.RULES, pages.select("url")).count() == 0


def test_cascade_is_exact_with_many_levels(spark):
    keys = spark.range(40_000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 3 == 0).alias("listed"))
    cascade = uf.fit_cascade(keys)
    assert len(cascade.levels) > 3
    assert keys.where(cascade.listed(F.array("key", "key"))[1] != F.col("listed")).count() == 0
    bits = sum(x.bits for x in cascade.levels)
    assert bits < 8 * 40_000 / 3


def test_a_long_list_is_dealt_over_several_cascades(spark):
    assert uf.shards_of(2, 30, 8) > 1 and uf.shards_of(2, 30, uf.MAX_BITS) == 1
    pages = spark.range(3_000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), (F.col("id") % 500).cast("string"), F.lit(".org/")).alias("url"))
    listed = spark.range(0, 500, 3).select(F.concat(F.lit("h"), "id", F.lit(".org")).alias("h"))
    got = uf.judge_urls(pages, [], listed, max_bits=600)
    assert uf.shards_of(167, 333, 600) > 1
    assert got.where((F.col("verdict") == "block") != (F.col("page_id") % 500 % 3 == 0)).count() == 0 and got.count() == 3_000


def test_hosts_of_tracked_links_are_listed(spark):
    urls = ["http://a.org/?utm_source=x", "http://a.org/?x=1&utm_id=2", "http://A.org/", "http://b.org/?utm_source=x", "http://b.org/", "http://ads.c.org/", None, "utm_x=", "http://d.org/utm_source="]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    assert sorted(r.host for r in uf.listed_hosts(pages).collect()) == ["a.org", "ads.c.org"]
