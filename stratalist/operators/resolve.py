"""Entity resolution: evidence edges, guards, similarity, clusters and survivorship.

The stages only add links, so the clusters are the connected components of all accepted edges, in whatever order
these are found. Guards look at pairs, not at clusters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.facts import locations_compatible
from ..functions.text import jaccard, token_set_ratio, words_array
from ..storage import Scratch, materialize
from . import overlap
from .components import connected_components

# Thresholds, bonuses and axes of the match.
MERGE, UNCERTAIN, MAX_BLOCK = 0.88, 0.70, 60
EXCLUSIVE_AXES = [["summer", "fall", "spring", "winter"], ["verification", "design", "physical", "analog"], ["software", "hardware", "firmware"], ["intern", "coop"], ["phd", "masters"]]
HOST_RANK = {"company_careers": 0, "ats": 1, "job_board": 2, "unknown": 4}
KIND_RANK = {"company_careers": 0, "ats": 1, "job_board": 2, "aggregator": 3, "curated_list": 4, "unknown": 5}


def ranked(table: dict[str, int], value: Column, default: int) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, value), F.lit(default))


def _heads(rows: DataFrame, key: str, node: str) -> DataFrame:
    """key and ``left``, the lowest node, of each key with several rows."""
    return rows.where(F.col(key).isNotNull() & (F.col(key).cast("string") != "")).groupBy(key).agg(F.min(node).alias("left"), F.count("*").alias("n")).where("n > 1")


def star_edges(rows: DataFrame, key: str, node: str, stage: str, confidence: float) -> DataFrame:
    """An edge from the lowest node of each key to every other: as many edges as rows, whatever the size of a group."""
    edges = rows.join(_heads(rows, key, node), key).where(F.col(node) != F.col("left"))
    return edges.select("left", F.col(node).alias("right"), F.lit(stage).alias("stage"), F.lit(confidence).alias("confidence"))


def side(row: str) -> Callable[[str], Column]:
    return lambda c: F.col(f"{row}.{c}")


def _on_axis(tags: Column, axis: list[str]) -> Column:
    return F.array_join(F.array_sort(F.array_intersect(tags, words_array(axis))), ",")


def with_axes(rows: DataFrame, axes: list[list[str]] = EXCLUSIVE_AXES) -> DataFrame:
    """Adds ``axes``: where a row stands on each, worked out once a row and not once a pair. For ``axes_veto``."""
    return rows.withColumn("axes", F.array(*[_on_axis(F.col("discriminators"), axis) for axis in axes]))


def axes_veto(a: Callable[[str], Column], b: Callable[[str], Column], axes: list[list[str]] = EXCLUSIVE_AXES) -> Column:
    """``merge_veto`` of rows ``with_axes``."""
    return _veto(a, b, axes, lambda x, i: F.get(x("axes"), F.lit(i)))


def merge_veto(a: Callable[[str], Column], b: Callable[[str], Column], axes: list[list[str]] = EXCLUSIVE_AXES) -> Column:
    """Why two listings must not merge, or null; the first reason in order. ``location`` is a struct of ``facts.parse_location``."""
    return _veto(a, b, axes, lambda x, i: _on_axis(x("discriminators"), axes[i]))


def _veto(a: Callable[[str], Column], b: Callable[[str], Column], axes: list[list[str]], at: Callable[[Callable[[str], Column], int], Column]) -> Column:
    known = lambda c: (F.coalesce(a(c), F.lit("")) != "") & (F.coalesce(b(c), F.lit("")) != "")
    plain = lambda c: F.lower(F.trim(c))
    out = F.when(a("company_slug") != b("company_slug"), "company")
    out = out.when(known("requisition_id") & (plain(a("requisition_id")) != plain(b("requisition_id"))), "requisition")
    out = out.when(known("ats_identity") & (a("ats_identity") != b("ats_identity")), "ats identity")
    out = out.when((a("source") == b("source")) & known("canonical_url") & (a("canonical_url") != b("canonical_url")), "same source")
    for i, axis in enumerate(axes):
        left, right = at(a, i), at(b, i)
        out = out.when((left != "") & (right != "") & (left != right), F.concat(F.lit("axis: "), F.lit(axis[0])))
    out = out.when((a("employment_type") != "unknown") & (b("employment_type") != "unknown") & (a("employment_type") != b("employment_type")), "employment")
    return out.when(~locations_compatible(a("location"), b("location")), "location")


#: The stages of exact evidence in order, with their key, whether the guard looks at their edges, and confidence.
STAGES = [("exact_id", "source_key", False, 1.0), ("url", "canonical_url", False, 1.0), ("ats_identity", "ats_identity", False, 1.0), ("fingerprint", "fingerprint", True, 0.95), ("content_hash", "content_hash", True, 0.97)]
GUARDED = ["company_slug", "requisition_id", "ats_identity", "source", "canonical_url", "discriminators", "employment_type", "location"]


def guarded_edges(rows: DataFrame, key: str, node: str, stage: str, confidence: float) -> DataFrame:
    """Star edges with the reason for which the guard refuses them, or null: a refused edge is the record that two rows differ."""
    # Only the heads are looked up; the other end is the row itself.
    heads = _heads(rows, key, node).select(key, "left").join(rows.select(F.col(node).alias("left"), F.struct(*GUARDED).alias("head")), "left")
    edges = rows.select(key, F.col(node).alias("right"), F.struct(*GUARDED).alias("own")).join(heads, key).where("right <> left")
    return edges.select("left", "right", F.lit(stage).alias("stage"), F.lit(confidence).alias("confidence"), merge_veto(side("head"), side("own")).alias("veto"))


def resolve(rows: DataFrame, node: str, *, similar: bool = True, adjudicator: Callable[[DataFrame], DataFrame] | None = None, budget: int = 0) -> DataFrame:
    """(node, cluster_id) over all stages: equal keys, guarded fingerprints and contents, and (``similar``) guarded pairs of a company.

    rows: source_key and the columns of ``GUARDED``, fingerprint and content_hash; for similar also title_tokens, shingles, date_posted and salary_min.
    """
    edges = []
    for stage, key, guarded, confidence in STAGES:
        if guarded:
            edges.append(guarded_edges(rows, key, node, stage, confidence).where("veto is null").select("left", "right"))
        else:
            edges.append(star_edges(rows, key, node, stage, confidence).select("left", "right"))
    if similar:
        pairs = similar_pairs(rows, "company_slug", node, pair_score, axes_veto)
        edges.append(adjudicated(pairs, adjudicator, budget))
    return clusters(rows, node, reduce(DataFrame.unionByName, edges))


# The fields of a folded record by rule. The first in order of authority that says something speaks for the cluster.
FIRST_FILLED = "description requirements responsibilities preferred_qualifications salary_raw location_raw city state country requisition_id ats_identity company_url salary_currency salary_period".split()
FIRST_KNOWN = "sponsorship employment_type remote_status".split()
UNITED = "skills terms locations degrees".split()
OF_LEADER = "source source_kind title company company_slug fingerprint content_hash".split()


def fold(members: DataFrame, cluster: str, rank: str) -> DataFrame:
    """One record for each cluster by the rules of each field, as far as ``members`` has it: the first that says something, explicit dates before
    others, pay as a pair, a visa rule with its evidence, and ordered unions of lists."""
    order, of, own = F.col(rank), F.col, set(members.columns)
    said = lambda c, none: F.min_by(c, F.when(of(c).isNotNull() & (of(c) != none), order)).alias(c)
    union = lambda c: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("r"), of(c).alias("x")))), lambda s: s["x"]))).alias(c)
    out = [F.count("*").alias("members"), *[said(c, "") for c in FIRST_FILLED if c in own], *[said(c, "unknown") for c in FIRST_KNOWN if c in own], *[union(c) for c in UNITED if c in own], *[F.min_by(c, order).alias(c) for c in OF_LEADER if c in own]]
    if "salary_min" in own:
        pay = F.min_by(F.struct("salary_min", "salary_max"), F.when(of("salary_min").isNotNull(), order))
        out += [pay.getField("salary_min").alias("salary_min"), pay.getField("salary_max").alias("salary_max")]
    if "sponsorship_evidence" in own:
        out.append(F.min_by("sponsorship_evidence", F.when(of("sponsorship").isNotNull() & (of("sponsorship") != "unknown"), order)).alias("sponsorship_evidence"))
    if "deadline" in own:
        explicit = F.min_by("deadline", F.when(of("deadline_is_explicit"), order))
        out += [F.coalesce(explicit, F.min_by("deadline", order)).alias("deadline"), F.coalesce(F.bool_or("deadline_is_explicit"), F.lit(False)).alias("deadline_is_explicit")]
    out += [F.min(c).alias(c) for c in ("date_posted",) if c in own] + [F.max(c).alias(c) for c in ("date_updated",) if c in own]
    out += [F.min_by(c, F.when(of(c).isNotNull(), order)).alias(c) for c in ("years",) if c in own]
    return members.groupBy(cluster).agg(*out)


def cluster_order() -> list[Column]:
    """Folded clusters: the largest first, then by company and title; last by their id, so the order is one."""
    return [F.desc("members"), F.asc("company_slug"), F.asc("title_core"), F.asc("cluster_id")]


def with_urls(members: DataFrame, cluster: str, rank: str, classify: Callable[[Column], Column]) -> DataFrame:
    """cluster, application_url, host_class and posting_url. members: source_kind, apply_url and url."""
    at = lambda c, apply: F.struct(F.col(c).alias("url"), F.lit(apply).alias("is_apply"))
    each = members.select(cluster, F.col("source_kind").alias("kind"), F.col(rank).alias("rank"), F.explode(F.array(at("apply_url", True), at("url", False))).alias("u")).select(cluster, "kind", "rank", "u.*")
    best = elect_url(each.withColumn("host_class", classify(F.col("url"))), cluster)
    posting = members.groupBy(cluster).agg(F.min_by("url", F.when(F.coalesce("url", F.lit("")) != "", F.col(rank))).alias("posting_url"))
    return posting.join(best.select(cluster, F.col("url").alias("application_url"), "host_class"), cluster, "left")


def pair_score(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    """0 to 1 of title tokens and shingles, with bonuses for agreeing facts."""
    title, body = token_set_ratio(a("title_tokens"), b("title_tokens")), jaccard(a("shingles"), b("shingles"))
    have = (F.size(a("shingles")) > 0) & (F.size(b("shingles")) > 0)
    one = F.lit(1.0)
    # Each step names the score once: a score that is named twice a step doubles the generated code, which is then too long to be compiled.
    step = lambda value, *cases: F.least(one, value + reduce(lambda when, case: when.when(*case), cases, F).otherwise(0.0))
    score = F.when(have, 0.55 * title + 0.45 * body).otherwise(0.82 * title)
    same_req = F.lower(a("requisition_id")) == F.lower(b("requisition_id"))
    score = step(score, (same_req & (a("requisition_id") != ""), 0.25))
    score = step(score, ((a("location_key") != "") & (a("location_key") == b("location_key")), 0.05))
    days = F.abs(F.floor(F.timestamp_diff("SECOND", b("date_posted"), a("date_posted")) / 86400))
    score = step(score, (days <= 3, 0.03), (days > 90, -0.05))
    score = step(score, ((a("salary_min") != 0) & (F.abs(a("salary_min") - b("salary_min")) < 0.01), 0.04))
    return F.greatest(F.lit(0.0), score)


def similar_pairs(rows: DataFrame, block: str, node: str, score: Callable, veto: Callable | None = None, max_block: int = MAX_BLOCK) -> DataFrame:
    """(left, right, score, verdict) for pairs of a block: merge or uncertain. Blocks beyond ``max_block`` are skipped, as the
    matching rule says: ``skipped_blocks`` reports them, and ``similar_sets`` compares all rows.
    """
    sized = rows.groupBy(block).agg(F.count("*").alias("__n")).where(f"__n between 2 and {max_block}")
    own = rows.join(sized.select(block), block, "left_semi")
    if veto is axes_veto:
        own = with_axes(own)
    pairs = own.alias("a").join(own.alias("b"), (F.col(f"a.{block}") == F.col(f"b.{block}")) & (F.col(f"a.{node}") < F.col(f"b.{node}")))
    a, b = side("a"), side("b")
    if veto is not None:
        pairs = pairs.where(veto(a, b).isNull())
    pairs = pairs.select(a(node).alias("left"), b(node).alias("right"), score(a, b).alias("score")).where(F.col("score") >= UNCERTAIN)
    return pairs.withColumn("verdict", F.when(F.col("score") >= MERGE, "merge").otherwise("uncertain"))


def skipped_blocks(rows: DataFrame, block: str, max_block: int = MAX_BLOCK) -> DataFrame:
    """(block, skipped): the blocks that ``similar_pairs`` does not compare, with their rows."""
    return rows.groupBy(block).agg(F.count("*").alias("skipped")).where(f"skipped > {max_block}")


def adjudicated(pairs: DataFrame, adjudicator: Callable[[DataFrame], DataFrame] | None, budget: int = 0, least: float = 0.8) -> DataFrame:
    """Turns uncertain pairs into merges where the adjudicator, asked for at most ``budget`` of the best, is sure enough.

    adjudicator: (left, right, score) to (left, right, same, confidence).
    """
    sure = pairs.where("verdict = 'merge'").select("left", "right")
    if adjudicator is None or budget <= 0:
        return sure
    asked = pairs.where("verdict = 'uncertain'").orderBy(F.desc("score"), "left", "right").limit(budget)
    said = adjudicator(asked.select("left", "right", "score"))
    return sure.unionByName(said.where(F.col("same") & (F.col("confidence") >= least)).select("left", "right"))


def clusters(rows: DataFrame, node: str, edges: DataFrame) -> DataFrame:
    """(node, cluster_id) of every row; the cluster is named by its lowest node."""
    found = connected_components(edges, "left", "right").select(F.col("node").alias("found_node"), F.col("component").alias("found_component"))
    return rows.select(node).join(found, F.col(node) == F.col("found_node"), "left").select(node, F.coalesce("found_component", node).alias("cluster_id"))


def authority_rank(cluster: str, kind: Column, body: Column, source: Column, node: str) -> Column:
    """1 for the member of a cluster that speaks for it."""
    rich = (F.length(body) > 200).cast("int")
    return F.row_number().over(Window.partitionBy(cluster).orderBy(ranked(KIND_RANK, kind, 5), F.desc(rich), F.desc(F.length(body)), source, node))


def survivors(members: DataFrame, cluster: str, rank: str, *, first: list[str], lists: list[str], earliest: list[str] = (), latest: list[str] = (), leader: list[str] = ()) -> DataFrame:
    """One row for each cluster. first: the first value that isn't empty, in order of authority; lists: their ordered union."""
    order = F.col(rank)
    filled = [F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), order)).alias(c) for c in first]
    union = [F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("r"), F.col(c).alias("x")))), lambda s: s["x"]))).alias(c) for c in lists]
    rest = [F.min(c).alias(c) for c in earliest] + [F.max(c).alias(c) for c in latest] + [F.min_by(c, order).alias(c) for c in leader]
    return members.groupBy(cluster).agg(F.count("*").alias("members"), *filled, *union, *rest)


def elect_url(candidates: DataFrame, cluster: str) -> DataFrame:
    """The most authoritative url of each cluster. candidates: cluster, url, host_class, kind, is_apply, rank."""
    order = F.struct(ranked(HOST_RANK, F.col("host_class"), 4), ranked(KIND_RANK, F.col("kind"), 5), (~F.col("is_apply")).cast("int"), "rank")
    return candidates.where("url <> ''").groupBy(cluster).agg(F.min_by("url", order).alias("url"), F.min_by("host_class", order).alias("host_class"))


def similar_sets(rows: DataFrame, node: str, tokens: str) -> DataFrame:
    """(left, right, score, verdict) over all rows, without blocks or a cap; the score is ``token_set_ratio``. Tokens hold no space.

    Rows with equal sets are joined by a star around the lowest of them, with a score of 1; that one stands for them in the
    pairs of different sets. These are compared with blocks of sets of bounded size, one block after the other (``overlap``): neither
    candidates nor texts of pairs are dealt out, so that the work may grow with the square of the rows, but what is held on disk doesn't.
    """
    spark, percent, node_type = rows.sparkSession, round(100 * UNCERTAIN), rows.schema[node].dataType.simpleString()
    scratch = Scratch(spark, "similar")
    # The texts are read once, and the filter looks at what was written: before, it would cut them into words a second time. A set as one text takes a third of the room of an array.
    said = rows.select(F.col(node).alias("node"), F.size(tokens).alias("n"), F.array_join(F.sort_array(tokens), " ").alias("words"))
    said = scratch.keep(said.withColumn("set", F.sha2("words", 256)), "sets").where("words <> '' and node is not null")
    copies = materialize(star_edges(said.select("node", "set"), "set", "node", "equal", 1.0).select("left", "right", F.lit(1.0).alias("score")), "copies")
    hashes = F.transform(F.split("words", " "), lambda t: F.xxhash64(t))
    # Any common order of the tokens will do: here the number of tokens in a token's cell, so that frequent ones come last.
    cells = said.select(F.explode(hashes).alias("token")).groupBy(F.pmod("token", F.lit(overlap.COUNTED)).cast("int").alias("cell")).agg(F.count("*").alias("n")).toArrow()
    counts = np.zeros(overlap.COUNTED, dtype=np.int64)
    counts[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    shared = spark.sparkContext.broadcast(counts)
    # In classes of like size, so that a block is compared with sets of like size only, and near copies of a class are in many tasks; equal sets are neighbours, and the first has the lowest node.
    order = [F.floor(8 * F.log2("n")), F.col("set"), F.col("node")]
    # Partitions have as many rows each, but those of large sets are several times larger: four times as many.
    ordered = said.repartitionByRange(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order).withColumn("hashes", hashes)
    kinds = f"node {node_type}, place long, piece long, n int, near array<int>, set string, words binary"
    sets = scratch.keep(ordered.mapInArrow(overlap.placed(lambda: shared.value, percent), kinds), "placed")
    edges = sets.groupBy(F.shiftright("place", 32).alias("part")).agg(F.min("place").alias("first"), F.min_by("set", "place").alias("low"), F.max_by("set", "place").alias("high"))
    if again := overlap.repeated([tuple(r)[1:] for r in edges.orderBy("part").collect()]):  # at most one a partition
        sets = sets.where(~F.col("place").isin(again))
    pieces = sets.groupBy("piece").agg(F.min("place"), F.max("place"), F.min("n"), F.max("n"), F.sum(F.octet_length("words")), F.count("*")).orderBy("piece").collect()
    path, found = f"{scratch.path}/found", f"a {node_type}, b {node_type}, score double"
    spark.range(0).selectExpr(f"cast(null as {node_type}) as a", f"cast(null as {node_type}) as b", "cast(null as double) as score").write.parquet(path)
    sets = sets.select("node", "place", "n", "near", "words")
    for first, last, low, high in overlap.blocks([tuple(r)[1:] for r in pieces]):
        like = sets.where((F.col("place") > first) & F.col("n").between(-(-percent * low // 100), 100 * high // percent))
        _matched(sets.where(F.col("place").between(first, last)), like, percent, found, path)
    pairs = spark.read.schema(found).parquet(path).where("a <> b").select(F.least("a", "b").alias("left"), F.greatest("a", "b").alias("right"), "score")
    pairs = materialize(pairs, "pairs")
    scratch.clear()
    return pairs.unionByName(copies).withColumn("verdict", F.when(F.col("score") >= MERGE, "merge").otherwise("uncertain"))


def _matched(block: DataFrame, like: DataFrame, percent: int, kinds: str, path: str) -> None:
    """Adds to ``path`` the pairs of a block, which goes to all workers, with ``like`` rows."""
    shared = block.sparkSession.sparkContext.broadcast(overlap.Block.of(block.toArrow()))
    like.mapInArrow(overlap.matched(lambda: shared.value, percent, UNCERTAIN), kinds).write.mode("append").parquet(path)
    shared.destroy()
