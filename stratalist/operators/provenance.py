"""Why listings were merged: the spanning forest of all evidence, the method of each listing, and the records of doubt.

Evidence has a total order (its ``rank``): stages one after the other; within an exact stage by the later listing; within a guarded one by the
first listing of the group, then the later one; similar pairs by the first listing of the company, then by the pair. Taken in
that order, a link counts only if its ends are not joined yet, so what counts is the minimum spanning forest, however the rows are
dealt. A listing's method is that of its lowest forest edge in which it is the right end, else ``primary``.

The forest is found by Borůvka's rounds: each component takes its lowest edge, components that met become one, and of parallel
edges only the lowest stays; a logarithmic number of rounds, each a written table, and nothing collected. If the edges of the first stage are
stars, as those of one key are, they all count, and the rounds begin with what these leave.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import Scratch, materialize
from . import resolve
from .components import connected_components, settled

LEAST_SURE = 0.8
EDGE = ["left", "right", "stage", "confidence", "rank"]


def rank(stage: int, *places: Column) -> Column:
    """A place in the order of evidence."""
    filled = [*places, *[F.lit(0)] * (3 - len(places))]
    return F.struct(F.lit(stage).alias("s"), *[x.cast("long").alias(n) for n, x in zip("abc", filled, strict=True)])


def spanning_forest(edges: DataFrame, asked: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The minimum spanning forest of edges (``EDGE``), and ``asked`` (left, right, rank, ...) with ``joined``: whether edges of lower ranks join the ends.

    In a round each component moves to a new one under the rank of its lowest edge. The highest rank on the forest's path between two nodes is
    the highest that either of them moves under until they are in one component, so each question is followed through the
    rounds until that is known.
    """
    scratch = Scratch(edges.sparkSession, "forest")
    live = edges.select("rank", "left", "right", "stage", "confidence", F.col("left").alias("u"), F.col("right").alias("v")).where("u <> v")
    forest, open_, closed = [], None, []
    if asked is not None:
        top = F.lit(None).cast(edges.schema["rank"].dataType)
        open_ = asked.select(F.struct("*").alias("q"), F.col("left").alias("u"), F.col("right").alias("v"), top.alias("top"))

    def move(step: DataFrame, live: DataFrame, open_: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
        """Edges and questions between the components after a step (node, component, under); nodes that are not in it stay."""
        at = {x: step.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}"), F.col("under").alias(f"w_{x}")) for x in "uv"}
        now = {x: F.coalesce(f"c_{x}", x) for x in "uv"}
        if open_ is not None:
            followed = open_.join(at["u"], "u", "left").join(at["v"], "v", "left")
            followed = followed.select("q", now["u"].alias("u"), now["v"].alias("v"), F.greatest("top", "w_u", "w_v").alias("top"))
            followed = scratch.keep(followed, "followed")
            above = F.coalesce(F.col("top") > F.col("q.rank"), F.lit(False))
            closed.append(followed.where((F.col("u") == F.col("v")) | above).select("q", (~above).alias("joined")))
            open_ = followed.where((F.col("u") != F.col("v")) & ~above)
        live = live.join(at["u"].drop("w_u"), "u", "left").join(at["v"].drop("w_v"), "v", "left").withColumns({f"c_{x}": now[x] for x in "uv"}).where("c_u <> c_v")
        lowest = F.min(F.struct("rank", "left", "right", "stage", "confidence")).alias("e")
        live = live.groupBy(F.least("c_u", "c_v").alias("u"), F.greatest("c_u", "c_v").alias("v")).agg(lowest).select("e.*", "u", "v")
        return scratch.keep(live, "live"), open_

    stage = live.agg(F.min("rank.s")).head()[0]
    stars = live.where(F.col("rank.s") == F.lit(stage))
    if stage is not None and settled(stars.select(F.col("right").alias("u"), F.col("left").alias("v"))):
        # The only edge of this stage at its right end is the lowest there is at that end.
        live, open_ = move(stars.select(F.col("right").alias("node"), F.col("left").alias("component"), F.col("rank").alias("under")), live.where(F.col("rank.s") > stage), open_)
    else:
        stars = stars.limit(0)
    while live.head(1):
        edge = F.struct("rank", "left", "right", "stage", "confidence", "u", "v").alias("e")
        ends = live.select(F.explode(F.array("u", "v")).alias("node"), edge)
        best = scratch.keep(ends.groupBy("node").agg(F.min("e").alias("e")), "best")
        chosen = scratch.keep(best.select("e.*").distinct(), "chosen")
        forest.append(chosen.select(*EDGE))
        moved = connected_components(chosen, "u", "v", scratch.keep)
        step = scratch.keep(best.join(moved, "node").select("node", "component", F.col("e.rank").alias("under")), "step")
        live, open_ = move(step, live, open_)
    out = stars.select(*EDGE)
    if forest:
        out = out.unionByName(materialize(reduce(DataFrame.unionByName, forest), "forest"))
    told = None
    if open_ is not None:
        told = reduce(DataFrame.unionByName, [*closed, open_.select("q", F.lit(False).alias("joined"))])
        told = materialize(told.select("q.*", "joined"), "told")
    scratch.clear()
    return out, told


def evidence(rows: DataFrame, node: str, *, similar: bool = True, doubted: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """Links (``EDGE``), and doubts (with verdict and reason), if they are asked for (``doubted``): refused links of guarded stages, and similar pairs that are not similar enough.

    rows: as for ``resolve.resolve``; ``node`` is the listing's place in the input.
    """
    links, doubts = [], []
    for i, (stage, key, guarded, confidence) in enumerate(resolve.STAGES):
        if guarded:
            edges = resolve.guarded_edges(rows, key, node, stage, confidence).withColumn("rank", rank(i, F.col("left"), F.col("right")))
            links.append(edges.where("veto is null").select(*EDGE))
            refused = edges.where("veto is not null").withColumn("confidence", F.lit(0.0))
            doubts.append(refused.select(*EDGE, F.lit("different").alias("verdict"), F.col("veto").alias("reason")))
        else:
            links.append(resolve.star_edges(rows, key, node, stage, confidence).withColumn("rank", rank(i, F.col("right"))).select(*EDGE))
    if similar:
        pairs = resolve.similar_pairs(rows, "company_slug", node, resolve.pair_score, resolve.axes_veto)
        first = rows.groupBy("company_slug").agg(F.min(node).alias("first"))
        block = rows.select(F.col(node).alias("left"), "company_slug").join(first, "company_slug").select("left", "first")
        pairs = pairs.join(block, "left").select("left", "right", F.lit("similarity").alias("stage"), F.col("score").alias("confidence"), rank(len(resolve.STAGES), F.col("first"), F.col("left"), F.col("right")).alias("rank"), "verdict")
        links.append(pairs.where("verdict = 'merge'").select(*EDGE))
        doubts.append(pairs.where("verdict = 'uncertain'").select(*EDGE, "verdict", F.lit("similar").alias("reason")))
    return materialize(reduce(DataFrame.unionByName, links), "links"), materialize(reduce(DataFrame.unionByName, doubts), "doubts") if doubted else None


def methods(rows: DataFrame, node: str, forest: DataFrame) -> DataFrame:
    """(node, method, confidence) of every row, from the spanning forest of the links. The doubts have no part in it."""
    first = forest.groupBy(F.col("right").alias("__node")).agg(F.min(F.struct("rank", "stage", "confidence")).alias("e"))
    found = rows.select(node).join(first, F.col(node) == F.col("__node"), "left")
    return found.select(node, F.coalesce("e.stage", F.lit("primary")).alias("method"), F.coalesce("e.confidence", F.lit(1.0)).alias("confidence"))


def trace(rows: DataFrame, node: str, links: DataFrame, doubts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``methods`` of every row, and the records (``EDGE``, verdict, reason): links that counted, and doubts about pairs that
    were not joined by then."""
    forest, told = spanning_forest(links, doubts)
    same = forest.select(*EDGE, F.lit("same").alias("verdict"), F.concat(F.lit("identical "), "stage").alias("reason"))
    return methods(rows, node, forest), same.unionByName(told.where("not joined").select(*EDGE, "verdict", "reason"))


def adjudicate(links: DataFrame, doubts: DataFrame, ask: Callable[[DataFrame], DataFrame], budget: int, *, least: float = LEAST_SURE) -> tuple[DataFrame, DataFrame]:
    """Links and doubts after an adjudicator was asked about uncertain pairs, at most ``budget`` of them, in the order of evidence.

    ask: (left, right, score) to (left, right, verdict, confidence); a pair without an answer, or with a null verdict, is an error and stays uncertain.
    Only a pair that nothing before it joins is asked about, and each answer may join others, so it goes in rounds: a pair is asked as soon as no
    open pair before it could join it, and as soon as open pairs before it could not use up the budget. The answers are those of asking one by one.
    """
    uncertain, rest = doubts.where("verdict = 'uncertain'"), doubts.where("verdict <> 'uncertain'")
    pending, answered = materialize(uncertain, "pending"), []
    while budget > 0:
        # What the links so far do not join by then is possible; what open pairs could not join either is certain.
        possible = spanning_forest(links, pending)[1].where("not joined").drop("joined")
        possible = materialize(possible, "possible")
        if not possible.head(1):
            break
        sure = spanning_forest(links.unionByName(possible.select(*EDGE)))[0].select("rank").join(possible, "rank")
        reach = possible.orderBy("rank").limit(budget).select("rank")  # at most the budget
        batch = materialize(sure.join(reach, "rank", "left_semi"), "batch")
        said = ask(batch.select("left", "right", F.col("confidence").alias("score"))).select("left", "right", F.upper("verdict").alias("said"), F.col("confidence").alias("how_sure"))
        said = materialize(batch.join(said, ["left", "right"], "left"), "said")
        budget -= said.count()
        joins = F.coalesce((F.col("said") == "SAME") & (F.col("how_sure") >= least), F.lit(False))
        own = said.withColumns({"stage": F.lit("llm"), "confidence": F.coalesce("how_sure", F.lit(0.0)), "verdict": F.coalesce(F.lower("said"), F.lit("uncertain"))})
        links = materialize(links.unionByName(own.where(joins).select(*EDGE)), "links")
        answered.append(own.where(~joins).select(*EDGE, "verdict", F.when(F.col("said").isNull(), "adjudicator error").otherwise(F.col("reason")).alias("reason")))
        pending = materialize(pending.join(said.select("rank"), "rank", "left_anti"), "pending")
    return links, reduce(DataFrame.unionByName, [rest, *answered, pending])


def resolve_with_records(rows: DataFrame, node: str, *, similar: bool = True, ask: Callable[[DataFrame], DataFrame] | None = None, budget: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(node, cluster_id), (node, method, confidence) and the records of all stages, with an adjudicator for uncertain pairs if ``ask`` is given."""
    links, doubts = evidence(rows, node, similar=similar)
    if ask is not None:
        links, doubts = adjudicate(links, doubts, ask, budget)
    return resolve.clusters(rows, node, links.select("left", "right")), *trace(rows, node, links, doubts)
