"""Operator 11: hard-negative mining by blocked exact products.

A stated set of anchors meets all rows in blocks. Components are quantised to integers; a tile of anchors times a tile of candidates
is one int64 product by Strassen's recursion, padded with zeros. It uses additions and products only, so every score is exact
(an intermediate sum that wraps comes back, as in any ring). Each task keeps two kinds of bounded heaps, as sorted arrays:
for an anchor its best rows of the same label, and for an anchor and a positive the best rows of other labels within the window
that the positive's score opens. Heaps of two tasks merge into one; Spark merges them by anchor, so what is shuffled are
heaps, never vectors.

The anchors are taken in blocks of a bounded size (``block``), each broadcast, so no plan depends on how many anchors there are.
For each block the rows are read twice: the positives must be known before a window is. A hot label only makes more of a
tile's columns count; rows are dealt as they lie in their files.

Defined results: rows with a null id, label or vector, or with a null or non-finite component, take no part; an anchor without
positives, and a positive without rows in its window, have no rows in the result; a shorter vector counts as padded with zeros (an empty
one too); of rows with one id the one with the smallest label, then the smallest vector, counts; ties go to the smaller id; an
empty table gives an empty result; other columns are ignored. Vectors whose quantised squared length reaches 2**52 are an
error, since their scores could not be held.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialize, new_path, table

#: Below this width a product is not split further.
LEAF = 32
#: Anchors and candidates of a tile; the columns are a power of two.
TILE_ROWS, TILE_COLUMNS = 256, 1024
LOWEST, HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a (m, k) times the transpose of b (n, k), both int64."""
    (m, k), n = a.shape, len(b)
    levels = max(0, (min(m, k, n) // LEAF).bit_length() - 1)
    up = lambda x: -x % (1 << levels)
    return _product(np.pad(a, ((0, up(m)), (0, up(k)))), np.pad(b, ((0, up(n)), (0, up(k)))), levels)[:m, :n]


def _product(a: np.ndarray, b: np.ndarray, levels: int) -> np.ndarray:
    if not levels:
        return np.einsum("ik,jk->ij", a, b)
    m, n, k = len(a) // 2, len(b) // 2, a.shape[1] // 2
    a11, a12, a21, a22 = a[:m, :k], a[:m, k:], a[m:, :k], a[m:, k:]
    b11, b21, b12, b22 = b[:n, :k], b[:n, k:], b[n:, :k], b[n:, k:]  # of the transpose
    down = levels - 1
    p1 = _product(a11 + a22, b11 + b22, down)
    p2 = _product(a21 + a22, b11, down)
    p3 = _product(a11, b12 - b22, down)
    p4 = _product(a22, b21 - b11, down)
    p5 = _product(a11 + a12, b22, down)
    p6 = _product(a21 - a11, b11 + b12, down)
    p7 = _product(a12 - a22, b21 + b22, down)
    out = np.empty((2 * m, 2 * n), dtype=np.int64)
    out[:m, :n], out[:m, n:] = p1 + p4 - p5 + p7, p3 + p5
    out[m:, :n], out[m:, n:] = p2 + p4, p1 - p2 + p3 + p6
    return out


class Heaps:
    """For each of ``n`` queues the best ``size`` (score, id) so far: higher scores first, then smaller ids."""

    def __init__(self, n: int, size: int) -> None:
        self.scores = np.full((n, size), LOWEST)
        self.ids = np.full((n, size), HIGHEST)
        self.size = size

    def merge(self, queues: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Takes rows of (score, id) into the queues; a score of LOWEST is none."""
        s = np.concatenate([self.scores[queues], scores], axis=1)
        i = np.concatenate([self.ids[queues], ids], axis=1)
        order = np.lexsort((i, ~s))[:, : self.size]  # ~s falls as s rises, without overflow
        self.scores[queues], self.ids[queues] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)

    def push(self, queues: np.ndarray, scores: np.ndarray, ids: np.ndarray, fits: np.ndarray) -> None:
        """A tile of scores, one row a queue, where ``fits``; ids ascend, and are at most TILE_COLUMNS."""
        live = fits & (scores >= self.scores[queues, -1][:, None])
        rows = np.flatnonzero(live.any(axis=1))
        if not len(rows):
            return
        # Score and place in one number, so that equal scores are cut by their ids.
        back = TILE_COLUMNS - 1 - np.arange(len(ids))
        keys = np.where(live[rows], scores[rows] * TILE_COLUMNS + back, LOWEST)
        if keys.shape[1] > self.size:
            keys = np.partition(keys, -self.size, axis=1)[:, -self.size :]
        none = keys == LOWEST
        at = TILE_COLUMNS - 1 - (keys & (TILE_COLUMNS - 1))
        self.merge(queues[rows], np.where(none, LOWEST, keys // TILE_COLUMNS), np.where(none, HIGHEST, ids[np.where(none, 0, at)]))

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(queue, score, id) of all entries."""
        queue, at = np.nonzero(self.scores != LOWEST)
        return queue, self.scores[queue, at], self.ids[queue, at]


@dataclass(frozen=True)
class Block:
    """Anchors, with their positives once these are known."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    positives: np.ndarray | None = None  # (anchors, positives); HIGHEST where there are fewer
    scores: np.ndarray | None = None


def _quantised(lists: pa.Array, scale: float, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have finite components only, and the integers of all rows, padded or cut to ``width``."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    fine = np.bincount(row[~np.isfinite(flat)], minlength=len(sizes)) == 0
    whole = np.floor(scale * np.where(fine[row], flat, 0.0))
    if np.bincount(row, whole * whole, len(sizes)).max(initial=0.0) >= 2.0**52:
        raise ValueError("a vector is too long for exact scores")
    width = sizes.max(initial=0) if width is None else width
    out = np.zeros((len(sizes), width), dtype=np.int64)
    column = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    kept = column < width
    out[row[kept], column[kept]] = whole[kept].astype(np.int64)
    return fine, out


def _tiles(batches: Iterator[pa.RecordBatch], scale: float, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, vectors) of up to TILE_COLUMNS candidates, by ascending id."""
    for b in batches:
        for at in range(0, b.num_rows, TILE_COLUMNS):
            part = b.slice(at, TILE_COLUMNS)
            fine, vectors = _quantised(part.column("vector"), scale, width)
            ids, labels = (part.column(c).to_numpy(zero_copy_only=False) for c in ("id", "label"))
            kept = np.flatnonzero(fine)
            kept = kept[np.argsort(ids[kept], kind="stable")]
            if len(kept):
                yield ids[kept], labels[kept], vectors[kept]


def _best_positives(block: Block, tiles: Iterator, size: int) -> Heaps:
    heaps = Heaps(len(block.ids), size)
    of = {x: np.flatnonzero(block.labels == x) for x in np.unique(block.labels).tolist()}
    for ids, labels, vectors in tiles:
        for label in np.unique(labels).tolist():
            own = np.flatnonzero(labels == label)
            for at in range(0, len(queues := of.get(label, ())), TILE_ROWS):
                q = queues[at : at + TILE_ROWS]
                heaps.push(q, strassen(block.vectors[q], vectors[own]), ids[own], ids[own][None, :] != block.ids[q][:, None])
    return heaps


def _best_negatives(block: Block, tiles: Iterator, size: int, low: int, high: int) -> Heaps:
    anchors, count = block.positives.shape
    heaps = Heaps(anchors * count, size)
    # low * p <= 100 * n <= high * p, in integers
    least, most = -((-low * block.scores) // 100), (high * block.scores) // 100
    for ids, labels, vectors in tiles:
        for at in range(0, anchors, TILE_ROWS):
            q = np.arange(at, min(anchors, at + TILE_ROWS))
            scores = strassen(block.vectors[q], vectors)
            other = labels[None, :] != block.labels[q][:, None]
            for k in range(count):
                has = np.flatnonzero(block.positives[q, k] != HIGHEST)
                s, a = scores[has], q[has]
                heaps.push(a * count + k, s, ids, other[has] & (s >= least[a, k][:, None]) & (s <= most[a, k][:, None]))
    return heaps


def hard_negatives(
    vectors: DataFrame, anchors: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None,
    positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0, block: int = 32_768,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    anchors: which rows are anchors, in terms of ``id``. A negative's score is from ``low`` to ``high`` percent of the positive's.
    """
    spark = vectors.sparkSession
    label = F.col("label") if label is None else label
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector")).dropna()
    if rows.groupBy("id").count().where("count > 1").head(1):
        usable = rows.where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
        rows = materialize(usable.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("row")).select("id", "row.*"), "distinct-vectors")
    asked = materialize(rows.where(anchors), "anchors")
    parts, path = -(-asked.count() // block), new_path(spark, "hard-negatives")
    kinds = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], kinds).write.parquet(path)
    for i in range(parts):
        own = asked.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == i).orderBy("id").toArrow()  # about ``block`` rows
        fine, quantised = _quantised(own.column("vector"), scale)
        ids, labels = (own.column(c).to_numpy()[fine] for c in ("id", "label"))
        if len(ids):
            _mine(rows, Block(ids, labels, quantised[fine]), positives, negatives, low, high, scale).write.mode("append").parquet(path)
    return spark.read.schema(kinds).parquet(path)


def _mine(rows: DataFrame, block: Block, positives: int, negatives: int, low: int, high: int, scale: float) -> DataFrame:
    spark, width = rows.sparkSession, block.vectors.shape[1]
    first = spark.sparkContext.broadcast(block)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = first.value
        queue, score, ids = _best_positives(b, _tiles(batches, scale, width), positives).rows()
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (b.ids[queue], score, ids)], ["anchor_id", "score", "id"])

    best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    found = rows.mapInArrow(near, "anchor_id long, score long, id long").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= positives).toArrow()
    at = np.searchsorted(block.ids, found.column("anchor_id").to_numpy()), found.column("rank").to_numpy() - 1
    chosen, scores = np.full((len(block.ids), positives), HIGHEST), np.zeros((len(block.ids), positives), dtype=np.int64)
    chosen[at], scores[at] = found.column("id").to_numpy(), found.column("score").to_numpy()
    second = spark.sparkContext.broadcast(Block(block.ids, block.labels, block.vectors, chosen, scores))

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = second.value
        queue, score, ids = _best_negatives(b, _tiles(batches, scale, width), negatives, low, high).rows()
        a, k = queue // positives, queue % positives
        out = (b.ids[a], b.positives[a, k], ids, b.scores[a, k], score)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])

    window = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    mined = rows.mapInArrow(far, "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    mined = mined.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= negatives)
    return mined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=moved)


QUERIES = {"op11_hard_negatives": op11_hard_negatives}
ORACLES = {
    "op11_hard_negatives": """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, x -> cast(floor(256 * cast(x as double)) as bigint)) as q
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, x -> x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, cast(list_sum(list_transform(list_zip(a.q, b.q), p -> p[1] * p[2])) as bigint) as score
  from v a join v b on a.vec_id % 100 = 0 and b.vec_id <> a.vec_id),
p as (
  select * from (select anchor_id, id as positive_id, score as positive_score, row_number() over (partition by anchor_id order by score desc, id) as k from s where same) where k <= 5),
n as (
  select p.anchor_id, positive_id, cast(row_number() over (partition by p.anchor_id, positive_id order by score desc, id) as int) as rank, id as negative_id, positive_score, score as negative_score
  from p join s on s.anchor_id = p.anchor_id and not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score)
select * from n where rank <= 10"""
}
