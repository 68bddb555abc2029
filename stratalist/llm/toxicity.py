"""Operator 12: toxicity by a factorization machine over hashed terms.

The terms of a text are its words and their beginnings (4 to 6 letters, which stand for inflected and made-up forms), lower-cased
and hashed into ``buckets``. Those whose presence tells the labels apart (a likelihood-ratio statistic, counted by Spark over all
sampled rows) are the features. The score is the logistic of a bias, a weight for each term, and for each pair of terms the
product of their factor vectors: a word that is harmless alone, such as the name of a group, may weigh with another one, which
additive weights cannot say. Presence counts, not frequency, so an insult weighs as much in a long text as in a short one.

Learnt from at most ``Fit.rows`` labelled rows, taken by a hash of their id, so every run is the same. Only their feature numbers come
to the driver, at most ``Fit.features`` a row. Each text is scored where it is, in one pass without a shuffle.

Defined results: a null or empty text has no terms and gets the score of the bias; repeated rows score alike; null labels and ids are ignored, an id
with different labels counts as toxic; with labels of one class only every text gets the share of label 1 (0.5 without labels);
an empty table gives an empty result; other columns are ignored. Labels, language, source and id are no inputs of a score.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality import held_out
from .shared import table

WORDS = re.compile(r"[^\W\d_]+").findall
BEGINNINGS = range(4, 7)
THRESHOLD = 0.5
#: Words whose features a worker remembers, and the longest.
CACHE_ENTRIES, CACHE_CHARS = 300_000, 48


@dataclass(frozen=True)
class Fit:
    """Bounds and steps of what is learnt."""

    rows: int = 20_000
    buckets: int = 2**20
    features: int = 1_024
    least: int = 3  # rows with a term
    factors: int = 8
    batch: int = 256
    epochs: int = 10
    steps: int = 1_500  # at least, for few rows
    rate: float = 0.05
    ridge: float = 2e-4
    weight: float = 5.0  # of toxic rows, which are the fewer
    seed: int = 12


@dataclass(frozen=True)
class Model:
    buckets: int
    feature: dict[int, int]  # bucket: number
    bias: float
    weights: np.ndarray
    factors: np.ndarray


def terms(word: str) -> list[str]:
    return ["=" + word, *("^" + word[:n] for n in BEGINNINGS if len(word) >= n)]


def buckets_of(word: str, buckets: int) -> list[int]:
    return [zlib.crc32(t.encode()) % buckets for t in terms(word)]


class _Reader:
    """Feature numbers of texts; words are looked up once."""

    def __init__(self, model: Model) -> None:
        self.model, self.known = model, {}

    def of(self, word: str) -> tuple[int, ...]:
        found = self.known.get(word)
        if found is None:
            feature = self.model.feature
            found = tuple(feature[b] for b in buckets_of(word, self.model.buckets) if b in feature)
            if len(word) <= CACHE_CHARS:
                if len(self.known) >= CACHE_ENTRIES:
                    self.known.clear()
                self.known[word] = found
        return found

    def features(self, text: str | None) -> list[int]:
        return sorted({i for w in set(WORDS((text or "").lower())) for i in self.of(w)})


def _pairs(index: np.ndarray, starts: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The value of each row, and its sum of factors. index: feature numbers; starts: where a row begins, and the end."""
    add = lambda x: np.add.reduceat(np.concatenate([x, np.zeros_like(x[:1]) if len(x) else np.zeros((1, *x.shape[1:]))]), starts[:-1]) * (np.diff(starts) > 0).reshape(-1, *[1] * (x.ndim - 1))
    v = model.factors[index]
    sums = add(v)
    return model.bias + add(model.weights[index]) + 0.5 * ((sums**2).sum(1) - add((v**2).sum(1))), sums


def probabilities(rows: list[list[int]], model: Model) -> np.ndarray:
    if not rows:
        return np.zeros(0)
    starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    value, _ = _pairs(np.fromiter((i for r in rows for i in r), dtype=np.int64, count=starts[-1]), starts, model)
    return 1 / (1 + np.exp(-np.clip(value, -30, 30)))


def learn(rows: list[list[int]], labels: np.ndarray, feature: dict[int, int], fit: Fit) -> Model:
    """Logistic loss with a ridge, by adaptive steps over shuffled batches; the same for the same rows."""
    rng, n = np.random.default_rng(fit.seed), len(feature)
    share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    model = Model(fit.buckets, feature, float(np.log(share / (1 - share))), np.zeros(n), rng.normal(0, 0.05, (n, fit.factors)))
    seen_b, seen_w, seen_v = 1e-8, np.full(n, 1e-8), np.full((n, fit.factors), 1e-8)
    batches = -(-len(rows) // fit.batch)
    for _ in range(max(fit.epochs, -(-fit.steps // batches))):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), fit.batch):
            own = order[at : at + fit.batch]
            sizes = np.array([len(rows[i]) for i in own])
            starts = np.concatenate([[0], np.cumsum(sizes)])
            index = np.fromiter((x for i in own for x in rows[i]), dtype=np.int64, count=starts[-1])
            value, sums = _pairs(index, starts, model)
            error = (1 / (1 + np.exp(-np.clip(value, -30, 30))) - labels[own]) * np.where(labels[own] > 0, fit.weight, 1.0) / len(own)
            each, row = np.repeat(error, sizes), np.repeat(np.arange(len(own)), sizes)
            slope = each[:, None] * (sums[row] - model.factors[index])
            g_w = np.bincount(index, each, n) + fit.ridge * model.weights
            g_v = np.stack([np.bincount(index, slope[:, k], n) for k in range(fit.factors)], axis=1) + fit.ridge * model.factors if fit.factors else np.zeros((n, 0))
            g_b = error.sum()
            seen_b, seen_w, seen_v = seen_b + g_b**2, seen_w + g_w**2, seen_v + g_v**2
            model = Model(fit.buckets, feature, model.bias - fit.rate * g_b / seen_b**0.5, model.weights - fit.rate * g_w / seen_w**0.5, model.factors - fit.rate * g_v / seen_v**0.5)
    return model


def _term_counts(sampled: DataFrame, fit: Fit) -> DataFrame:
    """(bucket, toxic, clean): rows with a term of each bucket. Each task sums its own before they are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = np.zeros((2, fit.buckets), dtype=np.int64)
        for b in batches:
            for toxic, text in zip(b.column("toxic").to_pylist(), b.column("text"), strict=True):
                found = {x for w in set(WORDS((text.as_py() or "").lower())) for x in buckets_of(w, fit.buckets)}
                rows[1 - toxic][list(found)] += 1
        at = np.flatnonzero(rows.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(x[at]) for x in rows)], ["bucket", "toxic", "clean"])

    own = sampled.select("toxic", "text").mapInArrow(count, "bucket long, toxic long, clean long")
    return own.groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def likelihood_ratio(a: Column, b: Column, all_a: int, all_b: int) -> Column:
    """How much better presence is told by class than without: a of all_a and b of all_b rows have the term."""
    part = lambda k, n, p: k * F.log(p) + (n - k) * F.log(1 - p)
    inside = lambda k, n: F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), k / n))
    a, b = a.cast("double"), b.cast("double")
    p = inside(a + b, F.lit(float(all_a + all_b)))
    return part(a, all_a, inside(a, F.lit(float(all_a)))) + part(b, all_b, inside(b, F.lit(float(all_b)))) - part(a, all_a, p) - part(b, all_b, p)


def fit_model(docs: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> Model:
    """From labels (doc_id, toxic) of documents that are not held out."""
    rows = labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")).withColumn("h", F.xxhash64("doc_id"))
    picked = rows.orderBy("h", "doc_id").limit(fit.rows)  # bounded, so it is broadcast and texts stay where they are
    sampled = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    total = {r.toxic: r["count"] for r in sampled.groupBy("toxic").count().collect()}
    empty = Model(fit.buckets, {}, 0.0, np.zeros(0), np.zeros((0, fit.factors)))
    if len(total) < 2:
        return Model(fit.buckets, {}, 30.0 if 1 in total else -30.0, empty.weights, empty.factors) if total else empty
    tells = likelihood_ratio(F.col("toxic"), F.col("clean"), total[1], total[0])
    best = _term_counts(sampled, fit).where(F.col("toxic") + F.col("clean") >= fit.least).orderBy(F.desc(tells), "bucket").limit(fit.features).select("bucket").collect()
    feature = {r.bucket: i for i, r in enumerate(best)}
    shared = docs.sparkSession.sparkContext.broadcast(Model(fit.buckets, feature, 0.0, empty.weights, empty.factors))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(shared.value)
        for b in batches:
            found = pa.array([reader.features(t.as_py()) for t in b.column("text")], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("toxic"), found], ["h", "toxic", "features"])

    found = sampled.select("h", "toxic", "text").mapInArrow(read, "h long, toxic int, features array<int>")
    # An id may have several rows; the bound holds for them too.
    own = found.orderBy("h", F.xxhash64("features"), "features").limit(fit.rows).collect()
    return learn([r.features for r in own], np.array([r.toxic for r in own], dtype=float), feature, fit)


def score_rows(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(shared.value)
        for b in batches:
            score = probabilities([reader.features(t.as_py()) for t in b.column("text")], reader.model)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, score double")


def classify(docs: DataFrame, model: Model, *, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row."""
    predicted = F.when(F.col("score") >= threshold, 1).otherwise(0)
    return score_rows(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, fit_model(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op12_toxicity": op12_toxicity}
ORACLES: dict[str, str] = {}
