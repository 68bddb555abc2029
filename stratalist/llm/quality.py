"""Operator 5: quality classifier by compression.

Two zstandard dictionaries are built, one from texts labelled good and one from texts labelled bad. A text is cut into
short blocks, each compressed on its own with either dictionary (so the dictionary counts as much at the end of a long
text as at its start), and once as a whole. The difference of the two sizes over their sum, with the sizes per byte, goes
through a logistic calibration that is fitted on labelled rows which no dictionary has seen.

Bounds of the fit, both parameters of ``Sample``: rows for each dictionary and rows for the calibration. Only the whole texts
of the former come to the driver; each document is scored where it is, in one pass without a shuffle. The rows of a sample are chosen by a hash of their id, so the fit is the same on every run.

Defined results: an empty or null text scores 0; repeated rows score alike; with labels of one class only (or none) there
is nothing to tell apart and every non-empty text scores the share of label 1 (0.5 without labels); labels of null are
ignored, and an id with different labels counts as bad; an empty table gives an empty result; other columns, whatever
their names, are left as they are. Labels, language, source and id are no inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import table


@dataclass(frozen=True)
class Sample:
    """Bounds of what is learnt from."""

    dictionary_rows: int = 2_000  # for each class
    calibration_rows: int = 4_000
    dictionary_bytes: int = 32_768
    block: int = 192
    level: int = 3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    raw: bool  # the dictionaries are plain content: there was too little text to train them
    block: int
    level: int
    mean: tuple[float, ...] = ()
    scale: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()
    prior: float = 0.5


THRESHOLD = 0.3
FEATURES = 5


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _dictionary(texts: list[bytes], sample: Sample) -> tuple[bytes, bool]:
    blocks = [t[i : i + sample.block] for t in texts for i in range(0, len(t), sample.block)]
    try:
        return zstandard.train_dictionary(sample.dictionary_bytes, blocks).as_bytes(), False
    except zstandard.ZstdError:
        return b"".join(texts)[: sample.dictionary_bytes], True


class _Compressors:
    def __init__(self, model: Model) -> None:
        self.block = model.block
        kind = zstandard.DICT_TYPE_RAWCONTENT if model.raw else zstandard.DICT_TYPE_FULLDICT
        self.both = []
        for content in (model.good, model.bad):
            d = zstandard.ZstdCompressionDict(content, dict_type=kind)
            d.precompute_compress(level=model.level)
            self.both.append(zstandard.ZstdCompressor(dict_data=d, level=model.level, write_content_size=False, write_dict_id=False, write_checksum=False).compress)

    def features(self, text: str) -> list[float]:
        raw = text.encode()
        blocks = [raw[i : i + self.block] for i in range(0, len(raw), self.block)]
        good, bad = (sum(map(len, map(c, blocks))) for c in self.both)
        n = len(raw)
        return [(bad - good) / (bad + good), good / n, bad / n, *(len(c(raw)) / n for c in self.both)]


_MODELS: dict[int, _Compressors] = {}


def _compressors(model: Model) -> _Compressors:
    key = hash((model.good, model.bad, model.block, model.level))
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = _Compressors(model)
    return _MODELS[key]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[tuple, tuple, tuple]:
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(50):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z / len(y) + ridge * np.eye(len(w)), z.T @ (p - y) / len(y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(mean), tuple(scale), tuple(w)


def fit(docs: DataFrame, labels: DataFrame, sample: Sample = Sample()) -> Model:
    """From labels (doc_id, quality) of documents that are not held out."""
    rows = labels.where("quality is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.min("quality").alias("quality")).withColumn("h", F.xxhash64("doc_id"))
    counts = {int(r.quality): r["count"] for r in rows.groupBy("quality").count().collect()}
    if len(counts) < 2:
        return Model(b"", b"", True, sample.block, sample.level, prior=float(next(iter(counts), 0.5)))
    # Two thirds of the hashes are for the dictionaries, the rest for the calibration.
    order = ["h", "doc_id"]
    picks = [rows.where(f"quality = {q} and pmod(h, 3) > 0").orderBy(*order).limit(sample.dictionary_rows).withColumn("use", F.lit(q)) for q in (1, 0)]
    picks.append(rows.where("pmod(h, 3) = 0").orderBy(*order).limit(sample.calibration_rows).withColumn("use", F.lit(2)))
    picked = picks[0].unionByName(picks[1]).unionByName(picks[2]).select("doc_id", "quality", "use")
    # picked has at most 2 * dictionary_rows + calibration_rows rows, so it is broadcast and the texts aren't shuffled.
    texts = docs.select("doc_id", "text").where("text <> ''").join(F.broadcast(picked), "doc_id")
    own = texts.where(F.col("use") < 2).select("use", F.col("text").cast("binary").alias("text")).collect()
    by = {q: sorted(bytes(r.text) for r in own if r.use == q) for q in (1, 0)}
    if not by[1] or not by[0]:
        return Model(b"", b"", True, sample.block, sample.level, prior=counts[1] / (counts[0] + counts[1]))
    (good, raw_good), (bad, raw_bad) = _dictionary(by[1], sample), _dictionary(by[0], sample)
    if raw_good != raw_bad:
        good, bad = (b"".join(by[q])[: sample.dictionary_bytes] for q in (1, 0))
    model = Model(good, bad, raw_good or raw_bad, sample.block, sample.level)
    seen = texts.where(F.col("use") == 2)
    if not seen.where("quality = 0").head(1) or not seen.where("quality = 1").head(1):
        seen = texts
    found = np.array(sorted(tuple(r) for r in _with_features(seen.select("quality", "text"), model).select("quality", *(f"__f{i}" for i in range(FEATURES))).collect()), dtype=float)
    mean, scale, weights = _logistic(found[:, 1:], found[:, 0])
    return Model(model.good, model.bad, model.raw, model.block, model.level, mean, scale, weights)


def _with_features(df: DataFrame, model: Model) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(model)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = _compressors(shared.value)
            found = np.array([c.features(t.as_py()) for t in b.column("text")]).reshape(b.num_rows, FEATURES)
            yield pa.RecordBatch.from_arrays([b.column("quality"), *(pa.array(x) for x in found.T)], ["quality", *(f"__f{i}" for i in range(FEATURES))])

    df = df.select(F.col("quality").cast("long"), "text")
    return df.mapInArrow(add, "quality long, " + ", ".join(f"__f{i} double" for i in range(FEATURES)))


def _scores(texts: pa.Array, m: Model) -> np.ndarray:
    out = np.zeros(len(texts))
    x = [None if not (t := v.as_py()) else t for v in texts]
    at = [i for i, t in enumerate(x) if t is not None]
    if not m.weights:
        out[at] = m.prior
    elif at:
        c = _compressors(m)
        f = (np.array([c.features(x[i]) for i in at]) - m.mean) / m.scale
        out[at] = 1 / (1 + np.exp(-np.clip(np.c_[f, np.ones(len(at))] @ np.array(m.weights), -30, 30)))
    return out


def score_rows(docs: DataFrame, model: Model, kept: Column, *, text_col: str = "text") -> DataFrame:
    """kept, any column of a row, and its score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("kept"), pa.array(_scores(b.column("text"), shared.value))], ["kept", "score"])

    rows = docs.select(kept.alias("kept"), F.col(text_col).alias("text"))
    return rows.mapInArrow(add, StructType([rows.schema["kept"]]).add("score", "double"))


def classify(docs: DataFrame, model: Model, *, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row."""
    scored = score_rows(docs, model, F.col("doc_id"))
    return scored.select(F.col("kept").alias("doc_id"), held_out(F.col("kept")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, sample: Sample = Sample()) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all their columns."""
    return score_rows(docs, fit(docs, labels, sample), F.struct("*")).where(F.col("score") >= threshold).select("kept.*")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op5_quality": op5_quality}
ORACLES: dict[str, str] = {}
