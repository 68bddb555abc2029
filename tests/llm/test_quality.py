from __future__ import annotations

import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from stratalist.llm import quality as q
from stratalist.llm.shared import table

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    return q.op5_quality(spark, SF).join(labels, "doc_id", "left").join(docs.select("doc_id", "text"), "doc_id").toPandas()


def test_held_out_rows_and_range(scored, spark):
    assert len(scored) == table(spark, SF, "documents").count()
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 if h else zlib.crc32(str(i).encode()) % 5 for i, h in zip(scored.doc_id, scored.held_out, strict=True))
    assert scored.score.between(0, 1).all() and (scored.predicted == (scored.score >= 0.3)).all()
    assert scored.groupby("text").score.nunique().max() == 1


def test_held_out_accuracy(scored):
    own = scored[scored.held_out & scored.quality.notna()]
    assert len(own) > 500
    good, bad = own[own.quality == 1], own[own.quality == 0]
    above = (good.score.to_numpy()[:, None] > bad.score.to_numpy()[None, :]).mean()
    assert above > 0.97
    assert good.predicted.mean() > 0.99 and bad.predicted.mean() < 0.2


def test_held_out_labels_change_nothing(scored, spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    other = labels.withColumn("quality", F.when(q.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert q.fit(docs, other) == q.fit(docs, labels)


def test_edge_cases(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "word " * 50_000, "c"), (3, "word " * 50_000, "c"), (4, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(3, 1), (9, 1), (4, None)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in q.classify(docs, q.fit(docs, labels)).collect()}
    assert got == {1: 0.0, 2: 0.0, 3: 1.0, 4: 1.0}
    both = spark.createDataFrame([(3, 1), (4, 0)], "doc_id long, quality int")
    model = q.fit(docs, both)
    assert q.score_rows(docs, model, F.struct("*")).count() == 5
    named = docs.withColumnRenamed("score", "__score").withColumn("kept", F.lit(1)).withColumn("__text", F.lit("x"))
    kept = q.drop_low_quality(named, both)
    assert kept.columns == named.columns and kept.count() <= 5
    assert q.classify(docs.limit(0), q.fit(docs.limit(0), labels.limit(0))).count() == 0


def test_equals_brute_force(spark):
    small = "/root/testdata/sf0.01"
    docs, labels = table(spark, small, "documents"), table(spark, small, "labels")
    text = {r.doc_id: r.text for r in docs.collect()}
    worst: dict[int, int] = {}
    for r in labels.collect():
        if r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 5:
            worst[r.doc_id] = min(r.quality, worst.get(r.doc_id, 1))
    hashes = {r.doc_id: r.h for r in labels.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    sample, model = q.Sample(), q.fit(docs, labels)
    order = sorted(worst, key=lambda i: (hashes[i], i))
    blocks = {}
    for kind in (1, 0):
        own = [i for i in order if worst[i] == kind and hashes[i] % 3][: sample.dictionary_rows]
        raw = sorted(text[i].encode() for i in own if text.get(i))
        blocks[kind] = [t[a : a + sample.block] for t in raw for a in range(0, len(t), sample.block)]
    assert not model.raw
    assert model.good == zstandard.train_dictionary(sample.dictionary_bytes, blocks[1]).as_bytes()
    assert model.bad == zstandard.train_dictionary(sample.dictionary_bytes, blocks[0]).as_bytes()

    def features(t: str) -> list[float]:
        raw, sizes = t.encode(), []
        for content in (model.good, model.bad):
            c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_FULLDICT), level=sample.level, write_content_size=False, write_dict_id=False, write_checksum=False)
            sizes.append((sum(len(c.compress(raw[a : a + sample.block])) for a in range(0, len(raw), sample.block)), len(c.compress(raw))))
        (good, all_good), (bad, all_bad) = sizes
        return [(bad - good) / (bad + good), good / len(raw), bad / len(raw), all_good / len(raw), all_bad / len(raw)]

    calibration = [i for i in order if hashes[i] % 3 == 0 and text.get(i)][: sample.calibration_rows]
    x, y = np.array([features(text[i]) for i in calibration]), np.array([worst[i] for i in calibration])
    assert np.allclose(x.mean(0), model.mean) and np.allclose(x.std(0), model.scale, atol=1e-6)
    # The weights are where the penalised likelihood is flat.
    z, w = np.c_[(x - x.mean(0)) / (x.std(0) + 1e-9), np.ones(len(x))], np.array(model.weights)
    assert np.abs(z.T @ (1 / (1 + np.exp(-z @ w)) - y) / len(y) + 1e-3 * w).max() < 1e-7
    scores = {r.doc_id: r.score for r in q.op5_quality(spark, small).collect()}
    for i, t in text.items():
        want = 1 / (1 + np.exp(-np.clip(((np.array(features(t)) - model.mean) / model.scale) @ w[:-1] + w[-1], -30, 30))) if t else 0.0
        assert abs(scores[i] - want) < 1e-9
