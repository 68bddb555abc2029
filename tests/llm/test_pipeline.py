from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from stratalist.llm import bpe, mixing
from stratalist.llm.shared import materialize, table

SF = "/root/testdata/sf0.01"


def test_each_stage_on_its_own_input(spark):
    docs = table(spark, SF, "documents")
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    seen = {}
    for name, stage in cp.STAGES:
        out = materialize(stage(spark, docs, SF), "test")
        seen[name] = (docs, out)
        if name != "encode":
            assert out.columns == docs.columns
        docs = out
    before, after = (x.toPandas() for x in seen["quality"])
    kept = set(after.doc_id)
    good = [i for i in before.doc_id if labels.get(i) == 1]
    assert sum(i in kept for i in good) > 0.97 * len(good) and len(after) < len(before)
    before, after = (x.toPandas() for x in seen["exact_dedup"])
    assert sorted(after.doc_id) == sorted(before.assign(t=before.text.str.lower()).groupby("t").doc_id.max())
    before, after = (x.toPandas() for x in seen["near_dedup"])
    assert 0.8 * len(before) < len(after) < len(before) and after.doc_id.is_unique
    before, after = seen["mixing"]
    rates = {r.doc_id: r.copies for r in mixing.document_rates(before, mixing.labelled_domains(table(spark, SF, "labels")), cp.MIX_TARGETS).collect()}
    assert {r.doc_id: r["count"] for r in after.groupBy("doc_id").count().collect()} == {i: n for i, n in rates.items() if n}
    lib, (texts, out) = Tokenizer.from_file(bpe.tokenizer_path("word_bpe_49k.json")), seen["encode"]
    text = {r.doc_id: r.text for r in texts.collect()}
    for r in out.orderBy("doc_id").limit(50).collect():
        ids = lib.encode(text[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert out.count() == texts.count()


def test_run_takes_an_empty_table(spark, tmp_path):
    for name in ("documents", "labels"):
        table(spark, SF, name).where(F.lit(False)).write.parquet(f"{tmp_path}/{name}.parquet")
    assert cp.run(spark, f"file://{tmp_path}").count() == 0
