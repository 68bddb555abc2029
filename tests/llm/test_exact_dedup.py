from __future__ import annotations

import hashlib
import random

import pytest

from stratalist.llm import exact_dedup as ed

UP = str.maketrans(ed.UPPER, ed.LOWER)


def made() -> list[tuple[int, str | None, str]]:
    rng = random.Random(3)
    rows = [(i, rng.choice(["Hot text", "hot TEXT"]), "x") for i in range(600)]  # a third of all rows
    rows += [(1000 + i, f"text {i % 400} " + "same opening " * (i % 3), "y") for i in range(1200)]
    rows += [(5000, None, "z"), (5001, "", "z"), (5002, "Ä", "z"), (5003, "ä", "z"), (5004, "long " * 40_000, "z"), (5005, "LONG " * 40_000, "z"), (-5, "Hot text", "n")]
    return [*rows, rows[700], rows[700], (599, rows[599][1], "x")]


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_groups_equal_brute_force(spark, keep):
    rows = made()
    docs = spark.createDataFrame(rows, "doc_id long, text string, keep_id string").repartition(7)
    by: dict = {}
    for i, t, _ in rows:
        by.setdefault((t or "").translate(UP), []).append(i)
    pick = max if keep == "largest" else min
    want = sorted((i, pick(ids), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in by.items() for i in ids)
    got = ed.content_groups(docs, keep=keep).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = sorted(r.doc_id for r in got if r.kept)
    assert kept == sorted(pick(ids) for ids in by.values())
    left = ed.drop_exact_copies(docs, keep=keep)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == kept


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ed.content_groups(docs).count() == 0 and ed.drop_exact_copies(docs).count() == 0


def test_rows_without_an_id_and_columns_of_any_name(spark):
    rows = [(None, "a", 1, "p"), (None, "A", 2, "q"), (7, "b", 3, "r"), (None, "B", 4, "s"), (8, "c", 5, "t"), (8, "c", 6, "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_id int, part string")
    got = sorted((r.keep_id or 0, r.group_size, r.kept) for r in ed.content_groups(docs, keep="largest").collect())
    assert got == [(0, 2, False), (0, 2, True), (7, 2, False), (7, 2, True), (8, 2, False), (8, 2, True)]
    left = ed.drop_exact_copies(docs)
    assert left.columns == docs.columns
    assert sorted(r.text.lower() for r in left.collect()) == ["a", "b", "c"] and {r.row_id for r in left.collect()} & {3}


def test_splitters_are_short_but_for_repeated_texts():
    long = "x" * 1000
    assert ed.shorten([("abc" + long, 1), ("abd" + long, 2), ("b" + long, 3), ("b" + long, 9), ("b" + long, 9)]) == [
        ("a", ed.NO_ID), ("abd", ed.NO_ID), ("b", ed.NO_ID), ("b" + long, 9),
    ]


def test_partitions_are_sorted_by_content(spark):
    docs = spark.createDataFrame([(r[0], r[1]) for r in made()], "doc_id long, text string").repartition(6)
    rows = ed.content_sorted(docs, ed.normalized(docs.text), docs.doc_id).rdd.glom().collect()
    ends = [((p[0].text, p[0].row_id), (p[-1].text, p[-1].row_id)) for p in rows if p]
    assert len(ends) > 2 and all(a[1] <= b[0] for a, b in zip(ends, ends[1:], strict=False))
    assert all(p == sorted(p, key=lambda r: (r.text, r.row_id)) for p in rows)
