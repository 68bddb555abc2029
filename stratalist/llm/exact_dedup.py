"""Operator 9: exact deduplication by content sort.

Texts are equal when they are identical after lower-casing A-Z only; a null text counts as empty. The rows are range
partitioned on (normalised text, id) and sorted by the same key within each partition (Spark's external sort), so equal texts
stand next to each other, and neighbours are compared in full.

The splitters come from a sample of the rows, sorted by the same key: evenly spaced ones are taken, and each is cut after the
first character in which it differs from the splitter before it, so they stay short however long the texts are. Only where
two splitters fall into one text does that text stay whole, with the id as second part of the key: a text that a third of all
rows share is cut over as many partitions as its rows need. Their number is that of the partitions. Groups cut by a splitter are
joined again from one row for the first and the last run of each partition.

Defined results: null and empty texts form one group; equal rows (same id, same text) count as members of the group
and exactly one of them stays; a row without an id comes last in its group, so it stays only where no other does (its
``keep_id`` is then null); an empty table gives an empty result; other columns of the input are ignored by ``content_groups`` and
kept as they are by ``drop_exact_copies``, whatever their names.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import materialize, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows that are sampled for each splitter.
SAMPLED = 24
#: Stands for a missing id; it is lower than any sorted id.
NO_ID = -(2**63)


def normalized(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def shorten(splitters: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """Sorted splitters, each cut to what tells it from the one before; equal texts stay whole, with their ids."""
    out: list[tuple[str, int]] = []
    last = None
    for text, row_id in splitters:
        if last is None or text != last:
            n = next((i for i, (a, b) in enumerate(zip(last or "", text, strict=False)) if a != b), min(len(last or ""), len(text)))
            out.append((text[: n + 1], NO_ID))
        else:
            out.append((text, row_id))
        last = text
    return sorted(set(out))


def splitters(docs: DataFrame, text: Column, row_id: Column, parts: int) -> list[tuple[str, int]]:
    """About ``parts`` splitters of (text, row_id), in order."""
    n = docs.count()
    if n == 0 or parts < 2:
        return []
    share = min(1.0, SAMPLED * parts / n)
    sampled = materialize((docs.sample(share, seed=9) if share < 1 else docs).select(text.alias("text"), row_id.alias("row_id")), "sample")
    every = max(1, sampled.count() // parts)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The sorted sample in one task: a bounded number of rows for each partition.
        seen, taken = 0, []
        for batch in batches:
            for i in range((-seen - 1) % every, batch.num_rows, every):
                taken.append((batch.column("text")[i].as_py(), batch.column("row_id")[i].as_py()))
            seen += batch.num_rows
        short = shorten(taken)
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in short], pa.string()), pa.array([x[1] for x in short], pa.int64())], ["text", "row_id"])

    picked = sampled.coalesce(1).sortWithinPartitions("text", "row_id").mapInArrow(pick, "text string, row_id long")
    return [(r.text, r.row_id) for r in picked.collect()]


def content_sorted(docs: DataFrame, text: Column, row_id: Column, *more: Column) -> DataFrame:
    """Rows (text, row_id, ...) in range partitions, sorted by text and id within each."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = spark.sparkContext.broadcast(splitters(docs, text, row_id, parts))
    keyed = docs.select(text.alias("text"), row_id.alias("row_id"), *more)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            key = zip(batch.column("text").to_pylist(), batch.column("row_id").to_pylist(), strict=True)
            at = pa.array((bisect_right(own, k) for k in key), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, at], [*batch.schema.names, "part"])

    placed = keyed.mapInArrow(place, StructType([*keyed.schema.fields]).add("part", "integer"))
    return placed.repartitionById(len(shared.value) + 1, F.col("part")).sortWithinPartitions("text", "row_id")


_RUNS = pa.schema(
    [("row_id", pa.int64()), ("sha", pa.binary()), ("part", pa.int32()), ("run", pa.int64()), ("edge", pa.bool_()),
     ("best", pa.int64()), ("size", pa.int64()), ("at_best", pa.bool_()), ("edge_text", pa.string())]
)
_RUNS_DDL = "row_id long, sha binary, part int, run long, edge boolean, best long, size long, at_best boolean, edge_text string"


def _run_rows(part: int, runs: list[tuple[int, bool, list[np.ndarray], str]]) -> pa.RecordBatch:
    """One row for each member of some finished runs: (number, at an edge of the partition, ids, text)."""
    ids = [np.concatenate(x[2]) for x in runs]  # sorted: the partition is
    sizes = np.array([len(x) for x in ids])
    last = np.cumsum(sizes) - 1
    at_best = np.zeros(sizes.sum(), dtype=bool)
    at_best[last] = True
    edge_text = np.full(len(at_best), None, dtype=object)
    for (_, edge, _, text), at in zip(runs, last, strict=True):
        if edge:
            edge_text[at] = text

    def spread(values, kind):
        return pa.array(np.repeat(np.array(values, dtype=kind), sizes))

    shas = pa.array([hashlib.sha256(x[-1].encode()).digest() for x in runs], pa.binary()).take(pa.array(np.repeat(np.arange(len(runs)), sizes)))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(ids)), shas, spread([part] * len(runs), np.int32), spread([x[0] for x in runs], np.int64), spread([x[1] for x in runs], bool),
         spread([x[-1] for x in ids], np.int64), spread(sizes, np.int64), pa.array(at_best), pa.array(edge_text, pa.string())],
        schema=_RUNS,
    )


def _mark_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal neighbours in one sorted partition; the ids of the open run wait for its end, texts do not."""
    part, run = TaskContext.get().partitionId(), 0
    text, ids = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        texts, own = batch.column("text"), batch.column("row_id").to_numpy(zero_copy_only=False)
        same = np.zeros(len(own), dtype=bool)
        same[1:] = pc.equal(texts[1:], texts[:-1]).to_numpy(zero_copy_only=False)
        same[0] = text is not None and texts[0].as_py() == text
        cuts = [*np.flatnonzero(~same), len(own)]
        if cuts[0] > 0:  # the open run goes on
            ids.append(own[: cuts[0]])
        done = []
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            if text is not None:
                done.append((run, run == 0, ids, text))
                run += 1
            text, ids = texts[int(start)].as_py(), [own[start:end]]
        if done:
            yield _run_rows(part, done)
    if text is not None:
        yield _run_rows(part, [(run, True, ids, text)])


def _last_of_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each run of equal neighbours in one sorted partition its last row, with part, run, edge and the text of an edge."""
    part, run, held = TaskContext.get().partitionId(), 0, None

    def marked(rows: pa.RecordBatch, first: int, ends: bool) -> pa.RecordBatch:
        edge = np.zeros(rows.num_rows, dtype=bool)
        edge[0] |= first == 0
        edge[-1] |= ends
        edge_text = [None] * rows.num_rows
        for i in np.flatnonzero(edge).tolist():
            edge_text[i] = rows.column("text")[i].as_py()
        columns = [rows.column("row"), rows.column("row_id"), pa.array(np.full(rows.num_rows, part, np.int32)), pa.array(np.arange(first, first + rows.num_rows)), pa.array(edge), pa.array(edge_text, pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["row", "row_id", "part", "run", "edge", "edge_text"])

    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column("text")
        if held is not None and held.column("text")[0] != texts[0]:
            yield marked(held, run, False)
            run += 1
        ends = np.append(pc.not_equal(texts[1:], texts[:-1]).to_numpy(zero_copy_only=False).astype(bool), False)
        if (done := batch.filter(pa.array(ends))).num_rows:
            yield marked(done, run, False)
            run += done.num_rows
        held = batch.slice(batch.num_rows - 1)
    if held is not None:
        yield marked(held, run, True)


def _signed_id(id_col: str, keep: str) -> tuple[int, Column]:
    """Ids in the order in which the last one stays; a missing id comes first."""
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep is 'smallest' or 'largest', not {keep!r}")
    sign = 1 if keep == "largest" else -1
    return sign, F.coalesce(sign * F.col(id_col).cast("long"), F.lit(NO_ID))


def _whole_groups(edges: DataFrame) -> DataFrame:
    """part, run, all_best, all_size, keeps, for runs (part, run, best, size, edge_text) at the edges of partitions.

    At most two rows a partition, so the size is bounded by the number of partitions whatever the data.
    """
    whole = edges.groupBy("edge_text").agg(F.max("best").alias("all_best"), F.sum("size").alias("all_size"), F.collect_list(F.struct("part", "run", "best")).alias("of"))
    # Where several partitions hold the best id (repeated rows), the first of them keeps its row.
    first = F.array_min(F.filter("of", lambda x: x["best"] == F.col("all_best")))
    whole = whole.select("all_best", "all_size", first.alias("first"), F.inline("of"))
    return whole.select("part", "run", "all_best", "all_size", (F.struct("part", "run", "best") == F.col("first")).alias("keeps"))


def content_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row for each input row: doc_id, keep_id, group_size, kept, text_sha256.

    keep: ``smallest`` or ``largest`` id of a group stays.
    """
    sign, row_id = _signed_id(id_col, keep)
    ordered = content_sorted(docs, normalized(F.col(text_col)), row_id)
    runs = materialize(ordered.select("row_id", "text").mapInArrow(_mark_runs, _RUNS_DDL), "runs")
    whole = _whole_groups(runs.where("edge and at_best").select("part", "run", "best", "size", "edge_text"))
    joined = runs.drop("edge_text").join(F.broadcast(whole), ["part", "run"], "left")
    best = F.coalesce("all_best", "best")

    def known(c: Column) -> Column:
        return F.when(c != NO_ID, sign * c)

    return joined.select(
        known(F.col("row_id")).alias("doc_id"),
        known(best).alias("keep_id"),
        F.coalesce("all_size", "size").alias("group_size"),
        (F.col("at_best") & (F.col("row_id") == best) & F.coalesce("keeps", F.lit(True))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of repeated rows one stays. The sorted pass carries the rows."""
    _, row_id = _signed_id(id_col, keep)
    ordered = content_sorted(docs, normalized(F.col(text_col)), row_id, F.struct("*").alias("row")).select("row", "row_id", "text")
    schema = StructType([ordered.schema["row"], ordered.schema["row_id"]]).add("part", "integer").add("run", "long").add("edge", "boolean").add("edge_text", "string")
    runs = materialize(ordered.mapInArrow(_last_of_runs, schema), "last-rows")
    edges = runs.where("edge").select("part", "run", F.col("row_id").alias("best"), F.lit(1).alias("size"), "edge_text")
    joined = runs.select("row", "part", "run").join(F.broadcast(_whole_groups(edges)).select("part", "run", "keeps"), ["part", "run"], "left")
    return joined.where(F.coalesce("keeps", F.lit(True))).select("row.*")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_groups(table(spark, sf_dir, "documents"), keep="largest")


QUERIES = {"op9_exact_dedup": op9_exact_dedup}

ORACLES = {
    "op9_exact_dedup": f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size, sha256(norm) AS text_sha256 FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, g.text_sha256 FROM t JOIN g ON t.norm = g.norm"""
}
