"""Operator 6: near-duplicate groups from SetSketch registers.

1. Each text becomes its set of word shingles (64-bit hashes) and a SetSketch: for each of ``REGISTERS`` hash functions the
   minimum over the set, as an exponential variable, truncated to an exponentially spaced scale of base ``BASE``. The
   registers of a union are the larger ones, so sketches merge; texts with equal word sequences share one sketch, and
   only one node stands for them from here on.
2. Bands of registers are bucket keys. A node's weight is the number of rows in all its buckets; the heaviest member of a
   bucket is its hub, which in a group of copies is close to what they were copied from. Each member is paired with its hubs.
3. The likelihood of the register comparisons of a pair (how many are larger, smaller, equal), given both set sizes,
   estimates the Jaccard similarity. Pairs that may be similar are verified on their full sets and joined to components.
4. What is left are buckets whose members lie in several components. There each member is described by how it differs from
   the hub: the number of shingles that only one of the two has, and ``PARTS`` bits of them. Two members have at most so much of
   these differences in common as their bits allow, which bounds their similarity from above. Only pairs of different
   components that pass this bound leave the join, and their full sets decide. No pair that shares a bucket is lost: there
   is no cap on buckets, partners or candidates, and no estimate rejects a pair for good. Two sets of similarity 0.8 share a
   bucket with a probability of 0.99994.
5. Components are reached over all confirmed links.

Defined results: words are runs of anything but the six ASCII white-space characters, A-Z are lower-cased; a text with
fewer words than a shingle has its whole sequence as one shingle; null texts and texts without words have an empty set and
are linked with nothing; repeated rows (same id, same text) are alike, and rows of one id with different texts are judged each by
its own text; a row without an id has that of its group, or null; an empty table gives an empty result; other columns are ignored
by ``near_groups`` and kept as they are, whatever their names, by ``drop_near_copies``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .shared import materialize, table, unused

BANDS, ROWS = 32, 6
REGISTERS = BANDS * ROWS
#: Registers that the likelihood compares, and the log-likelihood that a pair may lack before it has to wait for step 4.
ESTIMATED, SLACK = 96, 10.0
BASE, RATE, TOP = 1.001, 20.0, 2**16 - 2
#: Rows of which a worker makes sketches, sets or differences at a time.
AT_ONCE = 512
#: Bits, in words of 64, in which the differences of two sets from their hub are compared.
PARTS = 1024
WORDS = [f"w{i}" for i in range(PARTS // 64)]

_SEEDS = np.random.Generator(np.random.Philox(20)).integers(1, 2**63, size=(2, REGISTERS), dtype=np.uint64)
_MULTIPLY, _ADD = _SEEDS[0] * np.uint64(2) + np.uint64(1), _SEEDS[1]
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]


def _mix(h: np.ndarray) -> np.ndarray:
    for c in _ODD[2:]:
        h = (h ^ (h >> np.uint64(33))) * c
    return h ^ (h >> np.uint64(33))


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()  # bytes: only A-Z and the ASCII white space count


def shingle_set(words: list[bytes], k: int) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles, sorted."""
    if len(words) < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], dtype=np.uint64)[: len(words)]
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = len(h) - k + 1
    out = h[:n].copy()
    for i in range(1, k):
        out = _mix(out * _ODD[0] + h[i : i + n] + _ODD[1])
    return np.unique(out)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The registers of a set; an empty set has none but the lowest."""
    low = np.full(REGISTERS, 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(shingles), 1024):
        np.minimum(low, (shingles[at : at + 1024, None] * _MULTIPLY + _ADD).min(axis=0), out=low)
    x = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**64 * (1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(x) / math.log(BASE)), 0, TOP + 1).astype(np.uint16)


def band_keys(registers: np.ndarray) -> np.ndarray:
    h = np.arange(BANDS, dtype=np.uint64) * _ODD[0]
    for column in registers.reshape(BANDS, ROWS).T:
        h = _mix(h * _ODD[1] + column.astype(np.uint64) + _ODD[0])
    return h.view(np.int64)


def estimate_jaccard(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood of the similarity of each pair, and how much better it fits than any of ``least`` or more.

    No similarity is above ``top``, the quotient of the sizes; ``least`` is clipped to it, as 4/5 may round to just below 0.8.
    Pairs whose sizes exclude ``least`` are for the caller to drop, in integers.

    With u and v the shares of both cardinalities in their sum, P(a > b) = p(u - v J) and P(a < b) = p(v - u J), where
    p(x) = -log_B(1 - x (B - 1) / B).
    """
    up, down = (a > b).sum(axis=1).astype(float), (a < b).sum(axis=1).astype(float)
    equal = a.shape[1] - up - down
    u = n_a / (n_a + n_b)
    v = 1 - u
    top = np.minimum(u / v, v / u)

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / math.log(BASE)

    def likelihood(j: np.ndarray) -> np.ndarray:
        x, y = p(u - v * j), p(v - u * j)
        return up * np.log(np.maximum(x, 1e-12)) + down * np.log(np.maximum(y, 1e-12)) + equal * np.log(np.maximum(1 - x - y, 1e-12))

    low, high = np.zeros_like(u), top.copy()
    for _ in range(40):  # the likelihood is concave
        one, two = low + (high - low) / 3, high - (high - low) / 3
        better = likelihood(one) < likelihood(two)
        low, high = np.where(better, one, low), np.where(better, high, two)
    best = (low + high) / 2
    lack = likelihood(best) - likelihood(np.clip(best, np.minimum(least, top), top))
    return best, lack


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of ``AT_ONCE`` rows: what is made of a batch is many times its size, and a worker never gives that memory back."""
    for batch in batches:
        for at in range(0, batch.num_rows, AT_ONCE):
            yield batch.slice(at, AT_ONCE)


def _sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, mark, seq (names the word sequence), n, bands, registers (those that the likelihood compares)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            seq, n, bands, registers = [], [], [], []
            for t in batch.column("text"):
                words = words_of(t.as_py() or "")
                shingles = shingle_set(words, k)
                own = sketch(shingles)
                seq.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest())
                n.append(len(shingles))
                bands.append(band_keys(own) if len(shingles) else [])
                registers.append(own[:ESTIMATED].tobytes())
            columns = [batch.column("doc_id"), batch.column("mark"), pa.array(seq, pa.binary()), pa.array(n, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(registers, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "seq", "n", "bands", "registers"])

    return docs.select("doc_id", "mark", "text").mapInArrow(run, "doc_id long, mark binary, seq binary, n long, bands array<long>, registers binary")


def _sets(docs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            sets = [shingle_set(words_of(t.as_py() or ""), k).view(np.int64) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    return docs.select("node", "text").mapInArrow(run, "node long, shingles array<long>")


def _likely(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) those that the likelihood does not rule out."""
    for side in ("a", "b"):
        pairs = pairs.join(sketches.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("registers").alias(f"r_{side}")), side)
    # Sizes alone exclude a pair whose smaller set is less than that share of the larger.
    pairs = pairs.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            r_a, r_b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, ESTIMATED) for c in ("r_a", "r_b"))
            n_a, n_b = (batch.column(c).to_numpy().astype(float) for c in ("n_a", "n_b"))
            _, lack = estimate_jaccard(r_a, r_b, n_a, n_b, percent / 100)
            yield batch.select(["a", "b"]).filter(pa.array(lack <= SLACK))

    return pairs.select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(run, "a long, b long")


def _enough(n: Column, differ: Column, percent: int) -> Column:
    """Whether sets of ``n`` shingles together, ``differ`` of which only one has, are similar enough: 2 both = n - differ."""
    return (100 + percent) * (n - differ) >= 2 * percent * n


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("node").alias(side), F.col("shingles").alias(f"s_{side}")), side)
    return pairs


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    both, n = F.size(F.array_intersect("s_a", "s_b")), F.size("s_a") + F.size("s_b")
    return _with_sets(pairs, sets).where(_enough(n.cast("long"), (n - 2 * both).cast("long"), percent)).select("a", "b")


def _differences(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """For each pair of a node and its hub (a, b): n and n_hub, how many shingles differ, how many of them share a bit, the bits."""
    differ = F.transform(F.concat(F.array_except("s_a", "s_b"), F.array_except("s_b", "s_a")), lambda x: F.pmod(x, F.lit(PARTS)).cast("int"))
    rows = _with_sets(pairs, sets).select("a", "b", F.size("s_a").cast("long").alias("n"), F.size("s_b").cast("long").alias("n_hub"), differ.alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            at = batch.column("at")
            count = at.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            bits = np.zeros((batch.num_rows, PARTS), dtype=bool)
            bits[np.repeat(np.arange(batch.num_rows), count), at.flatten().to_numpy(zero_copy_only=False)] = True
            words = np.packbits(bits, axis=1, bitorder="little").view(np.int64)
            columns = [*(batch.column(c) for c in ("a", "b", "n", "n_hub")), pa.array(count), pa.array(count - bits.sum(axis=1)), *(pa.array(w) for w in words.T)]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "n", "n_hub", "differ", "hidden", *WORDS])

    return rows.mapInArrow(run, "a long, b long, n long, n_hub long, differ long, hidden long, " + ", ".join(f"{w} long" for w in WORDS))


def _rest(bucketed: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links (a, b) between different components that share a bucket."""
    labelled = bucketed.join(labels, "node", "left").select("key", "node", "hub", F.coalesce("component", "node").alias("component"))
    by = labelled.groupBy("key", "component").count()
    mixed = by.groupBy("key").agg(F.max_by("component", F.struct("count", "component")).alias("largest"), F.count("*").alias("components")).where("components > 1")
    members = materialize(labelled.join(mixed.select("key", "largest"), "key").where("node <> hub"), "members")
    hub_pairs = members.select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    differences = materialize(_differences(hub_pairs, sets), "differences")
    with_hub = differences.where(_enough(F.col("n") + F.col("n_hub"), F.col("differ"), percent)).select("a", "b")
    described = members.join(differences.drop("n_hub").withColumnsRenamed({"a": "node", "b": "hub"}), ["node", "hub"])
    # Within a bucket, only members outside its largest component look for partners: the largest is one component already.
    own = ["node", "component", "n", "differ", "hidden", *WORDS]
    left = described.where("component <> largest").select("key", "largest", *(F.col(c).alias(f"{c}_a") for c in own))
    right = described.select("key", *(F.col(c).alias(f"{c}_b") for c in own))
    fits = (F.col("component_a") != F.col("component_b")) & ((F.col("component_b") == F.col("largest")) | (F.col("node_a") < F.col("node_b")))
    fits = fits & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    # Common differences: as many as there are common bits, and those that hide behind another one's bit in either set.
    common = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{w}_a").bitwiseAND(F.col(f"{w}_b"))) for w in WORDS]) + F.least("hidden_a", "hidden_b")
    fits = fits & _enough(F.col("n_a") + F.col("n_b"), F.col("differ_a") + F.col("differ_b") - 2 * common, percent)
    pairs = left.join(right, "key").where(fits).select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()
    return _confirmed(materialize(pairs, "pairs"), sets, percent).unionByName(with_hub)


def _grouped(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, mark, component (a node), n_shingles, component_id for each row (doc_id, mark, text)."""
    rows = materialize(_sketches(docs, k), "sketches")
    # One node stands for all texts with the same words. Its number is written once and only read from there.
    nodes = rows.where("n > 0").groupBy("seq").agg(F.min(F.struct("doc_id", "mark")).alias("of"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("registers").alias("registers"))
    nodes = nodes.withColumn("low", F.col("of.doc_id")).withColumn("node", F.monotonically_increasing_id())
    nodes = materialize(nodes, "nodes")
    banded = nodes.select("node", F.explode("bands").alias("key"))
    sizes = banded.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    # Spark takes a node with all its bands for one row's size, and would send them all to the driver: these are never broadcast.
    bucketed = materialize(banded.hint("merge").join(sizes.hint("merge"), "key"), "buckets")
    weights = bucketed.groupBy("node").agg(F.sum("size").alias("weight"))
    hubs = bucketed.join(weights, "node").groupBy("key").agg(F.max_by("node", F.struct("weight", -F.col("node"))).alias("hub"))
    bucketed = materialize(bucketed.select("node", "key").join(hubs, "key"), "bucketed")
    pairs = bucketed.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    # One text for each node that shares a bucket.
    members = nodes.join(weights, "node", "left_semi").select("node", "of.*")
    sets = materialize(_sets(docs.join(members, ["doc_id", "mark"]).dropDuplicates(["doc_id", "mark"]), k), "sets")
    links = connected_components(_confirmed(materialize(_likely(pairs, nodes.select("node", "n", "registers"), percent), "likely"), sets, percent))
    more = _rest(bucketed, links, sets, percent)
    # What the second pass found links whole components: one edge for each two of them.
    for side in ("a", "b"):
        more = more.join(links.select(F.col("node").alias(side), F.col("component").alias(f"c_{side}")), side, "left")
    merged = connected_components(more.select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b")).distinct())
    component = nodes.select("node", "seq", "low").join(links, "node", "left").withColumn("first", F.coalesce("component", "node"))
    component = component.select("seq", "low", "first").join(merged.select(F.col("node").alias("first"), F.col("component").alias("last")), "first", "left")
    component = materialize(component.select("seq", "low", F.coalesce("last", "first").alias("component")), "components")
    lowest = component.groupBy("component").agg(F.min("low").alias("component_id"))
    out = rows.select("doc_id", "mark", "seq", "n").join(component.join(lowest, "component").select("seq", "component", "component_id"), "seq", "left")
    found = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "mark", "component", F.col("n").alias("n_shingles"), found.alias("component_id"))


#: Stands for a missing id, so that no row loses its partner.
NO_ID = 2**63 - 1


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id (never null), text, and a mark of the text: rows of one id may hold different texts."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.withColumn("mark", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))))


def near_groups(docs: DataFrame, *, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row."""
    out = _grouped(_marked(docs, id_col, text_col), k, percent)
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return out.select(known("doc_id"), "n_shingles", known("component_id"), ((F.col("component_id") == F.col("doc_id")) & (F.col("doc_id") != NO_ID)).alias("kept"))


def drop_near_copies(docs: DataFrame, *, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one for each group (of the lowest id, then of the lowest mark of its text), with all their columns."""
    kept = _grouped(_marked(docs, id_col, text_col), k, percent).where("component_id = doc_id")
    # A text without words is no group: of its rows with one id and one text, one stays.
    low = kept.where("n_shingles > 0").groupBy("component").agg(F.min(F.struct("doc_id", "mark")).alias("of")).select("of.*")
    low = low.unionByName(kept.where("n_shingles = 0").select("doc_id", "mark"))
    name_id, name_mark = unused(docs, 2)
    low = low.select(F.col("doc_id").alias(name_id), F.col("mark").alias(name_mark))
    keyed = docs.withColumns({name_id: F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), name_mark: F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))})
    return keyed.join(low, [name_id, name_mark], "left_semi").dropDuplicates([name_id, name_mark]).drop(name_id, name_mark)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), k=4, percent=80)


QUERIES = {"op6_near_dedup": op6_near_dedup}
ORACLES: dict[str, str] = {}
