"""Streams of listings into a versioned table: each micro-batch is a version, and a replayed one changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..versions import VersionedTable


def merged(known: DataFrame | None, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """The newest row of each key by ``order``; of equally new ones that of the stream's batch, then the largest."""
    rows = new.withColumn("__new", F.lit(1))
    if known is not None:
        rows = rows.unionByName(known.withColumn("__new", F.lit(0)), allowMissingColumns=True)
    columns = [c for c in rows.columns if c != "__new"]
    newest = F.max_by(F.struct(*columns), F.struct(order, "__new", F.xxhash64(*columns)))
    return rows.groupBy(*key).agg(newest.alias("__row")).select("__row.*")


def upsert_stream(rows: DataFrame, table: VersionedTable, order: str, checkpoint: str, name: str) -> StreamingQuery:
    """One scheduled run: what is there goes into the table, then it stops. name: of the stream, under which the table counts its batches.

    The checkpoint makes a batch of the same rows after a failure, and the table takes no batch number twice, so each counts once.
    """

    def take(batch: DataFrame, number: int) -> None:
        batch = batch.dropna(subset=table.key)
        table.write(lambda known: merged(known, batch, table.key, order), batch, (name, number))

    return rows.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
