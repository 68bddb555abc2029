"""A versioned table of keyed rows: immutable versions under one manifest that is replaced in one step.

Rows lie in buckets by a hash of their key. A write rewrites only the buckets that it touches and names them, with the untouched ones of
the version before, in the manifest of the new version; readers see whole versions only, older ones too. A writer that fails leaves
files that no manifest names. Two writers that start from one version cannot both succeed: a manifest's file is created once.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET = "__bucket"


class Conflict(RuntimeError):
    """Another writer has made the version first."""


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, key: str | list[str], buckets: int = 64) -> None:
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), [key] if isinstance(key, str) else key, buckets
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifest(self, version: int) -> str:
        return f"{self.path}/_versions/{version:010d}.json"

    def versions(self) -> list[int]:
        at = self._path(f"{self.path}/_versions")
        if not self._fs.exists(at):
            return []
        names = (f.getPath().getName() for f in self._fs.listStatus(at))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def manifest(self, version: int | None = None) -> dict:
        """buckets: folder of each bucket, schema, batch and version; of the last version if none is named."""
        if version is None:
            version = (self.versions() or [0])[-1]
        if version == 0:
            return {"version": 0, "buckets": {}, "schema": None, "batches": {}}
        stream = self._fs.open(self._path(self._manifest(version)))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, version: int | None = None, buckets: set[int] | None = None) -> DataFrame | None:
        """A version's rows, of some buckets only if these are named; null before the first version."""
        m = self.manifest(version)
        if m["schema"] is None:
            return None
        schema = StructType.fromJson(m["schema"])
        folders = sorted({f for b, f in m["buckets"].items() if buckets is None or int(b) in buckets})
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(BUCKET, F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int"))

    def write(self, merge: Callable[[DataFrame | None], DataFrame], touched: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """The next version: ``merge`` of the old rows of the touched buckets is their new content. touched: frame of keys.

        batch: (stream, number). One that the table has taken is not taken again, so a replay changes nothing.
        """
        m = self.manifest()
        if batch and m["batches"].get(batch[0], -1) >= batch[1]:
            return m["version"]
        hit = {r[0] for r in self.bucketed(touched.select(*self.key)).select(BUCKET).distinct().collect()}  # at most ``buckets``
        known = self.read(m["version"], hit) if m["schema"] is not None else None
        new = self.bucketed(merge(known))
        folder = f"{self.path}/data-{uuid.uuid4().hex}"
        new.repartition(BUCKET).write.partitionBy(BUCKET).parquet(folder)
        schema = new.drop(BUCKET).schema
        kept = {b: f for b, f in m["buckets"].items() if int(b) not in hit}
        written = self._fs.listStatus(self._path(folder))
        own = {n.split("=")[1]: f"{folder}/{n}" for n in (f.getPath().getName() for f in written) if n.startswith(f"{BUCKET}=")}
        if unknown := {int(b) for b in own} - hit:
            raise ValueError(f"rows of buckets that were not said to be touched: {sorted(unknown)[:3]}")
        after = {"version": m["version"] + 1, "buckets": kept | own, "schema": schema.jsonValue(), "batches": m["batches"] | ({batch[0]: batch[1]} if batch else {})}
        self._publish(after)
        return after["version"]

    def _publish(self, manifest: dict) -> None:
        pending = self._path(f"{self.path}/_versions/.{uuid.uuid4().hex}")
        out = self._fs.create(pending, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        at = self._path(self._manifest(manifest["version"]))
        if self._fs.exists(at) or not self._fs.rename(pending, at):
            self._fs.delete(pending, False)
            raise Conflict(f"version {manifest['version']} exists")

    def changes(self, old: int, new: int) -> DataFrame:
        """key columns and change (added, removed, changed) between two versions; buckets that both share are not read."""
        a, b = self.manifest(old)["buckets"], self.manifest(new)["buckets"]
        differ = {int(k) for k in {*a, *b} if a.get(k) != b.get(k)}
        side = lambda v, name: self.read(v, differ).select(*self.key, F.xxhash64(*[c for c in self.read(v).columns if c not in self.key]).alias(name))
        both = side(old, "before").join(side(new, "after"), self.key, "full_outer")
        change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "changed")
        return both.select(*self.key, change.alias("change")).where("change is not null")

    def expire(self, keep: int) -> None:
        """Forgets all but the last ``keep`` versions and deletes files that no manifest names any more."""
        gone, kept = self.versions()[:-keep], self.versions()[-keep:]
        live = {f.rsplit("/", 1)[0] for v in kept for f in self.manifest(v)["buckets"].values()}
        for v in gone:
            self._fs.delete(self._path(self._manifest(v)), False)
        for f in self._fs.listStatus(self._path(self.path)):
            name = f.getPath().getName()
            if name.startswith("data-") and f"{self.path}/{name}" not in live:
                self._fs.delete(f.getPath(), True)
