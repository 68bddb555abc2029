"""Shared storage for intermediate tables, and readers of the given ones."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only a local master without that setting (tests) gets a folder of its own; a cluster without it is an error, since
    a machine-local folder would lose rows with its executor.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = spark.conf.get("stratalist.local.dir", None)
    if own is None:
        own = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("stratalist.local.dir", own)
    return own


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/stratalist/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once as Parquet in the shared folder and returns a scan of it.

    This cuts the lineage like ``checkpoint()`` but keeps column pruning and filter push-down, and the files outlive
    any executor.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables in a folder of their own in the shared storage, deleted together once their work is done."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.path, self.n = spark, new_path(spark, name), 0

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Like ``materialize``."""
        self.n += 1
        path = f"{self.path}/{name}-{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        delete(self.spark, self.path)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder of whatever file system Spark knows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
