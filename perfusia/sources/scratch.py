"""Durable intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset a local session, as in tests, gets a folder of its own; a cluster gets an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.n = 0

    def path(self) -> str:
        self.n += 1
        return f"{self.root}/{self.n}"

    def keep(self, df: DataFrame) -> DataFrame:
        path = self.path()
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept.scratch_path = path
        return kept

    def bucketed(self, df: DataFrame, column: str) -> DataFrame:
        """A durable table laid out in as many buckets by a column as shuffles have partitions: a join on that column doesn't move it."""
        path, name = self.path(), f"perfusia_{uuid.uuid4().hex}"
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.repartition(buckets, column).write.bucketBy(buckets, column).sortBy(column).option("path", path).saveAsTable(name)
        kept = self.spark.table(name)
        kept.scratch_path = path
        return kept

    def drop(self, *kept: DataFrame) -> None:
        """Deletes tables that no later plan reads."""
        for df in kept:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
