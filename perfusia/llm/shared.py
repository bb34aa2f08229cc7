"""Table access and what the library has for durable tables and components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from perfusia.operators.components import components
from perfusia.sources.scratch import Scratch, shared_dir

__all__ = ["Scratch", "components", "shared_dir", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
