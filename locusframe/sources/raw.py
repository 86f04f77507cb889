"""Raw bytes and cached copies of files."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_bytes(spark: SparkSession, path: str) -> DataFrame:
    """``path, length`` of files; their content isn't read."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def total_bytes(spark: SparkSession, path: str) -> DataFrame:
    return file_bytes(spark, path).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n_bytes"))


def in_memory(df: DataFrame) -> DataFrame:
    """A copy that stays in the executors' memory until ``unpersist``; lost parts are computed again."""
    return df.persist(StorageLevel.MEMORY_ONLY)
