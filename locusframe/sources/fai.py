"""FASTA indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.operators.binning import bins_of_index

SCHEMA = "name string, len bigint, off bigint, line_bases int, line_width int"


def read_fai(spark: SparkSession, path: str) -> DataFrame:
    """An index with ``ord``, the order of its rows."""
    return spark.read.schema(SCHEMA).option("sep", "\t").csv(path).withColumn("ord", F.monotonically_increasing_id())


def bins_from_fasta(spark: SparkSession, fasta: str, width: int) -> DataFrame:
    """``chrom, bins`` of a FASTA file; only its index (``.fai`` beside it) is read."""
    return bins_of_index(read_fai(spark, f"{fasta}.fai"), width)
