"""Pairs of reads by their place in two files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def zip_mates(r1: DataFrame, r2: DataFrame, key: str = "rec") -> DataFrame:
    """The n-th record of one with the n-th of the other: ``rec, r1, r2``; where one has ended its struct is null.

    Headers are not compared.
    """
    left = r1.select(key, F.struct(*[c for c in r1.columns if c != key]).alias("r1"))
    right = r2.select(key, F.struct(*[c for c in r2.columns if c != key]).alias("r2"))
    return left.join(right, key, "full_outer")


def mate_totals(pairs: DataFrame) -> DataFrame:
    """``r1_records, r2_records, r1_bases, r2_bases``."""
    length = lambda c: F.coalesce(F.sum(F.length(f"{c}.sequence")), F.lit(0)).cast("long")
    return pairs.agg(
        F.count("r1").alias("r1_records"), F.count("r2").alias("r2_records"), length("r1").alias("r1_bases"), length("r2").alias("r2_bases")
    )
