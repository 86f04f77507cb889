"""Fixed-width bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.functions.chrom import chrom


def bins(start: Column, end: Column, width: Column) -> Column:
    """``array<struct<lo, hi>>`` of half-open bins over [start, end), the last one clipped; empty if start >= end.

    Raises for a width below 1.
    """
    step = F.when(width < 1, F.raise_error(F.lit("bin width must be at least 1")).cast("long")).otherwise(width)
    # sequence() rejects a range that runs backwards, even where the branch isn't taken.
    last = F.greatest(end - 1, start)
    made = F.transform(F.sequence(start, last, step), lambda x: F.struct(x.alias("lo"), F.least(x + width, end).alias("hi")))
    return F.when(start < end, made).otherwise(F.array().cast("array<struct<lo:bigint,hi:bigint>>"))


def bins_of_index(index: DataFrame, width: int) -> DataFrame:
    """``chrom, bins`` for the sequences of a reference index (``name, len, ord``).

    Names that are the same chromosome count once: the last in the order of the index.
    """
    last = index.groupBy(chrom(F.col("name")).alias("chrom")).agg(F.max_by("len", "ord").alias("len"))
    return last.select("chrom", bins(F.lit(0).cast("long"), F.col("len"), F.lit(width).cast("long")).alias("bins"))


def stepped(regions: DataFrame, step: int, *keep: str) -> DataFrame:
    """``contig, pos``, and the columns to keep: every ``step``-th position of half-open regions (``contig, start, end``) from their start.

    A region of any length is taken apart in two levels, so that no row holds more than 4,096 positions.  Empty regions, and those
    with a null border, have no position.
    """
    if step < 1:
        raise ValueError("step must be at least 1")
    stride = step * 4096
    blocks = regions.where("start < end").select(
        "contig", "end", *keep, F.explode(F.sequence("start", F.col("end") - 1, F.lit(stride).cast("long"))).alias("block")
    )
    last = F.least(F.col("block") + stride, F.col("end")) - 1
    return blocks.select("contig", *keep, F.explode(F.sequence("block", last, F.lit(step).cast("long"))).alias("pos"))
