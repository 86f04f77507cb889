"""Variant keys ``chrom_pos_ref_alt``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from locusframe.functions.chrom import chrom

#: The error texts.
MISSING, FIFTH, SUFFIX = "Failed to get next element of variant key.", "Invalid variant key, it has 5-th element: ", " Input variant key: "


def try_variant(key: Column) -> Column:
    """``struct(chrom, pos, ref_b, alt_b, error)``; either the fields or the error are null."""
    parts = F.split(key, "_", -1)
    n = F.size(parts)
    number = F.when(F.get(parts, F.lit(1)).rlike("^[+-]?[0-9]+$"), F.get(parts, F.lit(1))).try_cast("long")
    error = (
        F.when(key.isNull(), F.lit(None))
        .when(n >= 2, F.when(number.isNull(), F.lit("invalid position")))
        .otherwise(F.lit(MISSING))
    )
    error = F.coalesce(
        error,
        F.when(n < 4, F.lit(MISSING))
        .when(n > 4, F.concat(F.lit(FIFTH), key))
        .otherwise(F.lit(None).cast("string")),
    )
    good = error.isNull()
    field = lambda k: F.when(good, F.get(parts, F.lit(k)))
    return F.struct(
        F.when(good, chrom(F.get(parts, F.lit(0)))).alias("chrom"),
        F.when(good, number).alias("pos"),
        field(2).alias("ref_b"),
        field(3).alias("alt_b"),
        F.concat(error, F.lit(SUFFIX), key).alias("error"),
    )


def variant(key: Column) -> Column:
    """``struct(chrom, pos, ref_b, alt_b)``; raises for a malformed key."""
    v = try_variant(key)
    fields = F.struct(v["chrom"].alias("chrom"), v["pos"].alias("pos"), v["ref_b"].alias("ref_b"), v["alt_b"].alias("alt_b"))
    return F.when(v["error"].isNotNull(), F.raise_error(v["error"]).cast("struct<chrom:string,pos:bigint,ref_b:string,alt_b:string>")).otherwise(fields)


def region_1bp(v: Column) -> Column:
    """``struct(contig, start, end)``: from the position to the one after."""
    return F.struct(v["chrom"].alias("contig"), v["pos"].alias("start"), (v["pos"] + 1).alias("end"))
