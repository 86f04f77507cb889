"""Chromosome names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIX = "chr"
#: The names of the standard chromosomes without their prefix.
CORES = [*(str(n) for n in range(1, 23)), "X", "Y", "M"]
STANDARD = [PREFIX + c for c in CORES]
#: Autosomes and sex chromosomes; the mitochondrial one is not among them.
TYPICAL = [c for c in STANDARD if c != "chrM"]


def chrom(name: Column) -> Column:
    """Canonical name: prefixed.  Never fails; the prefix is case-sensitive, so ``ChrEBV`` gives ``chrChrEBV``."""
    return F.when(name.startswith(PREFIX), name).otherwise(F.concat(F.lit(PREFIX), name))


to_prefixed = chrom


def to_unprefixed(name: Column) -> Column:
    """Without one leading prefix."""
    return F.when(name.startswith(PREFIX), F.substring(name, len(PREFIX) + 1, 2**31 - 1)).otherwise(name)


def typical_chroms() -> Column:
    return F.array(*[F.lit(c) for c in TYPICAL])


def is_typical(name: Column) -> Column:
    return name.isin(TYPICAL)


def is_standard(name: Column) -> Column:
    """Whether the name, with or without its prefix, is one of the 25 standard ones."""
    return to_unprefixed(name).isin(CORES)


def chrom_rank(name: Column) -> Column:
    """Karyotypic order of canonical names: 1 to 25 for the standard ones, 26 for all others."""
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(c) for c in STANDARD]), name), F.lit(0)), F.lit(26)).cast("int")
