"""Rounding as Python 3 does: half to even, on the exact binary value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def py_round(value: Column, digits: int = 0) -> Column:
    """``round(value, digits)``.  What is not finite, and more than 308 digits, leave the value as it is."""
    value = value.cast("double")
    odd = F.isnan(value) | F.abs(value).eqNullSafe(F.lit(float("inf")))
    if digits == 0:
        rounded = F.rint(value)
    elif digits > 308:
        rounded = value
    elif digits > 0:
        # format_number puts out the exact decimal expansion, correctly rounded.
        rounded = F.call_function("format_number", value, F.lit("0." + "0" * digits)).cast("double")
    elif digits < -308:
        rounded = value
    else:
        rounded = F.rint(value / F.lit(10.0**-digits)) * F.lit(10.0**-digits)
    return F.when(odd | value.isNull(), value).otherwise(rounded)


def py_round0(value: Column) -> Column:
    return py_round(value, 0)
