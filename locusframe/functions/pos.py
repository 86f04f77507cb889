"""Positions: stored 0-based, shown 0- or 1-based."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from locusframe.functions.chrom import chrom

MAX_LONG, MAX_U32 = 2**63 - 1, 2**32 - 1
#: The error texts; {} is the offending number.
NEGATIVE_ZERO_BASED = "0-based position must be >= 0, got {}"
NON_POSITIVE_ONE_BASED = "1-based position must be > 0, got {}"
OVERFLOW_ONE_BASED = "cannot represent 1-based position for 0-based value {}"
OUT_OF_RANGE_U32 = "position {} cannot be represented as u32"
VIOLATES, DOES_NOT_FIT = "cannot convert {} to Pos: value violates Pos invariants", "cannot convert {} to Pos: value does not fit into i64 range"
#: The integer types that convert, those that may be too large among them, and the one that tells the reason.
INTEGERS, UNSIGNED, REASONED = ("u32", "i32", "i64", "u64", "usize", "isize"), ("u64", "usize"), ("isize",)


def _text(message: str, value: Column) -> Column:
    before, after = message.split("{}")
    return F.concat(F.lit(before), value.cast("string"), F.lit(after))


def _result(value: Column, *problems: tuple[Column, Column]) -> Column:
    """``struct(pos, error)`` for the first problem that holds."""
    error = F.lit(None).cast("string")
    for holds, text in reversed(problems):
        error = F.when(holds, text).otherwise(error)
    return F.struct(F.when(error.isNull(), value).alias("pos"), error.alias("error"))


def or_raise(result: Column) -> Column:
    """The position of a ``try_*`` result; raises with its error text."""
    return F.when(result["error"].isNotNull(), F.raise_error(result["error"]).cast("long")).otherwise(result["pos"])


def try_from_0based(value: Column) -> Column:
    value = value.cast("long")
    return _result(
        value, (value < 0, _text(NEGATIVE_ZERO_BASED, value)), (value == MAX_LONG, _text(OVERFLOW_ONE_BASED, value))
    )


def try_from_1based(value: Column) -> Column:
    value = value.cast("long")
    return _result(F.when(value > 0, value - 1), (value <= 0, _text(NON_POSITIVE_ONE_BASED, value)))


def try_from_integer(value: Column, kind: str) -> Column:
    """A 0-based position from an integer of a type; u64 and usize come as decimals."""
    if kind not in INTEGERS:
        raise ValueError(f"kind must be one of {', '.join(INTEGERS)}")
    number = value.cast("decimal(20,0)")
    small = F.when(number <= F.lit(MAX_LONG).cast("decimal(20,0)"), number).cast("long")
    good = try_from_0based(small)
    if kind in REASONED:
        return good
    problems = [(good["error"].isNotNull(), F.lit(VIOLATES.format(kind)))]
    if kind in UNSIGNED:
        problems.insert(0, (number.isNotNull() & small.isNull(), F.lit(DOES_NOT_FIT.format(kind))))
    return _result(small, *problems)


def from_integer(value: Column, kind: str) -> Column:
    return or_raise(try_from_integer(value, kind))


def from_0based(value: Column) -> Column:
    return or_raise(try_from_0based(value))


def from_1based(value: Column) -> Column:
    return or_raise(try_from_1based(value))


def zero_based(pos: Column) -> Column:
    return pos


def one_based(pos: Column) -> Column:
    return pos + 1


def _u32(value: Column) -> Column:
    return _result(value, (~value.between(0, MAX_U32), _text(OUT_OF_RANGE_U32, value)))


def try_zero_based_u32(pos: Column) -> Column:
    return _u32(pos)


def try_one_based_u32(pos: Column) -> Column:
    return _u32(pos + 1)


def zero_based_u32(pos: Column) -> Column:
    return or_raise(try_zero_based_u32(pos))


def one_based_u32(pos: Column) -> Column:
    return or_raise(try_one_based_u32(pos))


def try_checked_add(pos: Column, step: Column) -> Column:
    moved = F.try_add(pos, step)
    good = try_from_0based(moved)
    return F.when(moved.isNull() & pos.isNotNull() & step.isNotNull(), _result(moved, (F.lit(True), _text(OVERFLOW_ONE_BASED, pos)))).otherwise(good)


def try_checked_sub(pos: Column, step: Column) -> Column:
    moved = F.try_subtract(pos, step)
    good = try_from_0based(moved)
    return F.when(moved.isNull() & pos.isNotNull() & step.isNotNull(), _result(moved, (F.lit(True), _text(NEGATIVE_ZERO_BASED, pos)))).otherwise(good)


def checked_add(pos: Column, step: Column) -> Column:
    return or_raise(try_checked_add(pos, step))


def checked_sub(pos: Column, step: Column) -> Column:
    return or_raise(try_checked_sub(pos, step))


def as_fetch(region: Column) -> Column:
    """``struct(contig, start, end)`` as it stands, without a shift."""
    return F.struct(region["contig"].alias("contig"), region["start"].alias("start"), region["end"].alias("end"))


def region(contig: Column, start: Column, end: Column) -> Column:
    """``struct(contig, start, end)`` with the canonical name of the contig."""
    return F.struct(chrom(contig).alias("contig"), start.cast("long").alias("start"), end.cast("long").alias("end"))
