"""Bases packed three bits each into an array of longs: 21 in a chunk of 64 bits, 5 in one of 16.

Codes are 1 to 5 in the order ATCGN; 0 stands for no base and ends a sequence.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The letters in the order of their codes, the codes as octal digits, bases in a chunk by its width in bits, chunks of an array.
ALPHABET, CODES, BASES_IN, CHUNKS = "ATCGN", "12345", {16: 5, 64: 21}, 8

#: The error texts.
INVALID_BASE, INVALID_AT = "Invalid base: %s", "Invalid base '%s' at position %d"
SLICE_TOO_LONG, ITER_TOO_LONG = "Input slice is too long: %d bases, max is %d", "Input iterator is too long, max is %d"
OUT_OF_BOUNDS = "Index out of bounds"


def capacity(bits: int = 64, chunks: int = CHUNKS) -> int:
    return BASES_IN[bits] * chunks


def code(base: Column) -> Column:
    """1 to 5; 0 for anything but a capital base."""
    return F.when(F.length(base) == 1, F.instr(F.lit(ALPHABET), base)).otherwise(F.lit(0))


def letter(of: Column) -> Column:
    """The base of a code; null for 0."""
    return F.when(of.between(1, len(ALPHABET)), F.substring(F.lit(ALPHABET), of.cast("int"), F.lit(1)))


def base(of: Column) -> Column:
    """A capital base as it is; raises for anything else."""
    return F.when(code(of) > 0, of).otherwise(F.raise_error(F.format_string(INVALID_BASE, of)).cast("string"))


def _first_wrong(seq: Column) -> Column:
    """1-based place of the first letter that is no base; 0 if there is none."""
    good = F.length(F.regexp_extract(seq, f"^[{ALPHABET}]*", 0))
    return F.when(good < F.length(seq), good + 1).otherwise(F.lit(0))


def _invalid(seq: Column, place: Column) -> Column:
    return F.format_string(INVALID_AT, F.substring(seq, place, F.lit(1)), place - 1)


def pack_error(seq: Column, bits: int = 64, chunks: int = CHUNKS, from_iter: bool = False) -> Column:
    """Why ``seq`` can't be packed; null if it can.  The length is looked at first, or, ``from_iter``, after the letters that
    would fit."""
    most, place = capacity(bits, chunks), _first_wrong(seq)
    wrong = F.when(place > 0, _invalid(seq, place))
    if from_iter:
        return F.coalesce(
            F.when(place <= most, wrong), F.when(F.length(seq) > most, F.lit(ITER_TOO_LONG % most))
        )
    long = F.format_string(SLICE_TOO_LONG, F.length(seq), F.lit(most))
    return F.coalesce(F.when(F.length(seq) > most, long), wrong)


def try_pack(seq: Column, bits: int = 64, chunks: int = CHUNKS, from_iter: bool = False) -> Column:
    """``array<bigint>``, null for what can't be packed."""
    each = BASES_IN[bits]

    def chunk(c: Column) -> Column:
        # Three bits a base are an octal digit a base, the first base last.  Only the chunk's own letters are changed to digits.
        octal = F.reverse(F.translate(F.substring(seq, c * each + 1, F.lit(each)), ALPHABET, CODES))
        return F.coalesce(F.conv(octal, 8, 10).cast("long"), F.lit(0).cast("long"))  # conv of no digit is null

    good = pack_error(seq, bits, chunks, from_iter).isNull() & seq.isNotNull()
    return F.when(good, F.transform(F.sequence(F.lit(0), F.lit(chunks - 1)), chunk))


def pack(seq: Column, bits: int = 64, chunks: int = CHUNKS, from_iter: bool = False) -> Column:
    error = pack_error(seq, bits, chunks, from_iter)
    return F.when(error.isNotNull(), F.raise_error(error).cast("array<bigint>")).otherwise(try_pack(seq, bits, chunks, from_iter))


def _code_at(packed: Column, index: Column, bits: int) -> Column:
    each = BASES_IN[bits]
    shifted = F.call_function("shiftrightunsigned", F.get(packed, F.floor(index / each).cast("int")), (F.pmod(index, F.lit(each)) * 3).cast("int"))
    return shifted.bitwiseAND(F.lit(7)).cast("int")


def get(packed: Column, index: Column, bits: int = 64) -> Column:
    """The base at a 0-based index; null beyond the capacity and where there is none."""
    return F.when(index >= 0, letter(_code_at(packed, index, bits)))


def bases(packed: Column, start: Column | None = None, end: Column | None = None, bits: int = 64) -> Column:
    """Text of the bases from ``start`` to before ``end``, clipped to the capacity, up to the first place without a base."""
    each = BASES_IN[bits]
    octal = lambda c: F.reverse(F.lpad(F.conv(c.cast("string"), 10, 8), each, "0"))
    digits = F.array_join(F.transform(packed, octal), "")
    if start is not None or end is not None:
        low = F.lit(0) if start is None else F.greatest(start, F.lit(0))
        high = F.lit(2**31 - 1) if end is None else end
        digits = F.substring(digits, (low + 1).cast("int"), F.greatest(high - low, F.lit(0)).cast("int"))
    # The text ends at the first place without a base.
    return F.translate(F.substring_index(digits, "0", 1), CODES, ALPHABET)


def set_base(packed: Column, index: Column, to: Column, bits: int = 64) -> Column:
    """With another base at a 0-based index; raises beyond the capacity and for what is no base.  May leave a hole, after
    which the text ends."""
    each = BASES_IN[bits]
    new = code(base(to)).cast("long")
    place = F.pmod(index, F.lit(each)) * 3
    shift = lambda x: F.call_function("shiftleft", x, place.cast("int"))
    changed = F.transform(
        packed,
        lambda c, k: F.when(k == F.floor(index / each), c.bitwiseAND(F.bitwise_not(shift(F.lit(7).cast("long")))).bitwiseOR(shift(new))).otherwise(c),
    )
    outside = (index < 0) | (index >= F.size(packed) * each)
    return F.when(outside, F.raise_error(F.lit(OUT_OF_BOUNDS)).cast("array<bigint>")).otherwise(changed)
