"""DNA text.  Letters other than ACGT, in either case, become N, wherever they stand."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: ASCII characters that are no base, for ``translate``, which is much faster than a pattern on each character.
_OTHERS = "".join(chr(c) for c in range(1, 128) if chr(c) not in "ACGTNacgtn")


def complement(seq: Column) -> Column:
    ascii_ = F.translate(seq, "ACGTNacgtn" + _OTHERS, "TGCANTGCAN" + "N" * len(_OTHERS))
    # What is beyond ASCII, surrogate pairs included, and the zero character that translate cannot name.
    return F.when(ascii_.rlike("[^ACGTN]"), F.regexp_replace(ascii_, "[^ACGTN]", "N")).otherwise(ascii_)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def generated(seed: Column, length: int, alphabet: str = "ACGTN") -> Column:
    """A sequence that depends on ``seed`` only: four hexadecimal digits of MD5 give a letter, one MD5 gives eight.

    Each MD5 is made once and read as two words of 64 bits, which give four letters each.  A null seed gives an empty text.
    """
    letters = F.array(*[F.lit(c) for c in alphabet])
    blocks = F.transform(F.sequence(F.lit(0), F.lit((length - 1) // 8)), lambda k: F.md5(F.concat(seed.cast("string"), F.lit(":"), k.cast("string"))))
    word = lambda block, at: F.conv(F.substring(block, at, 16), 16, -10).cast("long")
    words = F.flatten(F.transform(blocks, lambda block: F.array(word(block, 1), word(block, 17))))
    number = lambda of, bits: F.shiftrightunsigned(of, bits).bitwiseAND(F.lit(0xFFFF)).cast("int")
    letter = lambda of, bits: F.element_at(letters, F.pmod(number(of, bits), F.lit(len(alphabet))) + 1)
    fours = F.transform(words, lambda of: F.concat(*[letter(of, bits) for bits in (48, 32, 16, 0)]))
    return F.substring(F.array_join(fours, ""), 1, length)
