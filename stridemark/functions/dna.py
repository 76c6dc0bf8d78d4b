"""Column functions on DNA strings; all of them null for null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(text: str | Column, letters: str = "acgt") -> Column:
    """Lower-case text without what is not among ``letters``: a sequence from any text."""
    return F.regexp_replace(F.lower(text), f"[^{letters}]", "")


def reverse_complement(seq: str | Column) -> Column:
    """The other strand, case kept; letters without a complement become n."""
    other = F.regexp_replace(seq, "[^acgtuACGTU]", "n")
    return F.reverse(F.translate(other, "acgtuACGTU", "tgcaaTGCAA"))


def codes(seq: str | Column, order: str = "actg") -> Column:
    """Array of 2-bit codes by the letters' places in ``order``; u is t, other letters are code 0."""
    plain = F.regexp_replace(F.translate(F.lower(seq), "u", "t"), "[^acgt]", order[0])
    return F.transform(F.split(plain, ""), lambda c: (F.instr(F.lit(order), c) - 1).cast("int"))


def pack_2bit(seq: str | Column, order: str = "actg") -> Column:
    """Four codes a byte, the first in the lowest bits; the last byte is filled with code 0."""
    plain = F.regexp_replace(F.translate(F.lower(seq), "u", "t"), "[^acgt]", order[0])
    fours = F.filter(F.split(F.translate(plain, order, "0123"), r"(?<=\G.{4})"), lambda x: x != "")
    return F.unhex(F.array_join(F.transform(fours, lambda x: F.lpad(F.conv(F.reverse(F.rpad(x, 4, "0")), 4, 16), 2, "0")), ""))


def rotl(x: Column, r: Column, bits: int) -> Column:
    """x rotated left by r of 0 to bits - 1; 32-bit values are longs from 0 to 2^32 - 1."""
    left = F.call_function("shiftleft", x, r)
    right = F.call_function("shiftrightunsigned", x, (F.lit(bits) - r).cast("int"))
    turned = left.bitwiseOR(right)
    return F.when(r == 0, x).otherwise(turned.bitwiseAND(F.lit(0xFFFFFFFF)) if bits == 32 else turned)


def ordered(x: Column) -> Column:
    """An unsigned 64-bit value, flipped so that longs sort as it does; its own inverse."""
    return x.bitwiseXOR(F.lit(-(1 << 63)))
