"""Lane arithmetic: element-wise operations on vectors of fixed-width integers.

Lanes are bigint columns that hold values of a width of 8, 16 or 32 bits, signed
or not. Wrapping, saturation and narrowing are exact and never overflow.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def limits(bits: int, signed: bool) -> tuple[int, int]:
    return (-(1 << (bits - 1)), (1 << (bits - 1)) - 1) if signed else (0, (1 << bits) - 1)


def wrap(v: Column, bits: int, signed: bool) -> Column:
    """The value modulo 2**bits, in the lane's range."""
    low = v.bitwiseAND(F.lit((1 << bits) - 1))
    return F.when(low >= 1 << (bits - 1), low - (1 << bits)).otherwise(low) if signed else low


def saturate(v: Column, bits: int, signed: bool) -> Column:
    lo, hi = limits(bits, signed)
    return F.greatest(F.lit(lo).cast("bigint"), F.least(F.lit(hi).cast("bigint"), v))


def mask_of(condition: Column, bits: int, signed: bool) -> Column:
    """All ones where the condition holds, else 0."""
    return F.when(condition, -1 if signed else (1 << bits) - 1).otherwise(0).cast("bigint")


def select(mask: Column, a: Column, b: Column) -> Column:
    return F.when(mask != 0, a).otherwise(b)


def avg(a: Column, b: Column) -> Column:
    """Rounded average."""
    return F.shiftright(a + b + 1, 1)


def sub_div2(a: Column, b: Column) -> Column:
    """Half of the difference, rounded down."""
    return F.shiftright(a - b, 1)


def mul_hi(a: Column, b: Column, bits: int) -> Column:
    return F.shiftright(a * b, bits)


def mul_q15(a: Column, b: Column) -> Column:
    """Product of two Q15 numbers, rounded and saturated."""
    return saturate(F.shiftright(F.shiftright(a * b, 14) + 1, 1), 16, True)


def shift_left(v: Column, n: int, bits: int, signed: bool, saturating: bool = False) -> Column:
    return saturate(v * (1 << n), bits, signed) if saturating else wrap(v * (1 << n), bits, signed)


def shift_by(v: Column, n: Column, bits: int, signed: bool) -> Column:
    """Per-lane shift: left for positive counts, right for negative ones."""
    return F.when(n >= 0, wrap(v * F.pow(F.lit(2), n).cast("bigint"), bits, signed)).otherwise(F.floor(v / F.pow(F.lit(2), -n)).cast("bigint"))


def clz(v: Column, bits: int) -> Column:
    """Leading zeros of an unsigned lane."""
    return F.when(v == 0, bits).otherwise(bits - F.length(F.bin(v))).cast("bigint")


def bits_of(a: Column, b: Column, what: str) -> Column:
    return {"and": a.bitwiseAND(b), "or": a.bitwiseOR(b), "xor": a.bitwiseXOR(b), "and_not": a.bitwiseAND(F.bitwise_not(b)), "or_not": a.bitwiseOR(F.bitwise_not(b))}[what]


def interleave(a: Column, b: Column) -> Column:
    """a0, b0, a1, b1, ... of two arrays."""
    return F.flatten(F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda s: F.array(s["a"], s["b"])))


def deinterleave(v: Column, n: int, k: int) -> Column:
    """Every n-th element of an array, from the k-th on."""
    return F.filter(v, lambda _, i: i % n == k)


def pairwise_add(v: Column) -> Column:
    """Sums of neighbouring pairs of an array of even length."""
    pairs = F.transform(F.sequence(F.lit(1), (F.size(v) / 2).cast("int")), lambda i: F.element_at(v, 2 * i - 1) + F.element_at(v, 2 * i))
    return F.when(F.size(v) > 1, pairs).otherwise(F.slice(v, 1, 0))


def sad(a: Column, b: Column) -> Column:
    """Sum of absolute differences of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0).cast("bigint"), lambda s, x: s + x)


def look_up(table: list[int], at: Column) -> Column:
    """The entry of a table at each lane's value; 0 beyond its end."""
    t = F.array(*(F.lit(x).cast("bigint") for x in table))
    return F.when(at < len(table), F.try_element_at(t, (at + 1).cast("int"))).otherwise(0)
