"""Conversions between sample formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def u8_to_s16(x: Column) -> Column:
    return x * 256 - 32768


def wide_to_s16(x: Column, bits: int) -> Column:
    """From signed samples of 24, 32 or 64 bits."""
    return F.shiftright(x, bits - 16)


def float_to_s16(x: Column) -> Column:
    """Clamped to -1 to 1, scaled and cut off."""
    return (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)) * 32767).cast("bigint")


def u8_to_float(x: Column) -> Column:
    return x * (2.0 / 255) - 1


def signed_to_float(x: Column, bits: int) -> Column:
    return x / float(1 << (bits - 1))


def u8_to_s32(x: Column) -> Column:
    return (x - 128) * (1 << 24)


def s16_to_s32(x: Column) -> Column:
    return x * 65536


def float_to_s32(x: Column) -> Column:
    top = F.lit(2147483647).cast("bigint")
    return F.greatest(F.lit(-2147483648).cast("bigint"), F.least(top, (x * 2147483648.0).cast("bigint")))


def mulaw_table() -> list[int]:
    """The signed 16-bit value of each mu-law code."""
    out = []
    for code in range(256):
        c = ~code & 255
        v = (((c & 15) << 3) + 132 << ((c >> 4) & 7)) - 132
        out.append(-v if c & 128 else v)
    return out


def alaw_table() -> list[int]:
    """The signed 16-bit value of each A-law code."""
    out = []
    for code in range(256):
        c = code ^ 0x55
        e, m = (c >> 4) & 7, c & 15
        v = (m << 4) + 8 if e == 0 else ((m << 4) + 264) << (e - 1)
        out.append(v if c & 128 else -v)
    return out


def by_table(code: Column, table: list[int]) -> Column:
    return F.element_at(F.array(*(F.lit(v).cast("bigint") for v in table)), (code + 1).cast("int"))


def frame_bytes(bits: Column, channels: Column) -> Column:
    return F.floor(bits * channels / 8)


def padded_chunk(size: Column, to: int) -> Column:
    """A chunk's size with its padding to 2 (RIFF) or 8 (W64) bytes."""
    return F.ceil(size / to) * to
