"""Pixel and colour expressions on byte-valued columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BT601 = (0.299, 0.587, 0.114)


def clamp_byte(v: Column) -> Column:
    """Saturate to 0 to 255."""
    return F.greatest(F.lit(0).cast("bigint"), F.least(F.lit(255).cast("bigint"), v))


def luma(r: str, g: str, b: str) -> Column:
    """Integer luma; the truncated weights sum to 255."""
    return F.shiftright(76 * F.col(r) + 150 * F.col(g) + 29 * F.col(b), 8)


def ycbcr(r: str, g: str, b: str) -> tuple[Column, Column, Column]:
    y = BT601[0] * F.col(r) + BT601[1] * F.col(g) + BT601[2] * F.col(b)
    return y, 0.5 * (F.col(b) - y) / (1 - BT601[2]), 0.5 * (F.col(r) - y) / (1 - BT601[0])


def hsv(r: str, g: str, b: str) -> tuple[Column, Column, Column]:
    """Hue in degrees (-1 for greys), saturation, value."""
    r, g, b = F.col(r), F.col(g), F.col(b)
    hi = F.greatest(r, g, b)
    d = hi - F.least(r, g, b)
    h = F.when(d == 0, F.lit(None).cast("double")).when(r == hi, (g - b) / d).when(g == hi, 2 + (b - r) / d).otherwise(4 + (r - g) / d) * 60
    return F.when(d == 0, -1.0).when(h < 0, h + 360).otherwise(h), F.when(d == 0, 0.0).otherwise(d / hi), hi.cast("double")


def yuv_to_rgb(y: str, u: str, v: str, saturation: float = 1.0) -> tuple[Column, Column, Column]:
    """ITU-R BT.601 with 8-bit coefficients; saturation scales them."""
    rv, gv, gu, bu = (int(k * saturation) for k in (359, -183, -88, 454))
    y, u, v = F.col(y), F.col(u) - 128, F.col(v) - 128
    return clamp_byte(y + F.shiftright(rv * v, 8)), clamp_byte(y + F.shiftright(gv * v + gu * u, 8)), clamp_byte(y + F.shiftright(bu * u, 8))


def distance(p: tuple, q: tuple, weights: tuple[int, int, int] = (76, 150, 29)) -> Column:
    """Weighted L1 distance of two pixels."""
    return sum((w * F.abs(a - b) for w, a, b in zip(weights, p, q)), F.lit(0))


def packed(order: tuple[str, ...]) -> Column:
    """The channels' bytes in this order, in hex."""
    return F.concat(*(F.format_string("%02X", F.col(c)) for c in order))


def weights(only: str) -> tuple[float, float, float]:
    """BT.601 luma weights of some channels ('rg', 'rb', 'gb', 'r', 'g', 'b'), scaled to add up to 1."""
    kept = [w if c in only else 0.0 for c, w in zip("rgb", BT601)]
    if not sum(kept) or set(only) - set("rgb"):
        raise ValueError("channels are of r, g and b")
    return tuple(w / sum(kept) for w in kept)  # type: ignore[return-value]


def weighted(r: str, g: str, b: str, w: tuple[float, float, float]) -> Column:
    return F.col(r) * w[0] + F.col(g) * w[1] + F.col(b) * w[2]


def grey(y: str) -> tuple[Column, Column, Column]:
    """A luma as red, green and blue."""
    return F.col(y), F.col(y), F.col(y)


def yuv_bytes(y: str, first: str, second: str, uv_order: str = "uv", rgb_order: str = "rgb", saturation: float = 1.0, offset: int = 0) -> tuple[Column, ...]:
    """The channels in the order of rgb_order ('a' is an opaque alpha), of chroma pairs in the order uv or vu, brightened by an offset."""
    u, v = (first, second) if uv_order == "uv" else (second, first)
    rv, gv, gu, bu = (int(k * saturation) for k in (359, -183, -88, 454))
    base, du, dv = F.col(y) + offset, F.col(u) - 128, F.col(v) - 128
    of = {"r": clamp_byte(base + F.shiftright(rv * dv, 8)), "g": clamp_byte(base + F.shiftright(gv * dv + gu * du, 8)), "b": clamp_byte(base + F.shiftright(bu * du, 8)), "a": F.lit(255).cast("bigint")}
    return tuple(of[c] for c in rgb_order)
