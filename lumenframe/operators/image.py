"""Image operators on pixel tables: one row (id, y, x, v) for each pixel.

Sizes are given where an operator needs them. Windows and joins run per image,
so that images spread over all executors. Values are whole numbers as of
unsigned bytes unless an operator says otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenframe.operators import frames


def integral(img: DataFrame, key: str) -> DataFrame:
    """Inclusive two-dimensional prefix sums of v, as ii."""
    rows = Window.partitionBy(key, "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    cols = Window.partitionBy(key, "x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    return img.withColumn("ii", F.sum("v").over(rows)).withColumn("ii", F.sum("ii").over(cols))


def crop(img: DataFrame, y: int, x: int, h: int, w: int) -> DataFrame:
    """The pixels of a rectangle, moved to the origin."""
    return img.where(F.col("y").between(y, y + h - 1) & F.col("x").between(x, x + w - 1)).withColumns({"y": F.col("y") - y, "x": F.col("x") - x})


def turned(img: DataFrame, how: str, h: int, w: int) -> DataFrame:
    """Rotation by 90, 180 or 270 degrees clockwise ('90', '180', '270') or a vertical flip ('flip')."""
    y, x = F.col("y"), F.col("x")
    ny, nx = {"90": (x, h - 1 - y), "180": (h - 1 - y, w - 1 - x), "270": (w - 1 - x, y), "flip": (h - 1 - y, x)}[how]
    return img.withColumns({"y": ny, "x": nx})


def half_up(a: Column, b: Column) -> Column:
    """Rounded average (a + b + 1) >> 1."""
    return F.shiftright(a + b + 1, 1)


def taps(img: DataFrame, key: list[str], n: int) -> DataFrame:
    """One row for each n x n block (key, y, x) with its pixels as p00, p01, ..."""
    y, x = F.col("y"), F.col("x")
    at = [F.max(F.when((y % n == i) & (x % n == j), F.col("v"))).alias(f"p{i}{j}") for i in range(n) for j in range(n)]
    return img.groupBy(*key, F.floor(y / n).alias("by"), F.floor(x / n).alias("bx")).agg(*at).withColumnsRenamed({"by": "y", "bx": "x"})


def downscale_average(img: DataFrame, key: list[str], n: int) -> DataFrame:
    """Downscale by 2, 3 or 4 with cascaded rounded averages."""
    t = taps(img, key, n)
    p = lambda i, j: F.col(f"p{i}{j}")
    if n == 2:
        v = half_up(half_up(p(0, 0), p(0, 1)), half_up(p(1, 0), p(1, 1)))
    elif n == 3:
        a = half_up(half_up(p(0, 0), p(0, 1)), half_up(p(0, 2), p(1, 0)))
        b = half_up(half_up(p(2, 0), p(2, 1)), half_up(p(2, 2), p(1, 2)))
        s = half_up(a, b)
        v = half_up(half_up(half_up(p(1, 1), s), s), s)
    elif n == 4:
        r = [half_up(half_up(p(i, 0), p(i, 1)), half_up(p(i, 2), p(i, 3))) for i in range(4)]
        v = half_up(half_up(r[0], r[1]), half_up(r[2], r[3]))
    else:
        raise ValueError("n is 2, 3 or 4")
    return t.where(F.col(f"p{n - 1}{n - 1}").isNotNull()).select(*key, "y", "x", v.alias("v"))


def downscale_rows(img: DataFrame, key: list[str]) -> DataFrame:
    """Halve the width by rounded averages, and keep every other row."""
    t = taps(img, key, 2)
    return t.where("p01 is not null").select(*key, "y", "x", half_up(F.col("p00"), F.col("p01")).alias("v"))


def block_mean(img: DataFrame, key: list[str], n: int) -> DataFrame:
    """The mean of each n x n block, rounded down."""
    return img.groupBy(*key, F.floor(F.col("y") / n).alias("by"), F.floor(F.col("x") / n).alias("bx")).agg(F.floor(F.sum("v") / (n * n)).alias("v")).select(*key, F.col("by").alias("y"), F.col("bx").alias("x"), "v")


def _grid(img: DataFrame, h: int, w: int) -> DataFrame:
    """Destination places (i, j); a table of h * w rows for all images."""
    spark = img.sparkSession
    return spark.range(h).select(F.col("id").alias("i")).crossJoin(spark.range(w).select(F.col("id").alias("j")))


def scale_nearest(img: DataFrame, key: list[str], h0: int, w0: int, h: int, w: int) -> DataFrame:
    """Nearest-neighbour scaling: source row i * h0 / h, rounded down."""
    g = _grid(img, h, w).select("i", "j", F.floor(F.col("i") * h0 / h).alias("y"), F.floor(F.col("j") * w0 / w).alias("x"))
    return img.join(g, ["y", "x"]).select(*key, F.col("i").alias("y"), F.col("j").alias("x"), "v")


def _bilinear(i: Column, n0: int, n: int) -> tuple[Column, Column, Column]:
    """Both source places and the second one's weight in 1024ths, with half-pixel centres."""
    s = F.greatest((i + 0.5) * (float(n0) / n) - 0.5, F.lit(0.0))
    low = F.floor(s)
    return F.least(low, F.lit(n0 - 1)), F.least(low + 1, F.lit(n0 - 1)), F.round((s - low) * 1024).cast("bigint")


def scale_bilinear(img: DataFrame, key: list[str], h0: int, w0: int, h: int, w: int) -> DataFrame:
    """Bilinear scaling with 10-bit weights, rounded down."""
    y0, y1, dy = _bilinear(F.col("i"), h0, h)
    x0, x1, dx = _bilinear(F.col("j"), w0, w)
    four = F.array(*(F.struct(y.alias("y"), x.alias("x"), (wy * wx).alias("k")) for y, wy in ((y0, 1024 - dy), (y1, dy)) for x, wx in ((x0, 1024 - dx), (x1, dx))))
    g = _grid(img, h, w).select("i", "j", F.explode(four).alias("t")).select("i", "j", "t.y", "t.x", "t.k")
    made = img.join(g, ["y", "x"]).groupBy(*key, "i", "j").agg(F.sum(F.col("v") * F.col("k")).alias("s"))
    return made.select(*key, F.col("i").alias("y"), F.col("j").alias("x"), F.shiftright("s", 20).alias("v"))


def scale_bilinear_float(img: DataFrame, key: list[str], h0: int, w0: int, h: int, w: int) -> DataFrame:
    """Bilinear scaling with weights that aren't rounded; v is not whole."""

    def side(i: Column, n0: int, n: int):
        s = F.greatest((i + 0.5) * (float(n0) / n) - 0.5, F.lit(0.0))
        low = F.floor(s)
        return (F.least(low, F.lit(n0 - 1)), 1 - (s - low)), (F.least(low + 1, F.lit(n0 - 1)), s - low)

    four = F.array(*(F.struct(y.alias("y"), x.alias("x"), (wy * wx).alias("k")) for y, wy in side(F.col("i"), h0, h) for x, wx in side(F.col("j"), w0, w)))
    g = _grid(img, h, w).select("i", "j", F.explode(four).alias("t")).select("i", "j", "t.y", "t.x", "t.k")
    made = img.join(g, ["y", "x"]).groupBy(*key, "i", "j").agg(F.sum(F.col("v") * F.col("k")).alias("v"))
    return made.select(*key, F.col("i").alias("y"), F.col("j").alias("x"), "v")


def halve_planes(uv: DataFrame, key: list[str], planes: tuple[str, ...] = ("u", "v")) -> DataFrame:
    """Interleaved colour planes at half their size, by rounded averages of 2 x 2."""
    each = F.explode(F.array(*(F.struct(F.lit(p).alias("plane"), F.col(p).alias("value")) for p in planes))).alias("p")
    long = uv.select(*key, "y", "x", each).select(*key, "y", "x", "p.plane", F.col("p.value").alias("v"))
    half = downscale_average(long, [*key, "plane"], 2)
    return half.groupBy(*key, "y", "x").agg(*(F.max(F.when(F.col("plane") == p, F.col("v"))).alias(p) for p in planes))


def rotate_crop(img: DataFrame, key: list[str], h0: int, w0: int, alpha: float, left: int, top: int, h: int, w: int, bilinear: bool = False) -> DataFrame:
    """An h x w picture from (left, top) on of the image turned by alpha about its centre into its enlarged frame; nearest or bilinear, clamped to the edge."""
    from math import cos, sin

    sn, cs = sin(-alpha), cos(-alpha)
    rw, rh = abs(w0 / 2 * cs) + abs(h0 / 2 * sn), abs(h0 / 2 * cs) + abs(w0 / 2 * sn)
    di, dj = F.col("i") + (top - rh), F.col("j") + (left - rw)
    y, x = h0 / 2 + (sn * dj + cs * di), w0 / 2 + (cs * dj - sn * di)
    whole = lambda v: v.cast("bigint")  # noqa: E731  toward zero
    clamp = lambda v, n: F.greatest(F.lit(0).cast("bigint"), F.least(F.lit(n - 1).cast("bigint"), v))
    g = _grid(img, h, w).select("i", "j", y.alias("ty"), x.alias("tx"))
    if not bilinear:
        g = g.select("i", "j", clamp(whole(F.col("ty") + 0.5), h0).alias("y"), clamp(whole(F.col("tx") + 0.5), w0).alias("x"))
        return img.join(g, ["y", "x"]).select(*key, F.col("i").alias("y"), F.col("j").alias("x"), "v")
    y0, x0 = whole(F.col("ty")), whole(F.col("tx"))
    dy, dx = F.col("ty") - y0, F.col("tx") - x0
    four = F.array(*(F.struct(clamp(y0 + a, h0).alias("y"), clamp(x0 + b, w0).alias("x"), ((dy if a else 1 - dy) * (dx if b else 1 - dx)).alias("k")) for a in (0, 1) for b in (0, 1)))
    g = g.select("i", "j", F.explode(four).alias("t")).select("i", "j", "t.y", "t.x", "t.k")
    made = img.join(g, ["y", "x"]).groupBy(*key, "i", "j").agg(F.sum(F.col("v") * F.col("k")).alias("s"))
    return made.select(*key, F.col("i").alias("y"), F.col("j").alias("x"), F.round("s", 6).cast("bigint").alias("v"))


def scale_hq(img: DataFrame, key: list[str], h0: int, w0: int, h: int, w: int) -> DataFrame:
    """Block means where the least ratio is 2 or more, bilinear scaling below that."""
    ratio = min(h0 / h, w0 / w)
    n = int(ratio)
    if n < 2:
        return scale_bilinear(img, key, h0, w0, h, w)
    g = _grid(img, h, w).select("i", "j", F.explode(F.sequence(F.lit(0), F.lit(n * n - 1))).alias("t"))
    g = g.select("i", "j", (F.floor(F.col("i") * ratio) + F.floor(F.col("t") / n)).alias("y"), (F.floor(F.col("j") * ratio) + F.col("t") % n).alias("x"))
    return img.join(g, ["y", "x"]).groupBy(*key, "i", "j").agg(F.floor(F.sum("v") / (n * n)).alias("v")).select(*key, F.col("i").alias("y"), F.col("j").alias("x"), "v")


def box_blur(img: DataFrame, key: list[str], h: int, w: int, r: int) -> DataFrame:
    """Box blur of radius r along rows, then along columns, rounded down after each; needs h, w >= r + 1.

    Beyond the left or upper edge the image is mirrored without repeating its
    edge pixel, beyond the right or lower edge with it.
    """
    return frames.mapped(frames.gathered(img, key), key, lambda a: frames.box_blur(a, r), "v")


def bilateral(img: DataFrame, key: list[str], h: int, w: int, sd: float, sr: float) -> DataFrame:
    """Bilateral filter of a grey image: a flat window of radius sqrt(3) sd, range weights falling linearly to 0 at sqrt(6) * 255 * sr."""
    return frames.mapped(frames.gathered(img, key), key, lambda a: frames.bilateral(a, sd, sr), "v")


def lbp_radii(img: DataFrame, key: list[str], n: int, mask: int = 0xF8) -> DataFrame:
    """Local binary patterns of radii 1 to n: (key, y, x, code), with n rows for each inner row of the image."""
    return frames.mapped(frames.gathered(img, key), key, lambda a: frames.patterns(a, n, mask), "code")


def warp(img: DataFrame, key: str, motions: DataFrame, nearest: bool = False) -> DataFrame:
    """Images moved by motions (key, shift_x, shift_y, scale, alpha), bilinear or by nearest pixels; images without one go."""
    parts = ("shift_x", "shift_y", "scale", "alpha")
    rows = frames.gathered(img, [key]).join(motions.select(key, *(F.col(c).cast("double").alias(c) for c in parts)), key)
    return frames.mapped(rows, [key], lambda a, *m: frames.warped(a, *m, nearest=nearest), "v", more=parts)


LBP_ORDER = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]


def lbp(img: DataFrame, key: list[str], mask: int = 0xF8) -> DataFrame:
    """Local binary patterns of radius 1 of the inner pixels: a bit for each neighbour that is brighter, after masking."""
    m = F.col("v").bitwiseAND(F.lit(mask))
    rows = Window.partitionBy(*key, "y").orderBy("x")
    cols = Window.partitionBy(*key, "x").orderBy("y")
    side = img.withColumns({"m": m, "l": F.lag(m).over(rows), "r": F.lead(m).over(rows)})
    both = side.withColumns({f"{d}{c}": f(c).over(cols) for d, f in (("u", F.lag), ("d", F.lead)) for c in ("l", "m", "r")})
    order = ["ul", "um", "ur", "l", "r", "dl", "dm", "dr"]
    code = reduce(lambda a, b: a + b, (F.when(F.col(c) > F.col("m"), 1 << (7 - i)).otherwise(0) for i, c in enumerate(order)))
    return both.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in order))).select(*key, "y", "x", code.cast("bigint").alias("code"))


def draw_rect(img: DataFrame, y: int, x: int, h: int, w: int, value: int, alpha: float = 1.0) -> DataFrame:
    """The outline of a rectangle, blended over the image; parts outside are cut off."""
    on = F.col("y").between(y, y + h - 1) & F.col("x").between(x, x + w - 1) & (F.col("y").isin(y, y + h - 1) | F.col("x").isin(x, x + w - 1))
    return img.withColumn("v", F.when(on, F.floor(F.col("v") * (1 - alpha) + value * alpha)).otherwise(F.col("v")))


def rotate_crop_nearest(img: DataFrame, key: list[str], h0: int, w0: int, cy: float, cx: float, angle: float, h: int, w: int) -> DataFrame:
    """An h x w picture around (cy, cx), turned by angle, of nearest pixels clamped to the edge."""
    from math import cos, sin

    c, s = cos(angle), sin(angle)
    dy, dx = F.col("i") - (h - 1) / 2.0, F.col("j") - (w - 1) / 2.0
    clamp = lambda v, n: F.greatest(F.lit(0).cast("bigint"), F.least(F.lit(n - 1).cast("bigint"), F.floor(v + 0.5)))
    g = _grid(img, h, w).select("i", "j", clamp(cy + dx * s + dy * c, h0).alias("y"), clamp(cx + dx * c - dy * s, w0).alias("x"))
    return img.join(g, ["y", "x"]).select(*key, F.col("i").alias("y"), F.col("j").alias("x"), "v")


def draw_line(img: DataFrame, y0: int, x0: int, y1: int, x1: int, value: int, alpha: float = 1.0) -> DataFrame:
    """A straight line, one pixel for each step of its longer side, blended over the image; parts outside are cut off."""
    n = max(abs(y1 - y0), abs(x1 - x0))
    step = img.sparkSession.range(n + 1)
    at = step.select(*(F.floor(a + F.col("id") * (b - a) / max(n, 1) + 0.5).alias(c) for c, a, b in (("y", y0, y1), ("x", x0, x1)))).distinct().withColumn("on", F.lit(True))
    return img.join(F.broadcast(at), ["y", "x"], "left").select(*(F.col(c) if c != "v" else F.when(F.col("on"), F.floor(F.col("v") * (1 - alpha) + value * alpha)).otherwise(F.col("v")).alias("v") for c in img.columns))


def draw_cross(img: DataFrame, y: int, x: int, reach: int, value: int) -> DataFrame:
    """A cross of two lines through a point."""
    return draw_line(draw_line(img, y - reach, x, y + reach, x, value), y, x - reach, y, x + reach, value)
