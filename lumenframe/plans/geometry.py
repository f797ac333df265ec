"""Queries of the geometry operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe import fixtures as X
from lumenframe.functions import geometry as G
from lumenframe.functions import numeric as N
from lumenframe.registry import query

POINTS = "pts as (select c_custkey as id, c_acctbal / 100 as px, cast(c_custkey % 360 as double) as py, radians(c_custkey % 360) as a from customer)"


def points(spark, d):
    c = X.table(spark, d, "customer")
    py = (F.col("c_custkey") % 360).cast("double")
    return c.select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 100).alias("px"), py.alias("py"), F.radians(py).alias("a"))


def point():
    return F.col("px"), F.col("py")


def angle():
    return F.col("a")


@query("geo_basic", f"with {POINTS} select id, round(sqrt(px * px + py * py), 6) as len, round(atan2(py, px), 6) as angle, round(px * 3 + py * 4, 6) as dot, round(px * 4 - py * 3, 6) as cross from pts")
def geo_basic(spark, d):
    q = (F.lit(3.0), F.lit(4.0))
    return points(spark, d).select("id", F.round(G.length(point()), 6).alias("len"), F.round(G.polar_angle(point()), 6).alias("angle"), F.round(G.dot(point(), q), 6).alias("dot"), F.round(G.cross(point(), q), 6).alias("cross"))


@query("geo_rotate", f"with {POINTS} select id, round(10 + (px - 10) * cos(a) - (py - 20) * sin(a), 6) as x, round(20 + (px - 10) * sin(a) + (py - 20) * cos(a), 6) as y from pts")
def geo_rotate(spark, d):
    x, y = G.rotate_around(point(), (F.lit(10.0), F.lit(20.0)), angle())
    return points(spark, d).select("id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query("geo_affine", f"with {POINTS}, t as (select id, px, py, 2 * px + 0.5::double * py + 3 as x, -1 * px + 1.5::double * py - 7 as y from pts) select id, round(x, 6) as x, round(y, 6) as y, round(px, 6) as bx, round(py, 6) as by, round(3 * x + 1, 6) as sx from t")
def geo_affine(spark, d):
    t = G.Affine(2.0, 0.5, -1.0, 1.5, 3.0, -7.0)
    x, y = t.apply(point())
    bx, by = t.inverse().apply((x, y))
    sx, _ = t.then(G.Affine(3.0, 0.0, 0.0, 3.0, 1.0, 1.0)).apply(point())
    return points(spark, d).select("id", *(F.round(c, 6).alias(n) for n, c in (("x", x), ("y", y), ("bx", bx), ("by", by), ("sx", sx))))


_S = [f"(({bx} - {ax}) * (py - {ay}) - ({by} - {ay}) * (px - {ax}))" for (ax, ay), (bx, by) in (((0, 0), (90, 30)), ((90, 30), (20, 300)), ((20, 300), (0, 0)))]


@query("geo_triangle", f"with {POINTS} select id from pts where ({' and '.join(s + ' >= 0' for s in _S)}) or ({' and '.join(s + ' <= 0' for s in _S)})")
def geo_triangle(spark, d):
    a, b, c = ((F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (90, 30), (20, 300)))
    return points(spark, d).where(G.inside_triangle(point(), a, b, c)).select("id")


@query(
    "geo_circle",
    f"with {POINTS}, c as (select id, px, py, sqrt((px - 50) * (px - 50) + (py - 100) * (py - 100)) as d from pts), k as (select *, (6400 - 3600 + d * d) / (2 * d) as m from c where d <= 140 and d >= 20 and d > 0), h as (select *, sqrt(greatest(6400 - m * m, 0)) as h from k) select id, round(px + m / d * (50 - px) + h / d * (100 - py), 5) as x1, round(py + m / d * (100 - py) - h / d * (50 - px), 5) as y1 from h",
)
def geo_circle(spark, d):
    (x, y), _ = G.circle_intersect(point(), F.lit(80.0), (F.lit(50.0), F.lit(100.0)), F.lit(60.0))
    return points(spark, d).select("id", F.round(x, 5).alias("x1"), F.round(y, 5).alias("y1")).where("x1 is not null")


_W = "({0} - floor({0} / (2 * pi())) * 2 * pi())"


@query("geo_angle", f"with {POINTS} select id, round({_W.format('(3 * a - 5)')}, 6) as pos, round({_W.format('(3 * a - 5 + pi())')} - pi(), 6) as mid, round(degrees(a), 6) as deg from pts")
def geo_angle(spark, d):
    v = 3 * angle() - 5
    return points(spark, d).select("id", F.round(N.angle_0_2pi(v), 6).alias("pos"), F.round(N.angle_mpi_pi(v), 6).alias("mid"), F.round(F.degrees(angle()), 6).alias("deg"))


@query("geo_normalise", f"with {POINTS} select id, round(px / sqrt(px * px + (py + 1) * (py + 1)), 9) as x, round((py + 1) / sqrt(px * px + (py + 1) * (py + 1)), 9) as y from pts")
def geo_normalise(spark, d):
    q = (F.col("px"), F.col("py") + 1)
    return points(spark, d).select("id", F.round(q[0] / G.length(q), 9).alias("x"), F.round(q[1] / G.length(q), 9).alias("y"))
