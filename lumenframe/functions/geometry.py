"""Plane geometry on coordinate columns. A point is a pair of columns (x, y)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = tuple[Column, Column]


def dot(p: Point, q: Point) -> Column:
    return p[0] * q[0] + p[1] * q[1]


def cross(p: Point, q: Point) -> Column:
    return p[0] * q[1] - p[1] * q[0]


def minus(p: Point, q: Point) -> Point:
    return p[0] - q[0], p[1] - q[1]


def length(p: Point) -> Column:
    return F.sqrt(dot(p, p))


def polar_angle(p: Point) -> Column:
    return F.atan2(p[1], p[0])


def rotate(p: Point, angle: Column) -> Point:
    return p[0] * F.cos(angle) - p[1] * F.sin(angle), p[0] * F.sin(angle) + p[1] * F.cos(angle)


def rotate_around(p: Point, c: Point, angle: Column) -> Point:
    q = rotate(minus(p, c), angle)
    return q[0] + c[0], q[1] + c[1]


def inside_triangle(p: Point, a: Point, b: Point, c: Point) -> Column:
    """Whether p is in the triangle or on its sides."""
    s = [cross(minus(b, a), minus(p, a)), cross(minus(c, b), minus(p, b)), cross(minus(a, c), minus(p, c))]
    return ((s[0] >= 0) & (s[1] >= 0) & (s[2] >= 0)) | ((s[0] <= 0) & (s[1] <= 0) & (s[2] <= 0))


class Affine:
    """x' = m00 x + m01 y + tx, y' = m10 x + m11 y + ty, of columns or numbers."""

    def __init__(self, m00, m01, m10, m11, tx, ty):
        self.m = (m00, m01, m10, m11, tx, ty)

    def apply(self, p: Point) -> Point:
        a, b, c, d, tx, ty = self.m
        return a * p[0] + b * p[1] + tx, c * p[0] + d * p[1] + ty

    def then(self, other: Affine) -> Affine:
        a, b, c, d, tx, ty = self.m
        e, f, g, h, ux, uy = other.m
        return Affine(e * a + f * c, e * b + f * d, g * a + h * c, g * b + h * d, e * tx + f * ty + ux, g * tx + h * ty + uy)

    def inverse(self) -> Affine:
        a, b, c, d, tx, ty = self.m
        k = a * d - b * c
        return Affine(d / k, -b / k, -c / k, a / k, (b * ty - d * tx) / k, (c * tx - a * ty) / k)


def circle_intersect(p0: Point, r0: Column, p1: Point, r1: Column) -> tuple[Point, Point]:
    """Both common points of two circles; null where they are apart, one in the other, or concentric."""
    v = minus(p1, p0)
    d = length(v)
    a = F.try_divide(r0 * r0 - r1 * r1 + d * d, 2 * d)
    h2 = r0 * r0 - a * a
    meet = (d <= r0 + r1) & (d >= F.abs(r0 - r1)) & (d > 0)
    h = F.sqrt(F.greatest(h2, F.lit(0.0)))
    mx, my = p0[0] + F.try_divide(a, d) * v[0], p0[1] + F.try_divide(a, d) * v[1]
    ox, oy = F.try_divide(h, d) * v[1], F.try_divide(h, d) * v[0]
    ok = lambda c: F.when(meet, c)
    return (ok(mx + ox), ok(my - oy)), (ok(mx - ox), ok(my + oy))
