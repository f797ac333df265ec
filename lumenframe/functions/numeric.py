"""Numeric expressions and aggregates."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F


def relative_error(x: Column, x0: Column) -> Column:
    """Error relative to the larger of the expected size and 1."""
    return F.abs(x - x0) / F.greatest(F.abs(x0), F.lit(1.0))


def almost_equal(x: Column, x0: Column, tolerance: float) -> Column:
    return relative_error(x, x0) < tolerance


def signed_sqrt(x: Column) -> Column:
    return F.signum(x) * F.sqrt(F.abs(x))


def logistic(k: float, x0: float, x: Column) -> Column:
    return 1 / (1 + F.exp(-k * (x - x0)))


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def safe_log(x: Column) -> Column:
    return F.ln(F.greatest(x, F.lit(1e-15)))


def fits(x: Column, kind: str) -> Column:
    """Whether a whole number is in the range of a type such as 'tinyint'."""
    return F.expr("1 = 1") & x.isNotNull() if kind == "bigint" else x.between(-(1 << {"tinyint": 7, "smallint": 15, "int": 31}[kind]), (1 << {"tinyint": 7, "smallint": 15, "int": 31}[kind]) - 1)


def fixed(x: Column, shift: int, bits: int = 32) -> Column:
    """A number as binary fixed point of so many fraction bits: rounded and saturated."""
    top = (1 << (bits - 1)) - 1
    return F.greatest(F.lit(-top - 1).cast("bigint"), F.least(F.lit(top).cast("bigint"), F.round(x * (1 << shift)).cast("bigint")))


def weighted_mean(x: Column, w: Column) -> Column:
    return F.sum(x * w) / F.sum(w)


def mean_squared_error(a: Column, b: Column) -> Column:
    """0 for no rows."""
    return F.coalesce(F.avg((a - b) * (a - b)), F.lit(0.0))


def cross_entropy(y: Column, p: Column) -> Column:
    return -F.avg(y * safe_log(p) + (1 - y) * safe_log(1 - p))


def mean_angle(a: Column) -> Column:
    """Circular mean."""
    return F.atan2(F.avg(F.sin(a)), F.avg(F.cos(a)))


def angle_0_2pi(a: Column) -> Column:
    return F.pmod(a, F.lit(2 * pi))


def angle_mpi_pi(a: Column) -> Column:
    return F.pmod(a + pi, F.lit(2 * pi)) - pi


def polynomial_through(points: list[tuple[float, float]], t: Column) -> Column:
    """Lagrange interpolation through fixed points."""
    out = F.lit(0.0)
    for i, (xi, yi) in enumerate(points):
        term = F.lit(float(yi))
        for j, (xj, _) in enumerate(points):
            if i != j:
                term = term * (t - xj) / (xi - xj)
        out = out + term
    return out


def spline(knots: list[tuple[float, float]]) -> list[tuple[float, ...]]:
    """Pieces (x, value, slope, half the curvature, a sixth of its change) of a cubic spline, each from the right-hand knot of its interval; the first has a value only.

    Three knots at least. The curvature at the first knot is 0; at the last
    one it closes the elimination by the equation of the last inner knot.
    """
    if len(knots) < 3:
        raise ValueError("a spline needs three points")
    x, y = zip(*sorted(knots))
    n = len(x)
    gap = [b - a for a, b in zip(x, x[1:])]
    rise = [(b - a) / g for a, b, g in zip(y, y[1:], gap)]
    factor, rest = [0.0], [0.0]  # curvature[i] = factor[i] * curvature[i + 1] + rest[i]
    for before, after, jump in zip(gap, gap[1:], (6 * (q - p) for p, q in zip(rise, rise[1:]))):
        pivot = 2 * (before + after) + before * factor[-1]
        last = jump - before * rest[-1], pivot, before, after, jump
        factor.append(-after / pivot)
        rest.append(last[0] / pivot)
    _, _, before, after, jump = last
    curve = [0.0] * n
    curve[-1] = (jump - before * rest[-1]) / (2 * (before + after) + before * factor[-1])
    for i in range(n - 2, 0, -1):
        curve[i] = factor[i] * curve[i + 1] + rest[i]
    pieces = [(x[i], y[i], gap[i - 1] * (2 * curve[i] + curve[i - 1]) / 6 + rise[i - 1], curve[i] / 2, (curve[i] - curve[i - 1]) / gap[i - 1] / 6) for i in range(1, n)]
    return [(x[0], y[0], 0.0, 0.0, 0.0), *pieces]


def spline_at(pieces: list[tuple[float, ...]], x: Column) -> Column:
    """The spline's value; left of the first knot its value there, right of the last its last piece."""
    out = F.when(x <= pieces[0][0], F.lit(pieces[0][1]))
    for k, (x0, a, b, c, d) in enumerate(pieces[1:], 2):
        v = a + (b + (c + d * (x - x0)) * (x - x0)) * (x - x0)
        out = out.when(x <= x0, v) if k < len(pieces) else out.otherwise(v)
    return out
