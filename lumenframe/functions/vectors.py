"""Arithmetic and lane moves on whole arrays, without leaving the row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def zipped(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    """f of the elements of two arrays of equal length; an error otherwise."""
    fits = F.size(a) == F.size(b)
    return F.when(fits, F.zip_with(a, b, f)).otherwise(F.raise_error(F.lit("arrays of different lengths")))


def add(a: Column, b: Column) -> Column:
    return zipped(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return zipped(a, b, lambda x, y: x - y)


def scale(a: Column, k: Column | float) -> Column:
    return F.transform(a, lambda x: x * k)


def divide(a: Column, k: Column | float) -> Column:
    return F.transform(a, lambda x: x / k)


def dot(a: Column, b: Column) -> Column:
    """Sum of products; 0.0 for empty arrays."""
    return F.aggregate(zipped(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def prefix_products(a: Column) -> Column:
    """The product of each element and all before it."""
    step = lambda s, x: F.concat(s, F.array(F.coalesce(F.get(s, F.size(s) - 1), F.lit(1.0)) * x))
    return F.aggregate(a, F.array().cast("array<double>"), step)


def suffix_products(a: Column) -> Column:
    """The product of each element and all after it."""
    return F.reverse(prefix_products(F.reverse(a)))


def low_half(a: Column) -> Column:
    return F.slice(a, 1, (F.size(a) / 2).cast("int"))


def high_half(a: Column) -> Column:
    return F.slice(a, (F.size(a) / 2).cast("int") + 1, F.size(a) - (F.size(a) / 2).cast("int"))


def interleave(*arrays: Column) -> Column:
    """a0, b0, c0, ..., a1, b1, c1, ... of some arrays of equal length."""
    names = [f"a{i}" for i in range(len(arrays))]
    return F.flatten(F.transform(F.arrays_zip(*(v.alias(n) for v, n in zip(arrays, names))), lambda s: F.array(*(s[n] for n in names))))
