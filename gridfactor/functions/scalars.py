"""Scalar expressions.  A complex number is a pair of columns (re, im)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Pair = tuple[Column, Column]


def pair(re: str | Column, im: str | Column) -> Pair:
    return (F.col(re) if isinstance(re, str) else re, F.col(im) if isinstance(im, str) else im)


def conj(z: Pair) -> Pair:
    return z[0], -z[1]


def times(a: Pair, b: Pair) -> Pair:
    return a[0] * b[0] - a[1] * b[1], a[0] * b[1] + a[1] * b[0]


def modulus(z: Pair) -> Column:
    return F.hypot(*z)


def square_modulus(z: Pair) -> Column:
    return z[0] * z[0] + z[1] * z[1]


def phase(angle: Column, norm: float = 1.0) -> Pair:
    """exp(i * angle) / norm."""
    return F.cos(angle) / norm, F.sin(angle) / norm


def reciprocal(x: Column) -> Column:
    """1 / x; null for 0."""
    return F.try_divide(F.lit(1.0), x)


def kept_reciprocal(s: Column, largest: Column, rcond: float) -> Column:
    """1 / s where |s| > rcond * largest, else 0: how a pseudo-inverse treats singular values."""
    return F.when(F.abs(s) > rcond * largest, reciprocal(s)).otherwise(F.lit(0.0))


def multi_index(flat: Column, shape: tuple[int, ...]) -> list[Column]:
    """The row-major coordinates of a flat index."""
    out, step = [], math.prod(shape)
    for n in shape:
        step //= n
        out.append(F.pmod(F.floor(flat / step), F.lit(n)).cast("int"))
    return out


def flat_index(coordinates: list[Column], shape: tuple[int, ...]) -> Column:
    out = F.lit(0).cast("bigint")
    for c, n in zip(coordinates, shape):
        out = out * n + c
    return out


def rounded(x: Column, places: int = 6) -> Column:
    """Rounded, and with 0 in place of -0."""
    return F.round(x, places) + F.lit(0.0)
