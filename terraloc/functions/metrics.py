"""Distances of arrays of doubles as columns; all of it stays in the JVM."""

from __future__ import annotations

from collections.abc import Callable
from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def l1(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def l2(a: Column, b: Column) -> Column:
    """Squared."""
    return _sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def so2(a: Column, b: Column) -> Column:
    """The signed turn from a's last number to b's, both in [-pi, pi], brought into that range."""
    turn = F.element_at(b, -1) - F.element_at(a, -1)
    return F.when(turn > pi, turn - 2 * pi).when(turn < -pi, turn + 2 * pi).otherwise(turn)


#: By name. Quaternions (so3) are compared like any other four numbers.
METRICS: dict[str, Callable[[Column, Column], Column]] = {"l1": l1, "l2": l2, "l2_simple": l2, "so2": so2, "so3": l2}


def _mean_cosine(a: list[Column], b: list[Column]) -> Column:
    """1 - the mean cosine of the pairs; null if any of them is all zeros."""
    cosines = [dot(x, y) / F.nullif(F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)), F.lit(0.0)) for x, y in zip(a, b, strict=True)]
    return 1 - sum(cosines[1:], cosines[0]) / len(cosines)


def cosine_by_rows(a: Column, b: Column, rows: int, columns: int) -> Column:
    """Distance of two images, which are arrays row by row: 1 - the mean cosine of their rows; null if a row is all zeros."""
    cut = lambda v: [F.slice(v, i * columns + 1, columns) for i in range(rows)]
    return _mean_cosine(cut(a), cut(b))


def cosine_by_columns(a: Column, b: Column, rows: int, columns: int) -> Column:
    """As cosine_by_rows, of columns."""
    cut = lambda v: [F.array(*(F.get(v, i * columns + j) for i in range(rows))) for j in range(columns)]
    return _mean_cosine(cut(a), cut(b))
