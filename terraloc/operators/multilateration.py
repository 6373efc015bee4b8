"""Positions from ranges: predicates over spheres and closed-form trilateration as columns, least squares in numpy.

Spheres are structs of x, y, z, radius. `solve` takes one row per query with its spheres in an array, so a partition's
memory holds one Arrow batch; all rows of a batch iterate together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(sum((a[c] - b[c]) * (a[c] - b[c]) for c in AXES))


def overlap(a: Column, b: Column) -> Column:
    """The surfaces of two spheres cross."""
    d = distance(a, b)
    return (F.abs(a["radius"] - b["radius"]) < d) & (d < a["radius"] + b["radius"])


def on_surface(p: Column, s: Column, within: float = 1e-6) -> Column:
    return F.abs(distance(p, s) - s["radius"]) < within


def _dot(a, b):
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _cross(a, b):
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def trilaterate(spheres: DataFrame, a: str = "a", b: str = "b", c: str = "c") -> DataFrame:
    """Adds p1 and p2, where the surfaces of three spheres meet; null where they don't, or for centres on a line.

    In the frame of a's centre with its first axis towards b and its second in the plane of c; p1 lies on the side of
    (b - a) x (c - a). Each step is a column of its own, so that later ones don't repeat it.
    """
    def at(name, i):
        return F.col(name)[AXES[i]]

    def vec(name):
        return [F.col(f"{name}_{i}") for i in range(3)]

    def add(df, name, parts):
        return df.select("*", *(p.alias(f"{name}_{i}") for i, p in enumerate(parts)))

    own = spheres.columns
    r1, r2, r3 = (F.col(s)["radius"] for s in (a, b, c))
    df = add(spheres, "_u", [at(b, i) - at(a, i) for i in range(3)])
    df = add(df, "_v", [at(c, i) - at(a, i) for i in range(3)])
    df = df.withColumn("_d", F.sqrt(_dot(vec("_u"), vec("_u"))))
    df = add(df, "_ex", [F.try_divide(x, F.col("_d")) for x in vec("_u")])
    df = df.withColumn("_i", _dot(vec("_ex"), vec("_v")))
    df = add(df, "_w", [x - F.col("_i") * e for x, e in zip(vec("_v"), vec("_ex"), strict=True)])
    df = df.withColumn("_j", F.sqrt(_dot(vec("_w"), vec("_w"))))
    df = add(df, "_ey", [F.try_divide(x, F.col("_j")) for x in vec("_w")])
    df = add(df, "_ez", _cross(vec("_ex"), vec("_ey")))
    df = df.withColumn("_x", F.try_divide(r1 * r1 - r2 * r2 + F.col("_d") * F.col("_d"), 2 * F.col("_d")))
    df = df.withColumn("_y", F.try_divide(r1 * r1 - r3 * r3 + F.col("_i") * F.col("_i") + F.col("_j") * F.col("_j") - 2 * F.col("_i") * F.col("_x"), 2 * F.col("_j")))
    df = df.withColumn("_h", r1 * r1 - F.col("_x") * F.col("_x") - F.col("_y") * F.col("_y"))
    df = df.withColumn("_z", F.when((F.col("_h") >= 0) & (F.col("_j") > 1e-9), F.sqrt("_h")))
    points = []
    for sign, name in ((1, "p1"), (-1, "p2")):
        parts = [at(a, i) + F.col("_x") * F.col(f"_ex_{i}") + F.col("_y") * F.col(f"_ey_{i}") + sign * F.col("_z") * F.col(f"_ez_{i}") for i in range(3)]
        points.append(F.when(F.col("_z").isNotNull(), F.struct(*(p.alias(n) for p, n in zip(parts, AXES, strict=True)))).alias(name))
    return df.select(*own, *points)


def _descend(p: np.ndarray, centres: np.ndarray, radii: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Step and loss of the summed squares of range errors; p (..., 3), centres (..., n, 3)."""
    out = p[..., None, :] - centres
    d = np.sqrt((out * out).sum(-1))
    err = np.where(used, d - radii, 0.0)
    with np.errstate(invalid="ignore", divide="ignore"):
        pull = np.where(used, err / d, 0.0)
    return -(pull[..., None] * out).sum(-2), (err * err).sum(-1)


def meet(centres: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two points and whether they hold, for triples (..., 3, 3) and (..., 3). Surfaces that don't meet give the nearest point twice."""
    a, b, c = (centres[..., i, :] for i in range(3))
    r1, r2, r3 = (radii[..., i] for i in range(3))
    with np.errstate(invalid="ignore", divide="ignore"):
        d = np.linalg.norm(b - a, axis=-1)
        ex = (b - a) / d[..., None]
        i = (ex * (c - a)).sum(-1)
        w = c - a - i[..., None] * ex
        j = np.linalg.norm(w, axis=-1)
        ey = w / j[..., None]
        x = (r1 * r1 - r2 * r2 + d * d) / (2 * d)
        y = (r1 * r1 - r3 * r3 + i * i + j * j - 2 * i * x) / (2 * j)
        h = r1 * r1 - x * x - y * y
        foot, up = a + x[..., None] * ex + y[..., None] * ey, np.sqrt(np.maximum(h, 0))[..., None] * np.cross(ex, ey)
    ok = (d > 1e-9) & (j > 1e-9)
    p1, p2 = foot + up, foot - up
    apart = ok & (h < 0)
    if apart.any():
        cs, rs = centres[apart], radii[apart]
        p, live = cs.mean(-2), np.ones(len(cs), bool)
        for _ in range(100):
            step, _ = _descend(p, cs, rs, np.ones(rs.shape, bool))
            live &= ~(np.abs(step) < 1e-5).all(-1)
            p = np.where(live[:, None], p + 0.3 * step, p)
        p1[apart] = p2[apart] = p
        ok[apart] = ~np.isnan(p).any(-1)
    return p1, p2, ok


def _guess(centres: np.ndarray, radii: np.ndarray) -> np.ndarray | None:
    """Middle of the closest points of a triple from the front and one from the back; None without such triples."""
    n = len(radii)
    take = np.arange(n - 2)[:, None] + np.arange(3)
    f1, f2, ok = meet(centres[take], radii[take])
    # More than five spheres: the first triple that holds, but not the very first; else that one.
    front = next((i for i in range(1, n - 4) if ok[i]), None) if n > 5 else (0 if ok[0] else None)
    if front is None:
        return None
    edge = front if n > 5 else 1
    # From the back, triples whose first sphere lies behind the front's; the last triple only if there are no others.
    starts = range(n - 2, edge, -1)
    back = next((s for s in starts if ok[s - 2]), None) if len(starts) else (n - 1 if ok[n - 3] else None)
    if back is None:
        return None
    one, two = (f1[front], f2[front]), (f1[back - 2], f2[back - 2])
    pairs = [(np.linalg.norm(p - q), k, (p + q) / 2) for k, (p, q) in enumerate((p, q) for p in one for q in two)]
    return min(pairs, key=lambda t: t[:2])[2]


def positions(centres: list[np.ndarray], radii: list[np.ndarray], rounds: int = 30, tolerance: float = 5e-4) -> tuple[np.ndarray, np.ndarray]:
    """Position and success of each row's spheres; rows of under four, or without a first guess, are at 0 and fail."""
    n, most = len(radii), max((len(r) for r in radii), default=0)
    c, r, used = np.zeros((n, most, 3)), np.zeros((n, most)), np.zeros((n, most), bool)
    p, ok = np.zeros((n, 3)), np.zeros(n, bool)
    for i, (cs, rs) in enumerate(zip(centres, radii, strict=True)):
        start = _guess(cs, rs) if len(rs) > 3 else None
        if start is not None:
            c[i, : len(rs)], r[i, : len(rs)], used[i, : len(rs)], p[i], ok[i] = cs, rs, True, start, True
    first, live, last = p.copy(), ok.copy(), np.full(n, 1e5)
    rate = 0.9 / np.maximum(used.sum(1), 1)
    for k in range(rounds):
        step, loss = _descend(p, c, r, used)
        if k > 5:
            live &= ~(np.abs(loss - last) < tolerance)
        p = np.where(live[:, None], p + rate[:, None] * step, p)
        last = np.where(live, loss, last)
    return np.where(np.isnan(p).any(1)[:, None], first, p), ok


def solve(observed: DataFrame, key: str = "q", spheres: str = "spheres") -> DataFrame:
    """key, x, y, z, ok from rows of key and an array of spheres in order. Null arrays and spheres that lack a number count as missing."""

    def run(batches):
        for b in batches:
            rows = [[s for s in row or [] if s is not None and None not in s.values()] for row in b.column(1).to_pylist()]
            p, ok = positions([np.array([[s[c] for c in AXES] for s in row], float).reshape(-1, 3) for row in rows], [np.array([s["radius"] for s in row], float) for row in rows])
            yield pa.record_batch([b.column(0), *(pa.array(p[:, i]) for i in range(3)), pa.array(ok)], names=[key, *AXES, "ok"])

    kind = dict(observed.dtypes)[key]
    fields = F.transform(spheres, lambda s: F.struct(*(s[c].cast("double").alias(c) for c in (*AXES, "radius"))))
    return observed.select(key, fields.alias(spheres)).mapInArrow(run, f"{key} {kind}, x double, y double, z double, ok boolean")
