"""Scalar geometry as columns; all of it stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def azimuth(x: Column, y: Column) -> Column:
    """Degrees in [0, 360); 0 for the origin."""
    a = F.degrees(F.atan2(y, x))
    return F.when(a < 0, a + 360.0).otherwise(a)


def planar_range(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def ceil_bin(v: Column, most: float, n: int) -> Column:
    """0..n-1; a value on an edge belongs to the bin below it."""
    return F.greatest(F.least(F.ceil(v / most * n), F.lit(n)), F.lit(1)).cast("int") - 1


def floor_bin(v: Column, n: int) -> Column:
    return F.greatest(F.least(F.floor(v), F.lit(n - 1)), F.lit(0)).cast("int")


def rotation(roll: Column, pitch: Column, yaw: Column) -> list[list[Column]]:
    """Rz(yaw) Ry(pitch) Rx(roll)."""
    cr, sr, cp, sp, cy, sy = F.cos(roll), F.sin(roll), F.cos(pitch), F.sin(pitch), F.cos(yaw), F.sin(yaw)
    return [
        [cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr],
        [sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr],
        [-sp, cp * sr, cp * cr],
    ]


def angles(m: list[list[Column]]) -> tuple[Column, Column, Column]:
    """Roll, pitch and yaw of a rotation away from gimbal lock."""
    return F.atan2(m[2][1], m[2][2]), F.atan2(-m[2][0], F.sqrt(m[0][0] * m[0][0] + m[1][0] * m[1][0])), F.atan2(m[1][0], m[0][0])


def quaternion(roll: Column, pitch: Column, yaw: Column) -> tuple[Column, Column, Column, Column]:
    """x, y, z, w."""
    cr, sr, cp, sp, cy, sy = (f(v / 2) for v in (roll, pitch, yaw) for f in (F.cos, F.sin))
    return sr * cp * cy - cr * sp * sy, cr * sp * cy + sr * cp * sy, cr * cp * sy - sr * sp * cy, cr * cp * cy + sr * sp * sy


#: WGS84 semi-axes in metres.
MAJOR, MINOR = 6378137.0, 6356752.3142


def to_ecef(lat: Column, lon: Column, alt: Column) -> tuple[Column, Column, Column]:
    e2 = 1 - (MINOR * MINOR) / (MAJOR * MAJOR)
    la, lo = F.radians(lat), F.radians(lon)
    n = MAJOR / F.sqrt(1 - e2 * F.sin(la) * F.sin(la))
    return (n + alt) * F.cos(la) * F.cos(lo), (n + alt) * F.cos(la) * F.sin(lo), (n * (1 - e2) + alt) * F.sin(la)


def to_tangent(origin: tuple, point: tuple, lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """East, north and up of origin - point, by the point's own axes."""
    d = [o - p for o, p in zip(origin, point, strict=True)]
    la, lo = F.radians(lat), F.radians(lon)
    east = -F.sin(lo) * d[0] + F.cos(lo) * d[1]
    north = -F.sin(la) * F.cos(lo) * d[0] - F.sin(la) * F.sin(lo) * d[1] + F.cos(la) * d[2]
    up = F.cos(la) * F.cos(lo) * d[0] + F.cos(la) * F.sin(lo) * d[1] + F.sin(la) * d[2]
    return east, north, up
