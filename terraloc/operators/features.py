"""Edge and surface points of scans, whose greedy choice depends on order: one packed frame at a time in numpy.

A frame is one scan of bounded size, so packing it into a row is safe; frames spread over tasks by their key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

H_SCAN, SECTIONS, CORNERS, REACH = 1800, 6, 20, 5


def pack(points: DataFrame, *columns: str) -> DataFrame:
    """frame_id, p: each frame's points as structs in order of pt."""
    return points.groupBy("frame_id").agg(F.sort_array(F.collect_list(F.struct("pt", *columns))).alias("p"))


def scan_column(x: np.ndarray, y: np.ndarray, columns: int = H_SCAN) -> np.ndarray:
    """Column of a point's azimuth, counted clockwise from behind; what falls outside is column 0."""
    turns = (np.degrees(np.arctan2(x, y)) - 90.0) / (360.0 / columns)
    col = (-np.trunc(turns + np.copysign(0.5, turns))).astype(np.int64) + columns // 2
    col = np.where(col >= columns, col - columns, col)
    return np.where((col < 0) | (col >= columns), 0, col)


def kitti_rings(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ring of each point: a ring ends at the first positive azimuth after a negative one in it.

    That is where the latest azimuth other than 0 was negative and this one is positive.
    """
    sign = np.sign(np.arctan2(y, x))
    at = np.maximum.accumulate(np.where(sign != 0, np.arange(len(sign)), -1))
    before = np.where(at >= 0, sign[np.maximum(at, 0)], 0)
    turned = (sign > 0) & (np.concatenate([[0], before[:-1]])[: len(sign)] < 0)
    return np.cumsum(turned)


def scan_features(xyz: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Per point: 2 corner, 1 surface, 0 neither (too near, or in no section of its ring).

    Points go by ring, then in order. Curvature sums ranges over five neighbours on both sides, across rings; the first
    and last five points have none. Points beside jumps of depth and on surfaces along the beam aren't chosen. In each
    sixth of a ring, up to 20 points of the highest curvature over 1 become corners; each hides its neighbours until the
    columns part by over 10. Every other point of a section is a surface point.
    """
    out = np.zeros(len(xyz), np.int8)
    order = np.flatnonzero(((xyz**2).sum(1) >= 2.0) & (ring >= 0) & (ring < 64))
    order = order[np.argsort(ring[order], kind="stable")]
    n = len(order)
    if n == 0:
        return out
    p = xyz[order]
    r, col = np.sqrt((p**2).sum(1)), scan_column(p[:, 0], p[:, 1])
    curve = np.full(n, np.nan)
    if n > 2 * REACH:
        total = np.convolve(r, np.ones(2 * REACH + 1), "valid")
        curve[REACH:-REACH] = (total - (2 * REACH + 1) * r[REACH:-REACH]) ** 2
    gap = np.abs(np.diff(col))
    hidden = np.zeros(n, bool)
    close, drop = gap < 10, -np.diff(r)
    for k in range(REACH + 1):
        far_left, far_right = np.flatnonzero(close & (drop > 0.3)) - k, np.flatnonzero(close & (drop < -0.3)) + 1 + k
        hidden[far_left[far_left >= 0]] = True
        hidden[far_right[far_right < n]] = True
    hidden[1:-1] |= (np.abs(drop[:-1]) > 0.02 * r[1:-1]) & (np.abs(drop[1:]) > 0.02 * r[1:-1])

    def hide(i):
        hidden[i] = True
        for step, edge in ((1, 0), (-1, -1)):
            for k in range(1, REACH + 1):
                j = i + step * k
                if not 0 <= j < n or gap[j + (-1 if edge == 0 else 0)] > 10:
                    break
                hidden[j] = True

    bounds = np.flatnonzero(np.diff(ring[order])) + 1
    for begin, end in zip(np.concatenate([[0], bounds]), np.concatenate([bounds, [n]]), strict=True):
        cuts = begin + (end - begin) * np.arange(SECTIONS + 1) // SECTIONS
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a < 2:
                continue
            mine = np.arange(a, b)
            known = mine[~np.isnan(curve[mine])]
            ranked = known[np.argsort(curve[known], kind="stable")]
            chosen = 0
            for i in ranked[::-1]:
                if curve[i] <= 1.0 or chosen == CORNERS:
                    break
                if not hidden[i] and r[i] > 2.0:
                    chosen += 1
                    out[order[i]] = 2
                    hide(i)
            for i in ranked:
                if curve[i] >= 0.1:
                    break
                if not hidden[i] and r[i] > 2.0:
                    hide(i)
            mine = order[mine]
            out[mine[out[mine] == 0]] = 1
    return out


def thin(xyz: np.ndarray, least: float = 2.0) -> np.ndarray:
    """Which points stay: the first, and each that lies `least` or more from the last that stayed."""
    keep, last, bound = np.zeros(len(xyz), bool), None, least * least
    i = 0
    while i < len(xyz):
        keep[i] = True
        last = xyz[i]
        far = None
        for s in range(i + 1, len(xyz), 256):  # by stretches, as the next one mostly lies near
            hit = np.flatnonzero(((xyz[s : s + 256] - last) ** 2).sum(1) >= bound)
            if len(hit):
                far = s + int(hit[0])
                break
        if far is None:
            break
        i = far
    return keep


def _by_frame(packed: DataFrame, judge, schema: str) -> DataFrame:
    """judge: the points' struct array of a frame -> columns besides frame_id, each as long as the frame or its choice."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for b in batches:
            for frame, pts in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                cols = judge(pts.values)
                yield pa.record_batch([pa.array([frame] * len(cols[0]), pa.int64()), *map(pa.array, cols)], names=names)

    return packed.mapInArrow(run, schema)


def _xyz(p: pa.StructArray) -> np.ndarray:
    return np.stack([p.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x", "y", "z")], 1)


def loam_features(points: DataFrame) -> DataFrame:
    """frame_id, pt, kind (2 corner, 1 surface, 0 neither) from frame_id, pt, x, y, z, ring."""

    def judge(p):
        return p.field("pt"), scan_features(_xyz(p), p.field("ring").to_numpy(zero_copy_only=False)).astype(np.int32)

    return _by_frame(pack(points, "x", "y", "z", "ring"), judge, "frame_id long, pt long, kind int")


def thinned(points: DataFrame, least: float = 2.0) -> DataFrame:
    """frame_id, pt of the points that `thin` keeps."""
    return _by_frame(pack(points, "x", "y", "z"), lambda p: (p.field("pt").to_numpy()[thin(_xyz(p), least)],), "frame_id long, pt long")
