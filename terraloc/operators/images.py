"""Ground labels of organised scans and spectral descriptors of bird's-eye images: one packed frame at a time in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIDE, LOW, POLAR = 101, 40, (20, 120)


def ground(x: np.ndarray, y: np.ndarray, z: np.ndarray, lowest: int = 50, steepest: float = 10.0, rise: float = 0.3) -> np.ndarray:
    """Which cells of a rows x columns scan (NaN: empty) are ground.

    A cell and the one above it are ground where the line between them rises by at most `steepest` degrees. If the one
    above is empty, its neighbours two columns right and left, then the one two rows above stand for it; without any,
    the cell isn't ground. Last, ground over `rise` above the mean of one of the four neighbouring 2 m cells (0 if a
    cell has no ground) is none.
    """
    rows = len(x)
    full = ~np.isnan(z)

    def above(k, turn=0):
        out = np.full((3, *z.shape), np.nan)
        out[:, k:] = np.roll(np.stack([x, y, z]), turn, 2)[:, :-k]
        return out

    up = above(1)
    for other in (above(1, -2), above(1, 2), above(2)):
        up = np.where(np.isnan(up[2]), other, up)
    with np.errstate(invalid="ignore"):
        angle = np.degrees(np.arctan2(up[2] - z, np.hypot(up[0] - x, up[1] - y)))
        level = np.abs(angle) <= steepest
    judged = np.zeros(rows, bool)
    judged[max(rows - lowest, 1) :] = True
    level &= judged[:, None]
    blind = ~full | (np.isnan(up[2]) & judged[:, None])
    out = level.copy()
    out[:-1] |= level[1:] & ~blind[:-1]
    gx = np.clip(np.nan_to_num((x + 75.0) // 2.0), 0, 74).astype(int)
    gy = np.clip(np.nan_to_num((y + 50.0) // 2.0), 0, 49).astype(int)
    cell = (gx * 50 + gy)[out]
    n = np.bincount(cell, minlength=75 * 50)
    mean = np.pad((np.bincount(cell, z[out], minlength=75 * 50) / np.maximum(n, 1)).reshape(75, 50), 1, constant_values=np.inf)
    lowest_near = np.min([mean[:-2, 1:-1], mean[2:, 1:-1], mean[1:-1, :-2], mean[1:-1, 2:]], axis=0)
    return out & ~(np.nan_to_num(z) - lowest_near[gx, gy] > rise)


def ground_labels(cells: DataFrame, rows: int = 64, columns: int = 360) -> DataFrame:
    """frame_id, ring, col, ground of each cell of organised scans (frame_id, ring, col, x, y, z)."""

    def run(batches):
        for b in batches:
            for frame, p in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                p = p.values
                r, c = (p.field(f).to_numpy() for f in ("ring", "col"))
                grid = np.full((3, rows, columns), np.nan)
                for i, f in enumerate(("x", "y", "z")):
                    grid[i, r, c] = p.field(f).to_numpy()
                yield pa.record_batch([pa.array(np.full(len(r), frame)), pa.array(r), pa.array(c), pa.array(ground(*grid)[r, c].astype(np.int32))], names=["frame_id", "ring", "col", "ground"])

    inside = cells.filter(F.col("ring").between(0, rows - 1) & F.col("col").between(0, columns - 1))
    packed = inside.groupBy("frame_id").agg(F.collect_list(F.struct("ring", "col", "x", "y", "z")).alias("p"))
    return packed.mapInArrow(run, "frame_id long, ring int, col int, ground int")


def spectral_image(bev: np.ndarray, low: int = LOW, polar: tuple[int, int] = POLAR) -> np.ndarray:
    """Log of the blurred middle `low` x `low` of the centred amplitude spectrum, sampled at radii x angles of a full turn."""
    amplitude = np.abs(np.fft.fftshift(np.fft.fft2(bev)))
    at = (len(bev) - low) // 2 + 1
    kernel = np.exp(-np.arange(-3, 4) ** 2 / 2.0)
    kernel /= kernel.sum()
    part = np.pad(amplitude[at : at + low, at : at + low], 3, mode="edge")
    part = np.apply_along_axis(np.convolve, 0, part, kernel, "valid")
    part = np.apply_along_axis(np.convolve, 1, part, kernel, "valid")
    half = (low - 1) / 2.0
    radius = np.linspace(0, 1, polar[0])[:, None] * half
    angle = np.arange(polar[1]) * (2 * np.pi / polar[1])
    r, c = half + radius * np.cos(angle), half + radius * np.sin(angle)
    r0, c0 = (np.clip(np.floor(v).astype(int), 0, low - 2) for v in (r, c))
    fr, fc = r - r0, c - c0
    value = part[r0, c0] * (1 - fr) * (1 - fc) + part[r0 + 1, c0] * fr * (1 - fc) + part[r0, c0 + 1] * (1 - fr) * fc + part[r0 + 1, c0 + 1] * fr * fc
    return np.log(np.maximum(value, 1e-12))


def spectral_descriptor(bev: DataFrame) -> DataFrame:
    """frame_id, v: row-major 20 x 120 array from bird's-eye cells (frame_id, bx, by, v; 101 x 101, empty ones 0)."""

    def run(batches):
        for b in batches:
            out = []
            for p in b.column(1):
                image = np.zeros((SIDE, SIDE))
                image[p.values.field("bx").to_numpy(), p.values.field("by").to_numpy()] = p.values.field("v").to_numpy()
                out.append(spectral_image(image).ravel())
            yield pa.record_batch([b.column(0), pa.array(out, pa.list_(pa.float64()))], names=["frame_id", "v"])

    packed = bev.groupBy("frame_id").agg(F.collect_list(F.struct("bx", "by", "v")).alias("p"))
    return packed.mapInArrow(run, "frame_id long, v array<double>")


def row_statistics(cells: DataFrame, rows: int, columns: int) -> DataFrame:
    """frame_id, ring, mean, spread of long cells (frame_id, ring, v; empty ones 0): row mean and row deviation over the frame's mean. The deviation's squares are divided by the rows."""
    by_row = cells.groupBy("frame_id", "ring").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("ss"))
    own = by_row.groupBy("frame_id").agg((F.sum("s") / (rows * columns)).alias("m"), F.collect_list(F.struct("ring", "s", "ss")).alias("r"))
    long = own.select("frame_id", "m", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("ring"), F.map_from_entries(F.transform("r", lambda r: F.struct(r["ring"], F.struct(r["s"].alias("s"), r["ss"].alias("ss"))))).alias("r"))
    at = F.try_element_at("r", "ring")
    long = long.select("frame_id", "m", "ring", F.coalesce(at["s"], F.lit(0.0)).alias("s"), F.coalesce(at["ss"], F.lit(0.0)).alias("ss"))
    spread = F.sqrt(F.greatest(F.col("ss") - F.col("s") * F.col("s") / columns, F.lit(0.0)) / rows)
    return long.select("frame_id", "ring", F.try_divide(F.col("s") / columns, F.col("m")).alias("mean"), F.try_divide(spread, F.col("m")).alias("spread"))
