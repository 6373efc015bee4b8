"""Rigid registration of point clouds: least squares over lines and planes, over point pairs, or over cell normals.

A pair's two clouds meet as two packed columns of one row, so pairs spread over tasks and no group is collected twice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloc.operators.retrieval import nearest_points

ROUNDS, TOLERANCE = 30, 5e-4
#: Clouds of up to so many points, and so many to a cell, are compared whole, which costs less than looking into cells.
FEW_POINTS, CROWDED = 2048, 2
#: After so many rounds steps of ten times TOLERANCE will do to go on with finer ones, as some go to and fro.
COARSE = 10
#: Least share of a distribution's largest variance in its first rounds.
WIDE = 0.25
#: Metres that five points may lie off their plane or line and still count as exact when a motion is made finer.
FINE = 5e-3


class Cells:
    """Points hashed into cubes as wide as `reach`, so that what lies within reach is in the 27 cubes around."""

    def __init__(self, points: np.ndarray, reach: float):
        self.reach = reach
        key = self._key(np.floor(points / reach).astype(np.int64))
        order = np.argsort(key, kind="stable")
        self.order, self.key, self.points = order, key[order], points[order]
        crowded = len(points) >= CROWDED * (1 + np.count_nonzero(np.diff(self.key)))
        self.whole = crowded and len(points) <= FEW_POINTS

    @staticmethod
    def _key(c: np.ndarray) -> np.ndarray:
        return ((c[:, 0] + (1 << 20)) << 42) + ((c[:, 1] + (1 << 20)) << 21) + c[:, 2] + (1 << 20)

    def nearest(self, q: np.ndarray, k: int, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """Indexes (-1: none) and squared distances of the k nearest points strictly within reach, nearest first."""
        idx, dist = np.full((len(q), k), -1), np.full((len(q), k), np.inf)
        if self.whole:
            self._whole(q, idx, dist)
            return idx, dist
        around = np.stack(np.meshgrid(*[[-1, 0, 1]] * 3, indexing="ij"), -1).reshape(-1, 3)
        for s in range(0, len(q), block):
            part = q[s : s + block]
            cell = self._key((np.floor(part / self.reach).astype(np.int64)[:, None] + around).reshape(-1, 3))
            lo, hi = np.searchsorted(self.key, cell), np.searchsorted(self.key, cell, "right")
            n = hi - lo
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            own = np.repeat(np.repeat(np.arange(len(part)), len(around)), n)
            d = ((part[own] - self.points[at]) ** 2).sum(1)
            near = d < self.reach**2
            at, own, d = at[near], own[near], d[near]
            order = np.lexsort((at, d, own))
            at, own, d = at[order], own[order], d[order]
            rank = np.arange(len(own)) - np.searchsorted(own, own)
            first = rank < k
            idx[s + own[first], rank[first]], dist[s + own[first], rank[first]] = at[first], d[first]
        return idx, dist

    def _whole(self, q: np.ndarray, idx: np.ndarray, dist: np.ndarray) -> None:
        """nearest of all points, by one matrix of distances for a block of queries."""
        block = max(1, (1 << 15) // max(len(self.points), 1))
        for s in range(0, len(q) if len(self.points) else 0, block):
            part = q[s : s + block]
            d = (part[:, :1] - self.points[:, 0]) ** 2
            for axis in (1, 2):
                off = part[:, axis, None] - self.points[:, axis]
                off *= off
                d += off
            rows = np.arange(len(part))
            for rank in range(min(idx.shape[1], len(self.points))):
                at = d.argmin(1)
                own = d[rows, at]
                near = own < self.reach**2
                if not near.any():
                    break
                idx[s : s + block, rank], dist[s : s + block, rank] = np.where(near, at, -1), np.where(near, own, np.inf)
                d[rows, at] = np.inf


def turn(w: np.ndarray) -> np.ndarray:
    """Rotation matrix of a rotation vector."""
    a = float(np.linalg.norm(w))
    if a < 1e-12:
        return np.eye(3)
    x, y, z = w / a
    k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    return np.eye(3) + np.sin(a) * k + (1 - np.cos(a)) * (k @ k)


def plane_terms(p: np.ndarray, groups: np.ndarray, flat: float = 0.2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted normals, weighted distances and which hold: p against the planes through its groups of points (n, 5, 3)."""
    gram = np.einsum("nij,nik->njk", groups, groups)
    ok = np.abs(np.linalg.det(gram)) > 1e-9
    normal = np.zeros_like(p)
    normal[ok] = np.linalg.solve(gram[ok], -groups[ok].sum(1)[..., None])[..., 0]
    size = np.linalg.norm(normal, axis=1)
    ok &= size > 1e-9
    unit, offset = normal / np.where(ok, size, 1)[:, None], 1 / np.where(ok, size, 1)
    ok &= (np.abs(np.einsum("nij,nj->ni", groups, unit) + offset[:, None]) <= flat).all(1)
    d = (unit * p).sum(1) + offset
    weight = 1 - 0.9 * np.abs(d) / np.sqrt(np.maximum(np.linalg.norm(p, axis=1), 1e-9))
    return unit * weight[:, None], d * weight, ok & (weight >= 0.1)


def line_terms(p: np.ndarray, groups: np.ndarray, ratio: float = 3.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As plane_terms, against lines: principal axes that exceed the second by `ratio`."""
    centre = groups.mean(1)
    off = groups - centre[:, None]
    values, vectors = np.linalg.eigh(np.einsum("nij,nik->njk", off, off) / groups.shape[1])
    axis, away = vectors[..., 2], p - centre
    away = away - (away * axis).sum(1)[:, None] * axis
    d = np.linalg.norm(away, axis=1)
    weight = 1 - 0.9 * d
    unit = away / np.maximum(d, 1e-12)[:, None]
    return unit * weight[:, None], d * weight, (values[:, 2] > ratio * values[:, 1]) & (weight >= 0.1)


def _step(p: np.ndarray, n: np.ndarray, d: np.ndarray, middle: np.ndarray) -> np.ndarray | None:
    """Rotation vector about the middle and shift that lessen d along n; None if the equations don't fix them."""
    j = np.hstack([np.cross(p - middle, n), n])
    a = j.T @ j
    if len(p) < 6 or np.linalg.matrix_rank(a, tol=1e-9 * max(1.0, float(np.trace(a)))) < 6:
        return None
    return np.linalg.solve(a, -j.T @ d)


def _off_plane(groups: np.ndarray) -> np.ndarray:
    """How far the points of each group lie off the plane that fits them best, at most."""
    off = groups - groups.mean(1)[:, None]
    normal = np.linalg.eigh(np.einsum("nij,nik->njk", off, off))[1][..., 0]
    return np.abs(np.einsum("nij,nj->ni", off, normal)).max(1)


def _off_line(groups: np.ndarray) -> np.ndarray:
    """As _off_plane, off the best line."""
    off = groups - groups.mean(1)[:, None]
    axis = np.linalg.eigh(np.einsum("nij,nik->njk", off, off))[1][..., 2]
    away = off - np.einsum("nij,nj->ni", off, axis)[..., None] * axis[:, None]
    return np.linalg.norm(away, axis=2).max(1)


def _exact(off: np.ndarray) -> np.ndarray:
    """The better half of numbers that tell how far something is off, and all up to FINE."""
    return off <= max(float(np.median(off)), FINE)


def _settled(step: np.ndarray, times: float = 1) -> bool:
    return np.linalg.norm(step[:3]) < times * TOLERANCE and np.linalg.norm(step[3:]) < times * TOLERANCE


def register(source: dict, target: dict, guess: tuple[np.ndarray, np.ndarray], rounds: int = ROUNDS, reach: float = 1.0, finer: bool = False) -> tuple[np.ndarray, np.ndarray, float, int]:
    """R, t, mean residual and rounds of the transform that lays the source's corners on lines and its surfaces on planes of the target.

    Each round takes the five nearest target points of a moved source point, all within `reach`. It stops once a step
    turns and shifts by under TOLERANCE; NaN residual and the transform so far where the equations are singular.
    Planes and lines through points of two walls bend the motion, and so do those of a wall beside the point's own.
    With `finer`, rounds that are left go on with the better half of the groups by how well they fit theirs, and of the
    points by how near they are, to the same end; where these don't fix the motion, it stays.
    """
    rot, shift = guess
    cells = {k: Cells(v, reach) for k, v in target.items() if len(v) >= 5}
    loss, fine = float("nan"), False
    for k in range(1, rounds + 1):
        parts = []
        for kind, terms, off in (("corner", line_terms, _off_line), ("surface", plane_terms, _off_plane)):
            if kind not in cells or not len(source[kind]):
                continue
            moved = source[kind] @ rot.T + shift
            idx, _ = cells[kind].nearest(moved, 5)
            full = idx[:, 4] >= 0
            if full.any():
                groups = cells[kind].points[idx[full]]
                n, d, ok = terms(moved[full], groups)
                if fine and ok.any():
                    ok[ok] = _exact(off(groups[ok])) & _exact(np.abs(d[ok]))
                parts.append((moved[full][ok], n[ok], d[ok]))
        if not parts:
            return rot, shift, loss if fine else float("nan"), k
        p, n, d = (np.concatenate(x) for x in zip(*parts, strict=True))
        middle = p.mean(0) if len(p) else np.zeros(3)
        x = _step(p, n, d, middle)
        if x is None:
            return rot, shift, loss if fine else float("nan"), k
        loss = float(np.abs(d).mean())
        r = turn(x[:3])
        rot, shift = r @ rot, r @ (shift - middle) + middle + x[3:]
        if _settled(x) and (fine or not finer):
            break
        fine = fine or finer and (_settled(x) or (k >= COARSE and _settled(x, 10)))
    return rot, shift, loss, k


def icp(source: np.ndarray, target: np.ndarray, guess: tuple[np.ndarray, np.ndarray], rounds: int = ROUNDS, reach: float = 1.0) -> tuple[np.ndarray, np.ndarray, float, int]:
    """As register, by nearest points within reach and the closed-form rotation of the pairs."""
    rot, shift = guess
    loss, k = float("nan"), 0
    if len(source) < 3 or len(target) < 3:
        return rot, shift, loss, k
    cells = Cells(target, reach)
    for k in range(1, rounds + 1):
        moved = source @ rot.T + shift
        idx, d = cells.nearest(moved, 1)
        ok = idx[:, 0] >= 0
        if ok.sum() < 3:
            return rot, shift, float("nan"), k
        a, b = moved[ok], cells.points[idx[ok, 0]]
        ma, mb = a.mean(0), b.mean(0)
        u, _, vt = np.linalg.svd((a - ma).T @ (b - mb))
        r = vt.T @ np.diag([1, 1, np.sign(np.linalg.det(vt.T @ u.T))]) @ u.T
        t = mb - r @ ma
        rot, shift, loss = r @ rot, r @ shift + t, float(np.sqrt(d[ok, 0]).mean())
        if np.linalg.norm(r - np.eye(3)) < 1e-9 and np.linalg.norm(t) < 1e-9:
            break
    return rot, shift, loss, k


def ndt(source: np.ndarray, target: np.ndarray, guess: tuple[np.ndarray, np.ndarray], rounds: int = ROUNDS, cell: float = 1.0) -> tuple[np.ndarray, np.ndarray, float, int]:
    """As register, against the normal distribution of each target cell of five points or more: Gauss-Newton steps of summed Mahalanobis squares, each weighted by its density.

    A distribution's variances are kept to a hundredth of its largest at least. Residual: mean Mahalanobis distance.
    The first rounds keep them to WIDE of it, so that points some tenths of a cell off their wall are drawn to it too.
    Cells that hold two walls bend the motion, and so does where a wall's points happen to lie. Rounds that are left
    after it has settled go on with the flatter half of the cells and with the way across them alone; where these don't
    fix the motion, it stays.
    """
    rot, shift = guess
    loss, k, wide, fine = float("nan"), 0, True, False
    if not len(source) or not len(target):
        return rot, shift, loss, k
    _, own, n = np.unique(np.floor(target / cell).astype(np.int64), axis=0, return_inverse=True, return_counts=True)
    own = own.ravel()
    mean = np.stack([np.bincount(own, target[:, i]) for i in range(3)], 1) / n[:, None]
    off = target - mean[own]
    cov = np.stack([np.bincount(own, off[:, i] * off[:, j]) for i in range(3) for j in range(3)], 1).reshape(-1, 3, 3) / np.maximum(n - 1, 1)[:, None, None]
    mean, cov = mean[n >= 5], cov[n >= 5]
    if not len(mean):
        return rot, shift, loss, k
    values, vectors = np.linalg.eigh(cov)
    thick = np.sqrt(np.maximum(values[:, 0], 0))
    least = np.maximum(values[:, 2:], 1e-6)
    cells = Cells(mean, cell)
    close, far = (np.einsum("nij,nj,nkj->nik", vectors, 1 / np.maximum(values, least * share), vectors)[cells.order] for share in (0.01, WIDE))
    flat = _exact(thick)[cells.order]
    across = np.einsum("ni,nj,n->nij", vectors[..., 0], vectors[..., 0], 1 / np.maximum(values[:, 0], least[:, 0] * 0.01))[cells.order]
    for k in range(1, rounds + 1):
        moved = source @ rot.T + shift
        idx, _ = cells.nearest(moved, 1)
        ok = idx[:, 0] >= 0
        if fine:
            ok &= flat[idx[:, 0]]
        if ok.sum() < 6:
            return rot, shift, loss if fine else float("nan"), k
        p, m = moved[ok], (far if wide else across if fine else close)[idx[ok, 0]]
        d, middle = p - cells.points[idx[ok, 0]], p.mean(0)
        square = np.einsum("ni,nij,nj->n", d, m, d)
        weight = np.exp(-square / 2)
        j = np.zeros((len(p), 3, 6))
        x, y, z = (p - middle).T
        j[:, 0, 1], j[:, 0, 2], j[:, 1, 0], j[:, 1, 2], j[:, 2, 0], j[:, 2, 1] = z, -y, -z, x, y, -x
        j[:, range(3), range(3, 6)] = 1
        a = np.einsum("n,nia,nij,njb->ab", weight, j, m, j, optimize=True)
        if np.linalg.matrix_rank(a, tol=1e-9 * max(1.0, float(np.trace(a)))) < 6:
            return rot, shift, loss if fine else float("nan"), k
        step = np.linalg.solve(a, -np.einsum("n,nia,nij,nj->a", weight, j, m, d, optimize=True))
        r, loss = turn(step[:3]), float(np.sqrt(square).mean())
        rot, shift = r @ rot, r @ (shift - middle) + middle + step[3:]
        if wide:
            wide = k < COARSE and not _settled(step, 10)
            continue
        if fine and _settled(step):
            break
        fine = fine or _settled(step) or (k >= 2 * COARSE and _settled(step, 10))
    return rot, shift, loss, k


def _all(c: dict) -> np.ndarray:
    return np.concatenate([c["corner"], c["surface"]])


#: Methods by name: (source, target, guess, rounds, reach) of clouds by kind.
METHODS = {"loam": lambda *a: register(*a, finer=True), "icp": lambda s, t, *a: icp(_all(s), _all(t), *a), "ndt": lambda s, t, *a: ndt(_all(s), _all(t), *a)}


def register_pairs(pairs: DataFrame, clouds: DataFrame, method: str = "loam", reach: float = 1.0, rounds: int = ROUNDS) -> DataFrame:
    """q, c, the rotation m00..m22 and shift x, y, z that lay frame q on frame c, residual (null: failed), rounds, radius (length of the shift).

    pairs: q, c and perhaps yaw, the first guess in radians. clouds: frame_id, p, an array of x, y, z, kind (2 corner,
    else surface). A method that isn't in METHODS raises KeyError.
    """
    solve = METHODS[method]
    out = [f"m{i}{j}" for i in range(3) for j in range(3)] + ["x", "y", "z"]

    def split(p):
        if not p.is_valid:
            return {"corner": np.empty((0, 3)), "surface": np.empty((0, 3))}
        xyz = np.stack([p.values.field(c).to_numpy(zero_copy_only=False).astype(float) for c in "xyz"], 1)
        corner = p.values.field("kind").to_numpy(zero_copy_only=False) == 2
        return {"corner": xyz[corner], "surface": xyz[~corner]}

    def run(batches):
        for b in batches:
            rows = []
            for yaw, s, t in zip(b.column("yaw").to_pylist(), b.column("ps"), b.column("pt"), strict=True):
                rot, shift, loss, k = solve(split(s), split(t), (turn(np.array([0, 0, yaw or 0.0])), np.zeros(3)), rounds, reach)
                rows.append([*rot.ravel(), *shift, None if np.isnan(loss) else loss, k, float(np.linalg.norm(shift))])
            cols = list(zip(*rows, strict=True)) or [()] * 15
            arrays = [pa.array(c, pa.int32() if i == 13 else pa.float64()) for i, c in enumerate(cols)]
            yield pa.record_batch([b.column("q"), b.column("c"), *arrays], names=["q", "c", *out, "residual", "rounds", "radius"])

    yaw = F.col("yaw") if "yaw" in pairs.columns else F.lit(0.0)
    wide = pairs.select("q", "c", yaw.cast("double").alias("yaw"))
    for side, name in (("q", "ps"), ("c", "pt")):
        wide = wide.join(clouds.select(F.col("frame_id").alias(side), F.col("p").alias(name)), side)
    schema = "q long, c long, " + ", ".join(f"{c} double" for c in out) + ", residual double, rounds int, radius double"
    return wide.select("q", "c", "yaw", "ps", "pt").mapInArrow(run, schema)


def normal_equations(rows: DataFrame, key: str, jacobian: list[str], error: str) -> DataFrame:
    """key, a_i_j (i <= j), b_i and loss: sums of products of the rows' derivatives, and the mean absolute error; one shuffle of partial sums."""
    a = [F.sum(F.col(x) * F.col(y)).alias(f"a_{i}_{j}") for i, x in enumerate(jacobian) for j, y in enumerate(jacobian) if i <= j]
    b = [F.sum(F.col(x) * F.col(error)).alias(f"b_{i}") for i, x in enumerate(jacobian)]
    return rows.groupBy(key).agg(*a, *b, F.avg(F.abs(F.col(error))).alias("loss"))


def plane_rows(source: DataFrame, target: DataFrame, middle: np.ndarray, reach: float) -> DataFrame:
    """j0..j5, e: derivatives of each source point (q, x, y, z) by a turn about the middle and a shift, and its weighted distance from the plane of its five nearest target points (c, x, y, z), all within reach; as plane_terms has it."""
    near = nearest_points(source, target, 5, reach)
    at = near.join(target.select("c", F.struct("x", "y", "z").alias("p")), "c").groupBy("q").agg(F.sort_array(F.collect_list(F.struct("rk", "p"))).alias("near"))
    wide = at.filter(F.size("near") == 5).join(source, "q").select("x", "y", "z", "near")

    def run(batches):
        for b in batches:
            p = np.stack([b.column(c).to_numpy() for c in "xyz"], 1)
            near = b.column("near").flatten().field("p")
            groups = np.stack([near.field(c).to_numpy() for c in "xyz"], 1).reshape(-1, 5, 3)
            n, d, ok = plane_terms(p, groups)
            j = np.hstack([np.cross(p - middle, n), n])[ok]
            yield pa.record_batch([*map(pa.array, j.T), pa.array(d[ok])], names=[*(f"j{i}" for i in range(6)), "e"])

    return wide.mapInArrow(run, ", ".join(f"j{i} double" for i in range(6)) + ", e double")


def register_map(source: DataFrame, target: DataFrame, rounds: int = ROUNDS, reach: float = 1.0) -> tuple[np.ndarray, np.ndarray, float, int]:
    """R, t, mean residual and rounds that lay the source's surfaces (q, x, y, z) on the target's planes (c, x, y, z), both of any size: correspondences are a join, and only the sums of the normal equations reach the driver. Stops as `register` does."""
    rot, shift, loss, k = np.eye(3), np.zeros(3), float("nan"), 0
    for k in range(1, rounds + 1):
        moved = source.select("q", *((sum(float(rot[i, j]) * F.col(c) for j, c in enumerate("xyz")) + float(shift[i])).alias(n) for i, n in enumerate("xyz")))
        mean = moved.agg(*(F.avg(c) for c in "xyz")).first()
        if mean[0] is None:
            return rot, shift, float("nan"), k
        middle = np.array(mean)
        rows = plane_rows(moved, target, middle, reach).withColumn("one", F.lit(1))
        sums = normal_equations(rows, "one", [f"j{i}" for i in range(6)], "e").first()
        if sums is None:
            return rot, shift, float("nan"), k
        a = np.array([[sums[f"a_{min(i, j)}_{max(i, j)}"] for j in range(6)] for i in range(6)])
        if np.linalg.matrix_rank(a, tol=1e-9 * max(1.0, float(np.trace(a)))) < 6:
            return rot, shift, float("nan"), k
        x = np.linalg.solve(a, -np.array([sums[f"b_{i}"] for i in range(6)]))
        loss, r = float(sums["loss"]), turn(x[:3])
        rot, shift = r @ rot, r @ (shift - middle) + middle + x[3:]
        if np.linalg.norm(x[:3]) < TOLERANCE and np.linalg.norm(x[3:]) < TOLERANCE:
            break
    return rot, shift, loss, k
