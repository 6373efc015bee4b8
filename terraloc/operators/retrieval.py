"""Exact kNN joins by balls, radius joins by grid cells, and alignment of descriptors by circular shifts.

Neighbours are found by squared distance, rounded to 9 places, and then id. The map is dealt by parts of space, whose
borders a bounded sample gives, and packed into balls of up to BLOCK near rows with a centre and a radius; queries are
packed into panels of up to ASKING near ones. By the triangle inequality centres and radii bound how near a ball's keys
are: they tell a distance that a query surely has k keys within, and which balls a panel needs at all. These are sent to
the panel once, nearest first, and each query's k-th best distance so far rules out those that are farther. Matrix
products tell which pairs are worth computing; distances are sums of differences, as products lose places. Queries are a
stated set; all of the map is searched for them.
"""

from __future__ import annotations

import uuid
from collections import deque
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terraloc.operators.descriptors import RINGS, SECTORS

BLOCK = 512
#: Keys of a part of space that are made balls together, and centres that are compared at once.
CHUNK, CENTRES = 64 * BLOCK, 4096
#: Queries of a panel, for which a ball is sent once.
ASKING = 4096
#: Keys that tell where space is cut, and into how many parts at most.
SAMPLE, MOST_LEAVES = 20_000, 4096
#: Neighbours that a panel holds at once.
MOST_FOUND = 1 << 22
#: Balls of an Arrow batch; pairs whose products, and near pairs whose differences, are held at once.
BATCH, PRODUCTS, HITS = 64, 1 << 20, 1 << 16
#: Queries whose differences by one number from a ball's keys are held at once, so that they stay in a core's cache.
TILE = 64
#: Lengths (squared for l2) up to which single precision tells near pairs.
LONGEST = 1e30
#: Side of a radius join's cubes, in radiuses.
SPAN = 8
#: Up to so many pairs of panels and balls are compared without bounds.
FEW_PAIRS = 16
#: Tables that are kept for the steps of a search.
SLOTS = 20
#: Pairs of matrices that are compared at once.
COMPARED = 256


_SLOTS: deque[DataFrame] = deque()


def kept(df: DataFrame) -> DataFrame:
    """df, persisted in memory and on disk; beyond SLOTS the table that was kept first is let go, and computed again if it is read."""
    _SLOTS.append(df.persist(StorageLevel.MEMORY_AND_DISK))
    while len(_SLOTS) > SLOTS:
        _SLOTS.popleft().unpersist()
    return df


def settled(df: DataFrame) -> DataFrame:
    """df, computed now and held in memory and on disk without the plan that it came from, for loops whose plans would hold all earlier rounds'."""
    return df.localCheckpoint(eager=True, storageLevel=StorageLevel.MEMORY_AND_DISK)


def balls(x: np.ndarray, size: int = BLOCK) -> list[np.ndarray]:
    """The rows of x in groups of up to `size` near ones: halves along the longest way, again and again."""
    if len(x) <= size:
        return [np.arange(len(x))]
    a = x[((x - x.mean(0)) ** 2).sum(1).argmax()]
    b = x[((x - a) ** 2).sum(1).argmax()]
    order = np.argsort(x @ (b - a), kind="stable")
    cut = -(-len(x) // 2 // size) * size  # full groups but the last
    return [half[g] for half in (order[:cut], order[cut:]) for g in balls(x[half], size)]


def _apart(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances (not squared) of rows of a and rows of b, row by row of the fewer, so that no array holds all differences."""
    if len(b) < len(a) and metric != "so2":
        return _apart(b, a, metric).T
    out = np.empty((len(a), len(b)))
    for i in range(len(a)):
        diff = b - a[i]
        out[i] = wrapped(diff[:, -1]) if metric == "so2" else np.abs(diff).sum(1) if metric == "l1" else np.sqrt(np.einsum("ij,ij->i", diff, diff))
    return out


def _at_least(a: np.ndarray, b: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray] | None:
    """What distances (squared for l2) of rows of a and rows of b are at least, by single precision, and for each row of a by how much they are over that at most; None of rows too long for that. Rows should lie about the origin, as what is lost grows with their lengths."""
    size = (lambda x: np.einsum("ij,ij->i", x, x)) if metric == "l2" else (lambda x: np.abs(x).sum(1))
    la, lb = size(a), size(b)
    if not max(la.max(), lb.max()) < LONGEST:
        return None
    lost = 1.01 * (a.shape[1] + 10) * 2.0**-24  # a rounding for each number and step
    x, y = a.astype("f4"), b.astype("f4")
    over = 2 * lost * (la + lb.max())
    if metric == "l2":
        out = x @ y.T
        out *= -2
        out += (la * (1 - lost)).astype("f4")[:, None]
        out += (lb * (1 - lost)).astype("f4")
        return out, over
    out = (-lost * la).astype("f4")[:, None] + (-lost * lb).astype("f4")
    x, y, diff = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T), np.empty((TILE, len(b)), "f4")
    for i in range(0, len(a), TILE):
        own = out[i : i + TILE]
        some = diff[: len(own)]
        for u, v in zip(x[:, i : i + TILE, None], y, strict=True):
            np.subtract(u, v, out=some)
            np.abs(some, out=some)
            own += some
    return out, over


def wrapped(angle: np.ndarray) -> np.ndarray:
    """How far apart two angles are that differ by `angle`, the short way round: 0 to pi."""
    return np.abs((angle + np.pi) % (2 * np.pi) - np.pi)


def _known(keys: DataFrame, *chosen: str) -> DataFrame:
    """frame_id, k and for each condition a column side<n>, kept; without null keys, and such that hold a null, which have no neighbours."""
    known = F.col("frame_id").isNotNull() & F.col("k").isNotNull() & ~F.exists("k", F.isnull)
    sides = [F.coalesce(F.expr(c), F.lit(False)).alias(f"side{i}") for i, c in enumerate(chosen)]
    # The call's name keeps a later search, whose files may have changed, from reading these rows.
    return kept(keys.filter(known).select(F.col("frame_id").cast("long"), F.col("k").cast("array<double>"), *sides, F.lit(uuid.uuid4().hex).alias("call")))


def cuts(x: np.ndarray, leaves: int) -> list[tuple[np.ndarray, float, int, int]]:
    """Planes that halve the rows of x along their longest way, again and again, into about `leaves` parts: direction, place, and the numbers of the planes that cut the halves (-1: none)."""
    out: list[tuple[np.ndarray, float, int, int]] = []

    def cut(rows, leaves):
        if leaves <= 1 or len(rows) < 2:
            return -1
        a = rows[((rows - rows.mean(0)) ** 2).sum(1).argmax()]
        way = rows[((rows - a) ** 2).sum(1).argmax()] - a
        along = rows @ way
        at = float(np.quantile(along, (leaves // 2) / leaves))
        low = along < at
        if low.all() or not low.any():
            return -1
        me = len(out)
        out.append((way, at, -1, -1))
        out[me] = (way, at, cut(rows[low], leaves // 2), cut(rows[~low], leaves - leaves // 2))
        return me

    cut(x, leaves)
    return out


def leaf_of(planes: list[tuple[np.ndarray, float, int, int]], x: np.ndarray) -> np.ndarray:
    """Which part of `cuts` each row of x lies in: twice its last plane's number, and one more above it."""
    leaf = np.zeros(len(x), np.int64)
    todo = [(0, np.arange(len(x)))] if planes else []
    while todo:
        n, rows = todo.pop()
        way, at, low, high = planes[n]
        below = x[rows] @ way < at
        for side, then, own in ((0, low, rows[below]), (1, high, rows[~below])):
            if then < 0:
                leaf[own] = 2 * n + side
            else:
                todo.append((then, own))
    return leaf


def _on_circle(ks: np.ndarray) -> np.ndarray:
    return np.hstack((np.cos(ks), np.sin(ks)))


def _near_together(known: DataFrame, size: int, circle: bool) -> DataFrame:
    """leaf, frame_id, k, dealt and sorted by leaf: parts of space that hold about `size` keys each, cut by a sample of at most SAMPLE keys, so that near keys of all partitions meet."""
    n = known.count()
    leaves, planes = min(-(-n // size), MOST_LEAVES), []
    if leaves > 1:
        some = known.select("k").sample(min(1.0, SAMPLE / n), seed=1).limit(SAMPLE).toPandas()["k"]
        x = np.array([np.asarray(k, float) for k in some]).reshape(len(some), -1)
        planes = cuts(_on_circle(x[:, -1:]) if circle else x, leaves)

    def run(batches):
        for b in batches:
            ks = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            yield pa.record_batch([pa.array(leaf_of(planes, _on_circle(ks[:, -1:]) if circle else ks)), b.column(0), b.column(1)], names=["leaf", "frame_id", "k"])

    rows = known.select("frame_id", "k")
    if not planes:
        return rows.select(F.lit(0).cast("long").alias("leaf"), "*").coalesce(1)
    return rows.mapInArrow(run, "leaf long, frame_id long, k array<double>").repartition(leaves, "leaf").sortWithinPartitions("leaf")


def _grouped(batches, size: int):
    """Ids and keys of runs of one leaf, of `size` rows at most."""
    held, n, leaf = [], 0, None

    def out():
        t = pa.Table.from_batches(held).combine_chunks()
        return t.column(1).to_numpy(), pa.concat_arrays(t.column(2).chunks).flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)

    for b in batches:
        if not b.num_rows:
            continue
        ls = b.column(0).to_numpy()
        at = np.concatenate([[0], np.nonzero(np.diff(ls))[0] + 1, [len(ls)]])
        for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if held and ls[i] != leaf:
                yield out()
                held, n = [], 0
            leaf = ls[i]
            while i < j:
                take = min(j - i, size - n)
                held.append(b.slice(i, take))
                i, n = i + take, n + take
                if n == size:
                    yield out()
                    held, n = [], 0
    if held:
        yield out()


def index_of(keys: DataFrame, circle: bool = False) -> DataFrame:
    """Balls: side (0), block (a hash), ids, ks (little-endian 64-bit ids and doubles of up to BLOCK near keys), n, mid (the centre), far1, far2 (radius by l1 and l2).

    Keys are dealt by space first, so a ball's rows are near among all keys, not among those of a partition. On a circle
    the key is its last number, an angle; near ones are neighbours across the cut too, and centre and radius are an
    angle and the short way round.
    """
    return _balls_of(_known(keys), circle)


_blocks = index_of


def _balls_of(known: DataFrame, circle: bool = False) -> DataFrame:
    size, chunk = BLOCK, CHUNK

    def pack(batches):
        for ids, ks in _grouped(batches, chunk):
            ks, rows = ks[:, -1:] if circle else ks, []
            for own in balls(_on_circle(ks) if circle else ks, size):
                x = ks[own]
                mid = np.arctan2(np.sin(x).mean(0), np.cos(x).mean(0)) if circle else x.mean(0)
                far = [float(_apart(mid[None], x, m).max()) for m in (("so2", "so2") if circle else ("l1", "l2"))]
                rows.append((0, ids[own].astype("<i8").tobytes(), x.astype("<f8").tobytes(), len(own), mid.astype("<f8").tobytes(), *far))
                if len(rows) == BATCH:
                    yield balls_batch(rows)
                    rows = []
            if rows:
                yield balls_batch(rows)

    def balls_batch(rows):
        return pa.record_batch([pa.array(c, pa.int32()) if k == 0 else pa.array(c) for k, c in enumerate(zip(*rows, strict=True))], names=["side", "ids", "ks", "n", "mid", "far1", "far2"])

    packed = _near_together(known, chunk, circle).mapInArrow(pack, "side int, ids binary, ks binary, n long, mid binary, far1 double, far2 double")
    return kept(packed.select(F.md5(F.concat("ids", "ks")).alias("block"), "*"))


def _asked(known: DataFrame, circle: bool = False, k: int = 1) -> DataFrame:
    """Panels: block, ids, ks of up to ASKING near queries, which read what they need of the index together, and n, mid, far1, far2, as balls have them; fewer queries where k is so large that their neighbours would fill a task."""
    size = max(1, min(ASKING, MOST_FOUND // k))

    def pack(batches):
        for ids, ks in _grouped(batches, size):
            ks = ks[:, -1:] if circle else ks
            mid = ks[:1] if circle else ks.mean(0)[None]
            far = [float(_apart(mid, ks, m).max()) for m in (("so2", "so2") if circle else ("l1", "l2"))]
            yield pa.record_batch([pa.array([x]) for x in (ids.astype("<i8").tobytes(), ks.astype("<f8").tobytes(), len(ids), mid.astype("<f8").tobytes(), *far)], names=["ids", "ks", "n", "mid", "far1", "far2"])

    packed = _near_together(known, size, circle).mapInArrow(pack, "ids binary, ks binary, n long, mid binary, far1 double, far2 double")
    return kept(packed.select(F.md5(F.concat("ids", "ks")).alias("block"), "*"))


def save_index(entries: DataFrame, path: str, circle: bool = False) -> None:
    """entries: frame_id, k. Writes them as balls, which load_index reads for searches without packing them again; on a circle for so2."""
    _blocks(entries, circle=circle).write.mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def knn(queries: DataFrame, entries: DataFrame, k: int = 10, metric: str = "l2", without_own: bool = False, eps: float = 0.0) -> DataFrame:
    """queries, entries: frame_id, k (arrays of one length). q, c, d, rk: the k nearest entries of each query; without_own leaves out those of the query's id. The metric is l1, l2 (squared) or so2, the short way round between the keys' last numbers as angles; so3 is l2 of four numbers.

    With eps the search stops sooner: a query leaves out balls that can't hold a key nearer than its k-th so far by a
    factor of 1 + eps, so each of its distances is within that factor of the exact one of its rank.
    """
    return knn_of_index(queries, _blocks(entries, circle=metric == "so2"), k, metric, without_own, eps)


def knn_within(keys: DataFrame, asked: str, searched: str, k: int = 10, metric: str = "l2", reach: float = np.inf) -> DataFrame:
    """knn of the keys for which the condition `asked` holds among those for which `searched` does; the keys are computed once. Neighbours as far as `reach` (not squared) or farther may be left out."""
    known, circle = _known(keys, asked, searched), metric == "so2"
    return _nearest(_asked(known.filter("side0"), circle, k), _balls_of(known.filter("side1"), circle), k, metric, False, reach=reach)


def knn_stopped(keys: DataFrame, asked: str, k: int, eps: tuple[float, ...]) -> list[DataFrame]:
    """For each of eps, knn with it of the keys for which the condition `asked` holds among all; the keys, their balls and bounds are computed once."""
    known = _known(keys, asked)
    sought, index = _asked(known.filter("side0"), k=k), _balls_of(known)
    near = _bounds_of(sought, index, k, "l2", False)
    return [_nearest(sought, index, k, "l2", False, e, bounds=near) for e in eps]


def knn_of_index(queries: DataFrame, index: DataFrame, k: int = 10, metric: str = "l2", without_own: bool = False, eps: float = 0.0) -> DataFrame:
    """knn, with the entries as load_index reads them; so2 needs an index on a circle."""
    return _nearest(_asked(_known(queries), metric == "so2", k), index, k, metric, without_own, eps)


def _bounds_of(asked: DataFrame, index: DataFrame, k: int, metric: str, without_own: bool, reach: float = np.inf) -> tuple[DataFrame, DataFrame, int, int]:
    """_bounded, or all pairs where they are few, and the numbers of panels and of balls."""
    panels, n = asked.count(), index.count()
    if panels * n <= FEW_PAIRS:  # bounds would cost more than they spare
        told = asked.withColumn("most", F.lit(None).cast("binary"))
        return told, asked.select("block").crossJoin(index.select(F.col("block").alias("other"))).withColumn("at", F.lit(0.0)), panels, n
    told, met = _bounded(asked, index, k + without_own, metric, panels, n, reach)
    return told, kept(met), panels, n


def _nearest(asked: DataFrame, index: DataFrame, k: int, metric: str, without_own: bool, eps: float = 0.0, reach: float = np.inf, bounds: tuple | None = None) -> DataFrame:
    """Keys as far as `reach` may be among the neighbours or not; bounds are what _bounds_of says."""
    if metric not in ("l1", "l2", "so2"):
        raise ValueError(f"no such metric: {metric}")
    told, met, panels, n = bounds or _bounds_of(asked, index, k, metric, without_own, reach)
    cores = asked.sparkSession.sparkContext.defaultParallelism
    lanes = max(1, min(-(-3 * cores // max(panels, 1)), n))
    parts = max(1, min(panels * lanes, 12 * cores))
    far = "far1" if metric == "l1" else "far2"
    first = told.select("block", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), F.lit(-1.0).alias("at"), "most", "ids", "ks", F.lit(None).cast("binary").alias("mid"), F.lit(None).cast("double").alias("far"))
    sent = met.withColumn("lane", F.pmod(F.xxhash64("other"), F.lit(lanes)).cast("int")).hint("shuffle_hash")
    rest = index.select(F.col("block").alias("other"), "ids", "ks", "mid", F.col(far).alias("far")).join(sent, "other").withColumn("most", F.lit(None).cast("binary"))
    rows = first.unionByName(rest.drop("other")).repartition(parts, "block", "lane").sortWithinPartitions("block", "lane", "at")
    found = rows.select("at", "most", "ids", "ks", "mid", "far").mapInArrow(lambda batches: _searched(batches, k, metric, without_own, eps, reach), "q long, c long, d double")
    return _ranked_rows(found, k).select("q", "c", "d", "rk")


def _ranked_rows(pairs: DataFrame, k: int) -> DataFrame:
    return pairs.withColumn("rk", F.row_number().over(Window.partitionBy("q").orderBy("d", "c"))).filter(F.col("rk") <= k)


def _centres(rows: DataFrame, metric: str, n: int, *more: str) -> DataFrame:
    """others, ns, mids, fars: names, numbers of rows, centres and radii of up to CENTRES of n balls or panels, and lists of `more`."""
    columns = ["block", "n", "mid", "far1" if metric == "l1" else "far2", *more]

    def packed(held):
        t = pa.Table.from_batches(held)
        lists = [pa.array([b"".join(t.column(c).to_pylist()) if c == "mid" else t.column(c).to_pylist()]) for c in columns]
        return pa.record_batch(lists, names=["others", "ns", "mids", "fars", *more])

    def gather(batches):
        held, size = [], 0
        for b in batches:
            for at in range(0, b.num_rows, CENTRES):
                part = b.slice(at, CENTRES)
                if size + part.num_rows > CENTRES:
                    yield packed(held)
                    held, size = [], 0
                held.append(part)
                size += part.num_rows
        if size:
            yield packed(held)

    schema = ["others array<string>", "ns array<long>", "mids binary", "fars array<double>", *(f"{c} array<double>" for c in more)]
    # Few parts: the index has one for some balls, and each would meet each of the panels'.
    return rows.select(*columns).repartition(max(1, -(-n // CENTRES))).mapInArrow(gather, ", ".join(schema))


def _between(ids: bytes, ks: bytes, mids: bytes, n: int, metric: str):
    """How far a panel's queries are from balls' centres, by slices of queries that hold up to PRODUCTS distances, or one query's."""
    return _slices(np.frombuffer(ks, "<f8").reshape(len(ids) // 8, -1), np.frombuffer(mids, "<f8").reshape(n, -1), metric)


def _slices(q: np.ndarray, mids: np.ndarray, metric: str):
    step = max(1, PRODUCTS // len(mids))
    for at in range(0, len(q), step):
        own = slice(at, at + step)
        yield own, _apart(q[own], mids, metric)


def _bounded(asked: DataFrame, index: DataFrame, rows: int, metric: str, panels: int, n: int, reach: float = np.inf) -> tuple[DataFrame, DataFrame]:
    """The panels with `most`, a distance that each query (doubles in their order) has `rows` keys within, by the centres and radii of balls alone; and block, other, at: balls that some query of a panel needs, and how near to it they are at least.

    Panels' own centres and radii meet the balls' first: only balls that they don't rule out meet the panel's queries,
    which come to a task once for all of these.
    """
    centres = kept(_centres(index, metric, n))

    def most_of(batches):
        for b in batches:
            for blocks, wides, at, ns, mids, fars in zip(*(b.column(c).to_pylist() for c in range(6)), strict=True):
                full, most = np.array(ns) >= rows, np.full(len(blocks), reach)
                if full.any():
                    some = np.frombuffer(mids, "<f8").reshape(len(ns), -1)[full]
                    for own, away in _slices(np.frombuffer(at, "<f8").reshape(len(blocks), -1), some, metric):
                        most[own] = np.minimum(most[own], (away + np.array(fars)[full]).min(1) + np.array(wides)[own])
                yield pa.record_batch([pa.array(blocks, pa.string()), pa.array(most)], names=["block", "most"])

    amid = _centres(asked, metric, panels).toDF("blocks", "_", "at", "wides")
    each = amid.crossJoin(centres).select("blocks", "wides", "at", "ns", "mids", "fars").mapInArrow(most_of, "block string, most double")
    around = kept(_around(asked.join(each.groupBy("block").agg(F.min("most").alias("most")), "block"), centres, metric, panels))

    def told_of(panel, met):
        ids, ks, _ = panel
        most = np.full(len(ids) // 8, reach)
        for _, ns, mids, fars in met:
            full = np.array(ns) >= rows
            if full.any():
                some = np.frombuffer(mids, "<f8").reshape(len(ns), -1)[full]
                for own, apart in _between(ids, ks, some.tobytes(), len(some), metric):
                    apart += np.array(fars)[full]
                    most[own] = np.minimum(most[own], apart.min(1))
        return [(ids, ks, most.astype("<f8").tobytes())]

    parts = max(1, min(panels, 12 * asked.sparkSession.sparkContext.defaultParallelism))
    told = kept(_by_panels(asked.withColumn("most", F.lit(None).cast("binary")), around, parts, told_of, ["ids binary", "ks binary", "most binary"]))
    return told, _needed(told, around, metric, parts)


def _around(panels: DataFrame, centres: DataFrame, metric: str, n: int) -> DataFrame:
    """block, others, ns, mids, fars: balls that some query of a panel may need whose queries all have enough keys within `most`, by the panels' centres and radii."""

    def near(batches):
        for b in batches:
            for blocks, wides, at, mosts, others, ns, mids, fars in zip(*(b.column(c).to_pylist() for c in range(8)), strict=True):
                all_mids = np.frombuffer(mids, "<f8").reshape(len(others), -1)
                for own, away in _slices(np.frombuffer(at, "<f8").reshape(len(blocks), -1), all_mids, metric):
                    # Bounds are sums of rounded numbers.
                    may = (away - np.array(wides)[own, None] - np.array(fars)) * (1 - 1e-9) - 1e-7 <= np.array(mosts)[own, None]
                    for block, row in zip(blocks[own], may, strict=True):
                        keep = np.nonzero(row)[0].tolist()
                        if keep:
                            told = [[others[i] for i in keep]], [[ns[i] for i in keep]], [all_mids[keep].tobytes()], [[fars[i] for i in keep]]
                            yield pa.record_batch([pa.array([block]), *map(pa.array, told)], names=["block", "others", "ns", "mids", "fars"])

    amid = _centres(panels, metric, n, "most").toDF("blocks", "_", "at", "wides", "most")
    wide = amid.crossJoin(centres).select("blocks", "wides", "at", "most", "others", "ns", "mids", "fars")
    return wide.mapInArrow(near, "block string, others array<string>, ns array<long>, mids binary, fars array<double>")


def _by_panels(panels: DataFrame, around: DataFrame, parts: int, told, columns: list[str]) -> DataFrame:
    """block and columns: what told(panel, met) lists of each panel (ids, ks, most) and the balls around it, which follow it in a task (others, ns, mids, fars)."""
    balls_of = ["others", "ns", "mids", "fars"]
    types = dict(around.dtypes)
    first = panels.select("block", F.lit(0).alias("turn"), "ids", "ks", "most", *(F.lit(None).cast(types[c]).alias(c) for c in balls_of))
    then = around.select("block", F.lit(1).alias("turn"), *(F.lit(None).cast("binary").alias(c) for c in ("ids", "ks", "most")), *balls_of)
    schema = ", ".join(["block string", *columns])

    kinds = [{"binary": pa.binary(), "string": pa.string(), "double": pa.float64()}[c.split()[1]] for c in columns]

    def run(batches):
        rows = ([b.column(c)[i].as_py() for c in range(9)] for b in batches for i in range(b.num_rows))
        for block, own in groupby(rows, key=lambda r: r[0]):
            panel = next(own)[2:5]
            got = told(panel, (r[5:] for r in own))
            if got:
                arrays = [pa.array(x, kind) for x, kind in zip(zip(*got, strict=True), kinds, strict=True)]
                yield pa.record_batch([pa.array([block] * len(got)), *arrays], names=["block", *(c.split()[0] for c in columns)])

    return first.unionByName(then).repartition(parts, "block").sortWithinPartitions("block", "turn").mapInArrow(run, schema)


def _needed(told: DataFrame, around: DataFrame, metric: str, parts: int) -> DataFrame:
    """block, other, at, as _bounded has them, of panels with `most`."""

    def needed(panel, met):
        ids, ks, most = panel
        most, out = np.frombuffer(most, "<f8"), []
        for others, _, mids, fars in met:
            near, least = np.zeros(len(others), bool), np.full(len(others), np.inf)
            for own, lower in _between(ids, ks, mids, len(others), metric):
                lower -= np.array(fars)
                least = np.minimum(least, np.maximum(lower.min(0), 0))
                # Bounds are sums of rounded numbers.
                near |= (np.maximum(lower, 0) * (1 - 1e-9) - 1e-7 <= most[own, None]).any(0)
            out += [(others[i], float(least[i])) for i in np.nonzero(near)[0].tolist()]
        return out

    return _by_panels(told, around, parts, needed, ["other string", "at double"])


def _up_to(d: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Which distances are finite and up to `most` of their row, or over it by a rounding to d's type."""
    top = np.finfo(d.dtype).max
    return d <= np.nextafter(np.minimum(most, top).astype(d.dtype), top, dtype=d.dtype)[:, None]


class _Panel:
    """Queries of a task, and the k nearest keys that each has met."""

    def __init__(self, ids: bytes, ks: bytes, most: bytes | None, k: int, metric: str, without_own: bool, eps: float, reach: float = np.inf):
        self.ids, self.k, self.metric, self.without_own, self.eps = np.frombuffer(ids, "<i8"), k, metric, without_own, eps
        self.q = np.frombuffer(ks, "<f8").reshape(len(self.ids), -1)
        self.square = np.einsum("ij,ij->i", self.q, self.q)
        self.d, self.c = np.full((len(self.ids), k), np.inf), np.zeros((len(self.ids), k), np.int64)
        m = (np.full(len(self.ids), reach) if most is None else np.frombuffer(most, "<f8")) * (1 + 1e-9) + 1e-7
        self.kth = m * m if metric == "l2" else m

    def meet(self, ids: bytes, ks: bytes, mid: bytes, far: float) -> None:
        ids = np.frombuffer(ids, "<i8")
        c = np.frombuffer(ks, "<f8").reshape(len(ids), -1)
        lower = np.maximum(_apart(np.frombuffer(mid, "<f8")[None], self.q, self.metric)[0] - far, 0)
        if self.eps:
            lower = np.where(self.d[:, -1] < np.inf, lower * (1 + self.eps), lower)
        # Distances are rounded, and bounds are sums of rounded numbers.
        own = np.nonzero((lower * lower if self.metric == "l2" else lower) * (1 - 1e-9) - 1e-8 <= self.kth)[0]
        step = max(1, PRODUCTS // len(ids))
        for at in range(0, len(own), step):
            self._compare(own[at : at + step], ids, c, np.frombuffer(mid, "<f8"))

    def _compare(self, own: np.ndarray, ids: np.ndarray, c: np.ndarray, mid: np.ndarray) -> None:
        q = self.q[own]
        about = None if self.metric == "so2" else _at_least(q - mid, c - mid, self.metric)
        if about:  # single precision tells which pairs can be near; these are then computed from differences
            (d, over), slack = about, 1e-8
        elif self.metric == "l2":  # as do products, which lose places too
            square = np.einsum("ij,ij->i", c, c)
            d = self.square[own, None] + square - 2 * (q @ c.T)
            slack = 1e-8 + 1e-12 * (self.square[own].max() + square.max())
            over = 2 * slack
        else:
            d, slack, over = np.round(_apart(q, c, self.metric), 9), 0.0, 0.0
        if self.without_own:
            d[self.ids[own][:, None] == ids] = np.inf
        most = self.kth[own] + slack
        hit = _up_to(d, most)
        if len(ids) > self.k and np.count_nonzero(hit) > 2 * self.k * len(own):
            most = np.minimum(most, np.partition(d, self.k - 1, axis=1)[:, self.k - 1] + over + 2 * slack)
            hit = _up_to(d, most)
        i, j = np.nonzero(hit)
        for at in range(0, len(i), HITS):
            x, y = i[at : at + HITS], j[at : at + HITS]
            if about or self.metric == "l2":
                diff = c[y] - q[x]
                exact = np.round(np.einsum("ij,ij->i", diff, diff) if self.metric == "l2" else np.abs(diff).sum(1), 9)
            else:
                exact = d[x, y]
            self._merge(own[x], ids[y], exact)

    def _merge(self, at: np.ndarray, c: np.ndarray, d: np.ndarray) -> None:
        who = np.unique(at)
        q = np.concatenate([np.repeat(who, self.k), at])
        d, c = np.concatenate([self.d[who].ravel(), d]), np.concatenate([self.c[who].ravel(), c])
        order = np.lexsort((c, d, q))
        q, d, c = q[order], d[order], c[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        first = rank < self.k
        self.d[q[first], rank[first]], self.c[q[first], rank[first]] = d[first], c[first]
        self.kth[who] = np.minimum(self.kth[who], self.d[who, -1])

    def found(self) -> pa.RecordBatch:
        i, j = np.nonzero(self.d < np.inf)
        return pa.record_batch([pa.array(self.ids[i]), pa.array(self.c[i, j]), pa.array(self.d[i, j])], names=["q", "c", "d"])


def _searched(batches, k: int, metric: str, without_own: bool, eps: float, reach: float):
    """q, c, d of each panel (at under 0) and the balls that follow it, the nearest first."""
    panel = None
    for b in batches:
        for i in range(b.num_rows):
            at, most, ids, ks, mid, far = (b.column(c)[i].as_py() for c in range(6))
            if at >= 0:
                panel.meet(ids, ks, mid, far)
                continue
            if panel is not None:
                yield panel.found()
            panel = _Panel(ids, ks, most, k, metric, without_own, eps, reach)
    if panel is not None:
        yield panel.found()


def met_share(queries: DataFrame, entries: DataFrame, k: int = 10, metric: str = "l2") -> float:
    """Which part of the pairs of a query and a ball may hold one of the k nearest, by the bounds; for reports."""
    asked, index, parts = _known(queries), _blocks(entries, metric == "so2"), queries.sparkSession.sparkContext.defaultParallelism
    d = _nearest(_asked(asked, metric == "so2"), index, k, metric, False).groupBy("q").agg(F.max("d").alias("d"))

    def pack(batches):
        for b in batches:
            for i, key, d in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                d = d**0.5 if metric == "l2" else d
                row = np.array([i], "<i8"), np.array(key[-1:] if metric == "so2" else key, "<f8"), np.array([d], "<f8")
                yield pa.record_batch([pa.array([str(i)]), *(pa.array([x.tobytes()]) for x in row), pa.array([d])], names=["block", "ids", "ks", "most", "within"])

    single = asked.join(d, asked.frame_id == d.q).select("frame_id", "k", "d").mapInArrow(pack, "block string, ids binary, ks binary, most binary, within double")
    n, balls_n = asked.count(), index.count()
    points = single.select("block", F.lit(1).cast("long").alias("n"), F.col("ks").alias("mid"), F.lit(0.0).alias("far1"), F.lit(0.0).alias("far2"), F.col("within").alias("most"))
    around = _around(points, _centres(index, metric, balls_n), metric, n)
    return _needed(single, around, metric, parts).count() / max(n * balls_n, 1)


def radius_join(queries: DataFrame, entries: DataFrame, radius2: float, by: tuple[str, ...] = ()) -> DataFrame:
    """queries: q, x, y, z; entries: c, x, y, z; both with the columns `by`. by, q, c, d: pairs that are equal in `by` and whose squared distance d is under radius2.

    Entries lie in cubes of SPAN radiuses' side, and a query goes to each cube that its ball reaches. A cube's rows are
    packed by up to BLOCK, or about as many, so that what moves is packs, and packs of one cube meet. No task has to hold
    a crowded cube. Points with a null coordinate or `by` have no pairs.
    """
    radius = radius2**0.5 * (1 + 1e-9)  # wider by more than the division rounds
    side, key = SPAN * radius, [*by, "_x", "_y", "_z"]
    known, types = [*by, "x", "y", "z"], dict(queries.dtypes) | dict(entries.dtypes)

    def packed(rows, name):
        parts = rows.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_parts"))
        dealt = rows.join(parts, key).withColumn("_part", F.pmod(F.xxhash64(name), F.col("_parts")).cast("int"))
        return dealt.groupBy(*key, "_part").agg(F.collect_list(F.struct(name, *(F.col(x).cast("double").alias(x) for x in "xyz"))).alias(f"_{name}")).drop("_part")

    held = packed(entries.dropna(subset=known).select(*by, "c", *"xyz", *(F.floor(F.col(x) / side).alias(f"_{x}") for x in "xyz")), "c")
    asking = queries.dropna(subset=known).select(*by, "q", *"xyz")
    for x in "xyz":
        asking = asking.withColumn(f"_{x}", F.explode(F.sequence(F.floor((F.col(x) - radius) / side), F.floor((F.col(x) + radius) / side))))
    asking = packed(asking, "q")

    def run(batches):
        out, n = [], 0
        for b in batches:
            for r in range(b.num_rows):
                qs, cs = (b.column(len(by) + i)[r].values for i in range(2))
                near = sum((qs.field(x).to_numpy()[:, None] - cs.field(x).to_numpy()) ** 2 for x in "xyz")
                i, j = np.nonzero(near < radius2)
                if len(i):
                    same = [pa.repeat(b.column(x)[r], len(i)) for x in range(len(by))]
                    out.append(pa.record_batch([*same, qs.field("q").take(pa.array(i)), cs.field("c").take(pa.array(j)), pa.array(near[i, j])], names=[*by, "q", "c", "d"]))
                    n += len(i)
                if n >= HITS:
                    yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                    out, n = [], 0
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    both = asking.join(held, key).select(*by, "_q", "_c")
    return both.mapInArrow(run, ", ".join(f"`{x}` {types[x]}" for x in (*by, "q", "c")) + ", d double")


def nearest_points(queries: DataFrame, entries: DataFrame, k: int, reach: float) -> DataFrame:
    """queries: q, x, y, z; entries: c, x, y, z. q, c, d, rk: the k nearest entries of each query strictly within `reach`, by squared distance, rounded to 9 places, and then c.

    A search by balls, as knn, whose bounds start at the reach: neither side has to fit a task, and where entries are
    dense a query meets the few balls around it only. Points with a null id or coordinate have no neighbours.
    """
    asked, searched = (df.select(F.col(i).alias("frame_id"), F.array(*(F.col(x).cast("double") for x in "xyz")).alias("k")) for df, i in ((queries, "q"), (entries, "c")))
    return _nearest(_asked(_known(asked), k=k), index_of(searched), k, "l2", False, reach=reach).filter(F.col("d") < reach * reach)


def coarse_shifts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each pair of matrices (pairs, rings, sectors), the columns that b's is turned right by to be nearest to a's by sector keys; first wins."""
    ka, kb, columns = a.mean(1), b.mean(1), np.arange(a.shape[2])
    turned = kb[:, (columns - columns[:, None]) % len(columns)]
    return np.argmin(np.round(np.sqrt(((ka[:, None] - turned) ** 2).sum(2)), 9), 1)


def align_all(a: np.ndarray, b: np.ndarray, around: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Shifts and distances of pairs of matrices (pairs, rings, sectors): the best shift by sector keys, then the best mean column cosine within `around` of it; first wins. NaN without comparable columns."""
    columns, coarse = np.arange(a.shape[2]), coarse_shifts(a, b)
    na, nb = (np.sqrt((x * x).sum(1)) for x in (a, b))
    tried = np.sort((coarse[:, None] + np.arange(-around, around + 1)) % len(columns), 1)
    dist = np.empty(tried.shape)
    for t in range(tried.shape[1]):
        source = (columns - tried[:, t, None]) % len(columns)
        dot, size = (a * np.take_along_axis(b, source[:, None], 2)).sum(1), na * np.take_along_axis(nb, source, 1)
        seen = size > 0
        cosines = np.where(seen, dot / np.where(seen, size, 1), 0).sum(1)
        dist[:, t] = np.where(seen.any(1), np.round(1 - cosines / np.maximum(seen.sum(1), 1), 9), np.inf)
    at = np.argmin(dist, 1)
    best = dist[np.arange(len(at)), at]
    return np.where(best < np.inf, tried[np.arange(len(at)), at], coarse), np.where(best < np.inf, best, np.nan)


def align(a: np.ndarray, b: np.ndarray, around: int = 3) -> tuple[int, float]:
    """align_all of two matrices."""
    shifts, dists = align_all(a[None], b[None], around)
    return int(shifts[0]), float(dists[0])


def _dense(cells: pa.ListArray, rings: int, sectors: int) -> np.ndarray:
    """rings x sectors matrices of packed cells, empty ones 0."""
    flat, sizes = cells.flatten(), np.diff(cells.offsets.to_numpy())
    out = np.zeros((len(cells), rings * sectors))
    out[np.repeat(np.arange(len(cells)), sizes), flat.field(0).to_numpy()] = flat.field(1).to_numpy()
    return out.reshape(-1, rings, sectors)


def rerank(pairs: DataFrame, matrices: DataFrame, around: int = 3, rings: int = RINGS, sectors: int = SECTORS) -> DataFrame:
    """pairs: q, c. q, c, dist, shift after alignment."""
    return _compared(pairs, matrices, lambda a, b: dict(zip(("shift", "dist"), align_all(a, b, around), strict=True)), rings, sectors).select("q", "c", "dist", "shift")


def coarse(pairs: DataFrame, matrices: DataFrame, rings: int = RINGS, sectors: int = SECTORS) -> DataFrame:
    """pairs: q, c. q, c, s0: the shift by sector keys alone."""
    return _compared(pairs, matrices, lambda a, b: {"shift": coarse_shifts(a, b)}, rings, sectors).select("q", "c", F.col("shift").alias("s0"))


def _compared(pairs: DataFrame, matrices: DataFrame, compare, rings: int, sectors: int) -> DataFrame:
    """q, c, dist, shift: what `compare` says of the matrices of up to COMPARED pairs at a time."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, COMPARED):
                part = b.slice(at, COMPARED)
                got = compare(*(_dense(part.column(x), rings, sectors) for x in ("ma", "mb")))
                dist = got.get("dist", np.full(part.num_rows, np.nan))
                yield pa.record_batch([part.column("q"), part.column("c"), pa.array(dist, pa.float64()), pa.array(got["shift"], pa.int32())], names=["q", "c", "dist", "shift"])

    return _with_matrices(pairs, matrices).mapInArrow(run, "q long, c long, dist double, shift int")


def _with_matrices(pairs: DataFrame, matrices: DataFrame) -> DataFrame:
    left, right = (matrices.select(F.col("frame_id").alias(i), F.col("m").alias(m)) for i, m in (("q", "ma"), ("c", "mb")))
    return pairs.select("q", "c").join(left, "q").join(right, "c").select("q", "c", "ma", "mb")


def top(scored: DataFrame, n: int) -> DataFrame:
    """The n best candidates of each query, with rank."""
    return scored.withColumn("rk", F.row_number().over(Window.partitionBy("q").orderBy("dist", "c"))).filter(F.col("rk") <= n)
