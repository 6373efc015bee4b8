"""Exact top-k by inner product: a Voronoi kNN join.

Pivots, about the square root of the rows' number and chosen by a hash, cut the vectors into Voronoi cells. A cell's
summary is its k + 1 rows nearest to the pivot. A query's k best among all summaries give a score that its k-th best
can't be under; as q.x <= q.c + |q| |x - c|, only those rows of a cell can be better that lie far enough from its pivot
c. Queries of neighbouring cells form groups of about GROUP_QUERIES; a row goes to a group only if some query of the
group may need it. A group's rows are dealt to slices of about SLICE_ROWS; a slice holds the group's queries, streams
its rows by blocks and keeps the best k, and the slices' lists are merged in the end.

Bounded: the driver and each task see the pivots and summaries (PIVOT_BYTES together) and the cells' sizes; what groups
ask of cells is a table that is joined to the rows, whose large cells are cut into parts of CELL_ROWS. Products are
exact: in doubles while sums stay under 2^53, in 64-bit integers while they fit, else in whole numbers of any length.

Defined cases: a row is a candidate of every query but itself, so rows with one vec_id count each for itself, and each
of them that is a query has a list; vectors that are null, or hold null or non-finite numbers, or such whose 256-fold
isn't a finite double, take no part, nor do rows without a vec_id; scores beyond a long are the nearest long, and tie;
empty vectors have score 0 with one another; vectors of different lengths aren't compared; ties go to smaller vec_ids;
an empty table gives an empty result; columns other than vec_id and embedding aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terraloc.llm.common import partitions, save, table

PIVOT_BYTES = 32 << 20
GROUP_QUERIES = 512
SLICE_ROWS = 1 << 20
CELL_ROWS = 1 << 16
K = 5
EVERY = 50
#: No score; real ones are over it.
LOW = -(1 << 63)
TOP = (1 << 63) - 1


def _quantized(batches):
    for b in batches:
        col = b.column(1)
        flat = col.flatten()
        with np.errstate(over="ignore"):
            x = np.floor(256 * flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False))
        sizes = np.array([0 if s is None else s for s in pa.compute.list_value_length(col).to_pylist()], np.int64)
        ends = np.cumsum(sizes)
        data = []
        for s, e, valid in zip((ends - sizes).tolist(), ends.tolist(), col.is_valid().to_pylist(), strict=True):
            most = np.abs(x[s:e]).max(initial=0)  # not a number if any is none
            data.append(None if not valid or not np.isfinite(most) else x[s:e].astype("<i4" if most < 2**31 else "<f8").tobytes())
        keep = pa.array([i for i, q in enumerate(data) if q is not None], pa.int64())
        yield pa.record_batch([b.column(0).take(keep), pa.array(sizes.astype(np.int32)).take(keep), pa.array([q for q in data if q is not None], pa.binary())], names=["vec_id", "dim", "q"])


def quantized(vectors: DataFrame) -> DataFrame:
    """row, vec_id, dim, q: floor(256 x) as little-endian 32-bit integers, or doubles where one doesn't fit. Rows are numbered, so the result is to be saved before it is used twice."""
    known = vectors.filter("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return known.mapInArrow(_quantized, "vec_id long, dim int, q binary").select(F.monotonically_increasing_id().alias("row"), "vec_id", "dim", "q")


def _matrix(data: list[bytes], dim: int) -> np.ndarray:
    if all(len(x) == 4 * dim for x in data):
        return np.frombuffer(b"".join(data), "<i4").reshape(len(data), dim).astype(float)
    return np.stack([np.frombuffer(x, "<i4" if len(x) == 4 * dim else "<f8").astype(float) for x in data])


def _by_dim(b: pa.RecordBatch):
    dims, data = b.column("dim").to_numpy(), b.column("q").to_pylist()
    for d in np.unique(dims).tolist():
        at = np.nonzero(dims == d)[0]
        yield d, at, _matrix([data[i] for i in at.tolist()], d)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, as longs; those beyond a long are the nearest one but LOW."""
    if not a.shape[1] or not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    with np.errstate(over="ignore"):
        most = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    if most < 2**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    out = np.empty((len(a), len(b)), np.int64)
    wide_a, wide_b = np.abs(a).max(1) >= 2**24, np.abs(b).max(1) >= 2**24
    if wide_a.all() or wide_b.all() or not (wide_a.any() or wide_b.any()):
        whole = [[int(v) for v in row] for row in b.tolist()]
        for i, row in enumerate(a.tolist()):
            row = [int(v) for v in row]
            out[i] = [min(max(sum(x * y for x, y in zip(row, other, strict=True)), LOW + 1), TOP) for other in whole]
        return out
    for own in (wide_a, ~wide_a):
        for other in (wide_b, ~wide_b):
            out[np.ix_(own, other)] = products(a[own], b[other])
    return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of scores the k highest, by score and then id; filled up with LOW."""
    if scores.shape[1] > 4 * k:
        order = np.argsort(ids, kind="stable")
        scores, ids = scores[:, order], ids[order]
        kth = ~np.partition(~scores, k - 1, axis=1)[:, k - 1 : k]
        over, tied = scores > kth, scores == kth
        take = over | (tied & (np.cumsum(tied, axis=1) <= k - over.sum(1, keepdims=True)))
        at = np.nonzero(take)[1].reshape(len(scores), k)
        scores, wide = np.take_along_axis(scores, at, 1), ids[at]
    else:
        wide = np.broadcast_to(ids, scores.shape)
    return merged(scores, wide, k)


def merged(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, ~scores), axis=1)[:, :k]
    scores, ids = np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)
    short = k - scores.shape[1]
    if short > 0:
        scores = np.pad(scores, ((0, 0), (0, short)), constant_values=LOW)
        ids = np.pad(ids, ((0, 0), (0, short)))
    return scores, ids


def path(x: np.ndarray) -> np.ndarray:
    """An order of the rows in which near ones are neighbours: halves along the longest way, again and again."""
    if len(x) < 3:
        return np.arange(len(x))
    a = x[((x - x.mean(0)) ** 2).sum(1).argmax()]
    b = x[((x - a) ** 2).sum(1).argmax()]
    order = np.argsort(x @ (b - a), kind="stable")
    left, right = order[: len(x) // 2], order[len(x) // 2 :]
    return np.concatenate((left[path(x[left])], right[path(x[right])]))


class Cells:
    """The pivots by dimension, neighbours near one another."""

    def __init__(self, rows: list[tuple[int, bytes]]):
        self.pivots = {}
        for d in {d for d, _ in rows}:
            own = _matrix(sorted({q for e, q in rows if e == d}), d)
            self.pivots[d] = own[path(own)]

    def of(self, dim: int) -> np.ndarray:
        return self.pivots.get(dim, np.zeros((1, dim)))

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest pivot and distance to it; rows with numbers of 2^31 and more are infinitely far from the first."""
        c, near = self.of(x.shape[1]), np.abs(x).max(1, initial=0) < 2**31
        f = np.where(near[:, None], x, 0)
        cell = np.where(near, ((c * c).sum(1) - 2 * f @ c.T).argmin(1), 0)
        return cell, np.where(near, np.sqrt(((f - c[cell]) ** 2).sum(1)), np.inf)


def _batch(cols, kinds: str) -> pa.RecordBatch:
    types = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}
    names = [x.split(" ") for x in kinds.split(", ")]
    cols = cols or [[]] * len(names)
    return pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c, types[t]) for c, (_, t) in zip(cols, names, strict=True)], names=[n for n, _ in names])


PLACED = "row long, vec_id long, dim int, q binary, cell int, dist double"
ASKED = "g int, dim int, rows binary, ids binary, xs binary, need array<double>"
SENT = "g int, slice int, dim int, kind int, row long, vec_id long, q binary"


def _summaries(rows: DataFrame, k: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By dimension the row numbers and vectors of the k + 1 rows nearest to each pivot."""

    def nearest(batches):
        held: dict[tuple[int, int], list] = {}
        for b in batches:
            for own in zip(*(b.column(c).to_pylist() for c in ("dim", "cell", "dist", "row", "vec_id", "q")), strict=True):
                kept = held.setdefault(own[:2], [])
                kept.append(own[2:])
                if len(kept) > 8 * (k + 1):
                    held[own[:2]] = sorted(kept)[: k + 1]
        out = [(row, i, dim, q, cell, dist) for (dim, cell), kept in held.items() for dist, row, i, q in sorted(kept)[: k + 1]]
        yield _batch(list(zip(*out, strict=True)), PLACED)

    by_cell = Window.partitionBy("dim", "cell").orderBy("dist", "row")
    near = rows.mapInArrow(nearest, PLACED).withColumn("r", F.row_number().over(by_cell)).filter(F.col("r") <= k + 1).select("dim", "row", "q").toArrow()
    dims, numbers, qs = near.column("dim").to_numpy(), near.column("row").to_numpy(), near.column("q").to_pylist()
    at = {d: np.nonzero(dims == d)[0] for d in np.unique(dims).tolist()}
    return {d: (numbers[i], _matrix([qs[j] for j in i.tolist()], d)) for d, i in at.items()}


def _needs(cells: Cells, summary, k: int):
    """Groups of queries, sorted by g and dim, with the distance from each pivot that a row must have to matter to one of them."""

    def need(x: np.ndarray, numbers: np.ndarray, d: int) -> np.ndarray:
        known, s = summary[d]
        scores = products(x, s)
        scores[known[None, :] == numbers[:, None]] = LOW
        floor = best(scores, known, k)[0][:, k - 1]
        c, wide = cells.of(d), (floor == LOW) | (np.abs(x).max(1, initial=0) >= 2**31)
        f = np.where(wide[:, None], 0, x)
        size = np.sqrt((f * f).sum(1))
        size = np.where(size > 0, size, 1)[:, None]
        at, reach = f @ c.T / size, floor.astype(float)[:, None] / size
        out = reach - at - 1e-9 * (np.abs(reach) + np.abs(at)) - 1e-6
        out[wide | (f == 0).all(1)] = -1
        return out.min(0)

    def told(key, rows, ids, qs):
        x, numbers = _matrix(qs, key[1]), np.array(rows, np.int64)
        step = max(1, (1 << 22) // max(1, len(summary[key[1]][0])))
        least = np.min([need(x[a : a + step], numbers[a : a + step], key[1]) for a in range(0, len(x), step)], axis=0)
        return _batch([[v] for v in (*key, numbers.tobytes(), np.array(ids, np.int64).tobytes(), x.tobytes(), least.tolist())], ASKED)

    def run(batches):
        key, held = None, ([], [], [])
        for b in batches:
            for g, d, *own in zip(*(b.column(c).to_pylist() for c in ("g", "dim", "row", "vec_id", "q")), strict=True):
                if (g, d) != key:
                    if key:
                        yield told(key, *held)
                    key, held = (g, d), ([], [], [])
                for x, v in zip(held, own, strict=True):
                    x.append(v)
        if key:
            yield told(key, *held)

    return run


def _solved(k: int):
    """Queries of a group and slice come first, then its rows, of which the best k are kept for each query."""

    def run(batches):
        key, own, lists = None, None, None

        def told():
            if lists is None:
                return None
            hit = np.nonzero(lists[0] > LOW)
            return _batch([pa.array(own[0][hit[0]]), pa.array(own[1][hit[0]]), pa.array(lists[1][hit]), pa.array(lists[0][hit])], FOUND)

        for b in batches:
            keys = np.stack([b.column(c).to_numpy() for c in ("g", "slice", "dim", "kind")], 1)
            cuts = np.append(np.nonzero(np.append(True, (keys[1:] != keys[:-1]).any(1)))[0], len(keys))[: len(keys) + 1]
            qs, rows, ids = b.column("q").to_pylist(), b.column("row").to_numpy(), b.column("vec_id").to_numpy()
            for a, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                *now, kind = keys[a].tolist()
                dim = now[2]
                if now != key:
                    if (t := told()) is not None:
                        yield t
                    key, own, lists = now, None, None
                if kind == 0:  # one row holds all the queries of a group
                    size, rest = np.frombuffer(qs[a][:8], "<i8")[0], qs[a][8:]
                    own = [np.frombuffer(rest[8 * size * j : 8 * size * (j + 1)], "<i8") for j in (0, 1)] + [np.frombuffer(rest[16 * size :], "<f8").reshape(size, dim)]
                    continue
                scores = products(own[2], _matrix(qs[a:e], dim))
                scores[rows[a:e][None, :] == own[0][:, None]] = LOW
                new = best(scores, ids[a:e], k)
                lists = new if lists is None else merged(np.concatenate((lists[0], new[0]), 1), np.concatenate((lists[1], new[1]), 1), k)
        if (t := told()) is not None:
            yield t

    return run


FOUND = "query_row long, query_id long, vec_id long, score long"


def dealt_rows(data: DataFrame, queries: DataFrame, k: int = K, pivots: int | None = None) -> DataFrame | None:
    """SENT: the queries of each group and slice (kind 0) and the rows that one of them may need (kind 1); None without rows or queries."""
    spark = data.sparkSession
    n, widest = data.agg(F.count("*"), F.max("dim")).first()
    total = queries.count()
    if not n or not total:
        return None
    most = max(1, PIVOT_BYTES // (8 * (k + 2) * max(1, widest)))
    chosen = data.filter(F.octet_length("q") == 4 * F.col("dim")).orderBy(F.xxhash64("row"), "row").limit(min(most, pivots or int(np.ceil(n**0.5))))
    cells = Cells([(r.dim, r.q) for r in chosen.select("dim", "q").collect()])

    def placed(batches):
        for b in batches:
            cell, dist = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows)
            for _, at, x in _by_dim(b):
                cell[at], dist[at] = cells.assign(x)
            yield pa.record_batch([*(b.column(c) for c in ("row", "vec_id", "dim", "q")), pa.array(cell), pa.array(dist)], names=["row", "vec_id", "dim", "q", "cell", "dist"])

    rows, asked = (save(d.select("row", "vec_id", "dim", "q").mapInArrow(placed, PLACED), t) for d, t in ((data, "cells"), (queries, "queries")))
    summary = _summaries(rows, k)

    # Queries in the order of their cells, cut into groups. A row a cell: at most as many as pivots and dimensions.
    counts = {(r.dim, r.cell): r["count"] for r in asked.groupBy("dim", "cell").count().collect()}
    before, starts = 0, []
    for (dim, cell), count in sorted(counts.items()):
        starts.append((dim, cell, before, count))
        before += count
    starts = spark.createDataFrame(starts, "dim int, cell int, before long, count long")
    groups = -(-total // GROUP_QUERIES)
    share = F.pmod(F.xxhash64("row"), F.lit(1 << 20)) / (1 << 20)
    group = F.floor((F.col("before") + share * F.col("count")) * groups / total).cast("int")
    grouped = asked.join(F.broadcast(starts), ["dim", "cell"]).select(group.alias("g"), "row", "vec_id", "dim", "q")
    grouped = grouped.repartition(partitions(spark), "g", "dim").sortWithinPartitions("g", "dim", "row")
    blocks = save(grouped.mapInArrow(_needs(cells, summary, k), ASKED), "blocks")

    sizes = rows.groupBy("dim", "cell").agg(F.count("*").alias("count"), F.max("dist").alias("far"))
    sizes = F.broadcast(save(sizes.withColumn("parts", F.ceil(F.col("count") / CELL_ROWS).cast("int")), "sizes"))
    asks = blocks.select("g", "dim", F.posexplode("need").alias("cell", "need")).join(sizes, ["dim", "cell"]).filter("need <= far")
    asks = save(asks.select("g", "dim", "cell", "need", "count", "parts"), "asks")
    slices = asks.groupBy("g", "dim").agg(F.ceil(F.sum("count") / SLICE_ROWS).cast("int").alias("slices"))
    slices = slices.withColumn("slices", F.greatest("slices", F.lit(-(-partitions(spark) // groups))))
    asks = asks.join(slices, ["g", "dim"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("g", "dim", "cell", "part", "need", "slices")
    parted = rows.join(sizes, ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    sent = parted.join(asks, ["dim", "cell", "part"]).filter("dist >= need")
    slice_of = F.pmod(F.xxhash64("row", F.lit(1)), F.col("slices")).cast("int").alias("slice")
    sent = sent.select("g", slice_of, "dim", F.lit(1).alias("kind"), "row", "vec_id", "q")

    def packed(batches):
        for b in batches:
            some = [(len(r) // 8).to_bytes(8, "little") + r + i + x for r, i, x in zip(*(b.column(c).to_pylist() for c in ("rows", "ids", "xs")), strict=True)]
            yield pa.record_batch([b.column("g"), b.column("dim"), pa.array(some, pa.binary())], names=["g", "dim", "q"])

    zero = F.lit(0)
    whole = blocks.mapInArrow(packed, "g int, dim int, q binary").join(slices, ["g", "dim"])
    whole = whole.select("g", F.explode(F.sequence(zero, F.col("slices") - 1)).alias("slice"), "dim", zero.alias("kind"), zero.cast("long").alias("row"), zero.cast("long").alias("vec_id"), "q")
    return sent.unionByName(whole)


def topk_join(data: DataFrame, queries: DataFrame, k: int = K, pivots: int | None = None) -> DataFrame:
    """data, queries: saved rows as from `quantized`, queries being some of data. query_id, rank, vec_id, score of each query's k best rows."""
    spark = data.sparkSession
    dealt = dealt_rows(data, queries, k, pivots)
    if dealt is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = dealt.repartition(partitions(spark), "g", "slice", "dim").sortWithinPartitions("g", "slice", "dim", "kind").mapInArrow(_solved(k), FOUND)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = save(quantized(table(spark, sf_dir, "embeddings")), "vectors")
    return topk_join(data, data.filter(F.col("vec_id") % EVERY == 0))


OP1_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS n, CAST(vec_id AS BIGINT) AS vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS HUGEINT) FOR x IN embedding] AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(256 * CAST(x AS DOUBLE))]) = 0),
p AS (
  SELECT a.n, a.vec_id AS query_id, b.vec_id AS vec_id,
    CAST(greatest(least(coalesce(list_sum([a.q[i] * b.q[i] FOR i IN range(1, len(a.q) + 1)]), 0), 9223372036854775807), -9223372036854775807) AS BIGINT) AS score
  FROM v a JOIN v b ON a.n <> b.n AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
