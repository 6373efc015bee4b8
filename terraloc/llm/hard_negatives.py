"""Hard negatives by blocked dense products of anchors and candidates.

Anchors are dealt by a hash to blocks of about ANCHOR_BYTES; a block is broadcast, and every task multiplies its
candidates with it, TILE anchors at a time. In the first pass a task keeps each anchor's best positives, rows of the
same label, so only rows of one label are multiplied; the tasks' lists are merged. In the second pass each positive
opens a window of scores, and a task keeps the best rows of other labels within each window; these are merged too.

Bounded: the driver and each task hold one block of anchors with its positives (ANCHOR_BYTES and a list of `positives`
for each anchor); candidates stream by Arrow batches; a task sends at most `positives` x `negatives` rows an anchor.
Candidates are read twice for each block and never shuffled. Products are exact, as those of the kNN join: in doubles
while sums stay under 2^53, in 64-bit integers while they fit, else in whole numbers of any length.

Defined cases: rows with a null vec_id, label or vector, or a null or non-finite component (or one whose 256-fold isn't
a finite double), take no part; a row is a partner of every anchor but itself, so rows with one vec_id count each for
itself, and each of them that is an anchor has its own lists; ties of score go to smaller vec_ids, and equal vec_ids keep
any order, as their rows of the result are equal; scores beyond a long are the nearest long, and tie; vectors of
different lengths aren't compared; empty vectors have score 0 with one another; an anchor without positives, or a
positive whose window is empty, has no rows; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terraloc.llm.common import new_path, save, table
from terraloc.llm.knn import LOW, _by_dim, _quantized, best, merged, products

ANCHOR_BYTES = 32 << 20
TILE = 512
POSITIVES = 5
NEGATIVES = 10
EVERY = 100
#: A negative's score lies between these hundredths of the positive's.
WINDOW = (30, 90)
FOUND = "at int, slot int, vec_id long, score long"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def labelled(vectors: DataFrame, label: Column) -> DataFrame:
    """row, vec_id, label, dim, q: rows that take part. Rows are numbered, so the result is to be saved before it is used twice."""
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    own = own.filter("vec_id is not null and label is not null").select(F.struct("vec_id", "label").alias("own"), "embedding")
    out = own.mapInArrow(_named, "own struct<vec_id:long,label:long>, dim int, q binary")
    return out.select(F.monotonically_increasing_id().alias("row"), "own.*", "dim", "q")


def _named(batches):
    for b in _quantized(batches):
        yield b.rename_columns(["own", "dim", "q"])


class Anchors:
    """A block of anchors by dimension, in tiles: places in the block, rows, labels and matrices."""

    def __init__(self, block: pa.Table):
        self.tiles: dict[int, list] = {}
        self.size = at = 0
        for b in block.combine_chunks().to_batches():
            rows, labels = b.column("row").to_numpy(), b.column("label").to_numpy()
            for dim, own, x in _by_dim(b):
                order = np.argsort(labels[own], kind="stable")  # a tile has few labels
                for i in range(0, len(own), TILE):
                    cut = order[i : i + TILE]
                    self.tiles.setdefault(dim, []).append((at + own[cut], rows[own[cut]], labels[own[cut]], x[cut]))
            at += b.num_rows
        self.size = at


class Best:
    """The k best scores and their vec_ids of each anchor and slot of a block."""

    def __init__(self, size: int, k: int):
        self.k, self.scores, self.ids = k, np.full((size, k), LOW), np.zeros((size, k), np.int64)

    def add(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """at: places; a row of scores for each, LOW where there is none."""
        if not scores.shape[1]:
            return
        over = scores.max(1)
        hit = np.nonzero((over > LOW) & (over >= self.scores[at, -1]))[0]
        if len(hit):
            new, named = best(scores[hit], ids, self.k)
            own = at[hit]
            self.scores[own], self.ids[own] = merged(np.hstack((self.scores[own], new)), np.hstack((self.ids[own], named)), self.k)

    def batch(self, slots: int) -> pa.RecordBatch:
        place, rank = np.nonzero(self.scores > LOW)
        cols = (place // slots).astype(np.int32), (place % slots).astype(np.int32), self.ids[place, rank], self.scores[place, rank]
        return pa.record_batch(list(map(pa.array, cols)), names=["at", "slot", "vec_id", "score"])


def _positives(anchors, k: int):
    def run(batches):
        block = anchors.value
        kept = Best(block.size, k)
        for b in batches:
            ids, rows, labels = (b.column(c).to_numpy() for c in ("vec_id", "row", "label"))
            for dim, own, x in _by_dim(b):
                for place, arows, alabels, ax in block.tiles.get(dim, ()):
                    for label in np.intersect1d(alabels, labels[own]).tolist():
                        left, right = np.nonzero(alabels == label)[0], np.nonzero(labels[own] == label)[0]
                        s = products(ax[left], x[right])
                        s[arows[left][:, None] == rows[own[right]][None, :]] = LOW
                        kept.add(place[left], s, ids[own[right]])
        yield kept.batch(1)

    return run


def _negatives(anchors, windows, k: int):
    def run(batches):
        block, (low, high) = anchors.value, windows.value
        slots = low.shape[1]
        kept = Best(block.size * slots, k)
        for b in batches:
            ids, labels = b.column("vec_id").to_numpy(), b.column("label").to_numpy()
            for dim, own, x in _by_dim(b):
                for place, _, alabels, ax in block.tiles.get(dim, ()):
                    s = products(ax, x)
                    s[alabels[:, None] == labels[own][None, :]] = LOW
                    for slot in range(slots):
                        lo, hi = low[place, slot][:, None], high[place, slot][:, None]
                        kept.add(place * slots + slot, np.where((s >= lo) & (s <= hi), s, LOW), ids[own])
        yield kept.batch(slots)

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("at", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def score_windows(scores: np.ndarray, window: tuple[int, int] = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest whole n with window[0] * p <= 100 * n <= window[1] * p for each score p; without overflow, as p is cut into hundreds and a rest."""
    hundreds, rest = scores // 100, scores % 100
    return window[0] * hundreds - (-window[0] * rest) // 100, window[1] * hundreds + window[1] * rest // 100


def mine(data: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW, block_bytes: int = ANCHOR_BYTES) -> DataFrame:
    """data: saved rows as from `labelled`; anchors: some of them. For each anchor and each of its best positives the best rows of other labels in the window of its score."""
    spark = data.sparkSession
    total = anchors.agg(F.sum(F.lit(64) + 8 * F.col("dim"))).first()[0] or 0
    blocks = -(-total // block_bytes)
    path = new_path(spark, "negatives")
    for i in range(blocks):
        # A block's share of the anchors: of about block_bytes, whatever their number.
        block = anchors.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == i).select("row", "vec_id", "label", "dim", "q").toArrow()
        if not block.num_rows:
            continue
        held = spark.sparkContext.broadcast(Anchors(block))
        first = _ranked(data.mapInArrow(_positives(held, positives), FOUND), positives).select("at", "rank", "vec_id", "score").toArrow()
        at, rank, pids, pscores = (first.column(c).to_numpy() for c in ("at", "rank", "vec_id", "score"))
        low, high = np.ones((held.value.size, positives), np.int64), np.zeros((held.value.size, positives), np.int64)
        low[at, rank - 1], high[at, rank - 1] = score_windows(pscores, window)
        slots = spark.sparkContext.broadcast((low, high))
        found = _ranked(data.mapInArrow(_negatives(held, slots, negatives), FOUND), negatives)
        named = pa.table([at, (rank - 1).astype(np.int32), block.column("vec_id").to_numpy()[at], pids, pscores], names=["at", "slot", "anchor_id", "positive_id", "positive_score"])
        out = found.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"}).join(spark.createDataFrame(named), ["at", "slot"])
        out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").write.mode("append").parquet(path)
        held.destroy()
        slots.destroy()
    return spark.read.schema(RESULT).parquet(path) if blocks else spark.createDataFrame([], RESULT)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    data = save(labelled(table(spark, sf_dir, "embeddings"), label), "labelled")
    return mine(data, data.filter(F.col("vec_id") % EVERY == 0))


OP12_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS n, CAST(vec_id AS BIGINT) AS vec_id,
    CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
    [CAST(floor(256 * CAST(x AS DOUBLE)) AS HUGEINT) FOR x IN embedding] AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(256 * CAST(x AS DOUBLE))]) = 0),
s AS (
  SELECT a.n, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike,
    CAST(greatest(least(coalesce(list_sum([a.q[i] * b.q[i] FOR i IN range(1, len(a.q) + 1)]), 0), 9223372036854775807), -9223372036854775807) AS HUGEINT) AS score
  FROM v a JOIN v b ON a.n <> b.n AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS place FROM s WHERE alike),
w AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.n, p.place ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.n = p.n AND NOT s.alike AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
  WHERE p.place <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, CAST(positive_score AS BIGINT) AS positive_score, CAST(negative_score AS BIGINT) AS negative_score
FROM w WHERE rank <= 10
"""
