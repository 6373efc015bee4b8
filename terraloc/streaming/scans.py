"""Rings and thinning of points while they arrive, with what a frame needs of its past as state between batches.

A frame's state is a few numbers: the next point, the last one's side and ring, and the last point that stayed. Points
that come before their predecessors are held until those are there, so rows don't depend on where the stream is cut or
in which order its parts come. Once the watermark has passed the frame's newest point by `keep`, what is still held is
numbered over the gaps, and the state goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from terraloc.operators.features import thin

ROWS = "frame_id long, pt long, ring int, kept int"
POINT = ("pt", "x", "y", "z")
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
SHUFFLE = "spark.sql.shuffle.partitions"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


HELD = np.dtype([("pt", "<i8"), ("x", "<f8"), ("y", "<f8"), ("z", "<f8")])
#: Tasks, each with a state store, that a query's frames are dealt to for each core.
STORES = 1


def _packed(points: pd.DataFrame) -> bytes | None:
    return points[list(POINT)].to_records(index=False).astype(HELD).tobytes() if len(points) else None


def _read(state: tuple | None) -> tuple[tuple | None, int | None, pd.DataFrame]:
    """A frame's past, the time that it is over at, and the points that it holds."""
    if state is None:
        return None, None, pd.DataFrame(np.zeros(0, HELD))
    past = None if state[0] is None else tuple(state[:6])
    return past, state[6], pd.DataFrame(np.frombuffer(state[7] or b"", HELD))


class FrameScan(StatefulProcessor):
    """One frame's points, batch by batch; first: the number of a frame's first point."""

    def __init__(self, least: float, keep: int, first: int):
        self.least, self.keep, self.first = least, keep, first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # One value for all: each read and write of a state is a call to the JVM.
        self.state = handle.getValueState("state", "next long, ring int, up int, x double, y double, z double, due long, held binary")

    def _judged(self, frame: int, points: pd.DataFrame, past: tuple | None) -> tuple[pd.DataFrame, tuple]:
        """ROWS of points that follow the frame's past (next point, ring, side, and last point that stayed), and its past after them."""
        xyz = points[["x", "y", "z"]].to_numpy(float)
        known = ~np.isnan(xyz[:, :2]).any(1)
        up = known & (np.arctan2(xyz[:, 1], xyz[:, 0]) > 0)
        ring = (past[1] if past else -1) + np.cumsum(up & ~np.concatenate([[bool(past and past[2])], up[:-1]]))
        kept = thin(xyz, self.least) if past is None else thin(np.vstack([past[3:], xyz]), self.least)[1:]
        last = xyz[np.flatnonzero(kept)[-1]] if kept.any() else past[3:]
        now = (int(points.pt.iloc[-1]) + 1, int(ring[-1]), int(up[-1]), *map(float, last))
        return pd.DataFrame({"frame_id": frame, "pt": points.pt.to_numpy(), "ring": ring.astype("int32"), "kept": kept.astype("int32")}), now

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new, state = pd.concat(list(rows)), self.state.get()
        past, was, early = _read(state)
        due = max(int(new.ms.max()) + self.keep, was or 0)
        if was is None:
            self.handle.registerTimer(due)
        at = past[0] if past else self.first
        all_ = pd.concat([early, new[list(POINT)]]) if len(early) else new[list(POINT)]
        all_ = all_[all_.pt >= at].sort_values(list(POINT)).drop_duplicates("pt")
        ready = int((all_.pt.to_numpy() == at + np.arange(len(all_))).sum())  # ascending numbers once off stay off
        out = None
        if ready:
            out, past = self._judged(key[0], all_.iloc[:ready], past)
        self.state.update((*(past or [None] * 6), due, _packed(all_.iloc[ready:])))
        if out is not None:
            yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        past, due, early = _read(self.state.get())
        if due is not None and due > expiredTimerInfo.getExpiryTimeInMs():  # points came since it was set
            if due > timerValues.getCurrentWatermarkInMs():
                self.handle.registerTimer(due)
                return
        if len(early):
            yield self._judged(key[0], early, past)[0]
        self.state.clear()

    def close(self) -> None:
        pass


def scanned(points: DataFrame, least: float = 2.0, late: str = "10 minutes", keep: str = "10 minutes", first: int = 1) -> DataFrame:
    """frame_id, pt, ring, kept of a stream of frame_id, pt, x, y, z and the event time ts.

    ring as `ring_runs` has it; kept is 1 for points that `thinned` keeps, else 0. A frame's points are numbered from
    `first` on. Rows that come over `late` behind the newest ts don't count, nor do those without frame_id, pt or ts. Of
    points with one number the first to come counts, in one batch the smallest by x, y and z. A missing x or y has no
    side. Other columns aren't read. The stream needs Spark's RocksDB state store, which `follow` sets.
    """
    known = points.filter("frame_id is not null and pt is not null and ts is not null").withWatermark("ts", late)
    cut = known.select(F.col("frame_id").cast("long").alias("frame_id"), F.col("pt").cast("long").alias("pt"), *(F.col(c).cast("double").alias(c) for c in "xyz"), "ts", F.unix_millis("ts").alias("ms"))
    span = int(pd.Timedelta(keep).total_seconds() * 1000)
    return cut.groupBy("frame_id").transformWithStateInPandas(FrameScan(least, span, first), ROWS, "Append", "EventTime")


def follow(points: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, **options) -> StreamingQuery:
    """Starts a query that writes the `scanned` rows of a stream as Parquet, each once; options as of `scanned`, trigger as of DataStreamWriter.trigger, availableNow by default."""
    spark = points.sparkSession
    stores = min(int(spark.conf.get(SHUFFLE)), STORES * spark.sparkContext.defaultParallelism)
    # A query keeps the settings that it starts with. Each store is opened and committed in each batch, however few frames it has.
    given = {PROVIDER: ROCKS, SHUFFLE: str(stores)}
    was = {k: spark.conf.get(k, None) for k in given}
    for k, v in given.items():
        spark.conf.set(k, v)
    try:
        out = scanned(points, **options).writeStream.format("parquet").outputMode("append")
        return out.option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    finally:
        for k, v in was.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
