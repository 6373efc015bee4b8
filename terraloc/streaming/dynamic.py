"""A kNN index that takes inserts and deletes batch by batch: segments of doubling size, and tombstones.

An inserted batch is a segment of balls, as `retrieval` searches them. Two segments of one level (about BASE rows times
a power of two) are merged into one of the next, so an entry is rewritten once a level. A delete writes the ids as
tombstones for all segments up to the newest; searches leave these rows out, and a merge drops them. What is in force
stands in a manifest of some lines, and a new one is named only once all that it lists is written; a batch that is tried
again after that changes nothing.

Inserting an id that is there replaces its entry. Of one batch deletes come first; of several keys of one id in a batch
the largest is taken. Rows without an id or with a null in their key aren't inserted.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from terraloc.operators import retrieval

#: Rows of a segment of the first level.
BASE = 4096
BALL = "side int, ids binary, ks binary, n long, mid binary, far1 double, far2 double, block string"


def rows_of(balls: DataFrame) -> DataFrame:
    """frame_id, k of the rows that balls hold."""

    def run(batches):
        for b in batches:
            for ids, ks in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = np.frombuffer(ids, "<i8")
                k = np.frombuffer(ks, "<f8")
                wide = pa.ListArray.from_arrays(np.arange(len(own) + 1, dtype=np.int32) * (len(k) // len(own)), pa.array(k))
                yield pa.record_batch([pa.array(own), wide], names=["frame_id", "k"])

    return balls.select("ids", "ks").mapInArrow(run, "frame_id long, k array<double>")


def _living(balls: DataFrame, dead: DataFrame) -> DataFrame:
    """Balls without the rows whose ids are in `dead`; centres and radii hold for what is left."""

    def named(batches):
        for b in batches:
            for block, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = np.frombuffer(ids, "<i8")
                yield pa.record_batch([pa.array([block] * len(own), pa.string()), pa.array(own)], names=["block", "frame_id"])

    def run(batches):
        for b in batches:
            ids, ks, n = [], [], []
            for i, k, gone in zip(*(b.column(c).to_pylist() for c in ("ids", "ks", "gone")), strict=True):
                own = np.frombuffer(i, "<i8")
                stay = ~np.isin(own, gone or [])
                ids.append(own[stay].tobytes())
                ks.append(np.frombuffer(k, "<f8").reshape(len(own), -1)[stay].tobytes())
                n.append(int(stay.sum()))
            cols = [b.column("side"), pa.array(ids, pa.binary()), pa.array(ks, pa.binary()), pa.array(n, pa.int64()), *(b.column(c) for c in ("mid", "far1", "far2", "block"))]
            yield pa.record_batch(cols, names=["side", "ids", "ks", "n", "mid", "far1", "far2", "block"]).filter(pa.array(np.array(n) > 0))

    held = balls.select("block", "ids").mapInArrow(named, "block string, frame_id long").join(dead.select("frame_id").distinct(), "frame_id")
    gone = held.groupBy("block").agg(F.collect_set("frame_id").alias("gone"))  # at most a ball's rows
    return balls.join(gone, "block", "left").select("side", "ids", "ks", "n", "mid", "far1", "far2", "block", "gone").mapInArrow(run, BALL)


class DynamicIndex:
    """The index under `path`, a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, base: int = BASE):
        self.spark, self.path, self.base = spark, path.rstrip("/"), base
        jvm = spark.sparkContext._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def manifest(self) -> dict:
        """The newest one: segments (serial, level, folder), tombstones (upto, folder), and the last batch."""
        folder = self._at(f"{self.path}/manifest")
        names = [int(f.getPath().getName()) for f in self._fs.listStatus(folder) if f.getPath().getName().isdigit()] if self._fs.exists(folder) else []
        if not names:
            return {"version": 0, "serial": 0, "batch": -1, "segments": [], "tombstones": []}
        text = self.spark.read.text(f"{self.path}/manifest/{max(names)}", wholetext=True).first()[0]
        return json.loads(text)

    def _commit(self, m: dict) -> None:
        m["version"] += 1
        hidden = self._at(f"{self.path}/manifest/_{uuid.uuid4().hex}")
        out = self._fs.create(hidden)
        out.write(bytearray(json.dumps(m).encode()))
        out.close()
        if not self._fs.rename(hidden, self._at(f"{self.path}/manifest/{m['version']}")):
            raise RuntimeError(f"version {m['version']} was written by another")

    def _write(self, df: DataFrame, kind: str) -> str:
        name = f"{kind}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        return name

    def _dead(self, m: dict, serial: int) -> DataFrame | None:
        own = [f"{self.path}/{t['folder']}" for t in m["tombstones"] if t["upto"] >= serial]
        return self.spark.read.schema("frame_id long").parquet(*own) if own else None

    def _segment(self, m: dict, s: dict) -> DataFrame:
        balls, dead = self.spark.read.schema(BALL).parquet(f"{self.path}/{s['folder']}"), self._dead(m, s["serial"])
        return balls if dead is None else _living(balls, dead)

    def _add(self, m: dict, rows: DataFrame) -> None:
        folder = self._write(retrieval._blocks(rows).drop("call"), "segment")
        n = self.spark.read.schema(BALL).parquet(f"{self.path}/{folder}").agg(F.sum("n")).first()[0] or 0
        m["serial"] += 1
        if n:
            m["segments"].append({"serial": m["serial"], "level": (int(n) // self.base).bit_length(), "folder": folder})

    def apply(self, batch: DataFrame, number: int | None = None) -> None:
        """batch: op ("insert" or "delete"), frame_id, k. A batch with a number that was applied before is left out."""
        m = self.manifest()
        if number is not None and number <= m["batch"]:
            return
        batch = batch.filter("frame_id is not null")
        new = batch.filter(F.col("op") == "insert").filter(F.col("k").isNotNull() & ~F.exists("k", F.isnull)).groupBy(F.col("frame_id").cast("long").alias("frame_id")).agg(F.max(F.col("k").cast("array<double>")).alias("k"))
        gone = batch.filter(F.col("op") == "delete").select(F.col("frame_id").cast("long").alias("frame_id")).union(new.select("frame_id")).distinct()
        if m["segments"]:
            m["tombstones"].append({"upto": m["serial"], "folder": self._write(gone, "tombstones")})
        self._add(m, new)
        while True:
            levels = [s["level"] for s in m["segments"]]
            twice = [v for v in levels if levels.count(v) > 1]
            if not twice:
                break
            pair = [s for s in m["segments"] if s["level"] == min(twice)][:2]
            both = rows_of(self._segment(m, pair[0]).unionByName(self._segment(m, pair[1])))
            m["segments"] = [s for s in m["segments"] if s not in pair]
            self._add(m, both)
        oldest = min((s["serial"] for s in m["segments"]), default=m["serial"] + 1)
        m["tombstones"] = [t for t in m["tombstones"] if t["upto"] >= oldest]
        m["batch"] = m["batch"] if number is None else number
        self._commit(m)

    def entries(self) -> DataFrame:
        """The balls in force."""
        m = self.manifest()
        out = self.spark.createDataFrame([], BALL)
        for s in m["segments"]:  # as many as levels
            out = out.unionByName(self._segment(m, s))
        return out

    def search(self, queries: DataFrame, k: int = 10, metric: str = "l2", without_own: bool = False) -> DataFrame:
        """q, c, d, rk as `retrieval.knn` has it, among the entries in force."""
        return retrieval.knn_of_index(queries, self.entries(), k, metric, without_own)

    def follow(self, changes: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Starts a query that applies a stream of changes (op, frame_id, k), batch by batch."""
        return changes.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
