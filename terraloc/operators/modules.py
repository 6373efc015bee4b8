"""Place recognition methods by name: describe frames, index their keys, search.

A module makes descriptors (frame_id and its columns), keys (frame_id, k) and distances of candidate pairs. Its index
is a table of descriptors, so `join` is a union and an index is saved and loaded as Parquet.
"""

from __future__ import annotations

import math
from abc import ABC, abstractmethod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloc.operators import codes, descriptors, images, retrieval

PREFIX = "search."
#: Images whose keys are computed at once.
KEYED = 64
#: An index of fewer entries has no match for any query.
LEAST_ENTRIES = 10


class DescriptorModule(ABC):
    """options: defaults by name; others are refused. Keys may carry the prefix `search.`."""

    name: str
    options: dict[str, float] = {}

    def __init__(self, **options):
        self.set = dict(self.options)
        for key, value in options.items():
            self.config(key, value)

    def config(self, key: str, value) -> None:
        key = key.removeprefix(PREFIX)
        if key not in self.set:
            raise KeyError(f"{self.name} has no option {key}; it has {sorted(self.set)}")
        self.set[key] = type(self.set[key])(value)

    @abstractmethod
    def describe(self, points: DataFrame) -> DataFrame:
        """frame_id and descriptor columns from frame_id, x, y, z, intensity."""

    @abstractmethod
    def keys(self, described: DataFrame) -> DataFrame:
        """frame_id, k."""

    @abstractmethod
    def distances(self, pairs: DataFrame, described: DataFrame) -> DataFrame:
        """q, c, dist, shift of pairs q, c."""

    def nearest(self, pairs: DataFrame, described: DataFrame, n: int) -> DataFrame:
        """distances, of which those of each query's n nearest are needed only."""
        return self.distances(pairs, described)

    #: Columns of a full turn, columns after which images repeat, and whether shifts turn the candidate (1) or the query (-1).
    turn, period, sense = descriptors.SECTORS, descriptors.SECTORS, 1

    def yaw(self):
        """Radians that a query is turned by, against its candidate."""
        return F.radians(F.pmod(self.sense * F.col("shift"), F.lit(self.period)) * (360.0 / self.turn)).alias("yaw")

    def join(self, index: DataFrame | None, described: DataFrame) -> DataFrame:
        return described if index is None else index.unionByName(described)

    def save(self, described: DataFrame, path: str) -> None:
        described.write.mode("overwrite").parquet(path)

    def load(self, spark: SparkSession, path: str) -> DataFrame:
        return spark.read.parquet(path)

    def search(self, queries: DataFrame, index: DataFrame, n: int) -> DataFrame:
        """q, c, dist, yaw (radians), rk: the n best of each query's nearest keys, 10 of them, or 2n from n = 5 on; more if num_candidates is more."""
        k = max(int(self.set.get("num_candidates", 0)), 10 if n < 5 else 2 * n)
        near = retrieval.knn(self.keys(queries), self.keys(index), k)
        # Queries may bear ids of the index: sides are told apart by sign until the end.
        both = queries.withColumn("frame_id", -1 - F.col("frame_id")).unionByName(index)
        pairs = near.select((-1 - F.col("q")).alias("q"), "c")
        scored = self.nearest(pairs, both, n).filter("dist is not null and not isnan(dist)")
        best = retrieval.top(scored, n)
        return best.select((-1 - F.col("q")).alias("q"), "c", "dist", self.yaw(), "rk")


    def match(self, queries: DataFrame, index: DataFrame, least: int = LEAST_ENTRIES) -> DataFrame:
        """The best of each query, as search has it; none of any query while the index has fewer than `least` entries."""
        enough = index.agg((F.count("*") >= least).alias("enough")).filter("enough")
        return self.search(queries, index, 1).crossJoin(F.broadcast(enough)).drop("enough")


class ScanContext(DescriptorModule):
    """num_ring x num_sector matrices; frames without a point in reach have no descriptor. Ids of frames are 0 or more."""

    name = "scancontext"
    options = {"lidar_height": 2.0, "num_ring": descriptors.RINGS, "num_sector": descriptors.SECTORS, "max_radius": 80.0, "num_candidates": 10, "ratio": 0.1}

    def config(self, key, value):
        super().config(key, value)
        if min(self.set["num_ring"], self.set["num_sector"]) < 1:
            raise ValueError(f"{self.name} needs a ring and a sector at least")
        self.turn = self.period = self.set["num_sector"]

    @property
    def size(self) -> tuple[int, int]:
        return self.set["num_ring"], self.set["num_sector"]

    def polar(self, points: DataFrame) -> DataFrame:
        return descriptors.polar(points, self.set["max_radius"], *self.size).groupBy("frame_id", "ring", "sector")

    def cells(self, points: DataFrame) -> DataFrame:
        return self.polar(points).agg((F.max("z") + self.set["lidar_height"]).alias("v"))

    def describe(self, points):
        return descriptors.matrices(self.cells(points), *self.size)

    def keys(self, described):
        return described.select("frame_id", "k")

    def distances(self, pairs, described):
        around = math.floor(0.5 * self.set["ratio"] * self.set["num_sector"] + 0.5)
        return retrieval.rerank(pairs, described.select("frame_id", "m"), around, *self.size)


class IntensityScanContext(ScanContext):
    name = "isc"

    def cells(self, points):
        return self.polar(points).agg(F.max("intensity").alias("v"))


class Mercator(ScanContext):
    name = "mercator"

    def cells(self, points):
        return descriptors.mean_height(points, reach=self.set["max_radius"], lift=self.set["lidar_height"], rings=self.set["num_ring"], sectors=self.set["num_sector"])


class Mdfsc(DescriptorModule):
    """Codes of the 80 x 360 image of heights, found by row sums."""

    name = "mdfsc"
    turn, period, sense = 360, 360, -1
    bits = 2 * codes.SCALES * 80

    def image(self, points: DataFrame) -> DataFrame:
        return descriptors.nonuniform_max(points)

    def describe(self, points):
        cells = self.image(points)
        keys = cells.groupBy("frame_id").agg(F.array(*(F.sum(F.when(F.col("r") == r, F.col("v")).otherwise(0)).cast("double") for r in range(80))).alias("k"))
        return codes.encode_cells(cells, 80, 360).join(keys, "frame_id")

    def keys(self, described):
        return described.select("frame_id", "k")

    def search(self, queries, index, n):
        return super().search(*map(retrieval.kept, (queries, index)), n)

    def distances(self, pairs, described):
        return codes.compare_codes(pairs, described.select("frame_id", "t", "m"), self.bits, 360, shift="spectral")

    def nearest(self, pairs, described, n):
        return codes.nearest_of_pairs(pairs, described.select("frame_id", "t", "m"), self.bits, 360, n, shift="spectral")


class Iris(Mdfsc):
    """As Mdfsc, with bit sets of heights, and all frames of the index as candidates."""

    #: Tasks that the codes of a side are dealt to; under 1: as many as Spark's default parallelism.
    name, options = "iris", {"threads": 0}

    def image(self, points):
        return descriptors.bit_set(points)

    def search(self, queries, index, n):
        """Each query against all of the index, as is the method; those whose rows' numbers of bits rule them out aren't aligned."""
        queries, index = (retrieval.kept(x.select("frame_id", "t", "m")) for x in (queries, index))
        parts = self.set["threads"] if self.set["threads"] > 0 else queries.sparkSession.sparkContext.defaultParallelism
        scored = codes.nearest_codes(queries, index, self.bits, 360, n, parts).filter("not isnan(dist)")
        return retrieval.top(scored, n).select("q", "c", "dist", self.yaw(), "rk")


class Fresco(DescriptorModule):
    """Spectral images, which repeat after half a turn: 60 of 120 columns are tried."""

    name = "fresco"
    turn, period, sense = 120, 60, -1

    def describe(self, points):
        return images.spectral_descriptor(descriptors.bev_height(points))

    def keys(self, described):
        def run(batches):
            for b in batches:
                for at in range(0, b.num_rows, KEYED):
                    part = b.slice(at, KEYED)
                    v = part.column(1).flatten().to_numpy().reshape(-1, 20, 120)
                    # Summed from left to right, as the rows' order has it.
                    mean = v.cumsum(2)[..., -1] / 120
                    spread = np.sqrt((((v - mean[..., None]) ** 2) / 20).cumsum(2)[..., -1])
                    total = v.reshape(-1, 2400).cumsum(1)[:, -1:] / 2400
                    yield pa.record_batch([part.column(0), pa.array(list(np.hstack([mean, spread]) / total), pa.list_(pa.float64()))], names=["frame_id", "k"])

        return described.select("frame_id", "v").mapInArrow(run, "frame_id long, k array<double>")

    def distances(self, pairs, described):
        return codes.compare_images(pairs, described, 20, 120, 60)


MODULES: dict[str, type[DescriptorModule]] = {m.name: m for m in (ScanContext, IntensityScanContext, Mercator, Mdfsc, Iris, Fresco)}


def create(name: str, **options) -> DescriptorModule:
    """A module by name; unknown names and options raise KeyError."""
    return MODULES[name](**options)
