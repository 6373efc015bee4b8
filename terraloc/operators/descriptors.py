"""Frame descriptors as grouped aggregations over long-form points: a partial and a final aggregate, one shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloc.functions.geometry import azimuth, ceil_bin, floor_bin, planar_range

REACH, RINGS, SECTORS = 80.0, 20, 60


def polar(points: DataFrame, reach: float = REACH, rings: int = RINGS, sectors: int = SECTORS) -> DataFrame:
    """Points within reach, with ring and sector."""
    x, y = F.col("x"), F.col("y")
    near = points.filter(planar_range(x, y) <= reach)
    return near.withColumn("ring", ceil_bin(planar_range(x, y), reach, rings)).withColumn("sector", ceil_bin(azimuth(x, y), 360.0, sectors))


def height_max(points: DataFrame, lift: float = 2.0) -> DataFrame:
    """frame_id, ring, sector, v: highest z + lift of each cell that has points; others count as 0."""
    return polar(points).groupBy("frame_id", "ring", "sector").agg((F.max("z") + lift).alias("v"))


def intensity_max(points: DataFrame) -> DataFrame:
    return polar(points).groupBy("frame_id", "ring", "sector").agg(F.max("intensity").alias("v"))


def mean_height(points: DataFrame, least: float = 2.0, reach: float = REACH, lift: float = 2.0, rings: int = RINGS, sectors: int = SECTORS) -> DataFrame:
    """Mean z by sector and by ring of elevation; below the horizon is the last ring."""
    r = planar_range(F.col("x"), F.col("y"))
    near = points.filter(r.between(least, reach))
    ring = floor_bin(azimuth(r, F.col("z") + lift) / 45.0 * rings, rings)
    sector = floor_bin(azimuth(F.col("x"), F.col("y")) / 360.0 * sectors, sectors)
    return near.groupBy("frame_id", ring.alias("ring"), sector.alias("sector")).agg(F.avg("z").alias("v"))


def _grid(points: DataFrame) -> DataFrame:
    """80 x 360 cells; what lies beyond belongs to the last ones."""
    x, y = F.col("x"), F.col("y")
    return points.withColumn("r", floor_bin(planar_range(x, y), 80)).withColumn("c", floor_bin(F.degrees(F.atan2(y, x)) + 180.0 + 0.5, 360))


def bit_set(points: DataFrame) -> DataFrame:
    """frame_id, r, c, v: a bit for each metre of height that has points."""
    level = F.greatest(F.least(F.ceil(F.col("z") + 5.0), F.lit(7)), F.lit(0)).cast("int")
    return _grid(points).groupBy("frame_id", "r", "c").agg(F.bit_or(F.expr("1").cast("int") * F.pow(F.lit(2.0), level).cast("int")).alias("v"))


def nonuniform_max(points: DataFrame, inner: int = 19, merged: int = 8) -> DataFrame:
    """frame_id, r, c, v: whole metres of the highest z + 2; up to ring `inner`, columns go by eights, all of which get the value."""
    c = F.when(F.col("r") <= inner, F.floor(F.col("c") / merged) * merged).otherwise(F.col("c")).cast("int")
    cells = _grid(points).groupBy("frame_id", "r", c.alias("c0")).agg(F.greatest(F.floor(F.max("z") + 2.0), F.lit(0)).cast("int").alias("v"))
    own = F.when(F.col("r") <= inner, F.sequence(F.col("c0"), F.col("c0") + merged - 1)).otherwise(F.array("c0"))
    return cells.select("frame_id", "r", F.explode(own).alias("c"), "v")


def ring_key(cells: DataFrame) -> DataFrame:
    """Mean of each ring over all sectors, empty ones as 0."""
    return cells.groupBy("frame_id", "ring").agg((F.sum("v") / SECTORS).alias("k"))


def sector_key(cells: DataFrame) -> DataFrame:
    return cells.groupBy("frame_id", "sector").agg((F.sum("v") / RINGS).alias("k"))


def row_sums(cells: DataFrame) -> DataFrame:
    return cells.groupBy("frame_id", "r").agg(F.sum("v").alias("k"))


def matrices(cells: DataFrame, rings: int = RINGS, sectors: int = SECTORS) -> DataFrame:
    """frame_id, k, m: the `rings` numbers of `ring_key`, and a frame's cells as (place by row, value) in order of place."""
    at = (F.col("ring") * sectors + F.col("sector")).alias("at")
    sums = [F.sum(F.when(F.col("ring") == r, F.col("v")).otherwise(0.0)) / sectors for r in range(rings)]
    return cells.groupBy("frame_id").agg(F.array(*sums).alias("k"), F.sort_array(F.collect_list(F.struct(at, "v"))).alias("m"))


def bev_height(points: DataFrame, half: float = 100.0, cell: float = 2.0) -> DataFrame:
    """frame_id, bx, by, v: bird's-eye cells and the highest z + 2 that isn't under 0."""
    bx, by = (F.floor((F.col(c) + half) / cell + 1.0).cast("int") for c in ("x", "y"))
    cells = points.withColumn("bx", bx).withColumn("by", by).filter("bx BETWEEN 0 AND 100 AND by BETWEEN 0 AND 100")
    return cells.groupBy("frame_id", "bx", "by").agg(F.greatest(F.max("z") + 2.0, F.lit(0.0)).alias("v"))


def ground_grid(points: DataFrame) -> DataFrame:
    """Mean height of 2 m ground cells, 75 x 50, centred; what lies beyond belongs to the last ones."""
    gx, gy = floor_bin((F.col("x") + 75.0) / 2.0, 75), floor_bin((F.col("y") + 50.0) / 2.0, 50)
    return points.groupBy("frame_id", gx.alias("gx"), gy.alias("gy")).agg(F.avg("z").alias("v"))


def voxel_centroids(points: DataFrame, leaf: float) -> DataFrame:
    cells = [F.floor(F.col(c) / leaf).cast("int").alias(f"v{c}") for c in ("x", "y", "z")]
    return points.groupBy("frame_id", *cells).agg(*(F.avg(c).alias(c) for c in ("x", "y", "z")))
