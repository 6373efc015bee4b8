"""Operators over points in scan order, and over poses in time order: windows within a frame or a stretch of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terraloc.functions.geometry import azimuth, planar_range
from terraloc.operators.retrieval import kept


def by_frame():
    return Window.partitionBy("frame_id").orderBy("pt")


def ring_runs(cloud: DataFrame) -> DataFrame:
    """ring: grows where the signed azimuth turns from at most 0 to over 0; starts at 0 or, if the first isn't positive, at -1."""
    up = F.atan2("y", "x") > 0
    turned = F.when(up & ~F.coalesce(F.lag(up).over(by_frame()), ~up), 1).otherwise(0)
    return cloud.withColumn("turn", turned).withColumn("ring", (F.sum("turn").over(by_frame().rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int")).drop("turn")


def depth(cloud: DataFrame) -> DataFrame:
    return cloud.withColumn("r", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")))


def curvature(cloud: DataFrame, reach: int = 5) -> DataFrame:
    """Square of the sum of ranges around a point less its own; null within `reach` of a frame's ends."""
    d = depth(cloud)
    near = by_frame().rowsBetween(-reach, reach)
    total = F.sum("r").over(near) - (2 * reach + 1) * F.col("r")
    return d.withColumn("curvature", F.when(F.count("*").over(near) == 2 * reach + 1, total * total))


def scan_column(x, y, columns: int = 1800):
    """Column of a point's azimuth, counted clockwise from behind; what falls outside is column 0."""
    turns = (F.degrees(F.atan2(x, y)) - 90.0) / (360.0 / columns)
    col = F.lit(columns // 2) - F.when(turns >= 0, F.floor(turns + 0.5)).otherwise(F.ceil(turns - 0.5))
    col = F.when(col >= columns, col - columns).otherwise(col)
    return F.when((col >= 0) & (col < columns), col).otherwise(0).cast("int")


def occlusion(cloud: DataFrame, jump: float = 0.3, beam: float = 0.02, gap: int | None = 10) -> DataFrame:
    """masked: 1 beside a jump of depth (on its far side) between neighbours of under `gap` columns apart (any, if None), or on a surface along the beam."""
    d = depth(cloud)
    ahead, behind = F.lead("r").over(by_frame()), F.lag("r").over(by_frame())
    near = F.lit(True)
    if gap is not None:
        d = d.withColumn("_col", scan_column(F.col("x"), F.col("y")))
        near = F.abs(F.lead("_col").over(by_frame()) - F.col("_col")) < gap
    d = d.withColumn("left", F.when(near & (F.col("r") - ahead > jump), 1).otherwise(0)).withColumn("right", F.when(near & (ahead - F.col("r") > jump), 1).otherwise(0))
    along = (F.abs(behind - F.col("r")) > beam * F.col("r")) & (F.abs(ahead - F.col("r")) > beam * F.col("r"))
    marks = [F.coalesce(F.max("left").over(by_frame().rowsBetween(0, 5)), F.lit(0)), F.coalesce(F.max("right").over(by_frame().rowsBetween(-6, -1)), F.lit(0)), F.when(along, 1).otherwise(0)]
    return d.withColumn("masked", F.greatest(*marks).cast("int")).drop("_col")


def last_written(cloud: DataFrame, columns: int = 360) -> DataFrame:
    """frame_id, ring, col and the last point of each cell of a ring x column grid."""
    x, y = F.col("x"), F.col("y")
    col = F.floor(azimuth(x, y) / (360.0 / columns) + 0.5).cast("int") % columns
    ring = F.least(F.floor(planar_range(x, y) / 2.0), F.lit(63)).cast("int")
    best = F.max_by(F.struct("pt", "x", "y", "z"), F.col("pt")).alias("p")
    return cloud.groupBy("frame_id", ring.alias("ring"), col.alias("col")).agg(best).select("frame_id", "ring", "col", "p.*")


POSE = ("value",)


def interpolate(trace: DataFrame, times: DataFrame, columns: tuple[str, ...] = POSE, clamp: bool = False, ranges: int | None = None) -> DataFrame:
    """trace: t and columns, times: id and t (integers). Linear interpolation between the poses around each time.

    Poses and times are cut into ranges of time at quantiles that Spark samples (as many ranges as it shuffles to, if
    None), so that a range holds about as many rows wherever they crowd; each range also gets the last pose before it
    and the first after it. No window spans the whole trace. A time on a pose has its values. Times outside are dropped,
    or with clamp get the first or last pose; null times are dropped.
    """
    keyed = trace.groupBy("t").agg(*(F.max(c).alias(c) for c in columns)).filter("t is not null")
    pose = F.struct("t", *columns)
    wanted = times.filter("t is not null").select("id", "t", F.lit(True).alias("asked"), F.lit(None).cast(keyed.select(pose.alias("p")).schema["p"].dataType).alias("p"))
    both = wanted.unionByName(keyed.select(F.lit(None).cast(times.schema["id"].dataType).alias("id"), "t", F.lit(False).alias("asked"), pose.alias("p")))
    # Equal times are in one range.
    cut = kept((both.repartitionByRange(ranges, "t") if ranges else both.repartitionByRange("t")).withColumn("b", F.spark_partition_id()))
    # A row for each range.
    edges = cut.groupBy("b").agg(F.min_by("p", F.when(~F.col("asked"), F.col("t"))).alias("first"), F.max_by("p", F.when(~F.col("asked"), F.col("t"))).alias("last"))
    order = Window.orderBy("b")
    sides = edges.select("b", F.last("last", True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.first("first", True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("after"))
    # Both ways as growing frames: one that shrinks is gone through anew for each row.
    near, back = Window.partitionBy("b").orderBy("t"), Window.partitionBy("b").orderBy(F.desc("t"))
    found = cut.select("id", "t", "b", "asked", F.last("p", True).over(near.rangeBetween(Window.unboundedPreceding, 0)).alias("p0"), F.last("p", True).over(back.rangeBetween(Window.unboundedPreceding, 0)).alias("p1")).filter("asked")
    found = found.join(F.broadcast(sides), "b", "left").select("id", "t", F.coalesce("p0", "before").alias("p0"), F.coalesce("p1", "after").alias("p1"))
    if clamp:
        found = found.select("id", "t", F.coalesce("p0", "p1").alias("p0"), F.coalesce("p1", "p0").alias("p1"))
    gap = F.nullif(F.col("p1.t") - F.col("p0.t"), F.lit(0))
    share = F.coalesce((F.col("t") - F.col("p0.t")) / gap, F.lit(0.0))
    return found.filter("p0 is not null and p1 is not null").select("id", "t", *((F.col(f"p0.{c}") * (1 - share) + F.col(f"p1.{c}") * share).alias(c) for c in columns))


def scan_rings(cloud: DataFrame) -> DataFrame:
    """ring: a ring ends at the first positive azimuth after a negative one in it."""
    turn = F.signum(F.atan2("y", "x"))
    before = F.last(F.nullif(turn, F.lit(0.0)), True).over(by_frame().rowsBetween(Window.unboundedPreceding, -1))
    marked = cloud.withColumn("new", F.when((turn > 0) & (before < 0), 1).otherwise(0))
    return marked.withColumn("ring", F.sum("new").over(by_frame().rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("new")


def ring_sections(cloud: DataFrame, sections: int = 6) -> DataFrame:
    """section: which of the equal parts of its ring a point is in, cut at floor(n * j / sections)."""
    ring = Window.partitionBy("frame_id", "ring")
    at, n = F.row_number().over(ring.orderBy("pt")) - 1, F.count("*").over(ring)
    return cloud.withColumn("section", F.floor((sections * (at + 1) - 1) / n).cast("int"))


def ordinal(frames: DataFrame, key: str, bucket: int = 65_536) -> DataFrame:
    """ord: place of each row by an integer key, from 0; equal keys share none. Counts by bucket of keys, so that no task sorts all rows."""
    cut = frames.withColumn("_b", F.floor(F.col(key) / bucket))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy("_b").agg(F.count("*").alias("_n")).select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"))
    own = F.row_number().over(Window.partitionBy("_b").orderBy(key)) - 1
    return cut.withColumn("_o", own).join(starts, "_b").withColumn("ord", F.col("_s") + F.col("_o")).drop("_b", "_n", "_s", "_o")


def placed(rows: DataFrame, *order) -> DataFrame:
    """ord: each row's place, from 0, by any columns. Rows are sorted by ranges, and a range's first place is the sum of the sizes of those before it, so no task sees all rows; ties are numbered in any order."""
    part, at = "_part", "_at"
    spread = kept(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(part, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id()))
    sizes = spread.groupBy(part).agg(F.min(at).alias("_first"), F.count("*").alias("_n"))
    # A row for each range.
    before = F.coalesce(F.sum("_n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(part, (before - F.col("_first")).alias("_start"))
    return spread.join(F.broadcast(starts), part).withColumn("ord", F.col(at) + F.col("_start")).drop(part, at, "_start")
