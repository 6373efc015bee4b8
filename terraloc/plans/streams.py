"""Queries that send the fixtures through a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraloc.plans import fixtures as fx
from terraloc.plans.files import scratch
from terraloc.plans.queries import RINGED, query
from terraloc.streaming import scans


@query(f"""WITH RECURSIVE {RINGED}, c AS MATERIALIZED (SELECT frame_id, pt, x, y, z FROM cloud), k AS (SELECT frame_id, pt, x, y, z FROM c WHERE pt = 1 UNION ALL
SELECT frame_id, n.pt, n.x, n.y, n.z FROM (SELECT c.frame_id, min(struct_pack(pt := c.pt, x := c.x, y := c.y, z := c.z)) AS n FROM k JOIN c ON c.frame_id = k.frame_id AND c.pt > k.pt AND (c.x - k.x)*(c.x - k.x) + (c.y - k.y)*(c.y - k.y) + (c.z - k.z)*(c.z - k.z) >= 4 GROUP BY 1)),
r AS (SELECT frame_id, pt, CAST(sum(CASE WHEN up AND NOT coalesce(was, NOT up) THEN 1 ELSE 0 END) OVER (PARTITION BY frame_id ORDER BY pt) - 1 AS INTEGER) AS ring FROM u)
SELECT r.frame_id, r.pt, r.ring, CAST(k.pt IS NOT NULL AS INTEGER) AS kept FROM r LEFT JOIN k ON k.frame_id = r.frame_id AND k.pt = r.pt""")
def streamed_scans(spark, sf_dir):
    """Rings and thinning of all frames at once from a stream of files in no order, each with a stretch of points whose ends overlap those of others."""
    folder = scratch(spark, "stream")
    points = fx.cloud(spark, sf_dir).select("frame_id", "pt", "x", "y", "z", F.timestamp_millis("pt").alias("ts"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    early = F.pmod(F.xxhash64("frame_id", "pt"), F.lit(64))
    points.repartitionByRange(parts, F.col("pt") + early).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", max(1, parts // 4)).parquet(f"{folder}/in")
    # Each part's points have the times of their numbers, so `late` is the largest frame that may come in any order.
    scans.follow(stream, f"{folder}/out", f"{folder}/check", late="1 hour", keep="1 hour").awaitTermination()
    return spark.read.schema(scans.ROWS).parquet(f"{folder}/out")
