"""Descriptors of arriving frames appended to an index, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from terraloc.operators.modules import DescriptorModule


def append(points: DataFrame, module: DescriptorModule, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts a query that describes whole frames of a stream and writes them under path as batch=N.

    A batch that is tried again replaces its own folder, so each frame is in the index once. A frame's points must
    arrive in one batch, as those of one file do. trigger: as of DataStreamWriter.trigger, availableNow by default.
    """

    def add(batch: DataFrame, n: int) -> None:
        module.describe(batch).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return points.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def load(spark, module: DescriptorModule, path: str) -> DataFrame:
    return module.load(spark, path).drop("batch")


def window_counts(points: DataFrame, late: str = "10 minutes", window: str = "1 minute") -> DataFrame:
    """Points by frame and event-time window of `ts`; rows that come over `late` behind the newest don't count."""
    return points.withWatermark("ts", late).groupBy(F.window("ts", window), "frame_id").agg(F.count("*").alias("points"))
