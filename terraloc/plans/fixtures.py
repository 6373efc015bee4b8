"""Inputs of the engine's shape from the driver's tables: point clouds, poses, spheres, traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terraloc.functions.geometry import azimuth

ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
X = "CAST((l_orderkey*7919 + l_partkey*104729 + l_linenumber*1299709) % 16000 AS DOUBLE)/1e2 - 8e1 + 5e-3"
Y = "CAST((l_orderkey*15485863 + l_partkey*31 + l_linenumber*6151) % 16000 AS DOUBLE)/1e2 - 8e1 + 5e-3"
Z = "CAST((l_orderkey*613 + l_partkey*12289 + l_linenumber*389) % 700 AS DOUBLE)/1e2 - 2e0 + 5e-3"
INTENSITY = "CAST((l_orderkey*53 + l_partkey*97 + l_linenumber*193) % 256 AS DOUBLE)"
POSE = {
    "x": "CAST((frame_id*7919)%2003 AS DOUBLE)/1e1", "y": "CAST((frame_id*104729)%1999 AS DOUBLE)/1e1", "z": "CAST((frame_id*31)%53 AS DOUBLE)/1e1",
    "roll": "CAST((frame_id*17)%61 AS DOUBLE)/1e2 - 3e-1", "pitch": "CAST((frame_id*29)%61 AS DOUBLE)/1e2 - 3e-1", "yaw": "CAST((frame_id*43)%619 AS DOUBLE)/1e2 - 3.09e0",
}
GPS = {"lat": "3.9e1 + CAST(frame_id AS DOUBLE)/1e5", "lon": "1.16e2 + CAST(frame_id AS DOUBLE)*3e0/1e5", "alt": "4e1 + CAST(frame_id % 7 AS DOUBLE)"}

CLOUD = f"cloud AS (SELECT l_suppkey AS frame_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY {', '.join(ORDER)}) AS pt, {X} AS x, {Y} AS y, {Z} AS z, {INTENSITY} AS intensity FROM lineitem)"
FRAMES = "frames AS (SELECT DISTINCT l_suppkey AS frame_id FROM lineitem)"
POSES = f"{FRAMES}, poses AS (SELECT frame_id, {', '.join(f'{v} AS {k}' for k, v in POSE.items())} FROM frames)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_id, x, y, z, intensity: points whose order doesn't matter, so that no sort is needed."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return t.select(F.col("l_suppkey").alias("frame_id"), F.expr(X).alias("x"), F.expr(Y).alias("y"), F.expr(Z).alias("z"), F.expr(INTENSITY).alias("intensity"))


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """points with pt, their order in the frame."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    pt = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(*ORDER)).cast("long")
    return t.select(F.col("l_suppkey").alias("frame_id"), pt.alias("pt"), F.expr(X).alias("x"), F.expr(Y).alias("y"), F.expr(Z).alias("z"), F.expr(INTENSITY).alias("intensity"))


def swept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cloud, with pt anew: two turns of rising azimuth."""
    order = Window.partitionBy("frame_id").orderBy(F.col("pt") % 2, azimuth(F.col("x"), F.col("y")), "pt")
    return cloud(spark, sf_dir).withColumn("pt", F.row_number().over(order).cast("long"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_suppkey").alias("frame_id")).distinct()


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).select("frame_id", *(F.expr(v).alias(k) for k, v in POSE.items()))
