"""Queries that write the fixtures in the reference formats, read them back, and state in SQL what must come of it."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloc.operators import descriptors, modules, retrieval
from terraloc.plans import fixtures as fx
from terraloc.plans.queries import ROT, SC, R, _embedding_sql, query, rounded
from terraloc.sources import descriptors as sink
from terraloc.sources import files
from terraloc.streaming.dynamic import DynamicIndex, rows_of

POSE = ("x", "y", "z", "roll", "pitch", "yaw")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder's path under spark.checkpoint.dir, or a temporary one on a local master; it goes when the driver's Python ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.gettempdir()
    path = f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _written(spark: SparkSession, tag: str, lines: DataFrame) -> str:
    """The folder of text files, by ranges of ord, of the column value in its order; a line a frame."""
    path = scratch(spark, tag)
    lines.repartitionByRange("ord").sortWithinPartitions("ord").select("value").write.text(path)
    return path


def _texts(*columns: str):
    return [F.col(c).cast("string") for c in columns]


def _poses(spark, sf_dir) -> DataFrame:
    return fx.poses(spark, sf_dir).withColumn("t", F.col("frame_id") / 10.0)


def _order(columns: str) -> str:
    return f"{fx.POSES}, o AS (SELECT *, row_number() OVER (ORDER BY frame_id) - 1 AS ord FROM poses) SELECT {columns} FROM o"


ORDERED = f"{fx.CLOUD}, s AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY pt % 32, CASE WHEN atan2(y, x) < 0 THEN atan2(y, x) + 2*pi() ELSE atan2(y, x) END, pt) - 1 AS i FROM cloud)"
FLOATS = ", ".join(R(f"CAST(CAST({c} AS FLOAT) AS DOUBLE)", c) for c in ("x", "y", "z", "intensity"))


@query(f"""WITH {ORDERED}, n AS (SELECT *, CASE WHEN y > 0 AND lag(y) OVER w < 0 THEN 1 ELSE 0 END AS new, count(*) OVER (PARTITION BY frame_id) AS n FROM s WINDOW w AS (PARTITION BY frame_id ORDER BY i))
SELECT CAST(frame_id AS VARCHAR) || '.bin' AS path, i AS pt, {FLOATS}, CAST(sum(new) OVER (PARTITION BY frame_id ORDER BY i) AS INTEGER) AS ring, {R('99e-2/n*i + 1e-9', 'time')} FROM n""")
def kitti_scan(spark, sf_dir):
    """Each frame in 32 turns as a scan file of four floats a point."""

    def pack(batches):
        for b in batches:
            # A frame at a time, so that memory doesn't grow with the frames of a batch.
            content = [np.stack([frame.values.field(c).to_numpy() for c in ("x", "y", "z", "intensity")], 1).astype("<f4").tobytes() for frame in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array(content, pa.binary())], names=["path", "content"])

    az = F.atan2("y", "x")
    turn = F.struct((F.col("pt") % 32).alias("turn"), F.when(az < 0, az + 2 * np.pi).otherwise(az).alias("az"), "pt", "x", "y", "z", "intensity")
    frames = fx.cloud(spark, sf_dir).groupBy("frame_id").agg(F.sort_array(F.collect_list(turn)).alias("p"))
    packed = frames.select(F.concat(F.col("frame_id").cast("string"), F.lit(".bin")).alias("path"), "p").mapInArrow(pack, "path string, content binary")
    scans = _as_files(spark, "kitti", packed)
    off_ties = F.col("time") + 1e-9  # as engines round halves differently
    return _as_doubles(files.scan_points(scans, ".bin").withColumn("time", off_ties))


def _as_files(spark: SparkSession, tag: str, scans: DataFrame) -> DataFrame:
    """path, content of files of that content, written by tasks and read again; their paths are names."""
    path = scratch(spark, tag)
    files.write_files(scans.withColumnRenamed("path", "name"), path)
    found = spark.read.format("binaryFile").load(path)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("path"), "content")


def _as_doubles(points: DataFrame) -> DataFrame:
    return rounded(points.select("path", "pt", *(F.col(c).cast("double").alias(c) for c in ("x", "y", "z", "intensity")), "ring", "time"))


@query(f"WITH {fx.CLOUD} SELECT CAST(frame_id AS VARCHAR) || '.pcd' AS path, pt - 1 AS pt, {FLOATS}, CAST(pt % 32 AS INTEGER) AS ring, {R('pt/1e1', 'time')} FROM cloud")
def pcd_scan(spark, sf_dir):
    """Each frame as a point file with rings and times; by turns ascii, binary and compressed."""
    point = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("intensity", "<f4"), ("ring", "<u2"), ("time", "<f8")])
    head = "# .PCD\nFIELDS x y z intensity ring time\nSIZE 4 4 4 4 2 8\nTYPE F F F F U F\nCOUNT 1 1 1 1 1 1\nPOINTS {}\nDATA {}\n"

    def encoded(frame_id, p):
        kind = ("ascii", "binary", "binary_compressed")[frame_id % 3]
        if kind == "ascii":
            body = "".join(" ".join(str(v) for v in row) + "\n" for row in p).encode()
        elif kind == "binary":
            body = p.tobytes()
        else:  # field by field; runs of up to 32 literals are a valid compression
            plain = b"".join(p[c].tobytes() for c in point.names)
            packed = b"".join(bytes([len(plain[i : i + 32]) - 1]) + plain[i : i + 32] for i in range(0, len(plain), 32))
            body = np.array([len(packed), len(plain)], "<u4").tobytes() + packed
        return head.format(len(p), kind).encode() + body

    def points_of(frame):  # a frame at a time, so that memory doesn't grow with the frames of a batch
        p = np.empty(len(frame), point)
        for c in point.names:
            p[c] = frame.field(c).to_numpy()
        return p

    def pack(batches):
        for b in batches:
            content = [encoded(i, points_of(frame.values)) for i, frame in zip(b.column(0).to_pylist(), b.column(1), strict=True)]
            yield pa.record_batch([pa.array([f"{i}.pcd" for i in b.column(0).to_pylist()]), pa.array(content, pa.binary())], names=["path", "content"])

    own = F.struct("pt", "x", "y", "z", "intensity", (F.col("pt") % 32).alias("ring"), (F.col("pt") / 10.0).alias("time"))
    frames = fx.cloud(spark, sf_dir).groupBy("frame_id").agg(F.sort_array(F.collect_list(own)).alias("p"))
    return _as_doubles(files.scan_points(_as_files(spark, "pcd", frames.mapInArrow(pack, "path string, content binary")), ".pcd"))


@query("WITH " + _order(f"ord, {R('frame_id/1e1 + 17e-9', 't')}"))
def clock_lines(spark, sf_dir):
    f = fx.frames(spark, sf_dir).withColumn("ord", F.col("frame_id"))
    lines = f.select("ord", F.concat_ws(" ", *_texts("frame_id"), (F.col("frame_id") * 100_000_000 + 17).cast("string")).alias("value"))
    return rounded(files.read_clock(spark, _written(spark, "clock", lines)))


@query("WITH " + _order(f"ord, {R('frame_id - min(frame_id) OVER () + CAST(frame_id % 7 AS DOUBLE)/1e3 - CAST(min(frame_id) OVER () % 7 AS DOUBLE)/1e3', 't')}"))
def kitti_clock_lines(spark, sf_dir):
    """Seconds after the first line's."""
    f = fx.frames(spark, sf_dir).withColumn("ord", F.col("frame_id"))
    at = [F.lpad((F.floor(F.col("frame_id") / k) % 60).cast("string"), 2, "0") for k in (60, 1)]
    hour = F.lpad((F.floor(F.col("frame_id") / 3600) % 24).cast("string"), 2, "0")
    lines = f.select("ord", F.concat(F.lit("2011-09-30 "), hour, F.lit(":"), at[0], F.lit(":"), at[1], F.lit(".00"), (F.col("frame_id") % 7).cast("string"), F.lit("000000")).alias("value"))
    t = files.read_kitti_clock(spark, _written(spark, "kitti-clock", lines))
    return rounded(t.crossJoin(F.broadcast(t.agg(F.min_by("t", "ord").alias("first")))).select("ord", (F.col("t") - F.col("first")).alias("t")))


@query("WITH " + _order(f"ord, {R('frame_id/1e1', 't')}, {', '.join(R(c, c) for c in POSE)}"))
def trace_lines(spark, sf_dir):
    p = _poses(spark, sf_dir)
    lines = p.select(F.col("frame_id").alias("ord"), F.concat_ws(",", *_texts("t", *POSE), F.lit("0.1,0.2,0.3")).alias("value"))
    return rounded(files.read_trace(spark, _written(spark, "trace", lines)))


ECEF_OF = "(6378137e0/sqrt(1 - E2*sin(la)*sin(la)) + alt)*cos(la)*cos(lo) AS ex, (6378137e0/sqrt(1 - E2*sin(la)*sin(la)) + alt)*cos(la)*sin(lo) AS ey, (6378137e0/sqrt(1 - E2*sin(la)*sin(la))*(1 - E2) + alt)*sin(la) AS ez".replace("E2", "(1 - (63567523142e-4*63567523142e-4)/(6378137e0*6378137e0))")


@query(f"""WITH {fx.POSES}, ll AS (SELECT row_number() OVER (ORDER BY frame_id) - 1 AS ord, radians({fx.GPS['lat']}) AS la, radians({fx.GPS['lon']}) AS lo, {fx.GPS['alt']} AS alt, roll, pitch, yaw FROM poses),
p AS (SELECT *, {ECEF_OF} FROM ll), q AS (SELECT p.*, o.ex - p.ex AS dx, o.ey - p.ey AS dy, o.ez - p.ez AS dz FROM p, (SELECT ex, ey, ez FROM p WHERE ord = 0) o)
SELECT ord, round(-sin(lo)*dx + cos(lo)*dy, 4) + 0e0 AS x, round(-sin(la)*cos(lo)*dx - sin(la)*sin(lo)*dy + cos(la)*dz, 4) + 0e0 AS y, round(cos(la)*cos(lo)*dx + cos(la)*sin(lo)*dy + sin(la)*dz, 4) + 0e0 AS z, {', '.join(R(c, c) for c in POSE[3:])}, {', '.join(R(m, f'm{i // 3}{i % 3}') for i, m in enumerate(ROT))} FROM q""")
def gps_lines(spark, sf_dir):
    p = fx.poses(spark, sf_dir).select("frame_id", "roll", "pitch", "yaw", *(F.expr(v).alias(k) for k, v in fx.GPS.items()))
    lines = p.select(F.col("frame_id").alias("ord"), F.concat_ws(" ", *_texts("lat", "lon", "alt", "roll", "pitch", "yaw")).alias("value"))
    found = files.read_gps(spark, _written(spark, "gps", lines))
    local = [(F.round(c, 4) + 0.0).alias(c) for c in "xyz"]
    return rounded(found.select("ord", *local, "roll", "pitch", "yaw", *(f"m{i}{j}" for i in range(3) for j in range(3))))


@query(f"WITH {fx.FRAMES} SELECT CAST(frame_id AS VARCHAR) || '.bin' AS name FROM frames WHERE frame_id % 10 = 3")
def heldout_names(spark, sf_dir):
    held = fx.frames(spark, sf_dir).filter("frame_id % 10 = 3")
    lines = held.select(F.col("frame_id").alias("ord"), F.concat(F.lit("/data/"), F.col("frame_id").cast("string"), F.lit(".bin  ")).alias("value"))
    return files.read_heldout(spark, _written(spark, "heldout", lines))


def _numbered(spark, sf_dir) -> str:
    """A folder of a file for each frame, named by its number."""
    path = scratch(spark, "numbered")
    files.write_files(fx.frames(spark, sf_dir).select(F.concat(F.col("frame_id").cast("string"), F.lit(".bin")).alias("name"), F.lit(b"0").alias("content")), path)
    return path


@query("WITH " + _order("CAST(frame_id AS VARCHAR) || '.bin' AS name, frame_id AS number, ord"))
def file_list(spark, sf_dir):
    """Files in order of the numbers in their names: 2 before 10."""
    found = files.list_files(spark, _numbered(spark, sf_dir), ".bin")
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "number", "ord")


@query("WITH " + _order(f"CAST(frame_id AS VARCHAR) || '.bin' AS name, ord, {R('frame_id/1e1 + 17e-9', 't')}, {', '.join(R(c, c) for c in POSE)}"))
def frames_of_files(spark, sf_dir):
    """Files, times and poses joined by place."""
    f = fx.frames(spark, sf_dir).withColumn("ord", F.col("frame_id"))
    clock = _written(spark, "clock", f.select("ord", F.concat_ws(" ", *_texts("frame_id"), (F.col("frame_id") * 100_000_000 + 17).cast("string")).alias("value")))
    trace = _written(spark, "trace", _poses(spark, sf_dir).select(F.col("frame_id").alias("ord"), F.concat_ws(",", *_texts("t", *POSE), F.lit("0,0,0")).alias("value")))
    joined = files.frames(files.list_files(spark, _numbered(spark, sf_dir), ".bin"), files.read_clock(spark, clock), files.read_trace(spark, trace))
    return rounded(joined.select(F.element_at(F.split("path", "/"), -1).alias("name"), "ord", "t", *POSE))


@query(f"WITH {fx.POSES} SELECT CAST(frame_id AS VARCHAR) || '.bin' AS path, CAST(CASE WHEN frame_id % 5 = 0 THEN -1 ELSE frame_id + 1 END AS BIGINT) AS match_idx, {', '.join(R(f'CASE WHEN frame_id % 5 = 0 THEN 0 ELSE {v} END', c) for c, v in zip(files.RESULT[2:], ('x', 'y', 'z', 'x', 'y', 'z', 'z/10'), strict=True))} FROM poses")
def result_csv(spark, sf_dir):
    p = fx.poses(spark, sf_dir)
    match = F.when(F.col("frame_id") % 5 != 0, F.col("frame_id") + 1)
    results = p.select(F.concat(F.col("frame_id").cast("string"), F.lit(".bin")).alias("path"), match.alias("match_idx"), *(F.col(v).alias(c) for c, v in zip(files.RESULT[2:8], "xyzxyz", strict=True)), (F.col("z") / 10).alias("err"))
    path = scratch(spark, "results")
    files.write_results(results, path)
    return rounded(spark.read.schema("path string, match_idx long, " + ", ".join(f"{c} double" for c in files.RESULT[2:])).csv(path))


@query(f"""WITH {fx.POSES}, h AS (SELECT *, cos(roll/2) AS a, sin(roll/2) AS b, cos(pitch/2) AS c, sin(pitch/2) AS d, cos(yaw/2) AS e, sin(yaw/2) AS f FROM poses)
SELECT {R('frame_id/1e1', 't')}, {R('x', 'x')}, {R('y', 'y')}, {R('z', 'z')}, {R('b*c*e - a*d*f', 'qx')}, {R('a*d*e + b*c*f', 'qy')}, {R('a*c*f - b*d*e', 'qz')}, {R('a*c*e + b*d*f', 'qw')} FROM h""")
def trace_text(spark, sf_dir):
    path = scratch(spark, "trace-text")
    files.write_trace(_poses(spark, sf_dir), path)
    v = F.split("value", " ")
    return rounded(spark.read.text(path).select(*(v[i].cast("double").alias(c) for i, c in enumerate(("t", "x", "y", "z", "qx", "qy", "qz", "qw")))))


@query(f"""WITH {SC}, {fx.POSES}, f AS (SELECT DISTINCT frame_id FROM sc) SELECT CAST(frame_id AS VARCHAR) AS name, {', '.join(R(c, c) for c in POSE)}, CAST(i.range AS INTEGER) AS i, {R('CAST(CAST(coalesce(v, 0) AS FLOAT) AS DOUBLE)', 'v')}
FROM f JOIN poses USING (frame_id), range(1200) i LEFT JOIN sc ON sc.frame_id = f.frame_id AND sc.ring = i.range // 60 AND sc.sector = i.range % 60""")
def descriptor_file(spark, sf_dir):
    """Descriptors written as descriptor files and read back."""
    cells = descriptors.height_max(fx.points(spark, sf_dir)).groupBy("frame_id").agg(F.map_from_entries(F.collect_list(F.struct((F.col("ring") * 60 + F.col("sector")).alias("i"), "v"))).alias("m"))
    data = F.transform(F.sequence(F.lit(0), F.lit(1199)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)).cast("float"))
    rows = cells.join(_poses(spark, sf_dir), "frame_id").select(F.col("frame_id").cast("string").alias("name"), F.col("t").alias("timestamp"), *POSE, data.alias("data"))
    path = scratch(spark, "descriptors")
    spark.dataSource.register(sink.DescriptorSink)
    rows.write.format("descriptors").mode("append").save(path)
    found = files.read_descriptors(spark, path)
    return rounded(found.select("name", *POSE, F.posexplode("data").alias("i", "v")).withColumn("v", F.col("v").cast("double")))


@query(_embedding_sql("(a.k[i] - b.k[i])*(a.k[i] - b.k[i])"))
def saved_index(spark, sf_dir):
    """knn_embeddings, of an index that was saved and loaded."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("frame_id"), F.col("embedding").cast("array<double>").alias("k"))
    path = scratch(spark, "index")
    retrieval.save_index(e, path)
    return rounded(retrieval.knn_of_index(e.filter("frame_id % 50 = 0"), retrieval.load_index(spark, path), without_own=True))


CHANGED = _embedding_sql("(a.k[i] - b.k[i])*(a.k[i] - b.k[i])").replace("FROM embeddings", "FROM (SELECT vec_id, CASE WHEN vec_id % 11 = 4 THEN list_transform(embedding, lambda v: -v) ELSE embedding END AS embedding FROM embeddings WHERE vec_id % 5 <> 1 OR vec_id % 11 = 4)")


@query(CHANGED)
def dynamic_index(spark, sf_dir):
    """knn_embeddings after four batches of inserts, one of deletes and one that puts some entries back with turned signs."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("frame_id"), F.col("embedding").cast("array<double>").alias("k"))
    index = DynamicIndex(spark, scratch(spark, "dynamic"), base=64)
    change = lambda op, df: df.select(F.lit(op).alias("op"), "frame_id", "k")
    for part in range(4):
        index.apply(change("insert", e.filter(F.col("frame_id") % 4 == part)))
    index.apply(change("delete", e.filter("frame_id % 5 = 1")))
    index.apply(change("insert", e.filter("frame_id % 11 = 4").withColumn("k", F.transform("k", lambda v: -v))))
    asked = rows_of(index.entries()).filter("frame_id % 50 = 0")
    return rounded(index.search(asked, without_own=True))


@query(f"WITH {SC}, f AS (SELECT DISTINCT frame_id FROM sc), k AS (SELECT frame_id, ring, sum(v)/60 AS k FROM sc GROUP BY ALL) SELECT f.frame_id, CAST(i.range AS INTEGER) AS ring, {R('coalesce(k, 0)', 'k')} FROM f, range(20) i LEFT JOIN k ON k.frame_id = f.frame_id AND k.ring = i.range")
def saved_module(spark, sf_dir):
    """A module's keys after its descriptors were saved and loaded."""
    module, path = modules.create("scancontext"), scratch(spark, "module")
    module.save(module.describe(fx.points(spark, sf_dir)), path)
    return rounded(module.keys(module.load(spark, path)).select("frame_id", F.posexplode("k").alias("ring", "k")))


@query(f"WITH {SC} SELECT frame_id, row_number() OVER (PARTITION BY frame_id ORDER BY ring, sector) - 1 AS i, {R('v', 'v')} FROM sc")
def descriptor_text(spark, sf_dir):
    """A folder a frame, a line a ring; read back as the frame's numbers in order."""
    path = scratch(spark, "descriptor-text")
    files.write_descriptors_text(descriptors.height_max(fx.points(spark, sf_dir)), path)
    whole = spark.read.text(path, wholetext=True).groupBy(F.col("frame_id").cast("long").alias("frame_id")).agg(F.concat_ws(" ", F.collect_list(F.regexp_replace("value", "\n", " "))).alias("value"))
    numbers = F.transform(F.filter(F.split("value", " "), lambda v: v != ""), lambda v: v.cast("double"))
    return rounded(whole.select("frame_id", F.posexplode(numbers).alias("i", "v")).withColumn("i", F.col("i").cast("long")))
