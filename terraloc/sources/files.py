"""Scans, clocks, trajectories and results as files.

Binary files come whole, one row each (Spark's binaryFile), and become points in Arrow batches; text goes through
Spark's readers. Any Hadoop path will do. Bad files raise, but for the lines that a format says to skip.
"""

from __future__ import annotations

import posixpath
import struct
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terraloc.functions.geometry import quaternion, rotation, to_ecef, to_tangent
from terraloc.operators.features import kitti_rings
from terraloc.operators.scans import placed

POINT = "path string, pt long, x float, y float, z float, intensity float, ring int, time double"
#: Fixed values of the descriptor file format: header and record layouts, little-endian, without padding.
MAGIC, GENERATOR = 0x5343414E, 0x536D6D60
HEADER, WIDTH, HEIGHT = "<IIHHHH128s", 60, 20
RECORD = np.dtype([("name", "S64"), ("timestamp", "<f8"), ("x", "<f8"), ("y", "<f8"), ("z", "<f8"), ("roll", "<f8"), ("pitch", "<f8"), ("yaw", "<f8"), ("data", "<f4", (WIDTH * HEIGHT,))])


def list_files(spark: SparkSession, folder: str, extension: str) -> DataFrame:
    """path, number, ord: a folder's files of an extension, not those of its subfolders, by the number that their name starts with (else 0), then name. Spark leaves out files of no bytes."""
    names = spark.read.format("binaryFile").option("pathGlobFilter", f"*{extension}").option("recursiveFileLookup", "false").load(folder).select("path")
    return _ordered(names)


def _ordered(names: DataFrame) -> DataFrame:
    base = F.element_at(F.split("path", "/"), -1)
    number = F.coalesce(F.regexp_extract(base, r"^\s*([+-]?\d+)", 1).try_cast("long"), F.lit(0))
    found = names.withColumn("number", number)
    return placed(found.withColumn("_base", base), "number", "_base", "path").drop("_base")


def parse_bin(data: bytes) -> dict[str, np.ndarray]:
    """Points of four floats; a scan of over 64 rings, or a file that doesn't end on a point, raises ValueError."""
    if len(data) % 16:
        raise ValueError(f"{len(data)} bytes are no whole points")
    p = np.frombuffer(data, "<f4").reshape(-1, 4)
    ring = kitti_rings(p[:, 0], p[:, 1]).astype(np.int32)
    if len(ring) and ring[-1] > 63:
        raise ValueError(f"{ring[-1] + 1} rings")
    return {"x": p[:, 0], "y": p[:, 1], "z": p[:, 2], "intensity": p[:, 3], "ring": ring, "time": 0.99 / max(len(p), 1) * np.arange(len(p))}


def _decompress_lzf(data: bytes, size: int) -> bytes:
    """LZF: runs of up to 32 literals, or a copy of 3 bytes and more from up to 8 KiB back."""
    out, i = bytearray(), 0
    while i < len(data):
        c = data[i]
        i += 1
        if c < 32:
            out += data[i : i + c + 1]
            i += c + 1
            continue
        n, far = c >> 5, (c & 31) << 8
        if n == 7:
            n += data[i]
            i += 1
        start = len(out) - far - data[i] - 1
        i += 1
        if start < 0:
            raise ValueError("copy from before the start")
        for k in range(n + 2):
            out.append(out[start + k])
    if len(out) != size:
        raise ValueError(f"{len(out)} bytes instead of {size}")
    return bytes(out)


def parse_pcd(data: bytes) -> dict[str, np.ndarray]:
    """Fields of a PCD file (ascii, binary or binary_compressed) by name; fields of several values have a column each."""
    head, at = {}, 0
    while "DATA" not in head:
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError("no DATA line")
        line, at = data[at:end].decode("ascii").strip(), end + 1
        if line and not line.startswith("#"):
            key, *rest = line.split()
            head[key] = rest
    kinds = {"F": "f", "I": "i", "U": "u"}
    counts = [int(c) for c in head.get("COUNT", ["1"] * len(head["FIELDS"]))]
    types = [np.dtype(f"<{kinds[t]}{s}") for t, s in zip(head["TYPE"], head["SIZE"], strict=True)]
    n = int(head["POINTS"][0])
    shape = [(c,) if c > 1 else () for c in counts]
    row = np.dtype([(f"{f}#{i}", t, s) for i, (f, t, s) in enumerate(zip(head["FIELDS"], types, shape, strict=True))])
    how = head["DATA"][0]
    if how == "ascii":
        lines = data[at:].decode("ascii").split("\n")[:n]
        table = np.array([r.split() for r in lines]).reshape(n, sum(counts)) if n else np.empty((0, sum(counts)), str)
        edges = np.cumsum([0, *counts])
        columns = [table[:, a] if c == 1 else table[:, a : a + c] for a, c in zip(edges[:-1], counts, strict=True)]
        columns = [c.astype(float).astype(t) for c, t in zip(columns, types, strict=True)]
    elif how == "binary":
        if len(data) - at < n * row.itemsize:
            raise ValueError("file ends early")
        points = np.frombuffer(data, row, n, at)
        columns = [points[f] for f in row.names]
    elif how == "binary_compressed":
        packed, size = struct.unpack_from("<II", data, at)
        raw = _decompress_lzf(data[at + 8 : at + 8 + packed], size)
        columns, at = [], 0
        for t, c in zip(types, counts, strict=True):
            v = np.frombuffer(raw, t, n * c, at)
            columns.append(v.reshape(n, c) if c > 1 else v)
            at += v.nbytes
    else:
        raise ValueError(f"unknown DATA {how}")
    return {f: c for f, c in zip(head["FIELDS"], columns, strict=True) if f != "_"}


PARSERS = {".bin": parse_bin, ".pcd": parse_pcd}


def read_scans(spark: SparkSession, folder: str, extension: str, block: int = 65_536) -> DataFrame:
    """POINT rows of a folder's scans; fields that a file lacks are null. One task reads one file or more, by Spark's splitting."""
    return scan_points(spark.read.format("binaryFile").option("pathGlobFilter", f"*{extension}").load(folder), extension, block)


def scan_points(files: DataFrame, extension: str, block: int = 65_536) -> DataFrame:
    """POINT rows of scans' path and content."""
    parse = PARSERS[extension]

    def run(batches):
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    p = parse(content.as_py())
                except (ValueError, KeyError, struct.error) as e:
                    raise ValueError(f"{path}: {e}") from e
                n = len(p["x"])
                for s in range(0, n, block):
                    e = min(s + block, n)
                    cols = [pa.array([path] * (e - s)), pa.array(np.arange(s, e))]
                    for f, t in (("x", pa.float32()), ("y", pa.float32()), ("z", pa.float32()), ("intensity", pa.float32()), ("ring", pa.int32()), ("time", pa.float64())):
                        cols.append(pa.array(p[f][s:e], t, from_pandas=False, safe=False) if f in p else pa.nulls(e - s, t))
                    yield pa.record_batch(cols, names=["path", "pt", "x", "y", "z", "intensity", "ring", "time"])

    return files.select("path", "content").mapInArrow(run, POINT)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file, ord, value: the lines that aren't empty of a file, or of a folder's files one after the other by name; ord counts the empty ones too. A task reads a split of a file, and a split's first place is the sum of the sizes of those before it."""
    split = ["file", "_start"]
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), "value", F.monotonically_increasing_id().alias("_i"))
    # A row for each split of a file.
    sizes = text.groupBy(*split).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(*split, before.alias("_before"))
    own = F.row_number().over(Window.partitionBy(*split).orderBy("_i")) - 1
    numbered = text.withColumn("_own", own).join(starts, split).withColumn("ord", F.col("_before") + F.col("_own"))
    return numbered.select("file", "ord", "value").filter("value <> ''")


def _numbers(line: str = "value", sep: str = r"\s+"):
    return F.transform(F.split(F.trim(line), sep), lambda v: F.trim(v).try_cast("double"))


def read_clock(spark: SparkSession, path: str) -> DataFrame:
    """ord, t (seconds) of lines of frame and nanoseconds; the first bad line ends the file."""
    v = _numbers()
    rows = _lines(spark, path).select("ord", F.get(v, 0).alias("id"), F.get(v, 1).alias("ns"))
    bad = rows.filter("id is null or ns is null or id <> floor(id)").agg(F.min("ord").alias("bad"))
    return rows.crossJoin(F.broadcast(bad)).filter("bad is null or ord < bad").select("ord", (F.col("ns") / 1e9).alias("t"))


def read_kitti_clock(spark: SparkSession, path: str) -> DataFrame:
    """ord, t (seconds since 1970 in the session's time zone) of lines like 2011-09-30 12:40:25.076499968; others are skipped."""
    part = F.regexp_extract("value", r"^\s*(\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2})(?:\.(\d{1,9}))?\s*$", 1)
    nano = F.rpad(F.regexp_extract("value", r"\.(\d{1,9})\s*$", 1), 9, "0").try_cast("double")
    whole = F.unix_timestamp(F.try_to_timestamp(part, F.lit("yyyy-M-d H:m:s")))
    return _lines(spark, path).select("ord", (whole + F.coalesce(nano, F.lit(0.0)) / 1e9).alias("t")).filter("t is not null")


TRACE = ("t", "x", "y", "z", "roll", "pitch", "yaw", "cov_x", "cov_y", "cov_z")


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """ord, t and pose of lines of ten numbers with commas, of which the last three are dropped; other lines are skipped."""
    v = _numbers(sep=",")
    rows = _lines(spark, path).select("ord", v.alias("v")).filter((F.size("v") == 10) & ~F.exists("v", F.isnull))
    return rows.select("ord", *(F.get("v", i).alias(c) for i, c in enumerate(TRACE[:7])))


def read_gps(spark: SparkSession, folder: str) -> DataFrame:
    """ord, x, y, z, roll, pitch, yaw and m00..m22 of lines of latitude, longitude, height and angles in a folder's .txt files, by number of file and line.

    Local to the first good line. Lines without six numbers are skipped.
    """
    v = _numbers()
    order = list_files(spark, folder, ".txt").select(F.element_at(F.split("path", "/"), -1).alias("base"), F.col("ord").alias("f"))
    rows = _lines(spark, f"{folder.rstrip('/')}/*.txt").withColumn("base", F.element_at(F.split(F.url_decode("file"), "/"), -1)).join(F.broadcast(order), "base")
    rows = rows.select(F.struct("f", "ord").alias("at"), F.transform(F.slice(v, 1, 6), lambda x: x).alias("v")).filter((F.size("v") == 6) & ~F.exists("v", F.isnull))
    origin = rows.agg(F.min_by("v", "at").alias("o"))
    both = rows.crossJoin(F.broadcast(origin))
    lat, lon, alt = (F.get("v", i) for i in range(3))
    place = to_tangent(to_ecef(*(F.get("o", i) for i in range(3))), to_ecef(lat, lon, alt), lat, lon)
    angles = [F.get("v", i) for i in range(3, 6)]
    m = rotation(*angles)
    out = both.select("at", *(p.alias(n) for p, n in zip([*place, *angles], ("x", "y", "z", "roll", "pitch", "yaw"), strict=True)), *(m[i][j].alias(f"m{i}{j}") for i in range(3) for j in range(3)))
    return placed(out, "at").drop("at")


def read_heldout(spark: SparkSession, path: str) -> DataFrame:
    """name: base names of the paths in a list; blank ends of lines don't count, nor do empty lines."""
    return spark.read.text(path).select(F.element_at(F.split(F.regexp_replace("value", r"\s+$", ""), "/"), -1).alias("name")).filter("name <> ''").distinct()


def frames(files: DataFrame, clock: DataFrame, trace: DataFrame) -> DataFrame:
    """Files, times and poses joined by place, after their counts are found equal; else the query fails."""
    n = [d.agg(F.count("*").alias(c)) for d, c in ((files, "nf"), (clock, "nc"), (trace, "nt"))]
    counts = n[0].crossJoin(n[1]).crossJoin(n[2])  # one row each
    same = F.assert_true((F.col("nf") == F.col("nc")) & (F.col("nc") == F.col("nt")), F.concat_ws(" ", F.lit("files, times and poses:"), "nf", "nc", "nt"))
    sides = [placed(d.withColumnRenamed("ord", "_was"), "_was").drop("_was") for d in (files, clock, trace.drop("t"))]
    joined = sides[0].join(sides[1], "ord", "full").join(sides[2], "ord", "full")
    return joined.crossJoin(F.broadcast(counts.select(same.alias("same")))).filter("same is null").drop("same")


def descriptor_file(rows: list[dict], suffix: str = "") -> bytes:
    """A descriptor file of rows with name, timestamp, pose and 1200 floats of data. Over 65,535 rows, or names of over 63 bytes, raise ValueError."""
    if len(rows) > 0xFFFF:
        raise ValueError(f"{len(rows)} descriptors; the count has 16 bits")
    if len(suffix.encode()) > 127 or any(len(r["name"].encode()) > 63 for r in rows):
        raise ValueError("name or suffix too long")
    out = np.zeros(len(rows), RECORD)
    for i, r in enumerate(rows):
        out[i] = (r["name"].encode(), *(r[c] for c in RECORD.names[1:-1]), r["data"])
    return struct.pack(HEADER, MAGIC, GENERATOR, WIDTH, HEIGHT, len(rows), WIDTH * HEIGHT, suffix.encode()) + out.tobytes()


def parse_descriptors(data: bytes) -> list[dict]:
    """Rows of a descriptor file; wrong numbers in its header or a short file raise ValueError."""
    return _plain(_records(data))


def _plain(rows: np.ndarray) -> list[dict]:
    return [{"name": r["name"].decode(), **{c: float(r[c]) for c in RECORD.names[1:-1]}, "data": r["data"].tolist()} for r in rows]


def _records(data: bytes) -> np.ndarray:
    size = struct.calcsize(HEADER)
    if len(data) < size:
        raise ValueError("short header")
    magic, generator, width, height, count, length, _ = struct.unpack_from(HEADER, data)
    if (magic, generator, width, height, length) != (MAGIC, GENERATOR, WIDTH, HEIGHT, WIDTH * HEIGHT):
        raise ValueError("no descriptor file")
    if len(data) < size + count * RECORD.itemsize:
        raise ValueError("file ends early")
    return np.frombuffer(data, RECORD, count, size)


#: Descriptors that become an Arrow batch.
READ_ROWS = 256
DESCRIPTOR = "path string, name string, timestamp double, x double, y double, z double, roll double, pitch double, yaw double, data array<float>"


def read_descriptors(spark: SparkSession, path: str) -> DataFrame:
    """DESCRIPTOR rows of descriptor files."""

    def run(batches):
        schema = pa.schema([("path", pa.string()), ("name", pa.string()), *((c, pa.float64()) for c in RECORD.names[1:-1]), ("data", pa.list_(pa.float32()))])
        for b in batches:
            for p, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = _records(content.as_py())
                for at in range(0, len(rows), READ_ROWS):
                    yield pa.RecordBatch.from_pylist([{"path": p, **r} for r in _plain(rows[at : at + READ_ROWS])], schema)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, DESCRIPTOR)


def write_text(df: DataFrame, path: str) -> None:
    """One column of lines, in as many files as the plan has partitions."""
    df.write.mode("overwrite").text(path)


RESULT = ("path", "match_idx", "px", "py", "pz", "gx", "gy", "gz", "err")


def write_results(results: DataFrame, path: str) -> None:
    """CSV of RESULT; a row without a match is its path, -1 and zeros."""
    miss = F.col("match_idx").isNull() | (F.col("match_idx") < 0)
    results.select("path", F.when(miss, -1).otherwise(F.col("match_idx")).alias("match_idx"), *(F.when(miss, 0.0).otherwise(F.col(c)).alias(c) for c in RESULT[2:])).write.mode("overwrite").csv(path)


def write_trace(trace: DataFrame, path: str) -> None:
    """Lines of t, x, y, z and the quaternion, with blanks between."""
    q = quaternion(F.col("roll"), F.col("pitch"), F.col("yaw"))
    write_text(trace.select(F.concat_ws(" ", *(c.cast("string") for c in [*map(F.col, ("t", "x", "y", "z")), *q])).alias("value")), path)


def write_descriptors_text(cells: DataFrame, path: str) -> None:
    """A folder per frame with a line per ring of its values in order of sector. Files, not bytes, are what takes time, so frames are dealt to a fixed number of tasks that Spark doesn't join by their small sizes."""
    spark = cells.sparkSession
    tasks = max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    lines = cells.groupBy("frame_id", "ring").agg(F.sort_array(F.collect_list(F.struct("sector", "v"))).alias("r"))
    text = lines.select("frame_id", "ring", F.array_join(F.transform("r", lambda c: c["v"].cast("string")), " ").alias("value"))
    text.repartition(tasks, "frame_id").sortWithinPartitions("frame_id", "ring").select("frame_id", "value").write.partitionBy("frame_id").mode("overwrite").text(path)


def write_files(rows: DataFrame, folder: str) -> None:
    """rows: name, content (bytes). A file for each row, written by the tasks to a folder named by a URI; a name is given once its file is whole, so a task that is tried again leaves no part of one."""

    def run(batches):
        system, where = fs.FileSystem.from_uri(folder)
        system.create_dir(where, recursive=True)
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                hidden = posixpath.join(where, f"_{uuid.uuid4().hex}.tmp")
                with system.open_output_stream(hidden) as out:
                    out.write(content.as_buffer())
                system.move(hidden, posixpath.join(where, name))
            yield pa.record_batch([pa.array([b.num_rows], pa.int64())], names=["n"])

    rows.select("name", F.col("content").cast("binary")).mapInArrow(run, "n long").write.format("noop").mode("overwrite").save()
