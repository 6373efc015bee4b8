"""Files round trip, and what formats say of bad ones."""

import datetime
import struct

import numpy as np
import pytest

from terraloc.operators import modules, retrieval, scans
from terraloc.plans import fixtures as fx
from terraloc.sources import files
from terraloc.sources.descriptors import DescriptorSink
from terraloc.streaming import index
from terraloc.streaming.dynamic import DynamicIndex, rows_of

SF = "/root/testdata/sf0.001"


def test_list_files_by_number(spark, tmp_path):
    for n in ("10.bin", "9.bin", "2x.bin", "b.bin", "a.bin", "1.txt"):
        (tmp_path / n).write_bytes(b"x")
    got = files.list_files(spark, str(tmp_path), ".bin").orderBy("ord").collect()
    assert [r["path"].rsplit("/", 1)[1] for r in got] == ["a.bin", "b.bin", "2x.bin", "9.bin", "10.bin"]


def test_bin_scans(spark, tmp_path):
    p = np.array([[1, 1, 0, 5], [1, -1, 0, 6], [1, 1, 0, 7], [-1, 0, 0, 8], [-1, -1, 0, 9], [2, 1, 0, 1]], "<f4")
    (tmp_path / "1.bin").write_bytes(p.tobytes())
    (tmp_path / "2.bin").write_bytes(b"")
    got = files.read_scans(spark, str(tmp_path), ".bin", block=4).orderBy("pt").toPandas()
    assert (got[["x", "y", "z", "intensity"]].values == p).all() and list(got["ring"]) == [0, 0, 1, 1, 1, 2]
    assert np.allclose(got["time"], 0.99 / 6 * np.arange(6))
    for bad in (b"123", np.tile(np.array([[1, 1, 0, 0], [1, -1, 0, 0]], "<f4"), (65, 1)).tobytes()):
        with pytest.raises(ValueError):
            files.parse_bin(bad)


HEAD = "# .PCD\nVERSION .7\nFIELDS x y z intensity ring time\nSIZE 4 4 4 4 2 8\nTYPE F F F F U F\nCOUNT 1 1 1 1 1 1\nWIDTH 3\nHEIGHT 1\nPOINTS 3\nDATA {}\n"


def test_pcd_kinds():
    row = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("intensity", "<f4"), ("ring", "<u2"), ("time", "<f8")])
    p = np.array([(1.5, 2, 3, 4, 5, 6.25), (7, 8, 9, 10, 11, 12), (0, -1, 0, 0, 63, 0)], row)
    ascii_ = "\n".join(" ".join(str(v) for v in r) for r in p.tolist()).encode()
    flat = b"".join(p[f].tobytes() for f in row.names)
    literals = b"".join(bytes([len(flat[i : i + 32]) - 1]) + flat[i : i + 32] for i in range(0, len(flat), 32))
    for how, body in (("ascii", ascii_), ("binary", p.tobytes()), ("binary_compressed", struct.pack("<II", len(literals), len(flat)) + literals)):
        got = files.parse_pcd(HEAD.format(how).encode() + body)
        assert all((got[f] == p[f]).all() for f in row.names), how
    with pytest.raises(ValueError):
        files.parse_pcd(HEAD.format("binary").encode() + b"12")
    # A literal, then copies of 3 and of 9 bytes from one back.
    assert files._decompress_lzf(bytes([0, 97, 32, 0, 224, 0, 0]), 13) == b"a" * 13


def test_pcd_scans(spark, tmp_path):
    (tmp_path / "1.pcd").write_bytes(b"FIELDS x y z\nSIZE 4 4 4\nTYPE F F F\nPOINTS 1\nDATA ascii\n1 2 3\n")
    r = files.read_scans(spark, str(tmp_path), ".pcd").collect()[0]
    assert (r["x"], r["y"], r["z"], r["ring"]) == (1, 2, 3, None)


def test_clocks_and_traces(spark, tmp_path):
    (tmp_path / "t").write_text("0 1500000000\n1 2500000000\nx 1\n2 3500000000\n")
    assert [r["t"] for r in files.read_clock(spark, str(tmp_path / "t")).orderBy("ord").collect()] == [1.5, 2.5]
    (tmp_path / "k").write_text("2011-09-30 12:40:25.076499968\nbad\n2011-09-30 12:40:26\n")
    want = datetime.datetime(2011, 9, 30, 12, 40, 25, tzinfo=datetime.UTC).timestamp()
    assert np.allclose([r["t"] - want for r in files.read_kitti_clock(spark, str(tmp_path / "k")).orderBy("ord").collect()], [0.076499968, 1], atol=1e-6)
    (tmp_path / "c").write_text("1,2,3,4,5,6,7,8,9,10\n1,2\n,,,,,,,,,\n2,2,3,4,5,6,7,8,9,10\n1,2,3,4,5,6,7,8,9,10,11\n")
    got = files.read_trace(spark, str(tmp_path / "c")).orderBy("ord").collect()
    assert [(r["t"], r["yaw"]) for r in got] == [(1, 7), (2, 7)]
    (tmp_path / "h").write_text("/a/b/1.bin  \n\n2.bin\n")
    assert {r["name"] for r in files.read_heldout(spark, str(tmp_path / "h")).collect()} == {"1.bin", "2.bin"}


def test_gps_is_local_to_first_line(spark, tmp_path):
    (tmp_path / "2.txt").write_text("39.0 116.001 40 0 0 0.5\nbad\n")
    (tmp_path / "1.txt").write_text("nothing\n39.0 116.0 40 0.1 0 0\n")
    got = files.read_gps(spark, str(tmp_path)).orderBy("ord").collect()
    assert len(got) == 2 and abs(got[0]["x"]) + abs(got[0]["y"]) + abs(got[0]["z"]) < 1e-6
    assert -87 < got[1]["x"] < -86 and abs(got[1]["m00"] - np.cos(0.5)) < 1e-12


def test_frames_need_equal_counts(spark):
    f = spark.createDataFrame([("a", 0), ("b", 1)], "path string, ord long")
    t = spark.createDataFrame([(0, 1.0), (5, 2.0)], "ord long, t double")
    x = spark.createDataFrame([(3, 1.0, 9.0), (4, 2.0, 8.0)], "ord long, t double, x double")
    assert [(r["path"], r["t"], r["x"]) for r in files.frames(f, t, x).orderBy("ord").collect()] == [("a", 1.0, 9.0), ("b", 2.0, 8.0)]
    with pytest.raises(Exception, match="files, times and poses"):
        files.frames(f, t.limit(1), x).collect()


def test_descriptor_files(spark, tmp_path):
    rows = [(f"f{i}", float(i), 1.0, 2.0, 3.0, 0.1, 0.2, 0.3, [float(i)] * 1200) for i in range(5)]
    df = spark.createDataFrame(rows, files.DESCRIPTOR.removeprefix("path string, ")).repartition(2)
    spark.dataSource.register(DescriptorSink)
    df.write.format("descriptors").mode("append").option("suffix", ".pcd").save(str(tmp_path / "d"))
    got = files.read_descriptors(spark, str(tmp_path / "d")).orderBy("timestamp").drop("path").collect()
    assert [tuple(r) for r in got] == rows and all(f.suffix == ".desc" for f in (tmp_path / "d").iterdir() if f.is_file())
    good = files.descriptor_file([])
    assert len(good) == 144 and files.parse_descriptors(good) == []
    for bad in (b"", b"x" * 144, files.descriptor_file([got[0].asDict()])[:-1]):
        with pytest.raises(ValueError):
            files.parse_descriptors(bad)
    with pytest.raises(ValueError):
        files.descriptor_file([{}] * 65536)


def test_results_and_traces_as_text(spark, tmp_path):
    rows = [("a", 3, *[1.5] * 7), ("b", None, *[2.0] * 7)]
    files.write_results(spark.createDataFrame(rows, "path string, match_idx long, " + ", ".join(f"{c} double" for c in files.RESULT[2:])), str(tmp_path / "r"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "r")).collect()) == ["a,3,1.5,1.5,1.5,1.5,1.5,1.5,1.5", "b,-1,0.0,0.0,0.0,0.0,0.0,0.0,0.0"]
    files.write_trace(spark.createDataFrame([(1.0, 2.0, 3.0, 4.0, 0.0, 0.0, 0.0)], "t double, x double, y double, z double, roll double, pitch double, yaw double"), str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).collect()[0]["value"] == "1.0 2.0 3.0 4.0 0.0 0.0 0.0 1.0"
    cells = spark.createDataFrame([(1, 0, 1, 2.0), (1, 0, 0, 1.0), (1, 1, 0, 5.0)], "frame_id long, ring int, sector int, v double")
    files.write_descriptors_text(cells, str(tmp_path / "x"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "x")).collect()] == ["1.0 2.0", "5.0"]


def test_frames_of_text_are_written_by_many_tasks(spark, tmp_path):
    """A folder a frame takes time by files; before, Spark joined the few bytes of all frames into one task."""
    rows = [(i, 0, 0, float(i)) for i in range(60)]
    files.write_descriptors_text(spark.createDataFrame(rows, "frame_id long, ring int, sector int, v double"), str(tmp_path / "x"))
    found = list((tmp_path / "x").rglob("part-*.txt"))
    assert len(found) == 60 and len({p.name[:10] for p in found}) >= 4


@pytest.mark.parametrize("name", sorted(modules.MODULES))
def test_module_finds_the_same_frame(spark, name, tmp_path):
    points = fx.points(spark, SF).filter("frame_id < 6")
    module = modules.create(name)
    module.save(module.describe(points), str(tmp_path / "i"))
    described = module.load(spark, str(tmp_path / "i"))
    got = module.search(described, described, 2).toPandas()
    first = got[got["rk"] == 1]
    assert len(first) == 6 and (first["q"] == first["c"]).all() and (first["dist"].abs() < 1e-6).all() and (first["yaw"] == 0).all()
    assert (got.groupby("q").size() == 2).all()


def test_module_options():
    m = modules.create("scancontext", **{"search.max_radius": "40", "num_candidates": 3})
    assert m.set["max_radius"] == 40.0 and m.set["num_candidates"] == 3
    for bad in (lambda: modules.create("none"), lambda: m.config("search.wrong", 1)):
        with pytest.raises(KeyError):
            bad()


def test_stream_appends_to_index(spark, tmp_path):
    fx.points(spark, SF).filter("frame_id < 4").repartition(2, "frame_id").write.parquet(str(tmp_path / "in"))
    module = modules.create("scancontext")
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for _ in range(2):
        index.append(stream, module, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = {r["frame_id"] for r in index.load(spark, module, str(tmp_path / "out")).collect()}
    assert got == {0, 1, 2, 3} and index.load(spark, module, str(tmp_path / "out")).count() == 4


def test_late_points_do_not_count(spark, tmp_path):
    def at(minute):
        return datetime.datetime(2020, 1, 1, 0, minute)

    for i, rows in enumerate(([(at(0), 1), (at(0), 1), (at(30), 2)], [(at(1), 1), (at(50), 2)])):
        spark.createDataFrame(rows, "ts timestamp, frame_id long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"b={i}"))
        stream = spark.readStream.schema("ts timestamp, frame_id long, b int").parquet(str(tmp_path / "in"))
        counts = index.window_counts(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        counts.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("frame_id", "points").collect()
    assert sorted(map(tuple, got)) == [(1, 2), (2, 1)]


@pytest.mark.parametrize("name", sorted(modules.MODULES))
def test_module_finds_the_turned_frame(spark, name):
    points = fx.points(spark, SF).filter("frame_id < 6")
    turned = points.selectExpr("frame_id", "-y AS x", "x AS y", "z", "intensity")
    module = modules.create(name)
    got = module.search(module.describe(turned), module.describe(points), 1).toPandas()
    assert len(got) == 6 and (got["q"] == got["c"]).all()
    assert np.allclose(got["yaw"], np.pi / 2, atol=np.radians(3.1))


def test_lines_of_split_files_keep_their_places(spark, tmp_path):
    lines = [f"{i} {i * 10}" if i % 7 else "" for i in range(3000)]
    for k, part in enumerate((lines[:1800], lines[1800:])):
        (tmp_path / f"part-{k}.txt").write_text("\n".join(part) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = [(r["ord"], r["value"]) for r in files._lines(spark, str(tmp_path)).orderBy("ord").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [(i, v) for i, v in enumerate(lines) if v]


def test_rows_are_placed_across_ranges(spark):
    df = spark.createDataFrame([(i * 7919 % 1000, i % 3) for i in range(1000)], "a int, b int").repartition(7)
    got = scans.placed(df, "b", "a").orderBy("ord").collect()
    assert [r["ord"] for r in got] == list(range(1000))
    assert [(r["b"], r["a"]) for r in got] == sorted((r["b"], r["a"]) for r in got)
    assert scans.placed(df.limit(0), "a").count() == 0


def test_files_are_written_by_tasks(spark, tmp_path):
    rows = spark.createDataFrame([(f"{i}.bin", bytes([i]) * i) for i in range(20)], "name string, content binary").repartition(4)
    files.write_files(rows, f"file://{tmp_path}/out")
    assert {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()} == {f"{i}.bin": bytes([i]) * i for i in range(20)}


def test_dynamic_index_holds_what_changes_leave(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 8)
    r, held = np.random.default_rng(11), {}
    index_of = DynamicIndex(spark, f"file://{tmp_path}/index", base=8)
    schema = "op string, frame_id long, k array<double>"
    assert index_of.entries().count() == 0
    for n in range(7):
        gone = [int(i) for i in r.integers(0, 60, 6)]
        new = {int(i): [float(v) for v in np.round(r.normal(size=2), 3)] for i in r.integers(0, 60, 0 if n == 5 else 14)}
        rows = [*(("delete", i, None) for i in gone), *(("insert", i, k) for i, k in new.items()), ("insert", None, [0.0, 0.0]), ("insert", 99, None), ("insert", 98, [1.0, None])]
        for _ in range(2):  # the second time it was applied already
            index_of.apply(spark.createDataFrame(rows, schema), n)
        for i in gone:
            held.pop(i, None)
        held |= new
        assert {x["frame_id"]: x["k"] for x in rows_of(index_of.entries()).collect()} == held
    levels = [s["level"] for s in index_of.manifest()["segments"]]
    assert len(levels) == len(set(levels))
    asked = spark.createDataFrame([(i, held[i]) for i in sorted(held)[:9]], "frame_id long, k array<double>")
    got = sorted((x["q"], x["rk"], x["c"]) for x in index_of.search(asked, 3).collect())
    near = lambda i: sorted((round(sum((a - b) ** 2 for a, b in zip(held[i], held[j], strict=True)), 9), j) for j in held)[:3]
    assert got == [(i, n + 1, j) for i in sorted(held)[:9] for n, (_, j) in enumerate(near(i))]


def test_dynamic_index_follows_a_stream(spark, tmp_path):
    schema = "op string, frame_id long, k array<double>"
    index_of = DynamicIndex(spark, f"file://{tmp_path}/index", base=2)
    for n, rows in enumerate(([("insert", i, [float(i), 0.0]) for i in range(6)], [("delete", 2, None), ("insert", 9, [9.0, 0.0])])):
        spark.createDataFrame(rows, schema).coalesce(1).write.json(f"{tmp_path}/in/{n}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").json(f"{tmp_path}/in")
        index_of.follow(stream, f"{tmp_path}/check").awaitTermination()
    assert sorted(x["frame_id"] for x in rows_of(index_of.entries()).collect()) == [0, 1, 3, 4, 5, 9]
