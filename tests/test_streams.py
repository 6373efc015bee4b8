"""Streamed rings and thinning equal those of whole frames, however the stream is cut."""

from datetime import UTC, datetime, timedelta
from types import SimpleNamespace

import numpy as np
import pandas as pd

from terraloc.operators import features, scans
from terraloc.streaming import scans as streamed

START = datetime(2020, 1, 1, tzinfo=UTC)
SCHEMA = "frame_id long, pt long, x double, y double, z double, ts timestamp, ring string"


def cloud(frames: int, n: int, seed: int = 3) -> list[tuple]:
    rng = np.random.default_rng(seed)
    rows = []
    for f in range(frames):
        for pt, (x, y, z) in enumerate(np.cumsum(rng.normal(0, 0.6, (n, 3)), 0).tolist(), 1):
            rows.append((f, pt, x, y, z, START + timedelta(milliseconds=pt), "other"))
    return rows


def run(spark, tmp_path, parts: list[list[tuple]], **options) -> dict:
    source = str(tmp_path / "in")
    for part in parts:  # a batch each, with a start from the checkpoint
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        streamed.follow(stream, str(tmp_path / "out"), str(tmp_path / "check"), **options).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len({(r.frame_id, r.pt) for r in rows}) == len(rows)
    return {(r.frame_id, r.pt): (r.ring, r.kept) for r in rows}


def whole(spark, rows: list[tuple]) -> dict:
    df = spark.createDataFrame(rows, SCHEMA).drop("ring", "ts")
    ring = {(r.frame_id, r.pt): r.ring for r in scans.ring_runs(df).collect()}
    kept = {(r.frame_id, r.pt) for r in features.thinned(df).collect()}
    return {k: (v, int(k in kept)) for k, v in ring.items()}


def test_cut_at_random_places_and_out_of_order(spark, tmp_path):
    rows = cloud(4, 150)
    rows[10] = (*rows[10][:2], None, *rows[10][3:])  # a point without x
    rng = np.random.default_rng(8)
    part = rng.integers(0, 3, len(rows))
    parts = [[rows[i] for i in rng.permutation(len(rows)) if part[i] == p] for p in range(3)]
    parts[2] += parts[0][:20]  # repeats of an earlier batch
    parts[1].append((None, 1, 0.0, 0.0, 0.0, START, None))
    assert run(spark, tmp_path, parts) == whole(spark, rows)


def test_state_goes_after_the_watermark(spark, tmp_path):
    """Of frame 0 point 3 never comes: what was held is numbered when the frame is over, and its state goes."""
    rows = [r for r in cloud(1, 8) if r[1] != 3]
    later = [(9, 1, 1.0, 1.0, 1.0, START + timedelta(minutes=m), None) for m in (30, 31)]
    got = run(spark, tmp_path, [rows, later[:1], later[1:]], late="1 minute", keep="1 minute")
    assert {k: v for k, v in got.items() if k[0] == 0} == whole(spark, rows)
    assert [k for k in got if k[0] == 9] == [(9, 1)]


def test_late_rows_and_an_empty_stream(spark, tmp_path):
    rows = cloud(1, 4)
    ahead = [(5, 1, 1.0, -1.0, 0.0, START + timedelta(hours=2), None)]
    got = run(spark, tmp_path, [ahead, rows, []], late="1 minute", keep="1 minute")
    assert got == {(5, 1): (-1, 1)}


def test_a_batch_reads_and_writes_one_state(spark):
    """A frame's batch costs two calls to the state, and one timer for all batches, which is set again when newer points came."""
    calls, held, timers = [], {}, []

    def value(name, schema):
        return SimpleNamespace(get=lambda: calls.append("get") or held.get(name), update=lambda v: calls.append("update") or held.update({name: v}), clear=lambda: held.pop(name, None))

    scan = streamed.FrameScan(2.0, 1000, 1)
    scan.init(SimpleNamespace(getValueState=value, registerTimer=timers.append))
    points = pd.DataFrame(cloud(1, 60), columns=["frame_id", "pt", "x", "y", "z", "ts", "ring"]).assign(ms=lambda d: d.pt)
    out = [list(scan.handleInputRows((0,), iter([points[points.pt % 3 == k]]), None)) for k in (1, 2, 0)]
    assert calls == ["get", "update"] * 3 and timers == [58 + 1000]
    rows = pd.concat([x for part in out for x in part])
    assert {(0, r.pt): (r.ring, r.kept) for r in rows.itertuples()} == whole(spark, cloud(1, 60))
    at = lambda now: (SimpleNamespace(getCurrentWatermarkInMs=lambda: now), SimpleNamespace(getExpiryTimeInMs=lambda: 1058))
    assert list(scan.handleExpiredTimer((0,), *at(1059))) == [] and held and timers == [1058, 1060]
    assert list(scan.handleExpiredTimer((0,), *at(1060))) == [] and not held
