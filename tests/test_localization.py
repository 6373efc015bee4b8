"""Operators that SQL can't tell, against plain versions and planted answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraloc.functions import metrics
from terraloc.operators import codes, features, images, modules, multilateration, registration, retrieval, scans
from terraloc.plans import fixtures as fx
from terraloc.plans import localization
from terraloc.plans.localization import _moved_pairs
from terraloc.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain_position(c, r, p, rounds=30):
    """Descent of one row, number by number."""
    last, p = 1e5, list(p)
    for k in range(rounds):
        step, loss = [0.0, 0.0, 0.0], 0.0
        for (x, y, z), radius in zip(c, r, strict=True):
            d = ((x - p[0]) ** 2 + (y - p[1]) ** 2 + (z - p[2]) ** 2) ** 0.5
            loss += (d - radius) ** 2
            for i, o in enumerate((x, y, z)):
                step[i] -= (d - radius) * (p[i] - o) / d
        if k > 5 and abs(loss - last) < 5e-4:
            break
        p, last = [v + 0.9 / len(r) * s for v, s in zip(p, step, strict=True)], loss
    return p


def test_multilateration_by_hand():
    # Of four spheres both triples are the first three, so either of two mirrored points may come out; thus five or more.
    rng = np.random.default_rng(3)
    rows = [rng.random((n, 3)) * 50 for n in (5, 6, 7, 8, 8, 12)]
    truth = rng.random((len(rows), 3)) * 50
    exact = [np.linalg.norm(c - t, axis=1) for c, t in zip(rows, truth, strict=True)]
    p, ok = multilateration.positions(rows, exact)
    assert ok.all() and np.abs(p - truth).max() < 1e-6
    noisy = [r + rng.normal(0, 0.1, len(r)) for r in exact]
    p, ok = multilateration.positions(rows, noisy)
    for i, (c, r) in enumerate(zip(rows, noisy, strict=True)):
        start = multilateration._guess(c, r)
        assert ok[i] and np.allclose(p[i], plain_position(c, r, start), atol=1e-9)


def test_multilateration_without_an_answer():
    line = np.arange(5.0)[:, None] * np.ones(3)
    p, ok = multilateration.positions([line, np.zeros((0, 3)), np.eye(3)], [np.ones(5), np.zeros(0), np.ones(3)])
    assert not ok.any() and not p.any()


def test_solve_skips_missing_spheres(spark):
    s = "struct<x:double,y:double,z:double,radius:double>"
    rows = [(1, [(0.0, 0.0, 0.0, 3 ** 0.5), None, (2.0, 0.0, 0.0, 3 ** 0.5), (0.0, 2.0, 0.0, 3 ** 0.5), (None, 1.0, 1.0, 1.0), (0.0, 0.0, 3.0, 6 ** 0.5)]), (2, None), (3, [])]
    got = {r["q"]: r for r in multilateration.solve(spark.createDataFrame(rows, f"q long, spheres array<{s}>")).collect()}
    assert got[1]["ok"] and abs(got[1]["x"] - 1) + abs(got[1]["y"] - 1) + abs(got[1]["z"] - 1) < 1e-6
    assert not got[2]["ok"] and not got[3]["ok"]


def test_meet_and_its_columns_agree(spark):
    rng = np.random.default_rng(4)
    c, r = rng.random((20, 3, 3)) * 10, rng.random((20, 3)) * 4 + 6
    rows = [(i, *(tuple(map(float, (*c[i, k], r[i, k]))) for k in range(3))) for i in range(20)]
    s = "struct<x:double,y:double,z:double,radius:double>"
    got = multilateration.trilaterate(spark.createDataFrame(rows, f"i int, a {s}, b {s}, c {s}")).orderBy("i").collect()
    p1, _, ok = multilateration.meet(c, r)
    assert ok.all()
    met = [g for g in got if g["p1"]]
    assert len(met) > 5 and all(np.allclose(p1[g["i"]], list(g["p1"])) for g in met)


def plain_features(xyz, ring):
    """The rules of scan_features, point by point."""
    order = sorted((i for i in range(len(xyz)) if (xyz[i] ** 2).sum() >= 2 and 0 <= ring[i] < 64), key=lambda i: (ring[i], i))
    p = xyz[order]
    n = len(p)
    r = [float(np.sqrt((q**2).sum())) for q in p]
    col = [int(features.scan_column(np.array([q[0]]), np.array([q[1]]))[0]) for q in p]
    curve = [(sum(r[i - 5 : i + 6]) - 11 * r[i]) ** 2 if 5 <= i < n - 5 else None for i in range(n)]
    hidden, kind = [False] * n, [0] * n
    for i in range(n - 1):
        if abs(col[i + 1] - col[i]) < 10:
            if r[i] - r[i + 1] > 0.3:
                for j in range(max(i - 5, 0), i + 1):
                    hidden[j] = True
            elif r[i + 1] - r[i] > 0.3:
                for j in range(i + 1, min(i + 7, n)):
                    hidden[j] = True
    for i in range(1, n - 1):
        hidden[i] |= abs(r[i - 1] - r[i]) > 0.02 * r[i] and abs(r[i + 1] - r[i]) > 0.02 * r[i]

    def hide(i):
        hidden[i] = True
        for way in (1, -1):
            for k in range(1, 6):
                j = i + way * k
                if not 0 <= j < n or abs(col[j] - col[j - way]) > 10:
                    break
                hidden[j] = True

    for g in sorted({int(ring[i]) for i in order}):
        mine = [k for k in range(n) if ring[order[k]] == g]
        for j in range(6):
            part = mine[len(mine) * j // 6 : len(mine) * (j + 1) // 6]
            if len(part) < 2:
                continue
            ranked = sorted((k for k in part if curve[k] is not None), key=lambda k: (curve[k], k))
            chosen = 0
            for k in reversed(ranked):
                if not hidden[k] and curve[k] > 1 and r[k] > 2 and chosen < 20:
                    chosen, kind[k] = chosen + 1, 2
                    hide(k)
            for k in ranked:
                if not hidden[k] and curve[k] < 0.1 and r[k] > 2:
                    hide(k)
            for k in part:
                kind[k] = kind[k] or 1
    out = np.zeros(len(xyz), int)
    out[order] = kind
    return out


def test_features_by_hand():
    rng = np.random.default_rng(8)
    for size in (0, 7, 40, 900):
        a = np.sort(rng.random(size)) * 2 * np.pi
        reach = 6 + np.round(np.sin(a * 9) * 2) * 0.25 + rng.normal(0, 0.02, size)
        xyz = np.stack([reach * np.cos(a), reach * np.sin(a), rng.normal(0, 0.05, size)], 1)
        ring = rng.integers(0, 3, size)
        got = features.scan_features(xyz, ring)
        assert (got == plain_features(xyz, ring)).all()
        assert size < 900 or {1, 2} <= set(got)


def test_thin_by_hand():
    rng = np.random.default_rng(9)
    for n in (0, 1, 30, 2000):
        p = np.cumsum(rng.normal(0, 0.05, (n, 3)), 0)
        kept, last = [], None
        for i, q in enumerate(p):
            if last is None or ((q - last) ** 2).sum() >= 4.0:
                kept.append(i)
                last = q
        assert list(np.flatnonzero(features.thin(p))) == kept


def test_rings_of_arrays_and_columns_agree(spark):
    cloud = fx.cloud(spark, SF).filter("frame_id = 3").orderBy("pt").toPandas()
    want = scans.scan_rings(fx.cloud(spark, SF).filter("frame_id = 3")).orderBy("pt").toPandas()["ring"]
    assert (features.kitti_rings(cloud["x"].values, cloud["y"].values) == want.values).all()


def test_nearest_by_hand():
    rng = np.random.default_rng(1)
    a, b = rng.random((300, 3)) * 6 - 3, rng.random((400, 3)) * 6 - 3
    cells = registration.Cells(b, 1.0)
    idx, dist = cells.nearest(a, 5)
    for i, q in enumerate(a):
        d = np.sort(((b - q) ** 2).sum(1))
        d = d[d < 1][:5]
        assert np.allclose(dist[i, : len(d)], d) and (idx[i, len(d) :] == -1).all()


@pytest.mark.parametrize("name", ["loam", "ndt"])
def test_registration_finds_planted_motion(spark, name):
    wide = localization.WIDE_MOTION
    got = _moved_pairs(spark, SF, name, 1.0, wide, edges=name == "loam").toPandas().set_index("frame_id").sort_index()
    want = fx.frames(spark, SF).select("frame_id", *(F.expr(v).alias(k) for k, v in wide.items())).toPandas().set_index("frame_id").sort_index()
    assert len(got) == len(want)
    for k in wide:
        assert np.abs(got[k] - want[k]).max() < localization.EXACT[k]


def test_rows_of_registration_tell_wrong_motions(spark):
    wide = localization.WIDE_MOTION
    planted = fx.frames(spark, SF).select("frame_id", *(F.expr(v).alias(k) for k, v in wide.items()))
    right = localization._met(planted, wide).toPandas()
    assert right[[f"{k}_met" for k in wide]].values.all()
    still = localization._met(planted.select("frame_id", *(F.lit(0.0).alias(k) for k in wide)), wide).toPandas()
    assert not still[[f"{k}_met" for k in wide]].values.any()
    off = localization._met(planted.select("frame_id", *((F.col(k) + 0.01).alias(k) for k in wide)), wide).toPandas()
    assert not off[[f"{k}_met" for k in wide]].values.any()


@pytest.mark.parametrize("name", ["loam", "ndt"])
def test_walls_that_meet_do_not_bend_the_motion(name):
    """Of 40 rooms of few points each motion is met within a millimetre; a wall's neighbours bent it by several."""
    for seed in range(40):
        rng = np.random.default_rng(seed)
        half, n = np.array([3.0, 2.5, 1.5]), 480
        p = rng.uniform(-1, 1, (n, 3)) * half
        axis = rng.integers(0, 3, n)
        p[np.arange(n), axis] = half[axis] * rng.choice([-1, 1], n)
        r, t = registration.turn(rng.uniform(-0.1, 0.1, 3)), rng.uniform(-0.2, 0.2, 3)
        clouds = [{"corner": np.empty((0, 3)), "surface": x} for x in ((p - t) @ r, p)]
        rot, shift, _, _ = registration.METHODS[name](*clouds, (np.eye(3), np.zeros(3)), registration.ROUNDS, 1.0)
        assert np.abs(rot - r).max() < 1e-3 and np.abs(shift - t).max() < 1e-3, seed


def test_few_points_are_compared_as_in_cells(monkeypatch):
    rng = np.random.default_rng(3)
    a, b = rng.random((200, 3)), np.round(rng.random((300, 3)), 1)
    got = []
    for most in (0, 1000):
        monkeypatch.setattr(registration, "FEW_POINTS", most)
        cells = registration.Cells(b, 0.5)
        assert cells.whole == (most > 0)
        got.append(cells.nearest(a, 4))
    assert all((x == y).all() for x, y in zip(*got, strict=True))


def test_unknown_method():
    with pytest.raises(KeyError):
        registration.register_pairs(None, None, "none")


def test_registration_of_empty_clouds():
    none = {"corner": np.zeros((0, 3)), "surface": np.zeros((0, 3))}
    for f in registration.METHODS.values():
        rot, shift, loss, _ = f(none, none, (np.eye(3), np.zeros(3)), 30, 1.0)
        assert (rot == np.eye(3)).all() and not shift.any() and np.isnan(loss)


def test_line_terms_point_at_the_line():
    group = np.array([[[0, 0, float(k)] for k in range(5)]])
    n, d, ok = registration.line_terms(np.array([[0.1, 0.0, 2.5]]), group)
    assert ok[0] and np.allclose(n[0] / np.linalg.norm(n[0]), [1, 0, 0]) and np.isclose(d[0], 0.1 * (1 - 0.09))


def test_codes_find_planted_turns(spark):
    rng = np.random.default_rng(2)
    image = rng.random((8, 36))
    for s in (0, 1, 20):
        assert codes.spectral_shift(np.roll(image, s, 1), image) == s
    rows = [(k, [float(v) for v in np.roll(image, -s, 1).ravel()]) for k, s in ((1, 0), (2, 2), (3, 18), (4, 17))]
    coded = codes.encode(spark.createDataFrame([*rows, (5, None)], "frame_id long, v array<double>"), 8, 36)
    pairs = spark.createDataFrame([(2, 1), (3, 1), (4, 1), (5, 1)], "q long, c long")
    got = {r["q"]: r for r in codes.compare_codes(pairs, coded, 64, 36, opposite="both").collect()}
    assert (got[2]["shift"], got[2]["dist"]) == (2, 0) and (got[3]["shift"], got[3]["dist"]) == (18, 0) and (got[4]["shift"], got[4]["dist"]) == (17, 0)
    assert got[5]["dist"] is None


def test_responses_by_direct_sums():
    v = np.random.default_rng(6).random((2, 12))
    got = codes.responses(v)
    n = 12
    for s in range(4):
        gain = [np.exp(-np.log(k / n * 18 * 1.6**s) ** 2 / (2 * np.log(0.75) ** 2)) if 1 <= k <= n // 2 else 0 for k in range(n)]
        for r in range(2):
            for m in range(n):
                want = sum(gain[k] * sum(v[r, j] * np.exp(-2j * np.pi * k * j / n) for j in range(n)) * np.exp(2j * np.pi * k * m / n) for k in range(n))
                assert np.isclose(got[s, r, m], want)


def test_hidden_bits_do_not_count():
    a, all_hidden = np.array([[True, False]]), np.ones((1, 2), bool)
    assert np.isnan(codes.hamming((a, all_hidden), (a, all_hidden), [0])[0])
    assert codes.hamming((a, np.array([[True, False]])), (~a, np.zeros((1, 2), bool)), [0]) == (1.0, 0)


def test_spectral_image_by_direct_sums():
    rng = np.random.default_rng(7)
    bev = rng.random((101, 101)) * (rng.random((101, 101)) < 0.1)
    got = images.spectral_image(bev)
    k = np.arange(101) - 50
    wave = np.exp(-2j * np.pi * np.outer(k, np.arange(101)) / 101)
    amplitude = np.abs(wave @ bev @ wave.T)[31:71, 31:71]
    g = np.exp(-np.arange(-3, 4) ** 2 / 2)
    g = np.outer(g, g) / g.sum() ** 2
    wide = np.pad(amplitude, 3, mode="edge")
    soft = np.array([[(wide[i : i + 7, j : j + 7] * g).sum() for j in range(40)] for i in range(40)])
    assert got.shape == (20, 120)
    for ring, sector in ((0, 0), (7, 31), (19, 0), (19, 77)):
        r, c = (19.5 + ring / 19 * 19.5 * f(sector * np.pi / 60) for f in (np.cos, np.sin))
        i, j = min(int(r), 38), min(int(c), 38)
        u, v = r - i, c - j
        want = soft[i, j] * (1 - u) * (1 - v) + soft[i + 1, j] * u * (1 - v) + soft[i, j + 1] * (1 - u) * v + soft[i + 1, j + 1] * u * v
        assert np.isclose(got[ring, sector], np.log(want))


@pytest.mark.parametrize("least", [10, 5])
def test_localize_by_registration(spark, monkeypatch, least):
    monkeypatch.setattr(localization, "LEAST_ENTRIES", least)  # the map has five entries here
    got = localization._localized(spark, SF).toPandas().sort_values("frame_id")
    assert len(got) and (got["ok"] == (least == 5)).all()
    truth = localization._stands(spark, SF).filter("frame_id % 2 = 0").toPandas().sort_values("frame_id")
    if least == 5:
        assert (got["match_place"].values == truth["place"].values).all() and (got["match_id"] % 2 == 1).all()
    want = truth[["x", "y", "z"]].values if least == 5 else 0.0
    assert np.abs(got[["px", "py", "pz"]].values - want).max() <= 1e-6


def test_localize_goes_on_to_farther_candidates(spark, monkeypatch):
    """Where the one candidate by key is the farthest entry, of another place, frames are sought again among more."""
    near, some = retrieval.knn_of_index, "/root/testdata/sf0.01"
    monkeypatch.setattr(localization, "CANDIDATES", 1)
    monkeypatch.setattr(retrieval, "knn_of_index", lambda q, index, k: near(q, index, k) if k > 1 else near(q, index, 50).filter("rk = 50").withColumn("rk", F.lit(1)))
    got = localization._localized(spark, some).toPandas().sort_values("frame_id")
    truth = localization._stands(spark, some).filter("frame_id % 2 = 0").toPandas().sort_values("frame_id")
    assert got["ok"].all() and (got["match_place"].values == truth["place"].values).all()
    assert np.abs(got[["px", "py", "pz"]].values - truth[["x", "y", "z"]].values).max() <= 1e-6


def test_localize_needs_the_right_place(spark, monkeypatch):
    """With places of three frames most queries' own place has too few map frames, and a wrong one's clouds don't register."""
    monkeypatch.setattr(localization, "LEAST_ENTRIES", 1)
    monkeypatch.setattr(localization, "PLACE_FRAMES", 1)
    got = localization._localized(spark, SF).toPandas()
    assert len(got) and not got["ok"].any() and not got[["px", "py", "pz"]].values.any()


def test_ordinal_across_buckets(spark):
    df = spark.createDataFrame([(k,) for k in (5, -3, 900, 12, 10**9, 11)], "k long")
    got = {r["k"]: r["ord"] for r in scans.ordinal(df, "k", bucket=10).collect()}
    assert got == {k: i for i, k in enumerate(sorted(got))}


def test_radius_join_by_hand(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 8)  # so that the crowded cube is cut
    at = np.concatenate((np.random.default_rng(3).uniform(-5, 5, (200, 3)), np.zeros((60, 3)), [[2.0, 0, 0]]))
    rows = [(int(i), *map(float, p), i % 2) for i, p in enumerate(at)]
    e = spark.createDataFrame([*rows, (900, None, 0.0, 0.0, 0), (901, 0.0, 0.0, 0.0, None)], "c int, x double, y double, z double, g int")
    got = {(r.q, r.c) for r in retrieval.radius_join(e.withColumnRenamed("c", "q"), e, 4.0, ("g",)).collect()}
    d = ((at[:, None] - at[None]) ** 2).sum(2)
    assert got == {(i, j) for i in range(len(at)) for j in range(len(at)) if i % 2 == j % 2 and d[i, j] < 4.0} and (200, 260) not in got
    assert retrieval.radius_join(e.withColumnRenamed("c", "q"), e.limit(0), 4.0).count() == 0


def test_radius_join_across_cubes(spark):
    """Points far apart and on both sides of cubes' borders, of other types of ids."""
    at = np.random.default_rng(17).uniform(-20, 20, (400, 3)) * [1.0, 1.0, 0.1]
    e = spark.createDataFrame([(f"p{i}", *map(float, p)) for i, p in enumerate(at)], "c string, x double, y double, z double")
    found = retrieval.radius_join(e.withColumnRenamed("c", "q"), e, 1.0)
    got = {(r.q, r.c): r.d for r in found.collect()}
    d = ((at[:, None] - at[None]) ** 2).sum(2)
    assert set(got) == {(f"p{i}", f"p{j}") for i, j in zip(*np.nonzero(d < 1.0), strict=True)} and found.count() == len(got)


def test_saved_index_finds_the_same(spark, tmp_path):
    e = spark.createDataFrame([(i, [float(i * i % 17), float(i % 5)]) for i in range(40)], "frame_id long, k array<double>")
    retrieval.save_index(e.filter("frame_id > 9"), str(tmp_path / "index"))
    got = retrieval.knn_of_index(e.filter("frame_id < 10"), retrieval.load_index(spark, str(tmp_path / "index")), 3)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, retrieval.knn(e.filter("frame_id < 10"), e.filter("frame_id > 9"), 3).collect()))
    with pytest.raises(ValueError):
        retrieval.knn(e, e, metric="none")


def test_cosine_of_an_empty_row_is_null(spark):
    one = spark.createDataFrame([([1.0, 0.0, 0.0, 0.0], [1.0, 2.0, 3.0, 4.0])], "a array<double>, b array<double>")
    r = one.select(metrics.cosine_by_rows(F.col("a"), F.col("b"), 2, 2), metrics.cosine_by_columns(F.col("a"), F.col("b"), 2, 2), metrics.cosine_by_rows(F.col("b"), F.col("b"), 2, 2)).first()
    assert r[0] is None and r[1] is None and abs(r[2]) < 1e-12


def test_angles_turn_the_short_way(spark):
    a = spark.createDataFrame([([3.0], [-3.0]), ([-3.0], [3.0]), ([1.0], [2.0])], "a array<double>, b array<double>")
    got = [r[0] for r in a.select(metrics.so2(F.col("a"), F.col("b"))).collect()]
    assert np.allclose(got, [2 * np.pi - 6, 6 - 2 * np.pi, 1])


def plain_align(a, b, around):
    """Shift and distance of two matrices, shift by shift."""
    sectors = a.shape[1]
    ka, kb = a.mean(0), b.mean(0)
    off = [round(float(np.linalg.norm(ka - np.roll(kb, s))), 9) for s in range(sectors)]
    coarse, best = off.index(min(off)), None
    for s in sorted((coarse + t) % sectors for t in range(-around, around + 1)):
        r = np.roll(b, s, 1)
        cos = [a[:, j] @ r[:, j] / (np.linalg.norm(a[:, j]) * np.linalg.norm(r[:, j])) for j in range(sectors) if a[:, j].any() and r[:, j].any()]
        if cos and (best is None or round(1 - sum(cos) / len(cos), 9) < best[1]):
            best = s, round(1 - sum(cos) / len(cos), 9)
    return best or (coarse, float("nan"))


def test_align():
    rng = np.random.default_rng(5)
    a = rng.random((40, 6, 17)) * (rng.random((40, 6, 17)) < 0.2)
    b = np.stack([np.roll(x, -i, 1) if i % 2 else rng.random((6, 17)) for i, x in enumerate(a)])
    a[0], b[2] = 0, 0
    for around in (0, 3):
        shifts, dists = retrieval.align_all(a, b, around)
        for i in range(len(a)):
            s, d = plain_align(a[i], b[i], around)
            assert (shifts[i], np.isnan(dists[i])) == (s, np.isnan(d)) and (np.isnan(d) or abs(dists[i] - d) < 2e-9)


def test_matrix_sizes(spark):
    points = fx.points(spark, SF)
    turned = points.selectExpr("frame_id", "-y AS x", "x AS y", "z", "intensity")
    for name in ("scancontext", "isc", "mercator"):
        module = modules.create(name, **{"search.num_ring": 12, "num_sector": "24"})
        index = module.describe(points)
        assert {len(r.k) for r in index.select("k").collect()} == {12}
        found = module.search(module.describe(turned), index, 1).collect()
        assert found and all(r.q == r.c and abs(r.yaw - np.pi / 2) < 1e-9 for r in found)
    with pytest.raises(ValueError):
        modules.create("isc", num_sector=0)


def test_codes_all_to_all(spark):
    rng = np.random.default_rng(11)
    rows, columns = 6, 24
    codes_of = [(rng.random((rows, columns)) < 0.5, rng.random((rows, columns)) < 0.1) for _ in range(20)]
    codes_of += [tuple(np.roll(x, 7, 1) for x in codes_of[3]), (codes_of[0][0], np.ones((rows, columns), bool))]
    table = spark.createDataFrame([(i, bytearray(np.packbits(t).tobytes()), bytearray(np.packbits(m).tobytes())) for i, (t, m) in enumerate(codes_of)] + [(99, None, None)], "frame_id long, t binary, m binary")
    got = {(r.q, r.c): (r.dist, r.shift) for r in codes.compare_all(table.filter("frame_id >= 2"), table.filter("frame_id <> 5"), rows, columns, 2).collect()}
    assert len(got) == 20 * 21
    for (q, c), (dist, shift) in got.items():
        (tq, mq), (tc, mc) = codes_of[q], codes_of[c]
        start = -codes.spectral_shift(tq & ~mq, tc & ~mc) % columns
        tried = []
        for s in range(start - 2, start + 3):
            seen = ~np.roll(mq, s, 1) & ~mc
            tried.append((round(float((np.roll(tq, s, 1) ^ tc)[seen].mean()), 9) if seen.any() else float("inf"), s))
        best = min(tried, key=lambda t: t[0])
        assert (np.isnan(dist) and best[0] == float("inf")) or (dist, shift) == best
    assert got[3, 20][0] == 0 and got[20, 3][0] == 0
    assert codes.compare_all(table.limit(0), table, rows, columns, 1).count() == 0


@pytest.mark.parametrize("metric", ["l1", "l2", "so2"])
@pytest.mark.parametrize(("own", "few"), [(False, 0), (True, 0), (True, 10_000)])
def test_knn_by_balls_is_exact(spark, monkeypatch, metric, own, few):
    monkeypatch.setattr(retrieval, "BLOCK", 8)
    monkeypatch.setattr(retrieval, "ASKING", 4)
    monkeypatch.setattr(retrieval, "FEW_PAIRS", few)
    rng = np.random.default_rng(5)
    centres = rng.uniform(-50, 50, (12, 3))
    x = np.concatenate((centres[rng.integers(0, 12, 300)] + np.round(rng.normal(0, 1, (300, 3)), 1), np.zeros((20, 3))))
    rows = [(i, [float(v) for v in p]) for i, p in enumerate(x)] + [(900, None), (901, [1.0, None, 2.0]), (None, [0.0] * 3)]
    e = spark.createDataFrame(rows, "frame_id long, k array<double>").repartition(3)
    q = e.filter("frame_id % 7 = 0")
    got = {}
    for r in retrieval.knn(q, e, 5, metric, own).collect():
        got.setdefault(r["q"], []).append((r["rk"], r["d"], r["c"]))
    for i in range(0, 320, 7):
        diff = np.abs(x - x[i])
        turn = np.arctan2(np.sin(x - x[i]), np.cos(x - x[i]))[:, -1]
        d = np.round({"l1": diff.sum(1), "l2": (diff * diff).sum(1), "so2": np.abs(turn)}[metric], 9)
        near = sorted((float(v), j) for j, v in enumerate(d) if not own or j != i)[:5]
        assert sorted(got[i]) == [(n + 1, d, j) for n, (d, j) in enumerate(near)]
    some = e.filter("frame_id < 3")
    assert retrieval.knn(q, some, 5, metric).count() == 3 * q.count()
    assert retrieval.knn(q, e.filter("frame_id < 0"), 5, metric).count() == 0


@pytest.mark.parametrize("metric", ["l1", "l2"])
@pytest.mark.parametrize(("far", "size"), [(0.0, 1.0), (1e7, 1e-3), (0.0, 1e20), (0.0, 1e-30)])
def test_single_precision_only_bounds(metric, far, size):
    """Bounds hold for near keys far from the origin and for large and small ones, and are close to the distances; too large keys have none."""
    rng = np.random.default_rng(31)
    a, b = (far + rng.normal(0, size, (n, 64)) for n in (130, 70))
    exact = np.array([np.abs(b - x).sum(1) if metric == "l1" else ((b - x) ** 2).sum(1) for x in a])
    about = retrieval._at_least(a - b.mean(0), b - b.mean(0), metric)
    if size == 1e20 and metric == "l2":
        assert about is None
        return
    d, over = about
    assert d.dtype == np.float32 and (d <= exact + 1e-8).all() and (exact <= d + over[:, None] + 1e-8).all()
    assert (over <= 1e-3 * exact.mean() + 1e-8).all()


def test_panels_meet_centres_by_slices(spark, monkeypatch):
    """Distances of a panel's queries from the balls' centres are held for some queries at a time; the neighbours are the same."""
    monkeypatch.setattr(retrieval, "BLOCK", 8)
    monkeypatch.setattr(retrieval, "PRODUCTS", 64)
    rng = np.random.default_rng(33)
    x = rng.normal(0, 1, (300, 3))
    slices = list(retrieval._between(np.arange(300).astype("<i8").tobytes(), x.tobytes(), x[:20].tobytes(), 20, "l2"))
    assert all(d.size <= 64 for _, d in slices)
    assert np.allclose(np.concatenate([d for _, d in slices]), np.sqrt(((x[:, None] - x[:20]) ** 2).sum(2)))
    e = spark.createDataFrame([(i, p) for i, p in enumerate(x.tolist())], "frame_id long, k array<double>")
    got = {(r["q"], r["rk"]): r["c"] for r in retrieval.knn(e, e, 3).collect()}
    order = np.argsort(np.round(((x[:, None] - x) ** 2).sum(2), 9), 1, kind="stable")[:, :3]
    assert got == {(i, n + 1): int(order[i, n]) for i in range(300) for n in range(3)}


@pytest.mark.parametrize("metric", ["l1", "l2"])
def test_near_pairs_are_told_in_single_precision(monkeypatch, metric):
    """A panel finds what all distances tell, whose differences it computes for few pairs; before, l1 and l2 were compared in double precision throughout."""
    rng = np.random.default_rng(32)
    x, mid = rng.normal(0, 1, (1100, 64)), np.zeros(64)
    x[600] = x[5]
    monkeypatch.setattr(retrieval, "_apart", lambda a, b, m, f=retrieval._apart: f(a, b, m) if len(a) == 1 else pytest.fail("all differences were computed"))
    panel = retrieval._Panel(np.arange(100).astype("<i8").tobytes(), x[:100].tobytes(), None, 5, metric, True, 0.0)
    for at in (100, 600):
        panel.meet(np.arange(at, at + 500).astype("<i8").tobytes(), x[at : at + 500].tobytes(), mid.tobytes(), 1e3)
    for i in range(100):
        diff = x[100:] - x[i]
        d = np.round(np.abs(diff).sum(1) if metric == "l1" else np.einsum("ij,ij->i", diff, diff), 9)
        order = np.lexsort((np.arange(len(d)), d))[:5]
        assert panel.c[i].tolist() == (order + 100).tolist() and panel.d[i].tolist() == d[order].tolist()


def test_balls_of_clustered_keys_are_pruned(spark):
    rng = np.random.default_rng(6)
    centres = rng.uniform(-100, 100, (64, 20))
    clustered = centres[np.arange(64 * 600) % 64] + rng.normal(0, 0.1, (64 * 600, 20))
    uniform = rng.uniform(-1, 1, (64 * 600, 20))
    shares = []
    for x in (clustered, uniform):
        e = spark.createDataFrame([(i, p) for i, p in enumerate(x.tolist())], "frame_id long, k array<double>").repartition(2)
        shares.append(retrieval.met_share(e.filter("frame_id % 50 = 0"), e))
    print("pairs of balls read, clustered and uniform:", shares)
    assert shares[0] < 0.3


def test_balls_are_near_across_partitions(spark):
    """Keys lie in no order over 16 partitions: balls made where keys lie are as wide as all space, and each query needs most of them."""
    x = np.random.default_rng(16).uniform(-1, 1, (32_768, 3))
    e = spark.createDataFrame([(i, p) for i, p in enumerate(x.tolist())], "frame_id long, k array<double>").repartition(16)
    assert retrieval.met_share(e.filter("frame_id % 500 = 0"), e, 5) < 0.15


def test_balls_keep_every_row():
    rng = np.random.default_rng(7)
    for n in (1, 8, 9, 100, 1000):
        for x in (rng.normal(size=(n, 2)), np.zeros((n, 2))):
            groups = retrieval.balls(x, 8)
            assert sorted(np.concatenate(groups).tolist()) == list(range(n)) and max(map(len, groups)) <= 8
            assert sum(len(g) < 8 for g in groups) <= 1


@pytest.mark.parametrize("n, share", [(1, 1.0), (3, 1.0), (3, 0.0), (60, 1.0)])
def test_codes_are_aligned_only_where_numbers_of_bits_allow(spark, monkeypatch, n, share):
    """The n nearest by bounds are those of all alignments, whether few pairs are left (share 1) or all meet in blocks (0), and far fewer pairs are aligned."""
    monkeypatch.setattr(codes, "PAIRWISE", share)
    monkeypatch.setattr(codes, "COUNTED", 16)
    rng = np.random.default_rng(21)
    rows, columns, some = 70, 40, []
    for i in range(48):
        t, m = rng.random((rows, columns)) < rng.uniform(0.1, 0.9, (rows, 1)), rng.random((rows, columns)) < 0.01 * (i % 3)
        some += [(i, t, m), (100 + i, np.roll(t ^ (rng.random((rows, columns)) < 0.01), 5, 1), m)]
    some += [(300, some[0][1], np.ones((rows, columns), bool))]
    table = spark.createDataFrame([(i, bytearray(np.packbits(t).tobytes()), bytearray(np.packbits(m).tobytes())) for i, t, m in some] + [(301, None, None)], "frame_id long, t binary, m binary")
    asked, searched = table.filter("frame_id >= 100"), table.filter("frame_id < 100")
    best = lambda df: sorted((r.q, r.rk, r.c, r.dist, r["shift"]) for r in retrieval.top(df.filter("not isnan(dist)"), n).collect())
    exact = codes.compare_all(asked, searched, rows, columns, 2)
    found = codes.nearest_codes(asked, searched, rows, columns, n, 2)
    assert best(found) == best(exact)
    if n == 1:  # the third nearest is as far as any other
        assert found.filter("q < 300").count() < 48 * 48 / 4
    pairs = codes.nearest_of_pairs(exact.select("q", "c"), table, rows, columns, n, shift="spectral")
    assert best(pairs) == best(exact)
    assert n > 1 or pairs.filter("q < 300").count() < 48 * 48 / 4


@pytest.mark.parametrize("hide", [0.0, 0.2])
def test_pruned_code_search_finds_the_nearest(spark, hide):
    rng = np.random.default_rng(8)
    rows, columns, some = 12, 40, []
    for i in range(40):
        t, m = rng.random((rows, columns)) < rng.uniform(0.1, 0.9, (rows, 1)), rng.random((rows, columns)) < hide
        some.append((i, t, m))
        if i % 4 == 0:
            flip = rng.random((rows, columns)) < 0.03
            some.append((100 + i, np.roll(t ^ flip, int(rng.integers(0, 40)), 1), m))
    table = spark.createDataFrame([(i, bytearray(np.packbits(t).tobytes()), bytearray(np.packbits(m).tobytes())) for i, t, m in some], "frame_id long, t binary, m binary")
    asked = table.filter("frame_id >= 100")
    best = lambda df: sorted((r.q, r.rk, r.c, r.dist, r["shift"]) for r in retrieval.top(df.filter("not isnan(dist)"), 3).collect())
    count = spark.sparkContext.accumulator(0)
    found = best(codes.compare_all(asked, table, rows, columns, 2, n=3, compared=count))
    assert found == best(codes.compare_all(asked, table, rows, columns, 2))
    assert 0 < count.value < 10 * 50 or hide
    for i, t, m in some[:10]:
        for j, u, o in some[:10]:
            bound = codes.least_unlike(((t & ~m).sum(1)[None], m.sum(1)[None]), ((u & ~o).sum(1)[None], o.sum(1)[None]), rows * columns)[0, 0]
            d, _ = codes.hamming((t, m), (u, o), range(columns))
            assert bound <= d + 1e-9 or d != d


def test_nearest_points_by_hand(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 16)
    rng = np.random.default_rng(9)
    x = np.round(np.concatenate((rng.uniform(-4, 4, (150, 3)), rng.normal(0, 0.05, (60, 3)), rng.uniform(20, 40, (20, 3)))), 2)
    y = np.round(np.concatenate((rng.uniform(-4, 4, (40, 3)), [[0.0, 0, 0], [30, 30, 30], [-2, -2, -2]])), 2)
    e = spark.createDataFrame([*((i, *map(float, p)) for i, p in enumerate(x)), (999, None, 0.0, 0.0), (None, 0.0, 0.0, 0.0)], "c long, x double, y double, z double")
    q = spark.createDataFrame([*((i, *map(float, p)) for i, p in enumerate(y)), (999, 0.0, None, 0.0)], "q long, x double, y double, z double")
    got = sorted((r.q, r.rk, r.c, r.d) for r in retrieval.nearest_points(q, e, 5, 3.0).collect())
    want = []
    for i, p in enumerate(y):
        d = [(round(float(v), 9), j) for j, v in enumerate(((x - p) ** 2).sum(1))]
        want += [(i, n + 1, j, v) for n, (v, j) in enumerate(sorted(t for t in d if t[0] < 9)[:5])]
    assert got == want
    assert retrieval.nearest_points(q.limit(0), e, 5, 3.0).count() == 0 and retrieval.nearest_points(q, e.limit(0), 5, 3.0).count() == 0


def test_map_registration_as_in_one_task(spark):
    room = localization._room(spark, SF).filter("frame_id = 1").toPandas()[["x", "y", "z"]].values
    motion = (registration.turn(np.array([0.02, -0.01, 0.05])), np.array([0.1, -0.08, 0.05]))
    seen = (room - motion[1]) @ motion[0]
    table = lambda name, x: spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], f"{name} long, x double, y double, z double")
    rot, shift, loss, rounds = registration.register_map(table("q", seen), table("c", room), rounds=4)
    none = np.zeros((0, 3))
    r, t, l, _ = registration.register({"corner": none, "surface": seen}, {"corner": none, "surface": room}, (np.eye(3), np.zeros(3)), 4)
    assert np.allclose(rot, r, atol=1e-6) and np.allclose(shift, t, atol=1e-6) and np.isclose(loss, l, atol=1e-6)
    assert np.abs(shift - motion[1]).max() < 0.01 and rounds <= 4
    assert np.isnan(registration.register_map(table("q", none), table("c", room))[2])


def test_interpolation_of_a_crowded_day(spark):
    rng = np.random.default_rng(10)
    t = np.unique(np.concatenate((rng.integers(0, 10**6, 400), rng.integers(10**9, 10**9 + 500, 300))))
    v = rng.normal(size=len(t))
    asked = np.concatenate((t[::9], rng.integers(-10, 10**9 + 600, 500)))
    trace = spark.createDataFrame([*((int(a), float(b)) for a, b in zip(t, v, strict=True)), (None, 1.0)], "t long, value double")
    times = spark.createDataFrame([*((i, int(a)) for i, a in enumerate(asked)), (9999, None)], "id long, t long")
    for ranges in (None, 1, 9):
        got = {r["id"]: r["value"] for r in scans.interpolate(trace, times, clamp=True, ranges=ranges).collect()}
        assert sorted(got) == list(range(len(asked))) and np.allclose([got[i] for i in range(len(asked))], np.interp(asked, t, v))
        inside = {r["id"] for r in scans.interpolate(trace, times, ranges=ranges).collect()}
        assert inside == {i for i, a in enumerate(asked) if t[0] <= a <= t[-1]}
    assert scans.interpolate(trace.limit(0), times, clamp=True).count() == 0


def test_every_embedding_is_asked_for_its_labels(spark):
    sf = "/root/testdata/sf0.001"
    got = QUERIES["knn_labels_recall"](spark, sf)
    assert sorted(r.q for r in got.collect()) == sorted(r.vec_id for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id").collect())


def test_few_packs_of_centres_meet_panels(spark, monkeypatch):
    """The balls of an index in many parts come in as few packs as hold them (before: one a part, each of which met each panel's queries), and only those around a panel meet its queries."""
    monkeypatch.setattr(retrieval, "BLOCK", 8)
    monkeypatch.setattr(retrieval, "CHUNK", 32)
    monkeypatch.setattr(retrieval, "ASKING", 16)
    x = np.random.default_rng(34).uniform(-1, 1, (1500, 3))
    e = spark.createDataFrame([(i, p) for i, p in enumerate(x.tolist())], "frame_id long, k array<double>")
    index, asked = retrieval.index_of(e), retrieval._asked(retrieval._known(e.filter("frame_id % 10 = 0")), k=3)
    panels, n = asked.count(), index.count()
    packs = retrieval._centres(index, "l2", n)
    assert index.rdd.getNumPartitions() > 4 and packs.count() == 1
    told, met = retrieval._bounded(asked, index, 3, "l2", panels, n)
    assert told.count() == panels and met.count() < 0.6 * panels * n
    monkeypatch.setattr(retrieval, "CENTRES", 16)
    assert retrieval._centres(index, "l2", n).count() > 1
    want = np.argsort(np.round(((x[::10, None] - x) ** 2).sum(2), 9), 1, kind="stable")[:, :3]
    for got in (retrieval.knn(e.filter("frame_id % 10 = 0"), e, 3), *retrieval.knn_stopped(e, "frame_id % 10 = 0", 3, (0.0, 0.0))):
        assert {(r["q"], r["rk"]): r["c"] for r in got.collect()} == {(10 * i, j + 1): int(c) for i, row in enumerate(want) for j, c in enumerate(row)}
    near = retrieval.knn_within(e, "frame_id % 10 = 0", "true", 3, reach=0.1).filter("d < 0.01")
    d = np.sort(((x[::10, None] - x) ** 2).sum(2), 1)[:, :3]
    assert near.count() == int((np.round(d, 9) < 0.01).sum())


def test_plans_of_localize_hold_no_earlier_rounds(spark, monkeypatch):
    """A later round's plan held those of all rounds before it, several times each, which the driver keeps."""
    near, some = retrieval.knn_of_index, "/root/testdata/sf0.01"
    monkeypatch.setattr(localization, "CANDIDATES", 1)
    monkeypatch.setattr(retrieval, "knn_of_index", lambda q, index, k: near(q, index, k) if k > 1 else near(q, index, 50).filter("rk = 50").withColumn("rk", F.lit(1)))
    assert len(localization._localized(spark, some)._jdf.queryExecution().toString()) < 10_000
