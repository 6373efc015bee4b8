"""The engine's queries over the driver's tables, and the same in DuckDB's SQL. Numbers are rounded to 6 places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloc.functions import geometry as g
from terraloc.operators import descriptors as d
from terraloc.operators import retrieval, scans
from terraloc.plans import fixtures as fx

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to 6 places, without negative zeros."""
    return df.select(*((F.round(c, 6) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def R(x: str, name: str) -> str:  # noqa: N802
    return f"round({x}, 6) + 0e0 AS {name}"


AZ = "CASE WHEN degrees(atan2(y, x)) < 0 THEN degrees(atan2(y, x)) + 36e1 ELSE degrees(atan2(y, x)) END"
RANGE = "sqrt(x*x + y*y)"
POLAR = f"polar AS (SELECT *, CAST(greatest(least(ceil({RANGE}/8e1*20), 20), 1) AS INTEGER) - 1 AS ring, CAST(greatest(least(ceil(({AZ})/36e1*60), 60), 1) AS INTEGER) - 1 AS sector FROM cloud WHERE {RANGE} <= 8e1)"
SC = f"{fx.CLOUD}, {POLAR}, sc AS (SELECT frame_id, ring, sector, max(z) + 2e0 AS v FROM polar GROUP BY ALL)"
GRID = f"grid AS (SELECT *, CAST(least(floor({RANGE}), 79) AS INTEGER) AS r, CAST(least(floor(degrees(atan2(y, x)) + 18e1 + 5e-1), 359) AS INTEGER) AS c FROM cloud)"
MDFSC = f"{fx.CLOUD}, {GRID}, merged AS (SELECT frame_id, r, CASE WHEN r <= 19 THEN c // 8 * 8 ELSE c END AS c0, CAST(greatest(floor(max(z) + 2e0), 0) AS INTEGER) AS v FROM grid GROUP BY ALL), mdfsc AS (SELECT frame_id, r, CAST(unnest(CASE WHEN r <= 19 THEN range(c0, c0 + 8) ELSE [c0] END) AS INTEGER) AS c, v FROM merged)"
SHIFTS = f"""{SC},
cells AS (SELECT f.frame_id, r.range AS ring, s.range AS sector FROM (SELECT DISTINCT frame_id FROM sc) f, range(20) r, range(60) s),
m AS (SELECT c.frame_id, CAST(c.ring AS INTEGER) AS ring, CAST(c.sector AS INTEGER) AS sector, coalesce(v, 0e0) AS v FROM cells c LEFT JOIN sc USING (frame_id, ring, sector)),
rk AS (SELECT frame_id, list(k ORDER BY ring) AS k FROM (SELECT frame_id, ring, sum(v)/60 AS k FROM m GROUP BY ALL) GROUP BY 1),
sk AS (SELECT frame_id, sector, sum(v)/20 AS k FROM m GROUP BY ALL),
knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, c) AS rk FROM (
  SELECT a.frame_id AS q, b.frame_id AS c, round(list_sum(list_transform(range(1, 21), lambda i: (a.k[i] - b.k[i])*(a.k[i] - b.k[i]))), 9) AS d
  FROM rk a, rk b WHERE a.frame_id % 2 = 0 AND b.frame_id % 2 = 1)) WHERE rk <= 10),
coarse AS (SELECT q, c, CAST(arg_min(s, d * 1000 + s * 1e-12) AS INTEGER) AS s0 FROM (
  SELECT q, c, s, round(sqrt(sum((a.k - b.k)*(a.k - b.k))), 9) AS d
  FROM knn, range(60) t(s) JOIN sk a ON a.frame_id = q JOIN sk b ON b.frame_id = c AND (b.sector + s) % 60 = a.sector GROUP BY ALL) GROUP BY ALL),
cand AS (SELECT q, c, CAST((s0 + t.o + 57) % 60 AS INTEGER) AS shift FROM coarse, range(7) t(o)),
cols AS (SELECT q, c, shift, a.sector, sum(a.v*b.v) AS ab, sqrt(sum(a.v*a.v)) AS na, sqrt(sum(b.v*b.v)) AS nb
  FROM cand JOIN m a ON a.frame_id = q JOIN m b ON b.frame_id = c AND b.ring = a.ring AND (b.sector + shift) % 60 = a.sector GROUP BY ALL),
fine AS (SELECT q, c, shift, round(1 - avg(ab/(na*nb)), 9) AS dist FROM cols WHERE na > 0 AND nb > 0 GROUP BY ALL),
aligned AS (SELECT q, c, dist, shift FROM (SELECT *, row_number() OVER (PARTITION BY q, c ORDER BY dist, shift) AS n FROM fine) WHERE n = 1)"""


@query(f"WITH {fx.CLOUD} SELECT frame_id, pt, {R('x', 'x')}, {R('y', 'y')}, {R('z', 'z')}, {R('intensity', 'intensity')} FROM cloud")
def cloud_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fx.cloud(spark, sf_dir))


@query(f"WITH {fx.CLOUD}, {POLAR} SELECT frame_id, pt, ring, sector FROM polar")
def polar_project(spark, sf_dir):
    return d.polar(fx.cloud(spark, sf_dir)).select("frame_id", "pt", "ring", "sector")


@query(f"WITH {SC} SELECT frame_id, ring, sector, {R('v', 'v')} FROM sc")
def sc_descriptor(spark, sf_dir):
    return rounded(d.height_max(fx.points(spark, sf_dir)))


@query(f"WITH {fx.CLOUD}, {POLAR} SELECT frame_id, ring, sector, {R('max(intensity)', 'v')} FROM polar GROUP BY ALL")
def isc_descriptor(spark, sf_dir):
    return rounded(d.intensity_max(fx.points(spark, sf_dir)))


@query(f"""WITH {fx.CLOUD}, e AS (SELECT *, degrees(atan2(z + 2e0, {RANGE})) AS el FROM cloud WHERE {RANGE} BETWEEN 2e0 AND 8e1)
SELECT frame_id, CAST(least(greatest(floor((CASE WHEN el < 0 THEN el + 36e1 ELSE el END)/45e0*20), 0), 19) AS INTEGER) AS ring,
CAST(least(greatest(floor(({AZ})/36e1*60), 0), 59) AS INTEGER) AS sector, {R('avg(z)', 'v')} FROM e GROUP BY ALL""")
def mercator_descriptor(spark, sf_dir):
    return rounded(d.mean_height(fx.points(spark, sf_dir)))


@query(f"WITH {fx.CLOUD}, {GRID} SELECT frame_id, r, c, CAST(bit_or(1 << CAST(least(greatest(ceil(z + 5e0), 0), 7) AS INTEGER)) AS INTEGER) AS v FROM grid GROUP BY ALL")
def iris_image(spark, sf_dir):
    return d.bit_set(fx.points(spark, sf_dir))


@query(f"WITH {MDFSC} SELECT frame_id, r, c, v FROM mdfsc")
def mdfsc_image(spark, sf_dir):
    return d.nonuniform_max(fx.points(spark, sf_dir))


@query(f"WITH {MDFSC} SELECT frame_id, r, CAST(sum(v) AS BIGINT) AS k FROM mdfsc GROUP BY ALL")
def mdfsc_key(spark, sf_dir):
    return d.row_sums(d.nonuniform_max(fx.points(spark, sf_dir)))


@query(f"WITH {SC} SELECT frame_id, ring, {R('sum(v)/60', 'k')} FROM sc GROUP BY ALL")
def ring_key(spark, sf_dir):
    return rounded(d.ring_key(d.height_max(fx.points(spark, sf_dir))))


@query(f"WITH {SC} SELECT frame_id, sector, {R('sum(v)/20', 'k')} FROM sc GROUP BY ALL")
def sector_key(spark, sf_dir):
    return rounded(d.sector_key(d.height_max(fx.points(spark, sf_dir))))


def _neighbours(described: DataFrame) -> DataFrame:
    return retrieval.knn_within(described, "frame_id % 2 = 0", "frame_id % 2 = 1")


def _aligned(spark, sf_dir) -> DataFrame:
    described = d.matrices(d.height_max(fx.points(spark, sf_dir)))
    return retrieval.rerank(_neighbours(described), described)


@query(f"WITH {SHIFTS} SELECT q, c, {R('d', 'd')}, CAST(rk AS INTEGER) AS rk FROM knn")
def knn_ringkey(spark, sf_dir):
    return rounded(_neighbours(d.matrices(d.height_max(fx.points(spark, sf_dir)))))


@query(f"WITH {SHIFTS} SELECT q, c, {R('dist', 'dist')}, shift FROM aligned")
def sc_distance(spark, sf_dir):
    return rounded(_aligned(spark, sf_dir))


@query(f"WITH {SHIFTS}, t AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, c) AS rk FROM aligned) SELECT q, c, {R('dist', 'dist')}, shift, CAST(rk AS INTEGER) AS rk FROM t WHERE rk <= 5")
def sc_search_topn(spark, sf_dir):
    return rounded(retrieval.top(_aligned(spark, sf_dir), 5))


@query(f"WITH {SHIFTS}, t AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, c) AS rk FROM aligned) SELECT q, c, {R('dist', 'dist')}, {R('radians(shift*6e0)', 'yaw')} FROM t WHERE rk = 1")
def sc_best_match(spark, sf_dir):
    best = retrieval.top(_aligned(spark, sf_dir), 1)
    return rounded(best.select("q", "c", "dist", F.radians(F.col("shift") * (360.0 / d.SECTORS)).alias("yaw")))


def _embedding_sql(term: str) -> str:
    return f"""WITH e AS (SELECT vec_id AS frame_id, CAST(embedding AS DOUBLE[]) AS k FROM embeddings),
p AS (SELECT a.frame_id AS q, b.frame_id AS c, round(list_sum(list_transform(range(1, 65), lambda i: {term})), 9) AS d FROM e a, e b WHERE a.frame_id % 50 = 0 AND a.frame_id <> b.frame_id),
t AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, c) AS rk FROM p) SELECT q, c, {R('d', 'd')}, CAST(rk AS INTEGER) AS rk FROM t WHERE rk <= 10"""


def _embedding_knn(spark, sf_dir, metric):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("frame_id"), F.col("embedding").cast("array<double>").alias("k"))
    return rounded(retrieval.knn(e.filter("frame_id % 50 = 0"), e, metric=metric, without_own=True))


@query(_embedding_sql("(a.k[i] - b.k[i])*(a.k[i] - b.k[i])"))
def knn_embeddings(spark, sf_dir):
    return _embedding_knn(spark, sf_dir, "l2")


@query(_embedding_sql("abs(a.k[i] - b.k[i])"))
def knn_embeddings_l1(spark, sf_dir):
    return _embedding_knn(spark, sf_dir, "l1")


RINGED = f"{fx.CLOUD}, u AS (SELECT *, atan2(y, x) > 0 AS up, lag(atan2(y, x) > 0) OVER w AS was FROM cloud WINDOW w AS (PARTITION BY frame_id ORDER BY pt))"


@query(f"WITH {RINGED} SELECT frame_id, pt, CAST(sum(CASE WHEN up AND NOT coalesce(was, NOT up) THEN 1 ELSE 0 END) OVER (PARTITION BY frame_id ORDER BY pt) - 1 AS INTEGER) AS ring FROM u")
def ring_assignment(spark, sf_dir):
    return scans.ring_runs(fx.cloud(spark, sf_dir)).select("frame_id", "pt", "ring")


@query(f"""WITH {fx.CLOUD}, t AS (SELECT *, CAST(least(floor({RANGE}/2e0), 63) AS INTEGER) AS ring, CAST(floor(({AZ}) + 5e-1) AS INTEGER) % 360 AS col FROM cloud)
SELECT frame_id, ring, col, max(pt) AS pt, {R('arg_max(x, pt)', 'x')}, {R('arg_max(y, pt)', 'y')}, {R('arg_max(z, pt)', 'z')} FROM t GROUP BY ALL""")
def structured_grid(spark, sf_dir):
    return rounded(scans.last_written(fx.cloud(spark, sf_dir)))


@query(f"WITH {fx.CLOUD}, t AS (SELECT *, CAST(floor((x + 1e2)/2e0 + 1e0) AS INTEGER) AS bx, CAST(floor((y + 1e2)/2e0 + 1e0) AS INTEGER) AS \"by\" FROM cloud) SELECT frame_id, bx, \"by\", {R('greatest(max(z) + 2e0, 0)', 'v')} FROM t WHERE bx BETWEEN 0 AND 100 AND \"by\" BETWEEN 0 AND 100 GROUP BY ALL")
def bev_height(spark, sf_dir):
    return rounded(d.bev_height(fx.points(spark, sf_dir)))


@query(f"WITH {fx.CLOUD}, t AS (SELECT *, CAST(greatest(least(floor((x + 75e0)/2e0), 74), 0) AS INTEGER) AS gx, CAST(greatest(least(floor((y + 5e1)/2e0), 49), 0) AS INTEGER) AS gy FROM cloud) SELECT frame_id, gx, gy, {R('avg(z)', 'v')} FROM t GROUP BY ALL")
def ground_grid_avg(spark, sf_dir):
    return rounded(d.ground_grid(fx.points(spark, sf_dir)))


@query(f"WITH {fx.CLOUD}, t AS (SELECT *, CAST(floor(x/1e1) AS INTEGER) AS vx, CAST(floor(y/1e1) AS INTEGER) AS vy, CAST(floor(z/1e1) AS INTEGER) AS vz FROM cloud) SELECT frame_id, vx, vy, vz, {R('avg(x)', 'x')}, {R('avg(y)', 'y')}, {R('avg(z)', 'z')} FROM t GROUP BY ALL")
def voxel_downsample(spark, sf_dir):
    return rounded(d.voxel_centroids(fx.points(spark, sf_dir), 10.0))


DEPTH = f"{fx.CLOUD}, dep AS (SELECT *, sqrt(x*x + y*y + z*z) AS r FROM cloud)"


@query(f"WITH {DEPTH}, t AS (SELECT frame_id, pt, r, sum(r) OVER w - 11*r AS s, count(*) OVER w AS n FROM dep WINDOW w AS (PARTITION BY frame_id ORDER BY pt ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)) SELECT frame_id, pt, {R('CASE WHEN n = 11 THEN s*s END', 'curvature')} FROM t")
def curvature(spark, sf_dir):
    return rounded(scans.curvature(fx.cloud(spark, sf_dir)).select("frame_id", "pt", "curvature"))


SWEPT = f"{fx.CLOUD}, swept AS (SELECT * REPLACE (row_number() OVER (PARTITION BY frame_id ORDER BY pt % 2, {AZ}, pt) AS pt) FROM cloud)"


@query(f"""WITH {SWEPT}, u AS (SELECT *, sqrt(x*x + y*y + z*z) AS r, (degrees(atan2(x, y)) - 9e1)/2e-1 AS t FROM swept),
k AS (SELECT *, CAST(900 - CASE WHEN t >= 0 THEN floor(t + 5e-1) ELSE ceil(t - 5e-1) END AS INTEGER) AS k FROM u), c AS (SELECT *, CASE WHEN k >= 1800 THEN k - 1800 WHEN k < 0 THEN 0 ELSE k END AS col FROM k),
n AS (SELECT *, lead(r) OVER w AS ahead, lag(r) OVER w AS behind, abs(lead(col) OVER w - col) < 10 AS near FROM c WINDOW w AS (PARTITION BY frame_id ORDER BY pt)),
j AS (SELECT *, CASE WHEN near AND r - ahead > 3e-1 THEN 1 ELSE 0 END AS l, CASE WHEN near AND ahead - r > 3e-1 THEN 1 ELSE 0 END AS rt, CASE WHEN abs(behind - r) > 2e-2*r AND abs(ahead - r) > 2e-2*r THEN 1 ELSE 0 END AS b FROM n)
SELECT frame_id, pt, CAST(greatest(coalesce(max(l) OVER (w ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING), 0), coalesce(max(rt) OVER (w ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), 0), b) AS INTEGER) AS masked FROM j WINDOW w AS (PARTITION BY frame_id ORDER BY pt)""")
def occlusion_mask(spark, sf_dir):
    """Points in two turns of rising azimuth, so that neighbours' columns lie near or far."""
    return scans.occlusion(fx.swept(spark, sf_dir)).select("frame_id", "pt", "masked")


def _trace_sql(clamp: bool) -> str:
    p0, p1 = ("coalesce(t0, t1)", "coalesce(t1, t0)") if clamp else ("t0", "t1")
    return f"""WITH p AS (SELECT epoch_us(ts) AS t, max(value) AS value FROM events WHERE event_type = 'click' GROUP BY 1),
s AS (SELECT event_id AS id, epoch_us(ts) AS t FROM events WHERE event_type = 'view'),
b AS (SELECT s.id, s.t, a.t AS t0 FROM s ASOF LEFT JOIN p a ON s.t >= a.t), c AS (SELECT b.*, n.t AS t1 FROM b ASOF LEFT JOIN p n ON b.t <= n.t),
e AS (SELECT id, t, {p0} AS t0, {p1} AS t1 FROM c)
SELECT e.id, e.t, {R('x.value*(1 - w) + y.value*w', 'value')} FROM (SELECT *, coalesce(CAST(t - t0 AS DOUBLE)/nullif(t1 - t0, 0), 0e0) AS w FROM e) e JOIN p x ON x.t = t0 JOIN p y ON y.t = t1"""


def _trace(spark, sf_dir, clamp):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("t", F.expr("unix_micros(to_utc_timestamp(CAST(ts AS TIMESTAMP), 'UTC'))"))
    times = e.filter("event_type = 'view'").select(F.col("event_id").alias("id"), "t")
    return rounded(scans.interpolate(e.filter("event_type = 'click'").select("t", "value"), times, clamp=clamp))


@query(_trace_sql(False))
def trace_interpolate(spark, sf_dir):
    return _trace(spark, sf_dir, False)


@query(_trace_sql(True))
def trace_interpolate_clamped(spark, sf_dir):
    return _trace(spark, sf_dir, True)


@query(f"WITH {fx.FRAMES} SELECT frame_id, CASE WHEN frame_id % 10 = 3 THEN 'query' WHEN frame_id % 2 = 1 THEN 'map' ELSE 'none' END AS role FROM frames")
def map_query_split(spark, sf_dir):
    f = fx.frames(spark, sf_dir)
    held = f.filter("frame_id % 10 = 3")
    queries = f.join(held, "frame_id", "left_semi").withColumn("role", F.lit("query"))
    rest = f.join(held, "frame_id", "left_anti").withColumn("role", F.when(F.col("frame_id") % 2 == 1, "map").otherwise("none"))
    return queries.unionByName(rest)


ROT = ["cos(yaw)*cos(pitch)", "cos(yaw)*sin(pitch)*sin(roll) - sin(yaw)*cos(roll)", "cos(yaw)*sin(pitch)*cos(roll) + sin(yaw)*sin(roll)", "sin(yaw)*cos(pitch)", "sin(yaw)*sin(pitch)*sin(roll) + cos(yaw)*cos(roll)", "sin(yaw)*sin(pitch)*cos(roll) - cos(yaw)*sin(roll)", "-sin(pitch)", "cos(pitch)*sin(roll)", "cos(pitch)*cos(roll)"]


@query(f"WITH {fx.POSES} SELECT frame_id, {', '.join(R(m, f'm{i // 3}{i % 3}') for i, m in enumerate(ROT))} FROM poses")
def pose_matrix(spark, sf_dir):
    m = g.rotation(F.col("roll"), F.col("pitch"), F.col("yaw"))
    return rounded(fx.poses(spark, sf_dir).select("frame_id", *(m[i][j].alias(f"m{i}{j}") for i in range(3) for j in range(3))))


@query(f"WITH {fx.POSES} SELECT frame_id, {R('roll', 'roll')}, {R('pitch', 'pitch')}, {R('yaw', 'yaw')} FROM poses")
def pose_roundtrip(spark, sf_dir):
    back = g.angles(g.rotation(F.col("roll"), F.col("pitch"), F.col("yaw")))
    return rounded(fx.poses(spark, sf_dir).select("frame_id", *(c.alias(n) for c, n in zip(back, ("roll", "pitch", "yaw"), strict=True))))


@query(f"""WITH {fx.POSES}, h AS (SELECT frame_id, cos(roll/2) AS a, sin(roll/2) AS b, cos(pitch/2) AS c, sin(pitch/2) AS d, cos(yaw/2) AS e, sin(yaw/2) AS f FROM poses)
SELECT frame_id, {R('b*c*e - a*d*f', 'qx')}, {R('a*d*e + b*c*f', 'qy')}, {R('a*c*f - b*d*e', 'qz')}, {R('a*c*e + b*d*f', 'qw')} FROM h""")
def quaternion(spark, sf_dir):
    q = g.quaternion(F.col("roll"), F.col("pitch"), F.col("yaw"))
    return rounded(fx.poses(spark, sf_dir).select("frame_id", *(c.alias(n) for c, n in zip(q, ("qx", "qy", "qz", "qw"), strict=True))))


@query(f"""WITH {fx.CLOUD}, {fx.POSES}, j AS (SELECT c.frame_id, c.pt, c.x AS px, c.y AS py, c.z AS pz, p.* EXCLUDE (frame_id) FROM cloud c JOIN poses p USING (frame_id))
SELECT frame_id, pt, {', '.join(R(f'({ROT[3 * i]})*px + ({ROT[3 * i + 1]})*py + ({ROT[3 * i + 2]})*pz + {n}', n) for i, n in enumerate('xyz'))} FROM j""")
def transform_points(spark, sf_dir):
    p = fx.poses(spark, sf_dir).select("frame_id", *(F.col(c).alias(f"t_{c}") for c in fx.POSE))
    m = g.rotation(F.col("t_roll"), F.col("t_pitch"), F.col("t_yaw"))
    moved = [m[i][0] * F.col("x") + m[i][1] * F.col("y") + m[i][2] * F.col("z") + F.col(f"t_{n}") for i, n in enumerate("xyz")]
    return rounded(fx.cloud(spark, sf_dir).join(p, "frame_id").select("frame_id", "pt", *(c.alias(n) for c, n in zip(moved, "xyz", strict=True))))


ECEF = "(6378137e0/sqrt(1 - E2*sin(la)*sin(la)) + alt)*cos(la)*cos(lo) AS ex, (6378137e0/sqrt(1 - E2*sin(la)*sin(la)) + alt)*cos(la)*sin(lo) AS ey, (6378137e0/sqrt(1 - E2*sin(la)*sin(la))*(1 - E2) + alt)*sin(la) AS ez".replace("E2", "(1 - (63567523142e-4*63567523142e-4)/(6378137e0*6378137e0))")


@query(f"""WITH {fx.FRAMES}, ll AS (SELECT frame_id, radians({fx.GPS['lat']}) AS la, radians({fx.GPS['lon']}) AS lo, {fx.GPS['alt']} AS alt FROM frames),
z AS (SELECT radians(39e0) AS la, radians(116e0) AS lo, 4e1 AS alt), o AS (SELECT {ECEF} FROM z), p AS (SELECT frame_id, la, lo, {ECEF} FROM ll),
q AS (SELECT frame_id, la, lo, o.ex - p.ex AS dx, o.ey - p.ey AS dy, o.ez - p.ez AS dz FROM p, o)
SELECT frame_id, round(-sin(lo)*dx + cos(lo)*dy, 4) + 0e0 AS x, round(-sin(la)*cos(lo)*dx - sin(la)*sin(lo)*dy + cos(la)*dz, 4) + 0e0 AS y FROM q""")
def wgs84_local(spark, sf_dir):
    p = fx.frames(spark, sf_dir).select("frame_id", *(F.expr(v).alias(k) for k, v in fx.GPS.items()))
    origin = g.to_ecef(F.lit(39.0), F.lit(116.0), F.lit(40.0))
    e, n, _ = g.to_tangent(origin, g.to_ecef(F.col("lat"), F.col("lon"), F.col("alt")), F.col("lat"), F.col("lon"))
    return p.select("frame_id", (F.round(e, 4) + 0.0).alias("x"), (F.round(n, 4) + 0.0).alias("y"))


@query(f"""WITH {fx.POSES}, k AS (SELECT frame_id, x, y, z, row_number() OVER (ORDER BY frame_id) - 1 AS ord FROM poses WHERE frame_id % 2 = 1), n AS (SELECT count(*) AS n FROM k),
m AS (SELECT frame_id AS q, greatest(least(frame_id // 2 - 4, n - 8), 0) AS s FROM frames, n WHERE frame_id % 2 = 0)
SELECT q, k.frame_id AS a, {R('k.x', 'x')}, {R('k.y', 'y')}, {R('k.z', 'z')} FROM m JOIN k ON k.ord >= s AND k.ord < s + 8""")
def anchor_window(spark, sf_dir):
    """Eight map frames around position frame_id / 2 of the map, clamped to its ends; joined by exploded positions."""
    f = fx.poses(spark, sf_dir).select("frame_id", "x", "y", "z")
    entries = f.filter("frame_id % 2 = 1")
    ordered = scans.ordinal(entries, "frame_id")
    n = F.broadcast(entries.agg(F.count("*").alias("n")))
    start = F.greatest(F.least(F.floor(F.col("frame_id") / 2) - 4, F.col("n") - 8), F.lit(0))
    wanted = fx.frames(spark, sf_dir).filter("frame_id % 2 = 0").crossJoin(n).select(F.col("frame_id").alias("q"), F.explode(F.sequence(start, start + 7)).alias("ord"))
    return rounded(wanted.join(ordered, "ord").select("q", F.col("frame_id").alias("a"), "x", "y", "z"))
