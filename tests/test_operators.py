"""Operators against brute-force definitions on small inputs."""

import math
import random

import numpy as np

from pyspark.sql import functions as F

from aeroquilt.functions import camera as C
from aeroquilt.functions import geo
from aeroquilt.functions import radiometry as TH
from aeroquilt.operators import blocks as B
from aeroquilt.operators import matching as M
from aeroquilt.operators import raster as R
from aeroquilt.operators import spatial as S
from aeroquilt.operators import terrain as T
from aeroquilt.sources import las, text


def raster(spark, z):
    h, w = z.shape
    return spark.createDataFrame([(r, c, None if np.isnan(z[r, c]) else float(z[r, c])) for r in range(h) for c in range(w)], "row int, col int, z double")


def dense(df, h, w, name="z"):
    out = np.full((h, w), np.nan)
    for r in df.select("row", "col", name).collect():
        if r[2] is not None:
            out[r[0], r[1]] = r[2]
    return out


def test_utm_round_trip_both_hemispheres(spark):
    df = spark.createDataFrame([(-33.9, 18.4), (60.2, 5.3), (78.0, 15.0), (0.0, -179.9), (45.0, 9.0)], "lat double, lon double")
    zone, north = geo.utm_zone(F.col("lat"), F.col("lon")), F.col("lat") >= 0
    df = df.withColumn("zone", zone).withColumn("north", north)
    e, n = geo.to_utm(F.col("lat"), F.col("lon"), F.col("zone"), F.col("north"))
    back = df.withColumn("e", e).withColumn("n", n)
    lat, lon = geo.from_utm(F.col("e"), F.col("n"), F.col("zone"), F.col("north"))
    got = back.select("lat", "lon", "zone", lat.alias("a"), lon.alias("b")).collect()
    assert [r.zone for r in got] == [34, 32, 33, 1, 32]
    assert all(abs(r.lat - r.a) < 1e-7 and abs(r.lon - r.b) < 1e-7 for r in got)


def test_median_and_city_block_against_numpy(spark):
    rng = np.random.default_rng(1)
    z = rng.random((9, 11)).round(3)
    z[rng.random(z.shape) < 0.3] = np.nan
    got = dense(R.median_filter(raster(spark, z), 1), 9, 11, "median")
    for r in range(9):
        for c in range(11):
            win = z[max(0, r - 1) : r + 2, max(0, c - 1) : c + 2]
            win = win[~np.isnan(win)]
            assert (np.isnan(got[r, c]) and not len(win)) or got[r, c] == np.median(win)
    d = dense(R.city_block(raster(spark, z).withColumn("m", F.coalesce(F.col("z") > 0.8, F.lit(False))), "m"), 9, 11, "distance")
    on = [(r, c) for r in range(9) for c in range(11) if z[r, c] > 0.8]
    assert all(d[r, c] == min(abs(r - a) + abs(c - b) for a, b in on) for r in range(9) for c in range(11))


def test_on_grid_restores_missing_cells(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (2, 3, 2.0)], "row int, col int, z double")
    assert R.on_grid(df).count() == 12
    assert R.on_grid(df.limit(0)).count() == 0


def test_push_pull_keeps_measured_and_fills_all(spark):
    z = np.add.outer(np.arange(13.0), np.arange(17.0))
    holes = z.copy()
    holes[4:9, 5:11] = np.nan
    got = dense(R.push_pull(raster(spark, holes)), 13, 17)
    assert not np.isnan(got).any() and np.array_equal(got[~np.isnan(holes)], z[~np.isnan(holes)])
    assert np.abs(got - z).max() < 6


def test_terrain_model_removes_a_building(spark):
    z = np.full((40, 40), 10.0)
    z[12:24, 14:26] = 18.0
    got = T.terrain_model(raster(spark, z), 0.5, T.TerrainOptions(max_object_size=10.0, cell=1.0))
    dtm = dense(got, 40, 40, "dtm")
    assert np.nanmax(np.abs(dtm - 10)) < 0.3
    ground = {(r.row, r.col) for r in got.where("ground").collect()}
    assert (18, 20) not in ground and (2, 2) in ground


def test_knn_pairs_and_radius_against_brute_force(spark):
    random.seed(2)
    pts = [(i, random.uniform(0, 100), random.uniform(0, 30)) for i in range(60)] + [(60, 500.0, 500.0), (61, None, None)]
    got = {tuple(r) for r in S.knn_pairs(spark.createDataFrame(pts, "id long, x double, y double"), 3, 5.0).collect()}
    want = set()
    real = [p for p in pts if p[1] is not None]
    for i, x, y in real:
        near = sorted(((a - x) ** 2 + (b - y) ** 2, j) for j, a, b in real if j != i)[:3]
        want |= {(min(i, j), max(i, j)) for _, j in near}
    assert got == want


def test_components_and_consistent_tracks(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (9, 9)], "i long, j long")
    assert {tuple(r) for r in M.components(e).collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7), (9, 9)}
    edges = spark.createDataFrame([(0, 1, 1, 1, 9), (1, 1, 2, 1, 8), (2, 1, 0, 2, 7), (3, 5, 4, 5, 1)], "i int, fi int, j int, fj int, n long")
    tracks = {}
    for r in M.tracks(edges).collect():
        tracks.setdefault(r.track, set()).add((r.image, r.feature))
    assert sorted(map(sorted, tracks.values())) == [[(0, 1), (1, 1), (2, 1)], [(3, 5), (4, 5)]]


def test_gains_recover_planted_exposure(spark):
    gain = {0: 1.0, 1: 1.1, 2: 0.9}
    rows = [(i, j, 500, 100 / gain[i], 100 / gain[j]) for i, j in ((0, 1), (1, 2), (0, 2))]
    got = {r.image_id: r.gain for r in B.solve_gains(spark.createDataFrame(rows, "i int, j int, n long, mi double, mj double"), sigma_n=1.0, sigma_g=10.0).collect()}
    assert abs(got[1] / got[0] - 1.1) < 0.02 and abs(got[2] / got[0] - 0.9) < 0.02


def test_gains_against_the_normal_equations(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), int(j), int(rng.integers(5, 900)), float(rng.uniform(20, 200)), float(rng.uniform(20, 200))) for i, j in [(0, 1), (1, 2), (0, 3), (2, 3), (3, 4)]]
    A, y = np.eye(5) / 0.01, np.full(5, 1 / 0.01)
    for i, j, n, a, b in rows:
        A[i, i] += n / 100 * a * a
        A[j, j] += n / 100 * b * b
        A[i, j] -= n / 100 * a * b
        A[j, i] -= n / 100 * a * b
    got = {r.image_id: r.gain for r in B.solve_gains(spark.createDataFrame(rows, "i int, j int, n long, mi double, mj double")).collect()}
    assert np.allclose([got[k] for k in range(5)], np.clip(np.linalg.solve(A, y), 0.5, 2))


def test_offsets_recover_planted_drift(spark):
    """Against rounds over single tie points; some are wild."""
    rng, o = np.random.default_rng(4), np.array([0.0, 6.0, -4.0, 2.0, -4.0])
    i = rng.integers(0, 4, 400)
    j = i + 1 + rng.integers(0, 4 - i)
    v = rng.uniform(50, 200, 400)
    vi, vj = v - o[i], v - o[j] + rng.normal(0, 0.3, 400) + np.where(rng.random(400) < 0.1, 60, 0)
    got = {r.image_id: r.offset for r in B.solve_offsets(spark.createDataFrame([(int(a), int(b), float(x), float(y)) for a, b, x, y in zip(i, j, vi, vj)], "i int, j int, vi double, vj double")).collect()}
    x, w, m = np.zeros(5), np.ones(400), vj - vi
    for _ in range(10):
        A, y = np.eye(5) / 64 + 1, np.zeros(5)
        for a, b, ww, mm in zip(i, j, w, m):
            e = np.zeros(5)
            e[a], e[b] = 1, -1
            A += ww * np.outer(e, e)
            y += ww * mm * e
        x = np.linalg.solve(A, y)
        r = np.abs(x[i] - x[j] - m)
        w = np.minimum(1, 1.5 * max(np.median(r), 0.5) / np.maximum(r, 1e-9))
    assert np.allclose([got[k] for k in range(5)], x - x.mean()) and np.abs(x - x.mean() - o).max() < 0.5


def test_gain_and_offset_against_single_points(spark):
    rng = np.random.default_rng(5)
    i, j = rng.integers(0, 3, 300), rng.integers(0, 3, 300)
    i, j = i[i != j], j[i != j]
    vi, vj = rng.uniform(20, 200, len(i)), rng.uniform(20, 200, len(i))
    A, y = np.diag([25.0, 1 / 64] * 3) + 1e-6 * np.eye(6), np.array([25.0, 0] * 3)
    for a, b, p, q in zip(i, j, vi, vj):
        e = np.zeros(6)
        e[2 * a], e[2 * a + 1] = p, 1
        e[2 * b], e[2 * b + 1] = -q, -1
        A += np.outer(e, e) / 100
    x = np.linalg.solve(A, y)
    gain, offset = x[0::2] / x[0::2].mean(), x[1::2] / x[0::2].mean()
    got = sorted(B.solve_gain_offset(spark.createDataFrame([(int(a), int(b), float(p), float(q)) for a, b, p, q in zip(i, j, vi, vj)], "i int, j int, vi double, vj double")).collect())
    assert np.allclose([r.gain for r in got], np.clip(gain, 0.5, 2)) and np.allclose([r.offset for r in got], np.clip(offset - offset.mean(), -48, 48))


def test_places_without_one_task(spark):
    from aeroquilt.operators.spatial import numbered

    got = numbered(spark.range(0, 3000, 3).repartition(7), "id", "at").collect()
    assert len(got) == 1000 and all(r.at == r.id // 3 + 1 for r in got)


def test_hull_against_supporting_lines():
    from aeroquilt.operators.survey import hull

    rng = np.random.default_rng(6)
    for n in (1, 2, 3, 5, 40):
        for _ in range(30):
            pts = [tuple(map(float, p)) for p in rng.integers(0, 7, (n, 2))]
            ring = hull(pts)
            if len({p[0] for p in pts}) > 1 and len(ring) > 2:
                for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
                    assert all((x1 - x0) * (y - y0) >= (y1 - y0) * (x - x0) for x, y in pts)
            assert set(ring) <= set(pts) and len(set(ring)) == len(ring)


def test_palettes(spark):
    lut = {r.gray: (r.r, r.g, r.b) for r in TH.palette_table(spark, "Iron-Red").collect()}
    assert len(lut) == 256 and lut[0] == (0, 0, 0) and lut[255] == (255, 255, 230)


def test_rodrigues_is_a_rotation(spark):
    m = C.rodrigues([F.lit(0.0), F.lit(0.0), F.lit(math.pi / 2)])
    got = spark.range(1).select(*[m[i][j].alias(f"m{i}{j}") for i in range(3) for j in range(3)]).first()
    assert np.allclose(np.array(got).reshape(3, 3), [[0, -1, 0], [1, 0, 0], [0, 0, 1]])


def test_las_header_and_records(spark):
    df = spark.createDataFrame([(1.5, 2.5, 3.5, 1, 2, 255), (2.0, 2.0, 2.0, 0, 0, 0)], "x double, y double, z double, r int, g int, b int").coalesce(1)
    head, body = las.las_bytes(df, 0.001)
    assert len(head) == 227 and head[:4] == b"LASF" and int.from_bytes(head[107:111], "little") == 2
    rec = np.frombuffer(b"".join(r["body"] for r in body.collect()), las.RECORD)
    assert list(rec["x"]) == [500, 1000] and list(rec["blue"]) == [65535, 0]


def test_gcp_lines(spark):
    lines = spark.createDataFrame([("EPSG:32646",), ("# x",), ("1 2 3 4 5 a/b.jpg G1",), ("1,2,3,4,5,b.jpg",), ("bad row",), (None,)], "line string")
    got = sorted((r.name, r.image) for r in text.parse_gcps(lines).collect())
    assert got == [("1.0000_2.0000_3.0000", "b.jpg"), ("G1", "b.jpg")]
