"""What a query costs grows with its input: plans deal small files to many tasks, hold no quadratic frames, and give the same rows."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from aeroquilt.functions.rounding import rounded
from aeroquilt.operators import spatial as S
from aeroquilt.plans import catalogue, fixtures

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    c = duckdb.connect()
    for t in fixtures.TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return c


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def same(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA)
    want = duck.sql(catalogue.SQL[name])
    return sorted(map(repr, map(tuple, got.select(*want.columns).collect()))) == sorted(map(repr, want.fetchall()))


def test_rounding_is_that_of_the_statements(spark, duck):
    rng = np.random.default_rng(7)
    x = [0.0, -0.2e-6, 1.0000005, -2.5e-6, 0.1308625, -45988110703.296425, 7.3e17 / 3, 1e300, 1e305, float("inf"), *(rng.normal(0, 100, 500)), *(rng.integers(-10**9, 10**9, 500) / 2e6)]
    got = [r[0] for r in spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)], "k int, x double").orderBy("k").select(rounded(F.col("x"), 6)).collect()]
    assert list(map(repr, got)) == [repr(duck.execute("select round(?::double, 6)", [float(v)]).fetchall()[0][0]) for v in x]  # halves, signs of zero, huge ones


def test_project_points_is_dealt_to_many_tasks(spark, duck):
    df = catalogue.QUERIES["project_points"](spark, DATA)
    counts = df.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(counts) > 4 and max(r["count"] for r in counts) < 0.5 * sum(r["count"] for r in counts)  # all in one task before
    assert same(spark, duck, "project_points")


def test_product_join_gives_every_pair_once(spark):
    few = spark.createDataFrame([(i, i % 2) for i in range(7)] + [(9, None)], "a int, k int")
    many = spark.createDataFrame([(i, i % 3) for i in range(50)] * 2, "b int, k int")
    got = sorted(map(tuple, S.product_join(few, many, "k", "b").select("a", "b").collect()))
    assert got == sorted((a, b) for a in range(7) for b in [*range(50)] * 2 if a % 2 == b % 3)


def test_tiles_are_those_of_the_statements_grid(spark, tmp_path):
    """Photos of a very long survey lie beyond the last column of tiles."""
    duck = duckdb.connect()
    duck.execute("create table customer as select range * 7919 as c_custkey, 1 as c_nationkey from range(120)")
    duck.execute(f"copy customer to '{tmp_path}/customer.parquet'")
    want = duck.sql(catalogue.SQL["tile_overlap_join"]).fetchall()
    got = catalogue.QUERIES["tile_overlap_join"](spark, str(tmp_path)).select("ty", "tx", "id").collect()
    assert len(want) > 100 and max(r[1] for r in want) > 3900 and sorted(map(tuple, got)) == sorted(want)


def test_observations_are_dealt_to_many_tasks_and_projected_once(spark, duck):
    df = fixtures.view(spark, DATA, "observations")
    assert plan(df).lower().count("cos(") == 1  # 54 before: each condition on u or v held all of the projection
    assert df.rdd.getNumPartitions() >= 16  # one before
    want = duck.sql(f"with {fixtures.ctes('observations')} select cam_id, pt_id, u, v from observations").fetchall()
    assert len(want) > 200 and sorted(map(tuple, df.select("cam_id", "pt_id", "u", "v").collect())) == sorted(want)


@pytest.mark.parametrize("name", ["kept_observations", "undistort", "covisibility_topk", "border_weight", "depth_range", "reprojection_residuals", "room_cap", "block_statistics", "depth_band", "marks_on_geometry", "rolling_shutter"])
def test_queries_over_observations(spark, duck, name):
    assert same(spark, duck, name)


def test_rolling_shutter_projects_once(spark, duck):
    assert plan(catalogue.QUERIES["rolling_shutter"](spark, DATA)).lower().count("cos(") < 8  # 80 before


def test_lens_limit_in_many_tasks_against_folds(spark):
    """Against the sampled polynomial written as a loop; a null has no limit."""
    from aeroquilt.operators.survey import lens_limit

    rng, steps = np.random.default_rng(8), 500
    lenses = [(k, 1200, 900, 1150.0, float(a), float(b), float(c), 599.5, 440.0) for k, (a, b, c) in enumerate(rng.normal(0, 0.2, (60, 3)))] + [(98, 1200, 900, 1150.0, 0.0, 0.0, 0.0, 599.5, 440.0), (99, 1200, 900, 1150.0, None, 0.0, 0.0, 599.5, 440.0)]
    cams = spark.createDataFrame(lenses, "cam_id int, width int, height int, f double, k1 double, k2 double, k3 double, ppx double, ppy double").coalesce(1)
    df = lens_limit(cams, steps)
    assert df.rdd.getNumPartitions() >= 16  # one before
    got = {r.cam_id: r.r2max for r in df.collect()}
    for cam, w, h, f, k1, k2, k3, px, py in lenses:
        if k1 is None:
            assert got[cam] is None
            continue
        rd = np.hypot(max(px, w - 1 - px), max(py, h - 1 - py)) / f
        step, stop = (4 * rd + 1) / steps, steps
        d = [i * step * (1 + (i * step) ** 2 * (k1 + (i * step) ** 2 * (k2 + (i * step) ** 2 * k3))) for i in range(steps + 1)]
        stop = next((i - 1 for i in range(1, steps + 1) if d[i] <= d[i - 1]), steps)
        at = next((i for i in range(stop + 1) if d[i] >= rd), None)
        limit = stop * step if at is None else min(at * step * 1.01, stop * step)
        assert abs(got[cam] - limit**2) < 1e-9 * (1 + limit**2)


def test_descriptors_are_compared_in_blocks_without_a_table_of_pairs(spark, duck):
    """Against all pairs, with blocks of three rows, ties and images without features."""
    from aeroquilt.operators import matching as M

    rng = np.random.default_rng(9)
    feats = [(int(k), int(rng.integers(0, 3)), int(rng.choice([0, 1, 3, 7, -1, 1 << 62])), float(rng.integers(0, 9)), float(rng.integers(0, 9))) for k in rng.permutation(60)]
    df = spark.createDataFrame(feats, "feat_id long, image_id int, dsc long, x double, y double")
    for radius in (None, 3.0):
        left = df.selectExpr("image_id as i", "image_id + 1 as j", "feat_id as a", "dsc as da", "x as qx", "y as qy")
        right = df.selectExpr("image_id - 1 as i", "image_id as j", "feat_id as b", "dsc as db", "x as px", "y as py")
        got = {(r.i, r.j, r.side, r.id): (r.ham, r.other, r.second) for r in M._nearest(left, right, ("i", "j"), radius, block=3).collect()}
        want = {}
        for k, i, d, x, y in feats:
            for side, other in ((0, i + 1), (1, i - 1)):
                near = sorted((bin((d ^ e) & (2**64 - 1)).count("1"), b) for b, j, e, p, q in feats if j == other and (radius is None or (x - p) ** 2 + (y - q) ** 2 <= radius**2))
                if near:
                    want[min(i, other), max(i, other), side, k] = (*near[0], near[1][0] if side == 0 and len(near) > 1 else None)
        assert {k: v if k[2] == 0 else (*v[:2], None) for k, v in got.items()} == want
    for name in ("hamming_best", "hamming_mutual", "hamming_ratio", "hamming_guided"):
        assert "bit_count" not in plan(catalogue.QUERIES[name](spark, DATA))  # the distance of every pair was a row before
        assert same(spark, duck, name)


def test_near_mask_goes_over_a_column_once(spark, duck):
    df = catalogue.QUERIES["near_mask"](spark, DATA)
    assert "currentrow$(), unboundedfollowing$()" not in plan(df)  # gone through anew for every cell: the square of a column's length
    assert "unboundedpreceding$(), currentrow$()" in plan(df)
    assert same(spark, duck, "near_mask")


def test_visibility_looks_places_up_without_a_shuffle_of_rays(spark, duck):
    from aeroquilt.operators import terrain as T

    df = catalogue.QUERIES["visibility"](spark, DATA)
    assert "Generate" not in plan(df)  # each ray was a row of a shuffle for each of its places
    assert same(spark, duck, "visibility")
    rng = np.random.default_rng(10)
    z = [(r, c, None if rng.random() < 0.2 else float(rng.uniform(0, 20))) for r in range(-3, 9) for c in range(2, 15) if rng.random() < 0.9]
    surface = spark.createDataFrame(z, "row int, col int, z double")
    cams = spark.createDataFrame([(k, *map(float, rng.uniform(-10, 30, 2)), 25.0) for k in range(5)] + [(9, None, 3.0, 25.0)], "cam_id long, cx double, cy double, cz double")
    every = [sorted(map(tuple, T.visible(cams.crossJoin(surface), surface, 12, 0.5, 1.25, small).select("cam_id", "row", "col", "visible").collect())) for small in (4096, 10)]
    assert every[0] == every[1] and len({r[3] for r in every[0]}) == 2


def test_neighbours_are_sought_in_many_tasks_and_each_ring_once(spark, duck):
    pts = spark.createDataFrame([(k, float(k % 40), float(k // 40)) for k in range(400)], "id long, x double, y double").coalesce(1)
    near = S.radius_join(pts.selectExpr("id as i", "x as qx", "y as qy"), pts.selectExpr("id as j", "x as px", "y as py"), 3.0)
    assert near.rdd.getNumPartitions() >= 16  # one before: the join was broadcast
    df = catalogue.QUERIES["knn_pairs"](spark, DATA)
    assert "gx" not in plan(df)  # the search of every ring was in the plan of the result, and of each test for the next
    assert same(spark, duck, "knn_pairs")


def test_far_points_are_projected_to_the_last_bit(spark, tmp_path):
    """Cameras and points of a survey of kilometres: pixels up to 1e11."""
    c = duckdb.connect()
    c.execute("create table supplier as select range * 7 as s_suppkey from range(900)")
    c.execute("create table part as select range * 131 as p_partkey, range % 50 + 1 as p_size from range(900)")
    for t in ("supplier", "part"):
        c.execute(f"copy {t} to '{tmp_path}/{t}.parquet'")
    want = c.sql(catalogue.SQL["project_points"]).fetchall()
    got = catalogue.QUERIES["project_points"](spark, str(tmp_path)).select("cam_id", "pt_id", "u", "v", "depth").collect()
    assert len(want) > 5000 and max(abs(r[2]) for r in want) > 1e9 and sorted(map(tuple, got)) == sorted(want)
