"""Bundle adjustment recovers a perturbed block, and its derivatives agree with differences."""

import numpy as np

from aeroquilt.operators import bundle as BA


def block():
    rng = np.random.default_rng(3)
    C = np.array([[x * 10.0, y * 10.0, 50.0] for x in range(3) for y in range(2)])
    R = np.stack([BA.turn(rng.normal(0, 0.02, 3)) @ np.diag([1.0, -1.0, -1.0]) for _ in C])
    cam = BA.Cameras(list(range(6)), R, C, np.tile([1000.0, -0.04, 0.01, 0.0, 600.0, 450.0], (6, 1)))
    X = np.column_stack([rng.uniform(-5, 25, 60), rng.uniform(-5, 15, 60), rng.uniform(0, 5, 60)])
    return rng, cam, X


def test_derivatives():
    rng, cam, X = block()
    at = rng.integers(0, 6, 60)
    uv = BA.project(cam, at, X)[0] + rng.normal(0, 0.5, (60, 2))
    r, jc, jx, _ = BA.linearise(cam, at, X, uv, 1e9)
    for k in range(3):
        h = np.zeros(3)
        h[k] = 1e-6
        assert np.allclose((BA.project(cam, at, X + h)[0] - BA.project(cam, at, X)[0]) / 1e-6, jx[:, :, k], atol=1e-2)
    for k in range(6):
        step = np.zeros((6, 6))
        step[:, k] = 1e-6
        assert np.allclose((BA.project(cam.moved(step), at, X)[0] - BA.project(cam, at, X)[0]) / 1e-6, jc[:, :, k], atol=2e-2)


def test_recovers_a_perturbed_block(spark):
    rng, cam, X = block()
    rows = [(c, p) for c in range(6) for p in range(60)]
    at, pt = (np.array(v) for v in zip(*rows, strict=True))
    uv = BA.project(cam, at, X[pt])[0]
    obs = spark.createDataFrame([(int(c), int(p), float(u), float(v)) for c, p, (u, v) in zip(at, pt, uv, strict=True)], "cam_id int, pt_id long, u double, v double")
    bad = cam.moved(np.concatenate([rng.normal(0, 0.003, (6, 3)), rng.normal(0, 0.05, (6, 3))], 1))
    points = spark.createDataFrame([(p, *map(float, x)) for p, x in enumerate(X + rng.normal(0, 0.2, X.shape))], "pt_id long, x double, y double, z double")
    got, pts, cost = BA.adjust(obs, points, bad, centre_sigma=1.0, rounds=6, buckets=3)
    assert cost < 0.1 and pts.count() == 60
    assert np.sqrt(((BA.project(got, at, np.array([r[1:4] for r in pts.orderBy("pt_id").collect()])[pt])[0] - uv) ** 2).mean()) < 0.05
