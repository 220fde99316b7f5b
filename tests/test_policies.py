"""Rigs and yaw models against planted ones."""

import numpy as np

from pyspark.sql import functions as F

from aeroquilt.operators import policies as P


def test_rig_moves_the_second_camera(spark):
    rng = np.random.default_rng(1)
    q = [np.linalg.qr(rng.normal(size=(3, 3)))[0] for _ in range(2)]
    shift, centre = rng.normal(size=3), rng.normal(size=3)
    lit = lambda m: [[F.lit(float(x)) for x in r] for r in m]
    r, c = P.apply_rig(lit(q[0]), [F.lit(float(x)) for x in shift], lit(q[1]), [F.lit(float(x)) for x in centre])
    row = spark.range(1).select(*[x.alias(f"r{i}{j}") for i, y in enumerate(r) for j, x in enumerate(y)], *[x.alias(f"c{i}") for i, x in enumerate(c)]).first()
    assert np.allclose([[row[f"r{i}{j}"] for j in range(3)] for i in range(3)], q[1] @ q[0])
    assert np.allclose([row[f"c{i}"] for i in range(3)], centre - q[0].T @ q[1].T @ shift)


def test_yaw_model_is_recovered_and_noise_refused(spark):
    rng = np.random.default_rng(2)
    yaw = rng.uniform(-180, 180, 40)
    angle = -np.radians(yaw) + 0.7 + rng.normal(0, 0.01, 40)
    angle[:3] += np.pi  # read the wrong way round
    alt = rng.uniform(40, 80, 40)
    rows = [(float(a), float(y), 0.0004 * float(h), float(h), -1.0) for a, y, h in zip(angle, yaw, alt)]
    schema = "angle double, yaw double, gsd double, rel_alt double, det double"
    got = P.yaw_model(spark.createDataFrame(rows, schema))
    assert got["sign"] == -1 and abs(got["offset"] - 0.7) < 0.01 and abs(got["per_metre"] - 0.0004) < 1e-9 and got["flip"] == -1
    noise = [(float(a), y, g, h, d) for a, (_, y, g, h, d) in zip(rng.uniform(-3, 3, 40), rows)]
    assert P.yaw_model(spark.createDataFrame(noise, schema)) is None and P.yaw_model(spark.createDataFrame(rows[:3], schema)) is None
