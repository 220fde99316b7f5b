"""Camera model: x right, y down, z forward; pixel centres at integers; three radial terms."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

DIAGONAL_35MM = 43.2666  # fixed value, mm


def focal_px(width: Column, height: Column, focal35: Column) -> tuple[Column, Column]:
    """(focal length in pixels, whether it is known); zero and null mean unknown."""
    diagonal = F.hypot(width, height)
    known = F.coalesce(focal35 != 0, F.lit(False))
    return F.when(known, focal35 * diagonal / DIAGONAL_35MM).otherwise(0.7 * diagonal), known


def nadir_rotation(yaw: Column | None, turn: tuple[Column, Column] | None = None) -> list[list[Column]]:
    """Rows of R of a camera that looks straight down, turned by yaw, or by the cosine and sine given."""
    (c, s), o = turn or (F.cos(yaw), F.sin(yaw)), F.lit(0.0)
    return [[c, s, o], [s, -c, o], [o, o, F.lit(-1.0)]]


def with_turn(cameras: DataFrame, yaw: str = "yaw") -> DataFrame:
    """``cos_yaw`` and ``sin_yaw`` by the C library, as DuckDB has them; Java's differ in the last bit of some, which shows in pixels far outside a photo."""

    def run(batches):
        for batch in batches:
            angles = batch.column(yaw).to_pylist()
            for name, f in (("cos_yaw", math.cos), ("sin_yaw", math.sin)):
                batch = batch.append_column(name, pa.array([None if a is None else f(a) if math.isfinite(a) else math.nan for a in angles], pa.float64()))
            yield batch

    return cameras.mapInArrow(run, StructType([*cameras.schema.fields, StructField("cos_yaw", DoubleType()), StructField("sin_yaw", DoubleType())]))


def rodrigues(w: list[Column]) -> list[list[Column]]:
    """Rotation matrix of an axis-angle vector."""
    angle = F.sqrt(w[0] * w[0] + w[1] * w[1] + w[2] * w[2])
    k = [F.when(angle > 1e-12, x / angle).otherwise(0.0) for x in w]
    s, c = F.sin(angle), 1 - F.cos(angle)
    skew = [[F.lit(0.0), -k[2], k[1]], [k[2], F.lit(0.0), -k[0]], [-k[1], k[0], F.lit(0.0)]]
    square = [[k[i] * k[j] - ((k[0] * k[0] + k[1] * k[1] + k[2] * k[2]) if i == j else F.lit(0.0)) for j in range(3)] for i in range(3)]
    return [[F.lit(1.0 if i == j else 0.0) + s * skew[i][j] + c * square[i][j] for j in range(3)] for i in range(3)]


def radial(r2: Column, k1: Column, k2: Column, k3: Column) -> Column:
    return 1 + r2 * (k1 + r2 * (k2 + r2 * k3))


def normalised(R: list[list[Column]], C: list[Column], X: list[Column]) -> tuple[Column, Column, Column]:
    """(nx, ny, depth) of a world point, without lens."""
    d = [x - c for x, c in zip(X, C, strict=True)]
    x, y, z = (r[0] * d[0] + r[1] * d[1] + r[2] * d[2] for r in R)
    return F.try_divide(x, z), F.try_divide(y, z), z


def pixels(nx: Column, ny: Column, f: Column, k: list[Column], pp: list[Column]) -> tuple[Column, Column]:
    scale = f * radial(nx * nx + ny * ny, *k)
    return scale * nx + pp[0], scale * ny + pp[1]


def project(R: list[list[Column]], C: list[Column], X: list[Column], f: Column, k: list[Column], pp: list[Column]) -> tuple[Column, Column, Column]:
    """(u, v, depth) of a world point."""
    nx, ny, z = normalised(R, C, X)
    return *pixels(nx, ny, f, k, pp), z


def undistort_step(n: tuple[str, str], d: tuple[Column, Column], k: list[Column]) -> tuple[Column, Column]:
    """One fixed-point step from the columns named ``n`` towards distorted coordinates ``d``."""
    x, y = F.col(n[0]), F.col(n[1])
    scale = radial(x * x + y * y, *k)
    return d[0] / scale, d[1] / scale


def undistort(df, u: str, v: str, steps: int = 8):
    """``df`` with normalised undistorted ``nx, ny``; its columns f, k1, k2, k3, ppx, ppy are the camera's.

    Eight steps of array folding keep one projection: the fold's state is a struct, so no step is written out again inside the next.
    """
    start = F.struct(((F.col(u) - F.col("ppx")) / F.col("f")).alias("x"), ((F.col(v) - F.col("ppy")) / F.col("f")).alias("y"))
    df = df.withColumn("__d", start)

    def step(n, _):
        r2 = n["x"] * n["x"] + n["y"] * n["y"]
        scale = radial(r2, F.col("k1"), F.col("k2"), F.col("k3"))
        return F.struct((F.col("__d.x") / scale).alias("x"), (F.col("__d.y") / scale).alias("y"))

    df = df.withColumn("__n", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.col("__d"), step))
    return df.withColumn("nx", F.col("__n.x")).withColumn("ny", F.col("__n.y")).drop("__d", "__n")


def geodesic_degrees(a: list[list[Column]], b: list[list[Column]]) -> Column:
    """Angle between two rotations."""
    trace = sum((a[i][j] * b[i][j] for i in range(3) for j in range(3)), F.lit(0.0))
    return F.degrees(F.acos(F.least(F.greatest((trace - 1) / 2, F.lit(-1.0)), F.lit(1.0))))


def singular_values(a: Column, b: Column, c: Column, d: Column) -> tuple[Column, Column]:
    """Of the matrix [[a, b], [c, d]], larger first."""
    s, t = F.hypot(a + d, b - c), F.hypot(a - d, b + c)
    return (s + t) / 2, F.abs(s - t) / 2


def describe_affine(a: Column, b: Column, c: Column, d: Column) -> dict[str, Column]:
    """Scales, shear and rotation of [[a, b], [c, d]]."""
    big, small = singular_values(a, b, c, d)
    sx = F.hypot(a, c)
    return {"scale_x": sx, "scale_y": F.try_divide(a * d - b * c, sx), "shear": F.try_divide(a * b + c * d, sx * sx), "rotation": F.degrees(F.atan2(c, a)), "s_max": big, "s_min": small}


# Rolling-shutter readout in ms by make and model; where the frame's megapixels matter, (below, ms) steps, then the rest.
READOUT_MS = {
    "autel robotics xl724": 29, "autel robotics xt701": 25, "autel robotics xt705": 30, "dji fc2103": 32, "dji fc220": 64, "dji fc300c": 33,
    "dji fc300s": 33, "dji fc300x": 33, "dji fc3170": 27, "dji fc330": 33, "dji fc3411": 32, "dji fc350": 30, "dji fc3582": [(48, 26), 60],
    "dji fc3682": 23, "dji fc6310": 33, "dji fc7203": [(10, 19), 25], "dji fc8482": [(12, 16), (20, 21), (45, 43), 58],
    "dji mavic2-enterprise-advanced": 31, "dji phantom vision fc200": 74, "dji zenmuse z30": 8, "fujifilm x-a5": 186, "fujifilm x-t2": 35,
    "gopro hero4 black": 30, "gopro hero8 black": 17, "hasselblad l1d-20c": [(17, 47), 56], "hasselblad l2d-20c": 16.6, "parrot anafi": 39,
    "teracube teracube one": 32, "yuneec e90": 44,
}
DEFAULT_READOUT_MS = 30.0


def readout_ms(make: Column, model: Column, width: Column, height: Column) -> Column:
    key, mp = F.trim(F.lower(F.concat_ws(" ", make, model))), width * height / 1e6
    out = None
    for name, value in READOUT_MS.items():
        if isinstance(value, list):
            steps = F.lit(float(value[-1]))
            for below, ms in reversed(value[:-1]):
                steps = F.when(mp < below, float(ms)).otherwise(steps)
        else:
            steps = F.lit(float(value))
        out = F.when(key == name, steps) if out is None else out.when(key == name, steps)
    return out.otherwise(DEFAULT_READOUT_MS)
