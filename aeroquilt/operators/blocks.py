"""Block geometry: triangulation, residuals, pair statistics, colour balance, alignment.  Sums run in Spark, small systems on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut

from ..functions import camera as C


def sensor_groups(frames: DataFrame) -> DataFrame:
    """(image_id, f, known, group): one group per size and focal length, numbered by first appearance."""
    f, known = C.focal_px(F.col("width"), F.col("height"), F.col("focal35"))
    df = frames.select("image_id", "width", "height", f.alias("f"), known.alias("known")).withColumn("__f", F.round("f", 1))
    first = df.groupBy("width", "height", "__f").agg(F.min("image_id").alias("__first"))
    first = first.withColumn("group", F.row_number().over(Window.orderBy("__first")) - 1)  # one row per camera model
    return df.join(F.broadcast(first), ["width", "height", "__f"]).select("image_id", "f", "known", "group")


def rays(observations: DataFrame, cameras: DataFrame) -> DataFrame:
    """World-space unit rays dx, dy, dz of observations of nadir cameras, with the cameras' columns."""
    df = C.undistort(observations.join(cameras, "cam_id"), "u", "v")
    R = C.nadir_rotation(F.col("yaw"))
    d = [R[0][k] * F.col("nx") + R[1][k] * F.col("ny") + R[2][k] for k in range(3)]
    df = df.withColumns({f"__{n}": x for n, x in zip("xyz", d, strict=True)})
    norm = F.sqrt(sum((F.col(f"__{n}") * F.col(f"__{n}") for n in "xyz"), F.lit(0.0)))
    return df.withColumns({f"d{n}": F.col(f"__{n}") / norm for n in "xyz"}).drop("__x", "__y", "__z")


def triangulate(observations: DataFrame, cameras: DataFrame, least: int = 2) -> DataFrame:
    """Least-squares meeting point of each point's rays, and the widest ray angle in degrees."""
    df = rays(observations, cameras)
    axes = "xyz"
    proj = {(i, j): F.lit(1.0 if i == j else 0.0) - F.col(f"d{i}") * F.col(f"d{j}") for i in axes for j in axes}
    sums = [F.sum(proj[i, j]).alias(f"a{i}{j}") for k, i in enumerate(axes) for j in axes[k:]]
    sums += [F.sum(sum((proj[i, j] * F.col(f"c{j}") for j in axes), F.lit(0.0))).alias(f"b{i}") for i in axes]
    sums += [F.sum(f"d{i}").alias(f"m{i}") for i in axes]
    g = df.groupBy("pt_id").agg(F.count("*").alias("views"), *sums).where(F.col("views") >= least)
    a = lambda i, j: F.col("a" + "".join(sorted(i + j))) + (1e-9 if i == j else 0.0)
    cof = {
        "xx": a("y", "y") * a("z", "z") - a("y", "z") * a("y", "z"), "xy": a("x", "z") * a("y", "z") - a("x", "y") * a("z", "z"), "xz": a("x", "y") * a("y", "z") - a("x", "z") * a("y", "y"),
        "yy": a("x", "x") * a("z", "z") - a("x", "z") * a("x", "z"), "yz": a("x", "y") * a("x", "z") - a("x", "x") * a("y", "z"), "zz": a("x", "x") * a("y", "y") - a("x", "y") * a("x", "y"),
    }
    det = a("x", "x") * cof["xx"] + a("x", "y") * cof["xy"] + a("x", "z") * cof["xz"]
    g = g.withColumns({i: F.try_divide(sum((cof["".join(sorted(i + j))] * F.col(f"b{j}") for j in axes), F.lit(0.0)), det) for i in axes})
    norm = F.greatest(F.sqrt(F.col("mx") * F.col("mx") + F.col("my") * F.col("my") + F.col("mz") * F.col("mz")), F.lit(1e-12))
    mean = g.select("pt_id", *[(F.col(f"m{i}") / norm).alias(f"m{i}") for i in axes])
    cos = df.join(mean, "pt_id").groupBy("pt_id").agg(F.min(sum((F.col(f"d{i}") * F.col(f"m{i}") for i in axes), F.lit(0.0))).alias("c"))
    angle = F.degrees(2 * F.acos(F.least(F.greatest("c", F.lit(-1.0)), F.lit(1.0))))
    return g.join(cos, "pt_id").select("pt_id", "views", "x", "y", "z", angle.alias("angle"))


def reproject(observations: DataFrame, cameras: DataFrame, points: DataFrame) -> DataFrame:
    """Residuals ru, rv and depth of every observation."""
    df = observations.join(cameras, "cam_id").join(points.select("pt_id", F.col("x").alias("wx"), F.col("y").alias("wy"), F.col("z").alias("wz")), "pt_id")
    col = F.col
    u, v, z = C.project(C.nadir_rotation(col("yaw")), [col("cx"), col("cy"), col("cz")], [col("wx"), col("wy"), col("wz")], col("f"), [col("k1"), col("k2"), col("k3")], [col("ppx"), col("ppy")])
    return df.withColumn("ru", u - col("u")).withColumn("rv", v - col("v")).withColumn("depth", z)


def huber(s2: Column, h: float) -> Column:
    """Cost of a squared residual."""
    return F.when(s2 <= h * h, s2).otherwise(2 * h * F.sqrt(s2) - h * h)


def affine_moments(matches: DataFrame, by: list[str]) -> DataFrame:
    """Least-squares affine (a, b, c; d, e, f) from (x, y) to (p, q) per group, from its moments (coordinates centred first)."""
    m = matches.join(matches.groupBy(*by).agg(*[F.avg(c).alias(f"m{c}") for c in "xypq"]), by)
    m = m.withColumns({f"c{c}": F.col(c) - F.col(f"m{c}") for c in "xypq"})
    s = lambda a, b: F.sum(F.col(f"c{a}") * F.col(f"c{b}")).alias(f"s{a}{b}")
    g = m.groupBy(*by).agg(F.count("*").alias("n"), *[F.first(f"m{c}").alias(f"m{c}") for c in "xypq"], s("x", "x"), s("x", "y"), s("y", "y"), s("x", "p"), s("y", "p"), s("x", "q"), s("y", "q"))
    det = F.col("sxx") * F.col("syy") - F.col("sxy") * F.col("sxy")
    part = lambda p, k: F.try_divide(F.col(f"sx{p}") * F.col("syy") - F.col(f"sy{p}") * F.col("sxy") if k == 0 else F.col(f"sy{p}") * F.col("sxx") - F.col(f"sx{p}") * F.col("sxy"), det)
    g = g.withColumns({"a": part("p", 0), "b": part("p", 1), "d": part("q", 0), "e": part("q", 1)})
    return g.withColumns({"c": F.col("mp") - F.col("a") * F.col("mx") - F.col("b") * F.col("my"), "f": F.col("mq") - F.col("d") * F.col("mx") - F.col("e") * F.col("my")}).select(*by, "n", *"abcdef")


def solve_gains(pairs: DataFrame, sigma_n: float = 10.0, sigma_g: float = 0.1) -> DataFrame:
    """(image_id, gain): gains that bring the mean colours (mi, mj) of pairs (i, j, n, mi, mj) together, held near 1, clipped to 0.5 .. 2.  One channel.

    The normal equations have one row per photo and are solved on the driver.
    """
    a, b = F.col("mi"), F.col("mj")
    w = F.col("n") / (sigma_n * sigma_n)
    terms = pairs.select(F.explode(F.array(*[F.struct(F.col(r).cast("int").alias("r"), F.col(c).cast("int").alias("c"), v.alias("v")) for r, c, v in (("i", "i", w * a * a), ("j", "j", w * b * b), ("i", "j", -w * a * b), ("j", "i", -w * a * b))])).alias("t"))
    rows = terms.groupBy("t.r", "t.c").agg(F.sum("t.v").alias("v")).collect()
    names = sorted({r["r"] for r in rows})
    at = {k: i for i, k in enumerate(names)}
    A, y = np.zeros((len(names), len(names))), np.zeros(len(names))
    for r in rows:
        A[at[r["r"]], at[r["c"]]] += r["v"]
    A[np.diag_indices(len(names))] += 1 / sigma_g**2  # once for each photo, however many matches it has
    y += 1 / sigma_g**2
    gain = np.clip(np.linalg.solve(A, y), 0.5, 2.0) if names else []
    return pairs.sparkSession.createDataFrame([(int(k), float(g)) for k, g in zip(names, gain, strict=True)], "image_id int, gain double")


def solve_offsets(ties: DataFrame, prior: float = 8.0, most: float = 32.0, rounds: int = 10) -> DataFrame:
    """(image_id, offset): additive drift between photos from tie points (i, j, vi, vj): vi + offset i = vj + offset j, robust, mean zero, bounded.

    Each round weighs every tie point by its residual (Huber, 1.5 times the median residual, at least half a level) and sums the normal equations by pair in
    Spark; the driver solves one row per photo, with a weak prior and the sum of all offsets held at zero.
    """
    spark = ties.sparkSession
    ties = cut(ties.select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), (F.col("vj") - F.col("vi")).cast("double").alias("m")))
    names = sorted(r["k"] for r in ties.select(F.explode(F.array("i", "j")).alias("k")).distinct().collect())  # one row per photo
    at, o = {k: n for n, k in enumerate(names)}, np.zeros(len(names))
    weighed = ties.withColumn("w", F.lit(1.0))
    for _ in range(rounds if names else 0):
        A, y = np.eye(len(names)) / prior**2 + 1.0, np.zeros(len(names))
        for r in weighed.groupBy("i", "j").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("m")).alias("wm")).collect():  # one row per pair of photos
            i, j = at[r["i"]], at[r["j"]]
            A[i, i] += r["w"]
            A[j, j] += r["w"]
            A[i, j] -= r["w"]
            A[j, i] -= r["w"]
            y[i] += r["wm"]
            y[j] -= r["wm"]
        o = np.linalg.solve(A, y)
        known = spark.createDataFrame([(k, float(x)) for k, x in zip(names, o, strict=True)], "k int, o double")
        left, right = known.select(F.col("k").alias("i"), F.col("o").alias("oi")), known.select(F.col("k").alias("j"), F.col("o").alias("oj"))
        res = ties.join(F.broadcast(left), "i").join(F.broadcast(right), "j").withColumn("r", F.abs(F.col("oi") - F.col("oj") - F.col("m")))  # one row per photo
        k = 1.5 * max(res.agg(F.median("r")).first()[0], 0.5)
        weighed = res.withColumn("w", F.least(F.lit(1.0), F.lit(k) / F.greatest("r", F.lit(1e-9))))
    o = np.clip(o - o.mean(), -most, most) if names else o
    return spark.createDataFrame([(int(k), float(x)) for k, x in zip(names, o, strict=True)], "image_id int, offset double")


def solve_gain_offset(ties: DataFrame, sigma_n: float = 10.0, gain_prior: float = 0.2, offset_prior: float = 8.0, most_gain: float = 2.0, most_offset: float = 48.0) -> DataFrame:
    """(image_id, gain, offset) of one channel from tie points (i, j, vi, vj): gain i * vi + offset i = gain j * vj + offset j.

    Moments are summed by pair in Spark; the driver solves two rows per photo, held near (1, 0), then sets the mean gain to 1 and the mean offset to 0.
    """
    a, b = F.col("vi").cast("double"), F.col("vj").cast("double")
    by = ties.groupBy(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"))
    moments = by.agg(F.count("*").alias("n"), F.sum(a).alias("a"), F.sum(b).alias("b"), F.sum(a * a).alias("aa"), F.sum(b * b).alias("bb"), F.sum(a * b).alias("ab")).collect()  # one row per pair
    names = sorted({r[c] for r in moments for c in ("i", "j")})
    place, n = {k: 2 * x for x, k in enumerate(names)}, 2 * len(names)
    A, y = np.zeros((n, n)), np.zeros(n)
    A[range(0, n, 2), range(0, n, 2)] = y[0::2] = 1 / gain_prior**2
    A[range(1, n, 2), range(1, n, 2)] = 1 / offset_prior**2
    for r in moments:
        i, j = place[r["i"]], place[r["j"]]
        at = np.array([i, i + 1, j, j + 1])
        A[np.ix_(at, at)] += np.array([[r["aa"], r["a"], -r["ab"], -r["a"]], [r["a"], r["n"], -r["b"], -r["n"]], [-r["ab"], -r["b"], r["bb"], r["b"]], [-r["a"], -r["n"], r["b"], r["n"]]]) / sigma_n**2
    x = np.linalg.solve(A + 1e-6 * np.eye(n), y) if n else y
    gain, offset = x[0::2], x[1::2]
    if n and gain.mean() > 1e-3:
        gain, offset = gain / gain.mean(), offset / gain.mean()
    offset = offset - offset.mean() if n else offset
    rows = zip(names, np.clip(gain, 1 / most_gain, most_gain).tolist(), np.clip(offset, -most_offset, most_offset).tolist(), strict=True)
    return ties.sparkSession.createDataFrame([(int(k), g, o) for k, g, o in rows], "image_id int, gain double, offset double")
