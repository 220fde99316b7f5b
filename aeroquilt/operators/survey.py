"""Survey policies and per-camera aggregates: lens limits, depth ranges, extents, footprints, gates, corrections."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import camera as C
from . import raster as R
from .raster import box_edge, box_zero, gradient
from .spatial import radius_join, spread


def lens_limit(cameras: DataFrame, steps: int = 8000) -> DataFrame:
    """``r2max``: squared undistorted radius of the farthest corner on the rising branch of the lens polynomial, a hundredth to spare.

    The polynomial is sampled in NumPy, a few lenses at a time and each lens of a batch once; cameras are dealt to many tasks, as their rows are few for the work.
    """
    rd = F.hypot(F.greatest(F.col("ppx"), F.col("width") - 1 - F.col("ppx")), F.greatest(F.col("ppy"), F.col("height") - 1 - F.col("ppy"))) / F.col("f")
    given = {"__rd": rd} | {f"__{k}": F.col(k) for k in ("k1", "k2", "k3")}
    df, names = spread(cameras).withColumns({c: v.cast("double") for c, v in given.items()}), list(given)

    def limits(lens: np.ndarray) -> np.ndarray:
        """r2max for rows rd, k1, k2, k3: the polynomial at ``steps`` even places, up to where it turns."""
        rd, k1, k2, k3 = lens.T[:, :, None]
        step = (4 * rd + 1) / steps
        at = np.arange(steps + 1) * step
        r2 = at * at
        d = at * (1 + r2 * (k1 + r2 * (k2 + r2 * k3)))
        fold = ~(d[:, 1:] > d[:, :-1])
        stop = np.where(fold.any(axis=1), fold.argmax(axis=1), steps)
        reach = ~(d < rd) & (np.arange(steps + 1) <= stop[:, None])
        last = stop * step[:, 0]
        limit = np.where(reach.any(axis=1), np.fmin(reach.argmax(axis=1) * step[:, 0] * 1.01, last), last)
        return limit * limit

    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            lens, null = np.empty((table.num_rows, 4)), np.zeros(table.num_rows, bool)
            for k, c in enumerate(names):
                null |= table.column(c).is_null().to_numpy()
                lens[:, k] = table.column(c).fill_null(0.0).to_numpy()
            each, which = np.unique(lens, axis=0, return_inverse=True)
            r2 = np.concatenate([limits(each[k : k + 32]) for k in range(0, len(each), 32)]) if len(each) else np.empty(0)
            yield from table.drop_columns(names).append_column("r2max", pa.array(r2[which.ravel()], pa.float64(), mask=null)).to_batches()

    return df.mapInArrow(run, StructType([*cameras.schema.fields, StructField("r2max", DoubleType())]))


def outside_lens(x: Column, y: Column, z: Column, r2max: Column) -> Column:
    """Behind the camera, or beyond its lens (camera coordinates)."""
    return (z <= 1e-6) | (x * x + y * y > r2max * z * z)


def flat_terms(px: Column, py: Column, width: Column, height: Column) -> list[Column]:
    """Falloff, plane and saddle basis of a sensor, in half widths from its centre."""
    x, y = (px - width / 2) / (width / 2), (py - height / 2) / (width / 2)
    r2 = x * x + y * y
    return [r2, r2 * r2, x, y, x * x - y * y, x * y]


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def border_weight(u: Column, v: Column, width: Column, height: Column) -> Column:
    """Feather weight: distance to the border over half the short side."""
    edge = F.least(u + 0.5, v + 0.5, width - u - 0.5, height - v - 0.5)
    return F.greatest(edge / (0.5 * F.least(width, height)), F.lit(0.0))


def radius_ladder(spacing: Column, steps: int, times: float) -> Column:
    """spacing * times * sqrt(2) ** k."""
    return F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda k: spacing * times * F.pow(F.lit(2.0), k / 2))


def depth_hypotheses(near: Column, far: Column, n: Column) -> Column:
    """``n`` depths at even steps of inverse depth, far to near."""
    step = (1 / near - 1 / far) / (n - 1)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: 1 / (1 / far + i * step))


def depth_range(seen: DataFrame, lowest: Column) -> DataFrame:
    """(cam_id, near, far) from depths (cam_id, cz, depth) of at least ten points per camera, reaching the lowest ground, with margins."""
    g = seen.groupBy("cam_id").agg(F.count("*").alias("n"), F.percentile("depth", 0.01).alias("lo"), F.percentile("depth", 0.99).alias("hi"), F.first("cz").alias("cz")).where("n >= 10")
    hi = F.greatest("hi", F.col("cz") - lowest)
    span = hi - F.col("lo")
    return g.select("cam_id", F.greatest(0.3 * F.col("lo"), F.col("lo") - 0.2 * span - 1).alias("near"), (hi + 0.2 * span + 2).alias("far"))


def depth_band(seen: DataFrame, block: int = 32, least: int = 5, margin: float = 1.0) -> DataFrame:
    """(cam_id, brow, bcol, low, high): depths of the tie points of each image block, widened over its neighbours and by a margin."""
    b = seen.groupBy("cam_id", F.floor(F.col("v") / block).cast("int").alias("brow"), F.floor(F.col("u") / block).cast("int").alias("bcol"))
    b = b.agg(F.min("depth").alias("lo"), F.max("depth").alias("hi"), F.count("*").alias("n")).where(F.col("n") >= least)
    step = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    near = b.withColumn("dr", step).withColumn("dc", step)  # nine rows per block
    near = near.groupBy("cam_id", (F.col("brow") + F.col("dr")).alias("brow"), (F.col("bcol") + F.col("dc")).alias("bcol")).agg(F.min("lo").alias("lo3"), F.max("hi").alias("hi3"))
    pad = margin + 0.05 * (F.col("hi3") - F.col("lo3"))
    return b.select("cam_id", "brow", "bcol").join(near, ["cam_id", "brow", "bcol"]).select("cam_id", "brow", "bcol", (F.col("lo3") - pad).alias("low"), (F.col("hi3") + pad).alias("high"))


def grid_extent(cameras: DataFrame, ground: Column, gsd: float, trim: float = 0.01) -> DataFrame:
    """One row: extent of the footprints of nadir cameras at a ground height, extremes trimmed, snapped outwards to cells."""
    corner = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
    df = cameras.withColumn("k", corner).withColumn("nx", (F.col("k.a") * F.col("width") - F.col("ppx")) / F.col("f")).withColumn("ny", (F.col("k.b") * F.col("height") - F.col("ppy")) / F.col("f"))
    rise = F.col("cz") - ground
    x = F.col("cx") + rise * (F.cos("yaw") * F.col("nx") + F.sin("yaw") * F.col("ny"))
    y = F.col("cy") + rise * (F.sin("yaw") * F.col("nx") - F.cos("yaw") * F.col("ny"))
    df = df.select(x.alias("x"), y.alias("y"))
    snap = lambda c, q, f: (f(F.percentile(c, q) / gsd) * gsd)
    return df.agg(snap("x", trim, F.floor).alias("min_x"), snap("x", 1 - trim, F.ceil).alias("max_x"), snap("y", trim, F.floor).alias("min_y"), snap("y", 1 - trim, F.ceil).alias("max_y"))


def occupied_blocks(cells: DataFrame, b: int) -> DataFrame:
    """(row, col, occupied) of blocks: half their cells measured, and six of their 3 x 3 neighbourhood too."""
    g = R.blocks(cells, b).groupBy(F.col("brow").alias("row"), F.col("bcol").alias("col")).agg((F.count("z") / (b * b) >= 0.5).cast("int").alias("o"))
    return R.square(g, "o", F.sum, 1, "near").select("row", "col", ((F.col("o") == 1) & (F.col("near") >= 6)).alias("occupied"))


def hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Convex hull, counter-clockwise, by wrapping: from each corner the ring goes on to the point that has all others on its left, the farthest of several."""
    pts = np.array(sorted(set(points)), float).reshape(-1, 2)
    if len(pts) < 3:
        return [tuple(p) for p in pts.tolist()]
    ring, at = [], 0
    while not ring or at != 0:
        ring.append(tuple(pts[at].tolist()))
        ahead = pts - pts[at]
        far, best = (ahead**2).sum(axis=1), None
        for k in np.flatnonzero(far).tolist():
            if best is not None:
                area = ahead[best, 0] * ahead[k, 1] - ahead[best, 1] * ahead[k, 0]  # of the triangle, twice: negative if k is on the right
                if area > 0 or (area == 0 and far[k] <= far[best]):
                    continue
            best = k
        at = best
    return ring


def footprint(cells: DataFrame, b: int) -> DataFrame:
    """``inside`` for cells within the convex hull of the occupied blocks.

    The hull needs only each row's outermost occupied blocks: two places per row of blocks reach the driver.
    """
    ends = occupied_blocks(cells, b).where("occupied").groupBy("row").agg(F.min("col").alias("a"), F.max("col").alias("z"), F.count("*").alias("n")).collect()
    if sum(r["n"] for r in ends) < 3:
        return cells.withColumn("inside", F.lit(True))
    ring = hull([(float(c * b), float((r["row"] + d) * b)) for r in ends for c in (r["a"], r["z"] + 1) for d in (0, 1)])
    x, y, inside = F.col("col") + 0.5, F.col("row") + 0.5, F.lit(True)
    for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1], strict=True):
        inside = inside & ((x1 - x0) * (y - y0) >= (y1 - y0) * (x - x0))
    return cells.withColumn("inside", inside)


def ground_gate(points: DataFrame, least: int = 10, floor: float = 0.5) -> DataFrame:
    """``held``: heights dz over the ground within three robust deviations of their median (``floor`` at least)."""
    mid = points.agg(F.median("dz").alias("mid"), F.count("dz").alias("n"))
    df = points.crossJoin(F.broadcast(mid))  # one row
    spread = df.agg((1.4826 * F.median(F.abs(F.col("dz") - F.col("mid")))).alias("spread"))
    df = df.crossJoin(F.broadcast(spread))  # one row
    ok = (F.col("n") >= least) & (F.abs(F.col("dz") - F.col("mid")) < F.greatest(F.lit(floor), 3 * F.col("spread")))
    return df.withColumn("held", F.coalesce(ok, F.lit(False))).drop("mid", "n", "spread")


def guided_filter(df: DataFrame, image: str, guide: str, r: int, eps: float, out: str = "filtered") -> DataFrame:
    """Edge-preserving smoothing of ``guide`` along ``image``; borders share what the window holds."""
    i, g = F.col(image), F.col(guide)
    df = df.withColumns({"__ig": i * g, "__ii": i * i, "__1": F.lit(1.0)})
    for c, to in (("__1", "__n"), (image, "__mi"), (guide, "__mg"), ("__ig", "__mig"), ("__ii", "__mii")):
        df = box_zero(df, r, c, to)
    mi, mg = F.col("__mi") / F.col("__n"), F.col("__mg") / F.col("__n")
    a = (F.col("__mig") / F.col("__n") - mi * mg) / (F.col("__mii") / F.col("__n") - mi * mi + eps)
    df = df.withColumn("__a", a).withColumn("__b", mg - F.col("__a") * mi)
    df = box_zero(box_zero(df, r, "__a", "__ma"), r, "__b", "__mb")
    return df.withColumn(out, F.col("__ma") / F.col("__n") * i + F.col("__mb") / F.col("__n")).drop("__ig", "__ii", "__1", "__n", "__mi", "__mg", "__mig", "__mii", "__a", "__b", "__ma", "__mb")


def structure(df: DataFrame, r: int, gsd: float = 1.0, value: str = "z", out: str = "structure") -> DataFrame:
    """Gradient of the locally normalised value: looks alike in colour and in thermal."""
    lim = df.agg(F.percentile(value, 0.01).alias("__lo"), F.percentile(value, 0.99).alias("__hi"))
    df = df.crossJoin(F.broadcast(lim))  # one row
    a = (F.coalesce(F.col(value), F.col("__lo")) - F.col("__lo")) / F.greatest(F.col("__hi") - F.col("__lo"), F.lit(1e-6))
    df = df.withColumn("__a", F.least(F.greatest(a, F.lit(0.0)), F.lit(1.0))).withColumn("__aa", F.col("__a") * F.col("__a"))
    df = box_edge(box_edge(df, r, "__a", "__m"), r, "__aa", "__mm")
    spread = F.sqrt(F.greatest(F.col("__mm") - F.col("__m") * F.col("__m"), F.lit(0.0)))
    df = box_edge(df.withColumn("__c", (F.col("__a") - F.col("__m")) / (spread + 0.02)), 1, "__c", "__soft")
    df = gradient(df, gsd, "__soft")
    return df.withColumn(out, F.hypot("gx", "gy")).drop("__lo", "__hi", "__a", "__aa", "__m", "__mm", "__c", "__soft", "gx", "gy")


def noise(df: DataFrame, value: str = "z") -> DataFrame:
    """One row: mean absolute Laplacian of the inner cells."""
    row, col = R.along("col"), R.along("row")
    lap = F.lag(value).over(row) + F.lead(value).over(row) + F.lag(value).over(col) + F.lead(value).over(col) - 4 * F.col(value)
    return df.select(F.abs(lap).alias("l")).agg(F.avg("l").alias("noise"))


def room_cap(candidates: DataFrame, sizes: DataFrame, most: int) -> DataFrame:
    """New observations (pt_id, ham, ...) that fit into tracks of at most ``most``: best descriptors first."""
    w = Window.partitionBy("pt_id").orderBy("ham", "cam_id")
    df = candidates.join(sizes.select("pt_id", "n"), "pt_id", "left").withColumn("__k", F.row_number().over(w))
    return df.where(F.col("__k") <= most - F.coalesce("n", F.lit(0))).drop("__k", "n")


def tile_views(tiles: DataFrame, cameras: DataFrame, half: float, most: int) -> DataFrame:
    """(tile, cam_id, rank): the nearest cameras whose square footprint holds a tile's four corners."""
    t = tiles.withColumn("qx", (F.col("x0") + F.col("x1")) / 2).withColumn("qy", (F.col("y0") + F.col("y1")) / 2)
    c = cameras.select("cam_id", F.col("cx").alias("px"), F.col("cy").alias("py"))
    near = radius_join(t, c, 1.5 * half)
    holds = (F.col("x0") >= F.col("px") - half) & (F.col("x1") <= F.col("px") + half) & (F.col("y0") >= F.col("py") - half) & (F.col("y1") <= F.col("py") + half)
    w = Window.partitionBy("tile").orderBy("d2", "cam_id")
    return near.where(holds).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("tile", "cam_id", "rank")


def admit(pairs: DataFrame, used: DataFrame, least: int = 2) -> DataFrame:
    """Photos outside ``used`` (image_id) with at least ``least`` verified pairs into it."""
    both = pairs.select(F.col("i").alias("image_id"), F.col("j").alias("to")).unionByName(pairs.select(F.col("j").alias("image_id"), F.col("i").alias("to"))).distinct()
    into = both.join(used.select(F.col("image_id").alias("to")), "to", "left_semi").join(used, "image_id", "left_anti")
    return into.groupBy("image_id").agg(F.count("*").alias("pairs")).where(F.col("pairs") >= least)


def rolling_shift(observations: DataFrame) -> DataFrame:
    """Pixel shift (su, sv) between a photo's centre and where it was when the row was read.

    Needs camera and point columns, velocity vx, vy, vz and ``readout`` in seconds; a mechanical shutter (``mechanical``) has none.
    """
    col = F.col
    t = (col("v") / col("height") - 0.5) * col("readout")
    centre, moved = [col(c) for c in ("cx", "cy", "cz")], [col(c) + col(v) * t for c, v in (("cx", "vx"), ("cy", "vy"), ("cz", "vz"))]
    X, turned = [col(c) for c in ("wx", "wy", "wz")], C.nadir_rotation(col("yaw"))
    at = {f"__{c}{k}": n for k, place in enumerate((centre, moved)) for c, n in zip("xy", C.normalised(turned, place, X), strict=False)}
    df = observations.withColumns(at)  # columns of their own: inside when() a shared part of an expression is computed at each mention
    u0, v0, u1, v1 = [p for k in (0, 1) for p in C.pixels(col(f"__x{k}"), col(f"__y{k}"), col("f"), [col("k1"), col("k2"), col("k3")], [col("ppx"), col("ppy")])]
    keep = F.coalesce(col("mechanical"), F.lit(False))
    return df.withColumn("su", F.when(keep, 0.0).otherwise(u0 - u1)).withColumn("sv", F.when(keep, 0.0).otherwise(v0 - v1)).drop(*at)


def cloud_classes(points: DataFrame, surface: DataFrame, gsd: float, below: float = 1.0) -> DataFrame:
    """``class`` of each point from the cell under it (row, col, class, z); ground more than ``below`` under the surface is none."""
    p = points.withColumn("row", F.floor(F.col("y") / gsd).cast("int")).withColumn("col", F.floor(F.col("x") / gsd).cast("int"))
    p = p.join(surface.select("row", "col", F.col("class").alias("__c"), F.col("z").alias("__z")), ["row", "col"], "left")
    kind = F.when(F.col("__c").isNull() | ((F.col("__c") == 2) & (F.col("z") < F.col("__z") - below)), 1).otherwise(F.col("__c"))
    return p.withColumn("class", kind).drop("__c", "__z")
