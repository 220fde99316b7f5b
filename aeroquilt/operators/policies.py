"""Frames, poses, gates and small rules of a survey, as columns and DataFrames."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from .spatial import numbered


def control_points(points: DataFrame, origin: tuple[float, float], zone: int = 0, north: bool = True, degrees: bool = False) -> DataFrame:
    """Marked control points (x, y) in the local frame; ``degrees``: x is the longitude and y the latitude."""
    if degrees:
        east, n = geo.to_utm(F.col("y"), F.col("x"), F.lit(zone), F.lit(north))
        points = points.withColumns({"x": east, "y": n})
    return points.where("image is not null").withColumns({"x": F.col("x") - origin[0], "y": F.col("y") - origin[1]})


def rebase(positions: DataFrame, old: tuple[float, float], new: tuple[float, float], x: str = "x", y: str = "y") -> DataFrame:
    """Positions about another local origin."""
    return positions.withColumns({x: F.col(x) + (old[0] - new[0]), y: F.col(y) + (old[1] - new[1])})


def absolute_affine(affines: DataFrame, origin: tuple[float, float]) -> DataFrame:
    """Pixel affine (a, b, c; d, e, f) with the origin added."""
    return affines.withColumns({"c": F.col("c") + origin[0], "f": F.col("f") + origin[1]})


def nadir_pose(affines: DataFrame, rel_alt: Column | None = None) -> DataFrame:
    """``yaw``, ``x``, ``y``, ``height`` of cameras that look down, from the pixel affine (a, b, c; d, e, f) and ``ppx, ppy, focal``.

    The rotation nearest to the linear part has a closed form; a mirrored one (rows run downwards) has the angle of its first axis.
    """
    det = F.col("a") * F.col("e") - F.col("b") * F.col("d")
    yaw = F.when(det < 0, F.atan2(F.col("d") + F.col("b"), F.col("a") - F.col("e"))).otherwise(F.atan2(F.col("d") - F.col("b"), F.col("a") + F.col("e")))
    height = F.col("focal") * F.sqrt(F.abs(det))
    new = {"yaw": yaw, "x": F.col("a") * F.col("ppx") + F.col("b") * F.col("ppy") + F.col("c"), "y": F.col("d") * F.col("ppx") + F.col("e") * F.col("ppy") + F.col("f"), "height": height if rel_alt is None else F.coalesce(rel_alt, height)}
    return affines.withColumns(new)


def rig_angles(r: list[list[Column]]) -> tuple[Column, Column, Column]:
    """Roll, pitch and yaw in degrees of a rotation (rows of columns)."""
    return F.degrees(F.atan2(r[2][1], r[2][2])), F.degrees(F.atan2(-r[2][0], F.hypot(r[2][1], r[2][2]))), F.degrees(F.atan2(r[1][0], r[0][0]))


def apply_rig(r: list[list[Column]], shift: list[Column], rel: list[list[Column]], centre: list[Column]) -> tuple[list[list[Column]], list[Column]]:
    """Rotation and centre of the second camera of a rig: rel * r, and centre - r' * rel' * shift."""
    turned = [[sum((rel[i][k] * r[k][j] for k in range(3)), F.lit(0.0)) for j in range(3)] for i in range(3)]
    return turned, [centre[j] - sum((turned[i][j] * shift[i] for i in range(3)), F.lit(0.0)) for j in range(3)]


def value_label(units: Column) -> Column:
    return F.when(units == "°C", F.lit("temperature (°C)")).otherwise("raw sensor value")


def corrected_level(value: Column, gain: Column, offset: Column) -> Column:
    """A channel after gain and offset, in whole levels."""
    return F.floor(F.least(F.greatest(gain * value + offset + 0.5, F.lit(0.0)), F.lit(255.0))).cast("int")


def matching_gray(r: Column, g: Column, b: Column, valid: Column) -> Column:
    """Gray value that views are matched by; null where the mask says so."""
    return F.when(valid, ((r + g + b) / 3.0 - 128.0) / 64.0)


def keypoint_budget(frames: DataFrame, longest: int) -> DataFrame:
    """One row: keypoints per photo, 1250 for each megapixel searched of the median photo, from 4000 to 20000."""
    m = frames.agg(F.median("width").alias("w"), F.median("height").alias("h")).withColumn("s", F.least(F.lit(1.0), F.lit(float(longest)) / F.greatest("w", "h")))
    return m.select(F.least(F.greatest(F.rint(F.col("w") * F.col("h") * F.col("s") * F.col("s") / 1e6 * 1.25) * 1000, F.lit(4000.0)), F.lit(20000.0)).cast("int").alias("keypoints"))


def capped_resolution(requested: Column, gsd: Column, force: Column, error: float = 0.1) -> Column:
    """The cell asked for, no finer than the photos allow unless forced."""
    return F.when(requested.isNull(), gsd).when(force, requested).otherwise(F.greatest(requested, gsd * (1 - error)))


def depth_steps(focal: Column, baseline: Column, near: Column, far: Column, base: int) -> Column:
    """Hypotheses of a depth sweep: one for each pixel of disparity, between ``base`` and three times that; ``base`` without neighbours."""
    return F.when(baseline.isNull(), F.lit(base)).otherwise(F.least(F.greatest(F.ceil(focal * baseline * (1 / near - 1 / far)), F.lit(base)), F.lit(3 * base))).cast("int")


def depth_tolerance(pixels: float, depth: Column, focal: Column, baseline: Column) -> Column:
    """Relative change of depth that moves a point by so many pixels between two views."""
    return F.least(F.greatest(F.lit(pixels) * depth / F.greatest(focal * baseline, F.lit(1e-9)), F.lit(0.01)), F.lit(0.05))


def crop_box(cells: DataFrame, measured: Column, margin: int = 2) -> DataFrame:
    """One row: the rows and columns (last ones exclusive) of the measured cells and a margin, inside the raster's own."""
    box = cells.agg(*[f(F.when(measured, F.col(c))).alias(f"{c}_{k}") for c in ("row", "col") for k, f in (("low", F.min), ("high", F.max))], *[F.max(c).alias(f"{c}_end") for c in ("row", "col")])
    low = {f"{c}0": F.greatest(F.col(f"{c}_low") - margin, F.lit(0)) for c in ("row", "col")}
    high = {f"{c}1": F.least(F.col(f"{c}_high") + margin + 1, F.col(f"{c}_end") + 1) for c in ("row", "col")}
    return box.select(*[v.cast("int").alias(k) for k, v in (low | high).items()])


def grouped_number(value: Column, digits: int = 2) -> Column:
    """A number with thousands set apart; a dash for none."""
    return F.when(value.isNull() | F.isnan(value.cast("double")), "-").otherwise(F.format_number(value, digits))


def unmasked(features: DataFrame, masks: DataFrame) -> DataFrame:
    """Features (image, x, y, width, height) on valid pixels.  masks: (stem, row, col) of the invalid pixels, by the stem of the photo's name."""
    stem = F.regexp_replace(F.regexp_replace("image", "^.*/", ""), r"\.[^.]*$", "")
    at = lambda c, size: F.least(F.greatest(F.rint(c), F.lit(0.0)), F.col(size) - 1).cast("int")
    keyed = features.withColumns({"stem": stem, "col": at("x", "width"), "row": at("y", "height")})
    return keyed.join(masks.select("stem", "row", "col"), ["stem", "row", "col"], "left_anti").drop("stem", "row", "col")


def kept_depth(depth: Column, score: Column, texture: Column, near: Column, far: Column, least_score: float = 0.3, least_texture: float = 0.5) -> Column:
    return F.when((score >= least_score) & (texture >= least_texture) & (depth >= near) & (depth <= far), depth)


def thermal_mode(frames: DataFrame, raw: Column) -> DataFrame:
    """One row: ``mode``, radiometric if all frames carry raw counts, mixed if some do, else colour."""
    return frames.agg(F.when(F.every(raw), "radiometric").when(F.some(raw), "mixed").otherwise("colour").alias("mode"))


def survey_calibration(frames: DataFrame, stored: list[str], **overrides: float) -> DataFrame:
    """Frames with their measurement parameters, given ones in place of stored ones, if every frame has stored ones; else null for all, and ``units`` raw."""
    every = frames.agg(F.every(F.lit(True) if not stored else sum((F.col(c).isNull().cast("int") for c in stored), F.lit(0)) == 0).alias("__all"))
    df = frames.crossJoin(F.broadcast(every))  # one row
    df = df.withColumns({c: F.when(F.col("__all"), F.lit(float(overrides[c])) if c in overrides else F.col(c)) for c in stored})
    return df.withColumn("units", F.when(F.col("__all"), "°C").otherwise("raw")).drop("__all")


def mosaic_extent(photos: DataFrame, gsd: float) -> DataFrame:
    """One row: extent of the photos' corners under their affines (a, b, c; d, e, f), snapped outwards to cells, and its size in cells."""
    corners = F.explode(F.array(*[F.struct(u.alias("u"), v.alias("v")) for u in (F.lit(-0.5), F.col("width") - 0.5) for v in (F.lit(-0.5), F.col("height") - 0.5)]))
    df = photos.withColumn("k", corners)
    df = df.select((F.col("a") * F.col("k.u") + F.col("b") * F.col("k.v") + F.col("c")).alias("x"), (F.col("d") * F.col("k.u") + F.col("e") * F.col("k.v") + F.col("f")).alias("y"))
    box = df.agg(*[(f(g(c) / gsd) * gsd).alias(f"{k}_{c}") for c in ("x", "y") for k, f, g in (("min", F.floor, F.min), ("max", F.ceil, F.max))])
    return box.withColumns({"width": F.round((F.col("max_x") - F.col("min_x")) / gsd).cast("long"), "height": F.round((F.col("max_y") - F.col("min_y")) / gsd).cast("long")})


def overlap_statistics(counts: DataFrame) -> DataFrame:
    """One row of ``n`` cameras per cell: median, and shares of cells that five and three see."""
    return counts.agg(F.median("n").alias("median"), F.avg((F.col("n") >= 5).cast("double")).alias("five"), F.avg((F.col("n") >= 3).cast("double")).alias("three"))


def block_statistics(observations: DataFrame) -> DataFrame:
    """One row: points, observations, mean track length, median of tie points per camera."""
    each = observations.groupBy("cam_id").agg(F.count("*").alias("n")).agg(F.floor(F.median("n")).cast("long").alias("per_camera"))
    whole = observations.agg(F.count_distinct("pt_id").alias("points"), F.count("*").alias("observations"))
    return whole.withColumn("track_length", F.col("observations") / F.greatest("points", F.lit(1))).crossJoin(F.broadcast(each))  # one row


def mean_of_largest(values: Column, k: int) -> Column:
    """Mean of the k largest of an array."""
    top = F.slice(F.sort_array(values, asc=False), 1, k)
    return F.aggregate(top, F.lit(0.0), lambda a, x: a + x) / F.size(top)


def every_nth(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first of each n rows in an order without ties."""
    return numbered(df, order, "__place").where(F.pmod(F.col("__place") - 1, F.lit(n)) == 0).drop("__place")


def may_merge(left: Column, right: Column) -> Column:
    """Whether two tracks (arrays of images) share no image."""
    return F.size(F.array_intersect(left, right)) == 0


def corner_maxima(scores: DataFrame) -> DataFrame:
    """Cells (row, col, z) whose positive score is over that of the neighbours before them and no less than that of those after, in reading order."""
    near = [F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r in (-1, 0, 1) for c in (-1, 0, 1)]
    told = scores.where("z > 0").withColumn("k", F.explode(F.array(*near)))
    told = told.select((F.col("row") + F.col("k.r")).alias("row"), (F.col("col") + F.col("k.c")).alias("col"), "z", (F.col("k.r") * 3 + F.col("k.c")).alias("side"))
    best = lambda cond: F.max(F.when(cond, F.col("z")))  # noqa: E731  a cell tells the one at (r, c) from it: it stands before that one if r, c is after
    seen = told.groupBy("row", "col").agg(best(F.col("side") == 0).alias("own"), best(F.col("side") > 0).alias("before"), best(F.col("side") < 0).alias("after"))
    return seen.where("own > coalesce(before, 0) and own >= coalesce(after, 0)").select("row", "col", F.col("own").alias("z"))


def on_geometry(marks: DataFrame, error: str = "error", depth: str = "depth") -> DataFrame:
    """Marks that a bound geometry explains: error under 30 or ten medians, depth over a tenth of its median."""
    m = marks.agg(F.median(error).alias("__e"), F.median(depth).alias("__d"))
    kept = marks.crossJoin(F.broadcast(m)).where((F.col(error) < F.greatest(F.lit(30.0), 10 * F.col("__e"))) & (F.col(depth) > 0.1 * F.col("__d")))  # one row
    return kept.drop("__e", "__d")


def yaw_model(photos: DataFrame, least: int = 5) -> dict | None:
    """How gimbal yaw and height predict a photo's affine: ``sign``, ``offset`` (radians), ``per_metre``, ``flip``; None if they do not.

    photos: angle (of the affine's first axis, radians), yaw (degrees), gsd, rel_alt, det.  Circular means and medians run in Spark; a handful of numbers
    reach the driver.
    """
    turn = lambda c: F.atan2(F.sin(c), F.cos(c))
    known = photos.where("angle is not null and yaw is not null")
    scale = photos.where("rel_alt > 1").agg(F.median(F.col("gsd") / F.col("rel_alt")).alias("k")).first()["k"]
    if known.count() < least or scale is None:
        return None
    best = None
    for sign in (1.0, -1.0):
        res = known.select((F.col("angle") - sign * F.radians("yaw")).alias("r"))
        mean = lambda df: df.agg(F.atan2(F.sum(F.sin("r")), F.sum(F.cos("r"))).alias("c")).first()["c"]
        c = mean(res)
        for _ in range(3):
            kept = res.where(F.abs(turn(F.col("r") - F.lit(c))) < math.radians(20))
            if kept.count() < 3:
                break
            c = mean(kept)
        off = res.agg(F.median(F.abs(turn(F.col("r") - F.lit(c)))).alias("m")).first()["m"]
        if best is None or off < best[2]:
            best = (sign, c, off)
    if best[2] > math.radians(5):
        return None
    flip = photos.agg(F.median(F.signum("det")).alias("f")).first()["f"]
    return {"sign": best[0], "offset": best[1], "per_metre": scale, "flip": flip or -1.0}
