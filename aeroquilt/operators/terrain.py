"""Surface and terrain: point clouds to surfaces, ground filter, terrain model, classes, contours, meshes."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from ..lineage import cut
from . import raster as R


@dataclass(frozen=True)
class TerrainOptions:
    """Lengths in metres."""

    max_object_size: float = 60.0
    cell: float | None = None
    slope: float = 0.15
    dh0: float = 0.3
    dh_max: float = 3.0
    refine_tolerance: float = 0.25
    smooth: float = 0.6
    low_outlier: float = 1.0
    outlier_radius: float = 5.0
    object_buffer: float = 1.0


def top_layer(points: DataFrame, cell: float, gap: float) -> DataFrame:
    """Per cell: median height of the points within ``gap`` of the highest, and their mean colours.

    The highest point comes from a partial aggregate; points join it back by cell, which adaptive execution splits where one cell is crowded.
    """
    keyed = points.withColumn("row", F.floor(F.col("y") / cell).cast("int")).withColumn("col", F.floor(F.col("x") / cell).cast("int"))
    top = keyed.groupBy("row", "col").agg(F.max("z").alias("top"))
    kept = keyed.join(top, ["row", "col"]).where(F.col("z") >= F.col("top") - gap)
    return kept.groupBy("row", "col").agg(F.median("z").alias("z"), F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in "rgb"])


def windows(max_object_size: float, cell: float) -> list[int]:
    """Odd window widths 3, 5, 9, 17 ... up to the largest object."""
    most = max(3, math.ceil(max_object_size / cell) | 1)
    out, k = [], 1
    while 2 * k + 1 < most:
        out.append(2 * k + 1)
        k *= 2
    return [*out, most]


def ground_filter(cells: DataFrame, cell: float, opt: TerrainOptions) -> DataFrame:
    """Progressive morphological filter: ``ground`` where no opening lowers the cell by more than its tolerance."""
    top = cells.agg(F.max("z")).first()[0]
    df = cells.withColumn("__z", F.coalesce(F.col("z"), F.lit(top), F.lit(0.0))).withColumn("ground", F.col("z").isNotNull())
    before = 1
    for w in windows(opt.max_object_size, cell):
        df = R.opening(df, w // 2, "__z", "__o")
        dh = min(opt.dh_max, opt.dh0 + opt.slope * (w - before) * cell)
        df = df.withColumn("ground", F.col("ground") & (F.col("__z") - F.col("__o") <= dh)).withColumn("__z", F.col("__o"))
        before = w
    return df.drop("__z", "__o")


def drop_low_outliers(cells: DataFrame, r: int, drop: float) -> DataFrame:
    """Heights more than ``drop`` under their local median become null."""
    return R.median_filter(cells, r, "z", "__m").withColumn("z", F.when(F.col("z") >= F.col("__m") - drop, F.col("z"))).drop("__m")


def terrain_model(dsm: DataFrame, gsd: float, opt: TerrainOptions | None = None) -> DataFrame:
    """(row, col, z, dtm, ground) of a whole grid from row 0, column 0; dtm is null where z is."""
    opt = opt or TerrainOptions()
    _, r1, _, c1 = R.extent(dsm)
    cell = opt.cell or min(1.0, max(0.25, opt.max_object_size / 120.0))
    f = max(1, round(cell / gsd))
    cell = f * gsd
    h, w = -(-(r1 + 1) // f), -(-(c1 + 1) // f)
    coarse = R.on_grid(R.block_percentile(dsm, f).select("row", "col", "z"), (0, h - 1, 0, w - 1))
    coarse = drop_low_outliers(coarse, max(2, round(opt.outlier_radius / cell)), opt.low_outlier)
    coarse = ground_filter(coarse, cell, opt)
    b = round(opt.object_buffer / cell)
    if b > 0:
        coarse = coarse.withColumn("__obj", (F.col("z").isNotNull() & ~F.col("ground")).cast("int"))
        coarse = R.dilate(coarse, b, "__obj", "__near").withColumn("ground", F.col("ground") & (F.col("__near") == 0)).drop("__obj", "__near")
    coarse = cut(coarse.select("row", "col", F.when(F.col("ground"), F.col("z")).alias("z")))
    base = R.push_pull(coarse, shape=(h, w))
    fine = R.resize(base, h, w, h * f, w * f).withColumnRenamed("z", "up")
    df = dsm.select("row", "col", "z").join(fine, ["row", "col"])
    rise = F.col("z") - F.col("up")
    df = cut(df.select("row", "col", "z", F.coalesce((rise <= opt.refine_tolerance) & (rise >= -1.0), F.lit(False)).alias("ground")))
    dtm = R.push_pull(df.select("row", "col", F.when(F.col("ground"), F.col("z")).alias("z")), shape=(r1 + 1, c1 + 1)).withColumnRenamed("z", "dtm")
    df = df.select("row", "col", "z", "ground").join(dtm, ["row", "col"])
    if opt.smooth > 0:
        r = max(1, round(opt.smooth / gsd / 2))
        df = R.box_zero(R.box_zero(df, r, "dtm", "__share").withColumn("__one", F.lit(1.0)), r, "__one", "__cover")
        df = df.withColumn("dtm", F.col("__share") / F.col("__cover")).drop("__share", "__cover", "__one")
    capped = F.when(F.col("z") >= F.col("dtm") - opt.low_outlier, F.least("z", "dtm")).otherwise(F.col("dtm"))
    return df.select("row", "col", "z", F.when(F.col("z").isNotNull(), capped).alias("dtm"), "ground")


def classify(df: DataFrame, gsd: float, building: float = 2.5, vegetation: float = 0.4, rough: float = 0.15) -> DataFrame:
    """``class``: 1 none, 2 ground, 3 low vegetation, 5 high vegetation, 6 building; needs z, ndsm, ground."""
    r = max(1, round(0.5 / gsd))
    df = df.withColumn("__h", F.when(F.col("z").isNotNull(), F.greatest(F.coalesce("ndsm", F.lit(0.0)), F.lit(0.0))).otherwise(0.0))
    df = df.withColumn("__q", F.col("__h") * F.col("__h")).withColumn("__1", F.lit(1.0))
    for source, out in (("__h", "__mh"), ("__q", "__mq"), ("__1", "__m1")):
        df = R.box_zero(df, r, source, out)
    mean, squares = F.col("__mh") / F.col("__m1"), F.col("__mq") / F.col("__m1")
    df = df.withColumn("roughness", F.sqrt(F.greatest(squares - mean * mean, F.lit(0.0))))
    kind = F.when(F.col("z").isNull(), 1).when(F.col("ground"), 2).when((F.col("__h") > building) & (F.col("roughness") > rough), 5).when(F.col("__h") > building, 6).when(F.col("__h") > vegetation, 3).otherwise(1)
    return df.withColumn("class", kind).drop("__h", "__q", "__1", "__mh", "__mq", "__m1")


def quads(cells: DataFrame) -> DataFrame:
    """Each 2 x 2 stencil once: za zb / zc zd, keyed by its upper left cell."""
    row = R.along("col")
    df = cells.select("row", "col", F.col("z").alias("za"), F.lead("z").over(row).alias("zb"), F.lead("col").over(row).alias("__c"))
    down = R.along("row")
    df = df.withColumns({"zc": F.lead("za").over(down), "zd": F.lead("zb").over(down), "__r": F.lead("row").over(down)})
    return df.where((F.col("__r") == F.col("row") + 1) & (F.col("__c") == F.col("col") + 1)).drop("__r", "__c")


def contours(cells: DataFrame, gsd: float, min_x: float, max_y: float, interval: float) -> DataFrame:
    """Marching squares: (level, x0, y0, x1, y1) segments; saddles are split by the mean of the four corners.

    Levels of a stencil lie between its lowest and highest corner, so a stencil makes as many rows as levels cross it.
    """
    low = cells.agg(F.min("z")).first()[0]
    if low is None:
        low = 0.0
    start = math.floor(low / interval) * interval
    q = quads(cells).where("za is not null and zb is not null and zc is not null and zd is not null")
    first = F.floor((F.least("za", "zb", "zc", "zd") - start) / interval)
    last = F.ceil((F.greatest("za", "zb", "zc", "zd") - start) / interval)
    q = q.withColumn("k", F.explode(F.sequence(F.greatest(first, F.lit(1)), F.greatest(last, F.lit(1))))).withColumn("level", start + F.col("k") * interval)
    x0, y0 = min_x + (F.col("col") + 0.5) * gsd, max_y - (F.col("row") + 0.5) * gsd
    x1, y1 = min_x + (F.col("col") + 1.5) * gsd, max_y - (F.col("row") + 1.5) * gsd
    level = F.col("level")

    def cross(a: str, b: str, xa, ya, xb, yb):
        za, zb = F.col(a), F.col(b)
        t = F.least(F.greatest(F.try_divide(level - za, zb - za), F.lit(0.0)), F.lit(1.0))
        return F.when((za - level) * (zb - level) < 0, F.struct((xa + t * (xb - xa)).alias("x"), (ya + t * (yb - ya)).alias("y")))

    q = q.select("level", ((F.col("za") + F.col("zb") + F.col("zc") + F.col("zd")) * 0.25).alias("mean"), cross("za", "zb", x0, y0, x1, y0).alias("t"), cross("zb", "zd", x1, y0, x1, y1).alias("r"), cross("zc", "zd", x0, y1, x1, y1).alias("b"), cross("za", "zc", x0, y0, x0, y1).alias("l"))
    q = q.withColumn("hit", F.array_compact(F.array("t", "r", "b", "l")))
    pair = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    two = F.array(F.struct(F.get("hit", F.lit(0)).alias("a"), F.get("hit", F.lit(1)).alias("b")))
    four = F.when(F.col("mean") >= level, F.array(pair("t", "r"), pair("b", "l"))).otherwise(F.array(pair("t", "l"), pair("r", "b")))
    q = q.where(F.size("hit").isin(2, 4)).select("level", F.explode(F.when(F.size("hit") == 2, two).otherwise(four)).alias("s"))
    return q.select("level", F.col("s.a.x").alias("x0"), F.col("s.a.y").alias("y0"), F.col("s.b.x").alias("x1"), F.col("s.b.y").alias("y1"))


def contours_geojson(segments: DataFrame, digits: int = 3) -> DataFrame:
    """(level, n, geojson): one MultiLineString feature per level, segments in order of their ends."""
    seg = F.array(F.array(F.round("x0", digits), F.round("y0", digits)), F.array(F.round("x1", digits), F.round("y1", digits)))
    lines = segments.groupBy("level").agg(F.array_sort(F.collect_list(seg)).alias("c"), F.count("*").alias("n"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.col("level").alias("elevation")).alias("properties"), F.struct(F.lit("MultiLineString").alias("type"), F.col("c").alias("coordinates")).alias("geometry"))
    return lines.select("level", "n", F.to_json(feature).alias("geojson"))


def grid_mesh(cells: DataFrame) -> DataFrame:
    """Triangles of each stencil's measured corners as cell pairs; split along the diagonal with the smaller step (ties: a - d)."""
    corner = {"a": (0, 0, "za"), "b": (0, 1, "zb"), "c": (1, 0, "zc"), "d": (1, 1, "zd")}
    place = {k: F.struct((F.col("row") + dr).alias("r"), (F.col("col") + dc).alias("c"), F.col(z).alias("z")) for k, (dr, dc, z) in corner.items()}
    tri = lambda s: F.struct(*[place[k].alias(f"v{i}") for i, k in enumerate(s)])
    q = quads(cells)
    ad = F.abs(F.col("za") - F.col("zd")) <= F.abs(F.col("zb") - F.col("zc"))
    t = q.select(F.explode(F.when(F.coalesce(ad, F.lit(False)), F.array(tri("acd"), tri("adb"))).otherwise(F.array(tri("acb"), tri("bcd")))).alias("t"))
    t = t.where("t.v0.z is not null and t.v1.z is not null and t.v2.z is not null")
    return t.select(*[F.col(f"t.v{i}.{k}").alias(f"{k}{i}") for i in range(3) for k in ("r", "c")])


def visible(targets: DataFrame, surface: DataFrame, steps: int, tol: float, gsd: float, small: int = 4096) -> DataFrame:
    """Line of sight from each camera (cx, cy, cz) to each target (row, col, z), once each: hidden if a sampled cell rises over the ray.

    Every ray is sampled at ``steps`` places.  A surface whose extent holds at most ``small`` cells goes to the tasks, which look the places up where the target
    is; those of a larger surface meet it by a join on cells.
    """
    r0, r1, c0, c1 = R.extent(surface)
    if (r1 - r0 + 1) * (c1 - c0 + 1) > small:
        return _visible_by_join(targets, surface, steps, tol, gsd)
    ground = np.full((r1 - r0 + 1, c1 - c0 + 1), np.nan)
    for r in surface.where("row is not null and col is not null").groupBy("row", "col").agg(F.max("z").alias("z")).collect():  # no more than ``small``
        ground[r["row"] - r0, r["col"] - c0] = np.nan if r["z"] is None else np.inf if np.isnan(r["z"]) else r["z"]

    def run(batches):
        for batch in batches:
            row, col, z, cx, cy, cz = (batch.column(c).cast(pa.float64()).fill_null(np.nan).to_numpy() for c in ("row", "col", "z", "cx", "cy", "cz"))
            x, y, hidden = (col + 0.5) * gsd, (row + 0.5) * gsd, np.zeros(len(z), bool)
            for a in (s / steps for s in range(1, steps)):
                at, to = np.floor((y + a * (cy - y)) / gsd) - r0, np.floor((x + a * (cx - x)) / gsd) - c0
                on = np.flatnonzero((at >= 0) & (at < ground.shape[0]) & (to >= 0) & (to < ground.shape[1]))
                hidden[on] |= ground[at[on].astype(int), to[on].astype(int)] > (z + a * (cz - z) + tol)[on]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("cam_id", "row", "col")), pa.array(~hidden)], ["cam_id", "row", "col", "visible"])

    schema = StructType([*(targets.schema[c] for c in ("cam_id", "row", "col")), StructField("visible", BooleanType())])
    return targets.select("cam_id", "row", "col", "z", "cx", "cy", "cz").mapInArrow(run, schema)


def _visible_by_join(targets: DataFrame, surface: DataFrame, steps: int, tol: float, gsd: float) -> DataFrame:
    t = targets.withColumn("x", (F.col("col") + 0.5) * gsd).withColumn("y", (F.col("row") + 0.5) * gsd)
    t = t.withColumn("s", F.explode(F.sequence(F.lit(1), F.lit(steps - 1)))).withColumn("a", F.col("s") / steps)
    ray = t.withColumn("rz", F.col("z") + F.col("a") * (F.col("cz") - F.col("z")))
    at = lambda p, c: F.floor((F.col(p) + F.col("a") * (F.col(c) - F.col(p))) / gsd).cast("int")
    ray = ray.withColumn("rrow", at("y", "cy")).withColumn("rcol", at("x", "cx"))
    met = ray.join(surface.select(F.col("row").alias("rrow"), F.col("col").alias("rcol"), F.col("z").alias("sz")), ["rrow", "rcol"], "left")
    hidden = F.coalesce(F.col("sz") > F.col("rz") + tol, F.lit(False))
    return met.groupBy("cam_id", "row", "col").agg((~F.bool_or(hidden)).alias("visible"))
