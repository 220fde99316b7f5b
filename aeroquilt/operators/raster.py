"""Neighbourhood operators on rasters in long form: one row (row, col, z) per cell, null where nothing was measured.

Square neighbourhoods are separable: a window along each row, then one along each column, so a cell travels twice whatever the radius.
Rank filters carry the values of the row window in an array on the second trip.  Windows range over values of row and col, and
``on_grid`` makes the grid whole first, since a missing cell would also lose its column's share.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def extent(cells: DataFrame) -> tuple[int, int, int, int]:
    """First and last row, first and last column."""
    e = cells.agg(F.min("row"), F.max("row"), F.min("col"), F.max("col")).first()
    return (0, -1, 0, -1) if e[0] is None else tuple(e)


def on_grid(cells: DataFrame, box: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Every cell of the extent, with nulls where ``cells`` has none; the grid is generated in parallel."""
    r0, r1, c0, c1 = box or extent(cells)
    wide = max(1, c1 - c0 + 1)
    n = max(0, r1 - r0 + 1) * wide
    grid = cells.sparkSession.range(n).select((F.floor(F.col("id") / wide) + r0).cast("int").alias("row"), (F.col("id") % wide + c0).cast("int").alias("col"))
    return grid.join(cells, ["row", "col"], "left")


def along(axis: str, before: int | None = None, after: int | None = None):
    """Window along a row (axis col) or a column (axis row); value offsets."""
    w = Window.partitionBy("row" if axis == "col" else "col").orderBy(axis)
    return w if before is None else w.rangeBetween(before, after)


def square(df: DataFrame, value: str, agg, r: int, out: str) -> DataFrame:
    """Two passes of an aggregate over a (2 r + 1) square; ``agg`` must be associative (min, max, sum)."""
    df = df.withColumn(out, agg(F.col(value)).over(along("col", -r, r)))
    return df.withColumn(out, agg(F.col(out)).over(along("row", -r, r)))


def erode(df: DataFrame, r: int, value: str = "z", out: str = "eroded") -> DataFrame:
    return square(df, value, F.min, r, out)


def dilate(df: DataFrame, r: int, value: str = "z", out: str = "dilated") -> DataFrame:
    return square(df, value, F.max, r, out)


def opening(df: DataFrame, r: int, value: str = "z", out: str = "opened") -> DataFrame:
    return dilate(erode(df, r, value, "__e"), r, "__e", out).drop("__e")


def box_zero(df: DataFrame, r: int, value: str = "z", out: str = "mean") -> DataFrame:
    """Box mean with zeros outside the grid: always divided by the whole window."""
    df = df.withColumn("__v", F.coalesce(F.col(value), F.lit(0.0)))
    return square(df, "__v", F.sum, r, "__s").withColumn(out, F.col("__s") / (2 * r + 1) ** 2).drop("__v", "__s")


def box_edge(df: DataFrame, r: int, value: str = "z", out: str = "mean") -> DataFrame:
    """Box mean with border cells repeated outside the grid."""

    def one(df: DataFrame, axis: str, source: str, to: str) -> DataFrame:
        whole = Window.partitionBy("row" if axis == "col" else "col")
        order = whole.orderBy(axis).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        low = F.greatest(F.lit(r) - (F.col(axis) - F.min(axis).over(whole)), F.lit(0))
        high = F.greatest(F.lit(r) - (F.max(axis).over(whole) - F.col(axis)), F.lit(0))
        return df.withColumn(to, F.sum(source).over(along(axis, -r, r)) + low * F.first(source).over(order) + high * F.last(source).over(order))

    df = df.withColumn("__v", F.coalesce(F.col(value), F.lit(0.0)))
    df = one(one(df, "col", "__v", "__s"), "row", "__s", "__s")
    return df.withColumn(out, F.col("__s") / (2 * r + 1) ** 2).drop("__v", "__s")


def gather(df: DataFrame, r: int, item: Column, out: str = "around") -> DataFrame:
    """Array of ``item`` over the square, nulls left out."""
    df = df.withColumn(out, F.collect_list(item).over(along("col", -r, r)))
    return df.withColumn(out, F.flatten(F.collect_list(out).over(along("row", -r, r))))


def median_of(values: Column) -> Column:
    """Mean of the middle two of an array without nulls; null if empty."""
    s = F.array_sort(values)
    n = F.size(values)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def median_filter(df: DataFrame, r: int, value: str = "z", out: str = "median") -> DataFrame:
    return gather(df, r, F.col(value), "__a").withColumn(out, median_of(F.col("__a"))).drop("__a")


def median3(df: DataFrame, value: str = "z", out: str = "median") -> DataFrame:
    """Fifth of the 3 x 3 values, border cells repeated outside."""
    v = F.col(value)
    row, col = along("col"), along("row")
    df = df.withColumn("__h", F.array(F.coalesce(F.lag(value).over(row), v), v, F.coalesce(F.lead(value).over(row), v)))
    h = F.col("__h")
    every = F.concat(F.coalesce(F.lag("__h").over(col), h), h, F.coalesce(F.lead("__h").over(col), h))
    return df.withColumn(out, F.array_sort(every)[4]).drop("__h")


def city_block(df: DataFrame, mask: str, out: str = "distance") -> DataFrame:
    """City-block distance to the nearest cell where ``mask`` holds: along rows, then the lower envelope along columns.

    Frames run from the start of either order to the cell, since one that runs from the cell to the end is gone through anew for every cell.
    """

    def running(axis: str):
        whole = Window.partitionBy("row" if axis == "col" else "col")
        return [whole.orderBy(order).rowsBetween(Window.unboundedPreceding, 0) for order in (F.asc(axis), F.desc(axis))]

    at = F.when(F.col(mask), F.col("col"))
    left, right = (F.last(at, True).over(w) for w in running("col"))
    df = df.withColumn("__h", F.least(F.col("col") - left, right - F.col("col")))
    before, after = running("row")
    up = F.min(F.col("__h") - F.col("row")).over(before) + F.col("row")
    down = F.min(F.col("__h") + F.col("row")).over(after) - F.col("row")
    return df.withColumn(out, F.least(up, down)).drop("__h")


def near(df: DataFrame, mask: str, k: int, out: str = "near") -> DataFrame:
    return city_block(df, mask, "__d").withColumn(out, F.coalesce(F.col("__d") <= k, F.lit(False))).drop("__d")


def bilateral(df: DataFrame, r: int, sigma_r: float, sigma_s: float, value: str = "z", out: str = "smooth") -> DataFrame:
    """Average weighted by distance and by difference in height; null cells stay null."""
    df = gather(df, r, F.when(F.col(value).isNotNull(), F.struct("row", "col", F.col(value).alias("v"))), "__a")

    def add(acc, n):
        far = (n["row"] - F.col("row")) * (n["row"] - F.col("row")) + (n["col"] - F.col("col")) * (n["col"] - F.col("col"))
        rise = n["v"] - F.col(value)
        w = F.exp(-far / (2 * sigma_s * sigma_s) - rise * rise / (2 * sigma_r * sigma_r))
        return F.struct((acc["w"] + w).alias("w"), (acc["s"] + w * n["v"]).alias("s"))

    start = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("s"))
    mean = F.aggregate("__a", start, add, lambda acc: F.try_divide(acc["s"], acc["w"]))
    return df.withColumn(out, F.when(F.col(value).isNotNull(), mean)).drop("__a")


def gaussian(df: DataFrame, sigma: float, value: str = "z", out: str = "blurred") -> DataFrame:
    """Separable blur of radius max(1, floor(3 sigma + 0.5)), border cells repeated outside."""
    r = max(1, math.floor(3 * sigma + 0.5))
    weights = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-r, r + 1)]
    total = sum(weights)

    def one(df: DataFrame, axis: str, source: str) -> DataFrame:
        order = along(axis)
        whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        mean = F.lit(0.0)
        for i, w in zip(range(-r, r + 1), weights, strict=True):
            v = F.col(source) if i == 0 else F.coalesce(F.lag(source, -i).over(order), F.first(source).over(whole)) if i < 0 else F.coalesce(F.lead(source, i).over(order), F.last(source).over(whole))
            mean = mean + v * (w / total)
        return df.withColumn(out, mean)

    return one(one(df, "col", value), "row", out)


def gradient(df: DataFrame, gsd: float, value: str = "z") -> DataFrame:
    """``gx`` along columns and ``gy`` along rows: central inside, one-sided at the ends."""

    def slope(axis: str) -> Column:
        a, b = F.lag(value).over(along(axis)), F.lead(value).over(along(axis))
        v = F.col(value)
        return F.when(a.isNotNull() & b.isNotNull(), (b - a) / (2 * gsd)).when(b.isNotNull(), (b - v) / gsd).when(a.isNotNull(), (v - a) / gsd).otherwise(F.lit(0.0))

    return df.withColumn("gx", slope("col")).withColumn("gy", slope("row"))


def hillshade(df: DataFrame, gsd: float, azimuth: float = 315.0, altitude: float = 45.0, value: str = "z", out: str = "shade") -> DataFrame:
    df = gradient(df, gsd, value)
    slope, aspect = F.atan(F.hypot("gx", "gy")), F.atan2(-F.col("gx"), F.col("gy"))
    az, alt = math.radians(azimuth), math.radians(altitude)
    lit = math.sin(alt) * F.cos(slope) + math.cos(alt) * F.sin(slope) * F.cos(az - aspect)
    return df.withColumn(out, 0.35 + 0.75 * F.least(F.greatest(lit, F.lit(0.0)), F.lit(1.0)))


def lower_median_fill(df: DataFrame, least: int = 3, value: str = "z", carry: tuple[str, ...] = ()) -> DataFrame:
    """Null cells with enough measured neighbours take the lower median of the eight and that neighbour's ``carry`` columns."""
    item = F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), "row", "col", *carry))
    df = gather(df, 1, item, "__a")
    pick = F.get(F.array_sort("__a"), F.floor((F.size("__a") - 1) / 2).cast("int"))
    grow = F.col(value).isNull() & (F.size("__a") >= least)
    filled = {f"{c}_filled": F.when(grow, pick[c]).otherwise(F.col(c)) for c in carry}
    return df.withColumns({"z_filled": F.when(grow, pick["v"]).otherwise(F.col(value)), "grown": grow, **filled}).drop("__a")


def blocks(df: DataFrame, f: int) -> DataFrame:
    """Block coordinates ``brow``, ``bcol``."""
    return df.withColumn("brow", F.floor(F.col("row") / f).cast("int")).withColumn("bcol", F.floor(F.col("col") / f).cast("int"))


def block_percentile(df: DataFrame, f: int, q: float = 0.25, value: str = "z") -> DataFrame:
    """Percentile (linear) of each block's measured cells; ragged blocks count."""
    out = blocks(df, f).groupBy("brow", "bcol").agg(F.percentile(value, q).alias("z"), F.count(value).alias("n"))
    return out.select(F.col("brow").alias("row"), F.col("bcol").alias("col"), "z", "n")


def block_mean(df: DataFrame, f: int, rows: int, cols: int, value: str = "z") -> DataFrame:
    """Mean of whole blocks only, valid where half the cells are measured."""
    out = blocks(df.where((F.col("row") < rows // f * f) & (F.col("col") < cols // f * f)), f)
    out = out.groupBy("brow", "bcol").agg(F.avg(value).alias("z"), F.count(value).alias("n"))
    return out.select(F.col("brow").alias("row"), F.col("bcol").alias("col"), "z", (F.col("n") >= f * f / 2).alias("valid"))


def local_min(df: DataFrame, radius: float, gsd: float, block: float = 0.5, value: str = "z", out: str = "local_min") -> DataFrame:
    """Minimum on blocks of ``block`` metres within ``radius``, brought back to the cells."""
    f, n = max(1, round(block / gsd)), max(1, round(radius / block))
    low = blocks(df, f).groupBy("brow", "bcol").agg(F.min(value).alias("m"))
    low = square(low.select(F.col("brow").alias("row"), F.col("bcol").alias("col"), "m"), "m", F.min, n, "m")
    low = low.select(F.col("row").alias("brow"), F.col("col").alias("bcol"), F.col("m").alias(out))
    return blocks(df, f).join(low, ["brow", "bcol"], "left").drop("brow", "bcol")


def _corners(target: DataFrame, source: DataFrame, value: str) -> DataFrame:
    """Join the source cells right of, below and below right of (y0, x0) as za .. zd (the last row and column repeat): one join, the stencil by windows."""
    source = source.select(F.col("row").alias("y0"), F.col("col").alias("x0"), F.struct(F.col(value).alias("v")).alias("a"))
    row, col = Window.partitionBy("y0").orderBy("x0"), Window.partitionBy("x0").orderBy("y0")
    source = source.withColumn("b", F.coalesce(F.lead("a").over(row), "a"))
    source = source.withColumns({"c": F.coalesce(F.lead("a").over(col), "a"), "d": F.coalesce(F.lead("b").over(col), "b")})
    return target.join(source.select("y0", "x0", *[F.col(f"{c}.v").alias(f"z{c}") for c in "abcd"]), ["y0", "x0"], "left")


def bilinear(fx: Column, fy: Column) -> Column:
    return (F.col("za") * (1 - fx) + F.col("zb") * fx) * (1 - fy) + (F.col("zc") * (1 - fx) + F.col("zd") * fx) * fy


def _target(spark, rows: int, cols: int, sy: float, sx: float, h: int, w: int) -> DataFrame:
    """Output cells with their source position (pixel centres aligned, clamped) and its four neighbours."""
    grid = spark.range(rows * cols).select((F.floor(F.col("id") / cols)).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col"))
    y = F.least(F.greatest((F.col("row") + 0.5) * sy - 0.5, F.lit(0.0)), F.lit(h - 1.0))
    x = F.least(F.greatest((F.col("col") + 0.5) * sx - 0.5, F.lit(0.0)), F.lit(w - 1.0))
    grid = grid.withColumn("y0", F.floor(y).cast("int")).withColumn("x0", F.floor(x).cast("int")).withColumn("fy", y - F.floor(y)).withColumn("fx", x - F.floor(x))
    return grid


def resize(df: DataFrame, h: int, w: int, rows: int, cols: int, value: str = "z") -> DataFrame:
    """Bilinear resize of an h x w raster; each output cell joins its four neighbours."""
    t = _corners(_target(df.sparkSession, rows, cols, h / rows, w / cols, h, w), df, value)
    return t.select("row", "col", bilinear(F.col("fx"), F.col("fy")).alias("z"))


def resample_edges(df: DataFrame, h: int, w: int, gsd: float, rows: int, cols: int, out_gsd: float, step: float = 0.3) -> DataFrame:
    """Bilinear on smooth ground; the nearest cell across steps of more than ``step`` and beside nulls."""
    s = out_gsd / gsd
    t = _corners(_target(df.sparkSession, rows, cols, s, s, h, w), df, "z")
    ny = F.least(F.greatest(F.floor((F.col("row") + 0.5) * s), F.lit(0)), F.lit(h - 1)).cast("int")
    nx = F.least(F.greatest(F.floor((F.col("col") + 0.5) * s), F.lit(0)), F.lit(w - 1)).cast("int")
    t = t.withColumn("ny", ny).withColumn("nx", nx).join(df.select(F.col("row").alias("ny"), F.col("col").alias("nx"), F.col("z").alias("nearest")), ["ny", "nx"], "left")
    smooth = bilinear(F.col("fx"), F.col("fy"))
    rough = smooth.isNull() | (F.greatest("za", "zb", "zc", "zd") - F.least("za", "zb", "zc", "zd") > step)
    return t.select("row", "col", F.when(rough, F.col("nearest")).otherwise(smooth).alias("z"))


def push_pull(df: DataFrame, value: str = "z", shape: tuple[int, int] | None = None) -> DataFrame:
    """Null cells of a whole grid (rows and columns from 0) filled from a pyramid of means.

    The number of levels follows the size; each halves the grid, so all of them together hold a third more cells.
    """
    if shape is None:
        _, r1, _, c1 = extent(df)
        shape = r1 + 1, c1 + 1
    shapes, levels = [shape], [df.select("row", "col", F.col(value).cast("double").alias("z"))]
    while min(shapes[-1]) > 4:
        h, w = shapes[-1]
        shapes.append(((h + 1) // 2, (w + 1) // 2))
        up = levels[-1].groupBy(F.floor(F.col("row") / 2).cast("int").alias("row"), F.floor(F.col("col") / 2).cast("int").alias("col"))
        levels.append(up.agg(F.avg("z").alias("z")))
    mean = F.avg("z").over(Window.partitionBy(F.lit(0)))  # the coarsest level: at most 4 cells on its short side
    filled = levels[-1].withColumn("z", F.coalesce("z", mean, F.lit(0.0)))
    for (h, w), (ph, pw), level in zip(shapes[-2::-1], shapes[:0:-1], levels[-2::-1], strict=True):
        t = _corners(_target(df.sparkSession, h, w, 0.5, 0.5, ph, pw), filled, "z")
        up = t.select("row", "col", bilinear(F.col("fx"), F.col("fy")).alias("up"))
        filled = up.join(level, ["row", "col"], "left").select("row", "col", F.coalesce("z", "up").alias("z"))
    return filled
