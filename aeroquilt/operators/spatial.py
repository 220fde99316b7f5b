"""Neighbour and range joins: near things meet by an equi-join on grid cells, never by comparing all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..lineage import cut


def tasks(spark: SparkSession) -> int:
    """How many tasks to deal rows to that cost far more than their size tells: a few for each core."""
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt to ``tasks``, by keys if there are any; a small file is one task else."""
    return df.repartition(tasks(df.sparkSession), *keys)


def product_join(few: DataFrame, many: DataFrame, on: str, by: str, shares: int = 32) -> DataFrame:
    """All pairs with equal ``on``, of which there may be few values: the rows of ``many`` are dealt to ``shares`` by ``by``, and those of ``few`` go to each."""
    few = few.withColumn("__share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    many = many.withColumn("__share", F.pmod(F.xxhash64(by), F.lit(shares)).cast("int"))
    return spread(few, on, "__share").hint("shuffle_hash").join(spread(many, on, "__share"), [on, "__share"]).drop("__share")


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """``df`` with its place (from 1) by a column without ties: ranges are sorted on their own, and only the sizes of ranges meet in one place."""
    own = F.monotonically_increasing_id()
    ranges = cut(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("__at", own))  # cut: another sample would give other ranges
    ranges = ranges.withColumn("__range", F.shiftright("__at", 33)).withColumn("__at", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = ranges.groupBy("__range").agg(F.count("*").alias("n"))
    before = sizes.select("__range", (F.sum("n").over(Window.orderBy("__range")) - F.col("n")).alias("__before"))  # one row per range
    return ranges.join(F.broadcast(before), "__range").withColumn(name, F.col("__before") + F.col("__at") + 1).drop("__range", "__at", "__before")


def cells_around(df: DataFrame, x: str, y: str, size: float) -> DataFrame:
    """Nine rows for each row: its own cell and the eight around it, as ``gx``, ``gy``."""
    step = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    df = df.withColumn("__dx", step).withColumn("__dy", step)
    return df.withColumn("gx", F.floor(F.col(x) / size) + F.col("__dx")).withColumn("gy", F.floor(F.col(y) / size) + F.col("__dy")).drop("__dx", "__dy")


def radius_join(left: DataFrame, right: DataFrame, radius: float, on: tuple[str, ...] = (), strict: bool = False) -> DataFrame:
    """Rows (left, right) within ``radius``; left has qx, qy and right px, py.  ``on``: further columns that must be equal.

    Both are dealt to ``tasks`` by cell and merged: broadcast, the rows of a small file would find all their neighbours in one task.
    """
    keys = ["gx", "gy", *on]
    probe = spread(cells_around(left, "qx", "qy", radius), *keys)
    build = spread(right.withColumn("gx", F.floor(F.col("px") / radius)).withColumn("gy", F.floor(F.col("py") / radius)), *keys)
    out = probe.join(build.hint("merge"), keys).drop("gx", "gy")
    d2 = (F.col("qx") - F.col("px")) * (F.col("qx") - F.col("px")) + (F.col("qy") - F.col("py")) * (F.col("qy") - F.col("py"))
    out = out.withColumn("d2", d2)
    return out.where(F.col("d2") < radius * radius if strict else F.col("d2") <= radius * radius)


def knn_radius(queries: DataFrame, points: DataFrame, k: int, radius: float) -> DataFrame:
    """The k nearest points strictly within ``radius`` (ties: lower id), ``rank`` from 1; queries (query, qx, qy), points (point, px, py)."""
    near = radius_join(queries, points, radius, strict=True)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("d2", "point"))).where(F.col("rank") <= k)
    return queries.select("query").join(ranked.select("query", "rank", "point", "d2"), "query", "left")


def knn_pairs(frames: DataFrame, k: int, reach: float) -> DataFrame:
    """Undirected pairs (i, j) of each frame and its k nearest (ties: lower id).

    Rings of cells are searched: a frame whose k-th neighbour lies within ``reach`` is done; the others search twice as far, until all are.
    Each ring is computed once and kept.  Frames: (id, x, y); those without a position have no neighbours.
    """
    frames = cut(frames.where("x is not null and y is not null").select("id", "x", "y"))
    n = frames.count()
    k = min(k, n - 1)
    if k < 1:
        return frames.select(F.col("id").alias("i"), F.col("id").alias("j")).where("i <> j")
    points = frames.select(F.col("id").alias("j"), F.col("x").alias("px"), F.col("y").alias("py"))
    left, done = frames.select(F.col("id").alias("i"), F.col("x").alias("qx"), F.col("y").alias("qy")), None
    while True:
        near = radius_join(left, points, reach).where("i <> j")
        ranked = cut(near.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy("d2", "j"))).where(F.col("rank") <= k).select("i", "j"))
        full = ranked.groupBy("i").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("i")
        found = ranked.join(full, "i", "left_semi").select("i", "j")
        done = found if done is None else done.unionByName(found)
        left = cut(left.join(full, "i", "left_anti"))
        if left.isEmpty():
            break
        reach *= 2
    return done.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct()


def capture_pairs(frames: DataFrame, k: int, all_below: int = 40) -> DataFrame:
    """Pairs without positions: all of them for few frames, else a window of k in capture order (``id``)."""
    n = frames.count()
    reach = n - 1 if n <= all_below else k
    df = numbered(frames, "id", "at")
    ahead = df.select(F.col("id").alias("i"), F.explode(F.sequence(F.col("at") + 1, F.col("at") + max(1, reach))).alias("at"))
    return ahead.join(df.select(F.col("id").alias("j"), "at"), "at").select("i", "j")


def overlap_tiles(boxes: DataFrame, width: float, height: float) -> DataFrame:
    """(tile row, tile column, id) of the tiles that each box meets: boxes name their tiles, no tile is compared.  boxes: (id, x0, y0, x1, y1)."""
    span = lambda a, b, size: F.explode(F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size)))
    return boxes.withColumn("tx", span("x0", "x1", width)).withColumn("ty", span("y0", "y1", height)).select(F.col("ty").cast("int").alias("ty"), F.col("tx").cast("int").alias("tx"), "id")


def auto_neighbours(frames: DataFrame, half: float, low: int = 6, high: int = 12, default: int = 10) -> DataFrame:
    """One row: median number of other frames within half the footprint's short side, clipped."""
    points = frames.where("x is not null").select(F.col("id").alias("j"), F.col("x").alias("px"), F.col("y").alias("py"))
    near = radius_join(points.select(F.col("j").alias("i"), F.col("px").alias("qx"), F.col("py").alias("qy")), points, half)
    counts = near.groupBy("i").agg((F.count("*") - 1).alias("n"))
    return counts.agg(F.coalesce(F.least(F.greatest(F.floor(F.median("n")).cast("int"), F.lit(low)), F.lit(high)), F.lit(default)).alias("k"))
