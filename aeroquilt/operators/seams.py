"""Choosing one photo per cell: cheapest labels, smoothed by synchronous sweeps over the four neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut
from .raster import along


def potts_labels(costs: DataFrame, weight: float, sweeps: int = 12) -> DataFrame:
    """(row, col, label) of least cost + ``weight`` for each neighbour with another label (ties: lower label).

    All cells of a sweep read the labels of the one before, so the result does not depend on partitions.  Sweeps end when nothing changes.
    costs: (row, col, label, cost), at most a few labels per cell.
    """
    costs = cut(costs.groupBy("row", "col").agg(F.array_sort(F.collect_list(F.struct("cost", "label"))).alias("options")))
    now = cut(costs.select("row", "col", "options", F.col("options")[0]["label"].alias("label")))
    for _ in range(sweeps):
        around = [f("label").over(along(axis)) for axis in ("row", "col") for f in (F.lag, F.lead)]
        place = [f(axis).over(along(axis)) for axis in ("row", "col") for f in (F.lag, F.lead)]
        near = [F.when(F.abs(p - F.col(a)) == 1, n) for n, p, a in zip(around, place, ("row", "row", "col", "col"), strict=True)]
        df = now.withColumns({f"__n{i}": n for i, n in enumerate(near)}).withColumn("__near", F.array_compact(F.array(*[f"__n{i}" for i in range(4)])))
        scored = F.transform("options", lambda o: F.struct((o["cost"] + weight * F.size(F.filter("__near", lambda n: n != o["label"]))).alias("cost"), o["label"].alias("label")))
        new = cut(df.select("row", "col", "options", F.array_min(scored)["label"].alias("label"), F.col("label").alias("before")))
        now = new.drop("before")
        if new.where("label <> before").isEmpty():
            break
    return now.select("row", "col", "label")


def depth_agreement(pixels: DataFrame, neighbours: DataFrame, px: float, relative: float) -> DataFrame:
    """Pixels (cam, u, v, depth) with the number of neighbouring maps that agree: near in the image and within a share of the depth.

    neighbours: (cam, other, u, v, depth, nu, nv, ndepth): what the other map says where the pixel lands.
    """
    ok = (F.hypot(F.col("nu") - F.col("u"), F.col("nv") - F.col("v")) <= px) & (F.abs(F.col("ndepth") - F.col("depth")) <= relative * F.col("ndepth"))
    votes = neighbours.where(ok).groupBy("cam", "u", "v").agg(F.count_distinct("other").alias("agree"))
    return pixels.join(votes, ["cam", "u", "v"], "left").withColumn("agree", F.coalesce("agree", F.lit(0)))


def hash_cap(matches: DataFrame, by: list[str], key: list[str], most: int = 150) -> DataFrame:
    """At most ``most`` rows per group, chosen by a hash of their key: the same rows on every run and at every parallelism."""
    w = Window.partitionBy(*by).orderBy(F.xxhash64(*key), *key)
    return matches.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= most).drop("__k")
