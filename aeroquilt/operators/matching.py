"""Descriptor matching, tracks and graphs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut
from .spatial import cells_around, spread


def hamming(a: str | Column, b: str | Column) -> Column:
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return F.bit_count(a.bitwiseXOR(b))


def _nearest(left: DataFrame, right: DataFrame, on: tuple[str, ...], radius: float | None = None, block: int = 4096) -> DataFrame:
    """Nearest descriptors among the rows of ``left`` (i, j, a, da) and ``right`` (i, j, b, db) with equal ``on``, both ways.

    Rows i, j, side, id, other, ham, second: for each a (side 0) the nearest b (ties: lower id) and the second distance, for each b (side 1) the nearest a.
    ``radius``: only pairs whose places (qx, qy) and (px, py) are that near.  All pairs are compared, in blocks of about ``block`` rows of each side that tasks
    hold a strip at a time; only what is nearest within a block leaves it, so no table of pairs is ever made.
    """
    parts = lambda df, name: df.groupBy(*on).agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    both = parts(left, "__m").join(parts(right, "__n"), [*on])
    all_of = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = left.where("da is not null").join(both, [*on]).withColumn("__p", F.pmod(F.xxhash64("a"), "__m").cast("int")).withColumn("__q", all_of("__n")).drop("__m", "__n")
    right = right.where("db is not null").join(both, [*on]).withColumn("__q", F.pmod(F.xxhash64("b"), "__n").cast("int")).withColumn("__p", all_of("__m")).drop("__m", "__n")
    keys = [*on, "__p", "__q"]

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        x, y = x.sort_by("a"), y.sort_by("b")
        a, b = x.column("a").to_numpy(), y.column("b").to_numpy()
        da, db = x.column("da").to_numpy().view(np.uint64), y.column("db").to_numpy().view(np.uint64)
        m, n = len(a), len(b)
        best, ham, second = np.zeros(m, int), np.full(m, 255, np.uint8), np.full(m, 255, np.uint8)
        back, least = np.zeros(n, int), np.full(n, 255, np.uint8)
        wide = max(1, (1 << 20) // max(n, 1))
        for k in range(0, m if n else 0, wide):
            d = np.bitwise_count(da[k : k + wide, None] ^ db)
            if radius is not None:
                dx, dy = (x.column(q).to_numpy()[k : k + wide, None] - y.column(p).to_numpy() for q, p in (("qx", "px"), ("qy", "py")))
                d[~(dx * dx + dy * dy <= radius * radius)] = 255
            low = d.min(axis=0)
            new = np.flatnonzero(low < least)
            least[new], back[new] = low[new], k + d[:, new].argmin(axis=0)
            rows, at = np.arange(len(d)), d.argmin(axis=1)
            best[k : k + wide], ham[k : k + wide] = at, d[rows, at]
            d[rows, at] = 255
            second[k : k + wide] = d.min(axis=1)
        f, g = ham < 255, least < 255
        size, both = int(f.sum()), int(f.sum() + g.sum())
        put = lambda v: pa.array([v] * both, pa.int64())
        return pa.table({
            "i": put(x.column("i")[0].as_py() if m else None), "j": put(x.column("j")[0].as_py() if m else None),
            "side": pa.array(np.repeat([0, 1], [size, both - size]), pa.int32()), "id": pa.array(np.concatenate([a[f], b[g]]), pa.int64()),
            "other": pa.array(np.concatenate([b[best[f]], a[back[g]]]) if both else np.empty(0), pa.int64()), "ham": pa.array(np.concatenate([ham[f], least[g]]), pa.int32()),
            "second": pa.array(np.concatenate([second[f], np.full(both - size, 255)]), pa.int32(), mask=np.concatenate([second[f] == 255, np.ones(both - size, bool)])),
        })

    kinds = {c: left.schema[c].dataType for c in ("i", "j")}
    left, right = (spread(df.withColumns({c: F.col(c).cast("long") for c in ids}), *keys) for df, ids in ((left, ("a", "da")), (right, ("b", "db"))))
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # columns of its own, where both sides come from the same pairs
    out = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "i long, j long, side int, id long, other long, ham int, second int")
    told = F.array_sort(F.collect_list(F.struct("ham", "other", "second")))  # one of each block
    out = out.groupBy("i", "j", "side", "id").agg(told.alias("t"))
    near, next_ = F.get("t", F.lit(0)), F.get("t", F.lit(1))
    return out.select(F.col("i").cast(kinds["i"]).alias("i"), F.col("j").cast(kinds["j"]).alias("j"), "side", "id", near["other"].alias("other"), near["ham"].alias("ham"), F.least(near["second"], next_["ham"]).alias("second"))


def _of_pairs(features: DataFrame, pairs: DataFrame) -> DataFrame:
    """Nearest features in both images of every pair (i, j), both ways."""
    left = features.select(F.col("image_id").alias("i"), F.col("feat_id").alias("a"), F.col("dsc").alias("da"))
    right = features.select(F.col("image_id").alias("j"), F.col("feat_id").alias("b"), F.col("dsc").alias("db"))
    pairs = pairs.select("i", "j").distinct()
    return _nearest(pairs.join(left, "i"), pairs.join(right, "j"), ("i", "j"))


def best_match(features: DataFrame, pairs: DataFrame) -> DataFrame:
    """For each feature a of the pair of images (i, j): nearest b (ties: lower id), its distance and the second one."""
    return _of_pairs(features, pairs).where("side = 0").select("i", "j", F.col("id").alias("a"), F.col("other").alias("b"), "ham", "second")


def _mutual(near: DataFrame) -> DataFrame:
    own = lambda c: F.max(F.when(F.col("side") == 0, F.col(c))).alias(c)
    ends = near.select("i", "j", F.when(F.col("side") == 0, F.col("id")).otherwise(F.col("other")).alias("a"), F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("id")).alias("b"), "side", "ham", "second")
    return ends.groupBy("i", "j", "a", "b").agg(own("ham"), own("second"), F.count("*").alias("__sides")).where(F.col("__sides") == 2).drop("__sides")


def mutual(features: DataFrame, pairs: DataFrame, ratio: float | None = None, most: int | None = None) -> DataFrame:
    """Features (a, b) of the pairs of images (i, j) that are each other's nearest; optional ratio and distance tests."""
    out = _mutual(_of_pairs(features, pairs))
    if ratio is not None:
        out = out.where(F.col("second").isNull() | (F.col("ham") < ratio * F.col("second")))
    if most is not None:
        out = out.where(F.col("ham") <= most)
    return out


def guided(features: DataFrame, predicted: DataFrame, radius: float) -> DataFrame:
    """Mutual matches among features within ``radius`` of the predicted position.  predicted: (i, j, a, da, qx, qy)."""
    right = features.select(F.col("image_id").alias("j"), F.col("feat_id").alias("b"), F.col("dsc").alias("db"), F.col("x").alias("px"), F.col("y").alias("py"))
    right = predicted.select("i", "j").distinct().join(right, "j")
    right = right.withColumns({"gx": F.floor(F.col("px") / radius), "gy": F.floor(F.col("py") / radius)})
    return _mutual(_nearest(cells_around(predicted, "qx", "qy", radius), right, ("i", "j", "gx", "gy"), radius))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): least node that it is connected to, by large-star and small-star steps over reliable checkpoints."""
    e = cut(edges.select(F.greatest("i", "j").alias("u"), F.least("i", "j").alias("v")).where("u <> v").distinct())
    stamp = lambda d: tuple(d.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum("v")).first())
    before = stamp(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        after = stamp(e)
        if after == before:
            break
        before = after
    nodes = edges.select(F.explode(F.array("i", "j")).alias("node")).distinct()
    return nodes.join(e.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def largest_component(edges: DataFrame) -> DataFrame:
    """Nodes of the largest component (ties: least label)."""
    label = components(edges)
    size = label.groupBy("component").agg(F.count("*").alias("n"))
    top = size.agg(F.min(F.struct((-F.col("n")).alias("n"), "component")).alias("t")).select(F.col("t.component").alias("component"))
    return label.join(F.broadcast(top), "component").select("node", "component")  # one row


def tracks(edges: DataFrame, shortest: int = 2) -> DataFrame:
    """Consistent tracks (track, image, feature): merges that would give a track two features of one photo are refused, strongest edges first.

    Merges never leave a connected component, so the ordered union runs inside each; its result is that of one pass over everything.
    edges: (i, fi, j, fj, n).
    """
    node = lambda i, f: F.col(i).cast("long") * (1 << 32) + F.col(f)
    e = edges.select(node("i", "fi").alias("i"), node("j", "fj").alias("j"), F.col("n").cast("long").alias("n"))
    label = components(e)
    e = e.join(label.withColumnRenamed("node", "i"), "i")

    def run(group: pa.Table) -> pa.Table:
        rows = sorted(zip(group.column("n").to_pylist(), group.column("i").to_pylist(), group.column("j").to_pylist(), strict=True), key=lambda r: (-r[0], r[1], r[2]))
        root, photos = {}, {}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for _, a, b in rows:
            for x in (a, b):
                if x not in root:
                    root[x], photos[x] = x, {x >> 32: x}
            a, b = find(a), find(b)
            if a == b or photos[a].keys() & photos[b].keys():
                continue
            if len(photos[a]) < len(photos[b]):
                a, b = b, a
            root[b] = a
            photos[a] |= photos.pop(b)
        members = {}
        for x in root:
            members.setdefault(find(x), []).append(x)
        out = [(min(m), x >> 32, x & 0xFFFFFFFF) for m in members.values() if len(m) >= shortest for x in m]
        return pa.table({"track": pa.array([o[0] for o in out], pa.int64()), "image": pa.array([o[1] for o in out], pa.int32()), "feature": pa.array([o[2] for o in out], pa.int32())})

    return e.groupBy("component").applyInArrow(run, "track long, image int, feature int")


def covisible(observations: DataFrame, least: int, top: int) -> DataFrame:
    """The ``top`` photos that share most points with each, of those that share ``least``."""
    o = observations.select("cam_id", "pt_id").distinct()
    pairs = o.join(o.select(F.col("cam_id").alias("other"), "pt_id"), "pt_id").where("cam_id <> other")
    shared = pairs.groupBy("cam_id", "other").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    w = Window.partitionBy("cam_id").orderBy(F.col("n").desc(), "other")
    return shared.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def bucket_topk(features: DataFrame, score: str, width: float, height: float, budget: int, grid: int = 8) -> DataFrame:
    """Per photo: the best of each grid cell, then the best of the rest, up to ``budget`` (ties: lower id)."""
    at = lambda c, size: F.least(F.floor(F.col(c) * grid / size), F.lit(grid - 1))
    df = features.withColumn("cell", at("y", height) * grid + at("x", width))
    order = [F.col(score).desc(), F.col("feat_id")]
    df = df.withColumn("__r", F.row_number().over(Window.partitionBy("image_id", "cell").orderBy(*order)))
    first = F.col("__r") <= max(1, budget // (grid * grid))
    df = df.withColumn("__k", F.row_number().over(Window.partitionBy("image_id").orderBy(first.desc(), *order)))
    return df.where(F.col("__k") <= budget).drop("__r", "__k")
