"""Queries over frames, gates and small rules, with their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import blocks as B
from ..operators import policies as P
from ..operators import spatial as S
from ..sources import text as TX
from .fixtures import ctes, view
from .survey_queries import overlap_count as _overlap

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


_GCPS = "p as (select string_split_regex(trim(line), '[,\\s]+') as p from gcp_text)"


@query(f"with {ctes('gcp_text')}, {_GCPS} select p[7] as name, string_split(p[6], '/')[-1] as image, round(cast(p[1] as double) - 230010, 6) as x, round(cast(p[2] as double) - 2635020, 6) as y from p")
def gcp_local(spark, sf_dir):
    g = P.control_points(TX.parse_gcps(view(spark, sf_dir, "gcp_text")), (230010.0, 2635020.0))
    return g.select("name", "image", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(f"with {ctes('world_points')} select pt_id, round(x + (100 - 87.5e0), 6) as x, round(y + (50 - 61.25e0), 6) as y from world_points")
def rebased_points(spark, sf_dir):
    return P.rebase(view(spark, sf_dir, "world_points"), (100.0, 50.0), (87.5, 61.25)).select("pt_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


_AFFINES = "aff as (select image_id, width, height, 0.02e0*cos(t) as a, 0.02e0*sin(t) as b, image_id%50*12e0 as c, 0.02e0*sin(t) as d, -0.02e0*cos(t) as e, image_id%40*9e0 as f, t, rel_alt from (select *, radians(image_id%300-150) as t from frames))"


def _affines(spark, sf_dir):
    t = F.radians(F.col("image_id") % 300 - 150)
    return view(spark, sf_dir, "frames").select("image_id", "width", "height", "rel_alt", (0.02 * F.cos(t)).alias("a"), (0.02 * F.sin(t)).alias("b"), (F.col("image_id") % 50 * 12.0).alias("c"), (0.02 * F.sin(t)).alias("d"), (-0.02 * F.cos(t)).alias("e"), (F.col("image_id") % 40 * 9.0).alias("f"))


@query(f"with {ctes('frames')}, {_AFFINES} select image_id, round(c + 230000, 4) as c, round(f + 2635000, 4) as f from aff")
def absolute_affine(spark, sf_dir):
    return P.absolute_affine(_affines(spark, sf_dir), (230000.0, 2635000.0)).select("image_id", F.round("c", 4).alias("c"), F.round("f", 4).alias("f"))


@query(f"with {ctes('frames')}, {_AFFINES} select image_id, round(degrees(t), 5) + 0e0 as yaw, round(a*599.5e0+b*449.5e0+c, 5) as x, round(d*599.5e0+e*449.5e0+f, 5) as y, round(case when image_id%2=0 then rel_alt else 1150*0.02e0 end, 5) as height from aff")
def nadir_poses(spark, sf_dir):
    given = _affines(spark, sf_dir).withColumns({"ppx": F.lit(599.5), "ppy": F.lit(449.5), "focal": F.lit(1150.0)})
    p = P.nadir_pose(given, F.when(F.col("image_id") % 2 == 0, F.col("rel_alt")))
    return p.select("image_id", (F.round(F.degrees("yaw"), 5) + 0.0).alias("yaw"), F.round("x", 5).alias("x"), F.round("y", 5).alias("y"), F.round("height", 5).alias("height"))


@query(f"with {ctes('frames')} select image_id, round(image_id%40-20, 6) + 0e0 as roll, round(image_id%60-30, 6) + 0e0 as pitch, round(image_id%300-150, 6) + 0e0 as yaw from frames")
def rig_euler(spark, sf_dir):
    i = F.col("image_id")
    (cx, sx), (cy, sy), (cz, sz) = [(F.cos(F.radians(a)), F.sin(F.radians(a))) for a in (i % 40 - 20, i % 60 - 30, i % 300 - 150)]
    r = [[cz * cy, cz * sy * sx - sz * cx, cz * sy * cx + sz * sx], [sz * cy, sz * sy * sx + cz * cx, sz * sy * cx - cz * sx], [-sy, cy * sx, cy * cx]]
    names = ("roll", "pitch", "yaw")
    return view(spark, sf_dir, "frames").select("image_id", *[(F.round(a, 6) + 0.0).alias(n) for a, n in zip(P.rig_angles(r), names, strict=True)])


@query(f"with {ctes('frames')} select image_id, case when image_id%3=0 then 'temperature (°C)' else 'raw sensor value' end as label from frames")
def value_labels(spark, sf_dir):
    units = F.when(F.col("image_id") % 3 == 0, "°C").otherwise("raw")
    return view(spark, sf_dir, "frames").select("image_id", P.value_label(units).alias("label"))


@query(f"with {ctes('points')} select l_orderkey, l_linenumber, cast(floor(least(greatest(1.25e0*r-20e0+0.5e0, 0), 255)) as int) as level, case when l_linenumber%4<>0 then round(((r+g+b)/3e0-128e0)/64e0, 6) end as gray from points")
def corrected_colour(spark, sf_dir):
    c = F.col
    return view(spark, sf_dir, "points").select("l_orderkey", "l_linenumber", P.corrected_level(c("r"), F.lit(1.25), F.lit(-20.0)).alias("level"), F.round(P.matching_gray(c("r"), c("g"), c("b"), c("l_linenumber") % 4 != 0), 6).alias("gray"))


@query(f"with {ctes('frames')}, m as (select median(width+image_id%7*400) as w, median(height+image_id%7*300) as h from frames) select cast(least(greatest(round_even(w*h*least(1e0, 2400e0/greatest(w,h))*least(1e0, 2400e0/greatest(w,h))/1e6*1.25e0, 0)*1000, 4000), 20000) as int) as keypoints from m")
def keypoint_budget(spark, sf_dir):
    f = view(spark, sf_dir, "frames").selectExpr("width + image_id%7*400 as width", "height + image_id%7*300 as height")
    return P.keypoint_budget(f, 2400)


@query(f"with {ctes('frames')}, r as (select image_id, case when image_id%5=0 then null else image_id%9*0.01e0 end as want, 0.05e0 as gsd, image_id%2=0 as force from frames) select image_id, round(case when want is null then gsd when force then want else greatest(want, gsd*0.9e0) end, 9) as cell from r")
def capped_resolution(spark, sf_dir):
    i = F.col("image_id")
    cell = P.capped_resolution(F.when(i % 5 != 0, i % 9 * 0.01), F.lit(0.05), i % 2 == 0)
    return view(spark, sf_dir, "frames").select("image_id", F.round(cell, 9).alias("cell"))


_EDGES = "e as (select a.cam_id, b.cam_id as other, a.cz, sqrt((a.cx-b.cx)*(a.cx-b.cx)+(a.cy-b.cy)*(a.cy-b.cy)+(a.cz-b.cz)*(a.cz-b.cz)) as base from cameras a join cameras b on a.cam_id <> b.cam_id and (a.cx-b.cx)*(a.cx-b.cx)+(a.cy-b.cy)*(a.cy-b.cy) <= 17*17)"


def _edges(spark, sf_dir):
    cam = view(spark, sf_dir, "cameras")
    left = cam.select("cam_id", "cz", F.col("cx").alias("qx"), F.col("cy").alias("qy"))
    right = cam.select(F.col("cam_id").alias("other"), F.col("cz").alias("oz"), F.col("cx").alias("px"), F.col("cy").alias("py"))
    near = S.radius_join(left, right, 17.0).where("cam_id <> other")
    return near.select("cam_id", "other", "cz", F.sqrt(F.col("d2") + (F.col("cz") - F.col("oz")) * (F.col("cz") - F.col("oz"))).alias("base"))


@query(f"with {ctes('cameras')}, {_EDGES}, m as (select cam_id, median(base) as base from e group by 1) select c.cam_id, cast(case when base is null then 32 else least(greatest(ceil(287.5e0*base*(1/(cz-20e0)-1/cz)), 32), 96) end as int) as steps from cameras c left join m using (cam_id)")
def depth_steps(spark, sf_dir):
    base = _edges(spark, sf_dir).groupBy("cam_id").agg(F.median("base").alias("base"))
    c = view(spark, sf_dir, "cameras").join(base, "cam_id", "left")
    return c.select("cam_id", P.depth_steps(F.lit(287.5), F.col("base"), F.col("cz") - 20.0, F.col("cz"), 32).alias("steps"))


@query(f"with {ctes('cameras')}, {_EDGES} select cam_id, other, round(least(greatest(2e0*cz/greatest(1150e0*base, 1e-9), 0.01e0), 0.05e0), 8) as tolerance from e")
def depth_tolerances(spark, sf_dir):
    return _edges(spark, sf_dir).select("cam_id", "other", F.round(P.depth_tolerance(2.0, F.col("cz"), F.lit(1150.0), F.col("base")), 8).alias("tolerance"))


@query(f"with {ctes('cells')} select cast(greatest(min(row) filter (where z > 48)-2, 0) as int) as row0, cast(greatest(min(col) filter (where z > 48)-2, 0) as int) as col0, cast(least(max(row) filter (where z > 48)+3, max(row)+1) as int) as row1, cast(least(max(col) filter (where z > 48)+3, max(col)+1) as int) as col1 from cells")
def crop_box(spark, sf_dir):
    return P.crop_box(view(spark, sf_dir, "cells"), F.col("z") > 48)


@query("select o_orderkey, case when o_orderkey%7=0 then '-' else format('{:,.2f}', o_orderkey*1250.25e0) end as text from orders")
def grouped_numbers(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    return o.select("o_orderkey", P.grouped_number(F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey") * F.lit(1250.25))).alias("text"))


@query("select vec_id from embeddings where not ((vec_id*91%300)%4=0 and (vec_id*37%400)%3=0 and label%2=0)")
def unmasked_features(spark, sf_dir):
    f = spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr("vec_id", "concat('dir/CAP_', label, '.JPG') as image", "vec_id*37%400 + 0.3D as x", "vec_id*91%300 - 0.3D as y", "400 as width", "300 as height", "label")
    names = f.where("label % 2 = 0").selectExpr("concat('CAP_', label) as stem").distinct()
    masks = names.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(299), F.lit(4)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(399), F.lit(3))))
    return P.unmasked(f, masks).select("vec_id")


@query(f"with {ctes('points')} select l_orderkey, l_linenumber, case when r/255e0 >= 0.3e0 and g/64e0 >= 0.5e0 and z >= 5 and z <= 45 then z end as depth from points")
def kept_depths(spark, sf_dir):
    c = F.col
    return view(spark, sf_dir, "points").select("l_orderkey", "l_linenumber", P.kept_depth(c("z"), c("r") / 255.0, c("g") / 64.0, F.lit(5), F.lit(45)).alias("depth"))


@query(f"with {ctes('frames')} select case when bool_and(focal35 is not null) then 'radiometric' when bool_or(focal35 is not null) then 'mixed' else 'colour' end as mode from frames")
def thermal_mode(spark, sf_dir):
    return P.thermal_mode(view(spark, sf_dir, "frames"), F.col("focal35").isNotNull())


@query(f"with {ctes('frames')} select image_id, case when (select bool_and(rel_alt is not null) from frames) then 0.95e0 end as emissivity, case when (select bool_and(rel_alt is not null) from frames) then rel_alt end as distance, case when (select bool_and(rel_alt is not null) from frames) then '°C' else 'raw' end as units from frames")
def calibrated_frames(spark, sf_dir):
    f = view(spark, sf_dir, "frames").select("image_id", F.lit(1.0).alias("emissivity"), F.col("rel_alt").alias("distance"))
    return P.survey_calibration(f, ["emissivity", "distance"], emissivity=0.95)


@query(f"""with {ctes('frames')}, {_AFFINES}, k as (select a*u+b*v+c as x, d*u+e*v+f as y from (select *, unnest([-0.5e0, width-0.5e0]) as u from aff), (select 0) z, lateral (select unnest([-0.5e0, height-0.5e0]) as v) w),
    b as (select floor(min(x)/0.25e0)*0.25e0 as min_x, ceil(max(x)/0.25e0)*0.25e0 as max_x, floor(min(y)/0.25e0)*0.25e0 as min_y, ceil(max(y)/0.25e0)*0.25e0 as max_y from k) select *, cast(round((max_x-min_x)/0.25e0) as bigint) as width, cast(round((max_y-min_y)/0.25e0) as bigint) as height from b""")
def mosaic_extent(spark, sf_dir):
    return P.mosaic_extent(_affines(spark, sf_dir), 0.25)


@query(f"with {ctes('cells', 'cameras')}, c as (select row, col, (col+0.5e0)*1.25e0 as x, (row+0.5e0)*2.5e0 as y from cells), n as (select row, col, count(*) as n from c join cameras k on abs(x-cx) <= 20 and abs(y-cy) <= 15 group by 1, 2) select median(n) as median, round(avg(case when n>=5 then 1e0 else 0 end), 9) as five, round(avg(case when n>=3 then 1e0 else 0 end), 9) as three from n")
def overlap_statistics(spark, sf_dir):
    return P.overlap_statistics(_overlap(spark, sf_dir)).select("median", F.round("five", 9).alias("five"), F.round("three", 9).alias("three"))


@query(f"with {ctes('observations')}, k as (select cam_id, count(*) as n from observations group by 1) select (select count(distinct pt_id) from observations) as points, (select count(*) from observations) as observations, round((select count(*) from observations)*1e0/(select count(distinct pt_id) from observations), 9) as track_length, cast(floor(median(n)) as bigint) as per_camera from k")
def block_statistics(spark, sf_dir):
    s = P.block_statistics(view(spark, sf_dir, "observations"))
    return s.select("points", "observations", F.round("track_length", 9).alias("track_length"), "per_camera")


@query(f"with {ctes('photo_samples')}, r as (select row, col, value, row_number() over (partition by row, col order by value desc, photo) as k from photo_samples) select row, col, round(avg(value), 6) as value from r where k <= 3 group by row, col")
def mean_of_largest(spark, sf_dir):
    a = view(spark, sf_dir, "photo_samples").groupBy("row", "col").agg(F.collect_list(F.col("value").cast("double")).alias("v"))  # at most one value per photo
    return a.select("row", "col", F.round(P.mean_of_largest(F.col("v"), 3), 6).alias("value"))


@query(f"with {ctes('world_points')}, r as (select pt_id, row_number() over (order by pt_id) as k from world_points) select pt_id from r where (k-1)%7 = 0")
def thinned_points(spark, sf_dir):
    return P.every_nth(view(spark, sf_dir, "world_points").select("pt_id"), "pt_id", 7)


@query(f"with {ctes('match_edges')}, m as (select a.i, a.fi, count(*) filter (where b.j = a.j) as shared from match_edges a join match_edges b on b.i = a.i and b.fi = a.fi + 1 group by 1, 2) select i, fi, shared = 0 as apart from m")
def disjoint_tracks(spark, sf_dir):
    t = view(spark, sf_dir, "match_edges").groupBy("i", "fi").agg(F.collect_set("j").alias("images"))  # at most one entry per photo
    after = t.select("i", (F.col("fi") - 1).alias("fi"), F.col("images").alias("others"))
    return t.join(after, ["i", "fi"]).select("i", "fi", P.may_merge(F.col("images"), F.col("others")).alias("apart"))


@query(f"with {ctes('cells')}, p as (select row, col, z - 20 as z from cells where z > 20), n as (select a.row, a.col, a.z, max(case when b.row < a.row or (b.row = a.row and b.col < a.col) then b.z end) as before, max(case when b.row > a.row or (b.row = a.row and b.col > a.col) then b.z end) as after from p a left join p b on abs(a.row-b.row) <= 1 and abs(a.col-b.col) <= 1 and (a.row <> b.row or a.col <> b.col) group by 1, 2, 3) select row, col, z from n where z > coalesce(before, 0) and z >= coalesce(after, 0)")
def corner_maxima(spark, sf_dir):
    return P.corner_maxima(view(spark, sf_dir, "cells").select("row", "col", (F.col("z") - 20).alias("z")))


_MARKS = "k as (select o.cam_id, o.pt_id, c.cz-p.z as depth, abs(p.x-c.cx)+(case when o.pt_id%50=0 then 900e0 else 0e0 end) as error from observations o join cameras c using (cam_id) join world_points p using (pt_id)), m as (select median(error) as e, median(depth) as d from k)"


@query(f"with {ctes('observations')}, {_MARKS} select cam_id, pt_id from k, m where error < greatest(30e0, 10*e) and depth > 0.1e0*d")
def marks_on_geometry(spark, sf_dir):
    o = view(spark, sf_dir, "observations").join(view(spark, sf_dir, "cameras"), "cam_id").join(view(spark, sf_dir, "world_points"), "pt_id")
    k = o.select("cam_id", "pt_id", (F.col("cz") - F.col("z")).alias("depth"), (F.abs(F.col("x") - F.col("cx")) + F.when(F.col("pt_id") % 50 == 0, 900.0).otherwise(0.0)).alias("error"))
    return P.on_geometry(k).select("cam_id", "pt_id")
