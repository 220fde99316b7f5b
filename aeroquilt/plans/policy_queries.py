"""Queries over survey policies and per-camera aggregates, with their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import camera as C
from ..functions.rounding import rounded
from ..operators import blocks as B
from ..operators import raster as R
from ..operators import survey as S
from .fixtures import ctes, view
from .raster_queries import CELLS, GAPS, _near, cells, gaps

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _sized(spark, sf_dir):
    return view(spark, sf_dir, "cameras").withColumn("width", F.lit(1200)).withColumn("height", F.lit(900))


def _seen(spark, sf_dir):
    r = B.reproject(view(spark, sf_dir, "observations"), view(spark, sf_dir, "cameras"), view(spark, sf_dir, "world_points"))
    return r.select("cam_id", "pt_id", "u", "v", "cz", "depth")


_SEEN = f"with {ctes('observations')}, seen as (select o.cam_id, o.pt_id, u, v, c.cz, c.cz - p.z as depth from observations o join cameras c using (cam_id) join world_points p using (pt_id))"


@query()
def lens_limit(spark, sf_dir):
    return S.lens_limit(_sized(spark, sf_dir)).select("cam_id", F.round("r2max", 6).alias("r2max"))


@query(f"with {ctes('frames')}, t as (select image_id, ((image_id*7)%1200-600)/600e0 as x, ((image_id*11)%900-450)/600e0 as y from frames) select image_id, round(x*x+y*y, 6) as a, round((x*x+y*y)*(x*x+y*y), 6) as b, round(x*x-y*y, 6) as e, round(x*y + 1e-9, 6) as f from t")
def flat_field_terms(spark, sf_dir):
    i = F.col("image_id")
    t = S.flat_terms((i * 7) % 1200, (i * 11) % 900, F.lit(1200.0), F.lit(900.0))
    return view(spark, sf_dir, "frames").select("image_id", F.round(t[0], 6).alias("a"), F.round(t[1], 6).alias("b"), F.round(t[4], 6).alias("e"), F.round(t[5] + 1e-9, 6).alias("f"))


@query(f"with {ctes('points')} select l_orderkey, l_linenumber, round(0.299e0*r+0.587e0*g+0.114e0*b, 5) as gray from points")
def luminance(spark, sf_dir):
    return view(spark, sf_dir, "points").select("l_orderkey", "l_linenumber", F.round(S.luminance(F.col("r"), F.col("g"), F.col("b")), 5).alias("gray"))


@query(f"with {ctes('observations')} select cam_id, pt_id, round(greatest(least(u+0.5e0, v+0.5e0, 1200-u-0.5e0, 900-v-0.5e0)/450e0, 0), 6) as w from observations")
def border_weight(spark, sf_dir):
    return view(spark, sf_dir, "observations").select("cam_id", "pt_id", rounded(S.border_weight(F.col("u"), F.col("v"), F.lit(1200), F.lit(900)), 6).alias("w"))


@query(f"{_SEEN}, l as (select quantile_cont(z, 0.005) as low from world_points), g as (select cam_id, count(*) as n, quantile_cont(depth, 0.01) as lo, quantile_cont(depth, 0.99) as hi, min(cz) as cz from seen group by cam_id having count(*) >= 10), h as (select cam_id, lo, greatest(hi, cz - low) as hi from g, l) select cam_id, round(greatest(0.3e0*lo, lo-0.2e0*(hi-lo)-1), 5) as near, round(hi+0.2e0*(hi-lo)+2, 5) as far from h")
def depth_range(spark, sf_dir):
    low = view(spark, sf_dir, "world_points").agg(F.percentile("z", 0.005)).first()[0]
    r = S.depth_range(_seen(spark, sf_dir), F.lit(low))
    return r.select("cam_id", F.round("near", 5).alias("near"), F.round("far", 5).alias("far"))


@query(f"{_SEEN}, b as (select cam_id, cast(floor(v/200) as int) as brow, cast(floor(u/200) as int) as bcol, min(depth) as lo, max(depth) as hi from seen group by 1, 2, 3 having count(*) >= 2), n as (select a.cam_id, a.brow, a.bcol, min(b.lo) as lo, max(b.hi) as hi from b a join b on a.cam_id = b.cam_id and abs(a.brow-b.brow) <= 1 and abs(a.bcol-b.bcol) <= 1 group by 1, 2, 3) select cam_id, brow, bcol, round(lo-(1+0.05e0*(hi-lo)), 5) as low, round(hi+(1+0.05e0*(hi-lo)), 5) as high from n")
def depth_band(spark, sf_dir):
    b = S.depth_band(_seen(spark, sf_dir), 200, 2)
    return b.select("cam_id", "brow", "bcol", F.round("low", 5).alias("low"), F.round("high", 5).alias("high"))


@query(f"with {ctes('cameras')}, k as (select cx, cy, cz-2 as h, yaw, (a*1200-ppx)/f as nx, (b*900-ppy)/f as ny from cameras cross join (select unnest([0,1]) as a) cross join (select unnest([0,1]) as b)), p as (select cx+h*(cos(yaw)*nx+sin(yaw)*ny) as x, cy+h*(sin(yaw)*nx-cos(yaw)*ny) as y from k) select floor(quantile_cont(x, 0.01)/0.5e0)*0.5e0 as min_x, ceil(quantile_cont(x, 0.99)/0.5e0)*0.5e0 as max_x, floor(quantile_cont(y, 0.01)/0.5e0)*0.5e0 as min_y, ceil(quantile_cont(y, 0.99)/0.5e0)*0.5e0 as max_y from p")
def grid_extent(spark, sf_dir):
    return S.grid_extent(_sized(spark, sf_dir), F.lit(2.0), 0.5)


@query(f"{GAPS}, b as (select cast(floor(row/2) as int) as row, cast(floor(col/2) as int) as col, case when count(z)/4e0 >= 0.5 then 1 else 0 end as z from grid group by 1, 2), n as ({_near(1, 'sum(b.z) as m', 'b')}) select b.row, b.col, b.z = 1 and n.m >= 6 as occupied from b join n using (row, col)".replace("from b a join b b", "from b a join b b"))
def occupied_blocks(spark, sf_dir):
    return S.occupied_blocks(gaps(spark, sf_dir), 2)


@query()
def footprint_hull(spark, sf_dir):
    return S.footprint(gaps(spark, sf_dir), 2).select("row", "col", "inside")


@query(f"with {ctes('points')}, d as (select l_orderkey, l_linenumber, z - y as dz from points), m as (select median(dz) as mid from d), s as (select 1.4826e0*median(abs(dz-mid)) as sp from d, m) select l_orderkey, l_linenumber, abs(dz-mid) < greatest(0.5e0, 3*sp) as held from d, m, s")
def ground_gate(spark, sf_dir):
    p = view(spark, sf_dir, "points").select("l_orderkey", "l_linenumber", (F.col("z") - F.col("y")).alias("dz"))
    return S.ground_gate(p).select("l_orderkey", "l_linenumber", "held")


@query(f"{CELLS}, g as (select row, col, z, z*z as zz from grid), m as ({_near(1, 'sum(b.z)/count(*) as m, sum(b.zz)/count(*) as q', 'g')}), a as (select row, col, (q-m*m)/(q-m*m+4e0) as z, m-(q-m*m)/(q-m*m+4e0)*m as b from m), s as (select a.row, a.col, sum(b.z)/count(*) as a, sum(b.b)/count(*) as b from a join a b on abs(a.row-b.row) <= 1 and abs(a.col-b.col) <= 1 group by 1, 2) select g.row, g.col, round(s.a*g.z+s.b, 5) as z from grid g join s using (row, col)")
def guided_filter(spark, sf_dir):
    return S.guided_filter(cells(spark, sf_dir).withColumn("g", F.col("z")), "z", "g", 1, 4.0).select("row", "col", F.round("filtered", 5).alias("z"))


@query()
def structure_image(spark, sf_dir):
    return S.structure(cells(spark, sf_dir), 2).select("row", "col", F.round("structure", 5).alias("z"))


@query(f"{CELLS}, l as (select abs(l.z+r.z+u.z+d.z-4*g.z) as v from grid g join grid l on l.row=g.row and l.col=g.col-1 join grid r on r.row=g.row and r.col=g.col+1 join grid u on u.col=g.col and u.row=g.row-1 join grid d on d.col=g.col and d.row=g.row+1) select round(avg(v), 6) as noise from l")
def image_noise(spark, sf_dir):
    return S.noise(cells(spark, sf_dir)).select(F.round("noise", 6).alias("noise"))


@query(f"with {ctes('observations')}, n as (select pt_id, count(*) as n from observations where cam_id % 3 = 0 group by 1), c as (select o.pt_id, cam_id, (cam_id*13+o.pt_id)%40 as ham, row_number() over (partition by o.pt_id order by (cam_id*13+o.pt_id)%40, cam_id) as k, coalesce(n, 0) as n from observations o left join n using (pt_id) where cam_id % 3 <> 0) select pt_id, cam_id, ham from c where k <= 6 - n")
def room_cap(spark, sf_dir):
    o = view(spark, sf_dir, "observations")
    sizes = o.where("cam_id % 3 = 0").groupBy("pt_id").agg(F.count("*").alias("n"))
    return S.room_cap(o.where("cam_id % 3 <> 0").selectExpr("pt_id", "cam_id", "(cam_id*13+pt_id)%40 as ham"), sizes, 6).select("pt_id", "cam_id", "ham")


@query(f"with {ctes('cameras')}, t as (select r*20+c as tile, c*8e0 as x0, r*8e0 as y0, c*8e0+8 as x1, r*8e0+8 as y1 from (select unnest(range(0, 10)) as r), (select unnest(range(0, 10)) as c)), k as (select tile, cam_id, row_number() over (partition by tile order by ((x0+x1)/2-cx)*((x0+x1)/2-cx)+((y0+y1)/2-cy)*((y0+y1)/2-cy), cam_id) as rank from t join cameras on x0 >= cx-20 and x1 <= cx+20 and y0 >= cy-20 and y1 <= cy+20) select tile, cam_id, cast(rank as int) as rank from k where rank <= 5")
def tile_views(spark, sf_dir):
    t = spark.range(100).selectExpr("floor(id/10)*20 + id%10 as tile", "id%10*8.0D as x0", "floor(id/10)*8.0D as y0", "id%10*8.0D+8 as x1", "floor(id/10)*8.0D+8 as y1")
    return S.tile_views(t, view(spark, sf_dir, "cameras"), 20.0, 5)


@query(f"with {ctes('pairs')}, e as (select i as a, j as b from pairs union select j, i from pairs) select a as image_id, count(*) as pairs from e where b % 3 = 0 and a % 3 <> 0 group by a having count(*) >= 2")
def admitted_frames(spark, sf_dir):
    used = view(spark, sf_dir, "pairs").select(F.explode(F.array("i", "j")).alias("image_id")).distinct().where("image_id % 3 = 0")
    return S.admit(view(spark, sf_dir, "pairs"), used)


_SHOT = """r as (select o.cam_id, o.pt_id, c.* exclude (cam_id), p.x as wx, p.y as wy, p.z as wz, (o.v/900-0.5e0)*0.03e0 as t from observations o join cameras c using (cam_id) join world_points p using (pt_id)),
    q as (select *, (cos(yaw)*(wx-cx)+sin(yaw)*(wy-cy))/(cz-wz) as nx, (sin(yaw)*(wx-cx)-cos(yaw)*(wy-cy))/(cz-wz) as ny, (cos(yaw)*(wx-cx-5*t)+sin(yaw)*(wy-cy+3*t))/(cz-wz) as mx, (sin(yaw)*(wx-cx-5*t)-cos(yaw)*(wy-cy+3*t))/(cz-wz) as my from r)"""


@query(f"with {ctes('observations')}, {_SHOT} select cam_id, pt_id, round(case when cam_id%2=0 then 0 else f*(1+(nx*nx+ny*ny)*(k1+(nx*nx+ny*ny)*(k2+(nx*nx+ny*ny)*k3)))*nx - f*(1+(mx*mx+my*my)*(k1+(mx*mx+my*my)*(k2+(mx*mx+my*my)*k3)))*mx end, 4) + 0e0 as su from q")
def rolling_shutter(spark, sf_dir):
    o = view(spark, sf_dir, "observations").join(view(spark, sf_dir, "cameras"), "cam_id").join(view(spark, sf_dir, "world_points").selectExpr("pt_id", "x as wx", "y as wy", "z as wz"), "pt_id")
    o = o.selectExpr("*", "900 as height", "5.0D as vx", "-3.0D as vy", "0.0D as vz", "0.03D as readout", "cam_id%2=0 as mechanical")
    return S.rolling_shift(o).select("cam_id", "pt_id", (F.round("su", 4) + 0.0).alias("su"))


@query(f"with {ctes('points', 'cells')}, s as (select row, col, z, case when z > 46 then 6 else 2 end as class from cells) select l_orderkey, l_linenumber, case when s.class is null or (s.class = 2 and p.z < s.z - 1) then 1 else s.class end as class from points p left join s on s.row = cast(floor(p.y/1.25e0) as int) and s.col = cast(floor(p.x/1.25e0) as int)")
def cloud_classes(spark, sf_dir):
    surface = view(spark, sf_dir, "cells").withColumn("class", F.when(F.col("z") > 46, 6).otherwise(2))
    return S.cloud_classes(view(spark, sf_dir, "points"), surface, 1.25).select("l_orderkey", "l_linenumber", "class")


@query(f"with {ctes('pair_matches')}, m as (select i, j, 0.9e0+i*0.01e0 as a, 0.1e0+j*0.01e0 as b, -0.1e0 as c, 1.05e0 as d from (select distinct i, j from pair_matches)) select i, j, round((sqrt((a+d)*(a+d)+(b-c)*(b-c))+sqrt((a-d)*(a-d)+(b+c)*(b+c)))/2, 6) as s_max, round(degrees(atan2(c, a)), 6) as rotation, round((a*b+c*d)/(a*a+c*c), 6) as shear from m")
def describe_affine(spark, sf_dir):
    m = view(spark, sf_dir, "pair_matches").select("i", "j").distinct()
    d = C.describe_affine(0.9 + F.col("i") * 0.01, 0.1 + F.col("j") * 0.01, F.lit(-0.1), F.lit(1.05))
    return m.select("i", "j", *[F.round(d[c], 6).alias(c) for c in ("s_max", "rotation", "shear")])
