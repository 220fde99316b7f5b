"""Raster, terrain and surface queries over the fixture cells, with their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut
from ..operators import raster as R
from ..operators import terrain as T
from ..operators.spatial import spread
from .fixtures import ctes, view

GSD = 0.5
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.on_grid(view(spark, sf_dir, "cells"))


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.on_grid(view(spark, sf_dir, "sparse_cells"))


def _grid(name: str) -> str:
    return f"""grid as (select cast(r.row as int) as row, cast(c.col as int) as col, s.z from (select unnest(range(min(row), max(row) + 1)) as row from {name}) r
        cross join (select unnest(range(min(col), max(col) + 1)) as col from {name}) c left join {name} s on s.row = r.row and s.col = c.col)"""


CELLS = f"with {ctes('cells')}, {_grid('cells')}"
GAPS = f"with {ctes('sparse_cells')}, {_grid('sparse_cells')}"


def _near(r: int, what: str, source: str = "grid") -> str:
    return f"select a.row, a.col, {what} from {source} a join {source} b on abs(a.row - b.row) <= {r} and abs(a.col - b.col) <= {r} group by a.row, a.col"


@query(f"with {ctes('points')}, k as (select *, cast(floor(y / 2.5e0) as int) as row, cast(floor(x / 1.25e0) as int) as col from points), t as (select *, max(z) over (partition by row, col) as top from k) select row, col, median(z) as z, count(*) as n, round(avg(r), 6) as r, round(avg(g), 6) as g, round(avg(b), 6) as b from t where z >= top - 10 group by row, col".replace("floor(x / 1.25e0)", "floor(x / 2.5e0)"))
def top_layer_dsm(spark, sf_dir):
    return T.top_layer(view(spark, sf_dir, "points"), 2.5, 10.0)


@query(f"with {ctes('points')}, k as (select *, cast(floor(y / 2.5e0) as int) as row, cast(floor(x / 2.5e0) as int) as col from points), t as (select *, max(z) over (partition by row, col) as top from k), d as (select row, col, median(z) as z from t where z >= top - 10 group by row, col) select cast(floor(row / 4) as int) as row, cast(floor(col / 4) as int) as col, quantile_cont(z, 0.25) as z, count(z) as n from d group by 1, 2")
def terrain_summary(spark, sf_dir):
    """Flagship: point cloud to top-layer surface to block percentiles."""
    return R.block_percentile(T.top_layer(view(spark, sf_dir, "points"), 2.5, 10.0), 4)


@query(f"{GAPS} {_near(2, 'min(b.z) as z')}")
def erode(spark, sf_dir):
    return R.erode(gaps(spark, sf_dir), 2).select("row", "col", F.col("eroded").alias("z"))


@query(f"{GAPS} {_near(2, 'max(b.z) as z')}")
def dilate(spark, sf_dir):
    return R.dilate(gaps(spark, sf_dir), 2).select("row", "col", F.col("dilated").alias("z"))


@query(f"{GAPS}, e as ({_near(2, 'min(b.z) as z')}) {_near(2, 'max(b.z) as z', 'e')}")
def opening(spark, sf_dir):
    return R.opening(gaps(spark, sf_dir), 2).select("row", "col", F.col("opened").alias("z"))


@query(f"{GAPS} {_near(2, 'round(sum(coalesce(b.z, 0)) / 25, 6) as z')}")
def box_zero(spark, sf_dir):
    return R.box_zero(gaps(spark, sf_dir), 2).select("row", "col", F.round("mean", 6).alias("z"))


_CLAMP = "least(greatest(a.{0} + o{1}.d, (select min({0}) from grid)), (select max({0}) from grid))"


@query(f"{GAPS}, o as (select unnest(range(-2, 3)) as d) select a.row, a.col, round(sum(coalesce(b.z, 0)) / 25, 6) as z from grid a cross join o oy cross join o ox join grid b on b.row = {_CLAMP.format('row', 'y')} and b.col = {_CLAMP.format('col', 'x')} group by a.row, a.col")
def box_edge(spark, sf_dir):
    return R.box_edge(gaps(spark, sf_dir), 2).select("row", "col", F.round("mean", 6).alias("z"))


@query(f"{GAPS} {_near(2, 'median(b.z) as z')}")
def median_filter(spark, sf_dir):
    return R.median_filter(gaps(spark, sf_dir), 2).select("row", "col", F.col("median").alias("z"))


@query(f"{CELLS}, o as (select unnest(range(-1, 2)) as d) select a.row, a.col, list_sort(list(b.z))[5] as z from grid a cross join o oy cross join o ox join grid b on b.row = {_CLAMP.format('row', 'y')} and b.col = {_CLAMP.format('col', 'x')} group by a.row, a.col")
def median3(spark, sf_dir):
    return R.median3(cells(spark, sf_dir)).select("row", "col", F.col("median").alias("z"))


@query(f"{GAPS} select a.row, a.col, coalesce(bool_or(b.z > 90 and abs(a.row - b.row) + abs(a.col - b.col) <= 3), false) as near from grid a join grid b on abs(a.row - b.row) <= 3 and abs(a.col - b.col) <= 3 group by a.row, a.col")
def near_mask(spark, sf_dir):
    df = gaps(spark, sf_dir).withColumn("m", F.coalesce(F.col("z") > 90, F.lit(False)))
    return R.near(df, "m", 3).select("row", "col", "near")


@query(f"{GAPS}, p as (select a.row, a.col, b.z, exp(-((a.row-b.row)*(a.row-b.row)+(a.col-b.col)*(a.col-b.col))/8e0 - (b.z-a.z)*(b.z-a.z)/200e0) as w from grid a join grid b on abs(a.row-b.row) <= 2 and abs(a.col-b.col) <= 2 where a.z is not null and b.z is not null), s as (select row, col, sum(w*z)/sum(w) as z from p group by 1,2) select g.row, g.col, round(s.z, 6) as z from grid g left join s using (row, col)")
def bilateral(spark, sf_dir):
    return R.bilateral(gaps(spark, sf_dir), 2, 10.0, 2.0).select("row", "col", F.round("smooth", 6).alias("z"))


@query(f"""{CELLS}, g as (select row, col, z, lag(z) over (partition by row order by col) as l, lead(z) over (partition by row order by col) as r,
    lag(z) over (partition by col order by row) as u, lead(z) over (partition by col order by row) as d from grid),
    s as (select row, col, case when l is not null and r is not null then (r-l)/1e0 when r is not null then (r-z)/0.5e0 else (z-l)/0.5e0 end as gx,
    case when u is not null and d is not null then (d-u)/1e0 when d is not null then (d-z)/0.5e0 else (z-u)/0.5e0 end as gy from g),
    a as (select row, col, atan(sqrt(gx*gx+gy*gy)) as sl, atan2(-gx, gy) as asp from s)
    select row, col, round(0.35e0 + 0.75e0 * least(greatest(sin(radians(45))*cos(sl) + cos(radians(45))*sin(sl)*cos(radians(315)-asp), 0), 1), 6) as shade from a""")
def hillshade(spark, sf_dir):
    return R.hillshade(cells(spark, sf_dir), GSD).select("row", "col", F.round("shade", 6).alias("shade"))


@query(f"{GAPS}, n as (select a.row, a.col, list_sort(list(b.z)) as v from grid a join grid b on abs(a.row-b.row) <= 1 and abs(a.col-b.col) <= 1 where a.z is null and b.z is not null group by 1, 2) select g.row, g.col, case when g.z is null and len(v) >= 3 then v[cast(floor((len(v)-1)/2) as int)+1] else g.z end as z, (g.z is null and coalesce(len(v), 0) >= 3) as grown from grid g left join n using (row, col)")
def lower_median_fill(spark, sf_dir):
    return R.lower_median_fill(gaps(spark, sf_dir)).select("row", "col", F.col("z_filled").alias("z"), "grown")


@query(f"{GAPS} select cast(floor(row / 3) as int) as row, cast(floor(col / 3) as int) as col, round(quantile_cont(z, 0.25), 6) as z, count(z) as n from grid group by 1, 2")
def block_percentile(spark, sf_dir):
    return R.block_percentile(gaps(spark, sf_dir), 3).withColumn("z", F.round("z", 6))


@query(f"{GAPS}, s as (select *, cast(floor((select max(row)+1 from grid)/3) as int)*3 as h, cast(floor((select max(col)+1 from grid)/3) as int)*3 as w from grid) select cast(floor(row / 3) as int) as row, cast(floor(col / 3) as int) as col, round(avg(z), 6) as z, count(z) >= 4.5 as valid from s where row < h and col < w group by 1, 2")
def block_mean(spark, sf_dir):
    df = gaps(spark, sf_dir)
    _, r1, _, c1 = R.extent(df)
    return R.block_mean(df, 3, r1 + 1, c1 + 1).select("row", "col", F.round("z", 6).alias("z"), "valid")


@query(f"{GAPS}, k as (select cast(floor(row/2) as int) as br, cast(floor(col/2) as int) as bc, min(z) as m from grid group by 1,2), n as (select a.br, a.bc, min(b.m) as m from k a join k b on abs(a.br-b.br) <= 2 and abs(a.bc-b.bc) <= 2 group by 1,2) select g.row, g.col, n.m as z from grid g join n on n.br = cast(floor(g.row/2) as int) and n.bc = cast(floor(g.col/2) as int)")
def local_minimum(spark, sf_dir):
    return R.local_min(gaps(spark, sf_dir), 2.0, 0.5, 1.0).select("row", "col", F.col("local_min").alias("z"))


def _levels(n: int) -> str:
    """Push-pull over a fixed number of levels, coarse to fine."""
    parts = ["p0 as (select row, col, z from grid)", "hw0 as (select max(row)+1 as h, max(col)+1 as w from grid)"]
    for i in range(n):
        parts.append(f"p{i+1} as (select cast(floor(row/2) as int) as row, cast(floor(col/2) as int) as col, avg(z) as z from p{i} group by 1,2)")
        parts.append(f"hw{i+1} as (select max(row)+1 as h, max(col)+1 as w from p{i+1})")
    parts.append(f"f{n} as (select row, col, coalesce(z, (select avg(z) from p{n}), 0) as z from p{n})")
    for i in range(n - 1, -1, -1):
        parts.append(f"""t{i} as (select p.row, p.col, p.z, least(greatest((p.row+0.5e0)/2-0.5e0,0e0),h-1e0) as y, least(greatest((p.col+0.5e0)/2-0.5e0,0e0),w-1e0) as x, h, w from p{i} p cross join hw{i+1})""")
        parts.append(f"""f{i} as (select t.row, t.col, coalesce(t.z, (a.z*(1-(x-floor(x)))+b.z*(x-floor(x)))*(1-(y-floor(y)))+(c.z*(1-(x-floor(x)))+d.z*(x-floor(x)))*(y-floor(y))) as z from t{i} t
            join f{i+1} a on a.row=floor(y) and a.col=floor(x) join f{i+1} b on b.row=floor(y) and b.col=least(floor(x)+1,w-1)
            join f{i+1} c on c.row=least(floor(y)+1,h-1) and c.col=floor(x) join f{i+1} d on d.row=least(floor(y)+1,h-1) and d.col=least(floor(x)+1,w-1))""")
    return ", ".join(parts)


@query(f"{GAPS}, {_levels(3)} select row, col, round(z + 1e-7, 4) as z from f0")
def pyramid_pushpull(spark, sf_dir):
    """24 columns: three levels until the short side is at most four."""
    return R.push_pull(gaps(spark, sf_dir)).select("row", "col", F.round(F.col("z") + 1e-7, 4).alias("z"))


def _open_sql(i: int, w: int, before: str, dh: float) -> str:
    r = w // 2
    return f"e{i} as ({_near(r, 'min(b.z) as z', before)}), o{i} as ({_near(r, 'max(b.z) as z', f'e{i}')}), k{i} as (select p.row, p.col, p.z - o.z <= {dh}e0 as ok from {before} p join o{i} o using (row, col))"


@query(f"{CELLS}, {_open_sql(1, 3, 'grid', 0.6)}, {_open_sql(2, 5, 'o1', 0.6)}, {_open_sql(3, 9, 'o2', 0.9)} select k1.row, k1.col, k1.ok and k2.ok and k3.ok as ground from k1 join k2 using (row, col) join k3 using (row, col)")
def ground_filter(spark, sf_dir):
    opt = T.TerrainOptions(max_object_size=9.0, slope=0.15, dh0=0.3)
    return T.ground_filter(cells(spark, sf_dir), 1.0, opt).select("row", "col", "ground")


OPT = T.TerrainOptions(max_object_size=6.0, cell=1.0)


@query()
def dtm(spark, sf_dir):
    return T.terrain_model(cells(spark, sf_dir), GSD, OPT).select("row", "col", F.round("dtm", 6).alias("dtm"), "ground")


@query()
def ndsm(spark, sf_dir):
    df = T.terrain_model(cells(spark, sf_dir), GSD, OPT)
    return df.select("row", "col", F.round(F.greatest(F.col("z") - F.col("dtm"), F.lit(0.0)), 6).alias("ndsm"))


@query(f"""{CELLS}, h as (select row, col, greatest(z - 45, 0) as h, z <= 46 as ground, z from grid),
    m as (select a.row, a.col, sum(b.h)/count(*) as m, sum(b.h*b.h)/count(*) as q from h a join h b on abs(a.row-b.row) <= 1 and abs(a.col-b.col) <= 1 group by 1,2)
    select h.row, h.col, case when ground then 2 when h > 2.5e0 and sqrt(greatest(q-m*m,0)) > 0.15e0 then 5 when h > 2.5e0 then 6 when h > 0.4e0 then 3 else 1 end as class, round(sqrt(greatest(q-m*m,0)), 4) as roughness from h join m using (row, col)""")
def classes(spark, sf_dir):
    df = cells(spark, sf_dir).withColumn("ndsm", F.greatest(F.col("z") - 45, F.lit(0.0))).withColumn("ground", F.col("z") <= 46)
    return T.classify(df, GSD).select("row", "col", "class", F.round("roughness", 4).alias("roughness"))


_QUADS = f"""{CELLS}, q as (select a.row, a.col, a.z za, b.z zb, c.z zc, d.z zd from grid a join grid b on b.row=a.row and b.col=a.col+1 join grid c on c.row=a.row+1 and c.col=a.col join grid d on d.row=a.row+1 and d.col=a.col+1)"""
_SEG = _QUADS + """, l as (select unnest(range(1, 200)) as k), st as (select floor(min(z)/1.5e0)*1.5e0 as s from grid),
    c as (select s+k*1.5e0 as level, (za+zb+zc+zd)*0.25e0 as mean, (col+0.5e0)*0.5e0 x0, 100-(row+0.5e0)*0.5e0 y0, (col+1.5e0)*0.5e0 x1, 100-(row+1.5e0)*0.5e0 y1, q.* from q cross join st join l on s+k*1.5e0 between least(za,zb,zc,zd) and greatest(za,zb,zc,zd)),
    e as (select *, case when (za-level)*(zb-level)<0 then {'x': x0+(level-za)/(zb-za)*(x1-x0), 'y': y0} end t, case when (zb-level)*(zd-level)<0 then {'x': x1, 'y': y0+(level-zb)/(zd-zb)*(y1-y0)} end r,
      case when (zc-level)*(zd-level)<0 then {'x': x0+(level-zc)/(zd-zc)*(x1-x0), 'y': y1} end b, case when (za-level)*(zc-level)<0 then {'x': x0, 'y': y0+(level-za)/(zc-za)*(y1-y0)} end l from c),
    h as (select *, list_filter([t,r,b,l], lambda p: p is not null) as hit from e),
    s as (select level, hit[1] p, hit[2] q2 from h where len(hit)=2 union all select level, t, case when mean>=level then r else l end from h where len(hit)=4 union all
      select level, case when mean>=level then b else r end, case when mean>=level then l else b end from h where len(hit)=4)"""


@query(f"{_SEG} select level, round(p.x, 6) as x0, round(p.y, 6) as y0, round(q2.x, 6) as x1, round(q2.y, 6) as y1 from s")
def contours(spark, sf_dir):
    s = T.contours(cells(spark, sf_dir), GSD, 0.0, 100.0, 1.5)
    return s.select("level", *[F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query(f"{_SEG} select level, count(*) as n from s group by level")
def contours_geojson(spark, sf_dir):
    g = T.contours_geojson(T.contours(cells(spark, sf_dir), GSD, 0.0, 100.0, 1.5))
    return g.select("level", F.size(F.from_json("geojson", "geometry struct<coordinates array<array<array<double>>>>")["geometry"]["coordinates"]).cast("long").alias("n"))


_TRI = "select row+{0} r0, col+{1} c0, row+{2} r1, col+{3} c1, row+{4} r2, col+{5} c2 from q where {6} and z{7} is not null and z{8} is not null and z{9} is not null"
_AD = "abs(za-zd) <= abs(zb-zc)"
_TRIS = " union all ".join([_TRI.format(0, 0, 1, 0, 1, 1, _AD, "a", "c", "d"), _TRI.format(0, 0, 1, 1, 0, 1, _AD, "a", "d", "b"), _TRI.format(0, 0, 1, 0, 0, 1, f"not coalesce({_AD}, false)", "a", "c", "b"), _TRI.format(0, 1, 1, 0, 1, 1, f"not coalesce({_AD}, false)", "b", "c", "d")])


@query(f"{_QUADS} {_TRIS}")
def grid_mesh(spark, sf_dir):
    return T.grid_mesh(cells(spark, sf_dir))


_HW = "hw as (select max(row)+1 as h, max(col)+1 as w from grid)"


@query(f"""{CELLS}, {_HW}, o as (select r.row, c.col, h, w from hw cross join (select unnest(range(0, 30)) as row) r cross join (select unnest(range(0, 50)) as col) c),
    t as (select *, least(greatest((row+0.5e0)*h/30-0.5e0,0e0),h-1e0) y, least(greatest((col+0.5e0)*w/50-0.5e0,0e0),w-1e0) x from o)
    select cast(t.row as int) as row, cast(t.col as int) as col, round((a.z*(1-(x-floor(x)))+b.z*(x-floor(x)))*(1-(y-floor(y)))+(c.z*(1-(x-floor(x)))+d.z*(x-floor(x)))*(y-floor(y)), 5) as z from t
    left join grid a on a.row=floor(y) and a.col=floor(x) left join grid b on b.row=floor(y) and b.col=least(floor(x)+1,w-1) left join grid c on c.row=least(floor(y)+1,h-1) and c.col=floor(x) left join grid d on d.row=least(floor(y)+1,h-1) and d.col=least(floor(x)+1,w-1)""")
def raster_resample(spark, sf_dir):
    df = cells(spark, sf_dir)
    _, r1, _, c1 = R.extent(df)
    return R.resize(df, r1 + 1, c1 + 1, 30, 50).select("row", "col", F.round("z", 5).alias("z"))


@query(f"""{CELLS}, {_HW}, o as (select r.row, c.col, h, w from hw cross join (select unnest(range(0, 36)) as row) r cross join (select unnest(range(0, 60)) as col) c),
    t as (select *, least(greatest((row+0.5e0)*0.25e0/0.5e0-0.5e0,0e0),h-1e0) y, least(greatest((col+0.5e0)*0.25e0/0.5e0-0.5e0,0e0),w-1e0) x, least(floor((row+0.5e0)*0.5e0),h-1) ny, least(floor((col+0.5e0)*0.5e0),w-1) nx from o)
    select cast(t.row as int) as row, cast(t.col as int) as col, round(case when a.z is null or b.z is null or c.z is null or d.z is null or greatest(a.z,b.z,c.z,d.z)-least(a.z,b.z,c.z,d.z) > 0.3e0 then e.z else
    (a.z*(1-(x-floor(x)))+b.z*(x-floor(x)))*(1-(y-floor(y)))+(c.z*(1-(x-floor(x)))+d.z*(x-floor(x)))*(y-floor(y)) end, 5) as z from t
    left join grid a on a.row=floor(y) and a.col=floor(x) left join grid b on b.row=floor(y) and b.col=least(floor(x)+1,w-1) left join grid c on c.row=least(floor(y)+1,h-1) and c.col=floor(x) left join grid d on d.row=least(floor(y)+1,h-1) and d.col=least(floor(x)+1,w-1) left join grid e on e.row=ny and e.col=nx""")
def edge_aware_resample(spark, sf_dir):
    df = cells(spark, sf_dir)
    _, r1, _, c1 = R.extent(df)
    return R.resample_edges(df, r1 + 1, c1 + 1, 0.5, 36, 60, 0.25).select("row", "col", F.round("z", 5).alias("z"))


@query(f"""with {ctes('cells', 'cameras')}, t as (select cam_id, row, col, (col+0.5e0)*1.25e0 x, (row+0.5e0)*1.25e0 y, z, cx, cy, cz-10 as cz from cells join cameras on true),
    s as (select t.*, k, k/12e0 as a from t cross join (select unnest(range(1, 12)) as k)),
    m as (select s.*, coalesce(c.z > s.z + a*(cz-s.z) + 0.5e0, false) as hid from s left join cells c on c.row = floor((y+a*(cy-y))/1.25e0) and c.col = floor((x+a*(cx-x))/1.25e0))
    select cam_id, row, col, not bool_or(hid) as visible from m group by 1, 2, 3""")
def visibility(spark, sf_dir):
    surface = cut(view(spark, sf_dir, "cells"))
    cams = view(spark, sf_dir, "cameras").select("cam_id", "cx", "cy", (F.col("cz") - 10).alias("cz")).distinct()
    targets = spread(cams).crossJoin(F.broadcast(surface))  # at most 20 x 40 cells, at every scale
    return T.visible(targets, surface, 12, 0.5, 1.25)


@query(f"{GAPS}, b as ({_near(1, 'sum(case when b.z is not null then 1e0 else 0e0 end)/9 as m')}), k as (select row, col, m > 0.5e0 as v from b) select cast(g.row as int) as row, cast(g.col as int) as col, k.v and g.z is not null as inside from grid g join k using (row, col)")
def footprint(spark, sf_dir):
    df = gaps(spark, sf_dir).withColumn("v", F.col("z").isNotNull().cast("double"))
    return R.box_zero(df, 1, "v", "m").select("row", "col", ((F.col("m") > 0.5) & F.col("z").isNotNull()).alias("inside"))


@query(f"{GAPS}, m as ({_near(2, 'median(b.z) as m')}) select g.row, g.col, case when abs(g.z - m.m) <= 40 then g.z end as z from grid g join m using (row, col)")
def spike_removal(spark, sf_dir):
    df = R.median_filter(gaps(spark, sf_dir), 2, "z", "m")
    return df.select("row", "col", F.when(F.abs(F.col("z") - F.col("m")) <= 40, F.col("z")).alias("z"))


@query(f"{CELLS}, w as (select d, exp(-0.5e0*(d/1e0)*(d/1e0)) as w from (select unnest(range(-3, 4)) as d)), n as (select d, w/(select sum(w) from w) as w from w) select a.row, a.col, round(sum(b.z*ny.w*nx.w), 5) as z from grid a cross join n ny cross join n nx join grid b on b.row = {_CLAMP.format('row', 'y').replace('oy.d', 'ny.d')} and b.col = {_CLAMP.format('col', 'x').replace('ox.d', 'nx.d')} group by 1, 2")
def gaussian_blur(spark, sf_dir):
    return R.gaussian(cells(spark, sf_dir), 1.0).select("row", "col", F.round("blurred", 5).alias("z"))
