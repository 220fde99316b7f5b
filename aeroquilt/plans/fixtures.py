"""Projections of the star-schema tables onto survey data, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..operators.spatial import tasks

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")

VIEWS = {
    "frames": """select c_custkey as image_id,
        concat('CAP_', lpad(cast(cast(floor(c_custkey/2.0) as bigint) as string),6,'0'), case when c_custkey%2=0 then '_V' else '_T' end, '.JPG') as name,
        1200 as width, 900 as height, 23.8e0 + (c_custkey%40)*0.00045e0 as lat,
        case when c_custkey%29=0 then null else 90.4e0 + floor(c_custkey/40.0e0)*0.0005e0 end as lon,
        60.0e0 + (c_custkey%7)*0.1e0 as rel_alt, case when c_custkey%5=0 then null else 24.0e0 + c_custkey%3 end as focal35,
        cast(c_custkey*37%360 as double) as gimbal_yaw, c_nationkey as sensor from {customer}""",
    "raw_counts": "select event_id, user_id as image_id, cast(17000 + floor(value*10.0e0) as int) as raw from {events}",
    "points": """select l_orderkey, l_linenumber, (l_partkey%1000)*0.05e0 as x, (l_suppkey%100)*0.5e0 as y, l_quantity as z,
        cast(floor(l_discount*2000.0e0) as int)%256 as r, cast(floor(l_tax*2000.0e0) as int)%256 as g, l_linenumber*30%256 as b,
        cast(l_suppkey%100 as int) as cam_id from {lineitem}""",
    "cells": "select cast(floor(y/2.5e0) as int) as row, cast(floor(x/1.25e0) as int) as col, max(z) as z from points where (l_orderkey%11)<>0 group by 1,2",
    "sparse_cells": "select cast(user_id as int) as row, cast(extract(hour from ts) as int) as col, max(value) as z from {events} group by 1,2",
    "cameras": """select s_suppkey as cam_id, (s_suppkey%10)*8.0e0 as cx, floor(s_suppkey/10.0e0)*8.0e0 as cy, 60.0e0+(s_suppkey%3)*0.5e0 as cz,
        radians((s_suppkey%4)*90.0e0+s_suppkey%7) as yaw, 1150.0e0 as f, -0.04e0 as k1, 0.01e0 as k2, 0.0e0 as k3, 599.5e0 as ppx, 449.5e0 as ppy from {supplier}""",
    "world_points": "select p_partkey as pt_id, (p_partkey%100)*0.8e0 as x, floor(p_partkey/100.0e0)*4.0e0 as y, p_size*0.1e0 as z from {part}",
    "observations": """with t as (select c.cam_id, p.pt_id, c.f,c.k1,c.k2,c.k3,c.ppx,c.ppy,
        (cos(yaw)*(p.x-c.cx)+sin(yaw)*(p.y-c.cy))/(c.cz-p.z) nx, (sin(yaw)*(p.x-c.cx)-cos(yaw)*(p.y-c.cy))/(c.cz-p.z) ny
        from cameras c join world_points p on abs(p.x-c.cx) < 60.0e0 and abs(p.y-c.cy) < 60.0e0),
        u as (select *, nx*nx+ny*ny r2 from t),
        w as (select cam_id,pt_id, f*(1+r2*(k1+r2*(k2+r2*k3)))*nx+ppx as u, f*(1+r2*(k1+r2*(k2+r2*k3)))*ny+ppy as v from u)
        select cam_id, pt_id, round(u, 6) as u, round(v, 6) as v from w where u>=0 and u<1200 and v>=0 and v<900 and (cam_id*7+pt_id)%5=0""",
    "pairs": "select distinct least(o_custkey%60,o_orderkey%67) as i, greatest(o_custkey%60,o_orderkey%67) as j from {orders} where o_custkey%60<>o_orderkey%67 and o_orderkey%19=0",
    "sparse_pairs": "select distinct least(o_custkey%601,o_orderkey%673) as i, greatest(o_custkey%601,o_orderkey%673) as j from {orders} where o_custkey%601<>o_orderkey%673",
    "pair_matches": """select cast(l_suppkey%20 as int) as i, cast((l_suppkey%20+1+l_linenumber%3)%20 as int) as j, l_orderkey*10+l_linenumber as k,
        (l_partkey%1200)*1.0e0 as xi, (l_orderkey%900)*1.0e0 as yi, 40.0e0+l_quantity*3 as ci, (40.0e0+l_quantity*3)*(1+0.01e0*(l_suppkey%5))+l_linenumber as cj
        from {lineitem} where l_orderkey%7=0""",
    "match_edges": """select cast(l_suppkey%12 as int) as i, cast(l_partkey%40 as int) as fi, cast((l_suppkey%12+1+l_linenumber)%12 as int) as j,
        cast((l_partkey+l_orderkey%3)%40 as int) as fj, count(*) as n from {lineitem} where l_orderkey%23=0 and l_linenumber<11 group by 1,2,3,4""",
    "gcp_text": """select concat(cast(230000+n_nationkey*10 as string),'.5 ',cast(2635000+n_regionkey*7 as string),'.25, ',cast(n_nationkey as string),'.125 ',
        cast(100+n_nationkey as string),' ',cast(200+n_nationkey as string),' dir/CAP_',lpad(cast(n_nationkey as string),6,'0'),'_V.JPG ','G',cast(n_regionkey as string)) as line from {nation}""",
    "xmp_text": """select p_partkey as image_id, concat('<x drone-dji:RelativeAltitude="+',cast(p_size as string),'.5" drone-dji:GimbalPitchDegree="-90.0" drone-dji:RtkStdLat="0.0',
        cast(p_size%9+1 as string),'" drone-dji:ShutterType="',case when p_size%2=0 then 'Mechanical' else 'Electronic' end,'"/>') as head from {part}""",
    "gcp_errors": """select concat('G', cast(o_custkey%40 as string)) as name, (o_orderkey%11-5)*0.01e0 as dx, (o_orderkey%7-3)*0.02e0 as dy, (o_orderkey%13-6)*0.03e0 as dz,
        1+o_orderkey%4 as marks from {orders}""",
    "photo_samples": """select cast(l_suppkey%50 as int) as row, cast(l_partkey%60 as int) as col, cast(l_orderkey%8 as int) as photo, max(l_quantity*5) as value,
        max((l_linenumber%4+1)*0.2e0) as weight from {lineitem} group by 1,2,3""",
    "tiles": "select cast(ty.r_regionkey as int) as ty, cast(tx.n_nationkey as int) as tx, tx.n_nationkey*90.0e0 as x0, ty.r_regionkey*500.0e0 as y0, (tx.n_nationkey+1)*90.0e0 as x1, (ty.r_regionkey+1)*500.0e0 as y1 from {region} ty join {nation} tx on true",
}


#: What Spark runs in place of a view's statement: cameras and points meet by grid cells of 60 m and by the residue of the last condition, not as all pairs.
#: Both are dealt to ``tasks`` tasks by cell, since their files are too small for more than one task.  The pixels come out of inline(), which no filter passes: pushed
#: below it, the four conditions would each hold all of the projection, and 54 cosines with it.
SPARK_VIEWS = {
    "observations": """with a as (select *, cos(yaw) as cw, sin(yaw) as sw, explode(sequence(-1, 1)) as dx from cameras), b as (select *, explode(sequence(-1, 1)) as dy from a),
        c as (select /*+ repartition(tasks, gx, gy, g) */ * from (select *, cast(floor(cx/60.0e0) as bigint) + dx as gx, cast(floor(cy/60.0e0) as bigint) + dy as gy, pmod(-7*cam_id, 5) as g from b)),
        q as (select /*+ repartition(tasks, gx, gy, g) */ * from (select *, cast(floor(x/60.0e0) as bigint) as gx, cast(floor(y/60.0e0) as bigint) as gy, pt_id%5 as g from world_points)),
        t as (select /*+ shuffle_hash(c) */ c.cam_id, q.pt_id, c.f,c.k1,c.k2,c.k3,c.ppx,c.ppy,
        (cw*(q.x-c.cx)+sw*(q.y-c.cy))/(c.cz-q.z) nx, (sw*(q.x-c.cx)-cw*(q.y-c.cy))/(c.cz-q.z) ny
        from c join q on c.gx = q.gx and c.gy = q.gy and c.g = q.g where abs(q.x-c.cx) < 60.0e0 and abs(q.y-c.cy) < 60.0e0),
        r as (select *, nx*nx+ny*ny r2 from t),
        w as (select cam_id, pt_id, u, v from r lateral view inline(array(named_struct('u', f*(1+r2*(k1+r2*(k2+r2*k3)))*nx+ppx, 'v', f*(1+r2*(k1+r2*(k2+r2*k3)))*ny+ppy))) as u, v)
        select cam_id, pt_id, round(u, 6) as u, round(v, 6) as v from w where u>=0 and u<1200 and v>=0 and v<900""",
}


def _needs(name: str) -> list[str]:
    """The view's own sources first, each once."""
    out: list[str] = []
    for other in VIEWS:
        if other != name and re.search(rf"(?<![\w{{]){other}\b(?!\s*\.)", re.sub(r"\{\w+\}", "", VIEWS[name])) and re.search(rf"(from|join)\s+{other}\b", VIEWS[name]):
            out += [v for v in [*_needs(other), other] if v not in out]
    return out


def ctes(*names: str) -> str:
    """``name as (...)`` for the views and what they need, for DuckDB."""
    order: list[str] = []
    for n in names:
        order += [v for v in [*_needs(n), n] if v not in order]
    return ", ".join(f"{v} as ({VIEWS[v].format(**{t: t for t in TABLES})})" for v in order)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a DataFrame; only the columns that its statement names are read."""
    order = [*_needs(name), name]
    bodies = {v: SPARK_VIEWS.get(v, VIEWS[v]).replace("repartition(tasks,", f"repartition({tasks(spark)},") for v in order}
    text = "with " + ", ".join(f"{v} as ({body})" for v, body in bodies.items()) + f" select * from {name}"
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in text}
    return spark.sql(text, **used)


def descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(feat_id, image_id, dsc): signs of the first 63 components packed into an integer."""
    bits = "aggregate(transform(sequence(0,62), i -> if(embedding[i]>0, shiftleft(cast(1 as bigint), i), cast(0 as bigint))), cast(0 as bigint), (x,y) -> x | y)"
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr("vec_id as feat_id", "label as image_id", f"{bits} as dsc", "vec_id*37%400*1.0D as x", "vec_id*91%300*1.0D as y")


DESCRIPTORS = """descriptors as (select vec_id as feat_id, label as image_id,
    list_reduce(list_transform(range(0,63), lambda i: case when embedding[i+1]>0 then (1::bigint << i::bigint) else 0::bigint end), lambda x, y: x | y) as dsc,
    vec_id*37%400*1.0e0 as x, vec_id*91%300*1.0e0 as y from embeddings)"""
