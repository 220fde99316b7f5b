"""LAS 1.2, PLY and OBJ: coordinates are quantised in Spark, bodies are written by the executors, headers need counts and bounds only."""

from __future__ import annotations

import struct
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RECORD = np.dtype([("x", "<i4"), ("y", "<i4"), ("z", "<i4"), ("intensity", "<u2"), ("flags", "u1"), ("class", "u1"), ("angle", "i1"), ("user", "u1"), ("source", "<u2"), ("red", "<u2"), ("green", "<u2"), ("blue", "<u2")])


def scale_for(spacing: float | None) -> float:
    """A tenth of the point spacing as a power of ten, at most a millimetre."""
    import math

    return 0.001 if not spacing or spacing <= 0 else min(10 ** round(math.log10(spacing)) / 10, 0.001)


def quantise(points: DataFrame, scale: float) -> DataFrame:
    """``points`` with integer ix, iy, iz from the floor of the least coordinates, and 16-bit red, green, blue."""
    low = points.agg(*[F.floor(F.min(c)).cast("double").alias(f"o{c}") for c in "xyz"])
    df = points.crossJoin(F.broadcast(low))  # one row
    df = df.withColumns({f"i{c}": F.rint((F.col(c) - F.col(f"o{c}")) / scale).cast("int") for c in "xyz"})
    return df.withColumns({name: (F.col(c) * 257).cast("int") for name, c in (("red", "r"), ("green", "g"), ("blue", "b"))})


def las_bytes(points: DataFrame, scale: float = 0.001, created: date | None = None) -> tuple[bytes, DataFrame]:
    """The header, and a DataFrame of the body (part, body): concatenated in the order of ``part`` they are the file."""
    q = quantise(points, scale)
    s = q.agg(F.count("*"), *[f(c) for c in "xyz" for f in (F.min, F.max)], *[F.first(f"o{c}") for c in "xyz"]).first()
    n, bounds, offset = s[0], s[1:7], s[7:10]
    day = created or date.today()
    head = struct.pack("<4sHHIHH8sBB32s32sHHHIIBHI5I12d", b"LASF", 0, 0, 0, 0, 0, b"", 1, 2, b"aeroquilt", b"aeroquilt", day.timetuple().tm_yday, day.year, 227, 227, 0, 2, RECORD.itemsize, n, n, 0, 0, 0, 0,
                       scale, scale, scale, *offset, bounds[1], bounds[0], bounds[3], bounds[2], bounds[5], bounds[4])
    kind = "class" if "class" in points.columns else None

    def run(batches):
        for b in batches:
            out = np.zeros(b.num_rows, RECORD)
            for i, name in enumerate(("x", "y", "z", "red", "green", "blue")):
                out[name] = b.column(i + 1).to_numpy()
            out["flags"] = 9
            if kind:
                out["class"] = b.column(7).to_numpy()
            yield pa.RecordBatch.from_arrays([b.column(0).slice(0, 1), pa.array([out.tobytes()], pa.binary())], ["part", "body"])

    columns = [F.monotonically_increasing_id().alias("part"), "ix", "iy", "iz", "red", "green", "blue", *([kind] if kind else [])]
    return head, q.select(*columns).mapInArrow(run, "part long, body binary")


def ply_bytes(points: DataFrame, offset: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> tuple[bytes, DataFrame]:
    """Little-endian PLY, float32 relative to ``offset``: header and body parts."""
    n = points.count()
    head = f"ply\nformat binary_little_endian 1.0\ncomment offset {offset[0]} {offset[1]} {offset[2]}\nelement vertex {n}\n" + "".join(f"property float {c}\n" for c in "xyz") + "".join(f"property uchar {c}\n" for c in ("red", "green", "blue")) + "end_header\n"
    kind = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("r", "u1"), ("g", "u1"), ("b", "u1")])

    def run(batches):
        for b in batches:
            out = np.zeros(b.num_rows, kind)
            for i, c in enumerate("xyz"):
                out[c] = b.column(i + 1).to_numpy() - offset[i]
            for i, c in enumerate("rgb"):
                out[c] = b.column(i + 4).to_numpy()
            yield pa.RecordBatch.from_arrays([b.column(0).slice(0, 1), pa.array([out.tobytes()], pa.binary())], ["part", "body"])

    return head.encode(), points.select(F.monotonically_increasing_id().alias("part"), *"xyzrgb").mapInArrow(run, "part long, body binary")


def write_parts(head: bytes, body: DataFrame, path: str) -> None:
    """Assemble a file on the driver's side, one part in memory at a time, through Hadoop's file system."""
    spark = body.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(head))
        for row in body.orderBy("part").toLocalIterator():
            out.write(bytearray(row["body"]))
    finally:
        out.close()
