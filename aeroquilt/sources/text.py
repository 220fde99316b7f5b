"""Text formats: control point lists, XMP tags, file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def capture_key(name: Column) -> Column:
    """File name without its alphabetic sensor suffix; the whole name where there is none."""
    key = F.regexp_extract(name, r"^(.+)_([A-Za-z]+)\.([^.]+)$", 1)
    return F.when(key != "", key).otherwise(name)


def parse_gcps(lines: DataFrame, column: str = "line") -> DataFrame:
    """(name, x, y, z, u, v, image): blank or comma separated, ``#`` comments and malformed rows left out; nameless points are named by place."""
    p = F.split(F.trim(F.col(column)), r"[,\s]+")
    df = lines.where(~F.ltrim(F.col(column)).startswith("#")).select(p.alias("p")).where(F.size("p") >= 6)
    n = [F.expr(f"try_cast(p[{i}] as double)") for i in range(5)]
    df = df.select(*[c.alias(k) for c, k in zip(n, "xyzuv", strict=True)], F.substring_index(F.col("p")[5], "/", -1).alias("image"), F.get("p", F.lit(6)).alias("name"))
    df = df.where("x is not null and y is not null and z is not null and u is not null and v is not null")
    place = F.concat_ws("_", *[F.format_string("%.4f", c) for c in "xyz"])
    return df.select(F.coalesce("name", place).alias("name"), "x", "y", "z", "u", "v", "image")


def read_gcps(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """Points of a list file, and its reference system: {"epsg": n or None, "degrees": bool}."""
    lines = spark.read.text(path).withColumnRenamed("value", "line")
    head = lines.where("line not like '#%' and trim(line) <> ''").limit(1).collect()
    text = head[0]["line"] if head else ""
    import re

    epsg = re.search(r"(?i)epsg:\s*(\d+)", text)
    degrees = bool(re.search(r"(?i)longlat|wgs\s*84", text)) or bool(epsg and epsg[1] == "4326")
    return parse_gcps(lines), {"epsg": int(epsg[1]) if epsg else None, "degrees": degrees}


def xmp_tags(df: DataFrame, column: str) -> DataFrame:
    """Drone tags out of the first 256 KiB of a photo's text: altitude, pitch, RTK sigma (larger of two), shutter."""
    head = F.substring(F.col(column), 1, 262144)
    tag = lambda name: F.regexp_extract(head, f'{name}="([^"]+)"', 1)
    number = lambda name: F.expr(f"try_cast(nullif(regexp_extract(substring({column}, 1, 262144), '{name}=\"([^\"]+)\"', 1), '') as double)")
    return df.withColumns({"rel_alt": number("RelativeAltitude"), "pitch": number("GimbalPitchDegree"), "rtk_sigma": F.greatest(number("RtkStdLat"), number("RtkStdLon")), "shutter": F.nullif(tag("ShutterType"), F.lit(""))})


def read_photo_heads(spark: SparkSession, path: str) -> DataFrame:
    """(path, head) of the photos of a folder: the head's bytes as Latin-1 text."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{jpg,JPG,jpeg,JPEG,png,PNG,tif,TIF,tiff,TIFF}").load(path)
    return files.select("path", F.decode(F.substring(F.col("content"), 1, 262144), "ISO-8859-1").alias("head"))
