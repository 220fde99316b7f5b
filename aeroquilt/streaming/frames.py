"""Photos that arrive while a survey is flown: metadata as a stream, and running extents.  An addition; surveys themselves are batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.photos import parse_frames

FILES = "path string, modificationTime timestamp, length long, content binary"


def photo_stream(spark: SparkSession, folder: str, per_batch: int = 500) -> DataFrame:
    """Metadata rows of photos as they are added to ``folder``, with their arrival time."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.{jpg,JPG,jpeg,JPEG}").option("maxFilesPerTrigger", per_batch).load(folder)
    return parse_frames(files)


def running_extent(frames: DataFrame) -> DataFrame:
    """Count and bounding box of all positions so far; write it in complete or update mode."""
    return frames.where("lat is not null and lon is not null").groupBy(F.lit(1).alias("survey")).agg(F.count("*").alias("n"), *[f(c).alias(f"{k}_{c}") for c in ("lat", "lon") for k, f in (("min", F.min), ("max", F.max))])
