"""Reading, scratch tables, joins on keys that may be hot, and small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_scratch: set[str] = set()
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Rows of one key that a join brings to one task at most.
HOT_ROWS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.  Where it is unset, a local one, but only in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = given.get() if given.isDefined() else None
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = getattr(shared_dir, "_own", None)
        if base is None:
            base = shared_dir._own = "file://" + tempfile.mkdtemp(prefix="aeroquilt-")
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/aeroquilt/{name}-{uuid.uuid4().hex[:12]}"
    if not _scratch:
        atexit.register(_clean)
    _scratch.add(path)
    return path


def _clean() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        with contextlib.suppress(Exception):  # the session may be gone
            for path in list(_scratch):
                remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder through Hadoop's file system, wherever it is."""
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    finally:
        _scratch.discard(path)


@contextlib.contextmanager
def shuffles_cleaned(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries run inside go when each query ends: what comes after reads what they wrote."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def materialise(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage and survives a lost executor."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with shuffles_cleaned(spark):
        df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete what ``materialise`` wrote for these tables; nothing may read them any more."""
    for df in tables:
        remove(df.sparkSession, df._scratch_path)


def join_unique(big: DataFrame, small: DataFrame, key: str, count: str, salt_by: list[str], how: str = "left", most: int = HOT_ROWS) -> DataFrame:
    """``big`` joined to ``small``, which has one row for each key and, in ``count``, how many rows of ``big`` have that key.

    A key with over ``most`` rows is dealt to several tasks by a hash of ``salt_by``, and its row of ``small`` repeated for each.  The
    list of such keys is broadcast: it has at most one row for each ``most`` rows of ``big``.  ``count`` is dropped.
    """
    salts = F.ceil(F.col(count) / F.lit(most)).cast("int")
    hot = small.where(F.col(count) > most).select(key, salts.alias("__salts"))
    left = big.join(F.broadcast(hot), key, "left")
    left = left.withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(*salt_by), F.col("__salts")).cast("int"), F.lit(0))).drop("__salts")
    right = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1))).drop(count)
    return left.join(right, [key, "__salt"], how).drop("__salt")
