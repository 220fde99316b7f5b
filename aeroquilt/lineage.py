"""Cutting lineage in iterative jobs: reliable checkpoints in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and read back from ``spark.checkpoint.dir``; a local folder only where that is unset, in local mode."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="aeroquilt-"))
    return df.checkpoint()
