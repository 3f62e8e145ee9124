"""Cutting lineage by checkpoints in the folder that the cluster names."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and written to the checkpoint folder: what several later steps read isn't computed again, and a lost
    executor costs none of it. The folder is the session's spark.checkpoint.dir; only a local session without one gets its own."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        found = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not found and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(found or "file://" + os.path.join(tempfile.gettempdir(), "tessera-checkpoints"))
    return df.checkpoint()
