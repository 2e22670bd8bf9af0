"""Reliable checkpoints in the folder that the session names."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use ``spark.checkpoint.dir``; a scratch folder only in local mode without it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="dealflow-")
    sc.setCheckpointDir(folder)


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and stored, so that it is measured and then used unchanged."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()
