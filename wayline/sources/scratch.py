"""Tables that a job needs more than once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> str:
    """The checkpoint folder (``spark.checkpoint.dir``), which all machines share; in local mode one of our own if none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        known = spark.conf.get("spark.checkpoint.dir", None)
        if known is None and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(known or tempfile.mkdtemp(prefix="wayline-"))
    return sc.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """``df`` worked out once and kept in the checkpoint folder."""
    _folder(df.sparkSession)
    return df.checkpoint()


def fresh_path(spark: SparkSession) -> str:
    """A path in the checkpoint folder at which nothing is yet."""
    return f"{_folder(spark)}/wayline-{uuid.uuid4().hex}"
