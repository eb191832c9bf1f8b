"""Cutting long lineages at a shared folder, so that lost executors and repeated reads do not redo the work before."""
from __future__ import annotations

import functools
import tempfile

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="graftline-")


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; one of its own only where driver and executors are one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("name a folder that the driver and all executors share in spark.checkpoint.dir")
    return _own_folder(spark.sparkContext.applicationId)


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the checkpoint folder and go on from there."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
