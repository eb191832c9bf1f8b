"""Using all cores on inputs that come in a few big pieces."""
from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread rows over the cores by key, only if the input has fewer partitions than there are cores.

    Large inputs already have more partitions than that and are left as they are: no shuffle is added for them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)
