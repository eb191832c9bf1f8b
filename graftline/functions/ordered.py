"""Positions and counts over a whole ordered table without sorting it in one task.

Rows are dealt by ranges of the whole sort key, so a common beginning of the key is no bottleneck; each range is numbered where it
lies and shifted by the rows before it.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graftline.plans.lineage import cut

_IN_PARTITION = (1 << 33) - 1


def global_row_number(df: DataFrame, order: list[Column], name: str = "row") -> DataFrame:
    """1-based position of every row in the whole table by `order`, which should tell all rows apart.

    The numbered ranges are written to the shared folder, so that a lost task cannot number them anew; the running total is over
    one row per range."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    inside = cut(ranged.select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_PARTITION)).alias("_inside")))
    sizes = inside.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    return inside.join(offsets, "_range").withColumn(name, F.col("_before") + F.col("_inside") + 1).drop("_range", "_inside", "_before")


def row_numbers_within(df: DataFrame, group: str, order: list[Column], name: str = "row") -> DataFrame:
    """1-based position of every row among the rows of its group by `order`; all groups are dealt and numbered in one pass."""
    order = [F.asc(group), *order]
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    inside = cut(ranged.select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_PARTITION)).alias("_inside")))
    sizes = inside.groupBy(group, "_range").agg(F.count("*").alias("_n"), F.min("_inside").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(group, "_range", (F.coalesce(before, F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    return inside.join(offsets, [group, "_range"]).withColumn(name, F.col("_inside") + F.col("_shift")).drop("_range", "_inside", "_shift")


def counts_below(df: DataFrame, group: str, value: str, width: float) -> DataFrame:
    """(group, value, equal, below, total): how many rows of the group have the value, a smaller one, and any.

    Rows are first counted per distinct value, so a value shared by a third of all rows is one row from then on; buckets of
    `width` bound how many distinct values are ordered together."""
    counts = (df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("equal"))
              .withColumn("_bucket", F.floor(F.col(value) / F.lit(float(width)))))
    buckets = counts.groupBy(group, "_bucket").agg(F.sum("equal").alias("_n"))
    w = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select(group, "_bucket", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(group)).alias("total"))
    inside = F.sum("equal").over(Window.partitionBy(group, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    return (counts.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(buckets, [group, "_bucket"])
            .select(group, value, "equal", (F.col("_before") + F.col("_inside")).alias("below"), "total"))
