"""Taste reports as a stream: the current state of every report, summaries of it, and windowed tag counts."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graftline.operators import tastings as ts


def current_reports(reports: DataFrame, version: str = "updated_at") -> DataFrame:
    """The latest version of each report (of equal times the one with the larger hash).

    Later edits replace text and labels, however late they come."""
    rest = [c for c in reports.columns if c != "number"]
    latest = F.struct(F.col(version), F.xxhash64(*[F.to_json(F.struct(c)) for c in ("number", *rest)]))
    return reports.groupBy("number").agg(F.max_by(F.struct(*rest), latest).alias("r")).select("number", "r.*")


def keep_current_reports(reports: DataFrame, store: str, checkpoint: str, version: str = "updated_at") -> StreamingQuery:
    """Write the reports that each batch brings, in their latest version there, as the batch's own folder of the store.

    The store is the state: a batch costs what it brings, however many reports came before it."""

    def write(brought: DataFrame, batch: int) -> None:
        current_reports(brought, version).write.mode("overwrite").parquet(f"{store}/batch={batch}")

    return reports.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def stored_reports(spark: SparkSession, store: str, version: str = "updated_at") -> DataFrame:
    """Every report in the latest version that any batch brought."""
    return current_reports(spark.read.parquet(store).drop("batch"), version)


def stored_summary(spark: SparkSession, store: str, names: DataFrame) -> DataFrame:
    """Summary per variety of the current reports: a report that has turned spam or names another variety counts as it now is."""
    return ts.tasting_summary(ts.resolve_reports(ts.parse_reports(ts.valid_reports(stored_reports(spark, store))), names))


def stream_tag_windows(tags: DataFrame, length: str = "7 days", delay: str = "2 days") -> DataFrame:
    """Reports per tag and week; a week is final once the watermark has passed its end, later rows are dropped.

    `tags`: created_at, tag."""
    counts = tags.withWatermark("created_at", delay).groupBy(F.window("created_at", length), "tag").agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "tag", "n")
