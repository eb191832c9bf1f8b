"""Daily weather as a stream: bloom is reported once per place and cycle, when it is reached.

The stream keeps one state row per place: the days of its newest two cycles and the autumn before them, which is all that an open cycle
can still need.  A batch reads and works out only the places it touches, however long their history."""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructField, StructType
from pyspark.sql.utils import AnalysisException

from graftline import fixed_values as fx
from graftline.functions import weather as wx
from graftline.operators import cycles as cy

#: Cycles before the newest one whose days are kept.
KEPT_CYCLES = 1
STATE = "lat double, at array<int>, tmax array<double>, tmin array<double>"


def _bloom_of(days: DataFrame) -> DataFrame:
    """Bloom day of every cycle whose winter is over (place_id, lat, southern, vy, vi, tmax, tmin in; no gap filling, cycles may be unfinished)."""
    days = days.where("tmax IS NOT NULL AND tmin IS NOT NULL")
    days = days.withColumns({"a": F.greatest("tmax", "tmin"), "b": F.least("tmax", "tmin")}).withColumns({"tmax": F.col("a"), "tmin": F.col("b")}).drop("a", "b")
    days = days.withColumns({"tmean": (F.col("tmax") + F.col("tmin")) / 2, "chill": wx.chill_units("tmax", "tmin")})
    season = cy.with_bloom(cy.with_chill_gate(cy.with_prev_autumn(days)))
    done = season.groupBy("place_id", "cycle").agg(F.first("chill_total").alias("chill"), F.first("bloom").alias("bloom"), F.max("ci").alias("last"))
    return done.where((F.col("last") >= fx.CHILL_END) & F.col("bloom").isNotNull()).drop("last")


def running_bloom(daily: DataFrame) -> DataFrame:
    """Bloom day of every cycle whose winter is over, from the days so far."""
    return _bloom_of(cy.to_cycles(daily))


def _merge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A place's kept days and the batch's; of a day that comes again the new values hold.  Days of cycles that are no longer kept are late."""
    lat, at, tmax, tmin = state.get if state.exists else (None, [], [], [])
    held = {a: (x, n) for a, x, n in zip(at, tmax, tmin, strict=True)}
    newest = max((a // 1000 for a in at), default=None)
    for pdf in batches:
        lat = float(pdf["lat"].iloc[0])
        rows = pdf[["at", "tmax", "tmin"]].astype(object).where(pdf[["at", "tmax", "tmin"]].notna(), None)
        for a, x, n in sorted(rows.itertuples(index=False, name=None), key=lambda r: (r[0], str(r))):
            if newest is None or a // 1000 >= newest - KEPT_CYCLES:
                held[int(a)] = (x, n)
    if not held:
        return
    rows = sorted(held.items())
    yield pd.DataFrame({"place_id": key[0], "lat": lat, "at": [a for a, _ in rows], "tmax": pd.Series([x for _, (x, _) in rows], dtype="float64"), "tmin": pd.Series([n for _, (_, n) in rows], dtype="float64")})
    newest = rows[-1][0] // 1000
    kept = [(a, *v) for a, v in rows if a // 1000 >= newest - KEPT_CYCLES or (a // 1000 == newest - KEPT_CYCLES - 1 and a % 1000 >= fx.AUTUMN_START)]
    state.update((lat, [a for a, _, _ in kept], [x for _, x, _ in kept], [n for _, _, n in kept]))


def open_days(daily: DataFrame) -> DataFrame:
    """A stream of days -> for every place that a batch touches, its days that still count (place_id, lat, southern, vy, vi, tmax, tmin)."""
    days = cy.to_cycles(daily).select("place_id", F.col("lat").cast("double").alias("lat"), (F.col("vy") * 1000 + F.col("vi")).cast("int").alias("at"), F.col("tmax").cast("double").alias("tmax"), F.col("tmin").cast("double").alias("tmin"))
    shape = StructType([StructField("place_id", days.schema["place_id"].dataType), *StructType.fromDDL("lat double, at int, tmax double, tmin double").fields])
    kept = days.groupBy("place_id").applyInPandasWithState(_merge, shape, StructType.fromDDL(STATE), "append", GroupStateTimeout.NoTimeout)
    return kept.select("place_id", "lat", (F.col("lat") < 0).alias("southern"), F.floor(F.col("at") / 1000).cast("int").alias("vy"), (F.col("at") % 1000).alias("vi"), "tmax", "tmin")


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def stream_phenology(daily: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append new blooms to `folder`/bloom, by batch and cycle.

    A batch looks up earlier reports only in the cycles it reports itself; it writes under its own number, so a batch that is repeated
    after a failure replaces itself."""

    def on_batch(days: DataFrame, batch_id: int) -> None:
        spark = days.sparkSession
        blooms = _bloom_of(days).persist()
        try:
            cycles = [r["cycle"] for r in blooms.select("cycle").distinct().collect()]  # years
            known = _stored(spark, f"{folder}/bloom") if cycles else None
            new = blooms
            if known is not None:
                new = blooms.join(known.where((F.col("batch") < batch_id) & F.col("cycle").isin(cycles)).select("place_id", "cycle"), ["place_id", "cycle"], "left_anti")
            new.write.mode("overwrite").partitionBy("cycle").parquet(f"{folder}/bloom/batch={batch_id}")
        finally:
            blooms.unpersist()

    return open_days(daily).writeStream.foreachBatch(on_batch).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
