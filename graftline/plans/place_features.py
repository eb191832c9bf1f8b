"""Weather -> place features: the batch that turns daily rows into one feature row per place."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graftline import fixed_values as fx
from graftline.operators import climatology as cl
from graftline.operators import cycles as cy


def place_features(daily: DataFrame, humidity_daily: DataFrame | None = None, min_valid: int = fx.MIN_VALID_DAYS) -> DataFrame:
    """All metrics of a place in one row.

    Normals are partial aggregates where the days lie; the days are shuffled by place once, for the seasons.  One pass over these gives the
    cycle metrics with the monthly sums, whose aggregate over the years is the summary.  Every join after that is between tables with
    one row per place."""
    normals = cl.monthly_normals(daily)
    clim = None if humidity_daily is None else cl.humidity_climatology(humidity_daily)
    dew = cl.dew_terms(normals, clim)
    season = cy.season_days(daily, dew, min_valid)
    summary = cl.summarise_cycles(cy.cycle_metrics(season, [*cy.FAMILIES, "humidity"]))
    hottest = F.array_max("tmax_m")
    return (normals.drop("first_day", "last_day", "lat", "southern").join(summary, "place_id")
            .join(dew.select("place_id", "dew_gap", F.col("estimated").alias("humidity_estimated")), "place_id")
            .withColumn("tmax_hot", hottest))
