"""Climatology: monthly normals, humidity normals and the cross-year summary (one row per place)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graftline import fixed_values as fx
from graftline.functions import weather as wx
from graftline.functions.calendar import vi_label
from graftline.functions.numeric import clamp, half_up, half_up_to, norm_cdf

MONTHS = range(1, 13)


def _by_month(value: str) -> Column:
    """Twelve monthly values of a place as an array in calendar order (null where a month has none)."""
    pairs = F.map_from_entries(F.collect_list(F.struct("month", F.col(value))))
    return F.transform(F.sequence(F.lit(1), F.lit(12)), lambda m: F.try_element_at(pairs, m))


def monthly_rows(daily: DataFrame) -> DataFrame:
    """Sums and counts per (place_id, month): the only pass over the days; everything after works on 12 rows a place."""
    both = F.col("tmax").isNotNull() & F.col("tmin").isNotNull()
    return (daily.groupBy("place_id", F.month("day").alias("month"))
            .agg(F.avg(F.when(both, F.col("tmax"))).alias("tmax"), F.avg(F.when(both, F.col("tmin"))).alias("tmin"),
                 F.avg(F.when(both, (F.col("tmax") + F.col("tmin")) / 2)).alias("tmean"),
                 F.coalesce(F.sum("prcp"), F.lit(0.0)).alias("rain"), F.first("lat").alias("lat"),
                 F.min("day").alias("first_day"), F.max("day").alias("last_day")))


def monthly_normals(daily: DataFrame) -> DataFrame:
    """Monthly mean max/min/mean and rain per year, annual mean and rain, and the climate class.

    The length of the record is its calendar span, so missing rows do not shorten it."""
    m = monthly_rows(daily).groupBy("place_id").agg(
        F.first("lat").alias("lat"), F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"),
        *[_by_month(c).alias(f"{c}_m") for c in ("tmax", "tmin", "tmean", "rain")])
    years = (F.datediff("last_day", "first_day") + 1) / F.lit(365.25)
    m = m.withColumn("southern", F.col("lat") < 0).withColumn(
        "prcp_m", F.transform(F.col("rain_m"), lambda r: F.coalesce(r, F.lit(0.0)) / years)).drop("rain_m")
    add = lambda a, x: a + x                                                    # noqa: E731
    code = wx.koppen("tmean_m", "prcp_m", "southern")
    return (m.withColumn("tann", F.aggregate("tmean_m", F.lit(0.0), add) / 12).withColumn("pann", F.aggregate("prcp_m", F.lit(0.0), add))
            .withColumn("koppen_code", code).withColumn("koppen_name", wx.koppen_name("koppen_code"))
            .withColumn("period", period_label("first_day", "last_day")))


def period_label(first_day: str, last_day: str) -> Column:
    """'1995-2004': first year, and as many whole years as the record is long."""
    start = F.year(first_day)
    years = half_up((F.datediff(last_day, first_day) + 1) / F.lit(365.25)).cast("int")
    return F.concat(start.cast("string"), F.lit("-"), (start + years - 1).cast("string"))


def humidity_climatology(humidity_daily: DataFrame) -> DataFrame:
    """Mean tmin - dew point and mean rain hours of wet days per month, with defaults where nothing was measured."""
    wet = (F.col("prcp") >= 1) & F.col("ph").isNotNull()
    rows = (humidity_daily.groupBy("place_id", F.month("day").alias("month"))
            .agg(F.avg(F.col("tmin") - F.col("dew")).alias("gap"), F.avg(F.when(wet, F.col("ph"))).alias("hours")))
    rows = rows.withColumn("gap", clamp("gap", -1.0, 14.0)).withColumn("hours", clamp("hours", 3.0, 20.0))
    return (rows.groupBy("place_id").agg(_by_month("gap").alias("gap"), _by_month("hours").alias("hours"))
            .select("place_id", F.transform("gap", lambda x: F.coalesce(x, F.lit(fx.DEFAULT_DEW_GAP))).alias("dew_gap"),
                    F.transform("hours", lambda x: F.coalesce(x, F.lit(fx.DEFAULT_RAIN_HOURS))).alias("rain_hours")))


def dew_terms(normals: DataFrame, climatology: DataFrame | None = None) -> DataFrame:
    """Monthly dew gap and rain hours per place: measured where a humidity record exists, else guessed from the rain."""
    guess = F.transform("prcp_m", lambda p: clamp(F.lit(2.5) * (F.lit(1.0) - p / F.lit(50.0)), 0.0, 2.5))
    nine = F.array_repeat(F.lit(fx.DEFAULT_RAIN_HOURS), 12)
    base = normals.select("place_id", guess.alias("guess"))
    if climatology is None:
        return base.select("place_id", F.col("guess").alias("dew_gap"), nine.alias("rain_hours"), F.lit(True).alias("estimated"))
    j = base.join(climatology, "place_id", "left")
    return j.select("place_id", F.coalesce("dew_gap", "guess").alias("dew_gap"), F.coalesce("rain_hours", nine).alias("rain_hours"),
                    F.col("dew_gap").isNull().alias("estimated"))


def _sd(c: Column | str, at_least: float | None = None) -> Column:
    s = F.coalesce(F.stddev_samp(c), F.lit(0.0))
    return s if at_least is None else F.greatest(F.lit(at_least), s)


def summarise_cycles(metrics: DataFrame) -> DataFrame:
    """Cross-year summary, one row per place.  Bloom-dependent values use only the years that bloomed.

    Where the metrics hold the monthly sums of humidity, their means rh_m[12] and lwd_m[12] come out of the same aggregation."""
    monthly = [F.array(*[F.try_divide(F.sum(F.col(f"{c}_sums")[m]), F.sum(F.col("month_days")[m])) for m in range(12)]).alias(f"{c}_m")
               for c in ("rh", "lwd") if f"{c}_sums" in metrics.columns]
    hits, nights, lows, spread = [], [], [], []
    for g in range(fx.FLOWER_GROUPS):
        n, low = F.col("frost_nights")[g], F.col("frost_min")[g]
        hits.append(F.avg((n > 0).cast("double")))
        nights.append(F.avg(n))
        lows.append(F.avg(low))
        spread.append(_sd(low, 1.2))
    spring = F.when(F.col("last_frost") >= 0, F.col("last_frost"))
    out = metrics.groupBy("place_id").agg(
        F.first("lat").alias("lat"), F.first("southern").alias("southern"), F.count("*").alias("n_cycles"),
        F.count("bloom").alias("n_bloom"), (F.count("*") - F.count("bloom")).alias("no_bloom_years"),
        F.avg("chill").alias("chill_mean"), F.percentile("chill", 0.2).alias("chill_p20"), F.min("chill").alias("chill_min"),
        F.max("chill").alias("chill_max"), F.avg("chill_hours").alias("chill_hours72"),
        F.avg("winter_min").alias("ext_min_mean"), F.min("winter_min").alias("ext_min_abs"),
        F.avg("bloom").alias("bloom_vi"), _sd("bloom").alias("bloom_sd"),
        F.array(*hits).alias("hits"), F.array(*spread).alias("spread"), F.array(*nights).alias("frost_nights"), F.array(*lows).alias("frost_min"),
        F.avg(spring).alias("last_spring_vi"), F.count(spring).alias("frost_years"),
        F.array(*[half_up(F.avg(F.col("gdd_curve")[k])).cast("double") for k in range(fx.CURVE_LEN)]).alias("gdd_curve"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("bloom").isNotNull(), F.struct("cycle", "gdd_total")))),
                    lambda s: half_up(s["gdd_total"]).cast("double")).alias("gend_per"),
        F.percentile("gdd_total", 0.5).alias("gend_median"), F.percentile("gdd_total", 0.2).alias("gend_p20"),
        F.avg("end_vi").alias("end_vi"), F.avg("season_days").alias("season_days"),
        F.count("freeze_vi").alias("freezes"), F.avg("freeze_vi").alias("freeze_vi"),
        *[F.avg(f"hot{t}").alias(f"hot{t}") for t in fx.HEAT_DAYS], F.avg("fall_tmin").alias("fall_tmin"),
        F.avg("spring_wet_days").alias("spring_wet_days"), F.avg("spring_t").alias("spring_t"),
        F.avg("canker_days").alias("canker_days"), F.avg("fire_blight_days").alias("fire_blight_events"),
        F.avg("mildew_idx").alias("mildew_idx"), F.avg("scab_events").alias("scab_events"), F.avg("lwd_spring").alias("lwd_spring"),
        F.avg("gs_precip").alias("gs_precip"), F.avg("gs_et0").alias("gs_et0"), F.avg("rh_gs").alias("rh_gs"),
        F.avg("snow_days").alias("snow_days"), F.avg("frost_free_days").alias("frost_free_days"), *monthly)
    z = F.zip_with("frost_min", "spread", lambda low, sd: (F.lit(fx.FROST_NIGHT) - low) / sd)
    chance = F.zip_with("hits", F.transform(z, norm_cdf), lambda hit, fit: F.lit(0.5) * hit + F.lit(0.5) * fit)
    out = out.withColumns({"frost_p": chance, "zone": wx.usda_zone("ext_min_mean"), "bloomed": F.col("n_bloom") > 0})
    rarely = F.col("frost_years") < F.col("n_bloom") / 2
    labels = {"bloom_label": vi_label("bloom_vi", "southern"), "end_label": vi_label("end_vi", "southern"),
              "last_spring": F.when(rarely, "rarely").otherwise(vi_label("last_spring_vi", "southern")),
              "first_freeze": F.when(F.col("freezes") > 0, vi_label("freeze_vi", "southern"))}
    only_bloomed = {c: F.col(c) for c in ("frost_p", "frost_nights", "frost_min", "gdd_curve", "gend_per")} | labels
    return out.withColumns({
        "zone_value": F.col("zone.value"), "zone_label": F.col("zone.label"),
        "freeze_years": F.when(F.col("bloomed"), F.try_divide("freezes", "n_bloom")),
        "aridity": F.col("gs_precip") / F.greatest(F.lit(1.0), F.col("gs_et0")),
        "no_bloom": ~F.col("bloomed"),
        "tropical": (F.col("ext_min_mean") > 12) | (F.col("chill_mean") < 30),
        **{name: F.when(F.col("bloomed"), c) for name, c in (only_bloomed | {c: F.col(c) for c in ("rh_m", "lwd_m") if monthly}).items()},
    }).drop("freezes", "freeze_vi", "frost_years", "hits", "spread", "zone", "bloomed")


def feature_status(complete_cycles: DataFrame, summary: DataFrame) -> DataFrame:
    """'not enough data' below three complete cycles, 'no bloom', 'tropical' or 'ok' per place.

    `complete_cycles`: one row per (place_id, vy) that passed the completeness gate."""
    n = complete_cycles.groupBy("place_id").agg(F.countDistinct("vy").alias("complete"))
    j = n.join(summary.select("place_id", "no_bloom", "tropical"), "place_id", "left")
    status = (F.when((F.col("complete") < fx.MIN_CYCLES) | F.col("no_bloom").isNull(), "not enough data")
              .when(F.col("no_bloom"), "no bloom").when(F.col("tropical"), "tropical").otherwise("ok"))
    return j.select("place_id", "complete", status.alias("status"))


def mean_curve(metrics: DataFrame) -> DataFrame:
    """Mean growing-degree curve as rows (place_id, days_after_bloom, gdd)."""
    pts = metrics.where("bloom IS NOT NULL").select("place_id", F.posexplode("gdd_curve").alias("k", "g"))
    return (pts.groupBy("place_id", "k").agg(half_up(F.avg("g")).alias("gdd"))
            .select("place_id", (F.col("k") * fx.CURVE_STEP).alias("days_after_bloom"), "gdd"))


def monthly_humidity(by_month: DataFrame) -> DataFrame:
    """Arrays rh_m[12] and lwd_m[12] per place from `humidity_by_month` rows."""
    rows = by_month.withColumn("month", F.col("cmonth") + 1)
    return rows.groupBy("place_id").agg(_by_month("rh").alias("rh_m"), _by_month("lwd").alias("lwd_m"))


def compact(features: DataFrame, decimals: int = 2, drop: tuple[str, ...] = ()) -> DataFrame:
    """Rounded copy for storage: doubles to two decimals (half-up), non-finite to null, named columns dropped."""

    def tidy(x: Column) -> Column:
        return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), half_up_to(x, decimals))

    cols = []
    for f in features.schema.fields:
        kind = f.dataType.simpleString()
        if f.name in drop:
            continue
        if kind == "double":
            cols.append(tidy(F.col(f.name)).alias(f.name))
        elif kind == "array<double>":
            cols.append(F.transform(f.name, tidy).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return features.select(*cols)
