"""Daily weather -> season-aligned cycles -> per-cycle orchard metrics.

Input: one row per (place_id, day) with lat, tmax, tmin, prcp; any value may be
null and days may be missing.  A cycle is a 365-day year that starts on
1 January (north) or 1 July (south), so that every rule is written once.

Layout: rows are shuffled once, by place_id.  Windows by (place_id, cycle) and
the final grouping reuse that partitioning.  A place's group is bounded by its
calendar (365 rows a year after `latest_per_day`), whatever the input skew.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graftline import fixed_values as fx
from graftline.functions import weather as wx
from graftline.functions.calendar import day_index, month_of_index

CYCLE = ["place_id", "vy"]
SEASON = ["place_id", "cycle"]


def latest_per_day(observations: DataFrame, order: str) -> DataFrame:
    """One row per (place_id, day): the last by `order`.  A plain aggregate, so repeats collapse before the shuffle."""
    rest = [c for c in observations.columns if c not in ("place_id", "day")]
    return (observations.groupBy("place_id", "day").agg(F.max_by(F.struct(*rest), order).alias("r"))
            .select("place_id", "day", "r.*"))


def nodata_gate(daily: DataFrame, max_null_share: float = fx.NO_DATA_SHARE) -> DataFrame:
    """Per place: share of days without tmax, and whether the place counts as having no land weather."""
    share = F.avg(F.col("tmax").isNull().cast("double"))
    return (daily.groupBy("place_id").agg(F.count("*").alias("n_days"), share.alias("null_share"))
            .withColumn("no_data", F.col("null_share") > max_null_share))


def to_cycles(daily: DataFrame) -> DataFrame:
    """Virtual year `vy`, virtual index `vi` 0..364 and calendar month `cmonth` 0..11; 29 February is dropped."""
    southern = F.col("lat") < 0
    di, year = F.col("di"), F.year("day")
    return (daily.where(~((F.month("day") == 2) & (F.dayofmonth("day") == 29)))
            .withColumn("southern", southern).withColumn("di", day_index("day"))
            .withColumn("vy", F.when(F.col("southern") & (di < fx.SOUTH_SHIFT), year - 1).otherwise(year))
            .withColumn("vi", F.when(~F.col("southern"), di).when(di >= fx.SOUTH_SHIFT, di - fx.SOUTH_SHIFT).otherwise(di + 184))
            .withColumn("cmonth", F.month("day") - 1).drop("di"))


def filter_complete(cycles: DataFrame, min_valid: int = fx.MIN_VALID_DAYS) -> DataFrame:
    """Keep cycles with enough days that have both extremes."""
    valid = F.count(F.when(F.col("tmax").isNotNull() & F.col("tmin").isNotNull(), 1)).over(Window.partitionBy(*CYCLE))
    return cycles.withColumn("valid_days", valid).where(F.col("valid_days") >= min_valid).drop("valid_days")


def densify(cycles: DataFrame) -> DataFrame:
    """365 rows per cycle: each row stands for itself and for the missing days up to the next one (values null)."""
    w = Window.partitionBy(*CYCLE).orderBy("vi")
    start = F.when(F.lag("vi").over(w).isNull(), F.lit(0)).otherwise(F.col("vi"))
    stop = F.coalesce(F.lead("vi").over(w) - 1, F.lit(364))
    spread = cycles.withColumn("slots", F.sequence(start, stop)).withColumn("slot", F.explode("slots"))
    own = F.col("slot") == F.col("vi")
    di = F.when(F.col("southern"), (F.col("slot") + fx.SOUTH_SHIFT) % 365).otherwise(F.col("slot"))
    return spread.select("place_id", "lat", "southern", "vy", F.col("slot").alias("vi"), month_of_index(di).alias("cmonth"),
                         *[F.when(own, F.col(c)).alias(c) for c in ("tmax", "tmin", "prcp")])


def _interpolated(c: str) -> Column:
    (i0, v0), (i1, v1) = ((F.col(f"{side}_{c}")["vi"], F.col(f"{side}_{c}")["x"]) for side in ("prev", "next"))
    line = v0 + (v1 - v0) * (F.col("vi") - i0) / (i1 - i0)
    return (F.when(F.col(c).isNotNull(), F.col(c)).when(v0.isNull(), v1).when(v1.isNull(), v0).otherwise(line))


def fill_gaps(dense: DataFrame) -> DataFrame:
    """Linear inside a cycle, flat at its ends; missing rain is no rain; swapped extremes are put right."""
    ahead = Window.partitionBy(*CYCLE).orderBy("vi").rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy(*CYCLE).orderBy(F.desc("vi")).rowsBetween(Window.unboundedPreceding, 0)
    known = {c: F.when(F.col(c).isNotNull(), F.struct("vi", F.col(c).alias("x"))) for c in ("tmax", "tmin")}
    seen = dense.select("*", *[F.last(v, ignorenulls=True).over(ahead).alias(f"prev_{c}") for c, v in known.items()])
    seen = seen.select("*", *[F.last(v, ignorenulls=True).over(back).alias(f"next_{c}") for c, v in known.items()])
    filled = seen.select("place_id", "lat", "southern", "vy", "vi", "cmonth", _interpolated("tmax").alias("a"),
                         _interpolated("tmin").alias("b"), F.coalesce("prcp", F.lit(0.0)).alias("prcp"))
    return (filled.withColumn("tmax", F.greatest("a", "b")).withColumn("tmin", F.least("a", "b"))
            .withColumn("tmean", (F.col("tmax") + F.col("tmin")) / 2).drop("a", "b"))


def filled_cycles(daily: DataFrame, min_valid: int = fx.MIN_VALID_DAYS) -> DataFrame:
    """Daily rows -> complete, gap-free cycles (place_id, lat, southern, vy, vi, cmonth, tmax, tmin, tmean, prcp)."""
    return fill_gaps(densify(filter_complete(to_cycles(daily.repartition("place_id")), min_valid)))


def with_leaf_wetness(cycles: DataFrame, humidity: DataFrame) -> DataFrame:
    """Humidity, dew hours and leaf-wet hours per day from the place's monthly dew gap and rain hours.

    `humidity`: one row per place_id with arrays dew_gap[12] and rain_hours[12]."""
    j = cycles.join(humidity.select("place_id", "dew_gap", "rain_hours"), "place_id")
    gap, hours = F.col("dew_gap")[F.col("cmonth")], F.col("rain_hours")[F.col("cmonth")]
    rh, rhn, dew = wx.day_humidity("tmax", "tmin", gap)
    return (j.withColumns({"rh": rh, "rhn": rhn, "dew": dew})
            .withColumn("lwd", wx.leaf_wet_hours("dew", "prcp", hours)).drop("dew_gap", "rain_hours"))


def with_day_terms(cycles: DataFrame) -> DataFrame:
    """Chill units, chill hours, growing degrees, blight degree-hours and water demand of every day."""
    doy = F.when(F.col("southern"), (F.col("vi") + fx.SOUTH_SHIFT) % 365 + 1).otherwise(F.col("vi") + 1)
    return cycles.withColumns({
        "chill": wx.chill_units("tmax", "tmin"), "h72": wx.hours_at_or_below("tmax", "tmin", fx.CHILL_HOURS_AT),
        "gdd": wx.growing_degrees("tmean"), "dh": wx.blight_degree_hours("tmax", "tmin"),
        "et0": wx.hargreaves_et0("lat", doy, "tmax", "tmin")})


def with_prev_autumn(days: DataFrame) -> DataFrame:
    """Give each cycle the autumn before it: days from vi 273 are also copied to the next cycle as ci = vi - 365.

    A cycle is kept only if both its own 365 days and the 92 copied ones are there, i.e. the cycle before it passed the
    completeness gate too.  Copying costs a quarter more rows and saves a self-join."""
    here = F.struct(F.col("vy").alias("cycle"), F.col("vi").alias("ci"))
    later = F.struct((F.col("vy") + 1).alias("cycle"), (F.col("vi") - 365).alias("ci"))
    both = F.when(F.col("vi") >= fx.AUTUMN_START, F.array(here, later)).otherwise(F.array(here))
    out = days.withColumn("at", F.explode(both)).select("*", "at.cycle", "at.ci").drop("at", "vy", "vi")
    w = Window.partitionBy(*SEASON)
    own, prev = F.count(F.when(F.col("ci") >= 0, 1)).over(w), F.count(F.when(F.col("ci") < 0, 1)).over(w)
    return out.withColumn("own", own).withColumn("prev", prev).where("own > 0 AND prev > 0").drop("own", "prev")


def with_chill_gate(season: DataFrame) -> DataFrame:
    """Winter chill (1 Nov - 31 Mar) and the day forcing may begin: 800 units, or 85% of what this winter offers."""
    w = Window.partitionBy(*SEASON)
    run = w.orderBy("ci").rowsBetween(Window.unboundedPreceding, 0)
    units = F.when(F.col("ci").between(fx.CHILL_START - 365, fx.CHILL_END), F.col("chill"))
    s = season.withColumn("run_chill", F.sum(F.coalesce(units, F.lit(0.0))).over(run))
    s = s.withColumn("chill_total", F.sum(units).over(w))
    gate = F.least(F.lit(fx.CHILL_GATE), F.lit(fx.CHILL_GATE_SHARE) * F.col("chill_total"))
    reached = F.col("ci").between(0, fx.CHILL_END) & (F.col("run_chill") >= gate)
    return s.withColumn("gate_vi", F.coalesce(F.min(F.when(reached, F.col("ci"))).over(w), F.lit(fx.CHILL_END))).drop("run_chill")


def with_bloom(season: DataFrame) -> DataFrame:
    """Bloom day: 220 degree-days above 5 C from 1 February or the end of chilling, by vi 200; null in a no-bloom year."""
    w = Window.partitionBy(*SEASON)
    run = w.orderBy("ci").rowsBetween(Window.unboundedPreceding, 0)
    open_ = F.col("ci").between(F.greatest(F.lit(fx.BLOOM_START), F.col("gate_vi")), F.lit(fx.BLOOM_LAST))
    warmth = F.greatest(F.lit(0.0), F.col("tmean") - F.lit(fx.BLOOM_BASE))
    s = season.withColumn("forcing", F.sum(F.when(open_, warmth).otherwise(0.0)).over(run))
    hit = open_ & (F.col("forcing") >= fx.BLOOM_GDD)
    return s.withColumn("bloom", F.min(F.when(hit, F.col("ci"))).over(w)).drop("forcing")


def with_season_end(season: DataFrame) -> DataFrame:
    """First killing freeze two months after bloom, else 290 days after bloom or the end of the cycle."""
    w = Window.partitionBy(*SEASON)
    freeze = (F.col("ci") >= F.col("bloom") + 60) & (F.col("tmin") <= fx.KILL_FREEZE)
    s = season.withColumn("freeze_vi", F.min(F.when(freeze, F.col("ci"))).over(w))
    fallback = F.when(F.col("bloom").isNotNull(), F.least(F.lit(364), F.col("bloom") + 290))
    return s.withColumn("end_vi", F.coalesce("freeze_vi", fallback))


def with_running_sums(season: DataFrame) -> DataFrame:
    """Growing degrees since bloom before each day, and blight degree-hours since a week before bloom."""
    run = Window.partitionBy(*SEASON).orderBy("ci").rowsBetween(Window.unboundedPreceding, 0)
    b, ci = F.col("bloom"), F.col("ci")
    grown = F.sum(F.when(ci >= b, F.col("gdd")).otherwise(0.0)).over(run)
    blight = F.sum(F.when(ci.between(F.greatest(F.lit(0), b - 7), F.least(F.lit(364), b + 14)), F.col("dh")).otherwise(0.0)).over(run)
    return (season.withColumn("grown", grown).withColumn("grown_before", F.col("grown") - F.when(ci >= b, F.col("gdd")).otherwise(0.0))
            .withColumn("blight_run", blight))


def season_days(daily: DataFrame, humidity: DataFrame, min_valid: int = fx.MIN_VALID_DAYS) -> DataFrame:
    """The full day table of every usable cycle (ci -92..364) with bloom, season end and running sums attached."""
    days = with_day_terms(with_leaf_wetness(filled_cycles(daily, min_valid), humidity))
    return with_running_sums(with_season_end(with_bloom(with_chill_gate(with_prev_autumn(days)))))


def chill_and_bloom(daily: DataFrame, min_valid: int = fx.MIN_VALID_DAYS) -> DataFrame:
    """Winter chill, chill hours, gate, winter minimum, canker days and bloom day per place and cycle."""
    days = filled_cycles(daily, min_valid)
    days = days.withColumn("chill", wx.chill_units("tmax", "tmin")).withColumn("h72", wx.hours_at_or_below("tmax", "tmin", fx.CHILL_HOURS_AT))
    s = with_bloom(with_chill_gate(with_prev_autumn(days)))
    return s.groupBy(*SEASON).agg(*_winter_metrics())


def _winter_metrics() -> list[Column]:
    ci = F.col("ci")
    canker = (F.col("prcp") >= fx.WET_DAY) & F.col("tmean").between(2, 16) & (ci <= fx.CHILL_END)
    return [
        F.first("lat").alias("lat"), F.first("southern").alias("southern"),
        F.first("chill_total").alias("chill"),
        F.sum(F.when(ci.between(fx.CHILL_START - 365, fx.CHILL_END), F.col("h72"))).alias("chill_hours"),
        F.first("gate_vi").alias("gate_vi"),
        (F.min(F.when(ci <= fx.SPRING_END, F.col("tmin"))) + F.lit(fx.EXTREME_MIN_BIAS)).alias("winter_min"),
        F.count(F.when(canker, 1)).alias("canker_days"),
        F.first("bloom").alias("bloom"),
    ]


def frost_window(bloom: Column | str, group: int) -> tuple[Column, Column]:
    """First and last day of a flowering group's frost window, clipped to the cycle."""
    b = (F.col(bloom) if isinstance(bloom, str) else bloom) + fx.GROUP_STEP_DAYS * (group - fx.MID_GROUP)
    return F.greatest(F.lit(0), b + fx.FROST_WINDOW[0]), F.least(F.lit(364), b + fx.FROST_WINDOW[1])


def _frost_metrics() -> list[Column]:
    nights, lows = [], []
    for g in range(1, fx.FLOWER_GROUPS + 1):
        inside = F.col("ci").between(*frost_window("bloom", g))
        nights.append(F.count(F.when(inside & (F.col("tmin") <= fx.FROST_NIGHT), 1)))
        lows.append(F.min(F.when(inside, F.col("tmin"))))
    return [F.array(*nights).alias("frost_nights"), F.array(*lows).alias("frost_min")]


def _season_metrics() -> list[Column]:
    ci, b, end = F.col("ci"), F.col("bloom"), F.col("end_vi")
    curve_last = F.least(b + 260, F.lit(364))
    full = F.max(F.when(ci <= curve_last, F.col("grown")))
    to_end = F.max(F.when((ci <= end) & (end <= b + 260), F.col("grown")))
    points = F.array_sort(F.collect_list(F.when(ci.between(b, curve_last) & ((ci - b) % fx.CURVE_STEP == 0),
                                                F.struct("ci", F.col("grown_before").alias("g")))))
    curve = F.transform(points, lambda p: p["g"])
    padded = F.concat(curve, F.array_repeat(F.try_element_at(curve, F.lit(-1)), fx.CURVE_LEN - F.size(curve)))
    hot = ci.between(b + 30, F.least(F.lit(364), b + 210))
    return [
        F.first("end_vi").alias("end_vi"), F.first("freeze_vi").alias("freeze_vi"), (F.first("end_vi") - F.first("bloom")).alias("season_days"),
        F.coalesce(F.nullif(to_end, F.lit(0.0)), full).alias("gdd_total"), padded.alias("gdd_curve"),
        F.coalesce(F.max(F.when((ci >= 0) & (ci < F.least(F.lit(200), b + 40)) & (F.col("tmin") <= fx.ANY_FROST), ci)), F.lit(-1)).alias("last_frost"),
        F.coalesce(F.min(F.when((ci >= b + 60) & (F.col("tmin") <= fx.ANY_FROST), ci)), F.lit(365)).alias("first_frost"),
        *[F.count(F.when(hot & (F.col("tmax") >= t), 1)).alias(f"hot{t}") for t in fx.HEAT_DAYS],
        F.avg(F.when(ci.between(227, 273), F.col("tmin"))).alias("fall_tmin"),
    ]


def scab_events(points: Column) -> Column:
    """Infection periods of an ordered array of (day, wet hours, hours needed).

    Wet hours add up over consecutive days of at least seven wet hours; an infection counts and the sum starts again
    when it reaches the hours needed at that day's temperature; a drier day starts the sum again."""
    start = F.struct(F.lit(0.0).alias("acc"), F.lit(0).alias("n"))

    def step(s: Column, p: Column) -> Column:
        acc = F.when(p["lwd"] >= fx.WET_RUN_HOURS, s["acc"] + p["lwd"]).otherwise(0.0)
        hit = (p["lwd"] >= fx.WET_RUN_HOURS) & F.coalesce(acc >= p["need"], F.lit(False))
        return F.struct(F.when(hit, 0.0).otherwise(acc).alias("acc"), F.when(hit, s["n"] + 1).otherwise(s["n"]).alias("n"))

    return F.aggregate(points, start, step, lambda s: s["n"])


def _wetness_metrics() -> list[Column]:
    ci, b = F.col("ci"), F.col("bloom")
    spring = ci.between(F.greatest(F.lit(0), b - 20), F.least(F.lit(364), b + 60))
    wet = F.array_sort(F.collect_list(F.when(spring, F.struct("ci", "lwd", wx.mills_hours("tmean").alias("need")))))
    blossom = ci.between(F.greatest(F.lit(0), b - 7), F.least(F.lit(364), b + 14))
    blight = (blossom & (F.col("blight_run") >= fx.BLIGHT_SUM) & (F.col("tmean") >= fx.BLIGHT_MEAN)
              & ((F.col("prcp") >= fx.BLIGHT_RAIN) | (F.col("dew") >= fx.BLIGHT_DEW)))
    summer = ci.between(b, F.least(F.lit(364), b + 90))
    mildew = F.col("tmean").between(10, 25) & (F.col("prcp") < 1) & (F.col("rhn") >= 60)
    return [
        F.count(F.when(spring & (F.col("prcp") >= fx.WET_DAY), 1)).alias("spring_wet_days"),
        F.avg(F.when(spring, F.col("tmean"))).alias("spring_t"), F.avg(F.when(spring, F.col("lwd"))).alias("lwd_spring"),
        scab_events(wet).alias("scab_events"), F.count(F.when(blight, 1)).alias("fire_blight_days"),
        F.avg(F.when(summer, F.when(mildew, 1.0).otherwise(0.0))).alias("mildew_idx"),
    ]


def _water_metrics() -> list[Column]:
    ci = F.col("ci")
    growing = ci.between(F.col("bloom"), F.col("end_vi"))
    snow = (ci >= 0) & (F.col("prcp") >= 1) & (F.col("tmean") < 0.5)
    return [
        F.sum(F.when(growing, F.col("prcp"))).alias("gs_precip"), F.sum(F.when(growing, F.lit(0.9) * F.col("et0"))).alias("gs_et0"),
        F.avg(F.when(growing, F.col("rh"))).alias("rh_gs"), F.count(F.when(snow, 1)).alias("snow_days"),
    ]


def _humidity_metrics() -> list[Column]:
    """Sums of relative humidity and leaf-wet hours by calendar month, and the days behind them; means over years are made of these."""
    month = [(F.col("ci") >= 0) & (F.col("cmonth") == m) for m in range(12)]
    none = F.lit(0.0)
    return [F.array(*[F.sum(F.when(m, F.col(c)).otherwise(none)) for m in month]).alias(f"{c}_sums") for c in ("rh", "lwd")] + [
        F.array(*[F.count(F.when(m, F.col("rh"))) for m in month]).alias("month_days")]


FAMILIES = {"frost": _frost_metrics, "season": _season_metrics, "wetness": _wetness_metrics, "water": _water_metrics}
#: Families that are only worked out when asked for.
FURTHER = {"humidity": _humidity_metrics}


def cycle_metrics(season: DataFrame, families: list[str] | None = None) -> DataFrame:
    """One row per (place_id, cycle).  Winter metrics always; the other families are null in a year without bloom."""
    chosen = [m for f in (families or list(FAMILIES)) for m in (FAMILIES | FURTHER)[f]()]
    out = season.groupBy(*SEASON).agg(*_winter_metrics(), *chosen)
    kept = SEASON + ["lat", "southern", "chill", "chill_hours", "gate_vi", "winter_min", "canker_days", "bloom"]
    out = out.select(*kept, *[F.when(F.col("bloom").isNotNull(), F.col(c)).alias(c) for c in out.columns if c not in kept])
    if "first_frost" in out.columns:
        out = out.withColumn("frost_free_days", F.col("first_frost") - F.greatest(F.lit(0), F.col("last_frost")))
    return out


def bloom_frost(metrics: DataFrame) -> DataFrame:
    """Long form of the frost metrics: one row per (place_id, cycle, flower_group)."""
    z = F.posexplode(F.arrays_zip("frost_nights", "frost_min")).alias("pos", "f")
    return (metrics.where("bloom IS NOT NULL").select(*SEASON, z)
            .select(*SEASON, (F.col("pos") + 1).alias("flower_group"), F.col("f.frost_nights").alias("frost_nights"),
                    F.col("f.frost_min").alias("frost_min"), (F.col("f.frost_nights") > 0).alias("hit")))


def humidity_by_month(season: DataFrame) -> DataFrame:
    """Mean relative humidity and leaf-wet hours per place and calendar month over cycles that bloomed."""
    return (season.where("ci >= 0 AND bloom IS NOT NULL").groupBy("place_id", "cmonth")
            .agg(F.avg("rh").alias("rh"), F.avg("lwd").alias("lwd")))
