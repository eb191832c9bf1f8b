"""Variety x place scoring.

`score` works on a table of (variety_id, place_id) pairs: which pairs to score is a relation of its own (an offer, a
selection, a listing), joined by key to both sides.  Everything that depends on the place alone is computed once per place
by `prepare_places`, so a pair costs a few arithmetic expressions and lookups.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graftline import fixed_values as fx
from graftline.functions import weather as wx
from graftline.functions.calendar import vi_label
from graftline.functions.spread import spread
from graftline.functions.numeric import banded, clamp, half_up, piecewise, weeks_shift

INF = float("inf")


def or_infinite(x: Column, y: Column) -> Column:
    """x / y, infinite where y is zero, null where either is null."""
    return F.coalesce(F.try_divide(x, y), F.when(x.isNotNull() & (y == 0), F.lit(INF)))


# ---- place side -------------------------------------------------------------------
def site_pressures(places: DataFrame) -> DataFrame:
    """Disease pressure 0..1 of a place as columns p_scab .. p_rust: weather sets how bad, the region whether at all."""
    scab = clamp((F.col("scab_events") - 8.0) / 26.0, 0.0, 1.0) * piecewise("spring_t", fx.SCAB_TEMPERATURE_RAMP)
    canker = clamp((F.col("canker_days") - 25.0) / 60.0, 0.0, 1.0) * F.when(F.col("ext_min_mean") > -28, 1.0).otherwise(0.6)
    mildew = clamp((F.col("mildew_idx") - 0.25) / 0.4, 0.0, 1.0)
    blight = clamp(F.col("fire_blight_events") / 4.0, 0.0, 1.0) * F.when(F.col("fire_blight_status") == "absent", 0.1).otherwise(1.0)
    rust = F.when(F.col("rust_present"), clamp((F.col("scab_events") - 6.0) / 22.0, 0.0, 1.0) * 0.9).otherwise(0.0)
    return places.withColumns(dict(zip([f"p_{d}" for d in fx.DISEASES], [scab, canker, mildew, blight, rust])))


def _shift(southern: str) -> Column:
    return F.when(F.col(southern), fx.SOUTH_SHIFT).otherwise(0)


def _daily_normals(monthly: str) -> Column:
    """A monthly normal on each of the 365 calendar days."""
    return F.transform(F.sequence(F.lit(0), F.lit(364)), lambda d: wx.normal_on(monthly, d))


def _window_means(monthly: str, days: int) -> Column:
    """Mean over `days` sampled every third day, for a window that starts at each virtual day 0..364.

    The daily normals are bound once as the element of a one-element array, so they are not recomputed per window."""
    n = days // 3 + 1
    steps = F.sequence(F.lit(0), F.lit(n - 1))

    def all_starts(daily: Column) -> Column:
        def at(start: Column) -> Column:
            day = lambda k: F.element_at(daily, (start + _shift("southern") + k * 3) % 365 + 1)      # noqa: E731
            return F.aggregate(steps, F.lit(0.0), lambda a, k: a + day(k)) / F.lit(float(n))

        return F.transform(F.sequence(F.lit(0), F.lit(364)), at)

    return F.element_at(F.transform(F.array(_daily_normals(monthly)), all_starts), 1)


def window_mean(table: Column | str, start_vi: Column) -> Column:
    """Look up a window mean for a (fractional) first virtual day."""
    return F.try_element_at(F.col(table) if isinstance(table, str) else table, F.pmod(half_up(start_vi), F.lit(365)).cast("int") + 1)


def prepare_places(places: DataFrame) -> DataFrame:
    """Add what scoring needs per place: disease pressures with their words and drivers, the mean of the 60 days after bloom, six-week
    window means."""
    p = site_pressures(spread(places, "place_id"))
    after = [wx.span_mean(m, F.col("bloom_vi"), F.col("bloom_vi") + 60, "southern") for m in ("tmax_m", "tmin_m")]
    said = {f"word_{d}": pressure_word(f"p_{d}") for d in fx.DISEASES} | {f"driver_{d}": disease_driver(d) for d in fx.DISEASES}
    return p.withColumns({"t60": (after[0] + after[1]) / 2, "win_tmax": _window_means("tmax_m", 42), "win_tmin": _window_means("tmin_m", 42)} | said)


def reference_place(prepared: DataFrame, place_id) -> Column:
    """The reference place (where harvest dates were recorded) as one struct value; a scalar subquery, not a join."""
    return (prepared.where(F.col("place_id") == F.lit(place_id))
            .select(F.struct("bloom_vi", "gdd_curve", "t60").alias("ref")).scalar())


# ---- factors ------------------------------------------------------------------------
def thermal_need(harvest_doy: str, ref: str = "ref") -> Column:
    """Degree-days from bloom to harvest implied by the harvest date at the reference place."""
    return wx.curve_at(F.col(f"{ref}.gdd_curve"), F.col(harvest_doy) - F.col(f"{ref}.bloom_vi"))


def harvest_vi(ref: str = "ref") -> tuple[Column, Column]:
    """(picking day, days after bloom): days after bloom at the reference, 2.5% fewer per degree the 60 days after bloom are warmer."""
    factor = clamp(F.lit(1.0) - fx.DAYS_AFTER_BLOOM_PER_DEGREE * (F.col("t60") - F.col(f"{ref}.t60")), 0.75, 1.2)
    days = (F.col("harvest_doy") - F.col(f"{ref}.bloom_vi")) * factor
    return F.col("bloom_vi") + days, days


def _need(c: str, default: int) -> Column:
    return F.coalesce(c, F.lit(default))


def _with_ratios(j: DataFrame) -> DataFrame:
    """The number behind each factor, before any ramp."""
    group = clamp(_need("flower_group", fx.DEFAULT_GROUP), 1, 7).cast("int")
    heat = clamp(_need("heat_tolerance", fx.DEFAULT_HEAT), 1, 5).cast("int")
    allowance = F.element_at(F.array(*[F.lit(x) for x in fx.HEAT_ALLOWANCE]), heat)
    vi, dafb = harvest_vi()
    j = j.withColumns({
        "chill_ratio": or_infinite(F.lit(0.5) * F.col("chill_mean") + F.lit(0.5) * F.col("chill_p20"), _need("chill_hours", fx.DEFAULT_CHILL_NEED).cast("double")),
        "zone_margin": F.col("zone_value") - _need("hardiness_zone", fx.DEFAULT_ZONE),
        "frost_chance": F.try_element_at("frost_p", group),
        "gdd_need": thermal_need("harvest_doy"),
        "heat_ratio": F.col("hot32") / allowance,
        "harvest_vi": vi, "dafb": half_up(dafb),
    })
    return j.withColumns({"season_ratio": or_infinite(F.col("gend_median"), F.col("gdd_need")), "shift": half_up(F.col("harvest_vi") - F.col("harvest_doy"))})


def _with_factors(j: DataFrame) -> DataFrame:
    """The ramps stand in one projection with the years counted in an array, which Spark compiles in small pieces; with what follows
    they would make one method too large for the JVM to compile."""
    good = F.size(F.filter("gend_per", lambda g: g >= F.col("gdd_need"))) / F.size("gend_per")
    ok_years = F.when(F.col("gdd_need").isNotNull(), good)
    night = F.when(F.coalesce("colour_cool_nights", F.lit(False)) & (F.col("fall_tmin") > 14), piecewise("fall_tmin", fx.WARM_NIGHT_RAMP)).otherwise(1.0)
    return j.withColumns({
        "ok_years": ok_years, "f_chill": F.when(F.col("tropical"), 0.0).otherwise(piecewise("chill_ratio", fx.CHILL_RAMP)),
        "f_hardiness": piecewise("zone_margin", fx.HARDINESS_RAMP),
        "f_frost": piecewise("frost_chance", fx.FROST_RAMP),
        "f_season": F.when(F.col("harvest_doy").isNull(), 0.7).otherwise(
            F.least(piecewise("season_ratio", fx.SEASON_RAMP), F.lit(0.2) + F.lit(0.8) * ok_years)),
        "f_heat": piecewise("heat_ratio", fx.HEAT_RAMP) * F.when(F.col("hot38") > 2, 0.85).otherwise(1.0) * night,
        "f_water": piecewise("aridity", fx.WATER_RAMP),
    })


def _with_disease(j: DataFrame) -> DataFrame:
    """Loss per disease and the share of crop left; unrated susceptibility counts as 3 and is flagged."""
    weights = F.array(*[F.lit(w) for w in fx.SUSCEPTIBILITY_WEIGHT])
    losses = {}
    for d in fx.DISEASES:
        s = clamp(_need(d, fx.DEFAULT_SUSCEPTIBILITY), 1, 5).cast("int")
        losses[f"loss_{d}"] = F.col(f"p_{d}") * F.element_at(weights, s) * F.lit(fx.DISEASE_STRENGTH[d])
    j = j.withColumns(losses)
    left = reduce(lambda a, b: a * b, [F.lit(1.0) - F.col(c) for c in losses])
    assumed = reduce(lambda a, b: a | b, [F.col(d).isNull() for d in fx.DISEASES])
    return j.withColumns({"disease_left": left, "disease_assumed": assumed})


def label(score: Column | str) -> Column:
    return banded(score, fx.CLIMATE_LABELS)


def disease_label(score: Column | str) -> Column:
    return banded(score, fx.DISEASE_LABELS)


def verdict(f: Column | str) -> Column:
    return banded(f, fx.VERDICTS)


def _combined(j: DataFrame) -> DataFrame:
    """Weighted mean of the factors times the weakest critical factor to the power 0.6; disease apart; `both` the lower."""
    base = reduce(lambda a, b: a + b, [F.lit(fx.WEIGHTS[k]) * F.col(f"f_{k}") for k in fx.FACTORS]) / F.lit(sum(fx.WEIGHTS.values()))
    weakest = F.least(*[F.col(f"f_{k}") for k in fx.CRITICAL])
    worst = F.array_min(F.array(*[F.struct(F.col(f"f_{k}").alias("f"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(fx.FACTORS)]))
    j = j.withColumns({"climate": half_up(F.lit(100.0) * base * F.pow(weakest, F.lit(fx.CRITICAL_POWER))).cast("int"),
                       "disease": half_up(F.lit(100.0) * F.col("disease_left")).cast("int"), "worst": worst})
    dead = F.col("no_bloom")
    climate = F.when(dead, 0).otherwise(F.col("climate"))
    return j.withColumns({
        "climate": climate, "disease": F.when(~dead, F.col("disease")),
        "both": F.when(dead, 0).otherwise(F.least("climate", "disease")),
        "label": label(climate), "disease_label": F.when(~dead, disease_label("disease")),
        "limiting": F.when(dead, "season").when(F.col("worst.f") < 0.7, F.col("worst.k")),
    }).drop("worst")


def join_pairs(pairs: DataFrame, varieties: DataFrame, prepared: DataFrame) -> DataFrame:
    """Attach both sides to (variety_id, place_id) pairs by key.

    Both sides are tables that grow, and their arrays make them many times the size Spark reckons from their files; so they are
    merged, not broadcast, and skewed keys are split.  Where both sides have a column (name, country), the variety's is kept."""
    places = prepared.drop(*[c for c in varieties.columns if c != "place_id"])
    return pairs.join(varieties.hint("merge"), "variety_id").join(places.hint("merge"), "place_id")


def score(pairs: DataFrame, varieties: DataFrame, prepared: DataFrame, ref: Column) -> DataFrame:
    """Score every requested pair: six climate factors, climate score and label, limiting factor, disease, picking date."""
    j = join_pairs(pairs, varieties, prepared).withColumn("ref", ref)
    s = _combined(_with_disease(_with_factors(_with_ratios(j))))
    alive = ~F.col("no_bloom") & F.col("harvest_doy").isNotNull()
    return s.withColumns({"harvest": F.when(alive, vi_label("harvest_vi", "southern")), "shift": F.when(alive, F.col("shift"))})


SCORE_COLUMNS = (["variety_id", "place_id"] + [f"f_{k}" for k in fx.FACTORS]
                 + ["climate", "label", "limiting", "disease", "disease_label", "disease_assumed", "both", "harvest", "dafb", "shift"])


# ---- explanations ------------------------------------------------------------------
def factor_rows(scored: DataFrame) -> DataFrame:
    """One row per pair and factor: value, verdict, whether critical, band code and the numbers of the reason."""

    def n0(c: str) -> Column:
        return half_up(c).cast("string")

    codes = {
        "chill": F.when(F.col("tropical"), "no_winter").otherwise(banded("chill_ratio", [(1.15, "plenty"), (1.0, "enough"), (0.85, "borderline"), (0.7, "short"), (None, "too_little")])),
        "hardiness": banded("zone_margin", [(0.3, "safe"), (0, "at_limit"), (-0.5, "occasional_dieback"), (-1.0, "injury_likely"), (None, "far_beyond")]),
        "frost": F.when(F.col("frost_chance") <= 0.05, "escapes").when(F.col("frost_chance") <= 0.15, "uncommon").when(F.col("frost_chance") <= 0.3, "regular").otherwise("serious"),
        "season": F.when(F.col("harvest_doy").isNull(), "unknown").otherwise(banded("f_season", [(0.85, "ripens"), (0.6, "just"), (0.3, "unreliable"), (None, "too_short")])),
        "heat": F.when(F.col("hot32") < 1, "rare").when(F.col("heat_ratio") <= 1, "copes").when(F.col("heat_ratio") <= 2, "more_than_it_likes").otherwise("well_beyond"),
        "water": banded("aridity", [(0.8, "rain_enough"), (0.5, "dry_spells"), (0.25, "irrigate"), (None, "arid")]),
    }
    numbers = {
        "chill": F.concat_ws("/", n0("chill_mean"), n0("chill_p20"), _need("chill_hours", fx.DEFAULT_CHILL_NEED).cast("string")),
        "hardiness": F.concat_ws("/", n0("ext_min_mean"), F.col("zone_label"), _need("hardiness_zone", fx.DEFAULT_ZONE).cast("string")),
        "frost": F.concat_ws("/", half_up(F.col("frost_chance") * (F.col("n_cycles") - 1)).cast("string"), (F.col("n_cycles") - 1).cast("string"), F.col("bloom_label")),
        "season": F.concat_ws("/", F.col("harvest"), F.abs(weeks_shift("shift")).cast("string"), half_up(F.col("ok_years") * 100).cast("string"), F.col("first_freeze")),
        "heat": F.concat_ws("/", n0("hot32"), _need("heat_tolerance", fx.DEFAULT_HEAT).cast("string")),
        "water": F.concat_ws("/", half_up(F.least(F.lit(1.0), F.col("aridity")) * 100).cast("string"), n0("gs_precip")),
    }
    assumed = {"chill": "chill_hours", "hardiness": "hardiness_zone", "frost": "flower_group", "season": "harvest_doy", "heat": "heat_tolerance", "water": "aridity"}
    rows = F.array(*[F.struct(F.lit(k).alias("factor"), F.col(f"f_{k}").alias("f"), verdict(f"f_{k}").alias("verdict"),
                              F.lit(k in fx.CRITICAL).alias("critical"), codes[k].alias("reason"), numbers[k].alias("numbers"),
                              F.col(assumed[k]).isNull().alias("assumed")) for k in fx.FACTORS])
    return scored.where(~F.col("no_bloom")).select("variety_id", "place_id", F.explode(rows).alias("r")).select("variety_id", "place_id", "r.*")


def pressure_word(p: Column | str) -> Column:
    return banded(p, fx.PRESSURE_WORDS)


def disease_driver(d: str) -> Column:
    """What drives a disease at a place: a code and up to two numbers (periods or days a year, wet hours a day)."""
    codes = {
        "scab": ("spring_infections", half_up("scab_events"), half_up("lwd_spring")),
        "canker": ("mild_wet_winter_days", half_up("canker_days"), None),
        "mildew": ("humid_nights", None, None),
        "fire_blight": ("blossom_infections", F.when(F.col("fire_blight_events") < 1, F.round("fire_blight_events", 1)).otherwise(half_up("fire_blight_events")), None),
        "rust": ("rust_and_wet_spring", None, None),
    }
    code, *numbers = codes[d]
    known = F.when(F.col("fire_blight_status") == "unknown", F.lit(f"{code}_status_unknown")).otherwise(code) if d == "fire_blight" else F.lit(code)
    return F.concat_ws(" ", known, *[n.cast("double").cast("string") for n in numbers if n is not None])


def disease_rows(scored: DataFrame) -> DataFrame:
    """One row per pair and disease; `issue_rank` 1..3 marks the worst issues (pressure and susceptibility both matter).

    A pair counts for each issue those that are worse; words and drivers stand with the place, and bands follow once per row."""
    issue = {d: F.coalesce((F.col(f"p_{d}") >= 0.33) & (_need(d, fx.DEFAULT_SUSCEPTIBILITY) >= 3), F.lit(False)) for d in fx.DISEASES}
    order = {d: F.when(issue[d], -F.col(f"loss_{d}")) for d in fx.DISEASES}
    s = scored.where(~F.col("no_bloom")).withColumns({f"o_{d}": order[d] for d in fx.DISEASES})
    rows = []
    for i, d in enumerate(fx.DISEASES):
        mine = F.col(f"o_{d}")
        worse = [(F.col(f"o_{e}") <= mine) if j < i else (F.col(f"o_{e}") < mine) for j, e in enumerate(fx.DISEASES) if e != d]
        rank = reduce(lambda a, b: a + b, [F.when(w, 1).otherwise(0) for w in worse], F.lit(1))
        rows.append(F.struct(F.lit(d).alias("disease"), F.col(f"p_{d}").alias("pressure"), F.col(f"word_{d}").alias("word"), F.col(d).alias("rated"),
                             F.col(f"loss_{d}").alias("loss"), F.col(f"driver_{d}").alias("driver"), F.when(mine.isNotNull(), rank).alias("rank")))
    r = s.select("variety_id", "place_id", F.inline(F.array(*rows)))
    susceptibility = _need("rated", fx.DEFAULT_SUSCEPTIBILITY)
    tone = banded("loss", [(0.4, "bad"), (0.2, "warn"), (0.08, "ok"), (None, "good")])
    return r.select("variety_id", "place_id", "disease", "pressure", "word", susceptibility.alias("susceptibility"), F.col("rated").isNull().alias("assumed"), "loss", tone.alias("tone"),
                    ((F.col("pressure") >= 0.33) & (susceptibility >= 3)).alias("issue"), "driver", F.when(F.col("rank") <= 3, F.col("rank")).alias("issue_rank"))


def flavour_here(scored: DataFrame) -> DataFrame:
    """Tone and reason code of how the place changes the flavour, for varieties with a recorded climate need."""
    return scored.where(~F.col("no_bloom") & F.col("climate_needs").isin("cool", "warm")).select(
        "variety_id", "place_id", flavour_tone()["tone"].alias("tone"), flavour_tone()["code"].alias("code")).where("tone IS NOT NULL")


def flavour_tone(prefix: str = "") -> Column:
    hot32, hottest, need = F.col(prefix + "hot32"), F.col(prefix + "tmax_hot"), F.col("climate_needs")
    hot, cool = (hottest >= 28) | (hot32 >= 10), hottest < 22
    code = (F.when((need == "cool") & hot, F.when(hottest >= 31, "bad:milder").otherwise("warn:milder"))
            .when((need == "cool") & (hottest < 26), "good:suits").when((need == "warm") & cool, "warn:stays_sharp")
            .when((need == "warm") & (hottest >= 26), "good:full_sweetness"))
    return F.struct(F.substring_index(code, ":", 1).alias("tone"), F.substring_index(code, ":", -1).alias("code"))


# ---- ranked views --------------------------------------------------------------------
def rank_key(by: str) -> Column:
    return F.coalesce("disease", "climate") if by == "disease" else F.col(by)


def rank_varieties(scored: DataFrame, by: str = "both", k: int | None = None) -> DataFrame:
    """Rank the varieties of each place by `both`, `climate` or `disease`; ties by climate score, then id.

    With `k`, each task keeps only its best k of a place before the shuffle."""
    w = Window.partitionBy("place_id").orderBy(rank_key(by).desc(), F.desc("climate"), F.asc("variety_id"))
    ranked = scored.withColumn("rank", F.row_number().over(w))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def best_worst_places(scored: DataFrame, best: int = 8, worst: int = 4) -> DataFrame:
    """Best and worst places of each variety by `both`, then climate score."""
    up = Window.partitionBy("variety_id").orderBy(F.desc("both"), F.desc("climate"), F.asc("place_id"))
    down = Window.partitionBy("variety_id").orderBy(F.asc("both"), F.asc("climate"), F.desc("place_id"))
    cols = ["variety_id", "place_id", "climate", "disease", "both"]
    top = scored.select(*cols, F.row_number().over(up).alias("rank")).where(F.col("rank") <= best).withColumn("side", F.lit("best"))
    low = scored.select(*cols, F.row_number().over(down).alias("rank")).where(F.col("rank") <= worst).withColumn("side", F.lit("worst"))
    return top.unionByName(low)


def colour_band(s: Column | str) -> Column:
    return F.coalesce(banded(s, [(70, "green"), (55, "yellow"), (35, "orange"), (None, "red")]), F.lit("grey"))


def mean_score_by_place(scored: DataFrame) -> DataFrame:
    """Rounded mean climate score per place and its colour band."""
    return (scored.groupBy("place_id").agg(half_up(F.avg("climate")).alias("score"), F.count("*").alias("n"))
            .withColumn("band", colour_band("score")))


def selection_summary(scored: DataFrame) -> DataFrame:
    """A selection at each place: mean climate and disease score, how many do not suit, how many would be sick."""
    sick = (F.col("climate") >= 35) & (F.col("disease") < 40)
    return scored.groupBy("place_id").agg(
        F.count("*").alias("n"), half_up(F.avg("climate")).alias("mean_climate"), half_up(F.avg(F.coalesce("disease", F.lit(0)))).alias("mean_disease"),
        F.count(F.when(F.col("climate") < 35, 1)).alias("unsuited"), F.count(F.when(sick, 1)).alias("sick"))


def site_profile(prepared: DataFrame) -> DataFrame:
    """Banded summary rows (title, tone, value, band) of each place."""

    def row(title: str, tone: Column, value: Column, band: Column, keep: Column = F.lit(True)) -> Column:
        return F.when(keep, F.struct(F.lit(title).alias("title"), tone.alias("tone"), value.cast("double").alias("value"), band.alias("band")))

    def up(c: str, bounds: tuple) -> Column:
        return banded(c, list(zip(bounds + (None,), ("good", "ok", "warn", "bad"))))

    def down(c: Column, bounds: tuple, strict: bool = True) -> Column:
        out = None
        for b, word in zip(bounds, ("good", "ok", "warn")):
            hit = c < b if strict else c <= b
            out = F.when(hit, word) if out is None else out.when(hit, word)
        return out.otherwise("bad")

    c, p3, ar = F.col("chill_mean"), F.col("frost_p")[2], F.col("aridity")
    bloom, winter = ~F.col("no_bloom"), ~F.col("tropical")
    watch = reduce(lambda a, b: a + b, [F.when(F.col(f"p_{d}") >= 0.33, 1).otherwise(0) for d in fx.DISEASES])
    rows = F.array_compact(F.array(
        row("Winter", F.lit("bad"), c, F.lit("no_winter"), F.col("tropical")),
        row("Winter chill", up("chill_mean", (1200, 800, 400)), c, banded(c, [(1800, "all"), (1000, "most"), (600, "medium"), (None, "low_chill_only")]), winter),
        row("Winter cold", up("zone_value", (6, 4.5, 3.5)), F.col("ext_min_mean"), F.col("zone_label"), winter),
        row("Blossom & frost", down(p3, (0.1, 0.3, 0.5), strict=False), p3, F.when(p3 < 0.05, "rare").otherwise("risk"), bloom),
        row("Growing season", up("gend_median", (1700, 1300, 900)), F.col("gend_median"), banded("gend_median", [(1800, "late"), (1400, "late_mid"), (1000, "mid"), (None, "early")]), bloom),
        row("Frost-free season", up("frost_free_days", (200, 150, 110)), F.col("frost_free_days"), F.when(F.col("snow_days") >= 1, "snow").otherwise("snow_rare"), bloom & F.col("frost_free_days").isNotNull()),
        row("Summer heat", down(F.col("hot32"), (3, 12, 30)), F.col("tmax_hot"), F.when(F.col("hot32") < 1, "rare").otherwise("days"), bloom),
        row("Humidity & leaf wetness", down(F.col("rh_gs"), (60, 72, 80)), F.col("rh_gs"), F.when(F.col("humidity_estimated"), "estimated").otherwise("measured"), bloom),
        row("Disease pressure", F.when(watch == 0, "good").when(watch <= 1, "ok").otherwise("warn"), F.col("pann"), watch.cast("string"), bloom),
        row("Water", up("aridity", (0.8, 0.5, 0.25)), ar, banded(ar, [(0.8, "rain"), (0.5, "dry_spells"), (0.25, "irrigate"), (None, "arid")]), bloom),
        row("Spring", F.lit("bad"), F.lit(None), F.lit("no_bloom"), F.col("no_bloom")),
    ))
    return prepared.select("place_id", F.posexplode(rows).alias("pos", "r")).select("place_id", "pos", "r.*")
