"""How a variety changes between two climates: ripening, sugar, acid, taste, aroma, colour, sunburn, keeping, skin."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graftline import fixed_values as fx
from graftline.functions.calendar import vi_label
from graftline.functions.numeric import half_up
from graftline.operators.scoring import flavour_tone, harvest_vi, join_pairs, or_infinite, thermal_need, window_mean

WINDOW_DAYS = 42
TYPICAL_HARVEST_VI = 255


def ripening(pairs: DataFrame, varieties: DataFrame, prepared: DataFrame, ref: Column) -> DataFrame:
    """When each requested variety ripens at each requested place, whether it ripens at all, by what margin and how often,
    with the weather of the six weeks before picking (a typical harvest month where no date is recorded)."""
    j = join_pairs(pairs, varieties, prepared).where(~F.col("no_bloom")).withColumn("ref", ref)
    vi, days = harvest_vi()
    j = j.withColumns({"need": thermal_need("harvest_doy"), "pick_vi": vi, "dafb": half_up(days)})
    j = j.withColumn("ripens", F.col("gend_median") >= F.col("need"))
    j = j.withColumns({
        "ripe_vi": F.when(F.col("ripens"), F.least("pick_vi", "end_vi")).when(F.col("harvest_doy").isNotNull(), F.col("end_vi")),
        "margin": or_infinite(F.col("gend_median"), F.col("need")),
        "ok_years": F.when(F.col("need").isNotNull(), F.size(F.filter("gend_per", lambda g: g >= F.col("need"))) / F.size("gend_per"))})
    start = F.coalesce("ripe_vi", F.lit(TYPICAL_HARVEST_VI).cast("double")) - WINDOW_DAYS
    j = j.withColumns({"ripe_label": F.when(F.col("ripe_vi").isNotNull(), vi_label("ripe_vi", "southern")),
                       "w_tmax": window_mean("win_tmax", start), "w_tmin": window_mean("win_tmin", start)})
    return j.withColumn("w_tmean", (F.col("w_tmax") + F.col("w_tmin")) / 2)


RIPENING = ["variety_id", "place_id", "ripens", "ripe_vi", "ripe_label", "margin", "ok_years", "dafb", "w_tmax", "w_tmin", "w_tmean"]


def climate_changes(here: DataFrame, home: DataFrame) -> DataFrame:
    """One row per change item (key, direction, tone) of each pair against the variety's home.

    `here` and `home` are `ripening` tables; `home` has one row per variety."""
    base = home.select("variety_id", F.col("ripe_vi").alias("h_ripe_vi"), F.col("w_tmax").alias("h_tmax"), F.col("w_tmin").alias("h_tmin"),
                       F.col("w_tmean").alias("h_tmean"), F.col("lwd_spring").alias("h_lwd"), F.lit(True).alias("has_home"))
    j = here.join(base, "variety_id", "left").withColumn("has_home", F.coalesce("has_home", F.lit(False)))
    j = j.withColumns({
        "unripe": F.coalesce(~F.col("ripens"), F.lit(False)),
        "dt": F.when(F.col("has_home"), F.col("w_tmean") - F.col("h_tmean")).otherwise(0.0),
        "dn": F.when(F.col("has_home"), F.col("w_tmin") - F.col("h_tmin")).otherwise(0.0),
        "cook": F.array_contains("uses", "culinary") & ~F.array_contains("uses", "dessert"),
        "cider": F.array_contains("uses", "cider") & ~F.array_contains("uses", "dessert"),
        "cools": F.coalesce("colour_cool_nights", F.lit(False)), "heat_tol": F.coalesce("heat_tolerance", F.lit(fx.DEFAULT_HEAT)),
        "wk": half_up(F.col("ripe_vi") - F.col("h_ripe_vi"))})
    fl = flavour_tone()
    j = j.withColumns({"warmer": ~F.col("unripe") & (F.col("dt") >= 1.5), "cooler": F.col("unripe") | (F.col("dt") <= -1.5),
                       "dacid": (F.col("dt") + F.col("dn")) / 2, "fl_tone": fl["tone"],
                       "red": F.coalesce((F.col("blush_cover") >= 25) & F.col("blush").isin(*fx.RED_BLUSH, "pink"), F.lit(False)) | F.col("cools")})
    H, U, dt, c = F.col("has_home"), F.col("unripe"), F.col("dt"), F.col

    def item(key: str, spec: Column) -> Column:
        """spec is 'dir:tone' (dir may be '-')."""
        return F.when(spec.isNotNull(), F.struct(F.lit(key).alias("item"), F.nullif(F.substring_index(spec, ":", 1), F.lit("-")).alias("dir"),
                                                 F.substring_index(spec, ":", -1).alias("tone")))

    move = F.when(~H | c("wk").isNull(), "-").when(c("wk") < -6, "down").when(c("wk") > 6, "up").otherwise("same")
    ripen = (F.when(c("ripe_vi").isNull(), "-:ok").when(U, "down:bad")
             .otherwise(F.concat(move, F.when(c("margin") < 1.1, ":warn").otherwise(":good"))))
    sugar = F.when(U, "down:bad").when(H, F.when(dt >= 3, "up:ok").when(dt >= 1.5, "up:ok").when(dt <= -3, "down:warn").when(dt <= -1.5, "down:ok").otherwise("same:good"))
    da = c("dacid")
    acid = F.when(H, F.when(U | (da <= -3), "up:warn").when(da <= -1.5, "up:ok").when(da >= 3, "down:warn").when(da >= 1.5, "down:ok").otherwise("same:good"))
    a = c("acid")
    taste = F.when(H, F.when(c("cider") & (c("warmer") | c("cooler")), "-:ok").when(c("cook") & c("warmer"), "-:warn").when(c("cook") & c("cooler"), "-:good")
                   .when(c("warmer") & (a >= 4), "-:good").when(c("warmer") & (a <= 2), "-:warn").when(c("warmer"), "-:ok")
                   .when(c("cooler") & (a >= 4), "-:warn").when(c("cooler") & (a <= 2), "-:good").when(c("cooler"), "-:ok"))
    aroma = (F.when(c("fl_tone").isNotNull(), F.concat(F.when(c("fl_tone") == "good", "same:").otherwise("down:"), c("fl_tone")))
             .when(U & (c("aroma") >= 3), "down:warn").when((c("w_tmax") >= 29) & (c("aroma") >= 4), "down:warn"))
    colour = F.when(c("red") & U, "down:warn").when(c("red"), F.when(c("w_tmin") >= 16, F.when(c("cools"), "down:bad").otherwise("down:warn"))
                                                    .when((c("w_tmin") >= 13) & c("cools"), "down:warn")
                                                    .when(H & (c("w_tmin") <= c("h_tmin") - 3), "up:good").when(c("w_tmin") < 11, "same:good"))
    hot35 = F.coalesce("hot35", F.lit(0.0))
    sunburn = F.when(hot35 >= 2, F.when((hot35 >= 10) | ((hot35 >= 5) & (c("heat_tol") <= 2)), "-:bad").otherwise("-:warn"))
    keep = F.when(U, "-:warn").when(H & (dt >= 3), "down:warn").when(H & (dt <= -2), "up:good")
    pit = F.when((F.coalesce("bitter_pit", F.lit(0)) >= 3) & ((c("aridity") < 0.5) | (c("hot32") >= 10)), "-:warn")
    dl = c("lwd_spring") - c("h_lwd")
    skin = F.when(H & (c("russet") <= 2), F.when(dl >= 3, "up:ok").when(dl <= -3, "down:good"))
    specs = [("ripen", ripen), ("sugar", sugar), ("acid", acid), ("taste", taste), ("aroma", aroma), ("colour", colour), ("sunburn", sunburn),
             ("keep", keep), ("pit", pit), ("russet", skin)]
    j = j.select("variety_id", "place_id", *[s.alias(f"x_{k}") for k, s in specs])
    items = F.array_compact(F.array(*[item(k, F.col(f"x_{k}")) for k, _ in specs]))
    return j.select("variety_id", "place_id", F.explode(items).alias("i")).select("variety_id", "place_id", "i.*")


def _place_words(text: Column) -> Column:
    """Distinct words of four letters or more."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([a-zà-ÿ']{4,})"), 1))


def place_name_words(regions: DataFrame) -> DataFrame:
    """(place_id, country, words): the distinct words (no generic ones) of a region's name and id."""
    text = F.concat_ws(" ", F.col("name"), F.regexp_replace(F.col("place_id").cast("string"), "-", " "))
    return regions.select("place_id", F.col("country").alias("r_country"), F.filter(_place_words(text), lambda w: ~w.isin(*fx.GENERIC_PLACE_WORDS)).alias("r_words"))


def home_place(varieties: DataFrame, regions: DataFrame, grown: DataFrame, scored: DataFrame, ref_id, national_home: str = "GB") -> DataFrame:
    """Home of each variety: origin named in the region (4) + same country (2) + grown there (1), at least 2; ties by climate
    score.  Varieties without one, and those of the reference country without a named origin, get the reference place.

    `regions` holds usable places only (place_id, name, country); `scored` has (variety_id, place_id, climate)."""
    # candidates come from the scored pairs, so no country or word is ever paired with itself
    origin = varieties.select("variety_id", "country", _place_words(F.coalesce("place", F.lit(""))).alias("words"))
    pairs = scored.select("variety_id", "place_id", "climate").join(origin, "variety_id").join(place_name_words(regions), "place_id")
    named = F.when((F.col("country") == F.col("r_country")) & F.arrays_overlap("words", "r_words"), 4)
    pairs = pairs.withColumn("named", named).drop("words", "r_words")
    pairs = pairs.join(grown.select("variety_id", "place_id").distinct().withColumn("grown", F.lit(1)), ["variety_id", "place_id"], "left")
    same = F.when(F.col("country") == F.col("r_country"), 2).otherwise(0)
    pairs = pairs.withColumn("k", F.coalesce("named", F.lit(0)) + same + F.coalesce("grown", F.lit(0))).where("k >= 2")
    w = Window.partitionBy("variety_id").orderBy(F.desc("k"), F.desc("climate"), F.asc("place_id"))
    best = pairs.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("variety_id", F.col("place_id").alias("best_id"), "k")
    j = varieties.select("variety_id", "country").join(best, "variety_id", "left")
    usable = F.col("best_id").isNotNull() & ~((F.coalesce("country", F.lit("")) == national_home) & (F.col("k") < 4))
    why = F.when(usable, F.when(F.col("k") >= 4, "origin").when(F.col("k") >= 3, "grown_in_country").otherwise("same_country")).otherwise("reference")
    return j.select("variety_id", F.when(usable, F.col("best_id")).otherwise(F.lit(ref_id)).alias("home_id"), why.alias("why"))
