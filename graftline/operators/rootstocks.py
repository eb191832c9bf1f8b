"""Rootstock fit at a place, advice by tree size, the questionnaire and pairing advice."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graftline.functions.ordered import global_row_number, row_numbers_within
from graftline import fixed_values as fx
from graftline.functions.codes import mapped, size_ordinal
from graftline.functions.numeric import clamp, half_up


def _sum(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def _codes(pairs: list[tuple[Column, str]]) -> Column:
    return F.array_compact(F.array(*[F.when(cond, F.lit(code)) for cond, code in pairs]))


def rootstock_fit(pairs: DataFrame, rootstocks: DataFrame, prepared: DataFrame) -> DataFrame:
    """Fit 0-100 of each requested (rootstock_id, place_id), with reasons for and against.

    `prepared` places carry zone_value, p_fire_blight, pann, canker_days, aridity, tmax_hot and ext_min_mean."""
    place = prepared.select("place_id", "zone_value", "p_fire_blight", "aridity", "tmax_hot", "ext_min_mean", "no_bloom",
                            (clamp((F.col("pann") - 700.0) / 600.0, 0.0, 1.0) * 0.6 + clamp((F.col("canker_days") - 60.0) / 60.0, 0.0, 1.0) * 0.4).alias("wet"),
                            clamp((F.lit(0.9) - F.col("aridity")) / 0.6, 0.0, 1.0).alias("dry"),
                            F.when((F.col("tmax_hot") >= 21) & (F.col("ext_min_mean") > -26), 0.6).otherwise(0.2).alias("aphid"))
    j = pairs.join(rootstocks, "rootstock_id").join(place, "place_id")
    zone = F.coalesce("hardiness_zone", F.lit(fx.DEFAULT_ZONE))
    j = j.withColumns({"zm": F.col("zone_value") - zone, "rz": zone})
    c = F.col
    blight, wet, dry = c("p_fire_blight") >= 0.3, c("wet") >= 0.25, c("dry") >= 0.2
    cold, hardy = c("zm") < 0, (c("zm") >= 0) & (c("zone_value") < 5.5) & (c("rz") <= 4)
    fb_bad, fb_good = blight & (c("fire_blight") >= 4), blight & (c("fire_blight") <= 2)
    rot_bad, rot_good, wet_ok = wet & (c("collar_rot") >= 4), wet & (c("collar_rot") <= 2), wet & (c("wet_soil") >= 4)
    dry_ok, dry_bad = dry & (c("drought") >= 4), dry & (c("drought") <= 2)
    ap_bad, ap_good, ap = c("woolly_aphid") >= 4, c("woolly_aphid") <= 2, c("aphid") > 0.4
    add = lambda cond, x: F.when(cond, x).otherwise(0.0)                        # noqa: E731
    s = _sum([F.lit(80.0), add(cold, -F.least(F.lit(65.0), -c("zm") * 45.0)), add(hardy, F.lit(6.0)),
              add(fb_bad, -c("p_fire_blight") * (c("fire_blight") - 2) * 12.0), add(fb_good, c("p_fire_blight") * 8.0),
              add(rot_bad, -c("wet") * (c("collar_rot") - 2) * 10.0), add(rot_good, c("wet") * 6.0), add(wet_ok, c("wet") * 4.0),
              add(dry_ok, c("dry") * 8.0), add(dry_bad, -c("dry") * 10.0),
              add(ap_bad, -c("aphid") * (c("woolly_aphid") - 2) * 5.0), add(ap_good, c("aphid") * 5.0)])
    why = _codes([(hardy, "hardy_roots"), (fb_good, "resists_blight"), (rot_good, "resists_collar_rot"), (wet_ok, "tolerates_wet"), (dry_ok, "copes_with_drought"), (ap_good & ap, "resists_aphid")])
    warn = _codes([(cold, "too_cold"), (fb_bad, "blight_prone"), (rot_bad, "collar_rot_prone"), (dry_bad, "needs_irrigation"), (ap_bad & ap, "aphid_prone")])
    return j.select("rootstock_id", "place_id", "size_class", "name", "no_bloom", clamp(half_up(s), 0, 100).cast("int").alias("fit"), why.alias("why"), warn.alias("warn"))


def rootstock_advice(fit: DataFrame, k: int = 3) -> DataFrame:
    """The k best-fitting rootstocks per place and tree size; nothing for places without bloom."""
    w = Window.partitionBy("place_id", "bucket").orderBy(F.desc("fit"), "name", "rootstock_id")
    return (fit.where(~F.col("no_bloom")).withColumn("bucket", mapped("size_class", fx.SIZE_BUCKETS)).withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= k))


def choose_rootstock(rootstocks: DataFrame, size: str = "semi-dwarf", soil: str = "normal", blight: bool = False, cold: bool = False,
                     wind: bool = False, early: bool = False, grass: bool = False) -> DataFrame:
    """Questionnaire score 0-100 of every rootstock with reasons."""
    c = F.col
    terms, why, warn = [F.lit(70.0)], [], []

    def rule(good: Column, bad: Column, plus: float, minus: float, yes: str, no: str) -> None:
        terms.append(F.when(good, plus).when(bad, -minus).otherwise(0.0))
        why.append((good, yes))
        warn.append((bad, no))

    if size != "any":
        off = F.abs(size_ordinal("size_class") - fx.SIZE_CLASSES.index(size))
        terms.append(off * -22.0)
        why.append((off == 0, "right_size"))
    if soil == "wet":
        rule(c("collar_rot") <= 2, c("collar_rot") >= 4, 8, 18, "resists_collar_rot", "collar_rot_prone")
        rule(c("wet_soil") >= 4, c("wet_soil") <= 2, 8, 8, "tolerates_wet", "dislikes_wet")
    if soil == "dry":
        rule(c("drought") >= 4, c("drought") <= 2, 12, 14, "drought_tolerant", "drought_sensitive")
    if soil == "poor" or grass:
        rule(c("poor_soil") >= 4, c("poor_soil") <= 2, 12, 14, "copes_with_poor", "needs_fertile")
    if blight:
        rule(c("fire_blight") <= 2, c("fire_blight") >= 4, 14, 22, "resists_blight", "blight_prone")
    if cold:
        rule(c("hardiness_zone") <= 4, c("hardiness_zone") >= 6, 12, 22, "very_hardy", "tender_roots")
        terms.append(F.when(c("hardiness_zone") == 5, -6.0).otherwise(0.0))
    if wind:
        rule(c("anchorage") >= 4, c("anchorage") <= 2, 10, 12, "well_anchored", "needs_stake")
    if early:
        rule(c("precocity") >= 4, c("precocity") <= 2, 10, 10, "crops_early", "slow_to_crop")
    terms.append(F.coalesce((c("yield_efficiency") - 3) * 2.0, F.lit(0.0)))
    avail = c("uk_availability")
    terms.append(F.when(avail == "common", 4.0).when(avail == "specialist", 1.0).when(avail.isin("rare", "not-available"), -3.0).otherwise(0.0))
    terms.append(F.when(c("conf") == "high", 3.0).when(c("conf") == "low", -6.0).otherwise(0.0))
    reasons = _codes(why) if why else F.array().cast("array<string>")
    reasons = F.when((F.size(reasons) == 0) & (avail == "common"), F.array(F.lit("widely_available"))).otherwise(reasons)
    warnings = _codes(warn) if warn else F.array().cast("array<string>")
    return rootstocks.select("rootstock_id", "name", "size_class", clamp(half_up(_sum(terms)), 0, 100).cast("int").alias("fit"), reasons.alias("why"), warnings.alias("warn"))


TABLE_COLUMNS = {
    "name": lambda: F.lower("name"), "size": lambda: F.nullif(size_ordinal("size_class"), F.lit(9)), "height": lambda: (F.col("height_m")[0] + F.col("height_m")[1]) / 2,
    **{k: (lambda v=v: F.col(v)) for k, v in {"vigor": "vigor", "prec": "precocity", "yield": "yield_efficiency", "anch": "anchorage", "fb": "fire_blight", "cr": "collar_rot",
                                            "wa": "woolly_aphid", "cold": "hardiness_zone", "dr": "drought", "wet": "wet_soil"}.items()},
}


def natural_name(c: str) -> Column:
    """Name key in which embedded numbers sort by value ('M.9' before 'M.26')."""
    return F.struct(F.lower(F.regexp_extract(c, r"^(\D*)", 1)), F.regexp_extract(c, r"(\d+)", 1).try_cast("int"), F.lower(F.col(c)))


def table_order(sort: str = "size", descending: bool = False) -> list[Column]:
    """Sort columns of the comparison table: the chosen column, nulls always last, then the name; both follow the direction."""
    key = natural_name("name") if sort == "name" else TABLE_COLUMNS[sort]()
    tie = natural_name("name")
    return [key.desc_nulls_last(), tie.desc()] if descending else [key.asc_nulls_last(), tie.asc()]


def rootstock_table(rootstocks: DataFrame, sort: str = "size", descending: bool = False, size: str | None = None) -> DataFrame:
    """Every rootstock with its position in the comparison table."""
    df = rootstocks if size is None else rootstocks.where(F.col("size_class") == size)
    return global_row_number(df, [*table_order(sort, descending), F.asc("rootstock_id")], "position")


def rootstock_positions(rootstocks: DataFrame) -> DataFrame:
    """(sort, rootstock_id, position) of every rootstock by every column of the comparison table, up and down.

    All columns of one direction are ordered in one pass, each name read once."""
    keys = F.array(*[F.struct(F.lit(k).alias("column"), (F.lit(None) if k == "name" else c()).cast("double").alias("key")) for k, c in TABLE_COLUMNS.items()])
    rows = rootstocks.select("rootstock_id", natural_name("name").alias("natural"), F.explode(keys).alias("k")).select("rootstock_id", "natural", "k.*")
    orders = {"asc": [F.asc_nulls_last("key"), F.asc("natural")], "desc": [F.desc_nulls_last("key"), F.desc("natural")]}
    up, down = (row_numbers_within(rows, "column", [*o, F.asc("rootstock_id")], "position").select(F.concat("column", F.lit(f" {d}")).alias("sort"), "rootstock_id", "position")
                for d, o in orders.items())
    return up.unionByName(down)


def pairing_advice(varieties: DataFrame) -> DataFrame:
    """Advice codes of what a variety needs from its rootstock, one row per code."""
    c = F.col
    codes = F.array_compact(F.array(
        F.when(c("vigor") <= 2, "weak_grower").when(c("vigor") >= 4, "strong_grower").when(c("vigor").isNotNull(), "average_vigour"),
        F.when(c("bearing").isin("tip", "part-tip"), "tip_bearer"), F.when(c("ploidy") == "triploid", "triploid"), F.when(c("fire_blight") >= 4, "blight_prone")))
    return varieties.select("variety_id", F.posexplode(codes).alias("pos", "advice"))
