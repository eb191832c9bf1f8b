"""Filters, sorts, pages and small aggregated views over the variety table."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graftline.functions.calendar import season_key
from graftline.functions.codes import chill_class, country_name
from graftline.functions.ordered import global_row_number

FAVOURITES_MAX = 24


def search_key() -> Column:
    """Lower-case text a variety is searched by: name, other names and place."""
    return F.lower(F.concat_ws(" ", F.col("name"), F.concat_ws(" ", F.coalesce(F.col("aka"), F.array().cast("array<string>"))), F.coalesce("place", F.lit(""))))


def explore(df: DataFrame, text: str | None = None, uses: list[str] = (), seasons: list[str] = (), tags: list[str] = (), country: str | None = None,
            listed: bool = False, bred: bool = False, self_fertile: bool = False, no_triploid: bool = False, scab_resistant: bool = False,
            canker_resistant: bool = False, chill: list[str] = (), hardy: bool = False) -> DataFrame:
    """Faceted filter; an unset facet filters nothing.  Null never satisfies a facet that needs a value."""
    conds = []
    if text and text.strip():
        conds.append(F.contains(search_key(), F.lit(text.strip().lower())))
    if uses:
        conds.append(F.arrays_overlap("uses", F.array(*map(F.lit, uses))))
    if seasons:
        conds.append(season_key("harvest_doy").isin(*seasons))
    if tags:
        conds.append(F.size(F.array_except(F.array(*map(F.lit, tags)), "tags")) == 0)
    if country:
        conds.append(F.col("country") == country)
    if listed:
        conds.append(F.col("listed"))
    if bred:
        conds.append(F.col("bred"))
    if self_fertile:
        conds.append(F.col("self_fertile") == "yes")
    if no_triploid:
        conds.append(~F.col("ploidy").eqNullSafe(F.lit("triploid")))
    if scab_resistant:
        conds.append(F.col("scab") <= 2)
    if canker_resistant:
        conds.append(F.col("canker") <= 2)
    if chill:
        conds.append(chill_class("chill_hours").isin(*chill))
    if hardy:
        conds.append(F.col("hardiness_zone") <= 4)
    for c in conds:
        df = df.where(c)
    return df


SORTS = {
    "name": lambda: F.lower("name").asc(),
    "season": lambda: F.coalesce("harvest_doy", F.lit(999)).asc(),
    "sweet": lambda: F.coalesce("sweet", F.lit(0)).desc(),
    "acid": lambda: F.coalesce("acid", F.lit(0)).desc(),
    "aroma": lambda: F.coalesce("aroma", F.lit(0)).desc(),
    "old": lambda: F.coalesce("year", F.lit(9999)).asc(),
    "hardy": lambda: F.coalesce("hardiness_zone", F.lit(99)).asc(),
    "lowchill": lambda: F.coalesce("chill_hours", F.lit(9999)).asc(),
}


def sort_keys(key: str) -> list[Column]:
    """The chosen order, then name and id so that ties are settled."""
    return [SORTS[key](), F.lower("name").asc(), F.asc("variety_id")]


def page(df: DataFrame, order: list[Column], number: int, size: int = 60) -> DataFrame:
    """One page of an ordered list: each task keeps its best (number + 1) * size rows."""
    return df.orderBy(*order).offset(number * size).limit(size)


KINDS = {
    "heirloom": lambda: F.col("year") < 1950, "modern": lambda: F.col("year") >= 1950, "russet": lambda: F.col("russet") >= 2,
    "redflesh": lambda: F.col("flesh_colour") == "red", "tinged": lambda: F.col("flesh_colour").isNotNull(),
}


def kind(df: DataFrame, name: str) -> DataFrame:
    return df.where(KINDS[name]())


def every_nth(df: DataFrame, id_column: str, n: int = 6) -> DataFrame:
    """Every n-th row by id, starting with the first: the deterministic sample behind the map overview."""
    return global_row_number(df, [F.asc(id_column)]).where((F.col("row") - 1) % n == 0).drop("row")


def lookup(df: DataFrame, text: str, exclude: DataFrame, n: int = 7) -> DataFrame:
    """First n varieties (by name) whose search text contains the query and that are not in a selection; two letters at least."""
    q = text.strip().lower()
    hits = df.where(F.contains(search_key(), F.lit(q)) & F.lit(len(q) >= 2)).join(exclude.select("variety_id"), "variety_id", "left_anti")
    return hits.orderBy(F.lower("name"), "variety_id").limit(n)


def countries(df: DataFrame) -> DataFrame:
    """Distinct countries of origin with their names."""
    return df.where("country IS NOT NULL").select("country").distinct().select("country", country_name("country").alias("country_name"))


def quadrants(measured: DataFrame) -> DataFrame:
    """Sweet/sharp quadrant of varieties with both percentiles."""
    sweet, sharp = F.col("pct_ssc") >= 50, F.col("pct_ta") >= 50
    q = F.when(sweet & sharp, "Sweet & sharp").when(sharp, "Sharp").when(sweet, "Sweet & mild").otherwise("Mild")
    return measured.where("pct_ssc IS NOT NULL AND pct_ta IS NOT NULL").withColumn("quadrant", q)


def favourites(picks: DataFrame, varieties: DataFrame, limit: int = FAVOURITES_MAX) -> DataFrame:
    """Each selection's first 24 known varieties in the order added, with position; more cannot be kept.

    `picks`: selection_id, variety_id, added (one row per pair)."""
    known = picks.join(varieties.select("variety_id"), "variety_id", "left_semi")
    w = Window.partitionBy("selection_id").orderBy("added", "variety_id")
    return known.select("selection_id", "variety_id", F.row_number().over(w).alias("position")).where(F.col("position") <= limit)


COMPARED = ["harvest_doy", "storage_weeks", "sweet", "acid", "aroma", "crisp", "flower_group", "self_fertile", "ploidy", "vigor", "bearing",
            "chill_hours", "hardiness_zone", "heat_tolerance", "scab", "canker", "mildew", "fire_blight"]


def compare(favs: DataFrame, varieties: DataFrame, attributes: list[str] = COMPARED) -> DataFrame:
    """Side by side: one row per selection, attribute and position with the value as text."""
    v = favs.join(varieties.select("variety_id", "name", *[F.col(a).cast("string").alias(a) for a in attributes]), "variety_id")
    return v.unpivot(["selection_id", "position", "variety_id", "name"], attributes, "attribute", "value")


def by_flower_group(favs: DataFrame, varieties: DataFrame) -> DataFrame:
    """A selection's varieties by flowering group ('?' where unknown); at most 24 names a selection."""
    j = favs.join(varieties.select("variety_id", "name", "flower_group"), "variety_id")
    names = F.transform(F.array_sort(F.collect_list(F.struct("position", "name"))), lambda s: s["name"])
    return j.groupBy("selection_id", F.coalesce(F.col("flower_group").cast("string"), F.lit("?")).alias("flower_group")).agg(F.count("*").alias("n"), names.alias("names"))


def known_sets(sets: DataFrame, varieties: DataFrame, at_least: int = 2) -> DataFrame:
    """Named sets with at least two known members, and how many of their members are known."""
    known = sets.join(varieties.select("variety_id"), "variety_id", "left_semi")
    return known.groupBy("set_name").agg(F.count("*").alias("known")).where(F.col("known") >= at_least)
