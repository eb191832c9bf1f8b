"""Building the atlas: patches, merges, enrichment, region assembly, profiles, the build report."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graftline.functions.calendar import parse_harvest, parse_harvest_range
from graftline.functions.names import build_key
from graftline.operators.matching import link_index, link_names


def _merged(schema: StructType, base: Column, new: Column, keys: Column, patch: Column, path: str) -> list[Column]:
    """Each field of a struct after a patch: untouched unless the patch names it; objects merge, everything else replaces."""
    out = []
    for f in schema.fields:
        old, val = base[f.name], new[f.name]
        if isinstance(f.dataType, StructType):
            sub = f"{path}.{f.name}"
            inner = F.struct(*_merged(f.dataType, old, val, F.coalesce(F.json_object_keys(F.get_json_object(patch, sub)), F.array().cast("array<string>")), patch, sub))
            changed = F.when(val.isNull(), F.lit(None).cast(f.dataType)).when(old.isNull(), val).otherwise(inner)
        else:
            changed = val
        out.append(F.when(F.array_contains(keys, f.name), changed).otherwise(old).alias(f.name))
    return out


def apply_patch(records: DataFrame, patches: DataFrame) -> DataFrame:
    """Deep-merge patches (id, patch JSON; a null patch deletes the record) into records.

    A key the patch does not name keeps its value; a key set to null becomes null."""
    schema = records.schema
    p = patches.select("id", F.col("patch").alias("_patch"), F.lit(True).alias("_hit"))
    j = records.join(p, "id", "left").where("_hit IS NULL OR _patch IS NOT NULL")
    j = j.withColumns({"_new": F.from_json("_patch", schema), "_keys": F.coalesce(F.json_object_keys("_patch"), F.array().cast("array<string>"))})
    fields = StructType([f for f in schema.fields if f.name != "id"])
    whole = j.withColumn("_old", F.struct(*[F.col(f.name) for f in fields.fields]))
    return whole.select("id", *_merged(fields, F.col("_old"), F.col("_new"), F.col("_keys"), F.col("_patch"), "$")).select(*schema.names)


def patches_not_found(records: DataFrame, patches: DataFrame) -> DataFrame:
    return patches.select("id").join(records.select("id"), "id", "left_anti")


def merge_new(base: DataFrame, new: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(base plus the new rows whose key it lacks, the new rows that were skipped)."""
    have = base.select(*keys)
    return base.unionByName(new.join(have, keys, "left_anti")), new.join(have, keys, "left_semi")


def enrich_varieties(varieties: DataFrame, catalogue: DataFrame, base_url: str) -> DataFrame:
    """Harvest day and range from the phrase, and the catalogue listing with its link."""
    rng = parse_harvest_range("harvest")
    c = catalogue.select("id", "listed", "slug", "category")
    j = varieties.join(c, "id", "left").withColumns({"harvest_doy": parse_harvest("harvest"), "harvest_from": rng["lo"], "harvest_to": rng["hi"], "listed": F.coalesce("listed", F.lit(False))})
    return j.withColumn("url", F.when(F.col("listed"), F.concat(F.lit(base_url), F.col("category"), F.lit("/"), F.col("slug"))))


def build_regions(seed: DataFrame, notes: DataFrame, varieties: DataFrame) -> DataFrame:
    """Seeded places with their notes and the number of varieties their local names link to."""
    linked = link_names(notes.select("place_id", "local_names"), varieties).groupBy("place_id").agg(F.count("*").alias("linked"))
    j = seed.join(notes, "place_id", "left").join(linked, "place_id", "left")
    return j.withColumns({"linked": F.coalesce("linked", F.lit(0)), "has_notes": F.col("summary").isNotNull()})


def region_warnings(seed: DataFrame, notes: DataFrame) -> DataFrame:
    """Places without notes, and notes without a place."""
    s, n = seed.select("place_id"), notes.select("place_id")
    return (s.join(n, "place_id", "left_anti").withColumn("problem", F.lit("no notes yet")).unionByName(n.join(s, "place_id", "left_anti").withColumn("problem", F.lit("notes without a place"))))


def profile_sources(profiles: DataFrame) -> DataFrame:
    """Ordered distinct sources of a profile: of its facts, of its items, then its own list."""
    of_items = F.flatten(F.transform("sections", lambda s: F.transform(s["items"], lambda i: i["source"])))
    every = F.concat(F.transform("facts", lambda f: f["source"]), of_items, F.col("sources"))
    return profiles.select("id", F.posexplode(F.array_distinct(F.filter(every, lambda u: u.isNotNull() & (u != "")))).alias("pos", "source"))


def profile_links(profiles: DataFrame, varieties: DataFrame) -> DataFrame:
    """Profile items that name a known variety."""
    items = profiles.select("id", F.explode(F.flatten(F.transform("sections", lambda s: s["items"]))).alias("i")).where("i.name IS NOT NULL").select("id", "i.name", build_key("i.name").alias("key"))
    return items.join(link_index(varieties), "key").select("id", "name", "variety_id")


def build_report(varieties: DataFrame) -> DataFrame:
    """Counts of the build as rows (measure, value, n): records, confidence, unrecorded fields."""
    total = varieties.agg(F.lit("varieties").alias("measure"), F.lit("all").alias("value"), F.count("*").alias("n"))
    listed = varieties.agg(F.lit("varieties").alias("measure"), F.lit("listed").alias("value"), F.count(F.when(F.col("listed"), 1)).alias("n"))
    conf = varieties.groupBy(F.lit("confidence").alias("measure"), F.col("conf").alias("value")).agg(F.count("*").alias("n"))
    fields = ["chill_hours", "hardiness_zone", "heat_tolerance", "flower_group", "harvest_doy"]
    nulls = varieties.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in fields]).unpivot([], fields, "value", "n").select(F.lit("null").alias("measure"), "value", "n")
    return total.unionByName(listed).unionByName(conf).unionByName(nulls)
