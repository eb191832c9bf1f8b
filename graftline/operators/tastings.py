"""Visitors' taste reports: form text -> fields, resolution to varieties, summaries.

Nothing per variety is gathered into lists: issues, tags and places are rows, so a variety with a third of all reports is
spread over tasks like any other."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graftline import fixed_values as fx
from graftline.functions.codes import mapped
from graftline.functions.names import build_key
from graftline.operators.matching import all_names

FIELDS = list(dict.fromkeys(fx.REPORT_HEADINGS.values()))


def _sections(body: Column | str) -> Column:
    """The '### heading' sections of a form as structs (h, text)."""
    b = F.regexp_replace(F.coalesce(F.col(body) if isinstance(body, str) else body, F.lit("")), r"\r\n?", "\n")
    parts = F.split(F.concat(F.lit("\n"), b), r"\n###[ \t]+")
    own = F.slice(parts, 2, F.greatest(F.lit(0), F.size(parts) - 1))
    return F.transform(own, lambda s: F.struct(F.trim(F.substring_index(s, "\n", 1)).alias("h"), F.regexp_extract(s, r"(?s)^[^\n]*\n(.*)$", 1).alias("text")))


def parse_reports(reports: DataFrame, body: str = "body") -> DataFrame:
    """Add the form's fields: 1-5 scales as numbers, ticked notes as an array, other answers as text (unanswered is null)."""
    r = reports.withColumn("_s", _sections(body))
    out = {}
    for heading, field in fx.REPORT_HEADINGS.items():
        mine = F.filter("_s", lambda s: s["h"] == heading)                      # noqa: B023
        text = F.when(F.size(mine) > 0, F.regexp_replace(F.array_join(F.transform(mine, lambda s: s["text"]), "\n"), r"^\s+|\s+$", ""))
        if field == "notes":
            ticked = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"- \[[xX]\]\s*([^\n]+)"), 1)
            out[field] = F.transform(ticked, lambda t: F.coalesce(mapped(t, fx.REPORT_TICKS), t))
        elif field in fx.TASTE_SCALES:
            out[field] = F.nullif(F.regexp_extract(text, r"^([1-5])", 1), F.lit("")).cast("int")
        else:
            out[field] = F.when(~text.isin("", "_No response_"), text)
    return r.withColumns(out).drop("_s")


def valid_reports(reports: DataFrame) -> DataFrame:
    """Reports without an invalid, spam or duplicate label."""
    bad = F.arrays_overlap(F.coalesce("labels", F.array().cast("array<string>")), F.array(*[F.lit(x) for x in fx.REPORT_SKIP_LABELS]))
    return reports.where(~bad)


def report_names(varieties: DataFrame) -> DataFrame:
    """(key, variety_id): the first variety, in name order, that has a name."""
    order = varieties.select("variety_id", build_key("name").alias("sort_name"))
    n = all_names(varieties).join(order, "variety_id").withColumn("key", build_key("name")).where("key <> ''")
    return n.groupBy("key").agg(F.min_by("variety_id", F.struct("sort_name", "variety_id", "pos")).alias("variety_id"))


def resolve_reports(parsed: DataFrame, names: DataFrame) -> DataFrame:
    """Variety of each report: by the form's field, else by the title without 'taste:'; null if neither is known."""
    by_field = names.select(F.col("key").alias("k1"), F.col("variety_id").alias("v1"))
    by_title = names.select(F.col("key").alias("k2"), F.col("variety_id").alias("v2"))
    keyed = parsed.withColumns({"k1": build_key(F.coalesce("variety", F.lit(""))), "k2": build_key(F.regexp_replace("title", r"(?i)^taste:\s*", ""))})
    return keyed.join(by_field, "k1", "left").join(by_title, "k2", "left").withColumn("variety_id", F.coalesce("v1", "v2")).drop("k1", "k2", "v1", "v2")


def tasting_summary(resolved: DataFrame) -> DataFrame:
    """Reports and mean scales (one decimal) per variety."""
    return resolved.where("variety_id IS NOT NULL").groupBy("variety_id").agg(F.count("*").alias("n"), *[F.bround(F.avg(s), 1).alias(s) for s in fx.TASTE_SCALES])


def tasting_tags(resolved: DataFrame) -> DataFrame:
    """Reports per variety and noticed flavour."""
    return resolved.where("variety_id IS NOT NULL").select("variety_id", F.explode("notes").alias("tag")).groupBy("variety_id", "tag").agg(F.count("*").alias("n"))


def tasting_places(resolved: DataFrame, k: int = 10) -> DataFrame:
    """The first ten places named per variety (sixty characters), in issue order."""
    w = Window.partitionBy("variety_id").orderBy("number")
    r = resolved.where("variety_id IS NOT NULL AND where IS NOT NULL").select("variety_id", "number", F.substring("where", 1, 60).alias("place"))
    return r.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k)


def unmatched_reports(resolved: DataFrame) -> DataFrame:
    return resolved.where("variety_id IS NULL").select("number", "title")


def publishable(summary: DataFrame, at_least: int = fx.MIN_TASTINGS) -> DataFrame:
    return summary.where(F.col("n") >= at_least)


def top_tags(tags: DataFrame, k: int = 5, at_least: int = 2) -> DataFrame:
    """The five flavours most noticed per variety, by two visitors at least."""
    w = Window.partitionBy("variety_id").orderBy(F.desc("n"), "tag")
    return tags.where(F.col("n") >= at_least).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
