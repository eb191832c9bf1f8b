"""Codes, classes and labels."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graftline import fixed_values as fx
from graftline.functions.numeric import banded, clamp, col


def _map(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def mapped(c: Column | str, table: dict) -> Column:
    """Value of a small fixed table, null where the key is unknown."""
    return F.try_element_at(_map(table), col(c))


def country_name(c: Column | str) -> Column:
    return F.coalesce(mapped(c, fx.COUNTRY_NAMES), F.nullif(col(c), F.lit("")), F.lit("Unknown"))


def tag_label(c: Column | str) -> Column:
    return F.coalesce(mapped(c, fx.TAG_LABEL), col(c))


def tag_family(c: Column | str) -> Column:
    return mapped(c, {t: family for family, tags in fx.TAG_FAMILIES for t in tags})


def chill_class(h: Column | str) -> Column:
    h = col(h)
    return F.when(h < 500, "low").when(h < 900, "medium").when(h < 1200, "high").when(h.isNotNull(), "very high")


def evidence_level(n: Column | str) -> Column:
    return banded(F.coalesce(col(n), F.lit(0)), [(3, "firm"), (2, "supported"), (1, "reported"), (None, "unsourced")])


def zone_min_c(zone: Column | str) -> Column:
    """Typical coldest night of a hardiness zone (1..10, held at the ends)."""
    z = clamp(col(zone), 1, len(fx.ZONE_MIN_C)).cast("int")
    return F.element_at(F.array(*[F.lit(c) for c in fx.ZONE_MIN_C]), z)


def book_voice(book: Column | str) -> Column:
    """The author behind a book: several works of one author are one voice."""
    return F.coalesce(mapped(book, fx.BOOK_VOICE), col(book))


def modern_voice(src: Column | str, url: Column | str) -> Column:
    """Voice key of a web source: a known publisher by itself, anything else by kind and host."""
    host = F.regexp_replace(F.lower(F.coalesce(F.try_parse_url(col(url), F.lit("AUTHORITY")), F.lit(""))), r"^www\.", "")
    return F.when(col(src).isin(*fx.KNOWN_PUBLISHERS), col(src)).otherwise(F.concat(col(src), F.lit(":"), host))


def modern_label(src: Column | str, url: Column | str) -> Column:
    host = F.regexp_replace(F.lower(F.coalesce(F.try_parse_url(col(url), F.lit("AUTHORITY")), F.lit(""))), r"^www\.", "")
    return F.coalesce(mapped(src, fx.KNOWN_PUBLISHERS), F.nullif(host, F.lit("")), col(src))


def implied_tags(sweet: Column | str, acid: Column | str, tags: Column | str) -> Column:
    """Structural tags that 1-5 ratings support although the source does not use the word."""
    said = F.array_compact(F.array(F.when(col(sweet) >= 4, "sweet"), F.when(col(acid) >= 4, "sharp"), F.when(col(acid) <= 2, "mild")))
    return F.array_except(said, F.coalesce(col(tags), F.array().cast("array<string>")))


def panel_tags(sweet: Column | str, acid: Column | str, aroma: Column | str) -> Column:
    """Tags that 1-9 panel scores support."""
    return F.array_compact(F.array(F.when(col(sweet) >= 7, "sweet"), F.when(col(acid) >= 7, "sharp"), F.when(col(acid) <= 3, "mild"), F.when(col(aroma) >= 7, "perfumed")))


def book_link(archive_id: Column | str, heading: Column | str, name: Column | str) -> Column:
    """Link that searches the scanned book for the heading (first forty characters, quoted)."""
    text = F.trim(F.regexp_replace(F.coalesce(F.nullif(col(heading), F.lit("")), col(name)), r"\s+", " "))
    text = F.substring(F.regexp_replace(text, r"^[ .]+|[ .]+$", ""), 1, 40)
    quoted = F.regexp_replace(F.url_encode(F.concat(F.lit('"'), text, F.lit('"'))), r"\+", "%20")
    return F.concat(F.lit("https://archive.org/details/"), F.substring_index(col(archive_id), "/", -1), F.lit("?q="), quoted)


def size_ordinal(c: Column | str) -> Column:
    return F.coalesce(mapped(c, {k: i for i, k in enumerate(fx.SIZE_CLASSES)}), F.lit(9))
