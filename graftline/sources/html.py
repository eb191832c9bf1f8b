"""Listing sources landed as HTML or wiki markup."""
from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graftline.functions.names import clean_title, unescape


def _all(text: str, rx: str, groups: list[str]) -> Column:
    """Every match of a pattern as structs of its groups."""
    return F.arrays_zip(*[F.regexp_extract_all(text, F.lit(rx), i).alias(g) for i, g in enumerate(groups, start=1)])


def extract_links(pages: DataFrame, rx: str, html: str = "html") -> DataFrame:
    """(slug, name) pairs of index pages; `rx` has the two groups."""
    m = pages.select(F.explode(_all(html, rx, ["slug", "name"])).alias("m"))
    return m.select("m.slug", F.trim(unescape("m.name")).alias("name")).where("name <> ''").distinct()


CARD = r'(?s)<h3 class="text-lg[^>]*>\s*([^<]+?)\s*</h3>.*?applebyname/(([a-z0-9-]+)-id-\d+)" type="button"'


@cache
def _windows_marks() -> tuple[str, str]:
    """The characters Windows-1252 has where Latin-1 has control codes."""
    codes = [i for i in range(0x80, 0xA0) if i not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]
    return "".join(map(chr, codes)), bytes(codes).decode("cp1252")


def repaired(latin: Column | str) -> Column:
    """Bytes read as Latin-1, as the text they are: UTF-8 where that is valid, else Windows-1252."""
    c = F.col(latin) if isinstance(latin, str) else latin
    return F.coalesce(F.try_validate_utf8(F.encode(c, "ISO-8859-1").cast("string")), F.translate(c, *_windows_marks()))


def extract_cards(pages: DataFrame, raw: str = "raw") -> DataFrame:
    """Listing cards (name, link) of landed pages (bytes): each title is decoded by itself, group prefixes and trailing marks are
    dropped, and accents lost at the source are replaced by the plain spelling of the link."""
    page = pages.select(F.decode(raw, "ISO-8859-1").alias("page"))
    c = page.select(F.explode(_all("page", CARD, ["title", "link", "slug"])).alias("m")).select(repaired("m.title").alias("title"), "m.link", "m.slug")
    name = F.regexp_replace(F.trim(unescape("title")), r"^R[FD]:\s*", "")
    name = F.regexp_replace(F.regexp_replace(name, r"\s*>{2,}.*$", ""), r"(\w)�(s\b)", "$1'$2")
    c = c.select("link", "slug", name.alias("name"))
    plain = F.initcap(F.replace(F.col("slug"), F.lit("-"), F.lit(" ")))
    return c.select(F.when(F.contains("name", F.lit("�")), plain).otherwise(F.col("name")).alias("name"), "link").distinct()


def parse_wiki_list(lines: DataFrame) -> DataFrame:
    """Rows of a wiki table: the cell after each '|-' line holds the name and perhaps other names.

    `lines`: page, line_no, text.  Each line looks at the one before it within its page."""
    w = Window.partitionBy("page").orderBy("line_no")
    cell = lines.withColumn("before", F.trim(F.lag("text").over(w))).where(F.col("before") == "|-")
    cell = cell.where(F.col("text").startswith("|") & ~F.col("text").startswith("|-") & ~F.col("text").startswith("|}") & ~F.contains(F.lower("text"), F.lit("(see ")))
    link = r"\[\[(?:[^|\]]*\|)?([^\]]*)\]\]"
    body = F.regexp_replace(F.expr("substring(text, 2)"), r"<ref[^>]*/>|<ref[^>]*>.*?</ref>", "")
    aka_rx = r"\(\{\{aka\}\}\s*(.*?)\)\s*$"
    aka = F.regexp_replace(F.regexp_extract("body", aka_rx, 1), link, "$1")
    names = F.filter(F.transform(F.split(aka, r",|;|\bor\b"), lambda a: F.regexp_replace(a, r"^[ '\[\]]+|[ '\[\]]+$", "")), lambda a: a != "")
    c = cell.withColumn("body", body).withColumns({"aka": names, "main": F.regexp_replace(F.regexp_replace("body", aka_rx, ""), link, "$1")})
    name = clean_title(F.regexp_replace(unescape(F.regexp_replace("main", r"'{2,}|\{\{.*?\}\}", "")), r"^[ |]+|[ |]+$", ""))
    return c.select("page", "line_no", name.alias("name"), "aka").where((F.length("name").between(2, 60)) & ~F.lower("name").startswith("file:"))
