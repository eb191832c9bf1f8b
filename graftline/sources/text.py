"""Text sources: books as numbered lines, landed listing lines."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graftline.functions.spread import spread
from graftline.sources import pieces as pc


def numbered_lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Whole texts -> one row per (key, line_no from 1, text)."""
    return spread(texts.select(key, text), key).select(key, F.posexplode(F.split(text, r"\r?\n")).alias("pos", "line")).select(key, (F.col("pos") + 1).cast("long").alias("line_no"), F.col("line").alias("text"))


def read_book_lines(spark: SparkSession, folder: str) -> DataFrame:
    """A folder of text books -> (book, line_no, text); the book is the file name without its ending.

    A book is read in blocks, and the lines of the blocks before are added to the numbers of a block.  A line feed at the very end
    begins no further line."""
    lines = pc.numbered(pc.read_pieces(spark, folder, "\n"))
    return lines.select(F.col("name").alias("book"), F.col("number").cast("long").alias("line_no"), F.regexp_replace("value", r"\r$", "").alias("text"))


def listing_lines(lines: DataFrame, text: str = "text") -> DataFrame:
    """Distinct listing lines of a landed text: spaces collapsed, page furniture and number-only lines dropped."""
    t = F.trim(F.regexp_replace(F.col(text), r"\s+", " "))
    return lines.select(t.alias("name")).where((F.col("name") != "") & ~F.col("name").rlike(r"P a g e|Collection list|^[\d\s.()-]+$")).distinct()
