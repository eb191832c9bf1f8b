"""Large files read in blocks: what depends on everything before a row is a running value, worked out block by block.

A text file is read as pieces between separators, so that many tasks share one file however long it is.  Within a block (the byte range
one task reads) running values come from a window; what the blocks before add is a small table with one row per block.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK = ["path", "block"]


def _inside() -> WindowSpec:
    return Window.partitionBy(*BLOCK).orderBy("id")


def _before() -> WindowSpec:
    """The pieces of a block before this one."""
    return _inside().rowsBetween(Window.unboundedPreceding, -1)


def _earlier() -> WindowSpec:
    """The blocks of a file before this one."""
    return Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)


def read_pieces(spark: SparkSession, folder: str, separator: str) -> DataFrame:
    """(path, name, block, id, value): pieces of text files between separators; name is the file's name without its ending, block where the
    byte range begins, id the order within a block."""
    meta = F.col("_metadata")
    return (spark.read.option("lineSep", separator).text(folder)
            .select(meta["file_path"].alias("path"), F.regexp_extract(meta["file_name"], r"^(.*?)(\.[^.]*)?$", 1).alias("name"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("id"), "value"))


def numbered(pieces: DataFrame) -> DataFrame:
    """`number`: the place of each piece in its file, from 1."""
    before = pieces.groupBy(*BLOCK).agg(F.count("*").alias("n")).select(*BLOCK, F.coalesce(F.sum("n").over(_earlier()), F.lit(0)).alias("before"))
    return pieces.withColumn("number", F.row_number().over(_inside())).join(before, BLOCK).withColumn("number", F.col("number") + F.col("before")).drop("before")


def _count(text: Column, letters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, letters, ""))


def json_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of JSON files between commas, with `depth`: the number of open objects and lists before a piece, null inside a string.

    Whether a piece begins inside a string is the parity of the quotes before it; what it opens and closes depends on that, so a block
    sums both cases and the blocks before decide which one holds."""
    pieces = read_pieces(spark, folder, ",")
    parts = F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"', -1)
    opened = lambda rest: (lambda t: _count(t, "{[") - _count(t, "}]"))(F.array_join(F.filter("parts", lambda x, i: i % 2 == rest), ""))
    pieces = pieces.withColumn("parts", parts).select("path", "name", "block", "id", "value", (F.size("parts") - 1).alias("quotes"), opened(0).alias("even"), opened(1).alias("odd"))
    odd = F.coalesce(F.sum("quotes").over(_before()), F.lit(0)) % 2 == 1
    pieces = pieces.withColumn("flipped", odd)
    # what a block opens if it begins outside a string (0) and inside one (1)
    pieces = pieces.withColumns({"in0": F.when(F.col("flipped"), F.col("odd")).otherwise(F.col("even")), "in1": F.when(F.col("flipped"), F.col("even")).otherwise(F.col("odd"))})
    pieces = pieces.withColumns({f"run{i}": F.coalesce(F.sum(f"in{i}").over(_before()), F.lit(0)) for i in (0, 1)})
    blocks = pieces.groupBy(*BLOCK).agg(F.sum("quotes").alias("quotes"), F.sum("in0").alias("s0"), F.sum("in1").alias("s1"))
    blocks = blocks.withColumn("inside", F.coalesce(F.sum("quotes").over(_earlier()), F.lit(0)) % 2 == 1)
    blocks = blocks.withColumn("open", F.coalesce(F.sum(F.when(F.col("inside"), F.col("s1")).otherwise(F.col("s0"))).over(_earlier()), F.lit(0))).select(*BLOCK, "inside", "open")
    j = pieces.join(blocks, BLOCK)
    depth = F.col("open") + F.when(F.col("inside"), F.col("run1")).otherwise(F.col("run0"))
    return j.select("path", "name", "block", "id", "value", F.when(F.col("flipped") == F.col("inside"), depth).alias("depth"))


def since(pieces: DataFrame, marks: dict[str, Callable[[], Column]]) -> DataFrame:
    """For each name, the place (block, id) of the latest piece up to this one for which the condition holds."""
    place = F.struct("block", "id")
    out = pieces.withColumns({f"_{n}": F.max(F.when(c(), place)).over(_inside().rowsBetween(Window.unboundedPreceding, Window.currentRow)) for n, c in marks.items()})
    blocks = out.groupBy(*BLOCK).agg(*[F.max(f"_{n}").alias(n) for n in marks])
    blocks = blocks.select(*BLOCK, *[F.max(n).over(_earlier()).alias(n) for n in marks])
    return out.join(blocks, BLOCK).withColumns({n: F.coalesce(f"_{n}", n) for n in marks}).drop(*[f"_{n}" for n in marks])


def joined(pieces: DataFrame, by: list[str], separator: str = ",") -> DataFrame:
    """The text of each group of pieces, which should be no more than one record."""
    ordered = F.array_sort(F.collect_list(F.struct("block", "id", "value")))
    return pieces.groupBy(*by).agg(F.array_join(F.transform(ordered, lambda p: p["value"]), separator).alias("text"))
