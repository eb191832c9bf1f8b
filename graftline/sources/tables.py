"""Delimited sources: checked headers, preambles, tabs, sniffed separators."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv_checked(spark: SparkSession, path: str, expect: dict[int, str]) -> DataFrame:
    """CSV with a header whose columns are used by position: each expected fragment must be in the header at its place."""
    df = spark.read.option("header", True).option("multiLine", False).csv(path)
    names = [c.lstrip("﻿") for c in df.columns]
    for i, fragment in expect.items():
        if fragment.lower() not in names[i].lower():
            raise ValueError(f"column {i} is {names[i]!r}, expected {fragment!r}")
    return df.toDF(*names)


def read_preamble_csv(spark: SparkSession, path: str, schema: str, preamble: list[str]) -> DataFrame:
    """CSV files that open with stated lines before the header.

    Exactly those lines and the header itself are left out, wherever they stand, so files may be split.  A short row has nulls at its
    end; a row that cannot be read at all keeps its text in `unreadable`."""
    names = [part.split()[0] for part in schema.split(",")]
    line = F.trim(F.regexp_replace("value", r"^\ufeff|\r$", ""))
    raw = spark.read.text(path).where(~line.isin([p.strip() for p in preamble]) & (F.lower(line) != ",".join(names).lower()) & (line != ""))
    row = F.from_csv(line, schema + ", unreadable string", {"columnNameOfCorruptRecord": "unreadable"})
    short = F.size(F.split(line, ",")) < len(names)
    return raw.select(row.alias("r"), short.alias("short")).select(*[F.col(f"r.{n}") for n in names], F.when(~F.col("short"), F.col("r.unreadable")).alias("unreadable"))


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("sep", "\t").csv(path)


def read_sniffed(spark: SparkSession, path: str, wanted: dict[str, list[str]]) -> DataFrame:
    """Delimited text whose separator is the one most used in the header line; columns are found under any of their names.

    Only the header line is looked at beforehand."""
    head = spark.read.text(path).limit(1).collect()[0]["value"].lstrip("﻿")
    sep = max(",;\t", key=head.count)
    df = spark.read.option("header", True).option("sep", sep).csv(path)
    df = df.toDF(*[c.lstrip("﻿").strip().upper() for c in df.columns])
    found = {out: [F.nullif(F.trim(F.col(f"`{n}`")), F.lit("")) for n in names if n in df.columns] for out, names in wanted.items()}
    return df.select(*[(F.coalesce(*cols) if cols else F.lit(None).cast("string")).alias(out) for out, cols in found.items()])


def accession_names(rows: DataFrame, status: str = "status", name: str = "name") -> DataFrame:
    """Names of cultivars, landraces and breeding lines; a cell may hold several names; numbers are no names."""
    ok = F.col(status).isNull() | F.col(status).rlike(r"(?i)^((3|4|5)\d\d|cultivar|landrace|breeding)")
    each = rows.where(ok).select(F.explode(F.split(name, r"\s*;\s*")).alias("name"))
    return each.where((F.col("name") != "") & ~F.col("name").rlike(r"^[\d\s/.-]+$")).distinct()
