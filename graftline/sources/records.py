"""Record sources: JSON arrays, keyed documents, source bundles, issues, daily arrays; and the sinks of the build."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graftline.sources import pieces as pc


def read_records(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A folder of JSON arrays as one table; `file` keeps the order of the files."""
    return spark.read.schema(schema).option("multiLine", True).json(folder).withColumn("file", F.col("_metadata.file_name"))


_BEGIN = r"^\s*\uFEFF?\s*\{"


def read_keyed(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """JSON objects {id: record} as rows (file, id, record fields); keys that start with '_' are metadata.

    A file is read in blocks and cut at the commas between its entries, so its size does not matter; a key that comes twice is two rows."""
    first = lambda: F.col("depth").isin(0, 1)                                   # noqa: E731
    entries = pc.joined(pc.since(pc.json_pieces(spark, folder), {"entry": first}), ["path", "name", "entry"])
    one = F.concat(F.lit("{"), F.regexp_replace("text", _BEGIN, ""), F.lit("}"))  # what follows the entry is not read
    rows = entries.select(F.col("name").alias("file"), F.explode(F.from_json(one, "map<string,string>")).alias("id", "json")).where(~F.col("id").startswith("_"))
    return rows.select("file", "id", F.from_json("json", schema).alias("r")).select("file", "id", "r.*")


def read_bundle(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Bundles {"_source": {...}, "records": {id: record}} as rows; files without a source are left out.

    Files are read in blocks and cut at the commas between sections and between records."""
    marks = {"section": lambda: F.col("depth").isin(0, 1), "entry": lambda: F.col("depth").isin(0, 1, 2)}
    entries = pc.joined(pc.since(pc.json_pieces(spark, folder), marks), ["path", "section", "entry"]).withColumn("text", F.regexp_replace("text", _BEGIN, ""))
    opening = F.col("section") == F.col("entry")
    named = entries.where(opening).select("path", "section", F.regexp_extract("text", r'^\s*"([^"\\]*)"\s*:', 1).alias("key"))
    entries = entries.join(named, ["path", "section"])
    told = entries.where("key = '_source'").groupBy("path", "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("entry", "text"))), lambda e: e["text"]), ",").alias("text"))
    told = told.select("path", F.from_json(F.concat(F.lit("{"), "text", F.lit("}")), "_source struct<key:string, title:string, year:int, url:string, where:string>")["_source"].alias("s")).where("s IS NOT NULL")
    head = r'^\s*"records"\s*:\s*\{'
    held = entries.where((F.col("key") == "records") & (~opening | F.col("text").rlike(head)))
    one = F.concat(F.lit("{"), F.when(opening, F.regexp_replace("text", head, "")).otherwise(F.col("text")), F.lit("}"))
    rows = held.select("path", F.explode(F.from_json(one, f"map<string, struct<{_inner(schema)}>>")).alias("id", "r"))
    return rows.join(told, "path").select(F.col("s.key").alias("source"), F.col("s.title").alias("title"), "id", "r.*")


def _inner(ddl: str) -> str:
    """'a int, b string' -> 'a:int, b:string'."""
    return ", ".join(f"{n}:{t}" for n, t in (part.strip().split(" ", 1) for part in ddl.split(",")))


def read_issues(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Landed issue records without pull requests, labels as names."""
    raw = spark.read.schema(schema).json(path).where("pull_request IS NULL")
    return raw.select("number", "title", "body", "created_at", F.transform("labels", lambda x: x["name"]).alias("labels"))


def unpack_daily(raw: DataFrame, fields: list[str] = ("tmax", "tmin", "prcp")) -> DataFrame:
    """Columnar daily arrays with a start date -> one row per place and day."""
    keep = [c for c in raw.columns if c not in (*fields, "start")]
    z = F.arrays_zip(*[F.col(f) for f in fields])
    return (raw.select(*keep, F.col("start").cast("date").alias("start"), F.posexplode(z).alias("i", "d"))
            .select(*keep, F.date_add("start", F.col("i")).alias("day"), *[F.col(f"d.{f}").alias(f) for f in fields]))


def ingest_worklist(seed: DataFrame, weather_ids: DataFrame, humidity_ids: DataFrame, first: list = ()) -> DataFrame:
    """Places still to fetch: without weather, then with weather but without humidity; named ids first."""
    ids = seed.select("place_id")
    bare = ids.join(weather_ids.select("place_id").distinct(), "place_id", "left_anti").withColumn("need", F.lit("weather"))
    dry = ids.join(weather_ids.select("place_id").distinct(), "place_id", "left_semi").join(humidity_ids.select("place_id").distinct(), "place_id", "left_anti").withColumn("need", F.lit("humidity"))
    rank = F.when(F.col("place_id").isin(*first), 0).otherwise(1) if first else F.lit(1)
    return bare.unionByName(dry).withColumn("priority", rank).orderBy("priority", F.desc("need"), "place_id")


def write_atlas(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> None:
    """Write the merged tables side by side."""
    for name, df in tables.items():
        df.write.mode("overwrite").format(fmt).save(f"{folder}/{name}")


def write_profiles(df: DataFrame, folder: str) -> None:
    """One JSON output per place id."""
    df.repartition("id").write.mode("overwrite").partitionBy("id").json(folder)
