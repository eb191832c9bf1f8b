"""Tasting reports, batch and stream."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.base import FIXTURES, fixture, oracle, query
from checks.climate import CHILL, SEASON
from checks.labs import build_sql
from checks.orchard import pick
from graftline.operators import tastings as ts
from graftline.plans.lineage import shared_folder
from graftline.streaming import phenology as ph
from graftline.streaming import tastings as st

NL = "chr(10)"
FIXTURES["fruit"] = "SELECT p_partkey AS variety_id, p_name || ' ' || CAST(p_partkey % 500 AS STRING) AS name, list_value(p_brand || ' ' || CAST(p_partkey AS STRING)) AS aka FROM {part}"
FIXTURES["taste_report"] = f"""
SELECT o_orderkey AS number, CAST(o_orderdate AS TIMESTAMP) AS created_at, CASE WHEN o_orderstatus = 'P' THEN list_value('taste-report', 'spam') WHEN o_orderkey % 3 = 0 THEN list_value('taste-report') END AS labels,
  CASE WHEN o_orderkey % 2 = 0 THEN 'TASTE: ' || upper(p_name) || ' ' || CAST(p_partkey % 500 AS STRING) ELSE 'my report' END AS title,
  CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE 'preface' || {NL} || '### Variety' || {NL} || {NL} || CASE WHEN o_orderkey % 7 = 0 THEN '_No response_' WHEN o_orderkey % 7 = 1 THEN p_brand || ' ' || CAST(p_partkey AS STRING) WHEN o_orderkey % 7 = 2 THEN 'unheard of' ELSE p_name || '  ' || CAST(p_partkey % 500 AS STRING) END || {NL}
   || '### Sweetness' || {NL} || {NL} || CAST(o_orderkey % 8 AS STRING) || ' - so so' || {NL} || {NL} || '### Sharpness (acidity)' || {NL} || CAST(1 + o_custkey % 5 AS STRING) || {NL} || '### Unknown heading' || {NL} || 'ignored 5' || {NL} || '### Texture' || {NL} || 'crisp' || {NL}
   || '### Flavours you noticed (tick any)' || {NL} || {NL} || '- [x] honey' || {NL} || '- [ ] nutty' || {NL} || CASE WHEN o_orderkey % 2 = 0 THEN '- [X] rose-water' || {NL} ELSE '' END || CASE WHEN o_custkey % 3 = 0 THEN '- [x] pear-drop' || {NL} ELSE '' END
   || '### Where it was grown (as precise as you like)' || {NL} || {pick('o_orderkey', ["a garden near the old railway station in the north of the county, by the river", "_No response_", "Kent", ""])} || {NL} END AS body
FROM {{orders}} JOIN {{part}} ON p_partkey = CASE WHEN o_custkey % 3 = 0 THEN 7 ELSE o_custkey END"""
FROM = ("taste_report", "fruit")


def section(h: str) -> str:
    return f"(SELECT trim(regexp_extract(s, '(?s)^[^\\n]*\\n(.*)$', 1), chr(10) || ' ') FROM (SELECT unnest(secs) AS s) WHERE trim(split_part(s, chr(10), 1)) = '{h}' LIMIT 1)"


PARSED = f"""sec AS (SELECT number, created_at, labels, title, (string_split(chr(10) || coalesce(body, ''), chr(10) || '### '))[2:] AS secs FROM taste_report),
prs AS (SELECT number, created_at, labels, title, nullif(nullif({section('Variety')}, ''), '_No response_') AS variety, nullif(regexp_extract({section('Sweetness')}, '^([1-5])', 1), '')::INT AS sweet, nullif(regexp_extract({section('Sharpness (acidity)')}, '^([1-5])', 1), '')::INT AS acid,
  nullif(regexp_extract({section('Texture')}, '^([1-5])', 1), '')::INT AS crisp, list_transform(regexp_extract_all(coalesce({section('Flavours you noticed (tick any)')}, ''), '- \\[[xX]\\]\\s*([^\\n]+)', 1), lambda t: CASE t WHEN 'rose-water' THEN 'rose' ELSE t END) AS notes,
  nullif(nullif({section('Where it was grown (as precise as you like)')}, ''), '_No response_') AS "where" FROM sec),
nk AS (SELECT key, arg_min(variety_id, (sn, variety_id, pos)) AS variety_id FROM (SELECT variety_id, {build_sql('name')} AS sn, 0 AS pos, {build_sql('name')} AS key FROM fruit UNION ALL SELECT variety_id, {build_sql('name')}, 1, {build_sql('aka[1]')} FROM fruit) WHERE key <> '' GROUP BY key),
rsv AS (SELECT p.*, coalesce(a.variety_id, b.variety_id) AS variety_id FROM prs p LEFT JOIN nk a ON a.key = {build_sql("coalesce(p.variety, '')")} LEFT JOIN nk b ON b.key = {build_sql("regexp_replace(p.title, '(?i)^taste:\\s*', '')")} WHERE NOT list_has_any(coalesce(labels, []), ['invalid', 'spam', 'duplicate']))"""


def resolved(spark, sf):
    return ts.resolve_reports(ts.parse_reports(ts.valid_reports(fixture(spark, sf, "taste_report"))), ts.report_names(fixture(spark, sf, "fruit")))


@query("parsed_reports", oracle(FROM, "SELECT number, variety, sweet, acid, crisp, array_to_string(notes, ',') AS notes, \"where\" FROM prs", PARSED))
def parsed_reports(spark, sf):
    p = ts.parse_reports(fixture(spark, sf, "taste_report"))
    return p.select("number", "variety", "sweet", "acid", "crisp", F.array_join("notes", ",").alias("notes"), "where")


@query("resolved_reports", oracle(FROM, "SELECT number, variety_id FROM rsv", PARSED))
def resolved_reports(spark, sf):
    return resolved(spark, sf).select("number", "variety_id")


@query("unmatched_reports", oracle(FROM, "SELECT number, title FROM rsv WHERE variety_id IS NULL", PARSED))
def unmatched_reports(spark, sf):
    return ts.unmatched_reports(resolved(spark, sf))


SUMMARY = "SELECT variety_id, count(*) AS n, round_even(avg(sweet), 1) AS sweet, round_even(avg(acid), 1) AS acid, NULL::DOUBLE AS aroma, round_even(avg(crisp), 1) AS crisp, NULL::DOUBLE AS juicy FROM rsv WHERE variety_id IS NOT NULL GROUP BY variety_id"


@query("tasting_summary", oracle(FROM, SUMMARY, PARSED))
def tasting_summary(spark, sf):
    return ts.tasting_summary(resolved(spark, sf))


@query("published_tastings", oracle(FROM, f"SELECT * FROM ({SUMMARY}) WHERE n >= 3", PARSED))
def published_tastings(spark, sf):
    return ts.publishable(ts.tasting_summary(resolved(spark, sf)))


@query("tasting_tags", oracle(FROM, "SELECT variety_id, tag, count(*) AS n FROM (SELECT variety_id, unnest(notes) AS tag FROM rsv WHERE variety_id IS NOT NULL) GROUP BY variety_id, tag", PARSED))
def tasting_tags(spark, sf):
    return ts.tasting_tags(resolved(spark, sf))


@query("top_visitor_tags", oracle(FROM, "SELECT variety_id, tag, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY variety_id ORDER BY n DESC, tag) AS rank FROM (SELECT variety_id, tag, count(*) AS n FROM (SELECT variety_id, unnest(notes) AS tag FROM rsv WHERE variety_id IS NOT NULL) GROUP BY variety_id, tag) WHERE n >= 2) WHERE rank <= 5", PARSED))
def top_visitor_tags(spark, sf):
    return ts.top_tags(ts.tasting_tags(resolved(spark, sf)))


@query("tasting_places", oracle(FROM, "SELECT variety_id, number, place, pos FROM (SELECT variety_id, number, substr(\"where\", 1, 60) AS place, row_number() OVER (PARTITION BY variety_id ORDER BY number) AS pos FROM rsv WHERE variety_id IS NOT NULL AND \"where\" IS NOT NULL) WHERE pos <= 10", PARSED))
def tasting_places(spark, sf):
    return ts.tasting_places(resolved(spark, sf))


# ---- streams: the tables land as files in time order, the stream reads them until all are taken -----------
def fresh_folder(spark) -> str:
    base = shared_folder(spark)
    return f"{base}/graftline-{uuid.uuid4().hex}"


def land(df, cuts, column, folder: str) -> str:
    """Write the rows as one folder of files, slice by slice in time order."""
    bounds = [None, *cuts, None]
    for lo, hi in zip(bounds, bounds[1:]):
        part = df
        if lo is not None:
            part = part.where(F.col(column) >= F.lit(lo).cast(df.schema[column].dataType))
        if hi is not None:
            part = part.where(F.col(column) < F.lit(hi).cast(df.schema[column].dataType))
        part.write.mode("append").parquet(folder)
    return folder


def run_to_files(df, mode: str, out: str, checkpoint: str):
    def keep(batch, _id):
        batch.write.mode("overwrite").parquet(out)

    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q = w.foreachBatch(keep).start() if mode == "complete" else w.format("parquet").option("path", out).start()
    q.awaitTermination()


# edited issues: of every ten one has its scores changed, of every thirty-five one turns into spam
EDITED = PARSED.replace("FROM taste_report)", "FROM (SELECT number, created_at, CASE WHEN number % 35 = 0 THEN ['spam'] ELSE labels END AS labels, title, CASE WHEN number % 10 = 0 THEN replace(body, 'so so', '9') ELSE body END AS body FROM taste_report))", 1)
EDITED = EDITED.replace("string_split(chr(10) || coalesce(body, '')", "string_split(chr(10) || coalesce(CASE WHEN number % 10 = 0 THEN regexp_replace(body, '[0-9] - 9', '2 - 9') ELSE body END, '')", 1)


@query("streamed_tastings", oracle(FROM, SUMMARY, EDITED))
def streamed_tastings(spark, sf):
    root = fresh_folder(spark)
    first = fixture(spark, sf, "taste_report").withColumn("updated_at", F.col("created_at").cast("timestamp")).withColumn("created_at", F.col("updated_at"))
    later = first.withColumn("updated_at", F.expr("updated_at + INTERVAL 700 DAYS"))
    scores = F.when(F.col("number") % 10 == 0, F.regexp_replace("body", "[0-9] - so so", "2 - 9")).otherwise(F.col("body"))
    again = later.where("number % 10 = 0 OR number % 35 = 0").withColumn("body", scores).withColumn("labels", F.when(F.col("number") % 35 == 0, F.array(F.lit("spam"))).otherwise(F.col("labels")))
    land(first.unionByName(again), ["1995-01-01", "1997-01-01", "1999-01-01"], "updated_at", f"{root}/in")
    stream = spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 4).parquet(f"{root}/in")
    st.keep_current_reports(stream, f"{root}/store", f"{root}/cp").awaitTermination()
    return st.stored_summary(spark, f"{root}/store", ts.report_names(fixture(spark, sf, "fruit")))


@query("streamed_tag_weeks", """SELECT strftime(start, '%Y-%m-%d') AS start, tag, n FROM (SELECT time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS start, event_type AS tag, count(*) AS n FROM events GROUP BY 1, 2)
 WHERE start + INTERVAL 7 DAY <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY""")
def streamed_tag_weeks(spark, sf):
    root = fresh_folder(spark)
    e = fixture(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("created_at"), F.col("event_type").alias("tag"))
    land(e, ["2024-01-09", "2024-01-17", "2024-01-25"], "created_at", f"{root}/in")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 4).parquet(f"{root}/in")
    run_to_files(st.stream_tag_windows(stream), "append", f"{root}/out", f"{root}/cp")
    return spark.read.parquet(f"{root}/out").select(F.date_format("start", "yyyy-MM-dd").alias("start"), "tag", "n")


RUN_DAYS = f"""raw AS (SELECT place_id, lat, greatest(tmax, tmin) AS tmax, least(tmax, tmin) AS tmin, year(day) AS y, dayofyear(make_date(2001, month(day), dayofmonth(day))) - 1 AS di FROM weather_daily WHERE tmax IS NOT NULL AND tmin IS NOT NULL AND NOT (month(day) = 2 AND dayofmonth(day) = 29)),
cyc AS (SELECT place_id, lat, CASE WHEN lat >= 0 OR di >= 181 THEN y ELSE y - 1 END AS vy, CASE WHEN lat >= 0 THEN di WHEN di >= 181 THEN di - 181 ELSE di + 184 END AS vi, tmax, tmin, (tmax + tmin) / 2 AS tmean FROM raw),
days AS (SELECT *, {CHILL} AS chill FROM cyc)"""


@query("streamed_bloom", oracle(["weather_daily"], "SELECT place_id, cycle, any_value(chill_total) AS chill, any_value(bloom) AS bloom FROM season GROUP BY place_id, cycle HAVING any_value(bloom) IS NOT NULL AND max(ci) >= 89", RUN_DAYS + "," + SEASON))
def streamed_bloom(spark, sf):
    root = fresh_folder(spark)
    daily = fixture(spark, sf, "weather_daily")
    land(daily, [f"{y}-01-01" for y in (1997, 1999, 2001)], "day", f"{root}/in")
    stream = spark.readStream.schema(daily.schema).option("maxFilesPerTrigger", 8).parquet(f"{root}/in")
    ph.stream_phenology(stream, f"{root}/state", f"{root}/cp").awaitTermination()
    return spark.read.parquet(f"{root}/state/bloom").select("place_id", "cycle", "chill", "bloom")

