"""Distance, neighbours, blending, regional presence and feature resolution."""
from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import FIXTURES, fixture, oracle, query
from checks.climate import joined, joined_sql, rounded, vi_label_sql
from checks.scores import half_up
from graftline import fixed_values as fx
from graftline.functions.numeric import wrap_lon
from graftline.operators import spatial as sp

FIXTURES["query_point"] = """SELECT c_custkey AS point_id, -65e0 + (c_custkey * 53) % 140 + 0.25e0 * (c_custkey % 4) AS lat, (c_custkey * 97) % 720 - 360e0 + 0.5e0 * (c_custkey % 2) AS lon,
  c_nationkey AS region_id, CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN 'US' WHEN c_custkey % 4 = 2 THEN 'NZ' ELSE 'ZA' END AS country FROM {customer}"""
FIXTURES["point"] = "SELECT point_id, lat, (lon + 540e0) % 360e0 - 180e0 AS lon, region_id, country FROM {query_point}"
FIXTURES["own_weather"] = "SELECT DISTINCT o_custkey AS point_id FROM {orders} WHERE o_orderpriority = '1-URGENT'"
FIXTURES["region_note"] = """SELECT n_nationkey AS place_id, n_name AS name, -55e0 + (n_nationkey * 37) % 115 AS lat, -180e0 + (n_nationkey * 71) % 360 AS lon, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE 'notes on ' || n_name END AS summary,
  list_value(n_name, 'Old ' || n_name, 'Red ' || n_name) AS local_names, list_value('Red ' || n_name) AS linked FROM {nation}"""
HAV = "(2 * 6371 * asin(sqrt(pow(sin((q.lat - p.lat) * pi() / 360), 2) + cos(p.lat * pi() / 180) * cos(q.lat * pi() / 180) * pow(sin((q.lon - p.lon) * pi() / 360), 2))))"


def near_sql(places: str, where: str = "TRUE") -> str:
    return f"SELECT p.point_id, q.place_id, {HAV} AS km FROM point p, {places} q WHERE {where}"


@query("wrapped_longitudes", oracle(["query_point"], "SELECT point_id, lon, (lon + 540) % 360 - 180 AS wrapped FROM query_point"))
def wrapped_longitudes(spark, sf):
    return fixture(spark, sf, "query_point").select("point_id", "lon", wrap_lon("lon").alias("wrapped"))


@query("nearest_place", oracle(["point", "site"], f"SELECT point_id, place_id, round(km, 4) AS km, km < 12 AS same_place FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY km, place_id) AS rank FROM ({near_sql('site')}) WHERE km <= 800) WHERE rank = 1"))
def nearest_place(spark, sf):
    n = sp.nearest_places(fixture(spark, sf, "point"), fixture(spark, sf, "site"), 1, 800.0, first_km=100.0)
    return rounded(n.withColumn("same_place", F.col("km") < 12), "km", places=4).drop("rank")


KNN = f"""nb0 AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY km, place_id) AS rank FROM ({near_sql('site', 'NOT q.no_bloom AND (p.lat < 0) = (q.lat < 0)')}) WHERE km <= 1500),
nb AS (SELECT *, (1 / pow(km + 100, 2)) / sum(1 / pow(km + 100, 2)) OVER (PARTITION BY point_id) AS w FROM nb0 WHERE rank <= 4)"""


@query("nearest_neighbours", oracle(["point", "site"], "SELECT point_id, place_id, round(km, 4) AS km, rank, round(w, 6) AS w FROM nb", KNN))
def nearest_neighbours(spark, sf):
    n = sp.knn_places(fixture(spark, sf, "point"), fixture(spark, sf, "site").where("NOT no_bloom"))
    return rounded(rounded(n, "km", places=4), "w")


NUMS = ["chill_mean", "ext_min_mean", "bloom_vi", "gend_median", "hot32", "aridity", "lwd_spring", "pann"]


def arr_sql(c: str, sort: bool = False) -> str:
    a = f"list_sort({c})" if sort else c
    return f"list(list_transform({a}, lambda x: x * w)) AS l_{c}"


BLEND = KNN + f""",
bl0 AS (SELECT point_id, {', '.join(f'sum({c} * w) / sum(CASE WHEN {c} IS NOT NULL THEN w END) AS {c}' for c in NUMS)}, sum(end_vi * w) / sum(w) AS end_vi, bool_or(humidity_estimated) AS humidity_estimated,
  {', '.join(arr_sql(c, c == 'gend_per') for c in ('frost_p', 'gdd_curve', 'gend_per', 'tmax_m'))}, string_agg(n.place_id || ':' || {half_up('km')} || ':' || {half_up('w * 100')}, ' ' ORDER BY rank) AS sources
  FROM nb n JOIN site s USING (place_id) GROUP BY point_id),
bl AS (SELECT b.*, p.lat < 0 AS south, (ext_min_mean * 9 / 5 + 92) / 10 AS z FROM bl0 b JOIN point p USING (point_id))"""


def sum_sql(c: str, n: int) -> str:
    return joined_sql(f"[list_sum(list_transform(l_{c}, lambda a: a[i])) for i in range(1, {n + 1})]") + f" AS {c}"


@query("extrapolated_features", oracle(["point", "site"], f"""SELECT point_id, {', '.join(f'round({c}, 5) AS {c}' for c in NUMS)}, humidity_estimated, {sum_sql('frost_p', 7)}, {sum_sql('gdd_curve', 27)}, {sum_sql('gend_per', 6)}, {sum_sql('tmax_m', 12)}, sources,
 round(greatest(0, z + 1), 5) AS zone_value, (CASE WHEN floor(z) + 1 < 1 THEN '<1' ELSE (floor(z)::INT + 1)::VARCHAR END) || CASE WHEN z - floor(z) >= 0.5 THEN 'b' ELSE 'a' END AS zone_label,
 ext_min_mean > 12 OR chill_mean < 30 AS tropical, {vi_label_sql('bloom_vi', 'south')} AS bloom_label, {vi_label_sql('end_vi', 'south')} AS end_label FROM bl""", BLEND))
def extrapolated_features(spark, sf):
    pts, sites = fixture(spark, sf, "point"), fixture(spark, sf, "site").where("NOT no_bloom").drop("t0", "amp", "tmin_m")
    e = sp.extrapolate(pts, sites, sp.knn_places(pts, sites))
    e = rounded(e, *NUMS, "zone_value", places=5)
    src = F.array_join(F.transform("sources", lambda s: F.concat_ws(":", s["place_id"].cast("string"), s["km"].cast("string"), s["share"].cast("string"))), " ")
    return e.select("point_id", *NUMS, "humidity_estimated", *[joined(F.col(c)).alias(c) for c in ("frost_p", "gdd_curve", "gend_per", "tmax_m")], src.alias("sources"),
                    "zone_value", "zone_label", "tropical", "bloom_label", "end_label")


def polygon_sql(poly) -> str:
    parts = []
    for (xi, yi), (xj, yj) in zip(poly, poly[-1:] + poly[:-1]):
        if yi != yj:
            parts.append(f"(CASE WHEN ({yi} > lat) <> ({yj} > lat) AND lon < ({xj} - {xi})::DOUBLE * (lat - {yi}) / ({yj} - {yi})::DOUBLE + {xi} THEN 1 ELSE 0 END)")
    return "((" + " + ".join(parts) + ") % 2 = 1)"


FIXTURES["american_point"] = "SELECT c_custkey AS point_id, 25e0 + (c_custkey * 7) % 25 + 0.3e0 AS lat, -128e0 + (c_custkey * 13) % 66 + 0.2e0 AS lon, CASE WHEN c_custkey % 5 = 0 THEN 'AU' WHEN c_custkey % 5 = 1 THEN 'US' WHEN c_custkey % 5 = 2 THEN 'CL' END AS country FROM {customer} UNION ALL SELECT -1 - c_custkey AS point_id, 28e0 - (c_custkey * 7) % 80 AS lat, 100e0 + (c_custkey * 13) % 70 AS lon, NULL AS country FROM {customer}"
IN_PRESENT = ", ".join(f"'{c}'" for c in fx.FIRE_BLIGHT_PRESENT)
IN_ABSENT = ", ".join(f"'{c}'" for c in fx.FIRE_BLIGHT_ABSENT)


@query("regional_presence", oracle(["american_point"], f"""SELECT point_id, country, CASE WHEN country IN ({IN_PRESENT}) THEN 'present' WHEN country IN ({IN_ABSENT}) THEN 'absent' ELSE 'unknown' END AS fire_blight_status, rust AS rust_present,
 concat_ws('|', 'Codling moth', CASE WHEN rust OR west THEN 'Apple maggot (Rhagoletis pomonella)' END, CASE WHEN rust THEN 'Plum curculio' END, CASE WHEN country IN ('AU', 'NZ') THEN 'Light brown apple moth' END) AS pests
 FROM (SELECT point_id, coalesce(country, CASE WHEN lat BETWEEN -44 AND -10 AND lon BETWEEN 112 AND 154 THEN 'AU' WHEN lat BETWEEN 30 AND 46 AND lon BETWEEN 129 AND 146 THEN 'JP' END) AS country, {polygon_sql(fx.RUST_RANGE)} AS rust, {polygon_sql(fx.MAGGOT_RANGE)} AS west FROM american_point)"""))
def regional_presence(spark, sf):
    r = sp.regional(fixture(spark, sf, "american_point"))
    return r.select("point_id", "country", "fire_blight_status", "rust_present", F.array_join("pests", "|").alias("pests"))


@query("feature_source", oracle(["point", "site", "own_weather"], f"""SELECT p.point_id, CASE WHEN a.point_id IS NOT NULL THEN 'preset' WHEN o.point_id IS NOT NULL THEN 'live' WHEN b.point_id IS NOT NULL THEN 'extrapolated' ELSE 'none' END AS source,
 a.place_id, round(CASE WHEN a.point_id IS NOT NULL THEN a.km WHEN o.point_id IS NULL THEN b.km END, 4) AS km, CASE WHEN a.point_id IS NOT NULL THEN 1 WHEN o.point_id IS NULL THEN b.n END AS n
 FROM point p LEFT JOIN (SELECT point_id, arg_min(place_id, km) AS place_id, min(km) AS km FROM ({near_sql('site', 'NOT q.humidity_estimated')}) WHERE km < 12 GROUP BY point_id) a USING (point_id)
 LEFT JOIN own_weather o USING (point_id) LEFT JOIN (SELECT point_id, count(*) AS n, min(km) AS km FROM nb GROUP BY point_id) b USING (point_id)""", KNN))
def feature_source(spark, sf):
    return rounded(sp.resolve_features(fixture(spark, sf, "point"), fixture(spark, sf, "site"), fixture(spark, sf, "own_weather")), "km", places=4)


def _prov_sql() -> str:
    m, d = "CASE WHEN ex THEN 'extrapolated' ELSE 'measured' END", "CASE WHEN ex THEN 'extrapolated' ELSE 'modelled' END"
    rows = [
        ("daily temperature and rain", "period", m, "TRUE"), ("elevation", f"{half_up('elev')}::VARCHAR", f"CASE WHEN elev IS NOT NULL THEN {m} ELSE 'assumed' END", "TRUE"),
        ("humidity", f"CASE WHEN humidity_estimated THEN 'estimated' ELSE {half_up('rh_gs')}::VARCHAR END", f"CASE WHEN humidity_estimated THEN 'assumed' ELSE {m} END", "TRUE"),
        ("winter chill", f"{half_up('chill_mean')}::VARCHAR", d, "b"), ("hardiness zone", "zone_label", d, "b"), ("full bloom", "bloom_label", d, "b"),
        ("blossom frost", f"array_to_string(list_transform(frost_p, lambda p: ({half_up('p * 100')})::VARCHAR), ' ')", d, "b"), ("growing degree-days", f"{half_up('gend_median')}::VARCHAR", d, "b"),
        ("frost-free season", f"{half_up('frost_free_days')}::VARCHAR", m, "b"), ("hot days", f"{half_up('hot32 * 10')}::VARCHAR", m, "b"),
        ("rain", f"{half_up('pann')} || '/' || {half_up('gs_precip')}", m, "b"), ("water balance", f"{half_up('least(9.99, aridity) * 100')}::VARCHAR", d, "b"),
        ("leaf wetness", f"{half_up('lwd_spring')}::VARCHAR", d, "b"), ("disease pressure", f"{half_up('scab_events')}::VARCHAR", d, "b"), ("fire blight weather", f"{half_up('fire_blight_events')}::VARCHAR", d, "b"),
        ("fire blight presence", "fire_blight_status", "CASE WHEN fire_blight_status = 'unknown' THEN 'assumed' ELSE 'regional' END", "TRUE"),
        ("rust presence", "CASE WHEN rust_present THEN 'yes' ELSE 'no' END", "'regional'", "TRUE"), ("variety traits", "'default where unrecorded'", "'assumed'", "TRUE")]
    u = " UNION ALL ".join(f"SELECT place_id, {i} AS o, '{k}' AS metric, {v} AS value, {bs} AS basis FROM s WHERE {w}" for i, (k, v, bs, w) in enumerate(rows))
    return f"SELECT place_id, row_number() OVER (PARTITION BY place_id ORDER BY o) - 1 AS pos, metric, value, basis FROM ({u})"


@query("metric_provenance", oracle(["site"], _prov_sql(), "s AS (SELECT *, place_id % 3 = 0 AS ex, CASE WHEN place_id % 2 = 0 THEN place_id * 1.5 END AS elev, NOT no_bloom AS b FROM site)"))
def metric_provenance(spark, sf):
    s = fixture(spark, sf, "site").withColumns({"source": F.when(F.col("place_id") % 3 == 0, "extrapolated").otherwise("live"), "elev": F.when(F.col("place_id") % 2 == 0, F.col("place_id") * 1.5)})
    return sp.provenance(s)


@query("local_notes", oracle(["point", "region_note"], f"""SELECT p.point_id, coalesce(o.place_id, n.place_id) AS place_id, round(CASE WHEN o.place_id IS NULL THEN n.km END, 4) AS km, o.place_id IS NOT NULL AS own, t.summary,
 array_to_string(t.linked, '|') AS linked, CASE WHEN t.place_id IS NOT NULL THEN t.name || '|Old ' || t.name END AS unlinked FROM point p LEFT JOIN region_note o ON o.place_id = p.region_id AND o.summary IS NOT NULL
 LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY km, place_id) AS rn FROM ({near_sql('region_note')}) WHERE km <= 800) WHERE rn = 1) n ON n.point_id = p.point_id
 LEFT JOIN region_note t ON t.place_id = coalesce(o.place_id, n.place_id) AND t.summary IS NOT NULL"""))
def local_notes(spark, sf):
    n = sp.local_notes(fixture(spark, sf, "point"), fixture(spark, sf, "region_note"))
    return rounded(n.select("point_id", "place_id", "km", "own", "summary", F.array_join("linked", "|").alias("linked"), F.array_join("unlinked", "|").alias("unlinked")), "km", places=4)
