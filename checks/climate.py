"""Weather cycles, per-cycle metrics and climatology."""
from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import FIXTURES, fixture, oracle, query
from graftline import fixed_values as fx
from graftline.functions import weather as wx
from graftline.operators import climatology as cl
from graftline.operators import cycles as cy
from graftline.plans.place_features import place_features

# Daily weather per region from shipments.  Values are multiples of 1/8, so sums are exact in any order.
FIXTURES["ship_days"] = """
SELECT n.n_regionkey AS place_id, CAST(l.l_shipdate AS DATE) AS day, count(*) AS n, sum(l.l_quantity) AS q,
       sum(CAST(floor(l.l_tax * 100e0 + 0.5e0) AS BIGINT)) AS tax, sum(CAST(floor(l.l_discount * 100e0 + 0.5e0) AS BIGINT)) AS disc
FROM {lineitem} l JOIN {supplier} s ON l.l_suppkey = s.s_suppkey JOIN {nation} n ON s.s_nationkey = n.n_nationkey
GROUP BY n.n_regionkey, CAST(l.l_shipdate AS DATE)"""
FIXTURES["ship_means"] = """
SELECT place_id, day, n, tax, disc, dayofyear(day) AS doy, CASE WHEN place_id < 3 THEN 52e0 - 12e0 * place_id WHEN place_id = 3 THEN -41e0 ELSE -33e0 END AS lat,
       10.5e0 + 2e0 * place_id + 8e0 * cos(2e0 * pi() * (dayofyear(day) - CASE WHEN place_id < 3 THEN 200 ELSE 17 END) / 365.25e0) + (q / n - 25e0) / 4e0 AS m,
       3e0 + (n % 5) * 0.5e0 AS half
FROM {ship_days}"""
FIXTURES["weather_daily"] = """
SELECT place_id, lat, day,
       CASE WHEN (place_id * 53 + doy) % 331 = 0 THEN NULL WHEN (place_id + doy) % 293 = 0 THEN floor((m - half) * 8e0 + 0.5e0) / 8e0 ELSE floor((m + half) * 8e0 + 0.5e0) / 8e0 END AS tmax,
       CASE WHEN (place_id * 31 + doy) % 317 = 0 THEN NULL WHEN (place_id + doy) % 293 = 0 THEN floor((m + half) * 8e0 + 0.5e0) / 8e0 ELSE floor((m - half) * 8e0 + 0.5e0) / 8e0 END AS tmin,
       CASE WHEN n % 7 = 0 THEN NULL WHEN n % 3 = 0 THEN floor(2e0 * tax / n * 8e0 + 0.5e0) / 8e0 ELSE 0e0 END AS prcp
FROM {ship_means}"""
FIXTURES["humidity_daily"] = """
SELECT place_id, day, floor((m - half) * 8e0 + 0.5e0) / 8e0 AS tmin,
       floor((m - half) * 8e0 + 0.5e0) / 8e0 - floor(0.4e0 * disc / n * 8e0 + 0.5e0) / 8e0 AS dew,
       CASE WHEN n % 3 = 0 THEN floor(2e0 * tax / n * 8e0 + 0.5e0) / 8e0 ELSE 0e0 END AS prcp, CAST(3 + n % 10 AS DOUBLE) AS ph
FROM {ship_means} WHERE place_id <> 2 AND day >= DATE '1998-01-01' AND day < DATE '2001-01-01' AND month(day) <> 8"""
# The whole weather of all regions as one place, for the smallest scale factor.
FIXTURES["weather_one_place"] = """
SELECT 0 AS place_id, 46e0 AS lat, CAST(l.l_shipdate AS DATE) AS day,
       floor((14e0 + 9e0 * cos(2e0 * pi() * (dayofyear(CAST(l.l_shipdate AS DATE)) - 200) / 365.25e0) + (sum(l.l_quantity) / count(*) - 25e0) / 4e0) * 8e0 + 0.5e0) / 8e0 AS tmax,
       floor((6e0 + 9e0 * cos(2e0 * pi() * (dayofyear(CAST(l.l_shipdate AS DATE)) - 200) / 365.25e0) + (sum(l.l_quantity) / count(*) - 25e0) / 4e0) * 8e0 + 0.5e0) / 8e0 AS tmin,
       CASE WHEN count(*) % 3 = 0 THEN 4e0 ELSE 0e0 END AS prcp
FROM {lineitem} l GROUP BY CAST(l.l_shipdate AS DATE)"""

# ---- oracle building blocks ---------------------------------------------------
HOUR = "((tmax + tmin) / 2 + (tmax - tmin) / 2 * cos(2 * pi() * (h + 0.5 - 15) / 24))"


def day_sum(term: str) -> str:
    """Sum over the 24 hours of a day; `t` in the term is the temperature of the hour."""
    return "list_sum([" + term.replace("{t}", HOUR) + " for h in range(24)])"


def es(t: str) -> str:
    return f"(0.6108 * exp(17.27 * ({t}) / (({t}) + 237.3)))"


def mills(t: str) -> str:
    return (f"CASE WHEN {t} <= 1 THEN NULL WHEN {t} < 4 THEN 40 WHEN {t} < 6 THEN 30 WHEN {t} < 8 THEN 21 WHEN {t} < 10 THEN 17 "
            f"WHEN {t} < 12 THEN 14 WHEN {t} < 14 THEN 12 WHEN {t} < 16 THEN 10 WHEN {t} < 24 THEN 9 WHEN {t} < 26 THEN 11 WHEN {t} < 28 THEN 16 END")


CHILL = ("greatest(" + day_sum("CASE WHEN {t} < 1.4 THEN 0 WHEN {t} < 2.5 THEN 0.5 WHEN {t} < 9.2 THEN 1 WHEN {t} < 12.5 THEN 0.5 ELSE 0 END")
         + ", 0.5 * " + day_sum("CASE WHEN {t} < 9.2 THEN 1 ELSE 0 END") + ")::DOUBLE")
H72 = day_sum("CASE WHEN {t} <= 7.2 THEN 1 ELSE 0 END") + "::DOUBLE"
DH = day_sum("CASE WHEN {t} > 18.3 THEN {t} - 18.3 ELSE 0 END")
RA_DEC = "(0.409 * sin(2 * pi() * rdoy / 365 - 1.39))"
RA_WS = f"acos(greatest(-1, least(1, -tan(lat * pi() / 180) * tan({RA_DEC}))))"
RA = (f"(0.408 * (24 * 60 / pi()) * 0.082 * (1 + 0.033 * cos(2 * pi() * rdoy / 365)) * ({RA_WS} * sin(lat * pi() / 180) * sin({RA_DEC}) "
      f"+ cos(lat * pi() / 180) * cos({RA_DEC}) * sin({RA_WS})))")
ET0 = f"greatest(0, 0.0023 * {RA} * ((tmax + tmin) / 2 + 17.8) * sqrt(greatest(0, tmax - tmin)))"


def filled(daily: str = "weather_daily", min_valid: int = 345) -> str:
    """CTEs up to `filled`: one gap-free row per (place_id, vy, vi)."""
    return f"""
raw AS (SELECT place_id, lat, day, tmax, tmin, prcp, year(day) AS y, dayofyear(make_date(2001, month(day), dayofmonth(day))) - 1 AS di
        FROM {daily} WHERE NOT (month(day) = 2 AND dayofmonth(day) = 29)),
cyc AS (SELECT place_id, lat, CASE WHEN lat >= 0 OR di >= 181 THEN y ELSE y - 1 END AS vy,
        CASE WHEN lat >= 0 THEN di WHEN di >= 181 THEN di - 181 ELSE di + 184 END AS vi, tmax, tmin, prcp FROM raw),
good AS (SELECT place_id, vy, any_value(lat) AS lat FROM cyc GROUP BY place_id, vy HAVING count(CASE WHEN tmax IS NOT NULL AND tmin IS NOT NULL THEN 1 END) >= {min_valid}),
dense AS (SELECT g.place_id, g.lat, g.vy, d.vi::INT AS vi, c.tmax, c.tmin, c.prcp FROM good g CROSS JOIN (SELECT unnest(range(365)) AS vi) d
          LEFT JOIN cyc c ON c.place_id = g.place_id AND c.vy = g.vy AND c.vi = d.vi),
near AS (SELECT *, last_value(CASE WHEN tmax IS NOT NULL THEN vi END IGNORE NULLS) OVER a AS xi0, last_value(tmax IGNORE NULLS) OVER a AS xv0,
         first_value(CASE WHEN tmax IS NOT NULL THEN vi END IGNORE NULLS) OVER b AS xi1, first_value(tmax IGNORE NULLS) OVER b AS xv1,
         last_value(CASE WHEN tmin IS NOT NULL THEN vi END IGNORE NULLS) OVER a AS ni0, last_value(tmin IGNORE NULLS) OVER a AS nv0,
         first_value(CASE WHEN tmin IS NOT NULL THEN vi END IGNORE NULLS) OVER b AS ni1, first_value(tmin IGNORE NULLS) OVER b AS nv1
         FROM dense WINDOW a AS (PARTITION BY place_id, vy ORDER BY vi ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                           b AS (PARTITION BY place_id, vy ORDER BY vi ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
lines AS (SELECT place_id, lat, vy, vi, coalesce(prcp, 0) AS prcp,
          CASE WHEN tmax IS NOT NULL THEN tmax WHEN xv0 IS NULL THEN xv1 WHEN xv1 IS NULL THEN xv0 ELSE xv0 + (xv1 - xv0) * (vi - xi0) / (xi1 - xi0) END AS a,
          CASE WHEN tmin IS NOT NULL THEN tmin WHEN nv0 IS NULL THEN nv1 WHEN nv1 IS NULL THEN nv0 ELSE nv0 + (nv1 - nv0) * (vi - ni0) / (ni1 - ni0) END AS b FROM near),
filled AS (SELECT place_id, lat, vy, vi, prcp, greatest(a, b) AS tmax, least(a, b) AS tmin, (a + b) / 2 AS tmean,
           month(make_date(2001, 1, 1) + ((CASE WHEN lat < 0 THEN vi + 181 ELSE vi END) % 365)::INT) - 1 AS cm,
           CASE WHEN lat < 0 THEN (vi + 181) % 365 + 1 ELSE vi + 1 END AS rdoy FROM lines)"""


# monthly normals, humidity climatology and the dew gap of every place and month
MONTHLY = """
mrows AS (SELECT place_id, any_value(lat) AS lat, month(day) AS mon, avg(CASE WHEN tmin IS NOT NULL THEN tmax END) AS tmax, avg(CASE WHEN tmax IS NOT NULL THEN tmin END) AS tmin,
          avg((tmax + tmin) / 2) AS tmean, coalesce(sum(prcp), 0) AS rain FROM weather_daily GROUP BY place_id, month(day)),
span AS (SELECT place_id, (date_diff('day', min(day), max(day)) + 1) / 365.25 AS yrs, min(day) AS d0, max(day) AS d1 FROM weather_daily GROUP BY place_id),
normals AS (SELECT m.place_id, m.lat, mon, tmax, tmin, tmean, rain / yrs AS rain FROM mrows m JOIN span USING (place_id))"""
DEW = """
hrows AS (SELECT place_id, month(day) AS mon, greatest(-1, least(14, avg(tmin - dew))) AS gap,
          greatest(3, least(20, avg(CASE WHEN prcp >= 1 THEN ph END))) AS hours, count(CASE WHEN prcp >= 1 THEN ph END) AS nh FROM humidity_daily GROUP BY place_id, month(day)),
hplaces AS (SELECT DISTINCT place_id FROM hrows),
dew AS (SELECT n.place_id, n.mon, CASE WHEN p.place_id IS NULL THEN greatest(0, least(2.5, 2.5 * (1 - n.rain / 50))) ELSE coalesce(h.gap, 2) END AS gap,
        CASE WHEN p.place_id IS NULL OR h.nh IS NULL OR h.nh = 0 THEN 9 ELSE h.hours END AS hours, p.place_id IS NULL AS estimated
        FROM normals n LEFT JOIN hplaces p USING (place_id) LEFT JOIN hrows h ON h.place_id = n.place_id AND h.mon = n.mon)"""
KGAP = "(tmin - gap)"
RH = f"least(100, 100 * {es(KGAP)} / {es('{t}')})"
WET = f"""
wetted AS (SELECT f.*, d.gap, d.hours, {day_sum(RH)} / 24 AS rh, least(100, 100 * {es(KGAP)} / {es('tmin')}) AS rhn,
           {day_sum('CASE WHEN ' + RH + ' >= 90 THEN 1 ELSE 0 END')}::DOUBLE AS dew FROM filled f JOIN dew d ON d.place_id = f.place_id AND d.mon = f.cm + 1),
rained AS (SELECT *, CASE WHEN prcp >= 1 THEN least(22, hours + 1.5 + CASE WHEN prcp > 10 THEN least(4, (prcp - 10) / 5) ELSE 0 END) WHEN prcp >= 0.3 THEN 0.5 * hours ELSE 0 END AS rainw FROM wetted),
days AS (SELECT *, least(24, greatest(dew, rainw) + 0.25 * least(dew, rainw)) AS lwd, {CHILL} AS chill, {H72} AS h72, {DH} AS dh, {ET0} AS et0,
         greatest(0, least(25, tmean - 5)) AS gdd FROM rained)"""
BARE_DAYS = f"days AS (SELECT *, {CHILL} AS chill, {H72} AS h72 FROM filled)"
SEASON = """
both_years AS (SELECT *, vy AS cycle, vi AS ci FROM days UNION ALL SELECT *, vy + 1 AS cycle, vi - 365 AS ci FROM days WHERE vi >= 273),
usable AS (SELECT place_id, cycle FROM both_years GROUP BY place_id, cycle HAVING count(CASE WHEN ci >= 0 THEN 1 END) > 0 AND count(CASE WHEN ci < 0 THEN 1 END) > 0),
s0 AS (SELECT b.* FROM both_years b JOIN usable u USING (place_id, cycle)),
s1 AS (SELECT *, sum(CASE WHEN ci BETWEEN -61 AND 89 THEN chill END) OVER (PARTITION BY place_id, cycle) AS chill_total,
       sum(CASE WHEN ci BETWEEN -61 AND 89 THEN chill ELSE 0 END) OVER (PARTITION BY place_id, cycle ORDER BY ci) AS run_chill FROM s0),
s2 AS (SELECT *, coalesce(min(CASE WHEN ci BETWEEN 0 AND 89 AND run_chill >= least(800, 0.85::DOUBLE * chill_total) THEN ci END) OVER (PARTITION BY place_id, cycle), 89) AS gate_vi FROM s1),
s3 AS (SELECT *, sum(CASE WHEN ci BETWEEN greatest(32, gate_vi) AND 200 THEN greatest(0, tmean - 5) ELSE 0 END) OVER (PARTITION BY place_id, cycle ORDER BY ci) AS forcing FROM s2),
s4 AS (SELECT *, min(CASE WHEN ci BETWEEN greatest(32, gate_vi) AND 200 AND forcing >= 220 THEN ci END) OVER (PARTITION BY place_id, cycle) AS bloom FROM s3),
s5 AS (SELECT *, min(CASE WHEN ci >= bloom + 60 AND tmin <= -2.2 THEN ci END) OVER (PARTITION BY place_id, cycle) AS freeze_vi FROM s4),
season AS (SELECT *, coalesce(freeze_vi, CASE WHEN bloom IS NOT NULL THEN least(364, bloom + 290) END) AS end_vi FROM s5)"""
WINTER = """sum(CASE WHEN ci BETWEEN -61 AND 89 THEN chill END) AS chill, sum(CASE WHEN ci BETWEEN -61 AND 89 THEN h72 END) AS chill_hours, any_value(gate_vi) AS gate_vi,
 min(CASE WHEN ci <= 119 THEN tmin END) - 2 AS winter_min, count(CASE WHEN ci <= 89 AND prcp >= 1 AND tmean BETWEEN 2 AND 16 THEN 1 END) AS canker_days, any_value(bloom) AS bloom"""
BOTH = ("weather_daily", "humidity_daily")
TO_DAYS = filled() + "," + MONTHLY + "," + DEW + "," + WET
TO_SEASON = TO_DAYS + "," + SEASON


def r(*cols: str, places: int = 6) -> str:
    return ", ".join(f"round({c}, {places}) AS {c}" for c in cols)


def rounded(df, *cols: str, places: int = 6):
    for c in cols:
        df = df.withColumn(c, F.round(c, places))
    return df


def joined(array, places: int = 4):
    """An array of numbers as text (both engines format the rounded values as integers of 10^-places)."""
    return F.array_join(F.transform(array, lambda x: F.round(x * 10**places).cast("bigint").cast("string")), ",", "null")


def joined_sql(array: str, places: int = 4) -> str:
    return f"array_to_string(list_transform({array}, lambda x: coalesce(CAST(round(x * {10**places}) AS BIGINT)::VARCHAR, 'null')), ',')"


def _weather(spark, sf):
    return fixture(spark, sf, "weather_daily")


def _dew(spark, sf):
    return cl.dew_terms(cl.monthly_normals(_weather(spark, sf)), cl.humidity_climatology(fixture(spark, sf, "humidity_daily")))


def _season(spark, sf):
    return cy.season_days(_weather(spark, sf), _dew(spark, sf))


# ---- queries --------------------------------------------------------------------
def chill_and_bloom_smoke(spark, sf):
    out = cy.chill_and_bloom(fixture(spark, sf, "weather_one_place"), min_valid=300)
    return rounded(out.drop("lat", "southern"), "chill", "winter_min")


@query("weather_cycles", oracle(["weather_daily"], "SELECT place_id, vy, vi, cm AS cmonth, round(tmax, 6) AS tmax, round(tmin, 6) AS tmin, round(tmean, 6) AS tmean, prcp FROM filled", filled()))
def weather_cycles(spark, sf):
    return rounded(cy.filled_cycles(_weather(spark, sf)).drop("lat", "southern"), "tmax", "tmin", "tmean")


@query("winter_chill_and_bloom", oracle(["weather_daily"], f"SELECT place_id, cycle, {WINTER} FROM season GROUP BY place_id, cycle", filled() + "," + BARE_DAYS + "," + SEASON))
def winter_chill_and_bloom(spark, sf):
    return cy.chill_and_bloom(_weather(spark, sf)).drop("lat", "southern")


@query("day_weather", oracle(BOTH, f"""SELECT place_id, vy, vi, round(rh, 3) AS rh, round(rhn, 3) AS rhn, dew, round(lwd, 3) AS lwd, {mills('tmean')}::DOUBLE AS mills,
 chill, h72, round(dh, 3) AS dh, round(gdd, 6) AS gdd, round(et0, 3) AS et0, round({RA}, 3) AS ra FROM days""", TO_DAYS))
def day_weather(spark, sf):
    days = cy.with_day_terms(cy.with_leaf_wetness(cy.filled_cycles(_weather(spark, sf)), _dew(spark, sf)))
    doy = F.when(F.col("southern"), (F.col("vi") + 181) % 365 + 1).otherwise(F.col("vi") + 1)
    out = days.withColumn("mills", wx.mills_hours("tmean")).withColumn("ra", wx.extraterrestrial_radiation("lat", doy))
    out = rounded(rounded(out, "gdd"), "rh", "rhn", "lwd", "dh", "et0", "ra", places=3)
    return out.select("place_id", "vy", "vi", "rh", "rhn", "dew", "lwd", "mills", "chill", "h72", "dh", "gdd", "et0", "ra")


@query("bloom_frost", oracle(BOTH, """SELECT s.place_id, s.cycle, g.g AS flower_group, count(CASE WHEN tmin <= 1.5 THEN 1 END) AS frost_nights, round(min(tmin), 6) AS frost_min,
 count(CASE WHEN tmin <= 1.5 THEN 1 END) > 0 AS hit FROM season s JOIN (SELECT unnest(range(1, 8)) AS g) g
 ON ci BETWEEN greatest(0, bloom + 3 * (g.g - 3) - 2) AND least(364, bloom + 3 * (g.g - 3) + 14) GROUP BY s.place_id, s.cycle, g.g""", TO_SEASON))
def bloom_frost(spark, sf):
    return rounded(cy.bloom_frost(cy.cycle_metrics(_season(spark, sf), ["frost"])), "frost_min")


GROWN = """grown AS (SELECT *, sum(CASE WHEN ci >= bloom THEN gdd ELSE 0 END) OVER (PARTITION BY place_id, cycle ORDER BY ci) AS g FROM season)"""
CURVE = """list_transform(range(27), lambda k: coalesce(list_extract(list(g - gdd ORDER BY ci) FILTER (WHERE ci BETWEEN bloom AND least(364, bloom + 260) AND (ci - bloom) % 10 = 0), k + 1),
 list_extract(list(g - gdd ORDER BY ci) FILTER (WHERE ci BETWEEN bloom AND least(364, bloom + 260) AND (ci - bloom) % 10 = 0), -1)))"""
SEASON_AGG = f"""any_value(bloom) AS bloom, any_value(end_vi) AS end_vi, any_value(freeze_vi) AS freeze_vi, any_value(end_vi) - any_value(bloom) AS season_days,
 coalesce(nullif(max(CASE WHEN ci <= end_vi AND end_vi <= bloom + 260 THEN g END), 0), max(CASE WHEN ci <= least(364, bloom + 260) THEN g END)) AS gdd_total, {CURVE} AS gdd_curve,
 coalesce(max(CASE WHEN ci >= 0 AND ci < least(200, bloom + 40) AND tmin <= 2.5 THEN ci END), -1) AS last_frost,
 coalesce(min(CASE WHEN ci >= bloom + 60 AND tmin <= 2.5 THEN ci END), 365) AS first_frost,
 count(CASE WHEN ci BETWEEN bloom + 30 AND least(364, bloom + 210) AND tmax >= 32 THEN 1 END) AS hot32, count(CASE WHEN ci BETWEEN bloom + 30 AND least(364, bloom + 210) AND tmax >= 35 THEN 1 END) AS hot35,
 count(CASE WHEN ci BETWEEN bloom + 30 AND least(364, bloom + 210) AND tmax >= 38 THEN 1 END) AS hot38, avg(CASE WHEN ci BETWEEN 227 AND 273 THEN tmin END) AS fall_tmin"""


@query("season_and_heat", oracle(BOTH, f"""SELECT place_id, cycle, bloom, end_vi, freeze_vi, season_days, round(gdd_total, 6) AS gdd_total, {joined_sql('gdd_curve', 3)} AS gdd_curve, last_frost, first_frost,
 hot32, hot35, hot38, round(fall_tmin, 6) AS fall_tmin, first_frost - greatest(0, last_frost) AS frost_free_days FROM (SELECT place_id, cycle, {SEASON_AGG} FROM grown WHERE bloom IS NOT NULL GROUP BY place_id, cycle)""", TO_SEASON + "," + GROWN))
def season_and_heat(spark, sf):
    m = cy.cycle_metrics(_season(spark, sf), ["season"]).where("bloom IS NOT NULL").withColumn("gdd_curve", joined(F.col("gdd_curve"), 3))
    m = rounded(m, "gdd_total", "fall_tmin")
    return m.select("place_id", "cycle", "bloom", "end_vi", "freeze_vi", "season_days", "gdd_total", "gdd_curve", "last_frost", "first_frost",
                    "hot32", "hot35", "hot38", "fall_tmin", "frost_free_days")


BLIGHT = """blighted AS (SELECT *, sum(CASE WHEN ci BETWEEN greatest(0, bloom - 7) AND least(364, bloom + 14) THEN dh ELSE 0 END) OVER (PARTITION BY place_id, cycle ORDER BY ci) AS run_dh FROM grown)"""
SPRING = "ci BETWEEN greatest(0, bloom - 20) AND least(364, bloom + 60)"
WET_AGG = f"""count(CASE WHEN {SPRING} AND prcp >= 1 THEN 1 END) AS spring_wet_days, avg(CASE WHEN {SPRING} THEN tmean END) AS spring_t, avg(CASE WHEN {SPRING} THEN lwd END) AS lwd_spring,
 count(CASE WHEN ci BETWEEN greatest(0, bloom - 7) AND least(364, bloom + 14) AND run_dh >= 110 AND tmean >= 15.6 AND (prcp >= 0.25 OR dew >= 6) THEN 1 END) AS fire_blight_days,
 avg(CASE WHEN ci BETWEEN bloom AND least(364, bloom + 90) THEN CASE WHEN tmean BETWEEN 10 AND 25 AND prcp < 1 AND rhn >= 60 THEN 1 ELSE 0 END END) AS mildew_idx,
 list_reduce(list_prepend({{'acc': 0::DOUBLE, 'n': 0::BIGINT, 'lwd': 0::DOUBLE, 'need': 0::DOUBLE}}, list({{'acc': 0::DOUBLE, 'n': 0::BIGINT, 'lwd': lwd::DOUBLE, 'need': coalesce({mills('tmean')}, 1e9)::DOUBLE}} ORDER BY ci) FILTER (WHERE {SPRING})),
  lambda s, p: {{'acc': CASE WHEN p.lwd < 7 OR s.acc + p.lwd >= p.need THEN 0 ELSE s.acc + p.lwd END, 'n': s.n + CASE WHEN p.lwd >= 7 AND s.acc + p.lwd >= p.need THEN 1 ELSE 0 END, 'lwd': p.lwd, 'need': p.need}}).n AS scab_events"""


@query("spring_wetness_and_disease", oracle(BOTH, f"""SELECT place_id, cycle, spring_wet_days, round(spring_t, 6) AS spring_t, round(lwd_spring, 6) AS lwd_spring, scab_events, fire_blight_days, round(mildew_idx, 6) AS mildew_idx
 FROM (SELECT place_id, cycle, {WET_AGG} FROM blighted WHERE bloom IS NOT NULL GROUP BY place_id, cycle)""", TO_SEASON + "," + GROWN + "," + BLIGHT))
def spring_wetness_and_disease(spark, sf):
    m = cy.cycle_metrics(_season(spark, sf), ["wetness"]).where("bloom IS NOT NULL")
    return rounded(m.select("place_id", "cycle", "spring_wet_days", "spring_t", "lwd_spring", "scab_events", "fire_blight_days", "mildew_idx"),
                   "spring_t", "lwd_spring", "mildew_idx")


WATER_AGG = """sum(CASE WHEN ci BETWEEN bloom AND end_vi THEN prcp END) AS gs_precip, sum(CASE WHEN ci BETWEEN bloom AND end_vi THEN 0.9 * et0 END) AS gs_et0,
 avg(CASE WHEN ci BETWEEN bloom AND end_vi THEN rh END) AS rh_gs, count(CASE WHEN ci >= 0 AND prcp >= 1 AND tmean < 0.5 THEN 1 END) AS snow_days"""


@query("water_balance_and_snow", oracle(BOTH, f"""SELECT place_id, cycle, round(gs_precip, 3) AS gs_precip, round(gs_et0, 3) AS gs_et0, round(rh_gs, 3) AS rh_gs, snow_days
 FROM (SELECT place_id, cycle, {WATER_AGG} FROM season WHERE bloom IS NOT NULL GROUP BY place_id, cycle)""", TO_SEASON))
def water_balance_and_snow(spark, sf):
    m = cy.cycle_metrics(_season(spark, sf), ["water"]).where("bloom IS NOT NULL")
    return rounded(m.select("place_id", "cycle", "gs_precip", "gs_et0", "rh_gs", "snow_days"), "gs_precip", "gs_et0", "rh_gs", places=3)


KOPPEN_SQL = """
kin AS (SELECT place_id, any_value(lat) < 0 AS south, list(tmean ORDER BY mon) AS t, list(rain ORDER BY mon) AS p FROM normals GROUP BY place_id),
kp AS (SELECT *, list_avg(t) AS tann, list_sum(p) AS pann, list_max(t) AS tx, list_min(t) AS tn, list_min(p) AS pmin,
       CASE WHEN south THEN [p[10], p[11], p[12], p[1], p[2], p[3]] ELSE p[4:9] END AS ps, CASE WHEN south THEN p[4:9] ELSE [p[10], p[11], p[12], p[1], p[2], p[3]] END AS pw FROM kin),
kq AS (SELECT *, CASE WHEN list_sum(pw) >= 0.7 * pann THEN 2 * tann WHEN list_sum(ps) >= 0.7 * pann THEN 2 * tann + 28 ELSE 2 * tann + 14 END AS pth, list_position(p, pmin) - 1 AS dry FROM kp),
kcode AS (SELECT *, CASE WHEN tx < 10 THEN CASE WHEN tx < 0 THEN 'EF' ELSE 'ET' END
  WHEN pann < 10 * pth THEN CASE WHEN pann < 5 * pth THEN 'BW' ELSE 'BS' END || CASE WHEN tann >= 18 THEN 'h' ELSE 'k' END
  WHEN tn >= 18 THEN CASE WHEN pmin >= 60 THEN 'Af' WHEN pann >= 25 * (100 - pmin) THEN 'Am' WHEN (south AND dry BETWEEN 9 AND 11) OR (NOT south AND dry BETWEEN 3 AND 8) THEN 'As' ELSE 'Aw' END
  ELSE CASE WHEN tn > 0 THEN 'C' ELSE 'D' END || CASE WHEN list_min(ps) < 40 AND list_min(ps) < list_max(pw) / 3 THEN 's' WHEN list_min(pw) < list_max(ps) / 10 THEN 'w' ELSE 'f' END
   || CASE WHEN tx >= 22 THEN 'a' WHEN len(list_filter(t, lambda x: x >= 10)) >= 4 THEN 'b' WHEN tn > -38 THEN 'c' ELSE 'd' END END AS code FROM kq)"""
KOPPEN_NAME_SQL = "CASE code " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fx.KOPPEN_NAMES.items()) + " ELSE code END"


@query("monthly_normals", oracle(["weather_daily"], f"""SELECT k.place_id, round(tann, 6) AS tann, round(pann, 6) AS pann, code AS koppen_code, {KOPPEN_NAME_SQL} AS koppen_name,
 (SELECT {joined_sql('list(tmax ORDER BY mon)', 3)} FROM normals n WHERE n.place_id = k.place_id) AS tmax_m, (SELECT {joined_sql('list(tmin ORDER BY mon)', 3)} FROM normals n WHERE n.place_id = k.place_id) AS tmin_m,
 {joined_sql('t', 3)} AS tmean_m, {joined_sql('p', 3)} AS prcp_m, year(d0)::VARCHAR || '-' || (year(d0) + floor(yrs + 0.5)::INT - 1)::VARCHAR AS period FROM kcode k JOIN span USING (place_id)""", MONTHLY + "," + KOPPEN_SQL))
def monthly_normals(spark, sf):
    n = rounded(cl.monthly_normals(_weather(spark, sf)), "tann", "pann")
    for c in ("tmax_m", "tmin_m", "tmean_m", "prcp_m"):
        n = n.withColumn(c, joined(F.col(c), 3))
    return n.select("place_id", "tann", "pann", "koppen_code", "koppen_name", "tmax_m", "tmin_m", "tmean_m", "prcp_m", "period")


# climate classes over many kinds of climate: monthly normals of every customer from its key and balance
FIXTURES["climate_kinds"] = ("SELECT c_custkey AS place_id, c_custkey % 2 = 1 AS southern, " + "list_value("
                             + ", ".join(f"-20e0 + (c_custkey % 50) + (2e0 + (c_custkey * 7) % 16) * cos(2e0 * pi() * ({m} - CASE WHEN c_custkey % 2 = 1 THEN 0 ELSE 6 END) / 12e0)" for m in range(12)) + ") AS tmean_m, list_value("
                             + ", ".join(f"CAST((c_custkey * {3 + m} + {m * m}) % (1 + c_custkey % 211) AS DOUBLE)" for m in range(12)) + ") AS prcp_m FROM {customer}")


@query("climate_classes", oracle(["climate_kinds"], f"SELECT place_id, code AS koppen_code, {KOPPEN_NAME_SQL} AS koppen_name FROM kcode",
                                 KOPPEN_SQL.replace("SELECT place_id, any_value(lat) < 0 AS south, list(tmean ORDER BY mon) AS t, list(rain ORDER BY mon) AS p FROM normals GROUP BY place_id",
                                                    "SELECT place_id, southern AS south, tmean_m AS t, prcp_m AS p FROM climate_kinds")))
def climate_classes(spark, sf):
    k = fixture(spark, sf, "climate_kinds").withColumn("koppen_code", wx.koppen("tmean_m", "prcp_m", "southern"))
    return k.select("place_id", "koppen_code", wx.koppen_name("koppen_code").alias("koppen_name"))


@query("humidity_climatology", oracle(BOTH, f"SELECT place_id, {joined_sql('list(gap ORDER BY mon)')} AS dew_gap, {joined_sql('list(hours ORDER BY mon)')} AS rain_hours, any_value(estimated) AS estimated FROM dew GROUP BY place_id", MONTHLY + "," + DEW))
def humidity_climatology(spark, sf):
    d = _dew(spark, sf)
    return d.select("place_id", joined(F.col("dew_gap")).alias("dew_gap"), joined(F.col("rain_hours")).alias("rain_hours"), "estimated")


@query("nodata_gate", oracle(["weather_daily"], "SELECT place_id, count(*) AS n_days, round(avg(CASE WHEN tmax IS NULL THEN 1 ELSE 0 END), 6) AS null_share, avg(CASE WHEN tmax IS NULL THEN 1 ELSE 0 END) > 0.3 AS no_data FROM weather_daily GROUP BY place_id"))
def nodata_gate(spark, sf):
    return rounded(cy.nodata_gate(_weather(spark, sf)), "null_share", places=6)


VI_DI = "((floor({v} + 0.5)::INT + CASE WHEN {s} THEN 181 ELSE 0 END) % 365)"


def vi_label_sql(v: str, s: str) -> str:
    d = f"(DATE '2001-01-01' + {VI_DI.format(v=v, s=s)})"
    return f"CASE WHEN {v} IS NULL THEN '-' ELSE strftime({d}, '%b') || ' ' || dayofmonth({d})::VARCHAR END"


NCDF_T = "(1 / (1 + 0.2316419 * abs({z})))"
NCDF = ("CASE WHEN {z} > 0 THEN 1 - {p} ELSE {p} END")


def ncdf(z: str) -> str:
    t = f"(1 / (1 + 0.2316419 * abs({z})))"
    p = f"(0.3989423 * exp(-({z}) * ({z}) / 2) * {t} * (0.3193815 + {t} * (-0.3565638 + {t} * (1.781478 + {t} * (-1.821256 + {t} * 1.330274)))))"
    return f"CASE WHEN {z} > 0 THEN 1 - {p} ELSE {p} END"


SUMMARY = f"""
cm AS (SELECT place_id, cycle, any_value(lat) < 0 AS south, {WINTER} FROM blighted GROUP BY place_id, cycle),
cb AS (SELECT place_id, cycle, {SEASON_AGG}, {WET_AGG}, {WATER_AGG} FROM blighted WHERE bloom IS NOT NULL GROUP BY place_id, cycle),
call AS (SELECT cm.*, cb.* EXCLUDE (place_id, cycle, bloom), first_frost - greatest(0, last_frost) AS frost_free_days FROM cm LEFT JOIN cb USING (place_id, cycle)),
fg AS (SELECT s.place_id, s.cycle, g.g, count(CASE WHEN tmin <= 1.5 THEN 1 END) AS n, min(tmin) AS low FROM season s JOIN (SELECT unnest(range(1, 8)) AS g) g
  ON ci BETWEEN greatest(0, bloom + 3 * (g.g - 3) - 2) AND least(364, bloom + 3 * (g.g - 3) + 14) GROUP BY s.place_id, s.cycle, g.g),
fp AS (SELECT place_id, g, avg(CASE WHEN n > 0 THEN 1 ELSE 0 END) AS emp, avg(n) AS nights, avg(low) AS mu, greatest(1.2, coalesce(stddev_samp(low), 0)) AS sd FROM fg GROUP BY place_id, g),
fz AS (SELECT place_id, g, emp, nights, mu, (1.5 - mu) / sd AS z FROM fp),
fa AS (SELECT place_id, list(0.5 * emp + 0.5 * ({ncdf('z')}) ORDER BY g) AS frost_p, list(nights ORDER BY g) AS frost_nights, list(mu ORDER BY g) AS frost_min FROM fz GROUP BY place_id),
cv AS (SELECT place_id, list(floor(v + 0.5) ORDER BY k) AS gdd_curve FROM (SELECT place_id, k, avg(gdd_curve[k + 1]) AS v FROM call, (SELECT unnest(range(27)) AS k) ks WHERE bloom IS NOT NULL GROUP BY place_id, k) GROUP BY place_id),
summ AS (SELECT place_id, any_value(south) AS southern, count(*) AS n_cycles, count(*) - count(bloom) AS no_bloom_years, count(bloom) AS n_bloom, avg(chill) AS chill_mean, quantile_cont(chill, 0.2) AS chill_p20, min(chill) AS chill_min, max(chill) AS chill_max,
  avg(chill_hours) AS chill_hours72, avg(winter_min) AS ext_min_mean, min(winter_min) AS ext_min_abs, avg(bloom) AS bloom_vi, coalesce(stddev_samp(bloom), 0) AS bloom_sd,
  avg(CASE WHEN last_frost >= 0 THEN last_frost END) AS last_spring_vi, count(CASE WHEN last_frost >= 0 THEN 1 END) AS nlf,
  list(floor(gdd_total + 0.5) ORDER BY cycle) FILTER (WHERE bloom IS NOT NULL) AS gend_per, quantile_cont(gdd_total, 0.5) AS gend_median, quantile_cont(gdd_total, 0.2) AS gend_p20, avg(end_vi) AS end_vi, avg(season_days) AS season_days,
  count(freeze_vi) AS freezes, avg(freeze_vi) AS freeze_vi, avg(hot32) AS hot32, avg(hot35) AS hot35, avg(hot38) AS hot38, avg(fall_tmin) AS fall_tmin, avg(spring_wet_days) AS spring_wet_days, avg(spring_t) AS spring_t,
  avg(canker_days) AS canker_days, avg(fire_blight_days) AS fire_blight_events, avg(mildew_idx) AS mildew_idx, avg(scab_events) AS scab_events, avg(lwd_spring) AS lwd_spring, avg(gs_precip) AS gs_precip, avg(gs_et0) AS gs_et0,
  avg(rh_gs) AS rh_gs, avg(snow_days) AS snow_days, avg(frost_free_days) AS frost_free_days FROM call GROUP BY place_id),
place AS (SELECT summ.* EXCLUDE (freeze_vi), fa.* EXCLUDE (place_id), cv.gdd_curve, gs_precip / greatest(1, gs_et0) AS aridity, freezes / n_bloom AS freeze_years, (ext_min_mean * 9 / 5 + 92) / 10 AS z,
  n_bloom = 0 AS no_bloom, ext_min_mean > 12 OR chill_mean < 30 AS tropical, {vi_label_sql('bloom_vi', 'southern')} AS bloom_label, {vi_label_sql('end_vi', 'southern')} AS end_label,
  CASE WHEN nlf < n_bloom / 2 THEN 'rarely' ELSE {vi_label_sql('last_spring_vi', 'southern')} END AS last_spring, CASE WHEN freezes > 0 THEN {vi_label_sql('freeze_vi', 'southern')} END AS first_freeze
  FROM summ LEFT JOIN fa USING (place_id) LEFT JOIN cv USING (place_id))"""
TO_PLACE = TO_SEASON + "," + GROWN + "," + BLIGHT + "," + SUMMARY
SUMMARY_NUMBERS = ("chill_mean chill_p20 chill_min chill_max chill_hours72 ext_min_mean ext_min_abs bloom_vi bloom_sd last_spring_vi gend_median gend_p20 end_vi season_days "
                   "hot32 hot35 hot38 fall_tmin spring_wet_days spring_t canker_days fire_blight_events mildew_idx scab_events lwd_spring gs_precip gs_et0 rh_gs snow_days frost_free_days "
                   "aridity freeze_years").split()
SUMMARY_ARRAYS = ["frost_p", "frost_nights", "frost_min", "gdd_curve", "gend_per"]


@query("place_summary", oracle(BOTH, f"""SELECT place_id, n_cycles, no_bloom_years, no_bloom, tropical, bloom_label, end_label, last_spring, first_freeze, round(greatest(0, z + 1), 3) AS zone_value,
 (CASE WHEN floor(z) + 1 < 1 THEN '<1' ELSE (floor(z)::INT + 1)::VARCHAR END) || CASE WHEN z - floor(z) >= 0.5 THEN 'b' ELSE 'a' END AS zone_label,
 {r(*SUMMARY_NUMBERS, places=3)}, {', '.join(joined_sql(a, 3) + ' AS ' + a for a in SUMMARY_ARRAYS)} FROM place""", TO_PLACE))
def place_summary(spark, sf):
    p = cl.summarise_cycles(cy.cycle_metrics(_season(spark, sf)))
    p = rounded(p, *SUMMARY_NUMBERS, "zone_value", places=3)
    for a in SUMMARY_ARRAYS:
        p = p.withColumn(a, joined(F.col(a), 3))
    return p.select("place_id", "n_cycles", "no_bloom_years", "no_bloom", "tropical", "bloom_label", "end_label", "last_spring", "first_freeze",
                    "zone_value", "zone_label", *SUMMARY_NUMBERS, *SUMMARY_ARRAYS)


@query("mean_gdd_curve", oracle(BOTH, """SELECT place_id, k * 10 AS days_after_bloom, floor(avg(gdd_curve[k + 1]) + 0.5)::BIGINT AS gdd FROM call, (SELECT unnest(range(27)) AS k) ks
 WHERE bloom IS NOT NULL GROUP BY place_id, k""", TO_PLACE))
def mean_gdd_curve(spark, sf):
    return cl.mean_curve(cy.cycle_metrics(_season(spark, sf), ["season"]))


@query("monthly_humidity", oracle(BOTH, "SELECT place_id, cm AS cmonth, round(avg(rh), 6) AS rh, round(avg(lwd), 6) AS lwd FROM season WHERE ci >= 0 AND bloom IS NOT NULL GROUP BY place_id, cm", TO_SEASON))
def monthly_humidity(spark, sf):
    return rounded(cy.humidity_by_month(_season(spark, sf)), "rh", "lwd")


@query("feature_status", oracle(BOTH, """SELECT g.place_id, count(DISTINCT g.vy) AS complete, CASE WHEN count(DISTINCT g.vy) < 3 OR any_value(p.no_bloom) IS NULL THEN 'not enough data'
 WHEN any_value(p.no_bloom) THEN 'no bloom' WHEN any_value(p.tropical) THEN 'tropical' ELSE 'ok' END AS status FROM good g LEFT JOIN place p USING (place_id) GROUP BY g.place_id""", TO_PLACE))
def feature_status(spark, sf):
    kept = cy.filter_complete(cy.to_cycles(_weather(spark, sf)))
    return cl.feature_status(kept, cl.summarise_cycles(cy.cycle_metrics(_season(spark, sf))))


@query("compact_place_features", oracle(BOTH, f"""SELECT p.place_id, k.code AS koppen_code, p.zone_lab AS zone_label, {', '.join(f'floor({c} * 100 + 0.5) / 100 AS {c}' for c in ('chill_mean', 'bloom_vi', 'aridity', 'tann', 'pann', 'tmax_hot'))}, d.est AS humidity_estimated,
 {joined_sql('list_transform(frost_p, lambda x: floor(x * 100 + 0.5) / 100)', 2)} AS frost_p, CASE WHEN p.no_bloom THEN NULL ELSE {joined_sql('list_transform(hm.rh, lambda x: floor(x * 100 + 0.5) / 100)', 2)} END AS rh_m, CASE WHEN p.no_bloom THEN NULL ELSE {joined_sql('list_transform(hm.lwd, lambda x: floor(x * 100 + 0.5) / 100)', 2)} END AS lwd_m
 FROM (SELECT *, (CASE WHEN floor(z) + 1 < 1 THEN '<1' ELSE (floor(z)::INT + 1)::VARCHAR END) || CASE WHEN z - floor(z) >= 0.5 THEN 'b' ELSE 'a' END AS zone_lab FROM place) p JOIN kcode k USING (place_id)
 JOIN (SELECT place_id, max(tmax) AS tmax_hot FROM normals GROUP BY place_id) x USING (place_id) JOIN (SELECT place_id, any_value(estimated) AS est FROM dew GROUP BY place_id) d USING (place_id)
 LEFT JOIN (SELECT place_id, list(rh ORDER BY cm) AS rh, list(lwd ORDER BY cm) AS lwd FROM (SELECT place_id, cm, avg(rh) AS rh, avg(lwd) AS lwd FROM season WHERE ci >= 0 AND bloom IS NOT NULL GROUP BY place_id, cm) GROUP BY place_id) hm USING (place_id)""", TO_PLACE + "," + KOPPEN_SQL))
def compact_place_features(spark, sf):
    f = cl.compact(place_features(_weather(spark, sf), fixture(spark, sf, "humidity_daily")), drop=("gend_per",))
    return f.select("place_id", "koppen_code", "zone_label", "chill_mean", "bloom_vi", "aridity", "tann", "pann", "tmax_hot", "humidity_estimated",
                    *[joined(F.col(c), 2).alias(c) for c in ("frost_p", "rh_m", "lwd_m")])
