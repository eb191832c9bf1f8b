"""Scoring, explanation, ranking and change queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from checks import orchard  # noqa: F401
from checks.base import fixture, oracle, query
from checks.climate import rounded
from graftline import fixed_values as fx
from graftline.operators import changes as ch
from graftline.operators import scoring as sc

REF = 5


def pw(x: str, pts) -> str:
    out = f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} <= {pts[0][0]} THEN {pts[0][1]}::DOUBLE"
    for (x0, y0), (x1, y1) in zip(pts, pts[1:]):
        out += f" WHEN {x} <= {x1} THEN {y0}::DOUBLE + ({y1}::DOUBLE - {y0}::DOUBLE) * ({x} - {x0}::DOUBLE) / ({x1}::DOUBLE - {x0}::DOUBLE)"
    return out + f" ELSE {pts[-1][1]}::DOUBLE END"


def bands(x: str, bs) -> str:
    return f"CASE WHEN {x} IS NULL THEN NULL " + " ".join(f"WHEN {x} >= {b} THEN '{w}'" for b, w in bs[:-1]) + f" ELSE '{bs[-1][1]}' END"


def half_up(x: str) -> str:
    return f"floor({x} + 0.5)::BIGINT"


MID = [float(m) for m in fx.MID_MONTH]
NORMAL = ("(SELECT list(CASE WHEN i = 0 OR i IS NULL THEN m[12] + (m[1] - m[12]) * ((d - 349.5 + 365) % 365) / 31.0 ELSE m[i] + (m[i + 1] - m[i]) * (d - mid[i]) / (mid[i + 1] - mid[i]) END ORDER BY d) "
          f"FROM (SELECT d, {MID}::DOUBLE[] AS mid, {{m}} AS m, CASE WHEN d >= 349.5 THEN NULL ELSE len(list_filter({MID}::DOUBLE[], lambda q: q <= d)) END AS i FROM (SELECT unnest(range(365)) AS d)))")
PLACES = f"""
nrm AS (SELECT place_id, {NORMAL.format(m='tmax_m')} AS nx, {NORMAL.format(m='tmin_m')} AS nn FROM site),
wins AS (SELECT s.*, n.nx, n.nn, CASE WHEN southern THEN 181 ELSE 0 END AS sh FROM site s JOIN nrm n USING (place_id)),
prep0 AS (SELECT *, list_sum([nx[(floor(bloom_vi + 0.5)::BIGINT + sh + 3 * k) % 365 + 1] for k in range(21)]) / 21 AS ax, list_sum([nn[(floor(bloom_vi + 0.5)::BIGINT + sh + 3 * k) % 365 + 1] for k in range(21)]) / 21 AS an,
  greatest(0, least(1, (scab_events - 8) / 26)) * ({pw('spring_t', fx.SCAB_TEMPERATURE_RAMP)}) AS p_scab, greatest(0, least(1, (canker_days - 25) / 60)) * CASE WHEN ext_min_mean > -28 THEN 1 ELSE 0.6::DOUBLE END AS p_canker,
  greatest(0, least(1, (mildew_idx - 0.25::DOUBLE) / 0.4::DOUBLE)) AS p_mildew, greatest(0, least(1, fire_blight_events / 4)) * CASE WHEN fire_blight_status = 'absent' THEN 0.1::DOUBLE ELSE 1 END AS p_fire_blight,
  CASE WHEN rust_present THEN greatest(0, least(1, (scab_events - 6) / 22)) * 0.9::DOUBLE ELSE 0 END AS p_rust FROM wins),
prep AS (SELECT *, (ax + an) / 2 AS t60 FROM prep0)"""
REFS = f"refp AS (SELECT bloom_vi AS rb, gdd_curve AS rc, t60 AS rt FROM prep WHERE place_id = {REF})"
PAIRS = f"""
pr0 AS (SELECT a.variety_id, a.place_id, v.* EXCLUDE (variety_id, name, country, place), v.name AS vname, p.* EXCLUDE (place_id), rb, rc, rt, CASE WHEN harvest_doy IS NOT NULL THEN greatest(0, least(26, (harvest_doy - rb) / 10)) END AS x FROM asked a JOIN variety v USING (variety_id) JOIN prep p USING (place_id), refp),
pr AS (SELECT *, CASE WHEN floor(x) >= 26 THEN rc[27] ELSE rc[floor(x)::INT + 1] + (rc[floor(x)::INT + 2] - rc[floor(x)::INT + 1]) * (x - floor(x)) END AS need, (harvest_doy - rb) * greatest(0.75::DOUBLE, least(1.2::DOUBLE, 1 - 0.025::DOUBLE * (t60 - rt))) AS days FROM pr0),
pq AS (SELECT *, bloom_vi + days AS hvi, CASE WHEN coalesce(chill_hours, 900) = 0 THEN 'inf'::DOUBLE ELSE (0.5 * chill_mean + 0.5 * chill_p20) / coalesce(chill_hours, 900) END AS chr, zone_value - coalesce(hardiness_zone, 5) AS zm,
  frost_p[coalesce(flower_group, 3)] AS fp, CASE WHEN need = 0 THEN 'inf'::DOUBLE ELSE gend_median / need END AS q, CASE WHEN need IS NOT NULL THEN len(list_filter(gend_per, lambda g: g >= need)) / len(gend_per) END AS okp,
  hot32 / [3, 8, 15, 25, 40][coalesce(heat_tolerance, 3)] AS hr FROM pr),
fs AS (SELECT *, CASE WHEN tropical THEN 0 ELSE {pw('chr', fx.CHILL_RAMP)} END AS f_chill, {pw('zm', fx.HARDINESS_RAMP)} AS f_hardiness, {pw('fp', fx.FROST_RAMP)} AS f_frost,
  CASE WHEN harvest_doy IS NULL THEN 0.7 ELSE least({pw('q', fx.SEASON_RAMP)}, 0.2::DOUBLE + 0.8::DOUBLE * okp) END AS f_season,
  ({pw('hr', fx.HEAT_RAMP)}) * CASE WHEN hot38 > 2 THEN 0.85::DOUBLE ELSE 1 END * CASE WHEN colour_cool_nights AND fall_tmin > 14 THEN {pw('fall_tmin', fx.WARM_NIGHT_RAMP)} ELSE 1 END AS f_heat, {pw('aridity', fx.WATER_RAMP)} AS f_water,
  {', '.join(f'p_{d} * ([0.03, 0.2, 0.5, 0.8, 1.0]::DOUBLE[])[coalesce({d}, 3)] * {fx.DISEASE_STRENGTH[d]}::DOUBLE AS loss_{d}' for d in fx.DISEASES)} FROM pq),
sc0 AS (SELECT *, {half_up('100 * (3 * f_chill + 3 * f_hardiness + 2 * f_frost + 3 * f_season + 2 * f_heat + 1.2::DOUBLE * f_water) / 14.2::DOUBLE * pow(least(f_chill, f_hardiness, f_season, f_heat), 0.6)')} AS cl,
  {half_up('100 * (' + ' * '.join(f'(1 - loss_{d})' for d in fx.DISEASES) + ')')} AS di, least(f_chill, f_hardiness, f_frost, f_season, f_heat, f_water) AS fmin, {half_up('hvi')} AS hv, {half_up('hvi - harvest_doy')} AS sh2 FROM fs),
scored AS (SELECT * EXCLUDE (sh2), CASE WHEN no_bloom THEN 0 ELSE cl END AS climate, CASE WHEN NOT no_bloom THEN di END AS disease, CASE WHEN no_bloom THEN 0 ELSE least(cl, di) END AS "both",
  CASE WHEN no_bloom THEN 'season' WHEN fmin < 0.7 THEN CASE fmin WHEN f_chill THEN 'chill' WHEN f_hardiness THEN 'hardiness' WHEN f_frost THEN 'frost' WHEN f_season THEN 'season' WHEN f_heat THEN 'heat' ELSE 'water' END END AS limiting,
  CASE WHEN NOT no_bloom AND harvest_doy IS NOT NULL THEN strftime(DATE '2001-01-01' + ((hv + sh) % 365)::INT, '%b') || ' ' || dayofmonth(DATE '2001-01-01' + ((hv + sh) % 365)::INT)::VARCHAR END AS harvest,
  CASE WHEN NOT no_bloom THEN sh2 END AS shift FROM sc0)"""
TO_SCORES = PLACES + "," + REFS + "," + PAIRS
FROM = ("site", "variety", "asked")
FCOLS = [f"f_{k}" for k in fx.FACTORS]


def prepared(spark, sf):
    return sc.prepare_places(fixture(spark, sf, "site").drop("t0", "amp"))


def varieties(spark, sf):
    return fixture(spark, sf, "variety").drop("country", "place")


def scored(spark, sf):
    p = prepared(spark, sf).drop("name", "country")
    return sc.score(fixture(spark, sf, "asked"), varieties(spark, sf), p, sc.reference_place(p, REF))


@query("variety_place_scores", oracle(FROM, f"""SELECT variety_id, place_id, {', '.join(f'round({c}, 6) AS {c}' for c in FCOLS)}, climate, {bands('climate', fx.CLIMATE_LABELS)} AS label, limiting, disease,
 {bands('disease', fx.DISEASE_LABELS)} AS disease_label, {' OR '.join(f'{d} IS NULL' for d in fx.DISEASES)} AS disease_assumed, "both", harvest, {half_up('days')} AS dafb, shift FROM scored""", TO_SCORES))
def variety_place_scores(spark, sf):
    return rounded(scored(spark, sf).select(*sc.SCORE_COLUMNS), *FCOLS)


@query("site_disease_pressure", oracle(["site"], "SELECT place_id, " + ", ".join(f"round(p_{d}, 6) AS p_{d}" for d in fx.DISEASES) + ", round(t60, 6) AS t60 FROM prep", PLACES))
def site_disease_pressure(spark, sf):
    cols = [f"p_{d}" for d in fx.DISEASES] + ["t60"]
    return rounded(prepared(spark, sf).select("place_id", *cols), *cols)


def _factor_sql() -> str:
    n = "coalesce(chill_hours, 900)"
    rows = {
        "chill": ("CASE WHEN tropical THEN 'no_winter' ELSE " + bands("chr", [(1.15, "plenty"), (1.0, "enough"), (0.85, "borderline"), (0.7, "short"), (None, "too_little")]) + " END",
                  f"{half_up('chill_mean')} || '/' || {half_up('chill_p20')} || '/' || {n}", "chill_hours"),
        "hardiness": (bands("zm", [(0.3, "safe"), (0, "at_limit"), (-0.5, "occasional_dieback"), (-1.0, "injury_likely"), (None, "far_beyond")]),
                      f"{half_up('ext_min_mean')} || '/' || zone_label || '/' || coalesce(hardiness_zone, 5)", "hardiness_zone"),
        "frost": ("CASE WHEN fp <= 0.05 THEN 'escapes' WHEN fp <= 0.15 THEN 'uncommon' WHEN fp <= 0.3 THEN 'regular' ELSE 'serious' END",
                  f"{half_up('fp * (n_cycles - 1)')} || '/' || (n_cycles - 1) || '/' || bloom_label", "flower_group"),
        "season": ("CASE WHEN harvest_doy IS NULL THEN 'unknown' ELSE " + bands("f_season", [(0.85, "ripens"), (0.6, "just"), (0.3, "unreliable"), (None, "too_short")]) + " END",
                   f"concat_ws('/', harvest, floor(abs(shift) / 7.0 + 0.5)::BIGINT, {half_up('okp * 100')}, first_freeze)", "harvest_doy"),
        "heat": ("CASE WHEN hot32 < 1 THEN 'rare' WHEN hr <= 1 THEN 'copes' WHEN hr <= 2 THEN 'more_than_it_likes' ELSE 'well_beyond' END",
                 f"{half_up('hot32')} || '/' || coalesce(heat_tolerance, 3)", "heat_tolerance"),
        "water": (bands("aridity", [(0.8, "rain_enough"), (0.5, "dry_spells"), (0.25, "irrigate"), (None, "arid")]),
                  f"{half_up('least(1, aridity) * 100')} || '/' || {half_up('gs_precip')}", "aridity"),
    }
    return " UNION ALL ".join(
        f"SELECT variety_id, place_id, '{k}' AS factor, round(f_{k}, 6) AS f, {bands(f'f_{k}', fx.VERDICTS)} AS verdict, {k in fx.CRITICAL} AS critical, {code} AS reason, {num} AS numbers, {a} IS NULL AS assumed FROM scored WHERE NOT no_bloom"
        for k, (code, num, a) in rows.items())


@query("score_reasons", oracle(FROM, _factor_sql().replace("len(list_filter(gend_per, lambda g: g >= need)) / len(gend_per)", "okp"), TO_SCORES))
def score_reasons(spark, sf):
    return rounded(sc.factor_rows(scored(spark, sf)), "f")


def _disease_sql() -> str:
    num = lambda x: f"CAST(CAST({x} AS DOUBLE) AS VARCHAR)"
    drivers = {
        "scab": f"'spring_infections ' || {num(half_up('scab_events'))} || ' ' || {num(half_up('lwd_spring'))}", "canker": f"'mild_wet_winter_days ' || {num(half_up('canker_days'))}", "mildew": "'humid_nights'",
        "fire_blight": f"CASE WHEN fire_blight_status = 'unknown' THEN 'blossom_infections_status_unknown ' ELSE 'blossom_infections ' END || CASE WHEN fire_blight_events < 1 THEN {num('floor(fire_blight_events * 10 + 0.5) / 10')} ELSE {num(half_up('fire_blight_events'))} END",
        "rust": "'rust_and_wet_spring'"}
    return " UNION ALL ".join(
        f"SELECT variety_id, place_id, {i} AS i, '{d}' AS disease, p_{d} AS pressure, coalesce({d}, 3) AS susceptibility, {d} IS NULL AS assumed, loss_{d} AS loss, p_{d} >= 0.33 AND coalesce({d}, 3) >= 3 AS issue, {drivers[d]} AS driver FROM scored WHERE NOT no_bloom"
        for i, d in enumerate(fx.DISEASES))


@query("disease_losses", oracle(FROM, f"""SELECT variety_id, place_id, disease, round(pressure, 6) AS pressure, {bands('pressure', fx.PRESSURE_WORDS)} AS word, susceptibility, assumed, round(loss, 6) AS loss,
 {bands('loss', [(0.4, 'bad'), (0.2, 'warn'), (0.08, 'ok'), (None, 'good')])} AS tone, issue, driver, CASE WHEN issue AND rk <= 3 THEN rk END AS issue_rank
 FROM (SELECT *, row_number() OVER (PARTITION BY variety_id, place_id, issue ORDER BY loss DESC, i) AS rk FROM dr)""", TO_SCORES + ", dr AS (" + _disease_sql() + ")"))
def disease_losses(spark, sf):
    return rounded(sc.disease_rows(scored(spark, sf)), "pressure", "loss")


@query("flavour_here", oracle(FROM, """SELECT variety_id, place_id, split_part(c, ':', 1) AS tone, split_part(c, ':', 2) AS code FROM (SELECT variety_id, place_id,
 CASE WHEN climate_needs = 'cool' AND (tmax_hot >= 28 OR hot32 >= 10) THEN CASE WHEN tmax_hot >= 31 THEN 'bad:milder' ELSE 'warn:milder' END WHEN climate_needs = 'cool' AND tmax_hot < 26 THEN 'good:suits'
 WHEN climate_needs = 'warm' AND tmax_hot < 22 THEN 'warn:stays_sharp' WHEN climate_needs = 'warm' AND tmax_hot >= 26 THEN 'good:full_sweetness' END AS c FROM scored WHERE NOT no_bloom) WHERE c IS NOT NULL""", TO_SCORES))
def flavour_here(spark, sf):
    return sc.flavour_here(scored(spark, sf))


RANK_COLS = ["variety_id", "place_id", "rank", "climate", "disease", "both"]
RANKED = """SELECT variety_id, place_id, rank, climate, disease, "both" FROM (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY {key} DESC, climate DESC, variety_id) AS rank FROM scored) WHERE rank <= 20"""


@query("best_varieties_at_place", oracle(FROM, RANKED.format(key='"both"'), TO_SCORES))
def best_varieties_at_place(spark, sf):
    return sc.rank_varieties(scored(spark, sf), "both", 20).select(*RANK_COLS)


@query("healthiest_varieties_at_place", oracle(FROM, RANKED.format(key="coalesce(disease, climate)"), TO_SCORES))
def healthiest_varieties_at_place(spark, sf):
    return sc.rank_varieties(scored(spark, sf), "disease", 20).select(*RANK_COLS)


@query("best_and_worst_places", oracle(FROM, """SELECT variety_id, place_id, climate, disease, "both", rank, side FROM (
 SELECT *, 'best' AS side, row_number() OVER (PARTITION BY variety_id ORDER BY "both" DESC, climate DESC, place_id) AS rank FROM scored) WHERE rank <= 8 UNION ALL
 SELECT variety_id, place_id, climate, disease, "both", rank, side FROM (SELECT *, 'worst' AS side, row_number() OVER (PARTITION BY variety_id ORDER BY "both", climate, place_id DESC) AS rank FROM scored) WHERE rank <= 4""", TO_SCORES))
def best_and_worst_places(spark, sf):
    return sc.best_worst_places(scored(spark, sf))


@query("mean_score_by_place", oracle(FROM, f"""SELECT place_id, score, n, CASE WHEN score >= 70 THEN 'green' WHEN score >= 55 THEN 'yellow' WHEN score >= 35 THEN 'orange' ELSE 'red' END AS band
 FROM (SELECT place_id, {half_up('avg(climate)')} AS score, count(*) AS n FROM scored GROUP BY place_id)""", TO_SCORES))
def mean_score_by_place(spark, sf):
    return sc.mean_score_by_place(scored(spark, sf))


@query("selection_summary", oracle(FROM, f"""SELECT place_id, count(*) AS n, {half_up('avg(climate)')} AS mean_climate, {half_up('avg(coalesce(disease, 0))')} AS mean_disease, count(CASE WHEN climate < 35 THEN 1 END) AS unsuited,
 count(CASE WHEN climate >= 35 AND disease < 40 THEN 1 END) AS sick FROM scored GROUP BY place_id""", TO_SCORES))
def selection_summary(spark, sf):
    return sc.selection_summary(scored(spark, sf))


def _profile_sql() -> str:
    def up(c, b):
        return f"CASE WHEN {c} >= {b[0]} THEN 'good' WHEN {c} >= {b[1]} THEN 'ok' WHEN {c} >= {b[2]} THEN 'warn' ELSE 'bad' END"

    def down(c, b, op="<"):
        return f"CASE WHEN {c} {op} {b[0]} THEN 'good' WHEN {c} {op} {b[1]} THEN 'ok' WHEN {c} {op} {b[2]} THEN 'warn' ELSE 'bad' END"

    watch = " + ".join(f"(p_{d} >= 0.33)::INT" for d in fx.DISEASES)
    rows = [
        ("Winter", "'bad'", "chill_mean", "'no_winter'", "tropical"),
        ("Winter chill", up("chill_mean", (1200, 800, 400)), "chill_mean", bands("chill_mean", [(1800, "all"), (1000, "most"), (600, "medium"), (None, "low_chill_only")]), "NOT tropical"),
        ("Winter cold", up("zone_value", (6, 4.5, 3.5)), "ext_min_mean", "zone_label", "NOT tropical"),
        ("Blossom & frost", down("frost_p[3]", (0.1, 0.3, 0.5), "<="), "frost_p[3]", "CASE WHEN frost_p[3] < 0.05 THEN 'rare' ELSE 'risk' END", "NOT no_bloom"),
        ("Growing season", up("gend_median", (1700, 1300, 900)), "gend_median", bands("gend_median", [(1800, "late"), (1400, "late_mid"), (1000, "mid"), (None, "early")]), "NOT no_bloom"),
        ("Frost-free season", up("frost_free_days", (200, 150, 110)), "frost_free_days", "CASE WHEN snow_days >= 1 THEN 'snow' ELSE 'snow_rare' END", "NOT no_bloom"),
        ("Summer heat", down("hot32", (3, 12, 30)), "tmax_hot", "CASE WHEN hot32 < 1 THEN 'rare' ELSE 'days' END", "NOT no_bloom"),
        ("Humidity & leaf wetness", down("rh_gs", (60, 72, 80)), "rh_gs", "CASE WHEN humidity_estimated THEN 'estimated' ELSE 'measured' END", "NOT no_bloom"),
        ("Disease pressure", f"CASE WHEN {watch} = 0 THEN 'good' WHEN {watch} <= 1 THEN 'ok' ELSE 'warn' END", "pann", f"({watch})::VARCHAR", "NOT no_bloom"),
        ("Water", up("aridity", (0.8, 0.5, 0.25)), "aridity", bands("aridity", [(0.8, "rain"), (0.5, "dry_spells"), (0.25, "irrigate"), (None, "arid")]), "NOT no_bloom"),
        ("Spring", "'bad'", "NULL", "'no_bloom'", "no_bloom")]
    u = " UNION ALL ".join(f"SELECT place_id, {i} AS o, '{t}' AS title, {tone} AS tone, {v}::DOUBLE AS value, {b} AS band FROM prep WHERE {w}" for i, (t, tone, v, b, w) in enumerate(rows))
    return f"SELECT place_id, row_number() OVER (PARTITION BY place_id ORDER BY o) - 1 AS pos, title, tone, round(value, 6) AS value, band FROM ({u})"


@query("site_profile", oracle(["site"], _profile_sql(), PLACES))
def site_profile(spark, sf):
    return rounded(sc.site_profile(prepared(spark, sf)), "value")


# ---- changes between climates ------------------------------------------------------
FIXTURE_HOME = "home AS (SELECT variety_id, min(place_id) AS home_id FROM asked GROUP BY variety_id)"
RIPEN = """
rp0 AS (SELECT *, gend_median >= need AS ripens, CASE WHEN gend_median >= need THEN least(hvi, end_vi) WHEN harvest_doy IS NOT NULL THEN end_vi END AS ripe_vi FROM pq WHERE NOT no_bloom),
rp1 AS (SELECT *, (floor(coalesce(ripe_vi, 255) - 42 + 0.5)::BIGINT % 365 + 365) % 365 AS st FROM rp0),
rp AS (SELECT *, list_sum([nx[(st + sh + 3 * k) % 365 + 1] for k in range(15)]) / 15 AS w_tmax, list_sum([nn[(st + sh + 3 * k) % 365 + 1] for k in range(15)]) / 15 AS w_tmin FROM rp1)"""


def _homes(spark, sf):
    """The first site each variety is asked about stands in for its home."""
    return fixture(spark, sf, "asked").groupBy("variety_id").agg(F.min("place_id").alias("place_id"))


@query("ripening", oracle(FROM, f"""SELECT variety_id, place_id, ripens, round(ripe_vi, 6) AS ripe_vi, CASE WHEN ripe_vi IS NOT NULL THEN strftime(DATE '2001-01-01' + ((floor(ripe_vi + 0.5)::BIGINT + sh) % 365)::INT, '%b') || ' ' || dayofmonth(DATE '2001-01-01' + ((floor(ripe_vi + 0.5)::BIGINT + sh) % 365)::INT)::VARCHAR END AS ripe_label,
 round(q, 6) AS margin, round(okp, 6) AS ok_years, {half_up('days')} AS dafb, round(w_tmax, 6) AS w_tmax, round(w_tmin, 6) AS w_tmin, round((w_tmax + w_tmin) / 2, 6) AS w_tmean FROM rp""", TO_SCORES + "," + RIPEN))
def ripening(spark, sf):
    p = prepared(spark, sf).drop("name", "country")
    r = ch.ripening(fixture(spark, sf, "asked"), varieties(spark, sf), p, sc.reference_place(p, REF))
    return rounded(r.select(*ch.RIPENING), "ripe_vi", "margin", "ok_years", "w_tmax", "w_tmin", "w_tmean")


CHANGE = f"""{FIXTURE_HOME},
hm AS (SELECT r.variety_id, ripe_vi AS h_ripe, w_tmax AS h_tmax, w_tmin AS h_tmin, lwd_spring AS h_lwd FROM rp r JOIN home h ON h.variety_id = r.variety_id AND h.home_id = r.place_id),
cc0 AS (SELECT r.*, h.* EXCLUDE (variety_id), h.variety_id IS NOT NULL AS hh, coalesce(NOT ripens, FALSE) AS u, CASE WHEN h.variety_id IS NOT NULL THEN (w_tmax + w_tmin) / 2 - (h_tmax + h_tmin) / 2 ELSE 0 END AS dt, CASE WHEN h.variety_id IS NOT NULL THEN w_tmin - h_tmin ELSE 0 END AS dn,
  list_contains(uses, 'culinary') AND NOT list_contains(uses, 'dessert') AS cook, list_contains(uses, 'cider') AND NOT list_contains(uses, 'dessert') AS cid, floor(ripe_vi - h_ripe + 0.5) AS wk,
  coalesce(blush_cover >= 25 AND blush IN ('red', 'deep-red', 'crimson', 'purple', 'orange-red', 'pink'), FALSE) OR colour_cool_nights AS red,
  CASE WHEN climate_needs = 'cool' AND (tmax_hot >= 28 OR hot32 >= 10) THEN CASE WHEN tmax_hot >= 31 THEN 'bad' ELSE 'warn' END WHEN climate_needs = 'cool' AND tmax_hot < 26 THEN 'good'
   WHEN climate_needs = 'warm' AND tmax_hot < 22 THEN 'warn' WHEN climate_needs = 'warm' AND tmax_hot >= 26 THEN 'good' END AS ft FROM rp r LEFT JOIN hm h USING (variety_id)),
cc AS (SELECT *, NOT u AND dt >= 1.5 AS wa, u OR dt <= -1.5 AS co, (dt + dn) / 2 AS da FROM cc0),
items AS (
 SELECT variety_id, place_id, 'ripen' AS item, CASE WHEN ripe_vi IS NULL THEN '-:ok' WHEN u THEN 'down:bad' ELSE CASE WHEN NOT hh OR wk IS NULL THEN '-' WHEN wk < -6 THEN 'down' WHEN wk > 6 THEN 'up' ELSE 'same' END || CASE WHEN q < 1.1 THEN ':warn' ELSE ':good' END END AS s FROM cc
 UNION ALL SELECT variety_id, place_id, 'sugar', CASE WHEN u THEN 'down:bad' WHEN hh THEN CASE WHEN dt >= 1.5 THEN 'up:ok' WHEN dt <= -3 THEN 'down:warn' WHEN dt <= -1.5 THEN 'down:ok' ELSE 'same:good' END END FROM cc
 UNION ALL SELECT variety_id, place_id, 'acid', CASE WHEN hh THEN CASE WHEN u OR da <= -3 THEN 'up:warn' WHEN da <= -1.5 THEN 'up:ok' WHEN da >= 3 THEN 'down:warn' WHEN da >= 1.5 THEN 'down:ok' ELSE 'same:good' END END FROM cc
 UNION ALL SELECT variety_id, place_id, 'taste', CASE WHEN hh THEN CASE WHEN cid AND (wa OR co) THEN '-:ok' WHEN cook AND wa THEN '-:warn' WHEN cook AND co THEN '-:good' WHEN wa THEN CASE WHEN acid >= 4 THEN '-:good' WHEN acid <= 2 THEN '-:warn' ELSE '-:ok' END
   WHEN co THEN CASE WHEN acid >= 4 THEN '-:warn' WHEN acid <= 2 THEN '-:good' ELSE '-:ok' END END END FROM cc
 UNION ALL SELECT variety_id, place_id, 'aroma', CASE WHEN ft IS NOT NULL THEN CASE WHEN ft = 'good' THEN 'same:' ELSE 'down:' END || ft WHEN u AND aroma >= 3 THEN 'down:warn' WHEN w_tmax >= 29 AND aroma >= 4 THEN 'down:warn' END FROM cc
 UNION ALL SELECT variety_id, place_id, 'colour', CASE WHEN red AND u THEN 'down:warn' WHEN red THEN CASE WHEN w_tmin >= 16 THEN CASE WHEN colour_cool_nights THEN 'down:bad' ELSE 'down:warn' END WHEN w_tmin >= 13 AND colour_cool_nights THEN 'down:warn' WHEN hh AND w_tmin <= h_tmin - 3 THEN 'up:good' WHEN w_tmin < 11 THEN 'same:good' END END FROM cc
 UNION ALL SELECT variety_id, place_id, 'sunburn', CASE WHEN hot35 >= 2 THEN CASE WHEN hot35 >= 10 OR (hot35 >= 5 AND coalesce(heat_tolerance, 3) <= 2) THEN '-:bad' ELSE '-:warn' END END FROM cc
 UNION ALL SELECT variety_id, place_id, 'keep', CASE WHEN u THEN '-:warn' WHEN hh AND dt >= 3 THEN 'down:warn' WHEN hh AND dt <= -2 THEN 'up:good' END FROM cc
 UNION ALL SELECT variety_id, place_id, 'pit', CASE WHEN bitter_pit >= 3 AND (aridity < 0.5 OR hot32 >= 10) THEN '-:warn' END FROM cc
 UNION ALL SELECT variety_id, place_id, 'russet', CASE WHEN hh AND russet <= 2 THEN CASE WHEN lwd_spring - h_lwd >= 3 THEN 'up:ok' WHEN lwd_spring - h_lwd <= -3 THEN 'down:good' END END FROM cc)"""


@query("climate_changes", oracle(FROM, "SELECT variety_id, place_id, item, nullif(split_part(s, ':', 1), '-') AS dir, split_part(s, ':', 2) AS tone FROM items WHERE s IS NOT NULL", TO_SCORES + "," + RIPEN + "," + CHANGE))
def climate_changes(spark, sf):
    p = prepared(spark, sf).drop("name", "country")
    here = ch.ripening(fixture(spark, sf, "asked"), varieties(spark, sf), p, sc.reference_place(p, REF))
    home = here.join(_homes(spark, sf), ["variety_id", "place_id"], "left_semi")
    return ch.climate_changes(here, home)


GENERIC = ", ".join(f"'{w}'" for w in fx.GENERIC_PLACE_WORDS)
HOME = f"""
rw AS (SELECT DISTINCT place_id, country, unnest(regexp_extract_all(lower(name || ' ' || place_id), '[a-zà-ÿ'']{{4,}}')) AS word FROM site WHERE NOT no_bloom),
vw AS (SELECT DISTINCT variety_id, country, unnest(regexp_extract_all(lower(coalesce(place, '')), '[a-zà-ÿ'']{{4,}}')) AS word FROM variety),
nm AS (SELECT DISTINCT variety_id, place_id FROM vw JOIN rw USING (country, word) WHERE word NOT IN ({GENERIC})),
cand AS (SELECT s.variety_id, s.place_id, s.climate, CASE WHEN n.place_id IS NOT NULL THEN 4 ELSE 0 END + CASE WHEN v.country = t.country THEN 2 ELSE 0 END + CASE WHEN g.place_id IS NOT NULL THEN 1 ELSE 0 END AS k
  FROM scored s JOIN variety v USING (variety_id) JOIN (SELECT place_id, country FROM site WHERE NOT no_bloom) t USING (place_id) LEFT JOIN nm n USING (variety_id, place_id) LEFT JOIN grown g USING (variety_id, place_id)),
bst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY variety_id ORDER BY k DESC, climate DESC, place_id) AS rn FROM cand WHERE k >= 2) WHERE rn = 1)"""


@query("home_place", oracle(FROM + ("grown",), f"""SELECT v.variety_id, CASE WHEN b.place_id IS NOT NULL AND NOT (coalesce(v.country, '') = 'GB' AND b.k < 4) THEN b.place_id ELSE {REF} END AS home_id,
 CASE WHEN b.place_id IS NOT NULL AND NOT (coalesce(v.country, '') = 'GB' AND b.k < 4) THEN CASE WHEN b.k >= 4 THEN 'origin' WHEN b.k >= 3 THEN 'grown_in_country' ELSE 'same_country' END ELSE 'reference' END AS why
 FROM variety v LEFT JOIN bst b USING (variety_id)""", TO_SCORES + "," + HOME))
def home_place(spark, sf):
    sites = fixture(spark, sf, "site").where("NOT no_bloom")
    return ch.home_place(fixture(spark, sf, "variety"), sites, fixture(spark, sf, "grown"), scored(spark, sf), REF)
