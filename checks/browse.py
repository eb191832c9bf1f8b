"""Views, pollination, similarity and rootstock queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import FIXTURES, fixture, oracle, query
from checks.climate import rounded
from checks.scores import FROM, PLACES, TO_SCORES, half_up, scored
from graftline import fixed_values as fx
from graftline.functions import calendar as cal
from graftline.functions import codes
from graftline.operators import pollination as pl
from graftline.operators import rootstocks as rs
from graftline.operators import scoring as sc
from graftline.operators import views as vw

SEASON = "CASE WHEN harvest_doy < 245 THEN 'early' WHEN harvest_doy < 280 THEN 'mid' WHEN harvest_doy IS NOT NULL THEN 'late' END"
CHILL = "CASE WHEN chill_hours < 500 THEN 'low' WHEN chill_hours < 900 THEN 'medium' WHEN chill_hours < 1200 THEN 'high' WHEN chill_hours IS NOT NULL THEN 'very high' END"


def v(spark, sf):
    return fixture(spark, sf, "variety").withColumns({"aka": F.array("p_brand"), "flesh_colour": F.nullif("flesh_mark", F.lit(""))})


FACETS = {
    "facets_text_and_country": (dict(text="BLUE", country="GB"), "contains(lower(name || ' ' || p_brand || ' ' || coalesce(place, '')), 'blue') AND country = 'GB'"),
    "facets_use_and_season": (dict(uses=["dessert", "cider"], seasons=["early", "late"]), f"(list_contains(uses, 'dessert') OR list_contains(uses, 'cider')) AND {SEASON} IN ('early', 'late')"),
    "facets_tags_and_health": (dict(tags=["sweet", "rose"], scab_resistant=True, canker_resistant=True), "list_contains(tags, 'sweet') AND list_contains(tags, 'rose') AND scab <= 2 AND canker <= 2"),
    "facets_growing": (dict(listed=True, self_fertile=True, no_triploid=True, chill=["low", "high"], hardy=True), f"listed AND self_fertile = 'yes' AND ploidy IS DISTINCT FROM 'triploid' AND {CHILL} IN ('low', 'high') AND hardiness_zone <= 4"),
    "facets_bred": (dict(bred=True), "bred"),
}
for _name, (_facets, _where) in FACETS.items():
    query(_name, oracle(["variety"], f"SELECT variety_id, name FROM variety WHERE {_where}"))(
        lambda spark, sf, f=_facets: vw.explore(v(spark, sf), **f).select("variety_id", "name"))

SORT_SQL = {"name": "lower(name)", "season": "coalesce(harvest_doy, 999)", "sweet": "coalesce(sweet, 0) DESC", "acid": "coalesce(acid, 0) DESC", "aroma": "coalesce(aroma, 0) DESC",
            "old": "coalesce(year, 9999)", "hardy": "coalesce(hardiness_zone, 99)", "lowchill": "coalesce(chill_hours, 9999)"}


@query("sorted_pages", oracle(["variety"], " UNION ALL ".join(
    f"SELECT * FROM (SELECT '{k}' AS sort, variety_id FROM variety ORDER BY {o}, lower(name), variety_id LIMIT 60 OFFSET 60)" for k, o in SORT_SQL.items())))
def sorted_pages(spark, sf):
    df, out = v(spark, sf), None
    for k in vw.SORTS:
        p = vw.page(df, vw.sort_keys(k), 1, 60).select(F.lit(k).alias("sort"), "variety_id")
        out = p if out is None else out.unionByName(p)
    return out


KIND_SQL = {"heirloom": "year < 1950", "modern": "year >= 1950", "russet": "russet >= 2", "redflesh": "flesh_mark = 'red'", "tinged": "flesh_mark <> ''"}


@query("kinds", oracle(["variety"], " UNION ALL ".join(f"SELECT '{k}' AS kind, variety_id FROM variety WHERE {w}" for k, w in KIND_SQL.items())))
def kinds(spark, sf):
    df, out = v(spark, sf), None
    for k in vw.KINDS:
        p = vw.kind(df, k).select(F.lit(k).alias("kind"), "variety_id")
        out = p if out is None else out.unionByName(p)
    return out


@query("place_friendliness", oracle(FROM, f"""SELECT place_id, {half_up('avg(climate)')} AS score, count(*) AS n FROM scored
 WHERE variety_id IN (SELECT variety_id FROM (SELECT variety_id, row_number() OVER (ORDER BY variety_id) - 1 AS i FROM variety) WHERE i % 6 = 0) GROUP BY place_id""", TO_SCORES))
def place_friendliness(spark, sf):
    sample = vw.every_nth(fixture(spark, sf, "variety").select("variety_id"), "variety_id")
    return sc.mean_score_by_place(scored(spark, sf).join(sample, "variety_id", "left_semi")).drop("band")


FIXTURES["first_picks"] = "SELECT DISTINCT l_partkey AS variety_id FROM {lineitem} WHERE l_linenumber = 1 AND l_returnflag = 'A' AND l_quantity > 40"


@query("name_lookup", oracle(["variety", "first_picks"], "SELECT variety_id, name FROM variety WHERE contains(lower(name || ' ' || p_brand || ' ' || coalesce(place, '')), 'gear') AND variety_id NOT IN (SELECT variety_id FROM first_picks) ORDER BY lower(name), variety_id LIMIT 7"))
def name_lookup(spark, sf):
    return vw.lookup(v(spark, sf), " Gear", fixture(spark, sf, "first_picks")).select("variety_id", "name")


@query("origin_countries", oracle(["variety"], "SELECT DISTINCT country, CASE country " + " ".join(f"WHEN '{k}' THEN '{n}'" for k, n in fx.COUNTRY_NAMES.items()) + " ELSE country END AS country_name FROM variety WHERE country IS NOT NULL"))
def origin_countries(spark, sf):
    return vw.countries(v(spark, sf))


FAV = "fav AS (SELECT * FROM (SELECT selection_id, variety_id, row_number() OVER (PARTITION BY selection_id ORDER BY added, variety_id) AS position FROM favourite WHERE variety_id IN (SELECT variety_id FROM variety)) WHERE position <= 24)"


def favs(spark, sf):
    return vw.favourites(fixture(spark, sf, "favourite"), fixture(spark, sf, "variety"))


@query("favourites", oracle(["favourite", "variety"], "SELECT * FROM fav", FAV))
def favourites(spark, sf):
    return favs(spark, sf)


@query("side_by_side", oracle(["favourite", "variety"], "SELECT selection_id, position, variety_id, name, attribute, value FROM (" + " UNION ALL ".join(
    f"SELECT selection_id, position, variety_id, name, '{a}' AS attribute, {a}::VARCHAR AS value FROM fav JOIN variety USING (variety_id)" for a in vw.COMPARED) + ")", FAV))
def side_by_side(spark, sf):
    return vw.compare(favs(spark, sf), v(spark, sf))


@query("by_flower_group", oracle(["favourite", "variety"], "SELECT selection_id, coalesce(flower_group::VARCHAR, '?') AS flower_group, count(*) AS n, string_agg(name, '|' ORDER BY position) AS names FROM fav JOIN variety USING (variety_id) GROUP BY ALL", FAV))
def by_flower_group(spark, sf):
    return vw.by_flower_group(favs(spark, sf), v(spark, sf)).withColumn("names", F.array_join("names", "|"))


FIXTURES["named_set"] = "SELECT DISTINCT p_brand || ' ' || p_type AS set_name, p_partkey * 3 AS variety_id FROM {part}"


@query("known_sets", oracle(["named_set", "variety"], "SELECT set_name, count(*) AS known FROM named_set WHERE variety_id IN (SELECT variety_id FROM variety) GROUP BY set_name HAVING count(*) >= 2"))
def known_sets(spark, sf):
    return vw.known_sets(fixture(spark, sf, "named_set"), v(spark, sf))


# ---- pollination --------------------------------------------------------------------
ABLE = "(ploidy IS NULL OR ploidy <> 'triploid') AND flower_group IS NOT NULL AND NOT (len(uses) = 1 AND uses[1] = 'ornamental')"
COST = "(CASE WHEN listed THEN 0 ELSE 1 END + CASE WHEN conf = 'low' THEN 1.5 ELSE 0 END + CASE WHEN list_contains(uses, 'crab') THEN 0.5 ELSE 0 END)"
POLL = f"""able AS (SELECT variety_id, lower(name) AS sn, flower_group, {COST} AS cost FROM variety WHERE {ABLE}),
poll AS (SELECT v.variety_id, a.variety_id AS partner_id, (a.cost + 2 * abs(a.flower_group - v.flower_group))::DOUBLE AS cost, row_number() OVER (PARTITION BY v.variety_id ORDER BY a.cost + 2 * abs(a.flower_group - v.flower_group), a.sn, a.variety_id) AS rank
 FROM variety v JOIN able a ON a.flower_group BETWEEN v.flower_group - 1 AND v.flower_group + 1 AND a.variety_id <> v.variety_id)"""


@query("pollinators", oracle(["variety"], "SELECT variety_id, rank, partner_id, cost FROM poll WHERE rank <= 8", POLL))
def pollinators(spark, sf):
    df = v(spark, sf)
    return pl.pollinators(df.select("variety_id", "flower_group"), df)


REPORT = f"""{FAV},
mem AS (SELECT f.*, v.flower_group, v.self_fertile, coalesce(v.ploidy = 'triploid', FALSE) AS triploid FROM fav f JOIN variety v USING (variety_id)),
prt AS (SELECT a.selection_id, a.variety_id, b.variety_id AS partner_id FROM mem a JOIN mem b ON a.selection_id = b.selection_id AND a.variety_id <> b.variety_id AND NOT b.triploid AND abs(a.flower_group - b.flower_group) <= 1),
rep0 AS (SELECT m.*, CASE WHEN m.flower_group IS NOT NULL THEN coalesce(p.np, 0) END AS partners FROM mem m LEFT JOIN (SELECT selection_id, variety_id, count(*) AS np FROM prt GROUP BY selection_id, variety_id) p USING (selection_id, variety_id)),
rep AS (SELECT *, CASE WHEN flower_group IS NULL THEN 'warn' WHEN triploid THEN CASE WHEN partners >= 2 THEN 'good' ELSE 'bad' END WHEN self_fertile IS DISTINCT FROM 'yes' THEN CASE WHEN partners >= 1 THEN 'good' ELSE 'warn' END ELSE 'good' END AS tone FROM rep0)"""


@query("pollination_report", oracle(["favourite", "variety"], "SELECT selection_id, position, variety_id, flower_group, triploid, partners, tone FROM rep", REPORT))
def pollination_report(spark, sf):
    return pl.pollination_report(favs(spark, sf), v(spark, sf))


@query("pollination_partners", oracle(["favourite", "variety"], "SELECT * FROM prt", REPORT))
def pollination_partners(spark, sf):
    return pl.partner_pairs(favs(spark, sf), v(spark, sf))


@query("suggested_pollinators", oracle(["favourite", "variety"], """SELECT selection_id, variety_id, place FROM (SELECT selection_id, variety_id, row_number() OVER (PARTITION BY selection_id ORDER BY min(position * 100 + rank)) AS place FROM (
 SELECT r.selection_id, r.position, p.rank, p.partner_id AS variety_id FROM rep r JOIN poll p ON p.variety_id = r.variety_id AND p.rank <= 4 WHERE r.tone <> 'good') c
 WHERE NOT EXISTS (SELECT 1 FROM fav f WHERE f.selection_id = c.selection_id AND f.variety_id = c.variety_id) GROUP BY selection_id, variety_id) WHERE place <= 6""", REPORT + "," + POLL))
def suggested_pollinators(spark, sf):
    return pl.suggest_pollinators(favs(spark, sf), v(spark, sf))


@query("needs_pollination", oracle(["favourite", "variety"], "SELECT selection_id, variety_id, position FROM fav JOIN variety USING (variety_id) WHERE self_fertile = 'no' OR ploidy = 'triploid'", FAV))
def needs_pollination(spark, sf):
    return pl.needs_pollination(favs(spark, sf), v(spark, sf))


PICKED = "picked AS (SELECT DISTINCT l_partkey AS variety_id FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45)"
SIM = " + ".join(f"pow(coalesce(p.{k}::DOUBLE, 2.5) - coalesce(v.{k}::DOUBLE, 2.5), 2)" for k in pl.TASTE_KEYS)


@query("similar_varieties", oracle(["variety"], f"""SELECT variety_id, pick_id, round(likeness, 6) AS likeness, rank FROM (SELECT *, row_number() OVER (PARTITION BY pick_id ORDER BY likeness DESC, sn, variety_id) AS rank FROM (
 SELECT v.variety_id, p.variety_id AS pick_id, lower(v.name) AS sn, 1 / (1 + sqrt({SIM})) * 0.6::DOUBLE + len(list_intersect(p.tags, v.tags)) / greatest(1, len(list_distinct(list_concat(p.tags, v.tags)))) * 0.7::DOUBLE
  + CASE WHEN list_has_any(p.uses, v.uses) THEN 0.1::DOUBLE ELSE -0.4::DOUBLE END AS likeness FROM variety v JOIN variety p ON p.variety_id IN (SELECT variety_id FROM picked) AND p.variety_id <> v.variety_id)) WHERE rank <= 6""", PICKED))
def similar_varieties(spark, sf):
    """Like the parts returned in large lots."""
    picked = fixture(spark, sf, "lineitem").where("l_returnflag = 'R' AND l_quantity >= 45").select(F.col("l_partkey").alias("variety_id"))
    return rounded(pl.similar_to(picked, v(spark, sf)), "likeness")


# ---- rootstocks -----------------------------------------------------------------------
RS = f"""rj AS (SELECT a.rootstock_id, a.place_id, r.size_class, r.name, p.no_bloom, r.fire_blight, r.collar_rot, r.wet_soil, r.drought, r.woolly_aphid, p.zone_value, p.p_fire_blight, coalesce(r.hardiness_zone, 5) AS rz,
  greatest(0, least(1, (p.pann - 700) / 600)) * 0.6::DOUBLE + greatest(0, least(1, (p.canker_days - 60) / 60)) * 0.4::DOUBLE AS wet, greatest(0, least(1, (0.9::DOUBLE - p.aridity) / 0.6::DOUBLE)) AS dry,
  CASE WHEN p.tmax_hot >= 21 AND p.ext_min_mean > -26 THEN 0.6::DOUBLE ELSE 0.2::DOUBLE END AS ap FROM asked_rootstock a JOIN rootstock r USING (rootstock_id) JOIN prep p USING (place_id)),
rk AS (SELECT *, zone_value - rz AS zm FROM rj),
fit AS (SELECT *, greatest(0, least(100, floor(80::DOUBLE + CASE WHEN zm < 0 THEN -least(65, -zm * 45) ELSE 0 END + CASE WHEN zm >= 0 AND zone_value < 5.5 AND rz <= 4 THEN 6 ELSE 0 END
  + CASE WHEN p_fire_blight >= 0.3 AND fire_blight >= 4 THEN -p_fire_blight * (fire_blight - 2) * 12 ELSE 0 END + CASE WHEN p_fire_blight >= 0.3 AND fire_blight <= 2 THEN p_fire_blight * 8 ELSE 0 END
  + CASE WHEN wet >= 0.25 AND collar_rot >= 4 THEN -wet * (collar_rot - 2) * 10 ELSE 0 END + CASE WHEN wet >= 0.25 AND collar_rot <= 2 THEN wet * 6 ELSE 0 END + CASE WHEN wet >= 0.25 AND wet_soil >= 4 THEN wet * 4 ELSE 0 END
  + CASE WHEN dry >= 0.2 AND drought >= 4 THEN dry * 8 ELSE 0 END + CASE WHEN dry >= 0.2 AND drought <= 2 THEN -dry * 10 ELSE 0 END
  + CASE WHEN woolly_aphid >= 4 THEN -ap * (woolly_aphid - 2) * 5 ELSE 0 END + CASE WHEN woolly_aphid <= 2 THEN ap * 5 ELSE 0 END + 0.5)))::INT AS fit,
  concat_ws(',', CASE WHEN zm >= 0 AND zone_value < 5.5 AND rz <= 4 THEN 'hardy_roots' END, CASE WHEN p_fire_blight >= 0.3 AND fire_blight <= 2 THEN 'resists_blight' END, CASE WHEN wet >= 0.25 AND collar_rot <= 2 THEN 'resists_collar_rot' END,
   CASE WHEN wet >= 0.25 AND wet_soil >= 4 THEN 'tolerates_wet' END, CASE WHEN dry >= 0.2 AND drought >= 4 THEN 'copes_with_drought' END, CASE WHEN woolly_aphid <= 2 AND ap > 0.4 THEN 'resists_aphid' END) AS why,
  concat_ws(',', CASE WHEN zm < 0 THEN 'too_cold' END, CASE WHEN p_fire_blight >= 0.3 AND fire_blight >= 4 THEN 'blight_prone' END, CASE WHEN wet >= 0.25 AND collar_rot >= 4 THEN 'collar_rot_prone' END,
   CASE WHEN dry >= 0.2 AND drought <= 2 THEN 'needs_irrigation' END, CASE WHEN woolly_aphid >= 4 AND ap > 0.4 THEN 'aphid_prone' END) AS warn FROM rk)"""
RFROM = ("site", "rootstock", "asked_rootstock")


def fit(spark, sf):
    return rs.rootstock_fit(fixture(spark, sf, "asked_rootstock"), fixture(spark, sf, "rootstock"), sc.site_pressures(fixture(spark, sf, "site")))


@query("rootstock_fit", oracle(RFROM, "SELECT rootstock_id, place_id, fit, why, warn FROM fit", PLACES + "," + RS))
def rootstock_fit(spark, sf):
    return fit(spark, sf).select("rootstock_id", "place_id", "fit", F.array_join("why", ",").alias("why"), F.array_join("warn", ",").alias("warn"))


@query("rootstock_advice", oracle(RFROM, """SELECT place_id, bucket, rank, rootstock_id, fit FROM (SELECT *, row_number() OVER (PARTITION BY place_id, bucket ORDER BY fit DESC, name, rootstock_id) AS rank FROM (
 SELECT *, CASE WHEN size_class IN ('very-dwarf', 'dwarf') THEN 'dwarf' WHEN size_class IN ('vigorous', 'very-vigorous') THEN 'vigorous' ELSE size_class END AS bucket FROM fit WHERE NOT no_bloom)) WHERE rank <= 3""", PLACES + "," + RS))
def rootstock_advice(spark, sf):
    return rs.rootstock_advice(fit(spark, sf)).select("place_id", "bucket", "rank", "rootstock_id", "fit")


SIZE_NO = "CASE size_class " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(fx.SIZE_CLASSES)) + " END"


def rule(c, lo, hi, plus, minus):
    """`lo`/`hi`: conditions for the bonus and the penalty."""
    return f"CASE WHEN {lo} THEN {plus} WHEN {hi} THEN -{minus} ELSE 0 END"


def chooser_sql(size: str, terms: list[str], why: list[tuple[str, str]], warn: list[tuple[str, str]]) -> str:
    tail = ["coalesce((yield_efficiency - 3) * 2, 0)", "CASE uk_availability WHEN 'common' THEN 4 WHEN 'specialist' THEN 1 WHEN 'rare' THEN -3 WHEN 'not-available' THEN -3 ELSE 0 END", "CASE conf WHEN 'high' THEN 3 WHEN 'low' THEN -6 ELSE 0 END"]
    total = " + ".join(["70"] + ([f"-22 * abs({SIZE_NO} - {fx.SIZE_CLASSES.index(size)})"] if size != "any" else []) + terms + tail)
    w = "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{k}' END" for c, k in why) + ")" if why else "''"
    x = "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{k}' END" for c, k in warn) + ")" if warn else "''"
    return f"SELECT rootstock_id, greatest(0, least(100, {total})) AS fit, CASE WHEN {w} = '' AND uk_availability = 'common' THEN 'widely_available' ELSE {w} END AS why, {x} AS warn FROM rootstock"


def two(c, yes, no, plus, minus, low_good=False):
    good, bad = (f"{c} <= 2", f"{c} >= 4") if low_good else (f"{c} >= 4", f"{c} <= 2")
    return f"CASE WHEN {good} THEN {plus} WHEN {bad} THEN -{minus} ELSE 0 END", (good, yes), (bad, no)


def _choose(name, kwargs, size, rules):
    extra = [r for r in rules if isinstance(r, str)]
    rules = [r for r in rules if not isinstance(r, str)]
    same = [(f"size_class = '{size}'", "right_size")] if size != "any" else []
    sql = chooser_sql(size, [r[0] for r in rules] + extra, same + [r[1] for r in rules], [r[2] for r in rules])
    query(name, oracle(["rootstock"], sql))(lambda spark, sf: rs.choose_rootstock(fixture(spark, sf, "rootstock"), **kwargs).select(
        "rootstock_id", "fit", F.array_join("why", ",").alias("why"), F.array_join("warn", ",").alias("warn")))


_choose("rootstock_for_wet_cold_site", dict(size="dwarf", soil="wet", blight=True, cold=True), "dwarf",
        [two("collar_rot", "resists_collar_rot", "collar_rot_prone", 8, 18, True), two("wet_soil", "tolerates_wet", "dislikes_wet", 8, 8), two("fire_blight", "resists_blight", "blight_prone", 14, 22, True),
         ("CASE WHEN hardiness_zone <= 4 THEN 12 WHEN hardiness_zone >= 6 THEN -22 ELSE 0 END", ("hardiness_zone <= 4", "very_hardy"), ("hardiness_zone >= 6", "tender_roots")), "CASE WHEN hardiness_zone = 5 THEN -6 ELSE 0 END"])
_choose("rootstock_for_dry_windy_site", dict(size="any", soil="dry", wind=True, early=True, grass=True), "any",
        [two("drought", "drought_tolerant", "drought_sensitive", 12, 14), two("poor_soil", "copes_with_poor", "needs_fertile", 12, 14), two("anchorage", "well_anchored", "needs_stake", 10, 12), two("precocity", "crops_early", "slow_to_crop", 10, 10)])

RT = {"name": None, "size": SIZE_NO, "height": "(height_m[1] + height_m[2]) / 2", "vigor": "vigor", "prec": "precocity", "yield": "yield_efficiency", "anch": "anchorage", "fb": "fire_blight", "cr": "collar_rot", "wa": "woolly_aphid",
      "cold": "hardiness_zone", "dr": "drought", "wet": "wet_soil"}
NAT = "lower(regexp_extract(name, '^(\\D*)', 1)) {d}, regexp_extract(name, '(\\d+)', 1)::INT {d}, lower(name) {d}"


def _table_sql() -> str:
    parts = []
    for k, c in RT.items():
        for d in ("ASC", "DESC"):
            nat = NAT.format(d=d)
            parts.append(f"SELECT '{k} {d.lower()}' AS sort, rootstock_id, row_number() OVER (ORDER BY {(c + ' ' + d + ' NULLS LAST, ') if c else ''}{nat}, rootstock_id) AS position FROM rootstock")
    return " UNION ALL ".join(parts)


@query("rootstock_table", oracle(["rootstock"], _table_sql()))
def rootstock_table(spark, sf):
    return rs.rootstock_positions(fixture(spark, sf, "rootstock"))


@query("pairing_advice", oracle(["variety"], """SELECT variety_id, row_number() OVER (PARTITION BY variety_id ORDER BY o) - 1 AS pos, advice FROM (
 SELECT variety_id, 0 AS o, CASE WHEN vigor <= 2 THEN 'weak_grower' WHEN vigor >= 4 THEN 'strong_grower' WHEN vigor IS NOT NULL THEN 'average_vigour' END AS advice FROM variety UNION ALL SELECT variety_id, 1, 'tip_bearer' FROM variety WHERE bearing IN ('tip', 'part-tip')
 UNION ALL SELECT variety_id, 2, 'triploid' FROM variety WHERE ploidy = 'triploid' UNION ALL SELECT variety_id, 3, 'blight_prone' FROM variety WHERE fire_blight >= 4) WHERE advice IS NOT NULL"""))
def pairing_advice(spark, sf):
    return rs.pairing_advice(v(spark, sf))


# ---- small classes of the variety record --------------------------------------------------
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


@query("variety_classes", oracle(["variety"], f"""SELECT variety_id, CASE WHEN harvest_doy < 232 THEN 'early' WHEN harvest_doy < 262 THEN 'early-mid' WHEN harvest_doy < 282 THEN 'mid' WHEN harvest_doy IS NOT NULL THEN 'late' END AS season_band,
 CASE WHEN harvest_doy < 245 THEN 'Early season' WHEN harvest_doy < 280 THEN 'Mid season' WHEN harvest_doy IS NOT NULL THEN 'Late season' ELSE 'unknown' END AS season_name, {CHILL} AS chill_class,
 ({list(fx.ZONE_MIN_C)})[greatest(1, least(10, hardiness_zone))] AS zone_min_c, CASE WHEN len(ms) > 0 THEN array_to_string([(ms[1] + k) % 12 for k in range(((ms[least(len(ms), 2)] - ms[1]) % 12 + 12) % 12 + 1)], ',') END AS eating
 FROM (SELECT *, CASE WHEN hardiness_zone IS NULL THEN NULL ELSE 1 END AS one, list_transform(regexp_extract_all(lower(eating), '{'|'.join(MONTHS)}'), lambda m: list_position({MONTHS}, m) - 1) AS ms FROM variety)"""))
def variety_classes(spark, sf):
    months = F.array_join(F.transform(cal.eating_months("eating"), lambda m: m.cast("string")), ",")
    return v(spark, sf).select("variety_id", cal.season_band("harvest_doy").alias("season_band"), cal.season_name("harvest_doy").alias("season_name"),
                               codes.chill_class("chill_hours").alias("chill_class"), codes.zone_min_c("hardiness_zone").alias("zone_min_c"), months.alias("eating"))
