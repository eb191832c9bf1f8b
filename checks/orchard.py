"""Fixtures for varieties, rootstocks, sites and what is asked about them."""
from __future__ import annotations

from checks.base import FIXTURES


def pick(expr: str, values: list, null_when: str | None = None) -> str:
    """values[expr % n] as a CASE, with an optional condition for null."""
    def lit(v):
        return f"'{v}'" if isinstance(v, str) else str(v)

    nulls = f"WHEN {null_when} THEN NULL " if null_when else ""
    body = " ".join(f"WHEN ({expr}) % {len(values)} = {i} THEN {lit(v)}" for i, v in enumerate(values))
    return f"CASE {nulls}{body} END"


def rating(expr: str, null_when: str, hi: int = 5) -> str:
    return f"CASE WHEN {null_when} THEN NULL ELSE CAST(1 + ({expr}) % {hi} AS INT) END"


K = "p_partkey"
FIXTURES["variety"] = f"""
SELECT {K} AS variety_id, p_name || ' ' || CAST({K} % 40 AS STRING) AS name, p_name, p_brand,
  {pick(K, ['GB', 'US', 'FR', 'AU', 'NZ', 'JP', 'DE'], f'{K} % 31 = 0')} AS country,
  {pick(f'{K} + p_size', ['upper kentish valley', 'geneva county', 'northern orchard', 'river meadow', 'southern hills'], f'{K} % 9 = 0')} AS place,
  CASE WHEN {K} % 8 = 0 THEN NULL ELSE CAST(1800 + p_size * 4 AS INT) END AS year,
  CASE WHEN {K} % 10 = 0 THEN NULL ELSE CAST(300 + 20 * p_size AS INT) END AS chill_hours,
  CASE WHEN {K} % 19 = 0 THEN NULL ELSE CAST(2 + {K} % 9 AS INT) END AS hardiness_zone,
  {rating('p_size', f'{K} % 17 = 0')} AS heat_tolerance, {K} % 6 = 0 AS colour_cool_nights,
  CASE WHEN {K} % 14 = 0 THEN NULL ELSE CAST(205 + ({K} * 7) % 100 AS INT) END AS harvest_doy,
  CASE WHEN {K} % 11 = 0 THEN NULL ELSE CAST(1 + {K} % 7 AS INT) END AS flower_group,
  CASE WHEN {K} % 13 = 0 THEN 'triploid' WHEN {K} % 29 = 0 THEN 'tetraploid' WHEN {K} % 37 = 0 THEN NULL ELSE 'diploid' END AS ploidy,
  {pick(f'{K} + p_size', ['no', 'yes', 'no', 'partial'], f'{K} % 23 = 0')} AS self_fertile,
  {rating(K, f'{K} % 9 = 0')} AS scab, {rating(f'{K} * 3 + p_size', f'{K} % 12 = 0')} AS canker, {rating(f'{K} * 2 + 1', f'{K} % 15 = 0')} AS mildew,
  {rating(f'{K} + p_size', f'{K} % 16 = 0')} AS fire_blight, {rating(f'{K} * 4 + p_size', f'{K} % 18 = 0')} AS rust, {rating(f'{K} + 2', f'{K} % 20 = 0')} AS bitter_pit,
  {rating(f'{K} * 3', f'{K} % 21 = 0')} AS sweet, {rating(f'{K} * 7 + p_size', f'{K} % 22 = 0')} AS acid, {rating(f'{K} + p_size * 3', f'{K} % 24 = 0')} AS aroma,
  CASE WHEN {K} % 5 = 0 THEN NULL ELSE CAST(({K} * 5) % 6 AS INT) END AS tannin, {rating(f'p_size + {K} * 2', f'{K} % 25 = 0')} AS crisp, {rating('p_size * 2', f'{K} % 26 = 0')} AS juicy,
  CASE WHEN {K} % 7 = 0 THEN list_value('culinary') WHEN {K} % 7 = 1 THEN list_value('dessert', 'culinary') WHEN {K} % 7 = 2 THEN list_value('cider') WHEN {K} % 7 = 3 THEN list_value('ornamental')
       WHEN {K} % 7 = 4 THEN list_value('crab', 'ornamental') ELSE list_value('dessert') END AS uses,
  CASE WHEN {K} % 4 = 0 THEN list_value({pick(K, ['sweet', 'sharp', 'nutty', 'honey'])}) WHEN {K} % 4 = 1 THEN list_value({pick(f'{K} + p_size', ['sweet', 'sharp', 'mild'])}, {pick('p_size', ['rose', 'pear', 'melon', 'lemon', 'spice'])})
       ELSE list_value({pick('p_size', ['sweet', 'sharp', 'mild'])}, {pick(f'{K} * 3', ['honey', 'nutty', 'walnut', 'vanilla'])}, {pick(f'{K} + p_size', ['rose', 'pear', 'melon', 'lemon', 'spice', 'pear-drop'])}) END AS tags,
  {pick(K, ['cool', 'warm', 'any'], f'{K} % 3 = 1 AND {K} % 2 = 0')} AS climate_needs,
  {pick(f'{K} + 1', ['none', 'pink', 'red', 'crimson', 'orange', 'brown'], f'{K} % 27 = 0')} AS blush, CAST(({K} * 11) % 101 AS INT) AS blush_cover,
  CASE WHEN {K} % 28 = 0 THEN NULL ELSE CAST({K} % 4 AS INT) END AS russet, {pick(f'{K} % 40', ['red', 'tinged'] + [''] * 38)} AS flesh_mark,
  {K} % 3 = 0 AS listed, {K} % 50 = 0 AS bred, {pick('p_size', ['high', 'medium', 'low'])} AS conf, {rating(f'{K} + p_size * 5', f'{K} % 33 = 0')} AS vigor,
  {pick(f'{K} + p_size', ['spur', 'tip', 'part-tip'], f'{K} % 34 = 0')} AS bearing, CASE WHEN {K} % 6 = 1 THEN NULL ELSE CAST(p_size % 30 AS INT) END AS storage_weeks,
  {pick(f'{K} * 3 + p_size', ['Oct-Dec', 'Nov-Feb', 'Sep', 'Aug-Sep', 'jan to mar, best feb', 'unknown'], f'{K} % 35 = 0')} AS eating
FROM {{part}}"""

S = "s_suppkey"


def linear(values) -> str:
    return "list_value(" + ", ".join(values) + ")"


FIXTURES["site_base"] = f"""
SELECT {S} AS place_id, -55e0 + ({S} * 37) % 115 AS lat, -180e0 + ({S} * 71) % 360 AS lon, 9 AS n_cycles, '1995-2004' AS period,
  {pick(S, ['GB', 'US', 'FR', 'AU', 'NZ', 'JP', 'DE'])} AS country, s_name || ' ' || {pick(S, ['Kentish Valley', 'Geneva', 'Orchard Basin', 'Meadow', 'Hills', 'Coastal Region'])} AS name,
  ({S} * 53) % 1900 + 20e0 AS chill_mean, (({S} * 53) % 1900 + 20e0) * 0.875e0 AS chill_p20, ({S} * 31) % 1500 + 10e0 AS chill_hours72,
  14e0 - ({S} * 29) % 52 AS ext_min_mean, 9e0 - ({S} * 29) % 52 AS ext_min_abs, 70e0 + ({S} * 17) % 70 + 0.25e0 * ({S} % 4) AS bloom_vi, 4e0 + {S} % 5 AS bloom_sd,
  {linear(f'(({S} * 7 + {g} * 13) % 100) / 125e0' for g in range(7))} AS frost_p,
  {linear(f'CAST({j} * (40 + 10 * ({S} % 9)) AS DOUBLE)' for j in range(27))} AS gdd_curve,
  {linear(f'900e0 + ({S} * 97 + {y} * 131) % 1500' for y in range(6))} AS gend_per,
  900e0 + ({S} * 61) % 1600 AS gend_median, 70e0 + ({S} * 17) % 70 + 150 + ({S} * 11) % 100 AS end_vi, 150e0 + ({S} * 11) % 100 AS season_days,
  CASE WHEN {S} % 4 = 0 THEN NULL ELSE 'Nov ' || CAST(1 + {S} % 28 AS STRING) END AS first_freeze,
  ({S} * 3) % 40 + 0.5e0 * ({S} % 2) AS hot32, (({S} * 3) % 40) / 2e0 AS hot35, (({S} * 3) % 40) / 8e0 AS hot38, 18e0 + ({S} * 5) % 18 AS tmax_hot, 6e0 + ({S} * 7) % 16 AS fall_tmin,
  CAST(({S} * 11) % 40 AS DOUBLE) AS scab_events, 4e0 + ({S} * 3) % 12 AS lwd_spring, 2e0 + ({S} * 7) % 24 AS spring_t, CAST(({S} * 13) % 110 AS DOUBLE) AS canker_days,
  (({S} * 19) % 100) / 100e0 AS mildew_idx, ({S} % 9) * 0.75e0 AS fire_blight_events, 50e0 + ({S} * 41) % 700 AS gs_precip, (50e0 + ({S} * 41) % 700) / (400e0 + ({S} * 23) % 500) AS aridity,
  45e0 + ({S} * 7) % 45 AS rh_gs, CAST({S} % 13 AS DOUBLE) AS snow_days, 90e0 + ({S} * 19) % 160 AS frost_free_days, 300e0 + ({S} * 67) % 1500 AS pann,
  {S} % 4 = 0 AS humidity_estimated, {pick(S, ['present', 'absent', 'unknown'])} AS fire_blight_status, {S} % 5 = 0 AS rust_present, {S} % 23 = 0 AS no_bloom, {S} % 17 = 3 AS tropical,
  (({S} * 23) % 17) - 4e0 AS t0, 3e0 + ({S} * 5) % 14 AS amp
FROM {{supplier}}"""
# hottest month July in the north, January in the south; a triangle wave so that no trigonometry is needed
FIXTURES["site"] = """
SELECT *, lat < 0 AS southern, (ext_min_mean * 9e0 / 5e0 + 92e0) / 10e0 + 1e0 AS zone_value, CAST(floor((ext_min_mean * 9e0 / 5e0 + 92e0) / 10e0) + 1 AS INT) || 'a' AS zone_label,
  'May ' || CAST(1 + place_id % 28 AS STRING) AS bloom_label,
  """ + linear(f"t0 + 12e0 + amp * abs(CASE WHEN lat < 0 THEN {abs(6 - (m + 6) % 12)} ELSE {abs(6 - m)} END - 6) / 6e0" for m in range(12)).replace("abs(CASE", "abs(CASE") + """ AS tmax_m,
  """ + linear(f"t0 + 2e0 + amp * abs(CASE WHEN lat < 0 THEN {abs(6 - (m + 6) % 12)} ELSE {abs(6 - m)} END - 6) / 8e0" for m in range(12)) + """ AS tmin_m
FROM {site_base}"""
FIXTURES["site"] = FIXTURES["site"].replace("CAST(floor((ext_min_mean * 9e0 / 5e0 + 92e0) / 10e0) + 1 AS INT) || 'a'", "CAST(CAST(floor((ext_min_mean * 9e0 / 5e0 + 92e0) / 10e0) + 1 AS INT) AS STRING) || 'a'")
# which variety is asked about at which site: what was shipped by whom
FIXTURES["asked"] = "SELECT DISTINCT l_partkey AS variety_id, l_suppkey AS place_id FROM {lineitem}"
FIXTURES["grown"] = "SELECT DISTINCT l_partkey AS variety_id, l_suppkey AS place_id FROM {lineitem} WHERE l_returnflag = 'R'"

FIXTURES["rootstock"] = f"""
SELECT {S} AS rootstock_id, {pick(S, ['M.', 'MM.', 'G.', 'B.', 'P.'])} || CAST(({S} * 7) % 120 AS STRING) AS name, {pick(S, ['very-dwarf', 'dwarf', 'semi-dwarf', 'semi-vigorous', 'vigorous', 'very-vigorous'])} AS size_class,
  {rating(S, f'{S} % 11 = 0')} AS vigor, {rating(f'{S} * 2', f'{S} % 12 = 0')} AS precocity, {rating(f'{S} * 3', f'{S} % 13 = 0')} AS yield_efficiency, {rating(f'{S} * 4 + 1', f'{S} % 14 = 0')} AS anchorage,
  {rating(f'{S} + 1', f'{S} % 5 = 0')} AS fire_blight, {rating(f'{S} * 2 + 1', f'{S} % 6 = 0')} AS collar_rot, {rating(f'{S} * 3 + 2', f'{S} % 7 = 0')} AS woolly_aphid,
  {rating(f'{S} + 3', f'{S} % 8 = 0')} AS drought, {rating(f'{S} * 7', f'{S} % 9 = 0')} AS wet_soil, {rating(f'{S} * 9 + 2', f'{S} % 10 = 0')} AS poor_soil,
  CASE WHEN {S} % 7 = 3 THEN NULL ELSE CAST(3 + {S} % 6 AS INT) END AS hardiness_zone, CASE WHEN {S} % 9 = 0 THEN NULL ELSE list_value(1e0 + {S} % 4, 2e0 + {S} % 6) END AS height_m,
  {pick(S, ['common', 'specialist', 'rare', 'not-available'], f'{S} % 15 = 0')} AS uk_availability, {pick(f'{S} * 5', ['high', 'medium', 'low'])} AS conf, {S} % 4 = 0 AS listed
FROM {{supplier}}"""
FIXTURES["asked_rootstock"] = "SELECT DISTINCT l_suppkey AS rootstock_id, l_partkey % (SELECT count(*) FROM {supplier}) AS place_id FROM {lineitem}"
# favourites: the parts each customer ordered, in order of order number
FIXTURES["favourite"] = """SELECT o.o_custkey AS selection_id, l.l_partkey AS variety_id, min(o.o_orderkey * 10 + l.l_linenumber) AS added
FROM {orders} o JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_custkey, l.l_partkey"""
