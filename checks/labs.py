"""Name matching, laboratory and panel queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import FIXTURES, fixture, oracle, query, ratio_sql
from checks.climate import rounded
from checks.orchard import pick
from graftline.functions import calendar as cal
from graftline.functions import names as nm
from graftline.functions import numeric as nu
from graftline.operators import lab
from graftline.operators import matching as mt
from graftline.plans.panel import kept_accessions

# names of parts, suppliers and customers as lists write them: case, accents, apostrophes, entities, qualifiers
FIXTURES["listed_name"] = """
SELECT p_partkey AS name_id, """ + pick("p_partkey", ["wikipedia-article", "wikipedia-list", "nfc", "abc", "grin", "refpop"]) + """ AS list,
  CASE WHEN p_partkey % 9 = 0 THEN upper(p_name) WHEN p_partkey % 9 = 1 THEN replace(p_name, ' ', '-') || ' apple' WHEN p_partkey % 9 = 2 THEN 'Malus ''' || p_name || '''' WHEN p_partkey % 9 = 3 THEN p_name || ' (3n)'
    WHEN p_partkey % 9 = 4 THEN 'St. ' || replace(p_name, 'e', 'é') WHEN p_partkey % 9 = 5 THEN replace(p_name, ' ', '''s ') || ' (apple)' WHEN p_partkey % 9 = 6 THEN 'Lady ' || p_name || ' apple' WHEN p_partkey % 9 = 7 THEN p_name || ' &amp; ' || p_brand ELSE p_name || '’s' END AS name,
  p_brand AS brand FROM {part}
UNION ALL SELECT 1000000 + s_suppkey AS name_id, 'toc' AS list, CASE WHEN s_suppkey % 3 = 0 THEN 'Saint  ' || s_name || CASE WHEN s_suppkey % 2 = 0 THEN ' Stra&szlig;e' ELSE '' END WHEN s_suppkey % 3 = 1 THEN replace(s_name, 'u', CASE WHEN s_suppkey % 4 = 0 THEN 'ü' WHEN s_suppkey % 4 = 1 THEN '&#233;' ELSE '&#xE9;' END) ELSE 'AB-' || CAST(s_suppkey AS STRING) END AS name, 'x' AS brand FROM {supplier}
UNION ALL SELECT 2000000 + c_custkey AS name_id, CASE WHEN c_custkey % 2 = 0 THEN 'pomiferous' ELSE 'eurisco' END AS list, CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment || ' rootstock' WHEN c_custkey % 5 = 1 THEN 'Crab Apple' WHEN c_custkey % 5 = 2 THEN replace(c_name, 'o', 'ö') || ' Pippin' ELSE c_mktsegment || ' ' || CAST(c_custkey % 97 AS STRING) || '''s' END AS name, 'y' AS brand FROM {customer}"""
Q = "''"


def decoded_sql(x: str) -> str:
    """The entities that the fixtures hold."""
    return f"replace(replace(replace(replace({x}, '&#233;', 'é'), '&#xE9;', 'é'), '&szlig;', 'ß'), '&amp;', '&')"


def key_sql(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents({decoded_sql(x)})), '[''’‘`]', '', 'g'), '\\b(st|saint)\\.?\\s', 'st ', 'g'), '[^a-z0-9]+', ' ', 'g'))"


def loose_sql(x: str) -> str:
    return key_sql(f"regexp_replace(regexp_replace({decoded_sql(x)}, '(\\w)[''’]s\\b', '\\1', 'g'), '(\\w)s[''’](\\s|$)', '\\1s\\2', 'g')")


def build_sql(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(strip_accents({x})), '[''’]', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"


def upper_sql(x: str) -> str:
    return f"upper(trim(regexp_replace(regexp_replace(strip_accents({x}), '[’''`]', '', 'g'), '[^A-Za-z0-9]+', ' ', 'g')))"


TITLE = """CASE WHEN regexp_matches(m, '(?i)^(lady|crab|pine|winter|summer)\\b') THEN trim(m) ELSE trim(regexp_replace(m, '(?i)\\s+(apple|apples)$', '')) END"""


@query("name_keys", oracle(["listed_name"], f"""SELECT name_id, {key_sql('name')} AS name_key, {loose_sql('name')} AS loose_key, {build_sql('name')} AS build_key, {upper_sql('name')} AS upper_key,
 regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(trim(regexp_replace(name, '\\s+', ' ', 'g')))), '[’''`]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, {TITLE} AS title,
 {key_sql('name')} AS full_key FROM (SELECT *, regexp_replace(regexp_replace(name, '(?i)\\s*\\((apple|cultivar|apple cultivar|malus)\\)$', ''), '^Malus\\s+[''‘]?(.+?)[''’]?$', '\\1') AS m FROM listed_name)"""))
def name_keys(spark, sf):
    return fixture(spark, sf, "listed_name").select("name_id", nm.name_key("name").alias("name_key"), nm.loose_key("name").alias("loose_key"), nm.build_key("name").alias("build_key"), nm.upper_key("name").alias("upper_key"),
                                                    nm.slug("name").alias("slug"), nm.clean_title("name").alias("title"), nm.name_key_full("name").alias("full_key"))


HEAD = f"""hk0 AS (SELECT name_id, unnest([{upper_sql('name')}, {upper_sql('brand')}]) AS k FROM listed_name),
hk1 AS (SELECT name_id, k, trim(replace(regexp_replace(k, '\\bS\\b', '', 'g'), '  ', ' ')) AS k2 FROM hk0 WHERE length(k) >= 5),
hk AS (SELECT DISTINCT name_id, x FROM (SELECT name_id, k AS x FROM hk1 UNION ALL SELECT name_id, k2 FROM hk1 UNION ALL SELECT name_id, regexp_replace(k2, ' (PIPPIN|PEARMAIN|SEEDLING|APPLE)$', '') FROM hk1) WHERE length(x) >= 5 AND (contains(x, ' ') OR length(x) >= 7))"""


@query("heading_keys", oracle(["listed_name"], "SELECT name_id, x AS heading FROM hk", HEAD))
def heading_keys(spark, sf):
    return fixture(spark, sf, "listed_name").select("name_id", F.explode(nm.heading_keys("name", F.array("brand"))).alias("heading"))


# variety names for matching: few, so that keys collide; other names from brand and type
FIXTURES["named_variety"] = """SELECT p_partkey AS variety_id, p_name || CASE WHEN p_partkey % 3 = 0 THEN '''s ' ELSE ' ' END || CAST(p_partkey % 300 AS STRING) AS name,
  list_value(p_type || ' ' || CAST(p_partkey % 1700 AS STRING), p_name || ' ' || CAST((p_partkey + 1) % 300 AS STRING)) AS aka FROM {part}"""
FIXTURES["source_name"] = """SELECT DISTINCT l.l_returnflag AS source, CASE WHEN l.l_linenumber = 1 THEN upper(v.name) WHEN l.l_linenumber = 2 THEN v.p_type || ' ' || CAST(l.l_partkey % 1700 AS STRING) WHEN l.l_linenumber = 3 THEN replace(v.name, '''s', '') ELSE v.name || ' x' END AS name
FROM {lineitem} l JOIN (SELECT p_partkey, p_type, p_name || CASE WHEN p_partkey % 3 = 0 THEN '''s ' ELSE ' ' END || CAST(p_partkey % 300 AS STRING) AS name FROM {part}) v ON v.p_partkey = l.l_partkey"""
FIXTURES["curated_name"] = "SELECT 'A' AS source, p_name || ' ' || CAST(p_partkey % 300 AS STRING) || ' x' AS name, max(p_partkey) AS variety_id FROM {part} WHERE p_partkey % 5 = 1 GROUP BY p_name || ' ' || CAST(p_partkey % 300 AS STRING) || ' x'"
FIXTURES["rejected_name"] = "SELECT DISTINCT 'R' AS source, p_type || ' ' || CAST(p_partkey % 1700 AS STRING) AS name FROM {part} WHERE p_size = 7"
INDEX = f"""an AS (SELECT variety_id, 0 AS pos, name, 'exact' AS kind FROM named_variety UNION ALL SELECT variety_id, i, aka[i], 'synonym' FROM named_variety, (SELECT unnest([1, 2]) AS i)),
ix0 AS (SELECT {key_sql('name')} AS key, min(CASE WHEN kind = 'exact' THEN variety_id END) AS e0, max(CASE WHEN kind = 'exact' THEN variety_id END) AS e1, min(variety_id) AS s0, max(variety_id) AS s1 FROM an GROUP BY 1),
ix AS (SELECT key, TRUE AS strict, CASE WHEN e0 IS NOT NULL THEN e0 ELSE s0 END AS variety_id, CASE WHEN e0 IS NULL THEN 'synonym' ELSE 'exact' END AS kind FROM ix0 WHERE key <> '' AND ((e0 IS NOT NULL AND e0 = e1) OR (e0 IS NULL AND s0 = s1))
 UNION ALL SELECT key, FALSE, s0, 'probable' FROM (SELECT {loose_sql('name')} AS key, min(variety_id) AS s0, max(variety_id) AS s1 FROM an GROUP BY 1) WHERE key <> '' AND s0 = s1),
mn AS (SELECT n.source, n.name, coalesce(c.variety_id, a.variety_id, b.variety_id) AS variety_id, CASE WHEN c.variety_id IS NOT NULL THEN 'probable' WHEN a.variety_id IS NOT NULL THEN a.kind ELSE 'probable' END AS kind
 FROM source_name n LEFT JOIN curated_name c ON c.source = n.source AND c.name = n.name LEFT JOIN (SELECT * FROM ix WHERE strict) a ON a.key = {key_sql('n.name')} LEFT JOIN (SELECT * FROM ix WHERE NOT strict) b ON b.key = {loose_sql('n.name')}
 WHERE NOT EXISTS (SELECT 1 FROM rejected_name r WHERE r.source = n.source AND r.name = n.name) AND coalesce(c.variety_id, a.variety_id, b.variety_id) IS NOT NULL)"""
NAMES = ("named_variety", "source_name", "curated_name", "rejected_name")


def _index(spark, sf):
    return mt.name_index(fixture(spark, sf, "named_variety"))


def _matches(spark, sf):
    return mt.match_names(fixture(spark, sf, "source_name"), _index(spark, sf), fixture(spark, sf, "curated_name"), fixture(spark, sf, "rejected_name"))


@query("name_index", oracle(["named_variety", "source_name", "curated_name", "rejected_name"], "SELECT * FROM ix", INDEX))
def name_index(spark, sf):
    return _index(spark, sf)


@query("ambiguous_keys", oracle(NAMES, "SELECT key FROM ix0 WHERE key <> '' AND NOT ((e0 IS NOT NULL AND e0 = e1) OR (e0 IS NULL AND s0 = s1))", INDEX))
def ambiguous_keys(spark, sf):
    return mt.ambiguous_keys(fixture(spark, sf, "named_variety"))


@query("matched_names", oracle(NAMES, "SELECT * FROM mn", INDEX))
def matched_names(spark, sf):
    return _matches(spark, sf)


@query("match_review", oracle(NAMES, "SELECT mn.*, v.name AS own_name FROM mn JOIN named_variety v USING (variety_id) WHERE mn.name <> v.name", INDEX))
def match_review(spark, sf):
    return mt.review(_matches(spark, sf), fixture(spark, sf, "named_variety"))


CLOSE = f"""ours AS (SELECT {key_sql('name')} AS known, max(variety_id) AS variety_id FROM an WHERE {key_sql('name')} <> '' GROUP BY 1),
ms AS (SELECT source, name, {key_sql('name')} AS ask FROM (SELECT DISTINCT source, name FROM source_name WHERE (source, name) NOT IN (SELECT (source, name) FROM mn)) WHERE {key_sql('name')} <> ''),
cp AS (SELECT known AS a, ask AS b FROM ours, (SELECT DISTINCT ask FROM ms) WHERE levenshtein(known, ask) <= floor((length(known) + length(ask)) * 0.2 + 1e-9)),
{ratio_sql('cp')},
top AS (SELECT a AS known, b AS ask, ratio, row_number() OVER (PARTITION BY b ORDER BY ratio DESC, a DESC)::INT AS rank FROM gr WHERE ratio >= 0.8 QUALIFY rank <= 3)"""


@query("close_names", oracle(NAMES, """SELECT source, name, known, variety_id, CASE WHEN rank IS NULL THEN 'contained' ELSE 'spelling' END AS how, ratio, rank FROM (SELECT * FROM ms, ours) LEFT JOIN top USING (known, ask)
 WHERE rank IS NOT NULL OR list_has_all(string_split(ask, ' '), string_split(known, ' ')) OR (len(list_distinct(string_split(ask, ' '))) > 1 AND list_has_all(string_split(known, ' '), string_split(ask, ' ')))""", INDEX + ",\n" + CLOSE).replace("WITH ", "WITH RECURSIVE ", 1))
def close_names(spark, sf):
    missing = mt.unmatched(fixture(spark, sf, "source_name"), _matches(spark, sf))
    return mt.close_names(missing, fixture(spark, sf, "named_variety"))


@query("name_collisions", oracle(NAMES, f"SELECT {build_sql('name')} AS key, count(DISTINCT variety_id) AS varieties FROM an GROUP BY 1 HAVING count(DISTINCT variety_id) > 1", INDEX))
def name_collisions(spark, sf):
    return mt.name_collisions(fixture(spark, sf, "named_variety"))


@query("name_list", oracle(["named_variety"], "SELECT variety_id, name, array_to_string(aka, '; ') AS aka FROM named_variety"))
def name_list(spark, sf):
    return mt.name_list(fixture(spark, sf, "named_variety"))


FIXTURES["place_names"] = """SELECT s.s_suppkey AS place_id, list_value(min(v.name), upper(max(v.name)), max(v.aka1), 'no such fruit', min(v.name)) AS local_names
FROM {lineitem} l JOIN {supplier} s ON s.s_suppkey = l.l_suppkey JOIN (SELECT p_partkey, p_name || CASE WHEN p_partkey % 3 = 0 THEN '''s ' ELSE ' ' END || CAST(p_partkey % 300 AS STRING) AS name, p_type || ' ' || CAST(p_partkey % 1700 AS STRING) AS aka1 FROM {part}) v ON v.p_partkey = l.l_partkey GROUP BY s.s_suppkey"""


@query("linked_place_names", oracle(NAMES + ("place_names",), f"""SELECT place_id, variety_id, min(pos) AS pos FROM (SELECT place_id, i - 1 AS pos, {build_sql('local_names[i]')} AS key FROM place_names, (SELECT unnest(range(1, 6)) AS i)) p JOIN (
 SELECT key, coalesce(arg_max(variety_id, (mk, variety_id)) FILTER (WHERE pos = 0), arg_min(variety_id, (mk, variety_id, pos)) FILTER (WHERE pos > 0)) AS variety_id
 FROM (SELECT a.variety_id, a.pos, {build_sql('a.name')} AS key, {build_sql('v.name')} AS mk FROM an a JOIN named_variety v USING (variety_id)) GROUP BY key) USING (key) GROUP BY place_id, variety_id""", INDEX))
def linked_place_names(spark, sf):
    return mt.link_names(fixture(spark, sf, "place_names"), fixture(spark, sf, "named_variety"))


# ---- accessions -----------------------------------------------------------------------------
FIXTURES["accession_name"] = """SELECT ((l.l_orderkey * 10 + l.l_linenumber) * 100000 + l.l_partkey) * 10000 + l.l_suppkey AS accession_id, 'P' AS source, v.name || CASE WHEN l.l_linenumber = 1 THEN '' WHEN l.l_linenumber = 2 THEN ' (LA 12A)' WHEN l.l_linenumber = 3 THEN ' EMLA 4' WHEN l.l_linenumber = 4 THEN ' (Kent)'
  WHEN l.l_linenumber = 5 THEN ' (red sport)' WHEN l.l_linenumber = 6 THEN ' unknown (syn ' || v.aka1 || ')' ELSE '  (' || v.aka1 || ') (a)' END AS name, CASE WHEN l.l_suppkey % 4 = 0 THEN '' ELSE 'G' || CAST(l.l_suppkey % 3 AS STRING) END AS munq,
  CASE WHEN l.l_quantity > 45 THEN NULL ELSE CAST(1 + CAST(floor(l.l_quantity) AS INT) % 9 AS DOUBLE) END AS sweet, CAST(1 + l.l_suppkey % 9 AS DOUBLE) AS acid, CAST(1 + l.l_partkey % 9 AS DOUBLE) AS balance, CASE WHEN l.l_partkey % 4 = 0 THEN NULL ELSE CAST(1 + l.l_orderkey % 9 AS DOUBLE) END AS aroma,
  CAST(1 + (l.l_orderkey + l.l_suppkey) % 9 AS DOUBLE) AS firm, CAST(1 + (l.l_orderkey * 3) % 9 AS DOUBLE) AS crunch, CAST(1 + (l.l_partkey * 5) % 9 AS DOUBLE) AS juice, CAST(1 + (l.l_partkey + l.l_orderkey) % 9 AS DOUBLE) AS quality,
  CASE WHEN l.l_suppkey % 5 = 0 THEN NULL ELSE l.l_linestatus || CAST(l.l_suppkey % 2 AS STRING) END AS pick, l.l_returnflag AS keeps_to
FROM {lineitem} l JOIN (SELECT p_partkey, p_name || CASE WHEN p_partkey % 3 = 0 THEN '''s ' ELSE ' ' END || CAST(p_partkey % 300 AS STRING) AS name, p_type || ' ' || CAST(p_partkey % 1700 AS STRING) AS aka1 FROM {part}) v ON v.p_partkey = l.l_partkey"""
FIXTURES["no_curated"] = "SELECT 'P' AS source, p_name AS name, max(p_partkey) AS variety_id FROM {part} GROUP BY p_name"


CLASSIFY = INDEX + f""",
pa AS (SELECT accession_id, trim(regexp_replace(name, '\\s+', ' ', 'g')) AS name FROM accession_name),
pb AS (SELECT *, list_transform(regexp_extract_all(name, '\\(([^()]*)(?:\\)|$)', 1), lambda q: trim(q)) AS ins, trim(split_part(name, '(', 1)) AS b0 FROM pa),
pc AS (SELECT accession_id, name, trim(regexp_replace(b0, '(?i)\\s+((?:EM)?LA\\s*\\d+\\w*)$', '')) AS base, list_concat(list_filter(ins, lambda q: q <> '' AND NOT regexp_matches(q, '(?i)^syn\\.?\\s+')), CASE WHEN regexp_matches(b0, '(?i)\\s+((?:EM)?LA\\s*\\d+\\w*)$') THEN [regexp_extract(b0, '(?i)\\s+((?:EM)?LA\\s*\\d+\\w*)$', 1)] ELSE [] END) AS quals,
  list_transform(list_filter(ins, lambda q: regexp_matches(q, '(?i)^syn\\.?\\s+')), lambda q: trim(regexp_extract(q, '(?i)^syn\\.?\\s+(.+)$', 1))) AS syns FROM pb),
pd AS (SELECT * FROM pc WHERE NOT regexp_matches(base, '(?i)\\b(?:sport|spur|mutation|clone|compact|self-fertile|strain|supposed|[4-8][nx])\\b|\\?') AND len(list_filter(quals, lambda q: regexp_matches(q, '(?i)\\b(?:sport|spur|mutation|clone|compact|self-fertile|strain|supposed|[4-8][nx])\\b|\\?'))) = 0),
lk AS (SELECT DISTINCT c AS cand FROM (SELECT name AS c FROM pd UNION ALL SELECT base FROM pd UNION ALL SELECT unnest(syns) FROM pd UNION ALL SELECT unnest(quals) FROM pd)),
lu AS (SELECT cand, coalesce(c.variety_id, a.variety_id, b.variety_id) AS vid, CASE WHEN c.variety_id IS NOT NULL THEN 'probable' WHEN a.variety_id IS NOT NULL THEN a.kind WHEN b.variety_id IS NOT NULL THEN 'probable' END AS kind FROM lk LEFT JOIN no_curated c ON c.name = cand
  LEFT JOIN (SELECT * FROM ix WHERE strict) a ON a.key = {key_sql('cand')} LEFT JOIN (SELECT * FROM ix WHERE NOT strict) b ON b.key = {loose_sql('cand')} WHERE coalesce(c.variety_id, a.variety_id, b.variety_id) IS NOT NULL),
tr AS (SELECT accession_id, 0 AS pos, name AS cand FROM pd UNION ALL SELECT accession_id, 1, base FROM pd UNION ALL SELECT accession_id, 2, unnest(syns) FROM pd),
hit AS (SELECT accession_id, arg_min((vid, lu.kind, tr.cand), pos) AS h FROM tr JOIN lu USING (cand) GROUP BY accession_id),
cl0 AS (SELECT p.accession_id, p.name, h[1] AS variety_id, h[2] AS kind, h[3] = p.name AS whole, p.quals FROM pd p JOIN hit USING (accession_id)),
oth AS (SELECT DISTINCT accession_id FROM (SELECT accession_id, variety_id, unnest(quals) AS q FROM cl0 WHERE NOT whole) x LEFT JOIN lu ON lu.cand = q WHERE NOT regexp_matches(q, '(?i)^(?:(?:EM)?LA\\s*\\d*\\w*|EMLA\\s*\\d*|EM|NFT\\s*\\d*|[23][nx]|[ab])$') AND (lu.vid IS NULL OR lu.vid <> variety_id)),
cls AS (SELECT c.accession_id, 'P' AS source, c.name, variety_id, kind, CASE WHEN kind = 'probable' OR o.accession_id IS NOT NULL THEN 'loose' ELSE 'firm' END AS tier, CASE WHEN kind = 'probable' THEN 'spelling variant' WHEN o.accession_id IS NOT NULL THEN 'qualifier' ELSE '' END AS note,
  whole AND contains(c.name, '(') AS full_hit FROM cl0 c LEFT JOIN oth o USING (accession_id))"""
ACC = NAMES + ("accession_name", "no_curated")


def _classified(spark, sf):
    return mt.classify_accessions(fixture(spark, sf, "accession_name"), _index(spark, sf), fixture(spark, sf, "no_curated"))


@query("classified_accessions", oracle(ACC, "SELECT * FROM cls", CLASSIFY))
def classified_accessions(spark, sf):
    return _classified(spark, sf)


PKEEP = CLASSIFY + """,
pm AS (SELECT c.*, a.munq, a.sweet, a.acid, a.balance, a.aroma, a.firm, a.crunch, a.juice, a.quality, a.pick, a.keeps_to FROM cls c JOIN accession_name a USING (accession_id)),
pk0 AS (SELECT *, tier = 'firm' OR NOT EXISTS (SELECT 1 FROM pm f WHERE f.variety_id = pm.variety_id AND f.tier = 'firm') OR (munq <> '' AND EXISTS (SELECT 1 FROM pm f WHERE f.variety_id = pm.variety_id AND f.tier = 'firm' AND f.munq = pm.munq)) AS k FROM pm),
tops AS (SELECT variety_id, munq AS top FROM (SELECT variety_id, munq, row_number() OVER (PARTITION BY variety_id ORDER BY count(*) DESC, bool_or(full_hit) DESC, bool_or(kind = 'exact') DESC, min(accession_id)) AS rn FROM pk0 WHERE k AND munq <> '' GROUP BY variety_id, munq) WHERE rn = 1),
pkeep AS (SELECT p.*, k AND NOT (munq <> '' AND munq <> coalesce(top, munq)) AS kept, CASE WHEN k AND munq <> '' AND munq <> top THEN 'other_genotype ' || munq || ' ' || top WHEN NOT k THEN 'weaker_match' END AS reason FROM pk0 p LEFT JOIN tops USING (variety_id))"""


def _kept(spark, sf, rows="accession_name"):
    return kept_accessions(fixture(spark, sf, rows), _index(spark, sf), fixture(spark, sf, "no_curated"))


@query("panel_dropped", oracle(ACC, "SELECT p.variety_id, p.accession_id, a.name, reason FROM pkeep p JOIN accession_name a USING (accession_id) WHERE NOT kept", PKEEP))
def panel_dropped(spark, sf):
    return lab.panel_dropped(_kept(spark, sf))


MODE = "(SELECT arg_max({f}, (c, -o)) FROM (SELECT {f}, count(*) AS c, min(accession_id) AS o FROM pkeep q WHERE q.kept AND q.variety_id = p.variety_id AND {f} <> '' GROUP BY {f}))"


# the rows of the panel as they come, with the dates of picking and tasting
FIXTURES["panel_row"] = FIXTURES["accession_name"].replace(" AS keeps_to\n", " AS keeps_to, CASE WHEN l.l_suppkey % 7 = 0 THEN NULL ELSE CAST(l.l_shipdate AS STRING) END AS harvest, CAST(year(l.l_shipdate) + 1 AS INT) AS tasted\n")
KEPT_ORDER = "ORDER BY tier <> 'firm', accession_id"


@query("panel_records", oracle(ACC + ("panel_row",), f"""SELECT variety_id, {', '.join(f'round_even(avg({s}), 1) AS {s}' for s in lab.PANEL_SCORES)}, count(*) AS n, CASE WHEN bool_or(tier = 'firm') AND bool_or(kind = 'exact') THEN 'exact' WHEN bool_or(tier = 'firm') THEN 'synonym' ELSE 'probable' END AS match,
 any_value(pick1) AS pick, any_value(keeps1) AS keeps_to, string_agg(name, '; ' {KEPT_ORDER}) AS accession, list(accession_id {KEPT_ORDER}) AS accessions, list(harvest {KEPT_ORDER}) AS harvest, list(tasted {KEPT_ORDER}) AS tasted,
 {', '.join(f"CASE WHEN count(*) > 1 THEN list({x} {KEPT_ORDER}) END AS each_{c}" for c, x in {'name': 'name', 'munq': "nullif(munq, '')", **{s: s for s in lab.PANEL_SCORES}}.items())}
 FROM (SELECT p.*, r.harvest, r.tasted, m1.pick1, m2.keeps1 FROM pkeep p JOIN panel_row r USING (accession_id) LEFT JOIN (SELECT variety_id, arg_max(pick, (c, -o)) AS pick1 FROM (SELECT variety_id, pick, count(*) AS c, min(accession_id) AS o FROM pkeep WHERE kept AND pick <> '' GROUP BY variety_id, pick) GROUP BY variety_id) m1 USING (variety_id)
 LEFT JOIN (SELECT variety_id, arg_max(keeps_to, (c, -o)) AS keeps1 FROM (SELECT variety_id, keeps_to, count(*) AS c, min(accession_id) AS o FROM pkeep WHERE kept AND keeps_to <> '' GROUP BY variety_id, keeps_to) GROUP BY variety_id) m2 USING (variety_id) WHERE kept) GROUP BY variety_id""", PKEEP))
def panel_records(spark, sf):
    return lab.panel_records(_kept(spark, sf, "panel_row"))


FIXTURES["assessment"] = "SELECT ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS accession_id, CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE CAST(l_shipdate AS STRING) END AS harvest, CAST(year(l_shipdate) + 1 AS INT) AS tasted FROM {lineitem}"


@query("panel_assessments", oracle(ACC + ("assessment",), "SELECT variety_id, row_number() OVER (PARTITION BY variety_id ORDER BY accession_id) AS nth, accession_id, a.name, harvest, tasted FROM pkeep p JOIN assessment USING (accession_id) JOIN accession_name a USING (accession_id) WHERE kept", PKEEP))
def panel_assessments(spark, sf):
    return lab.panel_assessments(_kept(spark, sf).join(fixture(spark, sf, "assessment"), "accession_id"))


# ---- laboratory -------------------------------------------------------------------------------
FIXTURES["lab_obs"] = """SELECT l_returnflag AS source, l_partkey AS variety_id, l_suppkey AS accession, CASE WHEN l_partkey % 6 = 0 OR l_linenumber >= 6 THEN 'storage' ELSE 'harvest' END AS stage,
  CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_quantity END AS ssc, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE floor(l_tax * 100e0 + 0.5e0) END AS ta, CASE WHEN l_discount = 0 THEN NULL ELSE floor(l_discount * 100e0 + 0.5e0) END AS firm,
  CAST(year(l_shipdate) AS INT) AS year, """ + pick("l_partkey + l_suppkey", ["exact", "synonym", "exact", "probable"]) + """ AS kind FROM {lineitem}"""
LAB = """
la AS (SELECT source, variety_id, accession, stage, avg(ssc) AS ssc, avg(ta) AS ta, avg(firm) AS firm, min(year) AS y0, max(year) AS y1, max(CASE kind WHEN 'exact' THEN 0 WHEN 'synonym' THEN 1 ELSE 2 END) AS kr FROM lab_obs GROUP BY source, variety_id, accession, stage HAVING coalesce(avg(ssc), avg(ta), avg(firm)) IS NOT NULL),
lb AS (SELECT source, variety_id, stage, avg(ssc) AS ssc, avg(ta) AS ta, avg(firm) AS firm, count(*) AS n, min(y0) AS y0, max(y1) AS y1, max(kr) AS kr FROM la GROUP BY source, variety_id, stage),
lr AS (SELECT b.source, b.variety_id, round_even(b.ssc, 1) AS ssc, round_even(b.ta, 2) AS ta, round_even(b.firm, 2) AS firm, b.n, CASE WHEN b.y0 = b.y1 THEN b.y0::VARCHAR ELSE b.y0 || '-' || b.y1 END AS years, ['exact', 'synonym', 'probable'][b.kr + 1] AS match, b.stage,
  round_even(s.ssc, 1) AS storage_ssc, round_even(s.ta, 2) AS storage_ta, round_even(s.firm, 2) AS storage_firm
  FROM lb b LEFT JOIN lb s ON s.source = b.source AND s.variety_id = b.variety_id AND s.stage = 'storage' AND b.stage = 'harvest'
  WHERE b.stage = 'harvest' OR NOT EXISTS (SELECT 1 FROM lb h WHERE h.source = b.source AND h.variety_id = b.variety_id AND h.stage = 'harvest'))"""
PCT = LAB + """,
pc AS (SELECT *, round_even(100 * ((SELECT count(*) FROM lr x WHERE x.source = lr.source AND x.ssc < lr.ssc) + 0.5::DOUBLE * (SELECT count(*) FROM lr x WHERE x.source = lr.source AND x.ssc = lr.ssc)) / (SELECT count(x.ssc) FROM lr x WHERE x.source = lr.source), 0) AS p1,
 round_even(100 * ((SELECT count(*) FROM lr x WHERE x.source = lr.source AND x.ta < lr.ta) + 0.5::DOUBLE * (SELECT count(*) FROM lr x WHERE x.source = lr.source AND x.ta = lr.ta)) / (SELECT count(x.ta) FROM lr x WHERE x.source = lr.source), 0) AS p2 FROM lr),
pct AS (SELECT * EXCLUDE (p1, p2), CASE WHEN ssc IS NOT NULL THEN p1::INT END AS pct_ssc, CASE WHEN ta IS NOT NULL THEN p2::INT END AS pct_ta FROM pc)"""


def records(spark, sf):
    return lab.lab_records(fixture(spark, sf, "lab_obs"))


def ranked(spark, sf):
    return lab.midrank_pct(lab.midrank_pct(records(spark, sf), "ssc"), "ta", 0.25)


@query("lab_records", oracle(["lab_obs"], "SELECT * FROM lr", LAB))
def lab_records(spark, sf):
    return records(spark, sf)


@query("lab_accessions", oracle(["lab_obs"], "SELECT source, variety_id, accession, round_even(ssc, 1) AS ssc, round_even(ta, 2) AS ta, round_even(firm, 2) AS firm FROM (SELECT *, count(*) OVER (PARTITION BY source, variety_id) AS n FROM la WHERE stage = 'harvest') WHERE n > 1", LAB))
def lab_accessions(spark, sf):
    return lab.lab_accessions(fixture(spark, sf, "lab_obs"))


@query("lab_percentiles", oracle(["lab_obs"], "SELECT source, variety_id, ssc, ta, pct_ssc, pct_ta FROM pct", PCT))
def lab_percentiles(spark, sf):
    return ranked(spark, sf).select("source", "variety_id", "ssc", "ta", "pct_ssc", "pct_ta")


@query("measured_varieties", oracle(["lab_obs"], "SELECT variety_id, round_even(sum(CAST(round(ssc * 10) AS BIGINT)) / count(ssc) / 10, 1) AS ssc, round_even(sum(CAST(round(ta * 100) AS BIGINT)) / count(ta) / 100, 1) AS ta, round_even(avg(pct_ssc), 1) AS pct_ssc, round_even(avg(pct_ta), 1) AS pct_ta, count(*) AS n FROM pct GROUP BY variety_id", PCT))
def measured_varieties(spark, sf):
    return lab.measured(ranked(spark, sf))


@query("taste_quadrants", oracle(["lab_obs"], """SELECT variety_id, CASE WHEN a >= 50 AND b >= 50 THEN 'Sweet & sharp' WHEN b >= 50 THEN 'Sharp' WHEN a >= 50 THEN 'Sweet & mild' ELSE 'Mild' END AS quadrant FROM (SELECT variety_id, round_even(avg(pct_ssc), 1) AS a, round_even(avg(pct_ta), 1) AS b FROM pct GROUP BY variety_id) WHERE a IS NOT NULL AND b IS NOT NULL""", PCT))
def taste_quadrants(spark, sf):
    from graftline.operators.views import quadrants

    return quadrants(lab.measured(ranked(spark, sf))).select("variety_id", "quadrant")


@query("lab_coverage", oracle(["lab_obs"], """SELECT count(DISTINCT variety_id) AS any_data, count(DISTINCT CASE WHEN ssc IS NOT NULL THEN variety_id END) AS with_ssc, count(DISTINCT CASE WHEN ta IS NOT NULL THEN variety_id END) AS with_ta, count(DISTINCT CASE WHEN firm IS NOT NULL THEN variety_id END) AS with_firm,
 (SELECT count(*) FROM (SELECT variety_id FROM lr WHERE ssc IS NOT NULL INTERSECT SELECT variety_id FROM lr WHERE ta IS NOT NULL)) AS with_both, count(DISTINCT CASE WHEN ssc IS NOT NULL AND ta IS NOT NULL THEN variety_id END) AS both_one_source FROM lr""", LAB))
def lab_coverage(spark, sf):
    return lab.lab_coverage(records(spark, sf))


@query("sugar_range_gate", oracle(["lab_obs"], "SELECT source, variety_id, accession, ssc, ssc BETWEEN 4 AND 32 AS plausible, count(*) AS n FROM lab_obs WHERE ssc IS NOT NULL GROUP BY ALL"))
def sugar_range_gate(spark, sf):
    return lab.range_gate(fixture(spark, sf, "lab_obs")).groupBy("source", "variety_id", "accession", "ssc", "plausible").agg(F.count("*").alias("n"))


FIXTURES["wide_trial"] = "SELECT l_orderkey, l_linenumber, l_quantity AS h16, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity / 2e0 END AS s16, CASE WHEN l_returnflag = 'R' THEN l_tax * 100e0 END AS ta17 FROM {lineitem}"


@query("yearly_columns", oracle(["wide_trial"], """SELECT l_orderkey, l_linenumber, measure, stage, year, round(value, 6) AS value FROM (SELECT l_orderkey, l_linenumber, 'ssc' AS measure, 'harvest' AS stage, 2016 AS year, h16 AS value FROM wide_trial UNION ALL
 SELECT l_orderkey, l_linenumber, 'ssc', 'storage', 2016, s16 FROM wide_trial UNION ALL SELECT l_orderkey, l_linenumber, 'ta', 'harvest', 2017, ta17 FROM wide_trial) WHERE value IS NOT NULL"""))
def yearly_columns(spark, sf):
    return rounded(lab.yearly_columns(fixture(spark, sf, "wide_trial"), ["l_orderkey", "l_linenumber"], {"h16": ("ssc", "harvest", 2016), "s16": ("ssc", "storage", 2016), "ta17": ("ta", "harvest", 2017)}), "value")


FIXTURES["trial_row"] = "SELECT l_orderkey, l_linenumber, l_partkey AS genotype, CASE WHEN l_linenumber % 2 = 0 THEN 'M1' ELSE 'M2' END AS management, CAST(floor(l_discount * 100e0 + 0.5e0) AS DOUBLE) AS firm FROM {lineitem}"
FIXTURES["genotype_name"] = "SELECT p_partkey AS genotype, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN '' ELSE p_name END AS name FROM {part}"


@query("trial_observations", oracle(["trial_row", "genotype_name"], "SELECT l_orderkey, l_linenumber, genotype, name, nullif(firm, 0) AS firm FROM trial_row JOIN genotype_name USING (genotype) WHERE management = 'M1' AND name <> ''"))
def trial_observations(spark, sf):
    return lab.trial_observations(fixture(spark, sf, "trial_row"), fixture(spark, sf, "genotype_name")).drop("management")


FIXTURES["descriptor_sugar"] = "SELECT l_suppkey AS accession, CAST(year(l_shipdate) AS INT) AS year, l_quantity AS value FROM {lineitem} WHERE l_returnflag = 'A'"
FIXTURES["descriptor_firm"] = "SELECT l_suppkey AS accession, CAST(year(l_shipdate) AS INT) AS year, l_tax AS value FROM {lineitem} WHERE l_returnflag <> 'A'"


@query("descriptor_union", oracle(["descriptor_sugar", "descriptor_firm"], "SELECT accession, year, sum(ssc) AS ssc, count(firm) AS firms FROM (SELECT accession, year, value AS ssc, NULL AS firm FROM descriptor_sugar UNION ALL SELECT accession, year, NULL, value FROM descriptor_firm) GROUP BY accession, year"))
def descriptor_union(spark, sf):
    return lab.descriptor_union(fixture(spark, sf, "descriptor_sugar"), fixture(spark, sf, "descriptor_firm")).groupBy("accession", "year").agg(F.sum("ssc").alias("ssc"), F.count("firm").alias("firms"))


FIXTURES["raw_cell"] = """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN ' ' || CAST(l_quantity AS STRING) || ' ' WHEN l_linenumber = 2 THEN 'NA' WHEN l_linenumber = 3 THEN '.' WHEN l_linenumber = 4 THEN 'n/a 5' WHEN l_linenumber = 5 THEN '' ELSE CAST(l_partkey AS STRING) END AS cell,
  CASE WHEN l_linenumber = 1 THEN 'SSC.98' WHEN l_linenumber = 2 THEN 'SSC.2004' WHEN l_linenumber = 3 THEN 'SSC.07' WHEN l_linenumber = 4 THEN 'none' ELSE 'X.123' END AS method, CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE 'PI' END AS prefix, CAST(l_suppkey AS STRING) AS number, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_returnflag END AS suffix FROM {lineitem}"""


@query("source_cells", oracle(["raw_cell"], """SELECT l_orderkey, l_linenumber, CASE WHEN trim(cell) NOT IN ('', 'NA', 'NaN', 'nan', '.') THEN try_cast(trim(cell) AS DOUBLE) END AS value,
 CASE WHEN regexp_matches(method, '\\.\\d{2,4}$') THEN CASE length(regexp_extract(method, '\\.(\\d{2,4})$', 1)) WHEN 4 THEN regexp_extract(method, '\\.(\\d{2,4})$', 1) ELSE CASE WHEN regexp_extract(method, '\\.(\\d{2,4})$', 1)::INT >= 50 THEN '19' ELSE '20' END || regexp_extract(method, '\\.(\\d{2,4})$', 1) END END AS year,
 concat_ws(' ', nullif(prefix, ''), number, nullif(suffix, '')) AS accession FROM raw_cell"""))
def source_cells(spark, sf):
    return fixture(spark, sf, "raw_cell").select("l_orderkey", "l_linenumber", nu.parse_number("cell").alias("value"), cal.method_year("method").alias("year"), nm.accession_id("prefix", "number", "suffix").alias("accession"))
