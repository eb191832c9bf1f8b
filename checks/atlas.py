"""Quality rules, patches, build, sources and small functions."""
from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import FIXTURES, fixture, oracle, query
from checks.climate import vi_label_sql
from checks.labs import build_sql
from checks.orchard import pick
from checks.reports import fresh_folder
from graftline import fixed_values as fx
from graftline.functions import calendar as cal
from graftline.functions import numeric as nu
from graftline.functions import weather as wx
from graftline.operators import build as bd
from graftline.operators import quality as qa
from graftline.sources import html as hx
from graftline.sources import records as rc
from graftline.sources import tables as tb
from graftline.sources import text as tx

K = "p_partkey"
HARVEST = pick(f"{K} * 3 + p_size", ["late Sep", "mid Sep-early Oct", "early Aug–mid Aug", "sometime", "mid Foo", "late october to mid Nov", "Early JUL"], f"{K} % 41 = 0")
FIXTURES["record"] = f"""SELECT CASE WHEN {K} % 53 = 0 THEN 'Bad Id' ELSE 'v-' || CAST({K} AS STRING) END AS id, CASE WHEN {K} % 59 = 0 THEN NULL WHEN {K} % 61 = 0 THEN '' ELSE p_name END AS name,
  CASE WHEN {K} % 4 = 0 THEN list_value('dessert', 'cider') WHEN {K} % 31 = 0 THEN list_value('pie') ELSE list_value('culinary') END AS uses, CASE WHEN {K} % 7 = 0 THEN 'Gb' WHEN {K} % 5 = 0 THEN NULL ELSE 'GB' END AS country,
  CAST(900 + p_size * 25 AS INT) AS year, {pick('p_size', fx.ORIGIN_KINDS + ['wild'])} AS origin_kind, CASE WHEN {K} % 67 = 0 THEN NULL WHEN p_size < 10 THEN 'short' ELSE 'a history of the ' || p_name || ' of the valley' END AS history,
  {pick('p_size', fx.LOOK_SIZE + ['huge'])} AS size, {pick(K, fx.LOOK_BLUSH + ['blue'])} AS blush, CAST(p_size * 3 AS INT) AS blush_cover, CAST({K} % 5 AS INT) AS russet,
  CASE WHEN {K} % 6 = 0 THEN NULL ELSE CAST({K} % 7 AS INT) END AS sweet, CAST(1 + {K} % 5 AS INT) AS acid, CAST(p_size % 8 AS INT) AS tannin, {pick(K, ['sweet', 'sharp', 'bittersweet'], f'{K} % 3 = 0')} AS cider_class,
  CASE WHEN {K} % 8 = 0 THEN list_value('honey', 'tar') WHEN {K} % 9 = 0 THEN list_value('honey', 'rose', 'pear', 'tea', 'wine', 'grape', 'berry', 'melon', 'mango') ELSE list_value('honey') END AS tags, CASE WHEN p_size % 2 = 0 THEN 'a summary long enough to pass' ELSE 'brief' END AS summary,
  CAST(p_size % 7 AS INT) AS vigor, {pick(K, fx.PLOIDY)} AS ploidy, CAST({K} % 9 AS INT) AS flower_group, {pick(f'{K} + 1', fx.SELF_FERTILE)} AS self_fertile, {HARVEST} AS harvest,
  CASE WHEN {K} % 5 = 1 THEN NULL ELSE CAST(p_size * 60 AS INT) END AS chill_hours, CASE WHEN {K} % 5 < 2 THEN NULL ELSE CAST(1 + {K} % 10 AS INT) END AS hardiness_zone, CASE WHEN {K} % 5 < 2 THEN NULL ELSE CAST({K} % 6 AS INT) END AS heat_tolerance,
  CAST({K} % 7 AS INT) AS scab, {pick('p_size', ['high', 'medium', 'low', 'none'])} AS conf FROM {{part}}"""


def nested(spark, sf):
    r = fixture(spark, sf, "record")
    s = F.lit(None).cast("string")
    i = F.lit(None).cast("int")
    return r.select(
        "id", "name", "uses", F.struct("country", "year", F.col("origin_kind").alias("kind")).alias("origin"), "history",
        F.struct("size", s.alias("shape"), s.alias("ground"), "blush", "blush_cover", "russet", s.alias("flesh_colour")).alias("look"),
        F.struct("summary", "sweet", "acid", i.alias("aroma"), i.alias("crisp"), i.alias("juicy"), "tannin", "tags", "cider_class").alias("taste"),
        F.struct("vigor", s.alias("habit"), s.alias("bearing"), s.alias("cropping"), s.alias("biennial"), i.alias("precocity"), "ploidy").alias("tree"),
        F.struct("flower_group", "self_fertile").alias("pollination"), F.struct("harvest", i.alias("storage_weeks")).alias("season"),
        F.struct("chill_hours", "hardiness_zone", "heat_tolerance").alias("climate"),
        F.struct("scab", *[i.alias(k) for k in fx.HEALTH_KEYS[1:]]).alias("health"), F.lit("notes").alias("grow_notes"), "conf", F.array().cast("array<string>").alias("tags"))


def _in(vals) -> str:
    return "(" + ", ".join(f"'{v}'" for v in vals) + ")"


MONTHS = [m.lower() for m in fx.MONTH_NAMES]
HPARTS = "list_transform(regexp_extract_all(replace(lower(harvest), '–', '-'), '(early|mid|late)\\s+([a-z]{3})'), lambda x: {'p': split_part(x, ' ', 1), 'm': right(x, 3)})"
HDAY = f"list_transform({HPARTS}, lambda x: ({fx.DAYS_BEFORE_MONTH})[list_position({MONTHS}, x.m)] + CASE x.p WHEN 'early' THEN 6 WHEN 'mid' THEN 16 ELSE 26 END)"
HDOY = f"CASE WHEN len({HDAY}) > 0 AND len(list_filter({HDAY}, lambda d: d IS NULL)) = 0 THEN round_even(list_sum({HDAY}) / len({HDAY}), 0)::INT END"
HLO = f"list_min(list_filter({HDAY}, lambda d: d IS NOT NULL)) - 5"
HHI = f"list_max(list_filter({HDAY}, lambda d: d IS NOT NULL)) + 5"


def rules_sql(table: str, rules, required=(), key="id") -> str:
    lost = " OR ".join(f"{c} IS NULL" for c in required) or "FALSE"
    parts = [f"SELECT {key} AS id, 'error' AS severity, 'absent {c}' AS message FROM {table} WHERE {c} IS NULL" for c in required]
    parts += [f"SELECT {key} AS id, '{sev}' AS severity, '{msg}' AS message FROM {table} WHERE NOT ({lost}) AND ({cond})" for sev, msg, cond in rules]
    return " UNION ALL ".join(parts)


e, w = "error", "warning"
VRULES = [(e, "form id", f"NOT regexp_matches(id, '{qa.ID}')"), (e, "empty name", "name = ''"), (e, "subset uses", f"NOT list_has_all({fx.USES}, uses)"),
          (e, "form origin.country", "NOT regexp_matches(country, '^[A-Z]{2}$')"), (e, "range origin.year 1000..2030", "year NOT BETWEEN 1000 AND 2030"), (e, "value origin.kind", f"origin_kind NOT IN {_in(fx.ORIGIN_KINDS)}"),
          (w, "short history", "length(history) < 20"), (e, "value look.size", f"size NOT IN {_in(fx.LOOK_SIZE)}"), (e, "value look.blush", f"blush NOT IN {_in(fx.LOOK_BLUSH)}"), (e, "value conf", f"conf NOT IN {_in(fx.CONFIDENCE)}"),
          (e, "range look.blush_cover 0..100", "blush_cover NOT BETWEEN 0 AND 100"), (e, "range look.russet 0..3", "russet NOT BETWEEN 0 AND 3"), (e, "range taste.sweet 1..5", "sweet NOT BETWEEN 1 AND 5"),
          (e, "range taste.tannin 0..5", "tannin NOT BETWEEN 0 AND 5"), (e, "range tree.vigor 1..5", "vigor NOT BETWEEN 1 AND 5"), (e, "range pollination.flower_group 1..7", "flower_group NOT BETWEEN 1 AND 7"),
          (e, "range climate.chill_hours 0..2500", "chill_hours NOT BETWEEN 0 AND 2500"), (e, "range climate.hardiness_zone 2..10", "hardiness_zone NOT BETWEEN 2 AND 10"), (e, "range climate.heat_tolerance 1..5", "heat_tolerance NOT BETWEEN 1 AND 5"),
          (e, "range health.scab 1..5", "scab NOT BETWEEN 1 AND 5"), (e, "vocabulary taste.tags", f"NOT list_has_all({fx.TASTE_TAGS}, tags)"), (w, "count taste.tags", f"list_has_all({fx.TASTE_TAGS}, tags) AND len(tags) > 8"),
          (w, "short taste.summary", "summary IS NULL OR length(summary) < 20"), (w, "conflict tree.ploidy pollination.self_fertile", "ploidy = 'triploid' AND self_fertile = 'yes'"), (e, "form season.harvest", f"harvest IS NOT NULL AND ({HDOY}) IS NULL"),
          (w, "conflict nulls conf", "(chill_hours IS NULL)::INT + (hardiness_zone IS NULL)::INT + (heat_tolerance IS NULL)::INT + (flower_group IS NULL)::INT + (harvest IS NULL)::INT >= 3 AND conf <> 'low'"),
          (w, "conflict uses taste.cider_class", "list_contains(uses, 'cider') AND cider_class IS NULL")]


@query("variety_rules", oracle(["record"], rules_sql("record", VRULES, ["name", "history"])))
def variety_rules(spark, sf):
    return qa.check_varieties(nested(spark, sf))


@query("harvest_phrases", oracle(["record"], f"SELECT id, name, harvest, {HDOY} AS doy, {HLO} AS lo, {HHI} AS hi FROM record"))
def harvest_phrases(spark, sf):
    rng = cal.parse_harvest_range("harvest")
    return fixture(spark, sf, "record").select("id", "name", "harvest", cal.parse_harvest("harvest").alias("doy"), rng["lo"].alias("lo"), rng["hi"].alias("hi"))


S = "s_suppkey"
FIXTURES["stock_record"] = f"""SELECT CASE WHEN {S} % 13 = 0 THEN 'M_9' ELSE 'm' || CAST({S} AS STRING) END AS id, CASE WHEN {S} % 17 = 0 THEN NULL ELSE s_name END AS name, {pick(S, ['Malling', 'Geneva', 'Unknown'])} AS series, {pick(S, fx.SIZE_CLASSES + ['giant'])} AS size_class,
  CAST({S} % 7 AS INT) AS vigor, list_value(10e0 + {S} % 60, 5e0 + {S} % 90) AS size_pct_standard, CASE WHEN {S} % 4 = 0 THEN NULL WHEN {S} % 4 = 1 THEN list_value(2e0) ELSE list_value(2e0, 20e0 - {S} % 9) END AS height_m, CAST({S} % 6 AS INT) AS fire_blight, CAST({S} % 8 AS INT) AS cold,
  CAST(1 + {S} % 12 AS INT) AS hardiness_zone, {pick(S, fx.AVAILABILITY + ['never'], f'{S} % 5 = 0')} AS uk_availability, {pick(S, ['high', 'low', 'sure'])} AS conf FROM {{supplier}}"""
RRULES = [(e, "form id", f"NOT regexp_matches(id, '{qa.ID}')"), (e, "value series", "series NOT IN ('Malling', 'Geneva')"), (e, "value size_class", f"size_class NOT IN {_in(fx.SIZE_CLASSES)}"), (e, "value uk_availability", f"uk_availability NOT IN {_in(fx.AVAILABILITY)}"),
          (e, "value conf", f"conf NOT IN {_in(fx.CONFIDENCE)}"), (e, "range hardiness_zone 2..10", "hardiness_zone NOT BETWEEN 2 AND 10"), (e, "range vigor 1..5", "vigor NOT BETWEEN 1 AND 5"), (e, "range susceptibility.fire_blight 1..5", "fire_blight NOT BETWEEN 1 AND 5"),
          (e, "range tolerance.cold 1..5", "cold NOT BETWEEN 1 AND 5"), (e, "pair size_pct_standard 1..150", "NOT (size_pct_standard[1] >= 1 AND size_pct_standard[1] <= size_pct_standard[2] AND size_pct_standard[2] <= 150)"),
          (e, "pair height_m 0.3..15", "height_m IS NOT NULL AND NOT coalesce(len(height_m) = 2 AND height_m[1] >= 0.3 AND height_m[1] <= height_m[2] AND height_m[2] <= 15, FALSE)"),
          (w, "conflict vigor size_pct_standard", "(vigor <= 2 AND (size_pct_standard[1] + size_pct_standard[2]) / 2 > 60) OR (vigor >= 4 AND (size_pct_standard[1] + size_pct_standard[2]) / 2 < 55)")]


@query("rootstock_rules", oracle(["stock_record"], rules_sql("stock_record", RRULES, ["name"])))
def rootstock_rules(spark, sf):
    i, a = F.lit(None).cast("int"), F.lit(None).cast("array<double>")
    df = fixture(spark, sf, "stock_record").select("id", "name", "series", "size_class", "vigor", "size_pct_standard", "height_m", a.alias("spacing_m"), a.alias("first_crop_years"),
                                                   *[i.alias(c) for c in ("precocity", "yield_efficiency", "fruit_size_effect", "anchorage", "suckering", "burr_knots")],
                                                   F.struct("fire_blight", *[i.alias(k) for k in fx.ROOTSTOCK_SUSCEPTIBILITY[1:]]).alias("susceptibility"), F.struct("cold", *[i.alias(k) for k in fx.ROOTSTOCK_TOLERANCE[1:]]).alias("tolerance"),
                                                   "hardiness_zone", "uk_availability", "conf", F.lit("n").alias("notes"), F.struct("name").alias("origin"))
    return qa.check_rootstocks(df)


FIXTURES["note_record"] = "SELECT 'c' || CAST(c_custkey AS STRING) AS id, CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE c_name || ' summary' END AS summary, c_mktsegment || ' culture here' AS apple_culture, list_value(c_name) AS local_varieties, c_mktsegment AS pests_diseases, c_name || c_mktsegment AS tips, CASE WHEN c_custkey % 3 = 0 THEN 'sure' ELSE 'low' END AS confidence FROM {customer}"


@query("region_note_rules", oracle(["note_record"], rules_sql("note_record", [*[(e, f"short {c}", f"length({c}) < 20") for c in ("summary", "apple_culture", "pests_diseases", "tips")], (e, "value confidence", "confidence NOT IN ('high', 'medium', 'low')")], ["summary"])))
def region_note_rules(spark, sf):
    return qa.check_regions(fixture(spark, sf, "note_record"))


FIXTURES["profile_row"] = f"SELECT c_custkey AS id, CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE '2024' END AS updated, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'rain' END AS label, {pick('c_custkey', ['http://a', 'http://b', '', 'http://c'])} AS f_src, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 'Section' END AS title, CASE WHEN c_custkey % 11 = 0 THEN '' ELSE 'text' END AS item_text, {pick('c_custkey * 3', ['http://b', 'http://d', 'http://a'], 'c_custkey % 8 = 0')} AS i_src, c_name FROM {{customer}}"


def profiles(spark, sf):
    p = fixture(spark, sf, "profile_row")
    return p.select("id", "updated", F.array(F.struct("label", F.lit("5").alias("value"), F.col("f_src").alias("source"))).alias("facts"),
                    F.array(F.struct("title", F.array(F.struct(F.col("item_text").alias("text"), F.col("i_src").alias("source"), F.col("c_name").alias("name"))).alias("items"))).alias("sections"), F.array(F.lit("http://z"), F.lit("http://a")).alias("sources"))


@query("profile_rules", oracle(["profile_row"], rules_sql("profile_row", [(e, "incomplete facts", "label = ''"), (e, "incomplete sections", "title IS NULL"), (e, "incomplete items", "item_text = ''")], ["updated"])))
def profile_rules(spark, sf):
    return qa.check_profiles(profiles(spark, sf))


@query("profile_sources", oracle(["profile_row"], "SELECT id, row_number() OVER (PARTITION BY id ORDER BY o) - 1 AS pos, source FROM (SELECT id, u AS source, min(o) AS o FROM (SELECT id, unnest([f_src, i_src, 'http://z', 'http://a']) AS u, unnest([0, 1, 2, 3]) AS o FROM profile_row) WHERE u <> '' GROUP BY id, u)"))
def profile_sources(spark, sf):
    return bd.profile_sources(profiles(spark, sf))


FIXTURES["web_record"] = f"SELECT 'v-' || CAST(user_id AS STRING) AS id, event_id, {pick('event_id', ['nfc', 'nursery', 'blog'])} AS src, {pick('event_id * 3', ['http://x', 'ftp://y', 'https://z'], 'event_id % 13 = 0')} AS url, {pick('event_id', ['sweet and juicy', 'one two three four five six', 'crisp'])} AS phrase, {pick('event_id * 7', ['honey', 'tar', 'rose'])} AS tag, CAST(event_id % 7 AS INT) AS sweet, {pick('event_id', ['cool', 'hot'], 'event_id % 3 = 0')} AS needs FROM {{events}}"


@query("web_evidence_rules", oracle(["web_record", "record"], """SELECT id, 'error' AS severity, 'value climate_flavour.needs' AS message FROM web_record WHERE needs NOT IN ('cool', 'warm', 'any') UNION ALL SELECT id, 'error', 'source 0: value src' FROM web_record WHERE src = 'blog' UNION ALL SELECT id, 'error', 'source 0: form url' FROM web_record WHERE url IS NULL OR url NOT LIKE 'http%'
 UNION ALL SELECT id, 'error', 'source 0: long words' FROM web_record WHERE phrase LIKE '% six' UNION ALL SELECT id, 'error', 'source 0: vocabulary tags' FROM web_record WHERE tag = 'tar' UNION ALL SELECT id, 'error', 'source 0: range sweet 1..5' FROM web_record WHERE sweet NOT BETWEEN 1 AND 5
 UNION ALL SELECT id, 'error', 'unknown id' FROM web_record WHERE id NOT IN (SELECT id FROM record)"""))
def web_evidence_rules(spark, sf):
    n = F.lit(None)
    df = fixture(spark, sf, "web_record").select("id", F.array(F.struct("src", "url", F.array("phrase").alias("words"), F.array("tag").alias("tags"), "sweet", n.cast("int").alias("acid"), n.cast("array<string>").alias("against"))).alias("sources"), F.struct("needs").alias("climate_flavour"))
    return qa.check_evidence(df, fixture(spark, sf, "record").select("id"))


FIXTURES["book_record"] = f"SELECT CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE 'v-' END || CAST(doc_id AS STRING) AS id, doc_id AS book, 1 AS line, CAST(1 + doc_id % 9 AS INT) AS end, {pick('doc_id', ['exact', 'synonym', 'guess'])} AS match, {pick('doc_id * 3', ['honey', 'tar'])} AS tag, CAST(doc_id % 7 AS INT) AS sweet, {pick('doc_id', ['fine', ' ', 'good'])} AS flavour FROM {{documents}}"


@query("book_entry_rules", oracle(["book_record", "record"], """SELECT id, 'error' AS severity, 'value match' AS message FROM book_record WHERE match = 'guess' UNION ALL SELECT id, 'error', 'vocabulary tags' FROM book_record WHERE tag = 'tar' UNION ALL SELECT id, 'error', 'range sweet 1..5' FROM book_record WHERE sweet NOT BETWEEN 1 AND 5
 UNION ALL SELECT id, 'error', 'empty flavour' FROM book_record WHERE trim(flavour) = '' UNION ALL SELECT id, 'error', 'span outside' FROM book_record JOIN documents ON doc_id = book WHERE "end" > len(string_split(text, chr(10))) UNION ALL SELECT id, 'error', 'unknown id' FROM book_record WHERE id NOT IN (SELECT id FROM record)""").replace("AS end,", 'AS "end",'))
def book_entry_rules(spark, sf):
    n = F.lit(None)
    df = fixture(spark, sf, "book_record").select("id", "book", "line", "end", "match", F.array("tag").alias("tags"), n.cast("array<string>").alias("against"), "sweet", n.cast("int").alias("acid"), "flavour", *[n.cast("string").alias(c) for c in ("quality", "storage", "climate")])
    return qa.check_entries(df, fixture(spark, sf, "record").select("id"), tx.numbered_lines(fixture(spark, sf, "documents").withColumnRenamed("doc_id", "book"), "book", "text"))


def _json(text: str) -> str:
    """JSON as a SQL expression; braces in fixture SQL would be read as table names, so they are written as chr(123) and chr(125)."""
    return "'" + text.replace("{", "' || chr(123) || '").replace("}", "' || chr(125) || '") + "'"


FIXTURES["patch"] = f"""SELECT 'v-' || CAST({K} AS STRING) AS id, CASE WHEN {K} % 34 = 0 THEN NULL WHEN {K} % 5 = 0 THEN {_json('{"taste":{"sweet":5,"tags":["honey","tar"]}}')} WHEN {K} % 5 = 1 THEN {_json('{"taste":{"sweet":null,"crunch":2},"conf":"high"}')}
  WHEN {K} % 5 = 2 THEN {_json('{"origin":{"year":2001},"conf":null}')} WHEN {K} % 5 = 3 THEN {_json('{"taste":null}')} ELSE {_json('{"taste":{"acid":9},"origin":{"country":"FR","year":null}}')} END AS patch FROM {{part}} WHERE {K} % 17 = 0
UNION ALL SELECT 'w-' || CAST(s_suppkey AS STRING) AS id, {_json('{"conf":"low"}')} AS patch FROM {{supplier}}"""
PATCHED = """base AS (SELECT 'v-' || p_partkey AS id, p_partkey AS k, sweet, acid, country, year, conf FROM record JOIN part ON record.id = 'v-' || p_partkey)"""


@query("patched_records", oracle(["record", "patch"], """SELECT b.id, CASE WHEN p.id IS NULL THEN sweet WHEN k % 5 = 0 THEN 5 WHEN k % 5 IN (1, 3) THEN NULL ELSE sweet END AS sweet, CASE WHEN p.id IS NULL THEN acid WHEN k % 5 = 3 THEN NULL WHEN k % 5 = 4 THEN 9 ELSE acid END AS acid,
 CASE WHEN p.id IS NULL THEN country WHEN k % 5 = 4 THEN 'FR' ELSE country END AS country, CASE WHEN p.id IS NULL THEN year WHEN k % 5 = 2 THEN 2001 WHEN k % 5 = 4 THEN NULL ELSE year END AS year, CASE WHEN p.id IS NULL THEN conf WHEN k % 5 = 1 THEN 'high' WHEN k % 5 = 2 THEN NULL ELSE conf END AS conf
 FROM base b LEFT JOIN patch p USING (id) WHERE p.id IS NULL OR p.patch IS NOT NULL""", PATCHED))
def patched_records(spark, sf):
    r = nested(spark, sf).where("id <> 'Bad Id'")
    return bd.apply_patch(r, fixture(spark, sf, "patch")).select("id", "taste.sweet", "taste.acid", "origin.country", "origin.year", "conf")


@query("patches_not_found", oracle(["record", "patch"], "SELECT id FROM patch WHERE id NOT IN (SELECT id FROM record)"))
def patches_not_found(spark, sf):
    return bd.patches_not_found(nested(spark, sf), fixture(spark, sf, "patch"))


@query("patch_rules", oracle(["record", "patch"], """SELECT id, 'error' AS severity, m AS message FROM (SELECT id, unnest([CASE WHEN patch LIKE '%origin%' OR patch LIKE '%conf%' THEN 'key patch' END, CASE WHEN patch LIKE '%crunch%' THEN 'key taste' END, CASE WHEN patch LIKE '%tar%' THEN 'vocabulary taste.tags' END,
 CASE WHEN patch LIKE '%"acid":9%' THEN 'range taste.acid 1..5' END]) AS m FROM patch) WHERE m IS NOT NULL UNION ALL SELECT id, 'error', 'unknown id' FROM patch WHERE id NOT IN (SELECT id FROM record)"""))
def patch_rules(spark, sf):
    return qa.check_patch(fixture(spark, sf, "patch"), nested(spark, sf).select("id"))


FIXTURES["batch_id"] = "SELECT DISTINCT 'v-' || CAST(l_partkey AS STRING) AS id FROM {lineitem} WHERE l_quantity > 30"
FIXTURES["batch_got"] = "SELECT 'v-' || CAST(l_partkey AS STRING) AS id FROM {lineitem} WHERE l_quantity < 5"


@query("batch_completeness", oracle(["batch_id", "batch_got"], "SELECT id, 'missing' AS problem FROM batch_id WHERE id NOT IN (SELECT id FROM batch_got) UNION ALL SELECT DISTINCT id, 'extra' FROM batch_got WHERE id NOT IN (SELECT id FROM batch_id)"))
def batch_completeness(spark, sf):
    return qa.check_batch(fixture(spark, sf, "batch_got"), fixture(spark, sf, "batch_id"))


@query("duplicate_ids", oracle(["batch_got"], "SELECT id, count(*) AS n FROM batch_got GROUP BY id HAVING count(*) > 1"))
def duplicate_ids(spark, sf):
    return qa.duplicate_ids(fixture(spark, sf, "batch_got"))


@query("not_yet_researched", oracle(["batch_id", "batch_got"], "SELECT id FROM batch_id WHERE id NOT IN (SELECT id FROM batch_got)"))
def not_yet_researched(spark, sf):
    return qa.missing_ids(fixture(spark, sf, "batch_id"), fixture(spark, sf, "batch_got"))


FIXTURES["old_entry"] = "SELECT o_custkey AS variety_id, o_orderpriority AS book, min(o_orderkey) AS line FROM {orders} WHERE o_orderstatus = 'F' GROUP BY o_custkey, o_orderpriority"
FIXTURES["new_entry"] = "SELECT o_custkey AS variety_id, o_orderpriority AS book, max(o_orderkey) AS line FROM {orders} GROUP BY o_custkey, o_orderpriority"


@query("merged_entries", oracle(["old_entry", "new_entry"], "SELECT variety_id, book, coalesce(o.line, n.line) AS line, o.line IS NOT NULL AS skipped FROM new_entry n LEFT JOIN old_entry o USING (variety_id, book)"))
def merged_entries(spark, sf):
    both, skipped = bd.merge_new(fixture(spark, sf, "old_entry"), fixture(spark, sf, "new_entry"), ["variety_id", "book"])
    return both.join(skipped.select("variety_id", "book", F.lit(True).alias("skipped")), ["variety_id", "book"], "left").withColumn("skipped", F.coalesce("skipped", F.lit(False)))


FIXTURES["catalogue"] = f"SELECT 'v-' || CAST({K} AS STRING) AS id, {K} % 2 = 0 AS listed, replace(p_name, ' ', '-') AS slug, lower(p_type) AS category FROM {{part}} WHERE {K} % 3 = 0"


@query("enriched_varieties", oracle(["record", "catalogue"], f"SELECT r.id, r.name, {HDOY} AS harvest_doy, {HLO} AS harvest_from, {HHI} AS harvest_to, coalesce(listed, FALSE) AS listed, CASE WHEN listed THEN 'https://shop.example/' || category || '/' || slug END AS url FROM record r LEFT JOIN catalogue c ON c.id = r.id"))
def enriched_varieties(spark, sf):
    r = fixture(spark, sf, "record").select("id", "name", "harvest")
    return bd.enrich_varieties(r, fixture(spark, sf, "catalogue"), "https://shop.example/").select("id", "name", "harvest_doy", "harvest_from", "harvest_to", "listed", "url")


FIXTURES["seed_place"] = "SELECT s_suppkey AS place_id, s_name AS place_name FROM {supplier} WHERE s_suppkey % 7 <> 0"
FIXTURES["place_note"] = "SELECT place_id, CASE WHEN place_id % 3 = 0 THEN NULL ELSE 'notes' END AS summary, local_names FROM {place_names} WHERE place_id % 5 <> 0"
LINK = f"""an AS (SELECT variety_id, 0 AS pos, name FROM named_variety UNION ALL SELECT variety_id, i, aka[i] FROM named_variety, (SELECT unnest([1, 2]) AS i)),
lx AS (SELECT key, coalesce(arg_max(variety_id, (mk, variety_id)) FILTER (WHERE pos = 0), arg_min(variety_id, (mk, variety_id, pos)) FILTER (WHERE pos > 0)) AS variety_id FROM (SELECT a.variety_id, a.pos, {build_sql('a.name')} AS key, {build_sql('v.name')} AS mk FROM an a JOIN named_variety v USING (variety_id)) GROUP BY key),
lk AS (SELECT place_id, count(DISTINCT variety_id) AS linked FROM (SELECT place_id, {build_sql('n')} AS key FROM (SELECT place_id, unnest(local_names) AS n FROM place_note)) JOIN lx USING (key) GROUP BY place_id)"""


@query("assembled_regions", oracle(["seed_place", "place_note", "named_variety"], "SELECT s.place_id, place_name, coalesce(linked, 0) AS linked, summary IS NOT NULL AS has_notes FROM seed_place s LEFT JOIN place_note n USING (place_id) LEFT JOIN lk USING (place_id)", LINK))
def assembled_regions(spark, sf):
    return bd.build_regions(fixture(spark, sf, "seed_place"), fixture(spark, sf, "place_note"), fixture(spark, sf, "named_variety")).select("place_id", "place_name", "linked", "has_notes")


@query("region_warnings", oracle(["seed_place", "place_note"], "SELECT place_id, 'no notes yet' AS problem FROM seed_place WHERE place_id NOT IN (SELECT place_id FROM place_note) UNION ALL SELECT place_id, 'notes without a place' FROM place_note WHERE place_id NOT IN (SELECT place_id FROM seed_place)"))
def region_warnings(spark, sf):
    return bd.region_warnings(fixture(spark, sf, "seed_place"), fixture(spark, sf, "place_note"))


FIXTURES["customer_variety"] = "SELECT c_custkey AS variety_id, c_name AS name, list_value('x') AS aka FROM {customer} WHERE c_custkey % 3 = 0"


@query("profile_links", oracle(["profile_row"], "SELECT id, c_name AS name, id AS variety_id FROM profile_row WHERE id % 3 = 0"))
def profile_links(spark, sf):
    return bd.profile_links(profiles(spark, sf), fixture(spark, sf, "customer_variety"))


@query("build_report", oracle(["variety"], "SELECT 'varieties' AS measure, 'all' AS value, count(*) AS n FROM variety UNION ALL SELECT 'varieties', 'listed', count(CASE WHEN listed THEN 1 END) FROM variety UNION ALL SELECT 'confidence', conf, count(*) FROM variety GROUP BY conf UNION ALL " + " UNION ALL ".join(f"SELECT 'null', '{c}', count(*) - count({c}) FROM variety" for c in ("chill_hours", "hardiness_zone", "heat_tolerance", "flower_group", "harvest_doy"))))
def build_report(spark, sf):
    return bd.build_report(fixture(spark, sf, "variety"))


# ---- sources: tables landed in the format, then read back -------------------------------------------
@query("csv_with_checked_header", "SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_mktsegment FROM customer")
def csv_with_checked_header(spark, sf):
    path = fresh_folder(spark)
    fixture(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment").write.option("header", True).csv(path)
    return tb.read_csv_checked(spark, path, {1: "name", 2: "segment"})


@query("tab_separated", "SELECT s_suppkey::VARCHAR AS s_suppkey, s_name FROM supplier")
def tab_separated(spark, sf):
    path = fresh_folder(spark)
    fixture(spark, sf, "supplier").select("s_suppkey", "s_name").write.option("header", True).option("sep", "\t").csv(path)
    return tb.read_tsv(spark, path)


@query("csv_with_preamble", "SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END AS o_totalprice, NULL::VARCHAR AS unreadable FROM orders")
def csv_with_preamble(spark, sf):
    path = fresh_folder(spark)
    o = fixture(spark, sf, "orders").select(F.concat_ws(",", F.col("o_orderkey").cast("string"), "o_orderpriority", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice").cast("string"))).alias("value"), (F.col("o_orderkey") % 7).alias("f"))
    heads = o.select("f").distinct().select(F.explode(F.array(F.lit("Title of the download"), F.lit(","), F.lit("o_orderkey,o_orderpriority,o_totalprice"))).alias("value"), "f")
    heads.unionByName(o).write.partitionBy("f").text(path)
    return tb.read_preamble_csv(spark, path, "o_orderkey bigint, o_orderpriority string, o_totalprice double", ["Title of the download", ","])


FIXTURES["gene_bank"] = "SELECT CASE WHEN c_custkey % 4 = 0 THEN '300' WHEN c_custkey % 4 = 1 THEN 'Landrace' WHEN c_custkey % 4 = 2 THEN '' ELSE 'wild' END AS sampstat, CASE WHEN c_custkey % 5 = 0 THEN '12 / 3' WHEN c_custkey % 5 = 1 THEN c_name || '; ' || c_mktsegment ELSE c_name END AS accename FROM {customer}"


@query("sniffed_gene_bank", oracle(["gene_bank"], "SELECT DISTINCT n AS name FROM (SELECT unnest(regexp_split_to_array(accename, '\\s*;\\s*')) AS n FROM gene_bank WHERE sampstat <> 'wild') WHERE n <> '' AND NOT regexp_matches(n, '^[\\d\\s/.-]+$')"))
def sniffed_gene_bank(spark, sf):
    path = fresh_folder(spark)
    fixture(spark, sf, "gene_bank").withColumn("accename", F.concat(F.lit('"'), "accename", F.lit('"'))).select(F.concat_ws(",", "sampstat", "accename").alias("v"), F.lit(1).alias("o")).unionByName(
        spark.createDataFrame([("SampStat,ACCENAME", 0)], "v string, o int")).select("v").write.text(path + "/raw")
    rows = fixture(spark, sf, "gene_bank")
    rows.write.option("header", True).option("sep", "\t").csv(path + "/tab")
    t = tb.read_sniffed(spark, path + "/tab", {"status": ["SAMPSTAT", "BIOLOGICAL STATUS"], "name": ["ACCENAME", "ACCESSION NAME"]})
    return tb.accession_names(t)


LINK_RX = r'<a href="/([^"/]+)">([^<]+)</a>'


@query("index_links", "SELECT DISTINCT slug, trim(name) AS name FROM (SELECT unnest(regexp_extract_all(html, '<a href=\"/([^\"/]+)\">([^<]+)</a>', 1)) AS slug, unnest(regexp_extract_all(html, '<a href=\"/([^\"/]+)\">([^<]+)</a>', 2)) AS name FROM pages) WHERE trim(name) <> ''")
def index_links(spark, sf):
    return hx.extract_links(fixture(spark, sf, "pages"), LINK_RX)


FIXTURES["card_page"] = """SELECT page_id, html || '<h3 class="text-lg bold"> ' || CASE WHEN page_id % 3 = 0 THEN 'RF: ' ELSE '' END || 'Königin ' || CAST(page_id AS STRING) || CASE WHEN page_id % 4 = 0 THEN ' >>>>cider' WHEN page_id % 4 = 1 THEN '�s' WHEN page_id % 4 = 2 THEN ' �' ELSE '' END || ' </h3> <p>x</p> <a href="/applebyname/konigin-' || CAST(page_id AS STRING) || '-id-' || CAST(page_id * 7 AS STRING) || '" type="button">' AS html FROM {pages}"""


@query("listing_cards", oracle(["card_page"], "SELECT CASE WHEN page_id % 4 = 2 THEN 'Konigin ' || page_id WHEN page_id % 4 = 1 THEN 'Königin ' || page_id || '''s' ELSE 'Königin ' || page_id END AS name, 'konigin-' || page_id || '-id-' || page_id * 7 AS link FROM card_page"))
def listing_cards(spark, sf):
    return hx.extract_cards(fixture(spark, sf, "card_page").select(F.encode("html", "UTF-8").alias("raw")))


FIXTURES["wiki_line"] = """SELECT p_partkey % 20 AS page, p_partkey * 3 AS line_no, '|-' AS text, p_partkey FROM {part} UNION ALL SELECT p_partkey % 20 AS page, p_partkey * 3 + 1 AS line_no, CASE WHEN p_partkey % 5 = 0 THEN '| (see ' || p_name || ')' WHEN p_partkey % 5 = 1 THEN '| [[' || p_name || ' (apple)|' || p_name || ']]<ref name=x/> ([[aka]]' ELSE '| ''''''[[' || p_name || ' ' || CAST(p_partkey AS STRING) || ' apple]]''''''<ref>a</ref>' END AS text, p_partkey FROM {part}
UNION ALL SELECT p_partkey % 20 AS page, p_partkey * 3 + 2 AS line_no, '| other cell' AS text, p_partkey FROM {part}"""


@query("wiki_rows", oracle(["wiki_line"], "SELECT page, line_no, CASE WHEN w.p_partkey % 5 = 1 THEN p_name || ' (aka' ELSE p_name || ' ' || w.p_partkey END AS name FROM wiki_line w JOIN part p ON p.p_partkey = w.p_partkey WHERE text LIKE '|%[[%' AND text NOT LIKE '%(see %'"))
def wiki_rows(spark, sf):
    return hx.parse_wiki_list(fixture(spark, sf, "wiki_line")).drop("aka")


@query("unpacked_daily", "SELECT l_orderkey AS place_id, CAST(DATE '2015-01-01' + i::INT AS VARCHAR) AS day, x AS tmax FROM (SELECT l_orderkey, unnest(xs) AS x, unnest(range(len(xs))) AS i FROM (SELECT l_orderkey, list_sort(list(l_quantity)) AS xs FROM lineitem GROUP BY l_orderkey))")
def unpacked_daily(spark, sf):
    """The lines of an order (a handful) stand for a place's days."""
    raw = fixture(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("place_id")).agg(F.sort_array(F.collect_list("l_quantity")).alias("tmax")).withColumn("start", F.lit("2015-01-01"))
    return rc.unpack_daily(raw, ["tmax"]).select("place_id", F.col("day").cast("string").alias("day"), "tmax")


FIXTURES["landed_issue"] = "SELECT o_orderkey AS number, o_orderpriority AS title, 'body ' || o_orderstatus AS body, CASE WHEN o_orderkey % 9 = 0 THEN 'http://pr' END AS pr, o_orderstatus AS label FROM {orders}"


@query("landed_issues", oracle(["landed_issue"], "SELECT number, title, body, label AS labels FROM landed_issue WHERE pr IS NULL"))
def landed_issues(spark, sf):
    from graftline.schemas import ISSUE

    path = fresh_folder(spark)
    i = fixture(spark, sf, "landed_issue")
    i.select("number", "title", "body", F.array(F.struct(F.col("label").alias("name"))).alias("labels"), F.when(F.col("pr").isNotNull(), F.struct(F.col("pr").alias("url"))).alias("pull_request")).write.json(path)
    return rc.read_issues(spark, path, ISSUE).select("number", "title", "body", F.array_join("labels", ",").alias("labels"))


@query("ingest_worklist", "WITH w AS (SELECT DISTINCT l_suppkey AS place_id FROM lineitem WHERE l_quantity > 49.5 AND l_discount > 0.07), h AS (SELECT DISTINCT l_suppkey AS place_id FROM lineitem WHERE l_quantity > 49.5 AND l_tax = 0) SELECT s_suppkey AS place_id, CASE WHEN w.place_id IS NULL THEN 'weather' ELSE 'humidity' END AS need, CASE WHEN s_suppkey IN (3, 5, 8) THEN 0 ELSE 1 END AS priority FROM supplier LEFT JOIN w ON w.place_id = s_suppkey LEFT JOIN h ON h.place_id = s_suppkey WHERE w.place_id IS NULL OR h.place_id IS NULL")
def ingest_worklist(spark, sf):
    li = fixture(spark, sf, "lineitem").where("l_quantity > 49.5").withColumnRenamed("l_suppkey", "place_id")
    return rc.ingest_worklist(fixture(spark, sf, "supplier").select(F.col("s_suppkey").alias("place_id")), li.where("l_discount > 0.07"), li.where("l_tax = 0"), [3, 5, 8])


@query("written_profiles", "SELECT n_nationkey AS id, n_name FROM nation")
def written_profiles(spark, sf):
    path = fresh_folder(spark)
    rc.write_profiles(fixture(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), "n_name"), path)
    return spark.read.schema("n_name string, id int").json(path).select("id", "n_name")


@query("written_atlas", "SELECT 'nation' AS t, n_nationkey::BIGINT AS id FROM nation UNION ALL SELECT 'supplier', s_suppkey FROM supplier")
def written_atlas(spark, sf):
    path = fresh_folder(spark)
    rc.write_atlas({t: fixture(spark, sf, t) for t in ("nation", "supplier")}, path)
    return (spark.read.parquet(f"{path}/nation").select(F.lit("nation").alias("t"), F.col("n_nationkey").cast("bigint").alias("id"))
            .unionByName(spark.read.parquet(f"{path}/supplier").select(F.lit("supplier").alias("t"), F.col("s_suppkey").alias("id"))))


@query("listing_lines", "SELECT DISTINCT name FROM (SELECT trim(regexp_replace(unnest(string_split(text, chr(10))), '\\s+', ' ', 'g')) AS name FROM documents) WHERE name <> '' AND NOT regexp_matches(name, 'P a g e|Collection list|^[\\d\\s.()-]+$')")
def listing_lines(spark, sf):
    d = fixture(spark, sf, "documents")
    return tx.listing_lines(tx.numbered_lines(d, "doc_id", "text"))


# ---- small functions -----------------------------------------------------------------------------------
@query("virtual_calendar", f"SELECT o_orderkey, di, vi, {vi_label_sql('vi', 'south')} AS label, di2 FROM (SELECT *, (vi + CASE WHEN south THEN 181 ELSE 0 END) % 365 AS di2 FROM (SELECT *, CASE WHEN south THEN (di - 181 + 365) % 365 ELSE di END AS vi FROM (SELECT o_orderkey, o_custkey % 2 = 0 AS south, dayofyear(make_date(2001, month(o_orderdate), least(28, dayofmonth(o_orderdate)))) - 1 AS di FROM orders)))")
def virtual_calendar(spark, sf):
    o = fixture(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 2 == 0).alias("south"), cal.day_index(F.make_date(F.year("o_orderdate"), F.month("o_orderdate"), F.least(F.lit(28), F.dayofmonth("o_orderdate")))).alias("di"))
    o = o.withColumn("vi", cal.doy_to_vi("di", "south"))
    return o.select("o_orderkey", "di", "vi", cal.vi_label("vi", "south").alias("label"), cal.vi_to_date("vi", "south")["doy"].alias("di2"))


@query("curves_and_scales", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN x >= 4 THEN 100 ELSE c[floor(x)::INT + 1] + (c[floor(x)::INT + 2] - c[floor(x)::INT + 1]) * (x - floor(x)) END, 6) AS at, round(CASE WHEN l_quantity <= 10 THEN l_quantity WHEN l_quantity <= 30 THEN 10 + (l_quantity - 10) / 2 WHEN l_quantity <= 60 THEN 10 + (l_quantity - 10) / 2 ELSE 40 END, 6) AS reached,
 (sign(d) * floor(abs(d) / 7.0 + 0.5))::INT AS weeks, (l_partkey % 130)::VARCHAR || CASE WHEN l_partkey % 130 % 100 BETWEEN 10 AND 20 THEN 'th' WHEN l_partkey % 10 = 1 THEN 'st' WHEN l_partkey % 10 = 2 THEN 'nd' WHEN l_partkey % 10 = 3 THEN 'rd' ELSE 'th' END AS nth, 20 * (1 + l_linenumber % 5) - 10 AS centre
 FROM (SELECT *, [0, 10, 30, 60, 100]::DOUBLE[] AS c, greatest(0, least(4, (l_quantity - 5) / 10)) AS x, (l_suppkey % 60) - 30 AS d FROM lineitem)""".replace("CASE WHEN l_quantity <= 10 THEN l_quantity WHEN l_quantity <= 30 THEN 10 + (l_quantity - 10) / 2 WHEN l_quantity <= 60 THEN 10 + (l_quantity - 10) / 2 ELSE 40 END", "CASE WHEN l_quantity <= 10 THEN l_quantity WHEN l_quantity <= 30 THEN 10 + (l_quantity - 10) / 2 ELSE 20 + (l_quantity - 30) / 3 END").replace("l_partkey % 10 =", "l_partkey % 130 % 10 ="))
def curves_and_scales(spark, sf):
    li = fixture(spark, sf, "lineitem").withColumn("rating", F.expr("1 + l_linenumber % 5")).withColumn("c", F.array(*[F.lit(x) for x in (0.0, 10.0, 30.0, 60.0, 100.0)]))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(wx.curve_at("c", F.col("l_quantity") - 5), 6).alias("at"), F.round(wx.offset_for("c", F.col("l_quantity")), 6).alias("reached"),
                     nu.weeks_shift(F.col("l_suppkey") % 60 - 30).alias("weeks"), nu.ordinal(F.col("l_partkey") % 130).alias("nth"), nu.percentile_centre("rating", fx.RATING_CENTRE).alias("centre"))


def _documents(df, record, size: int = 100):
    """Records packed into documents of a fixed size by key (bounded whatever the scale): rows (doc, entries)."""
    return df.groupBy(F.floor(F.col("k") / size).alias("doc")).agg(F.collect_list(F.struct("id", record.alias("r"))).alias("entries"))


def _people(spark, sf):
    return fixture(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("heading"), (F.col("c_custkey") % 6).cast("int").alias("sweet"), F.col("c_acctbal").alias("ssc"))


@query("record_arrays", "SELECT 'c' || c_custkey AS id, c_name AS name FROM customer")
def record_arrays(spark, sf):
    path = fresh_folder(spark)
    docs = _documents(_people(spark, sf), F.col("heading"))
    docs.select(F.to_json(F.transform("entries", lambda x: F.struct(x["id"].alias("id"), x["r"].alias("name")))).alias("value"), "doc").write.partitionBy("doc").text(path)
    return rc.read_records(spark, path, "id string, name string").select("id", "name")


@query("keyed_documents", "SELECT 'c' || c_custkey AS id, c_name AS heading, c_custkey % 6 AS sweet FROM customer")
def keyed_documents(spark, sf):
    from graftline.schemas import BOOK_ENTRY

    path = fresh_folder(spark)
    docs = _documents(_people(spark, sf), F.struct("heading", "sweet"))
    keyed = F.map_concat(F.create_map(F.lit("_book"), F.struct(F.lit("meta").alias("heading"), F.lit(0).alias("sweet"))), F.map_from_entries("entries"))
    docs.select(F.to_json(keyed).alias("value"), "doc").write.partitionBy("doc").text(path)
    return rc.read_keyed(spark, path, BOOK_ENTRY).select("id", "heading", "sweet")


@query("source_bundles", "SELECT 's' AS source, 'c' || c_custkey AS id, c_acctbal AS ssc FROM customer WHERE c_custkey // 100 % 3 <> 0")
def source_bundles(spark, sf):
    from graftline.schemas import LAB_RECORD

    path = fresh_folder(spark)
    docs = _documents(_people(spark, sf), F.struct("ssc"))
    source = F.when(F.col("doc") % 3 != 0, F.struct(F.lit("s").alias("key"), F.lit("t").alias("title")))
    docs.select(F.to_json(F.struct(source.alias("_source"), F.map_from_entries("entries").alias("records"))).alias("value"), "doc").write.partitionBy("doc").text(path)
    return rc.read_bundle(spark, path, LAB_RECORD).select("source", "id", "ssc")


@query("single_acidity_values", "SELECT l_suppkey AS accession, l_tax AS ta, 2019 AS year FROM lineitem WHERE l_tax > 0")
def single_acidity_values(spark, sf):
    from graftline.operators.lab import single_values

    return single_values(fixture(spark, sf, "lineitem").select(F.col("l_suppkey").alias("accession"), F.nullif("l_tax", F.lit(0.0)).alias("ta")), 2019)
