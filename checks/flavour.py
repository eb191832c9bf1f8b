"""Evidence merge and audit queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import FIXTURES, fixture, oracle, query
from checks.orchard import pick
from graftline import fixed_values as fx
from graftline.functions import codes
from graftline.operators import evidence as ev
from graftline.plans.evidence import merge

TAG5 = ["sweet", "sharp", "honey", "nutty", "mild", "pear", "rose"]
FIXTURES["event_tag"] = f"SELECT event_id, user_id, value, CASE event_type WHEN 'click' THEN 'sweet' WHEN 'view' THEN 'sharp' WHEN 'purchase' THEN 'honey' WHEN 'signup' THEN 'nutty' ELSE 'mild' END AS t1, {pick('event_id * 3 + user_id', TAG5)} AS t2, {pick('event_id', [1, 2, 3, 4, 5], 'event_id % 7 = 0')} AS sweet, {pick('event_id * 3 + 1', [1, 2, 3, 4, 5], 'event_id % 5 = 0')} AS acid FROM {{events}}"
FIXTURES["book"] = """SELECT 'hogg-1851' AS book, 'Hogg' AS author, 1851 AS year UNION ALL SELECT 'hogg-1884' AS book, 'Hogg' AS author, 1884 AS year UNION ALL SELECT 'beach-1905-1' AS book, 'Beach' AS author, 1905 AS year UNION ALL SELECT 'bunyard-1920' AS book, 'Bunyard' AS author, 1920 AS year
UNION ALL SELECT 'leroy-3' AS book, 'Leroy' AS author, 1873 AS year UNION ALL SELECT 'downing-1900' AS book, 'Downing' AS author, 1900 AS year"""
FIXTURES["book_entry"] = f"""SELECT event_id, {pick('event_id', ['hogg-1851', 'hogg-1884', 'beach-1905-1', 'bunyard-1920', 'leroy-3', 'downing-1900', 'no-such-book'])} AS book, user_id AS variety_id, CASE WHEN t1 = t2 THEN list_value(t1) ELSE list_value(t1, t2) END AS tags,
  CASE WHEN value < 30e0 THEN list_value({pick('event_id * 5 + user_id', TAG5)}) ELSE NULL END AS against, sweet, acid FROM {{event_tag}}"""
FIXTURES["web_source"] = f"""SELECT user_id AS variety_id, event_id AS ord, {pick('event_id', ['orangepippin', 'nursery', 'wikipedia', 'other', 'nfc'])} AS src, {pick('event_id * 7', ['https://www.Fruit.example.com/a', 'http://trees.example.org/x?y=1', 'https://shop.example.net/'])} AS url,
  list_value(t2) AS tags, CASE WHEN value < 40e0 THEN list_value({pick('event_id * 11 + user_id', TAG5)}, 'honey') ELSE NULL END AS against, sweet, acid FROM {{event_tag}}"""
FIXTURES["panel_score"] = "SELECT user_id AS variety_id, CAST(1 + max(event_id) % 9 AS DOUBLE) AS sweet, CAST(1 + max(event_id) * 5 % 9 AS DOUBLE) AS acid, CASE WHEN user_id % 6 = 0 THEN NULL ELSE CAST(1 + max(event_id) * 7 % 9 AS DOUBLE) END AS aroma FROM {events} GROUP BY user_id"
FIXTURES["measured_fixture"] = "SELECT p_partkey AS variety_id, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE CAST((p_partkey * 13) % 101 AS DOUBLE) END AS pct_ssc, CAST((p_partkey * 29) % 101 AS DOUBLE) AS pct_ta FROM {part}"
FROM = ("variety", "book", "book_entry", "web_source", "panel_score")
IMPLIED = "list_filter([CASE WHEN sweet >= 4 THEN 'sweet' END, CASE WHEN acid >= 4 THEN 'sharp' END, CASE WHEN acid <= 2 THEN 'mild' END], lambda x: x IS NOT NULL AND NOT list_contains(tags, x))"
HOST = "regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\\.', '')"
EV = f"""ev0 AS (
 SELECT variety_id, 'book' AS kind, 0 AS k, b.year::BIGINT AS ord, CASE WHEN b.author = 'Hogg' THEN 'hogg' WHEN b.author = 'Beach' THEN 'beach' WHEN b.author = 'Leroy' THEN 'leroy' ELSE b.book END AS voice, author || ' (' || year || ')' AS label, tags, {IMPLIED} AS implied, coalesce(against, []) AS against, sweet, acid FROM book_entry e JOIN book b ON b.book = e.book
 UNION ALL SELECT variety_id, 'web', 1, ord, CASE WHEN src IN ('orangepippin', 'wikipedia', 'nfc') THEN src ELSE src || ':' || {HOST} END, CASE src WHEN 'orangepippin' THEN 'Orange Pippin' WHEN 'wikipedia' THEN 'Wikipedia' WHEN 'nfc' THEN 'National Fruit Collection (UK)' ELSE {HOST} END, tags, {IMPLIED}, coalesce(against, []), sweet, acid FROM web_source
 UNION ALL SELECT variety_id, 'panel', 2, 0, 'nfc', 'panel tasting', list_filter([CASE WHEN sweet >= 7 THEN 'sweet' END, CASE WHEN acid >= 7 THEN 'sharp' END, CASE WHEN acid <= 3 THEN 'mild' END, CASE WHEN aroma >= 7 THEN 'perfumed' END], lambda x: x IS NOT NULL), []::VARCHAR[], []::VARCHAR[], NULL, NULL FROM panel_score),
ev AS (SELECT * FROM ev0 WHERE variety_id IN (SELECT variety_id FROM variety)),
fort AS (SELECT DISTINCT variety_id, tag, voice FROM (SELECT variety_id, voice, unnest(list_concat(tags, implied)) AS tag FROM ev)),
agt AS (SELECT DISTINCT variety_id, tag, voice FROM (SELECT variety_id, voice, unnest(against) AS tag FROM ev)),
seen AS (SELECT variety_id, tag, min(k * 1e12::BIGINT + ord * 100 + pos) AS seen FROM (SELECT variety_id, k, ord, unnest(list_concat(tags, implied)) AS tag, unnest(range(len(list_concat(tags, implied)))) AS pos FROM ev) GROUP BY variety_id, tag),
sup AS (SELECT variety_id, tag, sum(f)::BIGINT AS support, sum(a)::BIGINT AS against, sum(CASE WHEN f = 0 THEN a ELSE 0 END)::BIGINT AS against_only FROM (SELECT variety_id, tag, voice, max(f) AS f, max(a) AS a FROM (SELECT *, 1 AS f, 0 AS a FROM fort UNION ALL SELECT *, 0, 1 FROM agt) GROUP BY variety_id, tag, voice) GROUP BY variety_id, tag),
cnt AS (SELECT variety_id, count(DISTINCT voice) AS voices, count(DISTINCT CASE WHEN kind = 'web' THEN voice END) AS web, count(DISTINCT CASE WHEN kind <> 'panel' THEN voice END) AS written, count(DISTINCT CASE WHEN kind = 'book' THEN voice END) AS books FROM ev GROUP BY variety_id),
rec AS (SELECT variety_id, unnest(tags) AS tag, unnest(range(len(tags))) AS pos FROM variety),
dec AS (SELECT r.variety_id, r.tag, r.pos, coalesce(s.support, 0) AS support, coalesce(s.against_only, 0) AS against, CASE WHEN coalesce(s.against_only, 0) > coalesce(s.support, 0) AND (s.against_only >= 2 OR (c.web > 0 AND c.written >= 2)) THEN 'contested'
  WHEN coalesce(s.support, 0) > 0 OR coalesce(c.written, 0) < 2 OR coalesce(c.web, 0) = 0 THEN 'kept' ELSE 'unverified' END AS decision FROM rec r LEFT JOIN sup s USING (variety_id, tag) LEFT JOIN cnt c USING (variety_id)),
adt AS (SELECT s.variety_id, s.tag, s.support, n.seen FROM sup s JOIN seen n USING (variety_id, tag) WHERE support >= 2 AND against < support AND (s.variety_id, s.tag) NOT IN (SELECT (variety_id, tag) FROM rec)),
fin AS (SELECT variety_id, rank, tag, support, CASE WHEN support >= 3 THEN 'firm' WHEN support = 2 THEN 'supported' WHEN support = 1 THEN 'reported' ELSE 'unsourced' END AS level FROM (SELECT *, row_number() OVER (PARTITION BY variety_id ORDER BY support DESC, place, seen, tag) AS rank
  FROM (SELECT variety_id, tag, support, pos AS place, -1 AS seen FROM dec WHERE decision = 'kept' UNION ALL SELECT variety_id, tag, support, 99, seen FROM adt)) WHERE rank <= 8)"""


def parts(spark, sf):
    v = fixture(spark, sf, "variety")
    e, orphans = ev.evidence_union(ev.book_evidence(fixture(spark, sf, "book_entry"), fixture(spark, sf, "book")), ev.web_evidence(fixture(spark, sf, "web_source")), ev.panel_evidence(fixture(spark, sf, "panel_score")), v)
    return v, e, orphans


def merged(spark, sf):
    v, e, _ = parts(spark, sf)
    m = merge(e, v)
    return dict(v=v, e=m.evidence, voices=m.voices, recorded=ev.recorded_tags(v), support=m.support, counts=m.counts, decisions=m.decisions, added=m.added, final=m.final)


@query("evidence_voices", oracle(FROM, "SELECT variety_id, kind, voice, label, count(*) AS sources FROM ev GROUP BY ALL", EV))
def evidence_voices(spark, sf):
    return parts(spark, sf)[1].groupBy("variety_id", "kind", "voice", "label").agg(F.count("*").alias("sources"))


FIXTURES["known_variety"] = "SELECT variety_id FROM {variety} WHERE variety_id % 2 = 0"


@query("evidence_orphans", oracle(FROM, "SELECT variety_id, kind, count(*) AS n FROM ev0 WHERE variety_id NOT IN (SELECT variety_id FROM variety WHERE listed) GROUP BY ALL", EV))
def evidence_orphans(spark, sf):
    v, e, _ = parts(spark, sf)
    rows = ev.evidence_union(ev.book_evidence(fixture(spark, sf, "book_entry"), fixture(spark, sf, "book")), ev.web_evidence(fixture(spark, sf, "web_source")), ev.panel_evidence(fixture(spark, sf, "panel_score")), v.where("listed"))
    return rows[1].groupBy("variety_id", "kind").agg(F.count("*").alias("n"))


@query("tag_support", oracle(FROM, "SELECT * FROM sup", EV))
def tag_support(spark, sf):
    return merged(spark, sf)["support"].drop("seen")


@query("source_counts", oracle(FROM, "SELECT * FROM cnt", EV))
def source_counts(spark, sf):
    return merged(spark, sf)["counts"]


@query("tag_decisions", oracle(FROM, "SELECT * FROM dec", EV))
def tag_decisions(spark, sf):
    return merged(spark, sf)["decisions"]


@query("added_tags", oracle(FROM, "SELECT variety_id, tag, support FROM adt", EV))
def added_tags(spark, sf):
    return merged(spark, sf)["added"].drop("seen")


@query("final_tags", oracle(FROM, "SELECT * FROM fin", EV))
def final_tags(spark, sf):
    return merged(spark, sf)["final"]


@query("merged_voices", oracle(FROM, """SELECT w.variety_id, w.voice, w.kind, w.label, coalesce(t.tags, '') AS tags FROM (SELECT variety_id, voice, arg_min(kind, k * 1e12::BIGINT + ord) AS kind, arg_min(label, k * 1e12::BIGINT + ord) AS label FROM ev GROUP BY variety_id, voice) w LEFT JOIN (
 SELECT variety_id, voice, string_agg(tag, ',' ORDER BY o, tag) AS tags FROM (SELECT variety_id, voice, tag, min(k * 1e12::BIGINT + ord * 100 + pos) AS o FROM (SELECT variety_id, voice, k, ord, unnest(tags) AS tag, unnest(range(len(tags))) AS pos FROM ev) GROUP BY variety_id, voice, tag) GROUP BY variety_id, voice) t USING (variety_id, voice)""", EV))
def merged_voices(spark, sf):
    return ev.merge_voices(parts(spark, sf)[1]).withColumn("tags", F.array_join("tags", ","))


@query("evidence_stats", oracle(FROM + ("measured_fixture",), """SELECT 'with sources' AS stat, count(*) AS n FROM cnt UNION ALL SELECT 'with book entries', count(CASE WHEN books > 0 THEN 1 END) FROM cnt UNION ALL SELECT 'unverified tags', count(CASE WHEN decision = 'unverified' THEN 1 END) FROM dec
 UNION ALL SELECT 'contested tags', count(CASE WHEN decision = 'contested' THEN 1 END) FROM dec UNION ALL SELECT 'added tags', count(*) FROM adt UNION ALL SELECT 'varieties', count(*) FROM variety UNION ALL SELECT 'with measurements', count(DISTINCT variety_id) FROM measured_fixture WHERE variety_id IN (SELECT variety_id FROM variety)""", EV))
def evidence_stats(spark, sf):
    m = merged(spark, sf)
    return ev.evidence_stats(m["v"], m["counts"], m["decisions"], m["added"], fixture(spark, sf, "measured_fixture"))


@query("books_in_order", oracle(FROM, "SELECT event_id, variety_id, e.book, year, author FROM book_entry e JOIN book b ON b.book = e.book"))
def books_in_order(spark, sf):
    return ev.order_books(fixture(spark, sf, "book_entry"), fixture(spark, sf, "book")).select("event_id", "variety_id", "book", "year", "author")


@query("audit_levels", oracle(FROM, "SELECT level, count(*) AS tags FROM fin GROUP BY level", EV))
def audit_levels(spark, sf):
    return ev.audit_levels(merged(spark, sf)["final"])


@query("single_source_tags", oracle(FROM, "SELECT tag, count(*) AS varieties FROM fin WHERE support = 1 GROUP BY tag", EV))
def single_source_tags(spark, sf):
    return ev.single_source_tags(merged(spark, sf)["final"])


@query("source_histogram", oracle(FROM, "SELECT least(coalesce(voices, 0), 4) AS voices, count(*) AS varieties FROM variety LEFT JOIN cnt USING (variety_id) GROUP BY 1", EV))
def source_histogram(spark, sf):
    m = merged(spark, sf)
    return ev.source_histogram(m["v"], m["counts"])


@query("audit_changes", oracle(FROM, """SELECT variety_id, 'dropped' AS change, tag, NULL AS voice FROM dec WHERE decision = 'unverified' UNION ALL SELECT d.variety_id, 'contested', d.tag, a.voice FROM dec d JOIN agt a USING (variety_id, tag) WHERE decision = 'contested'
 UNION ALL SELECT variety_id, 'added', tag, NULL FROM adt""", EV))
def audit_changes(spark, sf):
    m = merged(spark, sf)
    return ev.audit_changes(m["decisions"], m["added"], m["voices"])




def _disagree_sql() -> str:
    out = []
    for scale, pct in (("sweet", "pct_ssc"), ("acid", "pct_ta")):
        out += [f"SELECT variety_id, '{scale}' AS scale, {scale} AS ours, {pct} AS theirs, 'laboratory' AS against FROM variety JOIN measured_fixture USING (variety_id) WHERE abs((20 * {scale} - 10) - {pct}) >= 40",
                f"SELECT v.variety_id, '{scale}', v.{scale}, p.{scale}, 'panel' FROM variety v JOIN panel_score p USING (variety_id) WHERE abs((p.{scale} + 1) / 2 - v.{scale}) >= 2",
                f"SELECT v.variety_id, '{scale}', v.{scale}, s.m::DOUBLE, 'books' FROM variety v JOIN (SELECT variety_id, list_sort(list({scale}))[len(list({scale})) // 2 + 1] AS m FROM ev WHERE kind = 'book' AND {scale} > 0 GROUP BY variety_id) s USING (variety_id) WHERE abs(s.m - v.{scale}) >= 2"]
    return " UNION ALL ".join(out)


@query("audit_disagreements", oracle(FROM + ("measured_fixture",), _disagree_sql(), EV))
def audit_disagreements(spark, sf):
    v, e, _ = parts(spark, sf)
    return ev.audit_disagreements(v, fixture(spark, sf, "measured_fixture"), fixture(spark, sf, "panel_score"), e)


@query("audit_unsourced", oracle(FROM, "SELECT variety_id, name FROM variety WHERE variety_id NOT IN (SELECT variety_id FROM cnt)", EV))
def audit_unsourced(spark, sf):
    m = merged(spark, sf)
    return ev.audit_unsourced(m["v"], m["counts"])


FIXTURES["researcher_note"] = "SELECT user_id AS variety_id, max(CASE WHEN event_id % 5 = 0 THEN 'two|kinds of' || chr(10) || event_type WHEN event_id % 3 = 0 THEN '' END) AS note FROM {events} GROUP BY user_id"


@query("audit_notes", oracle(["variety", "researcher_note"], "SELECT row_number() OVER (ORDER BY name, variety_id) AS row, variety_id, name, replace(replace(note, '|', '/'), chr(10), ' ') AS note FROM researcher_note JOIN variety USING (variety_id) WHERE note <> ''"))
def audit_notes(spark, sf):
    return ev.audit_notes(fixture(spark, sf, "variety"), fixture(spark, sf, "researcher_note"))


@query("flavour_stats", oracle(FROM, """SELECT 'tag' AS part, tag AS name, level, count(*) AS n FROM fin GROUP BY tag, level UNION ALL SELECT 'book', book, NULL, count(*) FROM book_entry WHERE variety_id IN (SELECT variety_id FROM variety) AND book IN (SELECT book FROM book) GROUP BY book
 UNION ALL SELECT 'tags', 'dropped', NULL, count(CASE WHEN decision <> 'kept' THEN 1 END) FROM dec UNION ALL SELECT 'tags', 'added', NULL, count(*) FROM adt""", EV))
def flavour_stats(spark, sf):
    m = merged(spark, sf)
    known = fixture(spark, sf, "book_entry").join(m["v"].select("variety_id"), "variety_id", "left_semi").join(fixture(spark, sf, "book").select("book"), "book", "left_semi")
    return ev.flavour_stats(m["final"], m["decisions"], m["added"], known)


FIXTURES["context_note"] = "SELECT user_id AS variety_id, max(CASE WHEN event_id % 5 = 0 THEN 'keeps well' ELSE '' END) AS storage_change, min(CASE WHEN event_id % 7 = 0 THEN 'Nov' END) AS peak, min(CASE WHEN event_id % 4 = 0 THEN 'cool' END) AS needs, min(CASE WHEN event_id % 9 = 0 THEN 'note' END) AS note, count(*) AS n FROM {events} GROUP BY user_id"


@query("attached_context", oracle(FROM + ("context_note", "measured_fixture"), """SELECT v.variety_id, nullif(c.storage_change, '') AS storage_change, c.peak, c.needs, CASE WHEN coalesce(c.needs, c.note) IS NOT NULL THEN coalesce(c.note, '') END AS note, p.sweet AS panel_sweet, p.acid AS panel_acid, p.aroma AS panel_aroma, p.variety_id % 9 + 0.5 AS panel_balance, CASE WHEN p.variety_id IS NOT NULL THEN 2024 END AS panel_tasted, m.pct_ssc, m.pct_ta, m.variety_id % 20 / 2.0 AS ssc, CASE WHEN m.variety_id IS NOT NULL THEN 3 END AS measured_n, CASE WHEN c.n >= 3 THEN c.n END AS visitor_reports, CASE WHEN c.n >= 3 THEN c.n / 2.0 END AS visitor_sweet
 FROM variety v LEFT JOIN context_note c USING (variety_id) LEFT JOIN panel_score p USING (variety_id) LEFT JOIN measured_fixture m USING (variety_id)"""))
def attached_context(spark, sf):
    c = fixture(spark, sf, "context_note")
    panel = fixture(spark, sf, "panel_score").withColumns({"balance": F.expr("variety_id % 9 + 0.5e0"), "juice": F.lit(None).cast("double"), "quality": F.lit(None).cast("double"), "assessed": F.expr("array(named_struct('harvest', 'Oct', 'tasted', 2024))")})
    measured = fixture(spark, sf, "measured_fixture").withColumns({"ssc": F.expr("variety_id % 20 / 2e0"), "ta": F.lit(1.0), "n": F.lit(3)})
    a = ev.attach_context(fixture(spark, sf, "variety").select("variety_id"), c.drop("n"), panel, measured, c.selectExpr("variety_id", "n", "n / 2e0 AS sweet"))
    return a.select("variety_id", "storage_change", "peak", F.col("climate_flavour.needs").alias("needs"), F.col("climate_flavour.note").alias("note"), F.col("panel.sweet").alias("panel_sweet"), F.col("panel.acid").alias("panel_acid"), F.col("panel.aroma").alias("panel_aroma"),
                    F.col("panel.balance").alias("panel_balance"), F.col("panel.tasted").alias("panel_tasted"), "measured.pct_ssc", "measured.pct_ta", "measured.ssc", F.col("measured.n").alias("measured_n"), F.col("visitors.n").alias("visitor_reports"), F.col("visitors.sweet").alias("visitor_sweet"))


@query("tag_names", oracle(["variety"], "SELECT tag, CASE tag WHEN 'pear-drop' THEN 'pear drop' WHEN 'rose' THEN 'rose-water' ELSE tag END AS label, CASE " + " ".join(f"WHEN tag IN ({', '.join(repr(t) for t in ts)}) THEN '{f}'" for f, ts in fx.TAG_FAMILIES) + " END AS family, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM variety) GROUP BY tag"))
def tag_names(spark, sf):
    t = fixture(spark, sf, "variety").select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    return t.select("tag", codes.tag_label("tag").alias("label"), codes.tag_family("tag").alias("family"), "n")


@query("book_links", oracle(["book_entry"], """SELECT event_id, 'https://archive.org/details/' || book || '?q=' || replace(url_encode('"' || h || '"'), '+', '%20') AS link FROM (SELECT event_id, book, substr(trim(book || ' & co. ' || variety_id, ' .'), 1, 40) AS h FROM book_entry)"""))
def book_links(spark, sf):
    b = fixture(spark, sf, "book_entry")
    return b.select("event_id", codes.book_link(F.concat(F.lit("https://archive.org/details/"), "book"), F.concat_ws(" & co. ", "book", F.col("variety_id").cast("string")), F.lit("x")).alias("link"))
