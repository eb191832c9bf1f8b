"""Text corpus and coverage queries."""
from __future__ import annotations

import re

from pyspark.sql import functions as F

from checks.base import FIXTURES, fixture, oracle, query, ratio_sql
from checks.climate import rounded
from checks.labs import decoded_sql, key_sql, loose_sql, upper_sql
from checks.orchard import pick
from graftline import fixed_values as fx
from graftline.operators import corpus as co
from graftline.operators import gaps as gp
from graftline.plans.coverage import coverage as cover
from graftline.plans.lineage import cut
from graftline.sources import text as tx

BACKSLASH_N = "chr(10)"
LINES = "lines AS (SELECT doc_id AS book, unnest(range(len(string_split(text, chr(10))))) + 1 AS line_no, unnest(string_split(text, chr(10))) AS text FROM documents)"
FIXTURES["book_name"] = "SELECT doc_id AS variety_id, split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) AS name, list_value(split_part(text, ' ', 3), split_part(text, ' ', 4) || ' ' || split_part(text, ' ', 5) || ' Pippin') AS aka FROM {documents}"


def lines(spark, sf):
    return tx.numbered_lines(fixture(spark, sf, "documents").withColumnRenamed("doc_id", "book"), "book", "text")


@query("numbered_lines", oracle([], "SELECT book, line_no, text FROM lines", LINES))
def numbered_lines(spark, sf):
    return lines(spark, sf)


LHEAD = f"""h0 AS (SELECT variety_id, {upper_sql('n')} AS k FROM (SELECT variety_id, unnest(list_prepend(name, aka)) AS n FROM book_name)),
h1 AS (SELECT variety_id, k, trim(replace(regexp_replace(k, '\\bS\\b', '', 'g'), '  ', ' ')) AS k2 FROM h0 WHERE length(k) >= 5),
hk AS (SELECT DISTINCT variety_id, x AS key FROM (SELECT variety_id, k AS x FROM h1 UNION ALL SELECT variety_id, k2 FROM h1 UNION ALL SELECT variety_id, regexp_replace(k2, ' (PIPPIN|PEARMAIN|SEEDLING|APPLE)$', '') FROM h1) WHERE length(x) >= 5 AND (contains(x, ' ') OR length(x) >= 7)),
ln AS (SELECT book, line_no, trim(text) AS raw, {upper_sql('trim(text)')} AS u FROM lines WHERE length(trim(text)) >= 5),
ht AS (SELECT book, line_no, raw, variety_id, key, length(key) AS kl, substr(raw, 1, length(key) + 6) AS head FROM ln JOIN hk ON u = key OR starts_with(u, key || ' ')),
hs AS (SELECT *, round(1 + CASE WHEN length(regexp_replace(head, '[^\\p{{Lu}}]', '', 'g')) / greatest(1, length(regexp_replace(head, '[^\\p{{L}}]', '', 'g'))) > 0.8 THEN 2 ELSE 0 END
  + CASE WHEN regexp_matches(CASE WHEN length(raw) > kl THEN substr(raw, kl + 1, 8) ELSE '.' END, '^[^a-z]*[.,—:;-]') THEN 0.5 ELSE 0 END + CASE WHEN contains(key, ' ') THEN 0.3 ELSE 0 END, 2)::DOUBLE AS score FROM ht),
hb AS (SELECT book, variety_id, line_no, max(score) AS score, arg_max(key, (score, key)) AS key, any_value(substr(raw, 1, 160)) AS text FROM hs GROUP BY book, variety_id, line_no)"""


# every third line is followed by a number, mostly the running page
PAGED = LINES + """,
pl AS (SELECT book, 2 * line_no AS line_no, text FROM lines UNION ALL SELECT book, 2 * line_no + 1, ' ' || (line_no * 7 + book % 60) % 4000 FROM lines WHERE line_no % 3 = 2)"""
PAGE_OF = """pn AS (SELECT book, line_no, row_number() OVER (PARTITION BY book ORDER BY line_no) AS i, list(n) OVER (PARTITION BY book ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS ns FROM (SELECT book, line_no, trim(text)::BIGINT AS n FROM {t} WHERE regexp_matches(trim(text), '^\\d{{1,4}}$'))),
pr AS (SELECT book, line_no, list_reduce(list_prepend(-1::BIGINT, ns[1:i]), lambda a, b: CASE WHEN b > greatest(a, 0) AND b <= greatest(a, 0) + 40 OR b = 0 AND a <= 0 THEN b ELSE a END) AS p FROM pn),
pg AS (SELECT t.book, t.line_no, nullif(last_value(p IGNORE NULLS) OVER (PARTITION BY t.book ORDER BY t.line_no), -1) AS page FROM {t} t LEFT JOIN pr USING (book, line_no))"""


@query("heading_candidates", oracle(["book_name"], "SELECT book, variety_id, line_no, page, score, key, text, rank FROM (SELECT *, row_number() OVER (PARTITION BY book, variety_id ORDER BY score DESC, line_no) AS rank FROM hb) WHERE rank <= 6".replace("FROM (SELECT *", "FROM (SELECT hb.*, page").replace("FROM hb)", "FROM hb JOIN pg USING (book, line_no))"),
                                    PAGED + "," + LHEAD.replace("FROM lines WHERE", "FROM pl WHERE") + ",\n" + PAGE_OF.format(t="pl")))
def heading_candidates(spark, sf):
    base = lines(spark, sf)
    numbers = base.where("line_no % 3 = 2").selectExpr("book", "2 * line_no + 1 AS line_no", "concat(' ', (line_no * 7 + book % 60) % 4000) AS text")
    paged = base.selectExpr("book", "2 * line_no AS line_no", "text").unionByName(numbers)
    return co.locate(paged, co.variety_headings(fixture(spark, sf, "book_name")), chunk_lines=16)


# scanned pages: number lines from the orders of each customer, a third of them in one book
FIXTURES["page_line"] = """SELECT CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE o_custkey % 40 END AS book, o_orderkey AS line_no, CASE WHEN o_orderkey % 5 = 0 THEN 'plate ' || o_orderpriority WHEN o_orderkey % 11 = 0 THEN ' ' || CAST(o_orderkey % 3000 AS STRING) ELSE CAST(CAST(floor(o_orderkey / 10e0) AS BIGINT) + o_custkey % 7 AS STRING) || ' ' END AS text FROM {orders}"""


@query("running_page_numbers", oracle(["page_line"], "SELECT book, line_no, page FROM pg", PAGE_OF.format(t="page_line")))
def running_page_numbers(spark, sf):
    return co.page_numbers(fixture(spark, sf, "page_line"), chunk_lines=4000)


FIXTURES["book_span"] = "SELECT doc_id AS entry_id, doc_id AS book, CASE WHEN doc_id % 9 = 0 THEN 2 ELSE 1 END AS line, CASE WHEN doc_id % 4 = 0 THEN 1 WHEN doc_id % 7 = 0 THEN 450 ELSE CAST(1 + doc_id % 6 AS INT) END AS end FROM {documents}"


@query("entry_span_checks", oracle(["book_span"], """SELECT entry_id, book, line, "end", n_lines, problem FROM (SELECT *, CASE WHEN NOT (line >= 1 AND line <= "end" AND "end" <= n_lines) THEN 'outside' WHEN "end" - line > 400 THEN 'too_long' END AS problem
 FROM book_span JOIN (SELECT book, max(line_no) AS n_lines FROM lines GROUP BY book) USING (book)) WHERE problem IS NOT NULL""", LINES).replace("AS end FROM", 'AS "end" FROM'))
def entry_span_checks(spark, sf):
    return co.check_spans(fixture(spark, sf, "book_span"), lines(spark, sf))


FIXTURES["entry"] = "SELECT doc_id AS entry_id, doc_id AS book, 1 AS line, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS INT) AS end FROM {documents}"


@query("entry_texts", oracle(["entry"], """SELECT entry_id, CASE WHEN length(t) <= 5000 THEN t ELSE regexp_replace(substr(t, 1, 5000), ' [^ ]*$', '') || ' …' END AS text FROM (SELECT entry_id, array_to_string(list_transform(list_filter(regexp_split_to_array(j, '\\n\\n+'), lambda p: trim(p, chr(10) || ' ') <> ''),
 lambda p: replace(regexp_replace(trim(p, chr(10)), '-\\n(\\p{Ll})', '\\1', 'g'), chr(10), ' ')), chr(10) || chr(10)) AS t FROM (
 SELECT entry_id, string_agg(s, chr(10) ORDER BY line_no) AS j FROM (SELECT entry_id, line_no, replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '�', '—') AS s FROM entry JOIN lines USING (book) WHERE line_no BETWEEN line AND "end") WHERE NOT regexp_matches(s, '^\\d{1,4}$') GROUP BY entry_id))""", LINES).replace("AS end FROM", 'AS "end" FROM'))
def entry_texts(spark, sf):
    return co.entry_text(fixture(spark, sf, "entry"), lines(spark, sf))


# quotes: a passage of the benchmark, and the entry's own opening with a misprint and with words run together
FIXTURES["quote"] = """SELECT d.doc_id AS entry_id, 'flavour' AS field, b.text AS quote FROM {documents} d JOIN {benchmark} b ON b.item_id = d.doc_id % 40
UNION ALL SELECT doc_id AS entry_id, 'quality' AS field, replace(substr(text, CAST(1 + (doc_id * 37) % greatest(length(text), 1) AS INT), 120), 'th', 'tb') AS quote FROM {documents} UNION ALL SELECT doc_id AS entry_id, 'storage' AS field, replace(substr(text, CAST(1 + (doc_id * 101) % greatest(length(text), 1) AS INT), 90), 'e', ' e') AS quote FROM {documents}"""


def words_sql(x: str) -> str:
    return f"list_filter(regexp_extract_all(regexp_replace(lower(strip_accents({x})), '-\\s*\\n\\s*', '', 'g'), '[a-z]+'), lambda q: length(q) > 2)"


QUOTES = f"""ch AS (SELECT entry_id, string_agg(text, chr(10) ORDER BY line_no) AS c FROM entry JOIN lines USING (book) WHERE line_no BETWEEN greatest(1, line - 2) AND "end" + 2 GROUP BY entry_id),
pool AS (SELECT DISTINCT entry_id, unnest(list_concat({words_sql('c')}, regexp_extract_all(lower(c), '[a-z]+'))) AS p FROM ch),
qw AS (SELECT entry_id, field, {words_sql('quote')} AS ws FROM quote),
qx AS (SELECT entry_id, field, unnest(range(1, len(ws) + 1)) AS i, ws FROM qw WHERE len(ws) > 0),
qy AS (SELECT entry_id, field, i, ws[i] AS x, CASE WHEN i < len(ws) THEN ws[i] || ws[i + 1] END AS nx, CASE WHEN i > 1 THEN ws[i - 1] || ws[i] END AS px FROM qx),
direct AS (SELECT q.entry_id, field, i, x, bool_or(p.p IS NOT NULL) AS hit FROM (SELECT entry_id, field, i, x, unnest([x, nx, px]) AS f FROM qy) q LEFT JOIN pool p ON p.entry_id = q.entry_id AND p.p = q.f GROUP BY q.entry_id, field, i, x),
np AS (SELECT DISTINCT o.entry_id, o.x AS a, p.p AS b FROM (SELECT DISTINCT entry_id, x FROM direct WHERE NOT hit AND length(x) >= 4) o JOIN pool p ON p.entry_id = o.entry_id AND abs(length(p.p) - length(o.x)) <= 2 AND levenshtein(o.x, p.p) <= floor((length(o.x) + length(p.p)) * 0.2 + 1e-9)),
{ratio_sql('np')},
nearw AS (SELECT DISTINCT entry_id, a AS x FROM np JOIN gr USING (a, b) WHERE ratio >= 0.8)"""


@query("quote_verification", oracle(["entry", "quote"], """SELECT entry_id, field, count(*) AS words, round(avg(CASE WHEN hit OR n.x IS NOT NULL THEN 1 ELSE 0 END), 6) AS share, avg(CASE WHEN hit OR n.x IS NOT NULL THEN 1 ELSE 0 END) >= 0.8 AS ok
 FROM direct d LEFT JOIN nearw n USING (entry_id, x) GROUP BY entry_id, field""", LINES + "," + QUOTES).replace("AS end FROM", 'AS "end" FROM').replace("WITH ", "WITH RECURSIVE ", 1))
def quote_verification(spark, sf):
    return rounded(co.verify_quotes(fixture(spark, sf, "entry"), fixture(spark, sf, "quote"), lines(spark, sf)), "share")


FIXTURES["tasting_summary"] = f"""SELECT doc_id AS variety_id, text || {pick('doc_id', [' Hints of vanilla and honey, a spicy finish.', ' No vanilla; not floral, but rose-water.', ' Without any trace of pineapple. Nutty and peary.', ' Lacking honey. Winey strawberry, little banana', ' Unlike the pearmain a pear-drop scent, earthy'])} AS text,
  CASE WHEN doc_id % 3 = 0 THEN list_value('honey', 'nutty') WHEN doc_id % 3 = 1 THEN list_value('a', 'b', 'c', 'd', 'e', 'f', 'g') END AS tags FROM {{documents}}"""


# SQL has no look-behind: the text is split at the pattern, and what stands before each place must not end in a negation
TAGGED = ("rx AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}', '{x.replace(chr(39), chr(39) * 2)}')" for i, (t, x) in enumerate((t, re.sub(r"\(\?!.*?\)", "", x)) for t, x in fx.TAG_PATTERNS.items())) + ") AS v(n, tag, x)),\n"
          f"""sp AS (SELECT variety_id, text, tags, n, tag, regexp_split_to_array(text, '(?i:' || x || ')') AS parts, regexp_extract_all(text, '(?i:' || x || ')') AS found FROM tasting_summary, rx WHERE text <> '' AND regexp_matches(text, '(?i:' || x || ')')),
pl AS (SELECT variety_id, tags, n, tag, text, unnest(list_transform(range(1, len(found) + 1), lambda k: list_sum(list_transform(parts[1:k], lambda q: length(q)))::BIGINT + coalesce(list_sum(list_transform(found[1:k - 1], lambda q: length(q))), 0)::BIGINT)) AS before, unnest(found) AS hit FROM sp),
ok AS (SELECT DISTINCT variety_id, tags, n, tag FROM pl WHERE NOT regexp_matches(substr(text, greatest(1, before - 59), least(before, 60)), '{fx.NEGATION}[^.;]{{0,25}}$')
 AND NOT (tag = 'pear' AND regexp_matches(lower(substr(text, before + length(hit) + 1, 5)), '^([- ]drop|main)')))""")


@query("tags_from_text", oracle(["tasting_summary"], """SELECT variety_id, (row_number() OVER (PARTITION BY variety_id ORDER BY n) - 1)::INT AS pos, tag FROM ok WHERE NOT list_contains(coalesce(tags, []), tag) QUALIFY row_number() OVER (PARTITION BY variety_id ORDER BY n) <= 8 - coalesce(len(tags), 0)""", TAGGED))
def tags_from_text(spark, sf):
    return co.scan_tags(fixture(spark, sf, "tasting_summary"))


@query("book_headings", oracle([], f"""SELECT DISTINCT book, heading FROM (SELECT book, array_to_string(w[1:n], ' ') AS heading FROM (SELECT book, string_split({key_sql('text')}, ' ')[1:5] AS w FROM lines), (SELECT unnest([2, 3, 4, 5]) AS n) WHERE n <= len(w)
 UNION ALL SELECT book, {key_sql('c')} FROM (SELECT book, regexp_extract(text || chr(10), '^\\s*([A-Z][A-Z''’-]{{4,}})[.,\\s]', 1) AS c FROM lines) WHERE c <> '')""", LINES))
def book_headings(spark, sf):
    return co.book_headings(lines(spark, sf))


# ---- coverage -----------------------------------------------------------------------------------
FIXTURES["listing"] = """SELECT list, name, name_id AS ord, CASE WHEN name_id % 4 = 0 THEN 'http://x/' || CAST(name_id AS STRING) END AS url, CASE WHEN name_id % 6 = 0 THEN list_value(brand || ' ' || CAST(name_id % 50 AS STRING), 'Customer' || CAST(name_id % 9 AS STRING)) ELSE list_value('') END AS aka FROM {listed_name}
UNION ALL SELECT 'orangepippin' AS list, p_brand || ' ' || CAST(p_partkey % 50 AS STRING) AS name, p_partkey AS ord, NULL AS url, list_value(p_name) AS aka FROM {part} WHERE p_partkey % 4 = 1
UNION ALL SELECT 'nfc' AS list, replace(p_name, ' ', '') AS name, p_partkey AS ord, NULL AS url, list_value('') AS aka FROM {part} WHERE p_partkey % 10 = 2
UNION ALL SELECT 'abc' AS list, split_part(p_brand, '#', 1) || CAST(p_partkey % 400 AS STRING) || 'x' || CASE WHEN p_partkey % 2 = 0 THEN ' long form' ELSE '' END AS name, p_partkey AS ord, NULL AS url, list_value('') AS aka FROM {part}"""
FIXTURES["atlas"] = "SELECT p_partkey AS variety_id, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'Customer ' || CAST(p_partkey AS STRING) END AS name, list_value(p_brand || '''s ' || CAST(p_partkey % 50 AS STRING)) AS aka FROM {part} WHERE p_retailprice % 3 < 1"
RANK = "CASE list " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(fx.LIST_WEIGHTS)) + " END"
GAPS = f"""l0 AS (SELECT list, ord, url, aka, regexp_replace(regexp_replace(regexp_replace(name, '\\s*\\((3n|2n|4n|\\d+x|triploid|tetraploid|[A-Z][a-z]+)\\)\\s*$', ''), '(?i)\\s*\\((apple|cultivar|apple cultivar|malus)\\)$', ''), '^Malus\\s+[''‘]?(.+?)[''’]?$', '\\1') AS m FROM listing),
l1 AS (SELECT list, ord, url, aka, CASE WHEN regexp_matches(m, '(?i)^(lady|crab|pine|winter|summer)\\b') THEN trim(m) ELSE trim(regexp_replace(m, '(?i)\\s+(apple|apples)$', '')) END AS name FROM l0),
cl AS (SELECT *, {loose_sql('name')} AS key, {RANK} AS lr FROM l1 WHERE name <> '' AND NOT regexp_matches(name, '{fx.NOT_CULTIVAR}') AND NOT regexp_matches(name, '^[A-Z]{{1,4}}[ -]?\\d')),
nm AS (SELECT key, arg_min(name, (lr, ord)) AS name, list_sort(list(DISTINCT list)) AS sources, arg_min(url, (lr, ord)) FILTER (WHERE url IS NOT NULL) AS url FROM cl GROUP BY key),
al AS (SELECT DISTINCT key, aka, {loose_sql('aka')} AS aka_key FROM (SELECT key, unnest(aka) AS aka FROM cl) WHERE aka <> ''),
hv AS (SELECT DISTINCT key FROM (SELECT {key_sql('n')} AS key FROM (SELECT unnest(list_prepend(name, aka)) AS n FROM atlas) UNION ALL SELECT {loose_sql('n')} FROM (SELECT unnest(list_prepend(name, aka)) AS n FROM atlas)) WHERE key <> ''),
nr AS (SELECT n.*, row_number() OVER (ORDER BY m.lr, m.ord, n.key) AS o FROM nm n JOIN (SELECT key, min((lr, ord))[1] AS lr, min((lr, ord))[2] AS ord FROM cl GROUP BY key) m USING (key)),
ed AS (SELECT DISTINCT a.key AS p, a.aka_key AS c, x.o AS op, y.o AS oc FROM al a JOIN nr x ON x.key = a.key JOIN nr y ON y.key = a.aka_key WHERE a.key <> a.aka_key),
pn AS (SELECT p, row_number() OVER (ORDER BY op) AS i, list(c ORDER BY oc) AS cs FROM ed GROUP BY p, op),
st(i, gone, who) AS (SELECT 0::BIGINT, []::VARCHAR[], []::VARCHAR[] UNION ALL SELECT st.i + 1, CASE WHEN list_contains(gone, p) THEN gone ELSE list_concat(gone, list_filter(cs, lambda x: NOT list_contains(gone, x))) END,
  CASE WHEN list_contains(gone, p) THEN who ELSE list_concat(who, list_transform(list_filter(cs, lambda x: NOT list_contains(gone, x)), lambda x: p)) END FROM st JOIN pn ON pn.i = st.i + 1),
ab AS (SELECT unnest(gone) AS c, unnest(who) AS p FROM (SELECT gone, who FROM st ORDER BY i DESC LIMIT 1)),
rt(key, root, way) AS (SELECT c, p, [o] FROM ab JOIN nr ON nr.key = c UNION ALL SELECT rt.key, ab.p, list_prepend(n.o, way) FROM rt JOIN ab ON ab.c = rt.root JOIN nr n ON n.key = rt.root),
r1 AS (SELECT key, max_by(root, len(way)) AS root, max_by(way, len(way)) AS way FROM rt GROUP BY key),
m1 AS (SELECT coalesce(r1.root, n.key) AS key, arg_min(url, coalesce(way, [])) FILTER (WHERE url IS NOT NULL) AS url, list_sort(list_distinct(flatten(list(sources)))) AS sources FROM nr n LEFT JOIN r1 USING (key) GROUP BY 1),
m1n AS (SELECT m1.*, n.name, n.o, replace(m1.key, ' ', '') AS pk FROM m1 JOIN nr n USING (key)),
m2 AS (SELECT arg_min(key, o) AS key, arg_min(name, o) AS name, min(o) AS o, arg_min(url, o) FILTER (WHERE url IS NOT NULL) AS url, list_sort(list_distinct(flatten(list(sources)))) AS sources FROM m1n GROUP BY pk),
lg AS (SELECT split_part(key, ' ', 1) AS w, min(key) AS root FROM m2 WHERE contains(key, ' ') GROUP BY 1 HAVING count(*) = 1),
sf AS (SELECT s.key, lg.root FROM m2 s JOIN lg ON lg.w = s.key WHERE length(s.key) >= 5 AND s.key NOT IN (SELECT key FROM hv) AND {key_sql('s.name')} NOT IN (SELECT key FROM hv)),
mg AS (SELECT m2.key, name, url, list_sort(list_distinct(list_concat(sources, coalesce(x.more, [])))) AS sources FROM m2 LEFT JOIN (SELECT root, flatten(list(sources)) AS more FROM sf JOIN m2 USING (key) GROUP BY root) x ON x.root = m2.key WHERE m2.key NOT IN (SELECT key FROM sf)),
am AS (SELECT al.* FROM al JOIN mg USING (key)),
cv AS (SELECT DISTINCT key FROM (SELECT key, key AS f FROM mg UNION ALL SELECT key, {key_sql('name')} FROM mg UNION ALL SELECT key, aka_key FROM am UNION ALL SELECT key, {key_sql('aka')} FROM am) WHERE f IN (SELECT key FROM hv))"""
SCORE = " + ".join(f"CASE WHEN list_contains(sources, '{k}') THEN {w} ELSE 0 END" for k, w in fx.LIST_WEIGHTS.items())
SCORE0 = " + ".join(f"CASE WHEN list_contains(sources, '{k}') THEN {w} ELSE 0 END" for k, w in fx.LIST_WEIGHTS.items() if k not in fx.HEIRLOOM_LISTS)
GFROM = ["listing", "atlas"]


def coverage(spark, sf):
    return cover(fixture(spark, sf, "listing"), fixture(spark, sf, "atlas"))


def gap_sql(body: str, fixtures: tuple[str, ...] = (), more: str = "") -> str:
    return oracle([*GFROM, *fixtures], body, GAPS + more).replace("WITH ", "WITH RECURSIVE ", 1)


@query("consolidated_listing", gap_sql("SELECT key, name, array_to_string(sources, ',') AS sources, url FROM nm"))
def consolidated_listing(spark, sf):
    return coverage(spark, sf).listed.select("key", "name", F.array_join("sources", ",").alias("sources"), "url")


@query("merge_edges", gap_sql("SELECT p AS a, c AS b FROM ed"))
def merge_edges(spark, sf):
    clean = cut(gp.clean_listing(fixture(spark, sf, "listing")))
    return gp.synonym_edges(gp.consolidate(clean), gp.alias_keys(clean)).select("a", "b")


@query("merged_listing", gap_sql("SELECT key, name, array_to_string(sources, ',') AS sources, url FROM mg"))
def merged_listing(spark, sf):
    return coverage(spark, sf).names.select("key", "name", F.array_join("sources", ",").alias("sources"), "url")


@query("list_coverage", gap_sql("SELECT list, count(*) AS names, count(c) AS covered, round_even(count(c) * 100.0 / count(*), 0)::INT AS percent FROM (SELECT unnest(sources) AS list, cv.key AS c FROM mg LEFT JOIN cv USING (key)) GROUP BY list"))
def list_coverage(spark, sf):
    c = coverage(spark, sf)
    return gp.list_coverage(c.names, c.covered)


@query("missing_names", gap_sql(f"SELECT key, name, array_to_string(sources, ',') AS sources, url, {SCORE} AS score FROM mg WHERE key NOT IN (SELECT key FROM cv)"))
def missing_names(spark, sf):
    c = coverage(spark, sf)
    return gp.missing(c.names, c.covered).withColumn("sources", F.array_join("sources", ",")).drop("met")


FIXTURES["known_id"] = "SELECT DISTINCT lower(replace(p_name, ' ', '-')) AS id FROM {part} WHERE p_size < 3"


@query("coverage_batches", gap_sql(f"""SELECT id, name, score, coalesce((SELECT array_to_string((list_sort(list(DISTINCT aka)))[1:4], ',') FROM am WHERE am.key = q.key), '') AS aka_hint, (row_number() OVER (ORDER BY score DESC, lower(name), id) - 1) // 20 + 1 AS batch FROM (SELECT id, arg_min(key, (-score, lower(name), key)) AS key, arg_min(name, (-score, lower(name), key)) AS name, arg_min(score, (-score, lower(name), key)) AS score FROM (
 SELECT key, name, score, replace({key_sql("translate(name, '()', '  ')")}, ' ', '-') AS id FROM (SELECT *, {SCORE} AS score, {SCORE0} AS s0 FROM mg WHERE key NOT IN (SELECT key FROM cv)) WHERE s0 >= 4 OR (s0 = 3 AND list_contains(sources, 'wikipedia-article'))) WHERE id <> '' GROUP BY id) q WHERE id NOT IN (SELECT id FROM known_id)""", ("known_id",)))
def coverage_batches(spark, sf):
    c = coverage(spark, sf)
    b = gp.coverage_batches(gp.missing(c.names, c.covered), fixture(spark, sf, "known_id"), c.aliases)
    return b.select("id", "name", "score", F.array_join("aka_hint", ",").alias("aka_hint"), "batch")


FIXTURES["theme_entry"] = "SELECT DISTINCT p_name || ' ' || CAST(p_size AS STRING) AS id, p_type AS theme, CAST(length(p_type) AS INT) * 1000 + ascii(p_type) AS theme_no, p_size * 100 + length(p_name) AS ord FROM {part}"


@query("theme_batches", oracle(["theme_entry"], """SELECT id, theme, CAST(floor((row_number() OVER (PARTITION BY theme ORDER BY ord, id) - 1) / ceil(n / ceil(n / 22))) AS INT) + 1 AS batch, listed > 1 AS also_in_others FROM (SELECT *, count(*) OVER (PARTITION BY theme) AS n FROM (
 SELECT id, arg_min(theme, (theme_no, ord)) AS theme, arg_min(ord, (theme_no, ord)) AS ord, count(*) AS listed FROM theme_entry GROUP BY id))"""))
def theme_batches(spark, sf):
    return gp.theme_batches(fixture(spark, sf, "theme_entry"))


FIXTURES["old_heading"] = "SELECT DISTINCT o_custkey % 5 AS book, 'customer 000000' || substr('000' || CAST(o_custkey AS STRING), -3) || ' pippin' AS heading FROM {orders} WHERE o_orderpriority = '2-HIGH'"
COMMON = ", ".join(f"'{w}'" for w in fx.COMMON_NAME_WORDS)


def look_sql(x: str) -> str:
    return f"CASE WHEN {key_sql(x)} <> '' AND len(list_filter(string_split({key_sql(x)}, ' '), lambda w: w NOT IN ({COMMON}))) > 0 THEN {key_sql(x)} END"


HEIR = f""",
hm AS (SELECT *, len(sources) AS ns FROM mg WHERE key NOT IN (SELECT key FROM cv) AND list_has_any(sources, ['toc', 'pomiferous', 'eurisco']) AND NOT regexp_matches(name, '{fx.SPORT_NAME}')),
lk AS (SELECT DISTINCT key, h FROM (SELECT key, {look_sql('name')} AS h FROM hm UNION ALL SELECT a.key, {look_sql('a.aka')} FROM am a JOIN hm USING (key)) WHERE h IS NOT NULL),
hbk AS (SELECT key, count(DISTINCT book) AS books FROM lk JOIN old_heading o ON o.heading = lk.h GROUP BY key)"""


@query("heirloom_tiers", gap_sql("""SELECT h.key, name, coalesce(books, 0) AS books, CASE WHEN ns >= 3 AND books > 0 THEN 'A' WHEN ns >= 3 OR (ns >= 2 AND books > 0) THEN 'B' ELSE 'C' END AS tier, ns + least(2, coalesce(books, 0)) AS strength FROM hm h LEFT JOIN hbk USING (key)""", ("old_heading",), HEIR))
def heirloom_tiers(spark, sf):
    c = coverage(spark, sf)
    h = gp.heirloom_gaps(gp.missing(c.names, c.covered), c.aliases, fixture(spark, sf, "old_heading"))
    return gp.gap_tiers(h).select("key", "name", "books", "tier", "strength")


FIXTURES["collection_row"] = "SELECT list AS collection, CASE WHEN name_id % 13 = 0 THEN '12 / 4.5' WHEN name_id % 7 = 0 THEN ' ' || name || '-NL' ELSE name END AS name, CASE WHEN name_id % 11 = 0 THEN 'rootstock' WHEN name_id % 3 = 0 THEN NULL ELSE 'cultivar' END AS type, CASE WHEN name_id % 5 = 0 THEN 'Malus sylvestris' WHEN name_id % 5 = 1 THEN NULL ELSE 'Malus domestica' END AS species FROM {listed_name}"


@query("collection_names", oracle(["collection_row"], f"""SELECT DISTINCT collection, n AS name FROM (SELECT collection, regexp_replace({decoded_sql('trim(name)')}, '-(NL|IT|ES|CH|BE|FR|PL|DE)$', '') AS n FROM collection_row WHERE coalesce(type, '') <> 'rootstock' AND (species IS NULL OR species = 'Malus domestica')) WHERE n <> '' AND NOT regexp_matches(n, '^[\\d\\s/.-]+$')"""))
def collection_names(spark, sf):
    return gp.collection_names(fixture(spark, sf, "collection_row"))


FIXTURES["category_edge"] = "SELECT DISTINCT 'root' AS parent, r_name AS child, TRUE AS is_category FROM {region} UNION ALL SELECT r_name AS parent, n_name AS child, TRUE AS is_category FROM {nation} JOIN {region} ON n_regionkey = r_regionkey UNION ALL SELECT n_name AS parent, c_name AS child, FALSE AS is_category FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey UNION ALL SELECT r_name AS parent, s_name AS child, FALSE AS is_category FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey UNION ALL SELECT c_name AS parent, 'too deep' AS child, FALSE AS is_category FROM {customer}"


@query("category_members", oracle(["category_edge"], """SELECT child AS member, min(lv) AS level FROM (SELECT child, is_category, 0 AS lv FROM category_edge WHERE parent = 'root' UNION ALL SELECT b.child, b.is_category, 1 FROM category_edge a JOIN category_edge b ON b.parent = a.child WHERE a.parent = 'root' AND a.is_category
 UNION ALL SELECT c.child, c.is_category, 2 FROM category_edge a JOIN category_edge b ON b.parent = a.child AND b.is_category JOIN category_edge c ON c.parent = b.child WHERE a.parent = 'root' AND a.is_category) WHERE NOT is_category GROUP BY child"""))
def category_members(spark, sf):
    return gp.category_closure(fixture(spark, sf, "category_edge"), "root")


PACKS = {"west": ["AUTOMOBILE", "BUILDING"], "east": ["FURNITURE"], "rest": ["MACHINERY"]}


@query("region_batches", """WITH p AS (SELECT CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'west' WHEN 'BUILDING' THEN 'west' WHEN 'FURNITURE' THEN 'east' WHEN 'MACHINERY' THEN 'rest' END AS batch, c_custkey AS place_id FROM customer) SELECT batch, place_id, count(*) OVER (PARTITION BY batch) AS count FROM p WHERE batch IS NOT NULL""")
def region_batches(spark, sf):
    p = fixture(spark, sf, "customer").select(F.col("c_custkey").alias("place_id"), F.col("c_mktsegment").alias("group"))
    return gp.region_batches(p, PACKS)
