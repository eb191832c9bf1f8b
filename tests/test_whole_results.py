"""Nothing is dropped on the way: many picks, short rows, edited reports, names merged before they are counted, balanced numbering."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from graftline.functions.ordered import global_row_number
from graftline.operators import gaps, pollination
from graftline.plans import lineage
from graftline.plans.coverage import coverage
from graftline.sources.tables import read_preamble_csv
from graftline.streaming import tastings


def test_every_pick_is_answered(spark):
    v = spark.range(70).select(F.col("id").alias("variety_id"), F.concat(F.lit("v"), "id").alias("name"), F.array(F.lit("eating")).alias("uses"), F.array((F.col("id") % 5).cast("string")).alias("tags"),
                               *[(F.col("id") % 5).alias(k) for k in pollination.TASTE_KEYS])
    got = pollination.similar_to(v.select("variety_id").where("variety_id < 40"), v).groupBy("pick_id").count().collect()
    assert len(got) == 40 and {r["count"] for r in got} == {6}


def test_short_rows_stay(spark, tmp_path):
    f = tmp_path / "p.csv"
    f.write_text("Title\n,\na,b,c\n1,2,3\n4,5\n7,x,9\n,8,\n")
    got = read_preamble_csv(spark, str(f), "a int, b int, c int", ["Title", ","]).collect()
    assert [tuple(r) for r in got] == [(1, 2, 3, None), (4, 5, None, None), (7, None, 9, "7,x,9"), (None, 8, None, None)]


def test_edits_replace_reports(spark, tmp_path):
    form = "### Variety\n\n{}\n\n### Sweetness\n\n{} - x\n"
    day = lambda n: dt.datetime(2024, 1, n)
    schema = "number long, updated_at timestamp, labels array<string>, title string, body string"
    batches = [[(1, day(1), None, "t", form.format("Gala", 1)), (2, day(1), None, "t", form.format("Gala", 5)), (3, day(2), None, "t", form.format("Gala", 4))],
               [(1, day(9), None, "t", form.format("Fuji", 2)), (2, day(5), ["spam"], "t", form.format("Gala", 5))], [(2, day(3), None, "t", form.format("Gala", 3))]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        tastings.keep_current_reports(stream, str(tmp_path / "store"), str(tmp_path / "cp")).awaitTermination()
    names = spark.createDataFrame([("gala", 10), ("fuji", 11)], "key string, variety_id long")
    got = {r["variety_id"]: (r["n"], r["sweet"]) for r in tastings.stored_summary(spark, str(tmp_path / "store"), names).collect()}
    assert got == {10: (1, 4.0), 11: (1, 2.0)}


def listing(spark, rows):
    return spark.createDataFrame([(src, n, aka, url, i) for i, (src, n, aka, url) in enumerate(rows)], "list string, name string, aka array<string>, url string, ord long")


def test_names_merge_before_they_count(spark):
    rows = [("wikipedia-article", "Karmijn de Sonnaville", [], "w"), ("orangepippin", "Karmijn", [], "o"), ("wikipedia-list", "Paula Red", [], None), ("nfc", "Paulared", [], "p"),
            ("wikipedia-list", "Reinette Verte", ["Green Reinette"], None), ("abc", "Green Reinette", ["Verte Old"], "g"), ("nfc", "Verte Old", [], "z"), ("nfc", "Known", [], None)]
    atlas = spark.createDataFrame([(1, "Known", [])], "variety_id long, name string, aka array<string>")
    c = coverage(listing(spark, rows), atlas)
    got = {r["name"]: (r["sources"], r["url"], r["score"]) for r in gaps.missing(c.names, c.covered).collect()}
    assert got["Karmijn de Sonnaville"][:2] == (["orangepippin", "wikipedia-article"], "w") and "Karmijn" not in got
    assert got["Paula Red"][:2] == (["nfc", "wikipedia-list"], "p") and "Paulared" not in got
    # the first takes the second in before the second's turn, so the third stays by itself
    assert got["Reinette Verte"][:2] == (["abc", "wikipedia-list"], "g") and got["Verte Old"][:2] == (["nfc"], "z")
    alone = gaps.missing(c.listed, c.covered).where("name = 'Paula Red'").first()["score"]
    assert got["Paula Red"][2] > alone


def test_numbering_is_balanced(spark):
    df = spark.range(4000).select(F.lit("common beginning ").alias("a"), F.col("id"), F.hash("id").alias("h"))
    got = global_row_number(df, [F.asc("a"), F.asc("h"), F.asc("id")]).orderBy("row").collect()
    assert [r["row"] for r in got] == list(range(1, 4001)) and [(r["h"], r["id"]) for r in got] == sorted((r["h"], r["id"]) for r in got)
    parts = df.repartitionByRange(8, "a", "h", "id").groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) == 8 and max(r["count"] for r in parts) < 1000


class Cluster:
    """A session whose executors do not share the driver's disk."""

    class conf:  # noqa: N801
        @staticmethod
        def get(name, default=None):
            return default

    class sparkContext:  # noqa: N801
        master, applicationId = "spark://far:7077", "app"


def test_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        lineage.shared_folder(Cluster)


def test_entities_as_the_standard_decodes_them(spark):
    import html
    import random

    from graftline.functions.names import name_key, unescape

    random.seed(1)
    bits = ["R", "&#233;", "&#xE9;", "&szlig;", "&amp", "&ampx", "&notit;", "&", "&;", "&#0;", "&#128;", "&#x110000;", "&#55296;", "&#99999999999999999999;", "&frac12", "&bogus;", " ", "inette", "&lt;", "&#1;", "&#x;", "&#", "&rsquo;"]
    rows = [("".join(random.choices(bits, k=random.randint(0, 8))),) for _ in range(300)] + [(None,)]
    got = spark.createDataFrame(rows, "t string").select("t", unescape("t").alias("u")).collect()
    assert all(r["u"] == (None if r["t"] is None else html.unescape(r["t"])) for r in got)
    assert spark.createDataFrame([("R&#233;inette",)], "t string").select(name_key("t").alias("k")).first()["k"] == "reinette"


def test_picks_meet_by_profile(spark):
    """Varieties of one profile are one row where picks are compared, and no close one of another class is lost."""
    import math
    import random

    rnd = random.Random(5)
    rows = [(i, f"V{rnd.randrange(60)}", rnd.choice([None, ["dessert"], ["cider", "crab"], ["dessert", "cider"]]), rnd.choice([None, ["a"], ["a", "b"], ["b", "a", "c"], ["d"], ["c", "d", "e"]]),
             *[rnd.choice([None, 1, 2, 3, 4, 5]) for _ in range(2)], *[3] * 4) for i in range(300)] + [(300, "alone", ["x"], ["y"], 1, 5, 1, 5, 1, 5)]
    v = spark.createDataFrame(rows, "variety_id long, name string, uses array<string>, tags array<string>, " + ", ".join(f"{k} int" for k in pollination.TASTE_KEYS))
    out = pollination.similar_to(v.select("variety_id").where("variety_id % 3 = 0"), v)
    assert "block" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((r["pick_id"], r["rank"], r["variety_id"]) for r in out.collect())

    def like(p, q):
        d = math.sqrt(sum((float(2.5 if x is None else x) - float(2.5 if y is None else y)) ** 2 for x, y in zip(p[4:], q[4:])))
        a, b = set(p[3] or []), set(q[3] or [])
        return 1.0 / (1.0 + d) * 0.6 + len(a & b) / max(1, len(a | b)) * 0.7 + (0.1 if set(p[2] or []) & set(q[2] or []) else -0.4)

    want = []
    for p in rows[::3]:
        near = sorted((-like(p, q), q[1].lower(), q[0]) for q in rows if q[0] != p[0])[:6]
        want += [(p[0], i + 1, x[2]) for i, x in enumerate(near)]
    assert got == sorted(want)


def test_headings_meet_varieties_as_classes(spark):
    """Lines are ranked before rows for every variety are made, and each variety has its own best six."""
    from graftline.operators import corpus

    heads = [["BLUE PEARMAIN"], ["BLUE PEARMAIN", "BLUE"], ["GOLDEN RUSSET", "BLUE PEARMAIN"], ["GOLDEN RUSSET"], ["NEVER SEEN"]]
    rows = [(v, k) for v in range(60) for k in heads[v % 5]]
    texts = ["Blue Pearmain. Large", "BLUE PEARMAIN", "blue skies", "Golden Russet, small", "GOLDEN RUSSET", "12", "Blue pearmain again"] * 4
    lines = spark.createDataFrame([(b, i + 1, t) for b in range(3) for i, t in enumerate(texts)], "book long, line_no long, text string")
    out = corpus.locate(lines, spark.createDataFrame(rows, "variety_id long, key string"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not any("variety_id" in p for p in plan.splitlines() if "Window [" in p)

    def score(text, key):
        head = [c for c in text[:len(key) + 6] if c.isalpha()]
        after = text[len(key):len(key) + 8] if len(text) > len(key) else "."
        return round(1 + 2.0 * (sum(c.isupper() for c in head) / max(1, len(head)) > 0.8) + 0.5 * (after[0] in ".,:;-") + 0.3 * (" " in key), 2)

    want = []
    for v in range(60):
        hits = []
        for i, t in enumerate(texts):
            u = t.upper().replace(".", "").replace(",", "")
            if found := [(score(t, k), k) for k in heads[v % 5] if u == k or u.startswith(k + " ")]:
                hits.append((-max(found)[0], i + 1, max(found)[1], 12 if i >= 5 else None, t))
        want += [(b, v, n, page, -s, k, t, r + 1) for b in range(3) for r, (s, n, k, page, t) in enumerate(sorted(hits, key=lambda h: h[:2])[:6])]
    assert sorted(tuple(r) for r in out.collect()) == sorted(want, key=lambda r: r[:3])


def test_texts_meet_in_few_chance_keys():
    """Names longer than eight letters meet in what is left of them, not in three letters that most names share."""
    from graftline.operators.closeness import SUBSEQUENCE, meeting_keys

    a, b = ({k for k in meeting_keys(x, 0.88) if k[1] == SUBSEQUENCE} for x in ("large widget 107", "large widget 17"))
    assert a & b and {k[1] for k in meeting_keys("large widget 17", 0.88, 2)} == {SUBSEQUENCE}


def test_quote_words_meet_inside_their_entry(spark, monkeypatch):
    """A misprint finds its word in its own entry alone; words of other entries are never paired with it."""
    from graftline.operators import closeness
    from graftline.operators import corpus as co

    seen = []
    checked = closeness.sequence_ratios
    monkeypatch.setattr(closeness, "sequence_ratios", lambda pairs, ratio: seen.append({tuple(r) for r in pairs.collect()}) or checked(pairs, ratio))
    entries = spark.createDataFrame([(1, 1, 1, 1), (2, 2, 1, 1)], "entry_id long, book long, line int, end int")
    lines = spark.createDataFrame([(1, 1, "aromatic flavour"), (2, 1, "aromatics savour")], "book long, line_no long, text string")
    quotes = spark.createDataFrame([(1, "f", "aromatjc flavoar"), (2, "f", "flavoar savovr")], "entry_id long, field string, quote string")
    got = {(r["entry_id"], r["words"], r["share"], r["ok"]) for r in co.verify_quotes(entries, quotes, lines).collect()}
    assert got == {(1, 2, 1.0, True), (2, 2, 0.5, False)}
    assert seen == [{("aromatjc", "aromatic"), ("flavoar", "flavour"), ("savovr", "savour")}], seen


def test_rootstock_columns_are_ordered_together(spark, monkeypatch):
    """All columns of one direction are ordered in one pass, and stand as each would alone."""
    from checks.base import fixture
    from graftline.functions import ordered
    from graftline.operators import rootstocks as rs

    written, cut = [], ordered.cut
    monkeypatch.setattr(ordered, "cut", lambda df: written.append(df) or cut(df))
    import __spark_entry__ as entry

    got = {tuple(r) for r in entry.queries()["rootstock_table"](spark, "/root/testdata/sf0.001").collect()}
    assert len(written) == 2
    df = fixture(spark, "/root/testdata/sf0.001", "rootstock")
    for k, d in (("size", False), ("height", True), ("name", True)):
        label = f"{k} {'desc' if d else 'asc'}"
        assert {(r["rootstock_id"], r["position"]) for r in rs.rootstock_table(df, k, d).collect()} == {g[1:] for g in got if g[0] == label}


def test_points_of_one_position_are_searched_once(spark, monkeypatch):
    """Many points and places at few positions: the circle is searched per position, and every point gets its k places."""
    from graftline.operators import spatial as sp

    searched, within = [], sp.within_km
    monkeypatch.setattr(sp, "within_km", lambda p, q, r: searched.append((p.count(), q.count())) or within(p, q, r))
    points = spark.range(300).selectExpr("id AS point_id", "CAST(id % 3 AS DOUBLE) AS lat", "10D AS lon")
    places = spark.range(200).selectExpr("id AS place_id", "CAST(id % 2 AS DOUBLE) + 0.5D AS lat", "10D AS lon")
    got = {(r["point_id"], r["place_id"], r["rank"]) for r in sp.knn_places(points, places, 4).collect()}
    nearest = {0: [0, 2, 4, 6], 1: [0, 1, 2, 3], 2: [1, 3, 5, 7]}
    assert {(p, q) for p, q, _ in got} == {(p, q) for p in range(300) for q in nearest[p % 3]} and len(got) == 1200
    assert searched[0] == (3, 8), searched


def test_disease_issues_are_ranked_by_counting(spark):
    """The worst three issues, ties by the order of diseases; nothing is sorted or put into words per pair."""
    from checks import scores
    from graftline import fixed_values as fx
    from graftline.operators import scoring as sc

    scored = scores.scored(spark, "/root/testdata/sf0.001")
    plan = sc.disease_rows(scored)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_sort" not in plan and "fire_blight_status" not in plan.split("Join")[0]
    over = {"p_scab": 0.5, "p_canker": 0.5, "p_mildew": 0.2, "p_fire_blight": 0.9, "p_rust": 0.5, "loss_scab": 0.3, "loss_canker": 0.3, "loss_mildew": 0.9, "loss_fire_blight": 0.1, "loss_rust": 0.6}
    from pyspark.sql import functions as F

    one = scored.where("NOT no_bloom").limit(1).withColumns({k: F.lit(x) for k, x in over.items()} | {d: F.lit(None).cast("int") if d == "rust" else F.lit(4) for d in fx.DISEASES})
    got = {r["disease"]: (r["issue"], r["issue_rank"], r["tone"], r["assumed"], r["susceptibility"]) for r in sc.disease_rows(one).collect()}
    assert got == {"scab": (True, 2, "warn", False, 4), "canker": (True, 3, "warn", False, 4), "mildew": (False, None, "bad", False, 4), "fire_blight": (True, None, "ok", False, 4), "rust": (True, 1, "bad", True, 3)}


def test_report_batches_cost_what_they_bring(spark, tmp_path):
    """A batch keeps no state of earlier reports; the latest version wins, however late an older one comes."""
    from graftline.streaming import tastings as st

    schema = "number long, body string, updated_at timestamp"
    batches = [[(1, "a", "2000-01-03"), (2, "b", "2000-01-01")], [(1, "old", "2000-01-02"), (3, "c", "2000-01-01")], [(2, "new", "2000-02-01"), (2, "mid", "2000-01-15")], [(3, None, "2000-01-05")]]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, "number long, body string, t string").selectExpr("number", "body", "CAST(t AS timestamp) AS updated_at").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = st.keep_current_reports(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "store"), str(tmp_path / "cp"))
        q.awaitTermination()
        assert not q.lastProgress["stateOperators"] and spark.read.parquet(str(tmp_path / "store" / f"batch={n}")).count() == len({r[0] for r in rows})
    assert {(r["number"], r["body"]) for r in st.stored_reports(spark, str(tmp_path / "store")).collect()} == {(1, "a"), (2, "new"), (3, None)}


def test_panel_records_name_every_accession(spark):
    """A record tells when each accession was picked and tasted, and what each of several had."""
    from graftline.operators import lab

    scores = ", ".join(f"{c} double" for c in lab.PANEL_SCORES)
    rows = [(1, 5, "Gala  (Kent)", "G1", "loose", "synonym", "2001-09-01", 2002, "mid", 2.0), (1, 9, "Gala", "", "firm", "exact", None, 2003, "mid", None), (1, 3, "Gala x", "G2", "loose", "exact", "2000-09-01", 2001, "late", 9.0),
            (2, 7, "Fuji", "G1", "firm", "synonym", "1999-10-01", None, "", 4.0)]
    df = spark.createDataFrame([(v, i, name, munq, tier, kind, h, t, pick, None, i != 3, *[score] * 8) for v, i, name, munq, tier, kind, h, t, pick, score in rows],
                               f"variety_id int, accession_id long, name string, munq string, tier string, kind string, harvest string, tasted int, pick string, keeps_to string, kept boolean, {scores}")
    got = {r["variety_id"]: r for r in lab.panel_records(df).collect()}
    one, two = got[1], got[2]
    assert (one["accession"], one["accessions"], one["harvest"], one["tasted"]) == ("Gala; Gala (Kent)", [9, 5], [None, "2001-09-01"], [2003, 2002])
    assert (one["each_name"], one["each_munq"], one["each_sweet"], one["each_quality"]) == (["Gala", "Gala (Kent)"], [None, "G1"], [None, 2.0], [None, 2.0])
    assert (one["n"], one["sweet"], one["match"], one["pick"]) == (2, 2.0, "exact", "mid")
    assert (two["accession"], two["accessions"], two["harvest"], two["tasted"], two["each_name"], two["each_sweet"], two["n"]) == ("Fuji", [7], ["1999-10-01"], [None], None, None, 1)
