"""Coverage: which listed names the atlas lacks, how strongly they are listed, and how to batch the work."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graftline import fixed_values as fx
from graftline.functions.codes import mapped
from graftline.functions.names import clean_title, loose_key, name_key, unescape
from graftline.functions.ordered import global_row_number
from graftline.operators.corpus import searchable
from graftline.operators.matching import all_names
from graftline.plans.lineage import cut


def clean_listing(listing: DataFrame) -> DataFrame:
    """Listed names cleaned, with their key; rows that are no cultivar names, or codes, are dropped.

    `listing`: list, name, aka, url, ord (order within the list)."""
    name = clean_title(F.regexp_replace("name", fx.LISTING_QUALIFIER, ""))
    return (listing.withColumn("name", name).where((F.col("name") != "") & ~F.col("name").rlike(fx.NOT_CULTIVAR) & ~F.col("name").rlike(fx.CODE_LIKE_NAME))
            .withColumn("key", loose_key("name")))


def _list_rank(c: str = "list") -> Column:
    return mapped(c, {k: i for i, k in enumerate(fx.LIST_WEIGHTS)})


def consolidate(clean: DataFrame) -> DataFrame:
    """One row per key: the first name and link met, the lists that have it (at most the ten lists), and where it was met first."""
    order = F.struct(_list_rank().alias("l"), F.col("ord"), F.col("key").alias("k"))
    return clean.groupBy("key").agg(F.min(order).alias("met"), F.min_by("name", order).alias("name"), F.array_sort(F.collect_set("list")).alias("sources"),
                                    F.min_by("url", F.when(F.col("url").isNotNull(), order)).alias("url"))


def alias_keys(clean: DataFrame) -> DataFrame:
    """(key, aka, aka_key): other names of a key, each once."""
    return clean.select("key", F.explode("aka").alias("aka")).where("aka IS NOT NULL AND aka <> ''").distinct().withColumn("aka_key", loose_key("aka"))


def atlas_keys(varieties: DataFrame) -> DataFrame:
    """Every key the atlas knows, strict and loose."""
    n = all_names(varieties)
    return n.select(name_key("name").alias("key")).unionByName(n.select(loose_key("name").alias("key"))).where("key <> ''").distinct()


def synonym_edges(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """(a, b, a_met, b_met): another name of listed name a is itself the listed name b."""
    here = names.select("key", "met")
    return (aliases.select(F.col("key").alias("a"), F.col("aka_key").alias("b")).where("a <> b").distinct()
            .join(here.select(F.col("key").alias("b"), F.col("met").alias("b_met")), "b").join(here.select(F.col("key").alias("a"), F.col("met").alias("a_met")), "a"))


def absorbers(edges: DataFrame) -> DataFrame:
    """(key, into, met): the name that takes a synonym in, names taking their turn in the order they were first met.

    A name that has been taken in before its turn takes nothing.  Whether it has depends only on names met before it, so a round decides
    every name whose earlier takers are all decided; the rounds are as many as the longest chain of such names."""
    edges = cut(edges)
    earlier = edges.where("a_met < b_met").select("a", "b")
    state = cut(edges.select(F.col("a").alias("key")).distinct().join(earlier.select(F.col("b").alias("key")).distinct().withColumn("w", F.lit(1)), "key", "left").select("key", F.when(F.col("w").isNull(), "takes").alias("turn")))
    while not state.where("turn IS NULL").isEmpty():
        before = earlier.join(state.select(F.col("key").alias("a"), "turn"), "a").groupBy(F.col("b").alias("key")).agg(F.max(F.col("turn") == "takes").alias("taken"), F.count(F.when(F.col("turn").isNull(), 1)).alias("open"))
        now = F.coalesce("turn", F.when(F.col("taken"), "gone").when(F.col("open") == 0, "takes"))
        state = cut(state.join(before, "key", "left").select("key", now.alias("turn")))
    takes = state.where("turn = 'takes'").select(F.col("key").alias("a"))
    return edges.join(takes, "a").groupBy(F.col("b").alias("key"), F.col("b_met").alias("met")).agg(F.min_by("a", "a_met").alias("into")).select("key", "into", "met")


def merge_synonyms(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """Names whose synonym is listed too take it in: lists are united, the taker keeps its name and the first link on the way."""
    into = cut(absorbers(synonym_edges(names, aliases)))
    step = into.select(F.col("key").alias("root"), F.col("into").alias("higher"), F.col("met").alias("root_met"))
    way = cut(into.select("key", F.col("into").alias("root"), F.array("met").alias("way")))
    while True:
        up = way.join(step, "root")
        if up.isEmpty():
            break
        way = cut(way.join(step, "root", "left").select("key", F.coalesce("higher", "root").alias("root"), F.when(F.col("higher").isNull(), F.col("way")).otherwise(F.concat(F.array("root_met"), "way")).alias("way")))
    j = names.join(way, "key", "left").withColumns({"root": F.coalesce("root", "key"), "way": F.coalesce("way", F.array().cast("array<struct<l:int,ord:bigint,k:string>>"))})
    return _united(j.select("root", "key", "name", "met", "url", "sources", F.col("way").alias("turn")))


def _united(rows: DataFrame) -> DataFrame:
    """One row per root: its own name and place, all lists, the first link by turn."""
    own = F.col("key") == F.col("root")
    each = rows.select("*", F.explode("sources").alias("source"))
    return each.groupBy(F.col("root").alias("key")).agg(F.max(F.when(own, F.col("name"))).alias("name"), F.max(F.when(own, F.col("met"))).alias("met"), F.array_sort(F.collect_set("source")).alias("sources"),
                                                        F.min_by("url", F.when(F.col("url").isNotNull(), F.col("turn"))).alias("url"))


def merge_spaced(names: DataFrame) -> DataFrame:
    """Names that differ only by spaces become the one met first."""
    packed = names.withColumn("p", F.replace("key", F.lit(" "), F.lit("")))
    first = packed.groupBy("p").agg(F.min_by("key", "met").alias("root"))
    return _united(packed.join(first, "p").select("root", "key", "name", "met", "url", "sources", F.col("met").alias("turn")))


def short_forms(names: DataFrame, have: DataFrame) -> DataFrame:
    """(key, root): a one-word name of five letters or more that opens exactly one longer name and that the atlas lacks."""
    longer = names.where(F.contains("key", F.lit(" "))).groupBy(F.substring_index("key", " ", 1).alias("key")).agg(F.min("key").alias("root"), F.count("*").alias("n")).where("n = 1 AND length(key) >= 5").select("key", "root")
    short = names.select("key", "name").join(longer, "key")
    ours = short.select("key", F.explode(F.array("key", name_key("name"))).alias("form")).join(have.withColumnRenamed("key", "form"), "form", "left_semi").select("key").distinct()
    return short.join(ours, "key", "left_anti").select("key", "root")


def merge_candidates(names: DataFrame, aliases: DataFrame, have: DataFrame) -> DataFrame:
    """Merge listed names that are the same apple, by three rules in this order: synonyms, spaces, short forms.

    Each rule sees what the one before left.  A short form adds its lists to the longer name, which keeps its own link."""
    two = cut(merge_spaced(cut(merge_synonyms(names, aliases))))
    short = cut(short_forms(two, have))
    j = two.join(short, "key", "left")
    return _united(j.select(F.coalesce("root", "key").alias("root"), "key", "name", "met", F.when(F.col("root").isNull(), F.col("url")).alias("url"), "sources", F.col("met").alias("turn")))


def covered_keys(names: DataFrame, aliases: DataFrame, have: DataFrame) -> DataFrame:
    """Keys of listed names that the atlas has, by the name (strict or loose) or by one of its other names."""
    forms = (names.select("key", F.col("key").alias("form")).unionByName(names.select("key", name_key("name").alias("form")))
             .unionByName(aliases.select("key", F.col("aka_key").alias("form"))).unionByName(aliases.select("key", name_key("aka").alias("form"))))
    return forms.join(have.withColumnRenamed("key", "form"), "form", "left_semi").select("key").distinct()


def list_coverage(names: DataFrame, covered: DataFrame) -> DataFrame:
    """Per list: names, covered names and percent."""
    j = names.join(covered.withColumn("c", F.lit(1)), "key", "left").select(F.explode("sources").alias("list"), "c")
    return j.groupBy("list").agg(F.count("*").alias("names"), F.count("c").alias("covered")).withColumn("percent", F.bround(F.col("covered") * 100.0 / F.col("names"), 0).cast("int"))


def list_score(sources: Column | str, lists: list[str] | None = None) -> Column:
    """Weighted number of lists."""
    s = F.col(sources) if isinstance(sources, str) else sources
    return reduce(lambda a, b: a + b, [F.when(F.array_contains(s, k), w).otherwise(0) for k, w in fx.LIST_WEIGHTS.items() if lists is None or k in lists])


def missing(names: DataFrame, covered: DataFrame) -> DataFrame:
    """Listed names the atlas lacks, with their score."""
    return names.join(covered, "key", "left_anti").withColumn("score", list_score("sources"))


def coverage_batches(gaps: DataFrame, known_ids: DataFrame, aliases: DataFrame, skip: list[str] = (), rename: dict[str, str] | None = None, size: int = 20) -> DataFrame:
    """Work batches of the strongest gaps: score 4 or more on the first lists, or 3 with an article of its own; the first four
    other names of a gap come along as a hint.

    Batches are cut in score and name order over the whole table."""
    score0 = list_score("sources", [k for k in fx.LIST_WEIGHTS if k not in fx.HEIRLOOM_LISTS])
    g = gaps.withColumn("score0", score0).where((F.col("score0") >= 4) | ((F.col("score0") == 3) & F.array_contains("sources", "wikipedia-article")))
    if skip:
        g = g.where(~F.col("name").isin(*skip))
    named = F.coalesce(mapped("name", rename), F.col("name")) if rename else F.col("name")
    g = g.withColumns({"name": named}).withColumn("id", F.regexp_replace(name_key(F.translate("name", "()", "  ")), " ", "-")).where("id <> ''")
    order = [F.desc("score"), F.asc(F.lower("name")), F.asc("id")]
    g = g.groupBy("id").agg(F.min_by(F.struct("key", "name", "score", "sources", "url"), F.struct((-F.col("score")).alias("s"), F.lower("name").alias("n"), F.col("key").alias("k"))).alias("r")).select("id", "r.*")
    g = g.join(known_ids.select("id"), "id", "left_anti")
    hints = aliases.join(g.select("key").distinct(), "key").groupBy("key").agg(F.slice(F.array_sort(F.collect_set("aka")), 1, 4).alias("aka_hint"))
    g = global_row_number(g.join(hints, "key", "left").withColumn("aka_hint", F.coalesce("aka_hint", F.array().cast("array<string>"))), order)
    return g.withColumn("batch", (F.floor((F.col("row") - 1) / size) + 1).cast("int")).drop("row")


def theme_batches(entries: DataFrame, most: int = 22) -> DataFrame:
    """Batches of equal size within a theme, at most 22; an entry named in several themes belongs to the first (theme order, ord).

    `entries`: id, theme, theme_no, ord."""
    first = F.struct("theme_no", "ord")
    e = entries.groupBy("id").agg(F.min_by(F.struct("theme", "theme_no", "ord"), first).alias("r"), F.count("*").alias("listed_in")).select("id", "r.*", "listed_in")
    e = global_row_number(e, [F.asc("theme_no"), F.asc("ord"), F.asc("id")])
    sizes = e.groupBy("theme").agg(F.count("*").alias("n"), F.min("row").alias("row0"))
    per = F.ceil(F.col("n") / F.ceil(F.col("n") / most))
    return (e.join(sizes, "theme").withColumn("batch", (F.floor((F.col("row") - F.col("row0")) / per) + 1).cast("int"))
            .select("id", "theme", "batch", (F.col("listed_in") > 1).alias("also_in_others")))


def heirloom_gaps(gaps: DataFrame, aliases: DataFrame, headings: DataFrame) -> DataFrame:
    """Missing names on the heirloom lists (sports and strains left out) with the number of old books that head an entry so."""
    h = gaps.where(F.arrays_overlap("sources", F.array(*[F.lit(x) for x in fx.HEIRLOOM_LISTS])) & ~F.col("name").rlike(fx.SPORT_NAME))
    looks = h.select("key", searchable("name").alias("heading")).unionByName(h.select("key").join(aliases, "key").select("key", searchable("aka").alias("heading"))).where("heading IS NOT NULL").distinct()
    books = looks.join(headings, "heading").groupBy("key").agg(F.countDistinct("book").alias("books"))
    return h.join(books, "key", "left").withColumn("books", F.coalesce("books", F.lit(0)))


def gap_tiers(heirlooms: DataFrame) -> DataFrame:
    """Tier A: three lists and an old book; B: three lists, or two and a book; C the rest.  `strength` orders them."""
    n = F.size("sources")
    tier = F.when((n >= 3) & (F.col("books") > 0), "A").when((n >= 3) | ((n >= 2) & (F.col("books") > 0)), "B").otherwise("C")
    return heirlooms.withColumns({"tier": tier, "strength": n + F.least(F.lit(2), F.col("books"))})


def collection_names(rows: DataFrame) -> DataFrame:
    """Distinct cultivar names of research collections: no rootstocks, other species, numbered accessions or country suffixes.

    `rows`: collection, name, type, species."""
    ok = ((F.coalesce("type", F.lit("")) != "rootstock") & (F.col("species").isNull() | F.col("species").isin("Malus domestica", "domestica")))
    name = F.regexp_replace(unescape(F.trim("name")), r"-(NL|IT|ES|CH|BE|FR|PL|DE)$", "")
    return rows.where(ok).select("collection", name.alias("name")).where((F.col("name") != "") & ~F.col("name").rlike(r"^[\d\s/.-]+$")).distinct()


def category_closure(edges: DataFrame, root, depth: int = 2) -> DataFrame:
    """Members reachable from a category in at most `depth` sub-category steps: (member, level of its nearest category).

    `edges`: parent, child, is_category.  The number of joins is the depth."""
    level = edges.where(F.col("parent") == F.lit(root))
    found = [level.withColumn("level", F.lit(0))]
    for d in range(1, depth + 1):
        cats = level.where("is_category").select(F.col("child").alias("parent")).distinct()
        level = edges.join(cats, "parent")
        found.append(level.withColumn("level", F.lit(d)))
    return reduce(lambda a, b: a.unionByName(b), found).where("NOT is_category").groupBy(F.col("child").alias("member")).agg(F.min("level").alias("level"))


def region_batches(places: DataFrame, packs: dict[str, list[str]]) -> DataFrame:
    """Places packed into named batches by group, with the size of each batch; (batch, place_id, count)."""
    batch = mapped("group", {g: b for b, gs in packs.items() for g in gs})
    p = places.withColumn("batch", batch).where("batch IS NOT NULL").select("batch", "place_id")
    return p.join(p.groupBy("batch").agg(F.count("*").alias("count")), "batch")

