"""Flavour evidence: sources -> voices -> support per tag -> which tags stand.

Everything is counted on distinct (variety, tag, voice) rows with plain aggregates, so neither a variety nor a source with a
third of all rows is ever gathered in one place."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graftline import fixed_values as fx
from graftline.functions.codes import book_voice, evidence_level, implied_tags, mapped, modern_label, modern_voice, panel_tags
from graftline.functions.ordered import global_row_number

NO_TAGS = "array<string>"


def _tags(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast(NO_TAGS))


def book_evidence(entries: DataFrame, books: DataFrame) -> DataFrame:
    """Book entries (book, variety_id, tags, against, sweet, acid) as evidence, in year order."""
    j = entries.join(books.select("book", "author", "year"), "book")
    return j.select("variety_id", F.lit("book").alias("kind"), F.col("year").cast("bigint").alias("ord"), book_voice("book").alias("voice"),
                    F.concat(F.col("author"), F.lit(" ("), F.col("year").cast("string"), F.lit(")")).alias("label"),
                    _tags("tags").alias("tags"), implied_tags("sweet", "acid", "tags").alias("implied"), _tags("against").alias("against"), "sweet", "acid")


def web_evidence(sources: DataFrame) -> DataFrame:
    """Web sources (variety_id, ord, src, url, tags, against, sweet, acid) as evidence."""
    return sources.select("variety_id", F.lit("web").alias("kind"), F.col("ord").cast("bigint").alias("ord"), modern_voice("src", "url").alias("voice"), modern_label("src", "url").alias("label"),
                          _tags("tags").alias("tags"), implied_tags("sweet", "acid", "tags").alias("implied"), _tags("against").alias("against"), "sweet", "acid")


def panel_evidence(panel: DataFrame) -> DataFrame:
    """Panel records (variety_id, sweet, acid, aroma on 1-9 scales) as evidence; the same voice as the organisation's pages."""
    return panel.select("variety_id", F.lit("panel").alias("kind"), F.lit(0).cast("bigint").alias("ord"), F.lit(fx.PANEL_VOICE).alias("voice"), F.lit("panel tasting").alias("label"),
                        panel_tags("sweet", "acid", "aroma").alias("tags"), F.array().cast(NO_TAGS).alias("implied"), F.array().cast(NO_TAGS).alias("against"),
                        F.lit(None).cast("int").alias("sweet"), F.lit(None).cast("int").alias("acid"))


def evidence_union(books: DataFrame, web: DataFrame, panel: DataFrame, varieties: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(evidence of known varieties, evidence rows whose variety is unknown)."""
    rows = books.unionByName(web).unionByName(panel)
    ids = varieties.select("variety_id")
    return rows.join(ids, "variety_id", "left_semi"), rows.join(ids, "variety_id", "left_anti")


def _kind_rank() -> Column:
    return F.when(F.col("kind") == "book", 0).when(F.col("kind") == "web", 1).otherwise(2)


def tag_voices(evidence: DataFrame) -> DataFrame:
    """(variety_id, tag, voice, says, denies, seen): whether a voice uses a tag, whether it denies it, and where first."""
    said = evidence.select("variety_id", "voice", _kind_rank().alias("k"), "ord", F.posexplode(F.concat("tags", "implied")).alias("pos", "tag")).withColumn("side", F.lit(1))
    denied = evidence.select("variety_id", "voice", _kind_rank().alias("k"), "ord", F.posexplode("against").alias("pos", "tag")).withColumn("side", F.lit(0))
    return said.unionByName(denied).groupBy("variety_id", "tag", "voice").agg(
        F.max("side").alias("says"), F.max(1 - F.col("side")).alias("denies"), F.min(F.when(F.col("side") == 1, F.struct("k", "ord", "pos"))).alias("seen"))


def tag_support(voices: DataFrame) -> DataFrame:
    """(variety_id, tag, support, against, against_only): independent voices for and against; `against_only` leaves out voices
    that also use the tag."""
    return voices.groupBy("variety_id", "tag").agg(F.sum("says").alias("support"), F.sum("denies").alias("against"),
                                                   F.sum(F.col("denies") * (1 - F.col("says"))).alias("against_only"), F.min("seen").alias("seen"))


def source_counts(evidence: DataFrame) -> DataFrame:
    """Voices per variety: all, on the web, in writing (not only a panel), in books."""
    v = evidence.groupBy("variety_id", "voice").agg(*[F.max((F.col("kind") == k).cast("int")).alias(k) for k in ("web", "book")], F.max((F.col("kind") != "panel").cast("int")).alias("written"))
    return v.groupBy("variety_id").agg(F.count("*").alias("voices"), F.sum("web").alias("web"), F.sum("written").alias("written"), F.sum("book").alias("books"))


def recorded_tags(varieties: DataFrame) -> DataFrame:
    return varieties.select("variety_id", F.posexplode("tags").alias("pos", "tag"))


def decide_tags(recorded: DataFrame, support: DataFrame, counts: DataFrame) -> DataFrame:
    """What becomes of each recorded tag: kept, unverified or contested."""
    j = recorded.join(support, ["variety_id", "tag"], "left").join(counts, "variety_id", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))                                # noqa: E731
    n, c = z("support"), z("against_only")
    contested = (c > n) & ((c >= 2) | ((z("web") > 0) & (z("written") >= 2)))
    kept = (n > 0) | (z("written") < 2) | (z("web") == 0)
    return j.select("variety_id", "tag", "pos", n.alias("support"), c.alias("against"), F.when(contested, "contested").when(kept, "kept").otherwise("unverified").alias("decision"))


def added_tags(recorded: DataFrame, support: DataFrame) -> DataFrame:
    """Tags not recorded that two or more voices use and fewer deny."""
    return support.where("support >= 2 AND against < support").join(recorded.select("variety_id", "tag"), ["variety_id", "tag"], "left_anti").select("variety_id", "tag", "support", "seen")


def final_tags(decisions: DataFrame, added: DataFrame, limit: int = fx.MAX_TAGS) -> DataFrame:
    """The tags shown: most supported first, recorded ones in their order before added ones; at most eight."""
    a = decisions.where("decision = 'kept'").select("variety_id", "tag", "support", F.col("pos").alias("place"), F.lit(None).cast("struct<k:int,ord:bigint,pos:int>").alias("seen"))
    b = added.select("variety_id", "tag", "support", F.lit(99).alias("place"), "seen")
    w = Window.partitionBy("variety_id").orderBy(F.desc("support"), "place", "seen", "tag")
    return (a.unionByName(b).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
            .select("variety_id", "rank", "tag", "support", evidence_level("support").alias("level")))


def merge_voices(evidence: DataFrame) -> DataFrame:
    """One row per (variety, voice) with the tags it uses, each once, in the order met (at most the vocabulary)."""
    t = (evidence.select("variety_id", "voice", _kind_rank().alias("k"), "ord", F.posexplode("tags").alias("pos", "tag"))
         .groupBy("variety_id", "voice", "tag").agg(F.min(F.struct("k", "ord", "pos")).alias("o")))
    tags = t.groupBy("variety_id", "voice").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "tag"))), lambda s: s["tag"]).alias("tags"))
    who = evidence.groupBy("variety_id", "voice").agg(F.min_by(F.struct("kind", "label"), F.struct(_kind_rank().alias("k"), "ord")).alias("first"))
    return who.join(tags, ["variety_id", "voice"], "left").select("variety_id", "voice", "first.kind", "first.label", F.coalesce("tags", F.array().cast(NO_TAGS)).alias("tags"))


def attach_context(varieties: DataFrame, context: DataFrame, panel: DataFrame, measured: DataFrame, visitors: DataFrame) -> DataFrame:
    """Add storage change, peak, climate need, the panel's scores and first tasting, measurements, and the visitors' record once there
    are three reports; each part is a struct, null where there is none."""
    needs = F.when(F.coalesce("needs", "note").isNotNull(), F.struct("needs", F.coalesce("note", F.lit("")).alias("note")))
    c = context.select("variety_id", F.nullif("storage_change", F.lit("")).alias("storage_change"), F.nullif("peak", F.lit("")).alias("peak"), needs.alias("climate_flavour"))
    shown = visitors.where(F.col("n") >= fx.MIN_TASTINGS).select("variety_id", F.struct(*[k for k in visitors.columns if k != "variety_id"]).alias("visitors"))
    scores = panel.select("variety_id", F.struct("sweet", "acid", "balance", "aroma", "juice", "quality", F.try_element_at("assessed", F.lit(1))["tasted"].alias("tasted")).alias("panel"))
    lab = measured.select("variety_id", F.struct("ssc", "ta", "pct_ssc", "pct_ta", "n").alias("measured"))
    return varieties.join(c, "variety_id", "left").join(scores, "variety_id", "left").join(lab, "variety_id", "left").join(shown, "variety_id", "left")


def evidence_stats(varieties: DataFrame, counts: DataFrame, decisions: DataFrame, added: DataFrame, measured: DataFrame) -> DataFrame:
    """Totals of the merge as rows (stat, n)."""
    parts = [
        counts.agg(F.lit("with sources").alias("stat"), F.count("*").alias("n")),
        counts.agg(F.lit("with book entries").alias("stat"), F.count(F.when(F.col("books") > 0, 1)).alias("n")),
        decisions.agg(F.lit("unverified tags").alias("stat"), F.count(F.when(F.col("decision") == "unverified", 1)).alias("n")),
        decisions.agg(F.lit("contested tags").alias("stat"), F.count(F.when(F.col("decision") == "contested", 1)).alias("n")),
        added.agg(F.lit("added tags").alias("stat"), F.count("*").alias("n")),
        varieties.agg(F.lit("varieties").alias("stat"), F.count("*").alias("n")),
        varieties.join(measured.select("variety_id"), "variety_id", "left_semi").agg(F.lit("with measurements").alias("stat"), F.countDistinct("variety_id").alias("n")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def order_books(entries: DataFrame, books: DataFrame) -> DataFrame:
    """Book entries by variety and year (a range sort, so long lists are split over tasks)."""
    return entries.join(books.select("book", "year", "author"), "book").orderBy("variety_id", "year", "book")


# ---- audit ------------------------------------------------------------------------------
def audit_levels(final: DataFrame) -> DataFrame:
    """How many shown tags stand at each level."""
    return final.groupBy("level").agg(F.count("*").alias("tags"))


def single_source_tags(final: DataFrame) -> DataFrame:
    return final.where("support = 1").groupBy("tag").agg(F.count("*").alias("varieties"))


def source_histogram(varieties: DataFrame, counts: DataFrame) -> DataFrame:
    """Varieties with 0, 1, 2, 3 and 4 or more voices."""
    j = varieties.select("variety_id").join(counts, "variety_id", "left")
    return j.groupBy(F.least(F.coalesce("voices", F.lit(0)), F.lit(4)).alias("voices")).agg(F.count("*").alias("varieties"))


def audit_changes(decisions: DataFrame, added: DataFrame, voices: DataFrame) -> DataFrame:
    """Every change of a variety's tags: (variety_id, change, tag, voice); contested tags with each voice against them."""
    contested = decisions.where("decision = 'contested'").select("variety_id", "tag").join(voices.where("denies = 1").select("variety_id", "tag", "voice"), ["variety_id", "tag"])
    dropped = decisions.where("decision = 'unverified'").select("variety_id", F.lit("dropped").alias("change"), "tag", F.lit(None).cast("string").alias("voice"))
    return (dropped.unionByName(contested.select("variety_id", F.lit("contested").alias("change"), "tag", "voice"))
            .unionByName(added.select("variety_id", F.lit("added").alias("change"), "tag", F.lit(None).cast("string").alias("voice"))))


def upper_median_rating(rating: Column) -> Column:
    """Upper median of 1-5 ratings as an aggregate: the rating at which the running count passes half (five counters, no list)."""
    n = F.count(rating)
    running, out = F.lit(0), F.when(F.lit(False), F.lit(0))
    for r in range(1, 6):
        running = running + F.count(F.when(rating == r, 1))
        out = out.when(running > F.floor(n / 2), F.lit(r))
    return F.when(n > 0, out)


def audit_disagreements(varieties: DataFrame, measured: DataFrame, panel: DataFrame, evidence: DataFrame) -> DataFrame:
    """Ratings that disagree with the laboratory (40 percentile points), the panel (two steps) or the old books (two steps)."""
    parts = []
    for scale, pct in (("sweet", "pct_ssc"), ("acid", "pct_ta")):
        v = varieties.select("variety_id", F.lit(scale).alias("scale"), F.col(scale).alias("ours"))
        lab = v.join(measured.select("variety_id", F.col(pct).alias("theirs")), "variety_id").where(F.abs(mapped("ours", fx.RATING_CENTRE) - F.col("theirs")) >= 40)
        tasted = v.join(panel.select("variety_id", F.col(scale).cast("double").alias("theirs")), "variety_id").where((F.col("ours") > 0) & (F.col("theirs") != 0) & (F.abs((F.col("theirs") + 1) / 2 - F.col("ours")) >= 2))
        said = evidence.where((F.col("kind") == "book") & (F.col(scale) > 0)).groupBy("variety_id").agg(upper_median_rating(F.col(scale)).cast("double").alias("theirs"))
        book = v.join(said, "variety_id").where((F.col("ours") > 0) & (F.abs(F.col("theirs") - F.col("ours")) >= 2))
        parts += [p.withColumn("against", F.lit(name)) for p, name in ((lab, "laboratory"), (tasted, "panel"), (book, "books"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def audit_unsourced(varieties: DataFrame, counts: DataFrame) -> DataFrame:
    return varieties.select("variety_id", "name").join(counts.select("variety_id"), "variety_id", "left_anti")


def audit_notes(varieties: DataFrame, notes: DataFrame) -> DataFrame:
    """Researchers' notes as table rows in the order of the names: (row, variety_id, name, note); bars and line ends would break the table.

    `notes`: variety_id, note."""
    told = notes.where("note IS NOT NULL AND note <> ''").join(varieties.select("variety_id", "name"), "variety_id")
    flat = F.translate(F.replace("note", F.lit("|"), F.lit("/")), "\n", " ")
    return global_row_number(told.select("variety_id", "name", flat.alias("note")), [F.asc("name"), F.asc("variety_id")])


def flavour_stats(final: DataFrame, decisions: DataFrame, added: DataFrame, entries: DataFrame) -> DataFrame:
    """(part, name, level, n): varieties per shown tag and level, entries per book, tags dropped and added."""
    none = F.lit(None).cast("string").alias("level")
    tags = final.groupBy(F.lit("tag").alias("part"), F.col("tag").alias("name"), "level").agg(F.count("*").alias("n"))
    books = entries.groupBy("book").agg(F.count("*").alias("n")).select(F.lit("book").alias("part"), F.col("book").alias("name"), none, "n")
    dropped = decisions.agg(F.count(F.when(F.col("decision") != "kept", 1)).alias("n")).select(F.lit("tags").alias("part"), F.lit("dropped").alias("name"), none, "n")
    more = added.agg(F.count("*").alias("n")).select(F.lit("tags").alias("part"), F.lit("added").alias("name"), none, "n")
    return tags.unionByName(books).unionByName(dropped).unionByName(more)
