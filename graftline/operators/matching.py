"""Name matching: indexes of known names, source names resolved against them, close spellings, collisions and links."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graftline import fixed_values as fx
from graftline.functions.names import build_key, loose_key, name_key, parse_accession, unescape
from graftline.operators.closeness import close_pairs
from graftline.plans.lineage import cut


def all_names(varieties: DataFrame) -> DataFrame:
    """One row per name of a variety: (variety_id, pos, name, kind); pos 0 is the main name."""
    names = F.concat(F.array("name"), F.coalesce("aka", F.array().cast("array<string>")))
    return (varieties.select("variety_id", F.posexplode(names).alias("pos", "name"))
            .withColumn("kind", F.when(F.col("pos") == 0, "exact").otherwise("synonym")))


def name_index(varieties: DataFrame) -> DataFrame:
    """(key, strict, variety_id, kind): which variety a key means, where it means exactly one.

    A main name beats other varieties' synonyms; keys of two main names, or only of synonyms of several varieties, are
    left out.  Loose keys (strict = false) count only if all names behind them belong to one variety."""
    n = all_names(varieties)
    exact = F.when(F.col("kind") == "exact", F.col("variety_id"))
    g = n.groupBy(name_key("name").alias("key")).agg(F.min(exact).alias("e0"), F.max(exact).alias("e1"), F.min("variety_id").alias("s0"), F.max("variety_id").alias("s1"))
    strict = (g.where("key <> ''").withColumn("variety_id", F.when(F.col("e0") == F.col("e1"), F.col("e0")).when(F.col("e0").isNull() & (F.col("s0") == F.col("s1")), F.col("s0")))
              .where("variety_id IS NOT NULL").select("key", F.lit(True).alias("strict"), "variety_id", F.when(F.col("e0").isNull(), "synonym").otherwise("exact").alias("kind")))
    loose = (n.groupBy(loose_key("name").alias("key")).agg(F.min("variety_id").alias("s0"), F.max("variety_id").alias("s1")).where("s0 = s1 AND key <> ''")
             .select("key", F.lit(False).alias("strict"), F.col("s0").alias("variety_id"), F.lit("probable").alias("kind")))
    return strict.unionByName(loose)


def ambiguous_keys(varieties: DataFrame) -> DataFrame:
    """Keys left out of the strict index because they mean several varieties."""
    n = all_names(varieties).withColumn("key", name_key("name")).where("key <> ''").select("key").distinct()
    return n.join(name_index(varieties).where("strict").select("key"), "key", "left_anti")


def match_names(names: DataFrame, index: DataFrame, curated: DataFrame | None = None, rejects: DataFrame | None = None) -> DataFrame:
    """Resolve distinct (source, name) rows: rejected names never match, then the curated list, the strict and the loose key.

    Repeated names are collapsed first, so the joins see each spelling once however often it occurs."""
    n = names.select("source", F.col("name"), unescape("name").alias("plain")).distinct()
    if rejects is not None:
        n = n.join(rejects.select("source", F.col("name").alias("plain")), ["source", "plain"], "left_anti")
    strict = index.where("strict").select(F.col("key").alias("k1"), F.col("variety_id").alias("v1"), F.col("kind").alias("kind1"))
    loose = index.where("NOT strict").select(F.col("key").alias("k2"), F.col("variety_id").alias("v2"))
    j = n.withColumns({"k1": name_key("name"), "k2": loose_key("name")}).join(strict, "k1", "left").join(loose, "k2", "left")
    if curated is not None:
        j = j.join(curated.select("source", F.col("name").alias("plain"), F.col("variety_id").alias("v0")), ["source", "plain"], "left")
    else:
        j = j.withColumn("v0", F.lit(None).cast("bigint"))
    kind = F.when(F.col("v0").isNotNull(), "probable").when(F.col("v1").isNotNull(), F.col("kind1")).when(F.col("v2").isNotNull(), "probable")
    return j.select("source", "name", F.coalesce("v0", "v1", "v2").alias("variety_id"), kind.alias("kind")).where("variety_id IS NOT NULL")


def review(matches: DataFrame, varieties: DataFrame) -> DataFrame:
    """Matches whose source name is not the variety's own name."""
    own = varieties.select("variety_id", F.col("name").alias("own_name"))
    return matches.join(own, "variety_id").where(unescape("name") != F.col("own_name"))


def unmatched(names: DataFrame, matches: DataFrame) -> DataFrame:
    return names.select("source", "name").distinct().join(matches, ["source", "name"], "left_anti")


def classify_accessions(accessions: DataFrame, index: DataFrame, curated: DataFrame | None = None, rejects: DataFrame | None = None) -> DataFrame:
    """Match collection accessions (accession_id, source, name), whose names carry qualifiers, to varieties.

    The full name is tried first, then the base name, then '(syn X)' names.  A donor or place qualifier, or a merely probable
    key, makes the match loose; clone codes, and qualifiers that name the same variety, do not.  Sports, clones and supposed
    accessions never match."""
    every = accessions.select("accession_id", "source", F.trim(F.regexp_replace("name", r"\s+", " ")).alias("name"))
    # all but the id follows from the name, so a name is taken apart and looked up once, however many accessions have it
    whose = ["source", "name"]
    a = cut(every.select(*whose).distinct().withColumn("p", parse_accession("name")))
    a = a.where(~F.col("p.base").rlike(fx.NOT_SAME_SELECTION) & ~F.exists("p.quals", lambda q: q.rlike(fx.NOT_SAME_SELECTION)))
    tries = a.select(*whose, F.posexplode(F.concat(F.array("name", "p.base"), F.col("p.syns"))).alias("pos", "cand"))
    quals = a.select(*whose, F.explode("p.quals").alias("qual"))
    asked = tries.select("source", F.col("cand").alias("name")).unionByName(quals.select("source", F.col("qual").alias("name"))).distinct()
    found = cut(match_names(asked, index, curated, rejects))
    first = (tries.join(found.withColumnRenamed("name", "cand"), ["source", "cand"]).groupBy(*whose)
             .agg(F.min_by(F.struct("variety_id", "kind", "cand"), "pos").alias("hit")))
    hit = first.select(*whose, "hit.variety_id", "hit.kind", (F.col("hit.cand") == F.col("name")).alias("whole"))
    other = (quals.where(~F.col("qual").rlike(fx.BENIGN_QUALIFIER)).join(found.select("source", F.col("name").alias("qual"), F.col("variety_id").alias("q_id")), ["source", "qual"], "left")
             .join(hit.where("NOT whole").select(*whose, "variety_id"), whose)
             .where(F.col("q_id").isNull() | (F.col("q_id") != F.col("variety_id"))).groupBy(*whose).agg(F.count("*").alias("others")))
    j = hit.join(other, whose, "left")
    tier = F.when((F.col("kind") == "probable") | F.col("others").isNotNull(), "loose").otherwise("firm")
    note = F.when(F.col("kind") == "probable", "spelling variant").when(F.col("others").isNotNull(), "qualifier").otherwise("")
    known = j.select(*whose, "variety_id", "kind", tier.alias("tier"), note.alias("note"), (F.col("whole") & F.contains("name", F.lit("("))).alias("full_hit"))
    return every.join(known, whose).select("accession_id", "source", "name", "variety_id", "kind", "tier", "note", "full_hit")


# ---- close spellings ------------------------------------------------------------------
def allowed_edits(length: Column, share: float = 0.2) -> Column:
    return F.floor(length * F.lit(share) + 1e-9).cast("int")


def _segments(text: Column, share: float) -> Column:
    """Cut a text into pieces such that any text within the allowed edits contains one of them unchanged.

    The longest partner a text of length n can have is n / (1 - share); it allows k edits, so k + 1 pieces are enough."""
    n = F.length(text)
    k = allowed_edits(F.floor(n / F.lit(1.0 - share) + 1e-9), share)
    parts = k + 1
    edge = lambda i: F.floor(i * n / parts).cast("int")                         # noqa: E731
    return F.transform(F.sequence(F.lit(0), k), lambda i: F.struct(n.alias("n"), i.alias("i"), edge(i).alias("at"), F.substring(text, edge(i) + 1, edge(i + 1) - edge(i)).alias("piece")))


def _probes(text: Column, share: float) -> Column:
    """Every piece a partner of each possible length could share with this text, near the place it would have there."""
    m = F.length(text)
    k_max = allowed_edits(F.floor(m / F.lit(1.0 - share) + 1e-9), share)

    def of_length(n: Column) -> Column:
        k = allowed_edits(F.floor(n / F.lit(1.0 - share) + 1e-9), share)
        edits = allowed_edits(F.greatest(n, m), share)
        edge = lambda i: F.floor(i * n / (k + 1)).cast("int")                   # noqa: E731

        def piece(i: Column) -> Column:
            size = edge(i + 1) - edge(i)
            starts = F.filter(F.sequence(edge(i) - edits, edge(i) + edits), lambda s: (s >= 0) & (s + size <= m))
            return F.transform(starts, lambda s: F.struct(n.alias("n"), i.alias("i"), edge(i).alias("at"), F.substring(text, s + 1, size).alias("piece")))

        return F.flatten(F.transform(F.sequence(F.lit(0), k), piece))

    lengths = F.filter(F.sequence(F.greatest(F.lit(1), m - k_max), m + k_max), lambda n: F.abs(n - m) <= allowed_edits(F.greatest(n, m), share))
    return F.flatten(F.transform(lengths, of_length))


SHORT = 14                      # up to this length a fifth of the letters is at most two edits


def _deletions(text: Column, share: float) -> Column:
    """A short text and everything left of it after as many deletions as any partner allows (none, one or two)."""
    k = allowed_edits(F.floor(F.length(text) / F.lit(1.0 - share) + 1e-9), share)

    def less_one(t: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substring(t, 1, i - 1), F.substring(t, i + 1, F.length(t))))

    def up_to_two(once: Column) -> Column:
        twice = F.when(k >= 2, F.flatten(F.transform(once, less_one))).otherwise(F.array().cast("array<string>"))
        return F.array_distinct(F.concat(F.array(text), once, twice))

    return F.when(k < 1, F.array(text)).otherwise(F.element_at(F.transform(F.array(less_one(text)), up_to_two), 1))


def within_edits(left: DataFrame, right: DataFrame, left_text: str, right_text: str, on: list[str] | None = None, share: float = 0.2) -> DataFrame:
    """Pairs of texts whose edit distance is at most `share` of the longer length: (on..., left_text, right_text, edits).

    Both sides should be distinct texts.  Two equality joins find every true pair and compare no text with all others: short
    texts meet in what is left of them after one or two deletions, long ones in an unchanged piece at about the same place."""
    if share > 0.2:
        raise ValueError("at most a fifth of the letters may differ")
    on = on or []
    a, b = left.select(*on, left_text), right.select(*on, right_text)
    n, m = F.length(left_text), F.length(right_text)
    short = (a.where(n <= SHORT).withColumn("key", F.explode(_deletions(F.col(left_text), share)))
             .join(b.where(m <= SHORT).withColumn("key", F.explode(_deletions(F.col(right_text), share))), on + ["key"]))
    least = int(SHORT * (1.0 - share))                                       # a partner of a longer text has more letters than this
    long_ = (a.where(n > least).withColumn("key", F.explode(_probes(F.col(left_text), share)))
             .join(b.where(m > least).withColumn("key", F.explode(_segments(F.col(right_text), share))), on + ["key"]).where(F.greatest(n, m) > SHORT))
    pairs = short.drop("key").unionByName(long_.drop("key")).where(F.abs(n - m) <= allowed_edits(F.greatest(n, m), share)).distinct()
    return pairs.withColumn("edits", F.levenshtein(left_text, right_text)).where(F.col("edits") <= allowed_edits(F.greatest(n, m), share))


def _closest(known: DataFrame, asked: DataFrame, best: int, ratio: float) -> DataFrame:
    """(ask, known, ratio, rank) of the `best` closest known names of each.

    High ratios leave few letters out and so have few candidates; a name that has enough partners there is done, the others are asked
    again with a lower one."""
    closest = Window.partitionBy("ask").orderBy(F.desc("ratio"), F.desc("known"))
    parts = []
    for r in [r for r in (0.94, 0.88, 0.84) if r > ratio] + [ratio]:
        found = close_pairs(known, asked, "known", "ask", r).withColumn("rank", F.row_number().over(closest)).where(F.col("rank") <= best)
        if r > ratio:
            found = cut(found)
            done = found.where(F.col("rank") == best).select("ask")
            found, asked = found.join(done, "ask", "left_semi"), cut(asked.join(done, "ask", "left_anti"))
        parts.append(found)
    return reduce(lambda a, b: a.unionByName(b), parts)


def close_names(missing: DataFrame, varieties: DataFrame, best: int = 3, ratio: float = 0.8) -> DataFrame:
    """For names that matched nothing: the `best` closest known names by sequence ratio (ties to the later spelling), and known names whose
    words are all in the missing name (or, for missing names of several words, contain all of its words); each with the last variety
    of that name.

    `missing`: distinct (source, name).  Containment is found by joining on each name's rarest word."""
    ask = cut(missing.select("source", "name", name_key("name").alias("ask")).where("ask <> ''"))
    ours = cut(all_names(varieties).select(name_key("name").alias("known"), "variety_id").where("known <> ''").groupBy("known").agg(F.max("variety_id").alias("variety_id")))
    known = ours.select("known")
    asked = ask.select("ask").distinct()
    near = _closest(known, asked, best, ratio)
    split = lambda c: F.array_distinct(F.split(F.col(c), " "))                  # noqa: E731
    ka, aa = known.select("known", split("known").alias("kw")), asked.select("ask", split("ask").alias("aw"))
    freq = ka.select(F.explode("kw").alias("w")).groupBy("w").agg(F.count("*").alias("f"))

    def rarest(df: DataFrame, text: str, ws: str) -> DataFrame:
        r = df.select(text, ws, F.explode(ws).alias("w")).join(freq, "w", "left").groupBy(text).agg(F.min_by("w", F.struct(F.coalesce("f", F.lit(0)), "w")).alias("w"), F.first(ws).alias(ws))
        return r

    inside = (rarest(ka, "known", "kw").join(aa.select("ask", "aw", F.explode("aw").alias("w")), "w").where(F.size(F.array_except("kw", "aw")) == 0)
              .select("ask", "known", F.lit("contained").alias("how")))
    around = (rarest(aa.where(F.size("aw") > 1), "ask", "aw").join(ka.select("known", "kw", F.explode("kw").alias("w")), "w").where(F.size(F.array_except("aw", "kw")) == 0)
              .select("ask", "known", F.lit("contained").alias("how")))
    hits = near.withColumn("how", F.lit("spelling")).unionByName(inside.unionByName(around), allowMissingColumns=True).groupBy("ask", "known").agg(*[F.max(c).alias(c) for c in ("how", "ratio", "rank")])
    return ask.join(hits, "ask").join(ours, "known").select("source", "name", "known", "variety_id", "how", "ratio", "rank")


# ---- links, collisions, lists --------------------------------------------------------------
def link_index(varieties: DataFrame) -> DataFrame:
    """(key, variety_id) for cross-linking: the last main name with a key wins, else the first synonym, in name order."""
    n = all_names(varieties).withColumn("key", build_key("name"))
    main = varieties.select("variety_id", F.struct(build_key("name").alias("k"), F.col("variety_id").alias("v")).alias("o"))
    n = n.join(main, "variety_id")
    exact = n.where("pos = 0").groupBy("key").agg(F.max_by("variety_id", "o").alias("e"))
    alias = n.where("pos > 0").groupBy("key").agg(F.min_by("variety_id", F.struct("o", "pos")).alias("s"))
    return exact.join(alias, "key", "full").select("key", F.coalesce("e", "s").alias("variety_id"))


def link_names(regions: DataFrame, varieties: DataFrame, names: str = "local_names") -> DataFrame:
    """Ids of the varieties a region's free-text names mean: (place_id, pos, variety_id), each id once at its first place."""
    r = regions.select("place_id", F.posexplode(names).alias("pos", "local")).withColumn("key", build_key("local"))
    return r.join(link_index(varieties), "key").groupBy("place_id", "variety_id").agg(F.min("pos").alias("pos"))


def name_collisions(varieties: DataFrame) -> DataFrame:
    """Keys that name more than one variety, with how many."""
    n = all_names(varieties).withColumn("key", build_key("name"))
    return n.groupBy("key").agg(F.countDistinct("variety_id").alias("varieties")).where("varieties > 1")


def name_list(varieties: DataFrame) -> DataFrame:
    """The compact shared list: id, name, other names joined."""
    return varieties.select("variety_id", "name", F.array_join(F.coalesce("aka", F.array().cast("array<string>")), "; ").alias("aka")).orderBy("variety_id")
