"""Pollination partners and similar varieties."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graftline.plans.lineage import cut


def own_cost() -> Column:
    """What a partner costs apart from the distance in flowering group: not listed 1, poorly known 1.5, a crab 0.5."""
    return (F.when(F.col("listed"), 0.0).otherwise(1.0) + F.when(F.col("conf") == "low", 1.5).otherwise(0.0)
            + F.when(F.array_contains("uses", "crab"), 0.5).otherwise(0.0))


def partner_lists(varieties: DataFrame, n: int = 8) -> Column:
    """Map from flowering group to its n + 1 best partners, as a scalar value.

    A partner's rank depends only on the group it is wanted for, so n + 1 per group (one may be the variety itself) is
    enough for every variety of the group: no variety is ever compared with all others."""
    able = varieties.where((F.col("ploidy").isNull() | (F.col("ploidy") != "triploid")) & F.col("flower_group").isNotNull()
                           & ~((F.size("uses") == 1) & (F.element_at("uses", 1) == "ornamental")))
    own = able.select("variety_id", F.lower("name").alias("sort_name"), "flower_group", own_cost().alias("cost"))
    w = Window.partitionBy("flower_group").orderBy("cost", "sort_name", "variety_id")
    best = own.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n + 1)
    near = best.select("variety_id", "sort_name", F.explode(F.array(*[F.struct((F.col("flower_group") + d).alias("wanted"), (F.col("cost") + 2.0 * abs(d)).alias("cost")) for d in (-1, 0, 1)])).alias("t"))
    w2 = Window.partitionBy("t.wanted").orderBy("t.cost", "sort_name", "variety_id")
    top = near.withColumn("rn", F.row_number().over(w2)).where(F.col("rn") <= n + 1).select(F.col("t.wanted").alias("wanted"), F.struct("rn", "variety_id", F.col("t.cost").alias("cost")).alias("p"))
    lists = top.groupBy("wanted").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    return lists.agg(F.map_from_entries(F.collect_list(F.struct("wanted", "ps"))).alias("m")).scalar()


def pollinators(targets: DataFrame, varieties: DataFrame, n: int = 8) -> DataFrame:
    """The n best partners of each target variety (variety_id, flower_group), ranked by cost, then name."""
    mine = F.filter(F.try_element_at(F.col("lists"), F.col("flower_group")), lambda p: p["variety_id"] != F.col("variety_id"))
    t = targets.where("flower_group IS NOT NULL").withColumn("lists", partner_lists(varieties, n)).select("variety_id", F.posexplode(F.slice(mine, 1, n)).alias("pos", "p"))
    return t.select("variety_id", (F.col("pos") + 1).alias("rank"), F.col("p.variety_id").alias("partner_id"), F.col("p.cost").alias("cost"))


def pollination_report(favs: DataFrame, varieties: DataFrame) -> DataFrame:
    """Per member of a selection: how many partners it has inside the selection and whether that is enough.

    Partners are counted per (selection, group), not paired."""
    j = favs.join(varieties.select("variety_id", "flower_group", "ploidy", "self_fertile"), "variety_id")
    tri = F.coalesce(F.col("ploidy") == "triploid", F.lit(False))
    j = j.withColumn("triploid", tri)
    groups = (j.where("NOT triploid AND flower_group IS NOT NULL").groupBy("selection_id", "flower_group").agg(F.count("*").alias("n"))
              .select("selection_id", F.explode(F.array(*[F.col("flower_group") + d for d in (-1, 0, 1)])).alias("flower_group"), "n")
              .groupBy("selection_id", "flower_group").agg(F.sum("n").alias("near")))
    r = j.join(groups, ["selection_id", "flower_group"], "left")
    partners = F.coalesce("near", F.lit(0)) - F.when(F.col("triploid"), 0).otherwise(1)
    r = r.withColumn("partners", F.when(F.col("flower_group").isNotNull(), partners))
    tone = (F.when(F.col("flower_group").isNull(), "warn").when(F.col("triploid"), F.when(F.col("partners") >= 2, "good").otherwise("bad"))
            .when(~F.col("self_fertile").eqNullSafe(F.lit("yes")), F.when(F.col("partners") >= 1, "good").otherwise("warn")).otherwise("good"))
    return r.select("selection_id", "position", "variety_id", "flower_group", "triploid", "partners", tone.alias("tone"))


def partner_pairs(favs: DataFrame, varieties: DataFrame) -> DataFrame:
    """Who pollinates whom inside a selection (at most 24 members): rows (selection_id, variety_id, partner_id)."""
    j = favs.join(varieties.select("variety_id", "flower_group", "ploidy"), "variety_id").where("flower_group IS NOT NULL")
    giver = j.where(~F.col("ploidy").eqNullSafe(F.lit("triploid"))).select("selection_id", F.col("variety_id").alias("partner_id"), F.explode(F.array(*[F.col("flower_group") + d for d in (-1, 0, 1)])).alias("flower_group"))
    return j.join(giver, ["selection_id", "flower_group"]).where("variety_id <> partner_id").select("selection_id", "variety_id", "partner_id")


def suggest_pollinators(favs: DataFrame, varieties: DataFrame, per_member: int = 4, n: int = 6) -> DataFrame:
    """Up to six varieties that would fill a selection's gaps: the four best partners of each member not yet served."""
    need = pollination_report(favs, varieties).where("tone <> 'good'").select("selection_id", "position", "variety_id", "flower_group")
    best = pollinators(need.select("variety_id", "flower_group").distinct(), varieties, per_member)
    new = (need.join(best, "variety_id").select("selection_id", "position", "rank", F.col("partner_id").alias("variety_id"))
           .join(favs.select("selection_id", "variety_id"), ["selection_id", "variety_id"], "left_anti"))
    first = new.groupBy("selection_id", "variety_id").agg(F.min(F.struct("position", "rank")).alias("o"))
    w = Window.partitionBy("selection_id").orderBy("o")
    return first.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).select("selection_id", "variety_id", "place")


def needs_pollination(favs: DataFrame, varieties: DataFrame) -> DataFrame:
    """Members that need a partner: not self-fertile, or triploid."""
    j = favs.join(varieties.select("variety_id", "self_fertile", "ploidy"), "variety_id")
    return j.where((F.col("self_fertile") == "no") | (F.col("ploidy") == "triploid")).select("selection_id", "variety_id", "position")


TASTE_KEYS = ["sweet", "acid", "aroma", "tannin", "crisp", "juicy"]
#: Parts in which the tastes of a class are compared with each other.
TASTE_PARTS = 16
#: Tastes are looked for in cells up to this distance, beyond it in the whole class.
CELLS_WITHIN = 1.5


def similar_to(picks: DataFrame, varieties: DataFrame, n: int = 6) -> DataFrame:
    """The n varieties most like each pick.

    Likeness depends on the profile alone: the class (uses and tags) and the taste.  Of each profile the first n + 1 varieties are kept,
    which is enough for any pick.  A pick's profile first meets the profiles of its own class; the likeness of the last of the best
    n + 1 found there bounds how far the taste may be off in each other class, and most classes are too far whatever the taste.  What is
    left meets on the class and on cells of three tastes.  The work grows with the pairs of profiles of one class, not with the pairs of
    varieties; classes are compared pair by pair, so it is quadratic where nearly every variety has tags of its own."""
    taste = [F.coalesce(F.col(k).cast("double"), F.lit(2.5)).alias(k) for k in TASTE_KEYS]
    tidy = lambda c: F.array_sort(F.array_distinct(c))                          # noqa: E731
    v = varieties.select("variety_id", F.lower("name").alias("sort_name"), tidy(F.col("uses")).alias("uses"),
                         tidy(F.coalesce("tags", F.array().cast("array<string>"))).alias("tags"), *taste)
    v = cut(v.withColumn("class", F.to_json(F.struct("uses", "tags"))))
    profile = ["class", *TASTE_KEYS]
    first = v.withColumn("nth", F.row_number().over(Window.partitionBy(*profile).orderBy("sort_name", "variety_id"))).where(F.col("nth") <= n + 1)
    members = F.array_sort(F.collect_list(F.struct("sort_name", "variety_id")))
    profiles = cut(first.groupBy(*profile).agg(members.alias("members"), F.first("uses").alias("uses"), F.first("tags").alias("tags")))
    picked = cut(v.join(picks.select("variety_id").distinct(), "variety_id", "left_semi").select(F.col("variety_id").alias("pick_id"), *profile))
    wanted = picked.select(*profile).distinct()
    mine = [F.col(k).alias(f"p_{k}") for k in profile]
    asked = [f"p_{k}" for k in profile]
    off = F.sqrt(reduce(lambda a, b: a + b, [(F.col(f"p_{k}") - F.col(k)) * (F.col(f"p_{k}") - F.col(k)) for k in TASTE_KEYS]))
    like = F.lit(1.0) / (F.lit(1.0) + off) * 0.6 + F.col("shared") * 0.7 + F.col("use")

    # how like each other two classes are
    classes = cut(profiles.groupBy("class").agg(F.first("uses").alias("uses"), F.first("tags").alias("tags")))
    other = classes.select(F.col("class").alias("p_class"), F.col("uses").alias("p_uses"), F.col("tags").alias("p_tags"))
    both, either = F.size(F.array_intersect("p_tags", "tags")), F.greatest(F.lit(1), F.size(F.array_union("p_tags", "tags")))
    use = F.when(F.arrays_overlap("p_uses", "uses"), 0.1).otherwise(-0.4)
    alike = cut(other.join(wanted.select(F.col("class").alias("p_class")).distinct(), "p_class", "left_semi").crossJoin(classes)
                .select("p_class", "class", (both / either).alias("shared"), use.alias("use")))

    def best(met: DataFrame) -> DataFrame:
        """The profiles that can hold one of the first n + 1 varieties, then these varieties."""
        by = Window.partitionBy(*asked)
        near = met.withColumn("at", F.rank().over(by.orderBy(F.desc("likeness")))).where(F.col("at") <= n + 1)
        rows = near.select(*asked, "likeness", F.explode("members").alias("m")).select(*asked, "likeness", "m.sort_name", "m.variety_id")
        return rows.withColumn("at", F.row_number().over(by.orderBy(F.desc("likeness"), "sort_name", "variety_id"))).where(F.col("at") <= n + 1)

    part = F.pmod(F.xxhash64(*TASTE_KEYS), F.lit(TASTE_PARTS)).cast("int")
    parts = F.explode(F.array(*[F.lit(i) for i in range(TASTE_PARTS)]))
    seekers = wanted.withColumn("part", part).select("part", *mine)
    own = alike.where("p_class = class").select("p_class", "shared", "use")
    here = seekers.join(own, "p_class").withColumn("class", F.col("p_class")).join(profiles.select(*profile, "members", parts.alias("part")), ["class", "part"])
    top = cut(best(here.select(*asked, "members", like.alias("likeness"))))

    # other classes: what a taste at no distance would give must reach the last of the best
    last = top.groupBy(*asked).agg(F.min(F.when(F.col("at") == n + 1, F.col("likeness"))).alias("last"))
    room = F.col("last") - 1e-9 - F.col("shared") * 0.7 - F.col("use")
    reach = F.when(room > 0, F.lit(0.6) / room - 1.0)
    open_ = last.join(alike.where("p_class <> class"), "p_class").withColumn("reach", reach).where(F.col("last").isNull() | F.col("reach").isNull() | (F.col("reach") >= 0)).drop("last")
    within = F.col("reach") + 1e-9
    cells, looked = TASTE_KEYS[:3], open_.where(F.col("reach") < CELLS_WITHIN)
    for k in cells:
        low, high = (F.floor(F.col(f"p_{k}") + 0.25 + s * within).cast("int") for s in (-1, 1))
        looked = looked.withColumn(f"c_{k}", F.explode(F.sequence(low, high)))
    placed = profiles.select(*profile, "members", *[F.floor(F.col(k) + 0.25).cast("int").alias(f"c_{k}") for k in cells])
    close = looked.join(placed, ["class", *[f"c_{k}" for k in cells]]).where(off <= within)
    far = open_.where(F.col("reach").isNull() | (F.col("reach") >= CELLS_WITHIN)).join(profiles.select(*profile, "members"), "class").where(F.col("reach").isNull() | (off <= within))
    rest = best(close.select(*asked, "members", like.alias("likeness")).unionByName(far.select(*asked, "members", like.alias("likeness"))))
    found = top.drop("at").unionByName(rest.drop("at"))
    pairs = picked.select("pick_id", *mine).join(found, asked).where("variety_id <> pick_id")
    w = Window.partitionBy("pick_id").orderBy(F.desc("likeness"), "sort_name", "variety_id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("variety_id", "pick_id", "likeness", "rank")
