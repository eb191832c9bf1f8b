"""Laboratory measurements and panel scores: gates, two-level means, percentiles inside each dataset, genotype majority."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graftline.functions.numeric import mean_score
from graftline.functions.ordered import counts_below, global_row_number
from graftline.plans.lineage import cut

MEASURES = ["ssc", "ta", "firm"]
PANEL_SCORES = ["sweet", "acid", "balance", "aroma", "firm", "crunch", "juice", "quality"]


def kind_rank(kind: Column | str) -> Column:
    k = F.col(kind) if isinstance(kind, str) else kind
    return F.when(k == "exact", 0).when(k == "synonym", 1).otherwise(2)


def kind_name(rank: Column) -> Column:
    return F.when(rank == 0, "exact").when(rank == 1, "synonym").when(rank == 2, "probable")


# ---- source shapes -> observations -----------------------------------------------------
def yearly_columns(wide: DataFrame, id_columns: list[str], columns: dict[str, tuple[str, str, int]]) -> DataFrame:
    """Wide yearly columns -> one observation per value: columns maps a column to (measure, stage, year)."""
    rows = F.array(*[F.struct(F.lit(m).alias("measure"), F.lit(st).alias("stage"), F.lit(y).alias("year"), F.col(c).cast("double").alias("value")) for c, (m, st, y) in columns.items()])
    return wide.select(*id_columns, F.explode(rows).alias("o")).select(*id_columns, "o.*").where("value IS NOT NULL")


def range_gate(obs: DataFrame, measure: str = "ssc", lo: float = 4.0, hi: float = 32.0) -> DataFrame:
    """Mark implausible values: column `plausible` is false outside [lo, hi]; such values are reported, not averaged."""
    return obs.where(F.col(measure).isNotNull()).withColumn("plausible", F.col(measure).between(lo, hi))


def descriptor_union(sugar: DataFrame, firmness: DataFrame) -> DataFrame:
    """Sugar and firmness files of one collection as observations per accession."""
    return sugar.select("accession", "year", F.col("value").alias("ssc")).unionByName(firmness.select("accession", "year", F.col("value").alias("firm")), allowMissingColumns=True)


def trial_observations(rows: DataFrame, names: DataFrame, management: str = "M1") -> DataFrame:
    """Trial rows of one management, with a named genotype; a firmness of zero is missing."""
    return (rows.where(F.col("management") == management).join(names, "genotype").where("name IS NOT NULL AND name <> ''")
            .withColumn("firm", F.nullif("firm", F.lit(0.0))))


def single_values(rows: DataFrame, year: int) -> DataFrame:
    """One acidity value per accession, all of one year."""
    return rows.where("ta IS NOT NULL").select("accession", F.col("ta"), F.lit(year).alias("year"))


# ---- two-level means ---------------------------------------------------------------------
def accession_means(obs: DataFrame) -> DataFrame:
    """Means within an accession, per stage.

    Partial sums are taken before the shuffle, so an accession (or a variety) with a third of all rows costs no more."""
    return obs.groupBy("source", "variety_id", "accession", "stage").agg(
        *[F.avg(m).alias(m) for m in MEASURES], F.min("year").alias("y0"), F.max("year").alias("y1"), F.max(kind_rank("kind")).alias("kind_rank"), F.count("*").alias("obs"))


def lab_records(obs: DataFrame) -> DataFrame:
    """One record per (source, variety): mean over accessions of their means, accessions used, weakest match, years.

    A variety without any harvest value falls back to its after-storage values; otherwise those are given beside it."""
    acc = accession_means(obs).where(" OR ".join(f"{m} IS NOT NULL" for m in MEASURES))

    def level(stage: str, prefix: str = "") -> DataFrame:
        return acc.where(F.col("stage") == stage).groupBy("source", "variety_id").agg(
            *[F.avg(m).alias(prefix + m) for m in MEASURES], F.count("*").alias(prefix + "n"), F.min("y0").alias(prefix + "y0"), F.max("y1").alias(prefix + "y1"), F.max("kind_rank").alias(prefix + "kind_rank"))

    j = level("harvest").join(level("storage", "s_"), ["source", "variety_id"], "full")
    own = F.col("n").isNotNull()
    pick = lambda c: F.when(own, F.col(c)).otherwise(F.col("s_" + c))          # noqa: E731
    y0, y1 = pick("y0"), pick("y1")
    digits = {"ssc": 1, "ta": 2, "firm": 2}
    return j.select("source", "variety_id", *[F.bround(pick(m), d).alias(m) for m, d in digits.items()], pick("n").alias("n"),
                    F.when(y0 == y1, y0.cast("string")).otherwise(F.concat(y0.cast("string"), F.lit("-"), y1.cast("string"))).alias("years"),
                    kind_name(pick("kind_rank")).alias("match"), F.when(own, "harvest").otherwise("storage").alias("stage"),
                    *[F.when(own, F.bround("s_" + m, d)).alias("storage_" + m) for m, d in digits.items()])


def lab_accessions(obs: DataFrame) -> DataFrame:
    """What was averaged, one row per accession of records that rest on more than one."""
    acc = accession_means(obs).where("stage = 'harvest'").where(" OR ".join(f"{m} IS NOT NULL" for m in MEASURES))
    several = acc.groupBy("source", "variety_id").agg(F.count("*").alias("n")).where("n > 1").select("source", "variety_id")
    return acc.join(several, ["source", "variety_id"], "left_semi").select("source", "variety_id", "accession", F.bround("ssc", 1).alias("ssc"), F.bround("ta", 2).alias("ta"), F.bround("firm", 2).alias("firm"))


def midrank_pct(records: DataFrame, measure: str, width: float = 1.0) -> DataFrame:
    """Mid-rank percentile (0-100, half-even) of a measure inside each source, over all its records."""
    below = counts_below(records, "source", measure, width)
    pct = F.bround(F.lit(100.0) * (F.col("below") + F.lit(0.5) * F.col("equal")) / F.col("total"), 0).cast("int")
    ranked = below.select("source", measure, pct.alias(f"pct_{measure}"))
    return records.join(ranked, ["source", measure], "left")


def measured(records: DataFrame) -> DataFrame:
    """Per variety: mean of values and percentiles over the sources (one decimal) and the number of sources."""
    exact = lambda c: F.avg(F.col(c).cast("decimal(18,4)"))                    # noqa: E731  (sums of rounded values, whatever their order)
    return records.groupBy("variety_id").agg(*[F.bround(exact(c), 1).cast("double").alias(c) for c in ("ssc", "ta", "pct_ssc", "pct_ta")], F.count("*").alias("n"))


def lab_coverage(records: DataFrame) -> DataFrame:
    """How many varieties have any data, sugar, acidity, firmness, both from any sources, both from one source."""
    v = records.groupBy("variety_id").agg(*[F.max(F.col(m).isNotNull().cast("int")).alias(m) for m in MEASURES], F.max((F.col("ssc").isNotNull() & F.col("ta").isNotNull()).cast("int")).alias("one"))
    return v.agg(F.count("*").alias("any_data"), *[F.sum(m).alias(f"with_{m}") for m in MEASURES], F.sum((F.col("ssc") * F.col("ta"))).alias("with_both"), F.sum("one").alias("both_one_source"))


# ---- panel -------------------------------------------------------------------------------
def panel_rows(rows: DataFrame) -> DataFrame:
    """Named accessions (not 'unknown') with at least one score."""
    return rows.where((F.trim("name") != "") & (F.lower(F.trim("name")) != "unknown") & F.coalesce(*PANEL_SCORES).isNotNull())


def panel_keep(matched: DataFrame) -> DataFrame:
    """Which matched accessions count, with the reason for those that do not.

    Firm matches first: loose ones stay only if their genotype is one of the firm ones' (or if there is no firm match).
    Then the majority genotype of what is left: most accessions, then a full-name hit, then an exact name, then the first
    accession.  Accessions without a genotype always stay."""
    has_munq = F.col("munq") != ""
    firm = matched.where("tier = 'firm'").groupBy("variety_id").agg(F.count("*").alias("firms"))
    firm_genotypes = matched.where((F.col("tier") == "firm") & has_munq).select("variety_id", "munq").distinct().withColumn("known", F.lit(True))
    j = matched.join(firm, "variety_id", "left").join(firm_genotypes, ["variety_id", "munq"], "left")
    j = j.withColumn("kept", (F.col("tier") == "firm") | F.col("firms").isNull() | F.coalesce("known", F.lit(False))).drop("firms", "known")
    votes = j.where(F.col("kept") & has_munq).groupBy("variety_id", "munq").agg(
        F.count("*").alias("n"), F.max(F.col("full_hit").cast("int")).alias("full"), F.max((F.col("kind") == "exact").cast("int")).alias("exact"), F.min("accession_id").alias("first_id"))
    top = votes.groupBy("variety_id").agg(F.max_by("munq", F.struct("n", "full", "exact", (-F.col("first_id")).alias("o"))).alias("top"))
    j = j.join(top, "variety_id", "left")
    other = F.col("kept") & has_munq & (F.col("munq") != F.col("top"))
    reason = F.when(other, F.concat_ws(" ", F.lit("other_genotype"), "munq", "top")).when(~F.col("kept"), "weaker_match")
    return j.withColumns({"reason": reason, "kept": F.col("kept") & ~other}).drop("top")


def panel_records(kept: DataFrame) -> DataFrame:
    """One record per variety: mean scores, commonest season fields (first seen wins ties), match class; its accessions with their
    names, when each was picked and tasted, and, if there are several, the name, genotype and scores of each.

    Lists have one entry per kept accession, firm matches first, then in the order of the accessions; a record holds all of them, so
    it is as long as its variety has accessions.  `panel_assessments` has a row for each instead."""
    k = kept.where("kept")
    tier = F.max((F.col("tier") == "firm").cast("int"))
    exact = F.max((F.col("kind") == "exact").cast("int"))
    name = F.trim(F.regexp_replace("name", r"\s+", " "))
    one = F.struct((F.col("tier") != "firm").alias("loose"), F.col("accession_id").alias("accessions"), name.alias("name"), F.nullif("munq", F.lit("")).alias("munq"), "harvest", "tasted", *PANEL_SCORES)
    out = k.groupBy("variety_id").agg(*[mean_score(F.avg(s)).alias(s) for s in PANEL_SCORES], F.count("*").alias("n"), tier.alias("f"), exact.alias("e"), F.array_sort(F.collect_list(one)).alias("every"))
    out = out.withColumn("match", F.when((F.col("f") == 1) & (F.col("e") == 1), "exact").when(F.col("f") == 1, "synonym").otherwise("probable")).drop("f", "e")
    several = F.when(F.col("n") > 1, F.col("every"))
    out = out.withColumns({"accession": F.array_join("every.name", "; "), **{c: F.col(f"every.{c}") for c in ("accessions", "harvest", "tasted")}, **{f"each_{c}": several[c] for c in ("name", "munq", *PANEL_SCORES)}}).drop("every")
    for field in ("pick", "keeps_to"):
        seen = k.where(F.col(field).isNotNull() & (F.col(field) != "")).groupBy("variety_id", field).agg(F.count("*").alias("c"), F.min("accession_id").alias("first_id"))
        top = seen.groupBy("variety_id").agg(F.max_by(field, F.struct("c", (-F.col("first_id")).alias("o"))).alias(field))
        out = out.join(top, "variety_id", "left")
    return out


def panel_assessments(kept: DataFrame) -> DataFrame:
    """When each kept accession of a variety was picked and tasted: (variety_id, nth, accession_id, name, harvest, tasted), in the order
    of the accessions.  Rows rather than a list, as a variety may have any number."""
    rows = global_row_number(kept.where("kept").select("variety_id", "accession_id", "name", "harvest", "tasted"), [F.asc("variety_id"), F.asc("accession_id")], "nth")
    rows = cut(rows)
    first = rows.groupBy("variety_id").agg(F.min("nth").alias("first"))
    return rows.join(first, "variety_id").withColumn("nth", F.col("nth") - F.col("first") + 1).drop("first")


def panel_dropped(kept: DataFrame) -> DataFrame:
    return kept.where("NOT kept").select("variety_id", "accession_id", "name", "reason")
