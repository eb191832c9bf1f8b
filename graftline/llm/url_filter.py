"""URL filter: host and path rules, and gradient-boosted trees on lexical features for what no rule decides.

Rules are a short list (a parameter) written `host/path`, matched in place: a rule fits its host and all subdomains if the path begins
with the rule's; the longest rule wins (of two equally long ones the longer host, then the first by letters).  The verdicts of rules
label URLs; trees learn from them which other URLs to block.  Features: length, depth, share of digits, entropy of the characters,
number of parameters and fragments, and two statistics of the host's last label over all labelled URLs (smoothed share of blocks,
logarithm of their number).  All of it is DataFrame functions and Spark's own tree learner.

The trees are fitted on at most `sample` labelled URLs, the first by hash, so the result doesn't depend on how rows are stored; the
statistics count all rows.  If the labelled URLs hold fewer than two verdicts, the one there is stands for all (allow, if none).

Cases: a null URL or one without `://` has an empty host and path, fits no rule and is judged by its features (zero length and so on);
repeated rows are judged each by itself; other columns stay, those with the name of an added column are replaced; an empty table
gives an empty result.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graftline.llm.rows import quoted, without
from graftline.plans.lineage import cut

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: Labelled URLs the trees see; trees and their depth; weight of the overall share in a suffix's share.
SAMPLE, TREES, DEPTH, SMOOTH = 20_000, 12, 4, 20.0
ADDED = ["host", "path", "rule", "score", "verdict"]
FEATURES = ["f_length", "f_depth", "f_digits", "f_entropy", "f_params", "f_fragment", "f_host_labels", "f_suffix_share", "f_suffix_count"]
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_parts(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Add host and path."""
    url = F.coalesce(quoted(url_col).cast("string"), F.lit(""))
    return df.select(*[quoted(c) for c in df.columns], F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _LOWER).alias("host"), F.regexp_extract(url, _PARTS, 2).alias("path"))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The winning rule as struct(rule, verdict), or null."""
    order = sorted(rules, key=lambda r: (-len(r[1]), -len(r[1].partition("/")[0]), r[1], r[0]))
    fits = []
    for verdict, rule in order:
        at, _, rest = rule.partition("/")
        fits.append(F.when(((host == at) | host.endswith("." + at)) & path.startswith("/" + rest), F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*fits, F.lit(None).cast("struct<rule:string,verdict:string>"))


def _entropy(text: Column) -> Column:
    """Bits per character."""
    chars = F.split(text, "")
    length = F.char_length(text)
    share = lambda c: (length - F.char_length(F.replace(text, c))) / length
    return F.when(length > 0, F.aggregate(F.array_distinct(F.filter(chars, lambda c: c != "")), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))).otherwise(0.0)


def lexical_features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    url = F.coalesce(url.cast("string"), F.lit(""))
    length = F.char_length(url)
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    return {"f_length": length.cast("double"), "f_depth": F.size(F.filter(F.split(path, "/"), lambda p: p != "")).cast("double"),
            "f_digits": (length - F.char_length(F.translate(url, "0123456789", ""))) / F.greatest(length, F.lit(1)), "f_entropy": _entropy(url),
            "f_params": F.when(query == "", 0.0).otherwise(1.0 + F.char_length(query) - F.char_length(F.replace(query, F.lit("&")))),
            "f_fragment": F.contains(url, F.lit("#")).cast("double"), "f_host_labels": F.size(F.filter(F.split(host, r"\."), lambda p: p != "")).cast("double"),
            "suffix": F.element_at(F.split(host, r"\."), -1)}


def url_filter(df: DataFrame, url_col: str = "url", rules: list[tuple[str, str]] | None = None, sample: int = SAMPLE) -> DataFrame:
    """Add host, path, rule (null if none fits), score (probability of a block by the trees) and verdict to each row."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rules = RULES if rules is None else rules
    kept = without(df, ADDED)
    # the caller's columns travel in one struct, so no name of theirs meets one of these
    parts = with_parts(df.select(F.struct(*[quoted(c) for c in kept.columns]).alias("row") if kept.columns else F.struct(F.lit(0)).alias("row"), quoted(url_col).cast("string").alias("url")))
    feats = parts.withColumn("by", rule_for(F.col("host"), F.col("path"), rules)).withColumns(lexical_features(F.col("url"), F.col("host"), F.col("path")))
    own = [c for c in feats.columns if c.startswith("f_")]
    labelled = feats.filter("by is not null").select("url", "suffix", *own, (F.col("by.verdict") == "block").cast("double").alias("label"))
    by_suffix = labelled.groupBy("suffix").agg(F.sum("label").alias("blocks"), F.count("*").alias("n"))
    overall = by_suffix.agg(F.coalesce(F.sum("blocks"), F.lit(0.0)).alias("blocks"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    share = overall["blocks"] / overall["n"] if overall["n"] else 0.0
    suffixes = by_suffix.select("suffix", ((F.col("blocks") + SMOOTH * share) / (F.col("n") + SMOOTH)).alias("f_suffix_share"), F.log1p("n").alias("f_suffix_count"))
    filled = {"f_suffix_share": F.coalesce("f_suffix_share", F.lit(share)), "f_suffix_count": F.coalesce("f_suffix_count", F.lit(0.0))}
    if 0 < overall["blocks"] < overall["n"]:
        # a url on many rows is one example of that weight
        urls = labelled.groupBy("url").agg(*[F.first(c).alias(c) for c in labelled.columns if c != "url"], F.count("*").cast("double").alias("rows"))
        # written once: the trees go over the sample many times, and over the table never
        some = cut(urls.orderBy(F.xxhash64("url"), "url").limit(sample).join(suffixes, "suffix", "left").withColumns(filled).select("rows", "label", *FEATURES).coalesce(1))
        assembler = VectorAssembler(inputCols=FEATURES, outputCol="x")
        model = GBTClassifier(featuresCol="x", labelCol="label", weightCol="rows", maxIter=TREES, maxDepth=DEPTH, seed=7, predictionCol="y").fit(assembler.transform(some))
        scored = model.transform(assembler.transform(feats.join(suffixes, "suffix", "left").withColumns(filled))).withColumn("score", vector_to_array("probability")[1])
    else:
        scored = feats.withColumn("score", F.lit(1.0 if overall["blocks"] else 0.0))
    verdict = F.coalesce("by.verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return scored.select(*(["row.*"] if kept.columns else []), "host", "path", F.col("by.rule").alias("rule"), "score", verdict.alias("verdict"))
