"""Quality rules: counts over whole texts, fixed rules, and robust outliers per language and source.

Every text gives four ratios on a logarithmic scale: characters per word, symbols per word, share of repeated lines, share of words in
repeated three-word windows.  For each language and source the centre and spread of these vectors come from the minimum covariance
determinant: of all subsets with at least `share` of the rows, the one whose covariance has the smallest determinant, found by
concentration steps (keep the rows nearest to the centre, estimate again) from two starts, then scaled and reweighted.  A row whose
Mahalanobis distance is beyond the `tail` quantile of chi-square is rejected.

A step is one aggregation over the small table of vectors: rows are counted and their products summed by group and distance bucket
(16 buckets an octave), so a group of any size is combined before the shuffle, and the subset is "all buckets up to the one that holds
the wanted row".  Groups with fewer than `least` rows take the estimate of their language, small languages that of all rows; below
that nobody is rejected.  The spread has a floor in each direction, so that a rule that nearly all rows meet exactly stays defined.

Cases: a null text has no words and fails the base rules; null language or source counts as the empty string; repeated rows and
repeated ids count each by itself; further columns are left aside; an empty table gives an empty result.
"""
from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from graftline.llm.rows import add_from_text, quoted
from graftline.plans.lineage import cut

P = 4
#: Parts of each group's rows where they meet its estimate, so that a large group is no single task's.
PARTS = 64
#: Share of rows in the subset; quantile beyond which a row is rejected; rows a group needs; concentration steps.
SHARE, TAIL, LEAST, STEPS = 0.75, 0.999, 60, 4
#: Smallest spread that counts, of the four ratios on the logarithmic scale; small enough that each ratio alone can pass the cut-off.
FLOOR = (0.08, 0.35, 0.35, 0.35)
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
VECTOR = [f"v{i}" for i in range(P)]
PRODUCTS = [(i, j) for i in range(P) for j in range(i, P)]
_SYMBOLS = re.compile(rb"[#*$%&|<>]")
_SPACES = (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")


def _repeated(words: list[bytes]) -> int:
    """Words that stand in a three-word window found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    a = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    _, pair = np.unique(a[:-1] * len(number) + a[1:], return_inverse=True)
    _, window, count = np.unique(pair[:-1] * len(number) + a[2:], return_inverse=True, return_counts=True)
    twice = count[window] > 1
    inside = np.zeros(n, bool)
    for k in range(3):
        inside[k:n - 2 + k] |= twice
    return int(inside.sum())


def text_stats(text: bytes) -> tuple[int, ...]:
    """Words, code points in them, symbols, repeated lines, words in repeated windows, lines with a word."""
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    points = len(text.decode("utf-8", "replace")) - sum(text.count(s) for s in _SPACES)
    return len(words), points, len(_SYMBOLS.findall(text)), len(lines) - len(set(lines)), _repeated(words), len(lines)


def add_stats(df: DataFrame, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Add the counts of each whole text."""

    def make():
        return lambda data: [pa.array(c, pa.int64()) for c in zip(*map(text_stats, data), strict=True)]

    return add_from_text(df, text_col, [(c, LongType()) for c in STATS], make, keep_text)


def _vector() -> dict[str, Column]:
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    return {"v0": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words), "v1": F.log(0.01 + F.col("n_symbols") / words),
            "v2": F.log(0.05 + F.col("n_dup_lines") / lines), "v3": F.log(0.05 + F.col("n_repeat_words") / words)}


def chi2_cdf(x: float) -> float:
    """Chi-square with four degrees of freedom."""
    return 1 - math.exp(-x / 2) * (1 + x / 2)


def chi2_quantile(q: float) -> float:
    low, high = 0.0, 200.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid) < q else (low, mid)
    return high


def _distance() -> Column:
    """Squared Mahalanobis distance by the joined centre m0.. and the inverse p00.. of the covariance."""
    d = [F.col(v) - F.col(f"m{i}") for i, v in enumerate(VECTOR)]
    return sum(((1 if i == j else 2) * d[i] * d[j] * F.col(f"p{i}{j}") for i, j in PRODUCTS), F.lit(0.0))


def _part() -> Column:
    return F.pmod(F.xxhash64(*VECTOR), F.lit(PARTS)).cast("int").alias("part")


def _for_parts(df: DataFrame) -> DataFrame:
    """A small table with a copy of each row for every part."""
    return df.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))


def _moments() -> list[Column]:
    return [F.count("*").alias("n"), *[F.sum(v).alias(f"s{i}") for i, v in enumerate(VECTOR)], *[F.sum(F.col(f"v{i}") * F.col(f"v{j}")).alias(f"q{i}{j}") for i, j in PRODUCTS]]


MOMENTS = ["n", *[f"s{i}" for i in range(P)], *[f"q{i}{j}" for i, j in PRODUCTS]]
SHAPE = ", ".join(["grp string", "start int", "total long", *[f"m{i} double" for i in range(P)], *[f"p{i}{j} double" for i, j in PRODUCTS], "logdet double", "reach double"])


def _estimate(moments: DataFrame, diagonal: bool = False) -> DataFrame:
    """Centre, inverse covariance and its log determinant for each row of summed moments (small: one row a group and start)."""
    names = [c.split(" ")[0] for c in SHAPE.split(", ")]

    def run(batches):
        for b in batches:
            x = {c: b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in b.schema.names}
            n = np.maximum(x["n"], 1)
            mean = np.stack([x[f"s{i}"] / n for i in range(P)], -1)
            cov = np.zeros((len(n), P, P))
            for i, j in PRODUCTS:
                cov[:, i, j] = cov[:, j, i] = x[f"q{i}{j}"] / n - mean[:, i] * mean[:, j]
            scale = x["scale"][:, None, None]
            cov = cov * scale
            if diagonal:
                cov = cov * np.eye(P)
            # shrinking towards the floor keeps the matrix invertible where nearly all rows agree
            values, vectors = np.linalg.eigh(cov / np.outer(FLOOR, FLOOR))
            values = np.maximum(values, 1.0)
            inverse = (vectors / values[:, None, :]) @ np.swapaxes(vectors, 1, 2) / np.outer(FLOOR, FLOOR)
            out = {"grp": x["grp"], "start": x["start"], "total": x["total"], "logdet": np.log(values).sum(-1), "reach": x["reach"]}
            out |= {f"m{i}": mean[:, i] for i in range(P)} | {f"p{i}{j}": inverse[:, i, j] for i, j in PRODUCTS}
            yield pa.RecordBatch.from_arrays([pa.array(out[c]) for c in names], names).cast(pa.schema([("grp", pa.string()), ("start", pa.int32()), ("total", pa.int64()), *[(c, pa.float64()) for c in names[3:]]]))

    return moments.mapInArrow(run, SHAPE)


def _by_bucket(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """Moments by group, start and distance bucket."""
    near = rows.join(_for_parts(estimate), ["grp", "part"]).withColumn("bucket", F.floor(16 * F.log2(F.greatest(_distance(), F.lit(1e-9)))))
    return near.groupBy("grp", "start", "total", "bucket").agg(*_moments())


def _nearest(by_bucket: DataFrame, share: float) -> DataFrame:
    """Summed moments of the nearest buckets that hold at least this share of each group's rows; buckets of a group are few hundred."""
    from pyspark.sql import Window

    before = F.sum("n").over(Window.partitionBy("grp", "start").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    kept = by_bucket.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < F.ceil(share * F.col("total")))
    return kept.groupBy("grp", "start", "total").agg(*[F.sum(c).alias(c) for c in MOMENTS], (F.pow(F.lit(2.0), (F.max("bucket") + 1) / 16)).alias("reach")).withColumn("scale", F.lit(1.0))


def robust_estimates(rows: DataFrame, share: float = SHARE, steps: int = STEPS) -> DataFrame:
    """Reweighted minimum-covariance-determinant estimate of each group: grp, total, centre m*, inverse covariance p*.

    `rows` has grp, part and the vector columns; it should be a written table, as each step reads it again."""
    middle = rows.groupBy("grp").agg(F.count("*").alias("total"), *[F.percentile_approx(v, [0.25, 0.5, 0.75], 1000).alias(v) for v in VECTOR])
    # first start: medians and quartile ranges, second start: plain mean and covariance
    medians = middle.select("grp", F.lit(0).alias("start"), "total", F.lit(1).cast("long").alias("n"), *[F.col(v)[1].alias(f"s{i}") for i, v in enumerate(VECTOR)],
                            *[(F.col(f"v{i}")[1] * F.col(f"v{j}")[1] + (F.pow((F.col(f"v{i}")[2] - F.col(f"v{i}")[0]) / 1.349, 2) if i == j else F.lit(0.0))).alias(f"q{i}{j}") for i, j in PRODUCTS],
                            F.lit(0.0).alias("reach"), F.lit(1.0).alias("scale"))
    plain = rows.groupBy("grp").agg(*_moments()).select("grp", F.lit(1).alias("start"), F.col("n").alias("total"), *MOMENTS, F.lit(0.0).alias("reach"), F.lit(1.0).alias("scale"))
    estimate = cut(_estimate(medians.unionByName(plain)))
    for _ in range(steps):
        estimate = cut(_estimate(_nearest(_by_bucket(rows, estimate), share)))
    order = F.struct("logdet", "start")
    best = estimate.groupBy("grp").agg(F.min_by(F.struct("*"), order).alias("b")).select("b.*")
    # the subset's covariance is too small by the share it leaves out: its reach should be that share's quantile
    scaled = cut(best.select("grp", "start", "total", *[f"m{i}" for i in range(P)], *[(F.col(f"p{i}{j}") * chi2_quantile(share) / F.greatest(F.col("reach"), F.lit(chi2_quantile(share)))).alias(f"p{i}{j}") for i, j in PRODUCTS],
                             "logdet", "reach"))
    inner = rows.join(_for_parts(scaled), ["grp", "part"]).filter(_distance() <= chi2_quantile(0.975)).groupBy("grp", "start", "total").agg(*_moments()).withColumn("reach", F.lit(0.0)).withColumn("scale", F.lit(1.0))
    return cut(_estimate(inner)).drop("start", "logdet", "reach")


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                  share: float = SHARE, tail: float = TAIL, least: int = LEAST) -> DataFrame:
    """One row per input row: id, the counts, base_failed, distance (squared; null if no group is large enough) and kept."""
    parts = [F.coalesce(quoted(c).cast("string"), F.lit("")) for c in (lang_col, source_col)]
    slim = df.select(quoted(id_col).alias(id_col), quoted(text_col).alias("text"), parts[0].alias("__lang"), parts[1].alias("__source"))
    counted = add_stats(slim, "text", keep_text=False)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = cut(counted.withColumn("base_failed", failed).withColumns(_vector()))
    levels = F.array(F.concat_ws("\x01", F.lit("s"), "__lang", "__source"), F.concat_ws("\x01", F.lit("l"), "__lang"), F.lit("a"))
    rows = cut(stats.filter(~F.col("base_failed")).select(F.explode(levels).alias("grp"), _part(), *VECTOR))
    estimates = robust_estimates(rows, share).filter(F.col("total") >= least)
    groups = stats.select("__lang", "__source").distinct().select("*", F.posexplode(levels).alias("level", "grp"))
    chosen = groups.join(estimates, "grp").groupBy("__lang", "__source").agg(F.min_by(F.struct("total", *[f"m{i}" for i in range(P)], *[f"p{i}{j}" for i, j in PRODUCTS]), "level").alias("e")).select("__lang", "__source", "e.*")
    judged = stats.withColumn("part", _part()).join(_for_parts(cut(chosen)), ["__lang", "__source", "part"], "left").withColumn("distance", _distance())
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= chi2_quantile(tail), F.lit(True))
    return judged.select(quoted(id_col), *STATS, "base_failed", "distance", kept.alias("kept"))
