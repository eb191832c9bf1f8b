"""Close spellings by the sequence ratio: 2 M / T, M the letters in matching blocks, T the letters of both texts.

Matching blocks are found by taking the longest common substring (the earliest in the first text, then in the second) and going on to
the left and right of it, as `difflib.SequenceMatcher` of the standard library does; it gives the final ratio of each candidate.

Candidates come from equality joins that lose no pair with a ratio of at least r >= 0.8.  Then at most D = (1 - r) T letters of both
texts are outside the blocks, so both texts have a subsequence of ceil(r T / 2) letters in common, and there are at most D + 1 blocks.

* If one text has at most SHORT letters, or neither text has more than MOST_KEYS ways to leave letters out, the texts meet in that common
  subsequence, which few texts share by chance.
* Else the longest block has at least M / (D + 1) letters, rounded up, and they meet in so many letters that stand together, if these are
  three or more.
* Else they meet in three letters.  If all blocks had at most two letters, M <= 2 (D + 1), which with M >= r T / 2 leaves a slack of two:
  nearly all gaps are one letter of one text, and two neighbouring blocks make three letters that stand together in one text and with one
  more letter among them in the other.  So three letters together on one side, and three letters together or with one letter among them
  on the other, always meet, and no further apart than D.
"""
from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graftline.plans.lineage import cut

SHORT = 8
MOST_KEYS = 4_000
LEAST_RATIO = 0.8
#: Kinds of keys: a common subsequence, letters that stand together, three letters with one among them.
SUBSEQUENCE, TOGETHER, PARTED = 0, 1, 2


def _needed(letters: int, ratio: float) -> int:
    """Letters in matching blocks that two texts of so many letters need."""
    return math.ceil(ratio * letters / 2 - 1e-9)


def _in_subsequence(n: int, m: int, need: int) -> bool:
    """Whether texts of n and m letters meet in a common subsequence."""
    return min(n, m) <= SHORT or max(math.comb(n, need), math.comb(m, need)) <= MOST_KEYS


def _met_in_subsequence(n: int, ratio: float, apart: int) -> tuple[int, int]:
    """First and last length of an unbroken range of lengths whose texts a text of n letters meets in a common subsequence alone."""
    best = (0, -1)
    lo = None
    for m in range(max(0, n - apart), n + apart + 2):
        need = _needed(n + m, ratio)
        if m <= n + apart and need <= min(n, m) and _in_subsequence(n, m, need):
            lo = m if lo is None else lo
        elif lo is not None:
            best, lo = max(best, (lo, m - 1), key=lambda r: r[1] - r[0]), None
    return best


def meeting_keys(text: str, ratio: float = LEAST_RATIO, most_apart: int | None = None) -> Iterator[tuple[str, int, int]]:
    """(key, kind, place) by which a text meets every text with at least this ratio and at most so many letters more or less."""
    n = len(text)
    apart = n if most_apart is None else most_apart
    drops, runs = set(), set()
    for m in range(max(0, n - apart), n + apart + 1):
        need = _needed(n + m, ratio)
        if need <= min(n, m):
            if _in_subsequence(n, m, need):
                drops.add(n - need)
            else:
                runs.add(-(-need // (n + m - 2 * need + 1)))
    for k in drops:
        for left in set(map("".join, itertools.combinations(text, n - k))):
            yield left, SUBSEQUENCE, 0
    for size in {max(r, 3) for r in runs}:
        for i in range(n - size + 1):
            yield text[i:i + size], TOGETHER, i
    if runs and min(runs) < 3:
        for i in range(n - 3):
            yield text[i:i + 2] + text[i + 3], PARTED, i
            yield text[i] + text[i + 2:i + 4], PARTED, i


def _parts(df: DataFrame) -> int:
    """Texts are small beside the work on them, so their partitions must not be merged by size."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _keyed(df: DataFrame, text: str, name: str, ratio: float, most_apart: int | None) -> DataFrame:
    """(name, key, kind, first and last place, lengths met in subsequences) of every text and key."""
    names = [name, "key", "kind", f"{name}_lo", f"{name}_hi", f"{name}_from", f"{name}_to"]
    kinds = (pa.string(), pa.string(), *[pa.int32()] * 5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(0).to_pylist():
                places: dict[tuple[str, int], list[int]] = {}
                for key, kind, at in meeting_keys(t, ratio, most_apart):
                    places.setdefault((key, kind), []).append(at)
                met = _met_in_subsequence(len(t), ratio, len(t) if most_apart is None else most_apart)
                rows += [(t, *k, min(at), max(at), *met) for k, at in places.items()]
                if len(rows) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return df.select(F.col(text).alias(name)).where(F.col(name).isNotNull()).repartition(_parts(df), name).mapInArrow(run, f"{name} string, key string, kind int, " + ", ".join(f"{c} int" for c in names[3:]))


def close_pairs(first: DataFrame, second: DataFrame, first_text: str, second_text: str, ratio: float = LEAST_RATIO, most_apart: int | None = None) -> DataFrame:
    """(first_text, second_text, ratio) of all pairs of texts with at least this ratio; the ratio depends on which text is the first.

    Both sides should be distinct texts.  `most_apart` bounds the difference of their lengths."""
    if not LEAST_RATIO <= ratio <= 1:
        raise ValueError("the ratio must be between 0.8 and 1")
    a, b = _keyed(first, first_text, "_a", ratio, most_apart), _keyed(second, second_text, "_b", ratio, most_apart).withColumnRenamed("kind", "kind_b")
    n, m = F.length("_a"), F.length("_b")
    outside = F.floor((n + m) * F.lit(1 - ratio) + 1e-9)
    kinds = ((F.col("kind") == SUBSEQUENCE) == (F.col("kind_b") == SUBSEQUENCE)) & ((F.col("kind") != PARTED) | (F.col("kind_b") != PARTED))
    sizes = 2 * F.least(n, m) >= (n + m) * F.lit(ratio) - 1e-9
    if most_apart is not None:
        sizes = sizes & (F.abs(n - m) <= most_apart)
    # some place of the key in one text and some in the other may be matched, from the front and from the end
    front = (F.col("_a_lo") - F.col("_b_hi") <= outside) & (F.col("_b_lo") - F.col("_a_hi") <= outside)
    end = ((n - F.col("_a_hi")) - (m - F.col("_b_lo")) <= outside + 1) & ((m - F.col("_b_hi")) - (n - F.col("_a_lo")) <= outside + 1)
    # texts that meet in a subsequence of the needed length need not meet in letters together as well
    drawn = F.when(F.col("kind") == SUBSEQUENCE, F.length(a["key"]) == F.ceil(F.lit(ratio) * (n + m) / 2 - 1e-9)).otherwise(front & end & ~m.between(F.col("_a_from"), F.col("_a_to")))
    a, b = a.repartition(_parts(first), "key").alias("a"), b.drop("_b_from", "_b_to").repartition(_parts(first), "key").alias("b")
    # keys are many times the texts they are reckoned from, so neither side is sent whole to every task
    met = a.hint("merge").join(b, (F.col("a.key") == F.col("b.key")) & kinds & sizes & drawn).select("_a", "_b").repartition(_parts(first), "_a", "_b").distinct()
    # letters outside the blocks can be edited away one by one
    likely = met.where(F.levenshtein("_a", "_b") <= outside)
    return sequence_ratios(likely.select(F.col("_a").alias(first_text), F.col("_b").alias(second_text)), ratio)


def sequence_ratios(pairs: DataFrame, ratio: float) -> DataFrame:
    """(first, second, ratio) of those of the given pairs of texts that have at least this ratio."""
    x, y = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [SequenceMatcher(None, p, q).ratio() for p, q in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [x, y, "ratio"])
            yield out.filter(pa.array([r >= ratio for r in found], pa.bool_()))

    return pairs.repartition(_parts(pairs)).mapInArrow(run, f"{x} string, {y} string, ratio double")


def _letters(text: str) -> Column:
    """Which of a to z a text has, one bit each."""
    return reduce(Column.bitwiseOR, [F.when(F.contains(text, F.lit(c)), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")])


def close_in_groups(first: DataFrame, second: DataFrame, group: str, first_text: str, second_text: str, ratio: float, most_apart: int) -> DataFrame:
    """(group, first_text, second_text) of texts of the same group with at least this ratio and at most so many letters more or less.

    Both sides: distinct (group, text).  Only texts of one group and of fitting lengths meet; a letter that only one of them has is outside
    the blocks, and so is every edit.  The ratio itself is worked out once per pair of texts, however many groups have it."""
    a = first.select(group, first_text, F.length(first_text).alias("_n"), _letters(first_text).alias("_x"))
    a = a.withColumn("_m", F.explode(F.sequence(F.greatest(F.lit(0), F.col("_n") - most_apart), F.col("_n") + most_apart)))
    a = a.where(2 * F.least("_n", "_m") >= (F.col("_n") + F.col("_m")) * F.lit(ratio) - 1e-9).withColumn("_outside", F.floor((F.col("_n") + F.col("_m")) * F.lit(1 - ratio) + 1e-9).cast("int"))
    b = second.select(group, second_text, F.length(second_text).alias("_m"), _letters(second_text).alias("_y"))
    likely = a.hint("merge").join(b, [group, "_m"]).where((F.bit_count(F.col("_x").bitwiseXOR(F.col("_y"))) <= F.col("_outside")) & (F.levenshtein(first_text, second_text) <= F.col("_outside")))
    likely = cut(likely.select(group, first_text, second_text))
    alike = sequence_ratios(likely.select(first_text, second_text).distinct(), ratio)
    return likely.join(alike, [first_text, second_text], "left_semi").select(group, first_text, second_text)
