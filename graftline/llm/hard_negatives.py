"""Hard negatives by rotated one-bit codes.

Index.  A vector of whole numbers is rotated (random signs and Hadamard transforms, given by a rule, nothing is stored) and kept as the
signs of its components, one bit each, with its alignment: the inner product a of the rotated vector with its unit sign vector.  What
a * code leaves over is rotated anew and coded the same way, STAGES times; the length r of what is left after each stage is kept too.

Search.  An anchor is rotated alike and cut to 8-bit steps, so its inner product with a code is a weighted sum of popcounts over eight bit planes.
After k stages the score lies within

    sum a_i <q_i, b_i>  +-  ( r_k * |part of q_k orthogonal to b_k|  +  sum a_i * error of the steps )

by Cauchy-Schwarz, always.  Pairs whose interval can reach no list any more are dropped stage by stage; what survives is scored in whole
numbers, so the result is exact.  Every task keeps the best few of each list, their best scores narrow its own search, and the lists of all
tasks are merged in Spark.

Anchors are a stated query set: they are taken in blocks of about BLOCK, each broadcast, and the rows are scanned where they lie, twice a
block: for the positives of the anchors, then for the negatives that the positives' scores admit.  No group of a label ever comes together.

Cases: rows with a null id, label or vector, or a null or non-finite component take no part; shorter vectors count as filled up with
zeros; components beyond +-2^25 after scaling count as that (sums of 4,096 products fit); of anchors with one id the least (label, vector) counts; in a list an id stands
once, by its best row, so repeated rows change nothing; a row with the anchor's own id is never its partner; ties go to the smaller id;
other columns are ignored; empty tables give an empty result.
"""
from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graftline.llm.rows import quoted, small_batches
from graftline.plans.lineage import shared_folder

STAGES, PLANES, BLOCK, SUB_BLOCK, FAR = 4, 8, 1_024, 128, 1 << 25


def prepared(vectors: DataFrame, id_col: str, label: Column, vector_col: str, scale: float) -> DataFrame:
    """(id, label, vector of whole numbers) of the rows that take part."""
    fit = F.forall(quoted(vector_col), lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(math.inf)))
    whole = F.transform(quoted(vector_col), lambda x: F.greatest(F.least(F.floor(F.lit(float(scale)) * x.cast("double")), F.lit(FAR)), F.lit(-FAR)).cast("int"))
    return vectors.where(quoted(id_col).isNotNull() & quoted(vector_col).isNotNull() & fit).select(quoted(id_col).cast("long").alias("id"), label.cast("long").alias("label"), whole.alias("vector")).where(F.col("label").isNotNull())


def rotate(x: np.ndarray, stage: int) -> np.ndarray:
    """Rows turned by three rounds of fixed random signs and Hadamard transforms; their length must be a power of two."""
    n, d = x.shape
    rng = np.random.default_rng([2718, stage, d])
    for _ in range(3):
        x = x * rng.choice([-1.0, 1.0], d)
        h = 1
        while h < d:
            y = x.reshape(n, d // (2 * h), 2, h)
            x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
            h *= 2
        x = x / math.sqrt(d)
    return x


def bits(x: np.ndarray) -> np.ndarray:
    """Booleans of each row as 64-bit words."""
    return np.packbits(x, axis=-1).view(np.uint64)


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code words, alignment, length left) of each row and stage."""
    x, d = vectors.astype(np.float64), vectors.shape[1]
    codes, align, left = [], [], []
    for k in range(STAGES):
        x = rotate(x, k)
        up = x > 0
        a = np.abs(x).sum(axis=1) / math.sqrt(d)
        x = x - np.where(up, 1, -1) * (a / math.sqrt(d))[:, None]
        codes.append(bits(up))
        align.append(a)
        left.append(np.sqrt((x * x).sum(axis=1)))
    return np.stack(codes, axis=1), np.stack(align, axis=1), np.stack(left, axis=1)


class Anchors:
    """Bit planes of a block's rotated anchors, and what their steps may be wrong by."""

    def __init__(self, vectors: np.ndarray):
        x, self.d = vectors.astype(np.float64), vectors.shape[1]
        self.square = (x * x).sum(axis=1)
        self.planes, self.low, self.step, self.error, self.sum = [], [], [], [], []
        for k in range(STAGES):
            x = rotate(x, k)
            low = x.min(axis=1)
            step = np.maximum((x.max(axis=1) - low) / (2**PLANES - 1), 1e-300)
            u = np.clip(np.rint((x - low[:, None]) / step[:, None]), 0, 2**PLANES - 1).astype(np.uint64)
            near = low[:, None] + u * step[:, None]
            self.planes.append(np.stack([bits((u >> np.uint64(p)) & np.uint64(1) > 0) for p in range(PLANES)], axis=1))
            self.low.append(low)
            self.step.append(step)
            self.error.append(np.abs(x - near).sum(axis=1) / math.sqrt(self.d))
            self.sum.append(near.sum(axis=1))

    def estimate(self, k: int, who: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Inner products of anchors with unit sign vectors at stage k, pair by pair (the arrays broadcast), by popcounts."""
        total = np.zeros(np.broadcast_shapes(who.shape, codes.shape[:-1]), np.int64)
        for p in range(PLANES):
            total += np.bitwise_count(self.planes[k][who, p] & codes).sum(axis=-1, dtype=np.int64) << p
        ones = np.bitwise_count(codes).sum(axis=-1, dtype=np.int64)
        return (2 * (self.low[k][who] * ones + self.step[k][who] * total) - self.sum[k][who]) / math.sqrt(self.d)


def survivors(anchors: Anchors, part: np.ndarray, codes: np.ndarray, align: np.ndarray, left: np.ndarray, wanted: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, row) of the pairs that no stage rules out; `wanted` says of (anchor, row, low, high) which may still count."""
    who, row = np.repeat(part, len(codes)), np.tile(np.arange(len(codes)), len(part))
    sure = wanted(who, row, np.full(len(who), -np.inf), np.full(len(who), np.inf))
    who, row = who[sure], row[sure]
    middle, wrong = np.zeros(len(who)), np.zeros(len(who))
    for k in range(STAGES):
        near = anchors.estimate(k, who, codes[row, k])
        error = anchors.error[k][who]
        middle, wrong = middle + align[row, k] * near, wrong + align[row, k] * error
        across = np.sqrt(np.maximum(anchors.square[who] - np.maximum(np.abs(near) - error, 0) ** 2, 0))
        width = wrong + left[row, k] * across
        width = width + 1e-9 * (np.abs(middle) + width) + 1e-9 * np.sqrt(anchors.square[who]) * (align[row, 0] + left[row, 0]) + 1e-6  # rounding
        on = wanted(who, row, middle - width, middle + width)
        who, row, middle, wrong = who[on], row[on], middle[on], wrong[on]
    return who, row


def score(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, exact: in doubles where no sum can pass 2^53."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[-1]
    return np.einsum("ij,ij->i", a.astype(np.float64), b.astype(np.float64)).astype(np.int64) if most < 1 << 53 else (a * b).sum(axis=1)


class Lists:
    """The best `most` (score, id) of each list met so far, ties to the smaller id, an id once."""

    def __init__(self, lists: int, most: int):
        self.most, self.least = most, np.full(lists, -np.inf)
        self.list, self.score, self.id = (np.empty(0, np.int64) for _ in range(3))

    def add(self, which: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        which, score, ids = np.r_[self.list, which], np.r_[self.score, score], np.r_[self.id, ids]
        order = np.lexsort((-score, ids, which))
        which, score, ids = which[order], score[order], ids[order]
        once = np.r_[True, (which[1:] != which[:-1]) | (ids[1:] != ids[:-1])] if len(which) else np.empty(0, bool)
        which, score, ids = which[once], score[once], ids[once]
        order = np.lexsort((ids, -score, which))
        which, score, ids = which[order], score[order], ids[order]
        first = np.flatnonzero(np.r_[True, which[1:] != which[:-1]]) if len(which) else np.empty(0, np.int64)
        rank = np.arange(len(which)) - np.repeat(first, np.diff(np.r_[first, len(which)]))
        keep = rank < self.most
        self.list, self.score, self.id = which[keep], score[keep], ids[keep]
        full = rank == self.most - 1
        self.least[which[full]] = score[full]


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """Lists of whole numbers as rows of width d, filled up with zeros."""
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (size == d).all():
        return flat.reshape(-1, d).astype(np.int64)
    out = np.zeros((len(size), d), np.int64)
    start = np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - start] = flat
    return out


def _written(df: DataFrame, at: str) -> DataFrame:
    df.write.parquet(at)
    return df.sparkSession.read.parquet(at)


def build_index(rows: DataFrame, d: int) -> DataFrame:
    """The rows with their codes (STAGES times d/64 words), alignments and lengths left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, align, left = encode(_matrix(batch.column("vector"), d))
            n = batch.num_rows
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (x.size // max(n, 1))), pa.array(x.reshape(-1))) for x in (codes.view(np.int64), align, left)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists], [*batch.schema.names, "codes", "align", "left"])

    return rows.mapInArrow(run, "id long, label long, vector array<int>, codes array<long>, align array<double>, left array<double>")


def _search(index: DataFrame, d: int, block: tuple, lists: tuple, most: int) -> DataFrame:
    """(list, id, score): the best `most` rows of each list that a task finds, merged over the tasks.

    block: ids, labels, vectors of the anchors.  lists: number of the anchor of each list, whether its rows have the anchor's label, the
    lowest and the highest score that count."""
    sent = index.sparkSession.sparkContext.broadcast((block, lists))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (ids, labels, vectors), (owner, same, low, high) = sent.value
        anchors, found = Anchors(vectors), Lists(len(owner), most)
        # lists of each anchor, as many columns as any has
        per = np.bincount(owner, minlength=len(ids))
        slot = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
        table = np.full((len(ids), per.max(initial=1)), -1)
        table[owner, slot] = np.arange(len(owner))
        part_of = np.flatnonzero(per > 0)
        for batch in batches:
            own_id, own_label, own = batch.column("id").to_numpy(), batch.column("label").to_numpy(), _matrix(batch.column("vector"), d)
            n = batch.num_rows
            codes = batch.column("codes").flatten().to_numpy().view(np.uint64).reshape(n, STAGES, -1)
            align, left = (batch.column(c).flatten().to_numpy().reshape(n, STAGES) for c in ("align", "left"))

            def eligible(who, row, lowest, highest):
                """By (pair, list of its anchor): whether the interval can reach the list."""
                mine = table[who]
                at = np.maximum(mine, 0)
                return (mine >= 0) & (highest[:, None] >= np.maximum(low[at], found.least[at])) & (lowest[:, None] <= high[at]) & ((labels[who] == own_label[row])[:, None] == same[at]) & (ids[who] != own_id[row])[:, None]

            for at in range(0, len(part_of), SUB_BLOCK):
                who, row = survivors(anchors, part_of[at:at + SUB_BLOCK], codes, align, left, lambda *x: eligible(*x).any(axis=1))
                exact = score(vectors[who], own[row])
                pair, column = np.nonzero(eligible(who, row, exact, exact))
                found.add(table[who[pair], column], exact[pair], own_id[row[pair]])
        yield pa.RecordBatch.from_arrays([pa.array(found.list), pa.array(found.id), pa.array(found.score)], ["list", "id", "score"])

    best = index.mapInArrow(run, "list long, id long, score long").groupBy("list", "id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("list").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= most)


def _width(rows: DataFrame) -> int:
    """Components of the longest vector, up to a power of two, 64 at least."""
    longest = rows.agg(F.max(F.size("vector")).alias("n")).first()["n"] or 1
    return max(64, 1 << (longest - 1).bit_length())


def mine(vectors: DataFrame, anchors: Column, id_col: str = "id", label: Column | None = None, vector_col: str = "vector", positives: int = 5, negatives: int = 5, lowest: int = 80, scale: float = 256.0) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows for which `anchors` holds.

    Positives are an anchor's `positives` best rows of its label.  Negatives of a positive are the `negatives` best rows of another label
    that score at most as much as the positive, and at least `lowest` percent of it."""
    spark = small_batches(vectors).sparkSession
    folder = f"{shared_folder(spark)}/negatives-{uuid.uuid4().hex}"
    label = quoted("label") if label is None else label
    rows = prepared(vectors, id_col, label, vector_col, scale)
    d = _width(rows)
    index = _written(build_index(rows, d), f"{folder}/index")
    asked = prepared(vectors.where(anchors), id_col, label, vector_col, scale)
    asked = _written(asked.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("r")).select("id", "r.*"), f"{folder}/anchors")
    kind = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    blocks = -(-asked.count() // BLOCK)
    for b in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).orderBy("id").collect()  # about BLOCK rows
        if not mine:
            continue
        block = (np.array([r["id"] for r in mine]), np.array([r["label"] for r in mine]), np.array([list(r["vector"]) + [0] * (d - len(r["vector"])) for r in mine], np.int64))
        n = len(mine)
        good = _search(index, d, block, (np.arange(n), np.ones(n, bool), np.full(n, -np.inf), np.full(n, np.inf)), positives).collect()  # `positives` for each anchor
        good = sorted((r["list"], r["rank"], r["id"], r["score"]) for r in good)
        owner, bar = np.array([g[0] for g in good], np.int64), np.array([g[3] for g in good], np.int64)
        floor = np.array([-(-lowest * int(s) // 100) for s in bar], np.float64)
        hard = _search(index, d, block, (owner, np.zeros(len(good), bool), floor, bar.astype(np.float64)), negatives) if good else None
        if hard is not None:
            lists = spark.createDataFrame([(i, int(block[0][g[0]]), g[2], g[3]) for i, g in enumerate(good)], "list long, anchor_id long, positive_id long, positive_score long")
            hard.join(F.broadcast(lists), "list").select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(f"{folder}/found")
    spark.createDataFrame([], kind).write.mode("append").parquet(f"{folder}/found")
    return spark.read.schema(kind).parquet(f"{folder}/found")
