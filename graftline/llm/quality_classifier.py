"""Quality classifier: a factorisation machine over hashed words, structure statistics and the text's own metadata.

Features of a text: its words hashed into 2**16 cells with logarithmic counts of unit length; statistics of its structure (shares of
character classes, of distinct and of the most frequent word, of repeated three-word runs, mean word length) and its sizes, each once
as a standardised number and once as one of eight bins.  The model adds linear weights and all pairwise interactions of rank `rank`;
a text is scored in time linear in its features by sum over k of ((sum v x)**2 - sum (v x)**2) / 2.

The model is fitted on a bounded sample, one text of each of the first `sample` labelled ids by hash (all if there are fewer), in
one task that sees only this sample; its size is fixed by the parameters and it is broadcast.  Documents are scored where they lie.

Cases: null and empty texts have the statistics of no words; without labels every score is 0.5, with one class only its smoothed
share; repeated rows are scored each by itself; of contradicting labels of an id the larger holds; null labels and ids are not
learned from; other columns stay, those with the name of an added column are replaced; an empty table gives an empty result.
"""
from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

from graftline.llm.rows import add_from_text, one_text, quoted, slices, texts
from graftline.llm.words import words

#: Labelled rows learned from; cells of hashed words; rank of the interactions; passes, step and shrinkage of the fit; rows of a step.
SAMPLE, CELLS, RANK, PASSES, STEP, SHRINK, LOT = 12_000, 1 << 16, 8, 12, 0.05, 1e-5, 128
_CLASSES = 13
_CLASS = np.full(256, 10, np.uint8)  # further punctuation
for _code, _bytes in enumerate([b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b"!?", b"|", b"#*$%&", b"<>=", b".,;:"]):
    _CLASS[list(_bytes)] = _code
_CLASS[128:192], _CLASS[192:] = 11, 12
STATS = [*[f"share_{i}" for i in range(_CLASSES)], "bytes", "words", "word_length", "distinct", "top_word", "repeated_runs"]
BINS = 8


def features(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, cell, value) of the hashed words, by text, and the statistics (text, stat)."""
    n = len(data)
    w = words(data)
    key = np.sort((w.text.astype(np.uint64) << np.uint64(32)) | (w.hashes >> np.uint64(32)))
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    count = np.diff(np.r_[first, len(key)])
    text, cell = (key[first] >> np.uint64(32)).astype(np.int64), ((key[first] >> np.uint64(16)) & np.uint64(CELLS - 1)).astype(np.int64)
    value = 1 + np.log(count)
    norm = np.sqrt(np.bincount(text, weights=value * value, minlength=n))
    size = np.array([len(t) for t in data], np.int64)
    raw = np.frombuffer(b"".join(data), np.uint8)
    shares = np.bincount(np.repeat(np.arange(n) * _CLASSES, size) + _CLASS[raw], minlength=n * _CLASSES).reshape(n, _CLASSES) / np.maximum(size, 1)[:, None]
    n_words = np.diff(w.first)
    top = np.zeros(n)
    np.maximum.at(top, text, count)
    run, at = w.window(3)
    run = np.sort((w.text[at].astype(np.uint64) << np.uint64(44)) | (run >> np.uint64(20)))
    again = np.r_[False, run[1:] == run[:-1]] if len(run) else np.empty(0, bool)
    repeated = np.bincount((run[again] >> np.uint64(44)).astype(np.int64), minlength=n)
    many = np.maximum(n_words, 1)
    letters = np.bincount(w.text, weights=w.end - w.begin, minlength=n)
    stats = np.column_stack([np.sqrt(shares), np.log1p(size), np.log1p(n_words), np.log1p(letters / many), np.bincount(text, minlength=n) / many, top / many, repeated / many])
    return text, cell, value / np.maximum(norm, 1e-12)[text], stats


@dataclass
class Machine:
    """Weights of the factorisation machine and the scales of the statistics."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    edges: np.ndarray  # inner edges of the bins of each statistic
    constant: float | None = None

    def inputs(self, data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, feature, value) in the order of texts."""
        text, cell, value, stats = features(data)
        n, s = stats.shape
        scaled = np.clip((stats - self.mean) / self.spread, -4, 4) / np.sqrt(s)
        binned = np.sum(stats[:, :, None] > self.edges[None], -1) + np.arange(s) * BINS
        rows = np.repeat(np.arange(n), s)
        t = np.concatenate([text, rows, rows])
        order = np.argsort(t, kind="stable")
        f = np.concatenate([cell, np.tile(CELLS + np.arange(s), n), (CELLS + s + binned).reshape(-1)])
        x = np.concatenate([value, scaled.reshape(-1), np.full(n * s, 1 / np.sqrt(s))])
        return t[order], f[order], x[order]

    def raw(self, text: np.ndarray, feature: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
        starts = np.searchsorted(text, np.arange(n))
        vx = self.factors[feature] * x[:, None].astype(np.float32)
        total, squares = np.add.reduceat(vx, starts, axis=0), np.add.reduceat(vx * vx, starts, axis=0)
        return self.bias + np.add.reduceat(self.linear[feature] * x, starts) + 0.5 * (total * total - squares).sum(1)

    def score(self, data: list[bytes]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(data), self.constant)
        if not data:
            return np.empty(0)
        return 1 / (1 + np.exp(-np.clip(self.raw(*self.inputs(data), len(data)), -30, 30)))


def fit(data: list[bytes], label: np.ndarray, seed: int = 11) -> Machine:
    """The machine fitted by steps of adaptive length on the logistic loss."""
    s = len(STATS)
    size = CELLS + s + s * BINS
    rng = np.random.default_rng(seed)
    ones = float(label.sum())
    if not 0 < ones < len(label):
        return Machine(0.0, np.zeros(size), np.zeros((size, RANK), np.float32), np.zeros(s), np.ones(s), np.zeros((s, BINS - 1)), (ones + 0.5) / (len(label) + 1.0))
    parts = [features(data[a:a + n]) for a, n in slices([len(t) for t in data])]
    stats = np.concatenate([p[3] for p in parts])
    edges = np.quantile(stats, np.arange(1, BINS) / BINS, axis=0).T
    m = Machine(float(np.log(ones / (len(label) - ones))), np.zeros(size), (rng.standard_normal((size, RANK)) * 0.03).astype(np.float32), stats.mean(0), np.maximum(stats.std(0), 1e-6), edges)
    texts_, features_, values = [], [], []
    done = 0
    for a, n in slices([len(t) for t in data]):
        t, f, x = m.inputs(data[a:a + n])
        texts_.append(t + done)
        features_.append(f)
        values.append(x)
        done += n
    text, feature, value = np.concatenate(texts_), np.concatenate(features_), np.concatenate(values)
    starts = np.r_[np.searchsorted(text, np.arange(len(data))), len(text)]
    seen_linear, seen_factors, seen_bias = np.full(size, 1e-8), np.full((size, RANK), 1e-8, np.float32), 1e-8
    for _ in range(PASSES):
        order = rng.permutation(len(data))
        for a in range(0, len(order), LOT):
            own = order[a:a + LOT]
            length = starts[own + 1] - starts[own]
            ends = np.cumsum(length)
            at = np.repeat(starts[own] - (ends - length), length) + np.arange(ends[-1])
            row = np.repeat(np.arange(len(own)), length)
            f, x = feature[at], value[at]
            v = m.factors[f]
            vx = v * x[:, None].astype(np.float32)
            total = np.add.reduceat(vx, ends - length, axis=0)
            raw = m.bias + np.add.reduceat(m.linear[f] * x, ends - length) + 0.5 * (total * total - np.add.reduceat(vx * vx, ends - length, axis=0)).sum(1)
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - label[own]) / len(own)
            distinct, where = np.unique(f, return_inverse=True)
            by_feature = np.argsort(where, kind="stable")
            cuts = np.searchsorted(where[by_feature], np.arange(len(distinct)))
            slope = error[row] * x
            g = np.add.reduceat(slope[by_feature], cuts) + SHRINK * m.linear[distinct]
            gv = np.add.reduceat((slope[:, None] * (total[row] - vx)).astype(np.float32)[by_feature], cuts, axis=0) + np.float32(SHRINK) * m.factors[distinct]
            seen_linear[distinct] += g * g
            seen_factors[distinct] += gv * gv
            seen_bias += float(error.sum()) ** 2
            m.linear[distinct] -= 2 * STEP * g / np.sqrt(seen_linear[distinct])
            m.factors[distinct] -= STEP * gv / np.sqrt(seen_factors[distinct])
            m.bias -= STEP * float(error.sum()) / np.sqrt(seen_bias)
    return m


def train_machine(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train: Column | None = None, sample: int = SAMPLE) -> Machine:
    """The machine fitted on the first labelled ids by hash, each with the first of its texts by hash; `train` says which rows of `labels` may be learned from."""
    allowed = F.lit(True) if train is None else train
    rows = labels.filter(quoted(label_col).isNotNull() & quoted(id_col).isNotNull() & allowed).groupBy(quoted(id_col).alias("id")).agg(F.max(quoted(label_col)).cast("int").alias("label"))
    chosen = F.broadcast(rows.orderBy(F.xxhash64("id"), "id").limit(sample))  # at most `sample` ids
    learned = one_text(docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text")).join(chosen, "id")).select("id", "text", "label")

    def run(batches):
        data, label, ids = [], [], []
        for batch in batches:
            data += texts(batch.column(1))
            label += batch.column(2).to_pylist()
            ids += [str(i) for i in batch.column(0).to_pylist()]
        order = sorted(range(len(ids)), key=lambda i: (ids[i], data[i]))  # the same fit however the rows arrive
        if order:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit([data[i] for i in order], np.array([label[i] for i in order], np.float64)))], pa.binary())], ["model"])

    fitted = learned.repartition(1).mapInArrow(run, "model binary").collect()
    if fitted:
        return pickle.loads(fitted[0]["model"])
    return Machine(0.0, np.zeros(0), np.zeros((0, RANK), np.float32), np.zeros(0), np.ones(0), np.zeros((0, 0)), 0.5)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train: Column | None = None, keep_text: bool = True, sample: int = SAMPLE) -> DataFrame:
    """Add score (probability of label 1) and predicted (1 if the score is at least 0.5) to each row."""
    sent = docs.sparkSession.sparkContext.broadcast(train_machine(docs, labels, id_col, text_col, label_col, train, sample))

    def make():
        machine = sent.value

        def work(data: list[bytes]) -> list[pa.Array]:
            s = machine.score(data)
            return [pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())]

        return work

    return add_from_text(docs, text_col, [("score", DoubleType()), ("predicted", IntegerType())], make, keep_text)
