"""Language-model scoring with a hierarchical Pitman-Yor model over words.

Restaurants.  A token is served in the restaurant of the word before it (a text starts after an end).  A word with at least 1 of
CONTEXTS training tokens has a restaurant of its own, so there can be no more than CONTEXTS of them; its parent is the restaurant of its
class (words with the same two last bytes, hashed to CLASSES classes), and words too rare for a restaurant of their own are served in
their class directly.  All classes share the root, whose base is uniform over the V training words and one unknown word.  Every table
of a restaurant is a customer of its parent.

Seating.  The customers of all restaurants that eat one dish (word) lie together, so all that a dish needs from elsewhere are the
totals of the at most CONTEXTS + CLASSES + 1 restaurants.  A sweep is one step of blocked Gibbs sampling: for every dish in every
restaurant the whole seating is drawn anew, given the parent's predictive probability and the totals that the sweep before left (all
dishes of a sweep at the same time).  Up to EXACT customers the number of tables is drawn from its exact distribution (generalised
Stirling numbers); above, PROPOSALS parties are seated by the Chinese restaurant rule, jumping from one new table to the next by
stick breaking (from LARGE customers on in blocks of an eighth of those seated, with the mean chance of a block), and one is drawn by importance.  After `burn` sweeps the seatings of `samples` sweeps are kept, and the probability of a
token is the mean of their predictive probabilities.

Spark.  Words are 64-bit hashes.  Counts of (word, context) are combined inside tasks, shuffled by bucket of the word, and merged there as
a stream; a bucket is a row of arrays.  Sweeps read and write those rows without a shuffle.  For scoring, texts send their tokens as
arrays per bucket and slice of texts, buckets answer with sums per document.  Pairs with at least 1 of FREQUENT training tokens
(no more than FREQUENT of them) are broadcast with their probability and are not sent, which keeps hot words out of the shuffle.

Cases: a null or empty text is one end; repeated rows are scored each by itself; without training tokens every word is unknown; null
`train` counts as false; an empty table gives an empty result; other columns named in `carry` come along, but for those with the name of an added one.
"""
from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graftline.llm.rows import quoted, slices, small_batches, texts
from graftline.llm.words import lower, mix, powers
from graftline.plans.lineage import shared_folder

#: Most restaurants of single words; classes; most pairs broadcast; tokens a task holds before it sends them; tokens of a bucket;
#: documents whose sums a task holds before it sends them.
CONTEXTS, CLASSES, FREQUENT, HELD_TOKENS, BUCKET_TOKENS, HELD_SUMS = 4_096, 256, 100_000, 1_000_000, 500_000, 500_000
#: Discount and strength of the root, of classes, of words.
DISCOUNT, STRENGTH = (0.6, 0.75, 0.85), (1.0, 1.0, 1.0)
EXACT, PROPOSALS, LARGE = 24, 4, 256
END = np.uint64(0xE4D0E4D0E4D0E4D1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_IN_WORD = np.ones(256, bool)
_IN_WORD[[32, 9, 10, 11, 12, 13]] = False


@dataclass
class Tokens:
    """Tokens of a slice of texts in order, an end after each text: word, class of the word, text; words and classes before them."""

    word: np.ndarray
    cls: np.ndarray
    text: np.ndarray
    before: np.ndarray
    before_cls: np.ndarray


def tokens(data: list[bytes]) -> Tokens:
    raw = b"\n".join([*data, b""])
    low = lower(raw)
    inside = _IN_WORD[low]
    change = np.diff(inside.astype(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    upto = np.zeros(len(low) + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(low)), out=upto[1:])
    words = mix((upto[end] - upto[begin]) * powers(_BASE_INVERSE, len(low) + 1)[begin] + (end - begin).astype(np.uint64))
    last = low[end - 1].astype(np.int64)
    cls = (last * 31 + np.where(end - begin > 1, low[end - 2], 0) * 17) % (CLASSES - 1) + 1 if len(end) else np.empty(0, np.int64)
    size = np.array([len(t) + 1 for t in data], np.int64)
    upto_text = np.searchsorted(begin, np.cumsum(size))  # words before the end of each text
    word, every = np.insert(words, upto_text, END), np.insert(cls, upto_text, 0)
    text = np.repeat(np.arange(len(data)), np.diff(upto_text, prepend=0) + 1)
    return Tokens(word, every, text, np.r_[END, word[:-1]] if len(word) else word, np.r_[0, every[:-1]] if len(every) else every)


def distinct_sums(key: np.ndarray, n: np.ndarray | None = None, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys (of one or two parts), sums of n (or counts), and the first of each further array."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.empty(0, np.int64)
    many = np.diff(np.r_[first, len(k)]) if n is None else np.add.reduceat(n[order], first) if len(first) else np.empty(0, np.int64)
    return k[first], many, *[m[order][first] for m in more]


def bucket_of(word: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(word * np.uint64(0xD6E8FEB86659FD93)) % np.uint64(buckets)).astype(np.int64)


class Contexts:
    """Numbers of restaurants: 0 .. CLASSES-1 for classes, then single words in the order of their hashes."""

    def __init__(self, words: np.ndarray, classes: np.ndarray):
        order = np.argsort(words)
        self.words, self.classes = words[order], classes[order]
        self.size = CLASSES + len(words)

    def of(self, word: np.ndarray, cls: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return cls
        at = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
        return np.where(self.words[at] == word, CLASSES + at, cls)

    def parents(self, ctx: np.ndarray) -> np.ndarray:
        """The class a restaurant belongs to; a class's own number."""
        return np.r_[np.arange(CLASSES), self.classes][ctx]


# ---- seating ------------------------------------------------------------------------------
def lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for positive numbers, by Stirling's series after eight steps of the recurrence."""
    y = np.array(x, np.float64)
    shift = 0.0
    small = np.flatnonzero(y < 8)
    if len(small):
        shift = np.zeros_like(y)
        while len(small):
            shift[small] += np.log(y[small])
            y[small] += 1
            small = small[y[small] < 8]
    z = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y - shift


@functools.cache
def stirling(d: float, most: int = EXACT) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers: ways to seat c customers at t tables under discount d."""
    s = np.full((most + 1, most + 1), -np.inf)
    s[1, 1] = 0
    for c in range(1, most):
        for t in range(1, c + 2):
            stay = s[c, t] + np.log(c - d * t) if t <= c else -np.inf
            s[c + 1, t] = np.logaddexp(stay, s[c, t - 1])
    return s


def _parties(c: np.ndarray, a: np.ndarray, d: float, rng: np.random.Generator, large: int = LARGE) -> tuple[np.ndarray, np.ndarray]:
    """(tables, log weight) of customers seated one after the other by the Chinese restaurant rule.

    With x = seated - d * tables, the number of customers until the next new table is geometric with a Beta(x, a) chance of staying.
    From `large` customers on a block of them sits down at once; its new tables are binomial with the mean chance over the block, whose
    tables are counted to the middle of the block."""
    t, j, weight = np.ones(len(c), np.int64), np.ones(len(c), np.int64), np.zeros(len(c))
    live = np.flatnonzero(j < np.minimum(c, large))
    while len(live):
        x, al = j[live] - d * t[live], a[live]
        step = rng.geometric(np.maximum(1 - rng.beta(x, al), 1e-15))
        left = np.minimum(c[live], large) - j[live]
        new = step <= left
        m = np.where(new, step, left)
        weight[live] += lgamma(al + x + m) - lgamma(al + x)
        j[live] += m
        t[live] += new
        live = live[left > m]
    live = np.flatnonzero(j < c)
    while len(live):
        x, al = j[live] - d * t[live], a[live]
        m = np.minimum(j[live] // 8, c[live] - j[live])
        grown = m * (1 - d * al / (al + x + 0.5 * m))  # of x over the block
        grown = m * (1 - d * np.log1p(grown / (al + x)) * al / grown)
        chance = np.minimum(np.log1p(grown / (al + x)) * al / grown, 1.0)
        new = rng.binomial(m, chance)
        end = x + m - d * new
        # sum of log(a + x) over the block, its ends taken as the ends of a straight line
        lo, hi = al + x, al + end
        weight[live] += m * np.where(hi - lo > 1e-9 * lo, (hi * np.log(hi) - lo * np.log(lo)) / np.maximum(hi - lo, 1e-300) - 1, np.log(lo)) - 0.5 * np.log(hi / lo)
        j[live] += m
        t[live] += new
        live = live[j[live] < c[live]]
    return t, weight


def seat(c: np.ndarray, a: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Numbers of tables at which c customers of one dish sit, where a new table weighs `a`: strength + discount * tables, times the
    parent's probability of the dish."""
    t = np.minimum(c, 1).astype(np.int64)
    table = stirling(d)
    a = np.maximum(a, 1e-12)
    some = np.flatnonzero((c > 1) & (c <= EXACT))
    some = some[np.argsort(c[some], kind="stable")]
    edge = np.searchsorted(c[some], np.arange(2, EXACT + 2))
    for n in range(2, EXACT + 1):
        at = some[edge[n - 2]:edge[n - 1]]
        if len(at):
            weight = table[n, 1:n + 1] + np.log(a[at])[:, None] * np.arange(1, n + 1)
            upto = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
            t[at] = 1 + (upto < (rng.random(len(at)) * upto[:, -1])[:, None]).sum(axis=1)
    at = np.flatnonzero(c > EXACT)
    if len(at):
        tables, weight = _parties(np.repeat(c[at], PROPOSALS), np.repeat(a[at], PROPOSALS), d, rng)
        chance = (weight.reshape(-1, PROPOSALS) + rng.gumbel(size=(len(at), PROPOSALS))).argmax(axis=1)
        t[at] = tables.reshape(-1, PROPOSALS)[np.arange(len(at)), chance]
    return t


@dataclass
class Totals:
    """Customers and tables of all restaurants; the last is the root.  `share` is what a restaurant leaves to its parent."""

    customers: np.ndarray
    tables: np.ndarray
    unknown: float

    def of(self, ctx: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """(weight of all new tables, weight of everything) in the given restaurants."""
        new = STRENGTH[level] + DISCOUNT[level] * self.tables[ctx]
        return new, STRENGTH[level] + self.customers[ctx]


class Dishes:
    """Dishes of a bucket: where each dish's pairs lie, and the (dish, class) pairs above them.

    pairs: dish number, restaurant, customers; classes: the sorted keys dish * CLASSES + class that occur."""

    def __init__(self, many: np.ndarray, ctx: np.ndarray, count: np.ndarray, contexts: Contexts):
        self.dish, self.ctx, self.count = np.repeat(np.arange(len(many)), many), ctx, count
        self.n, self.single = len(many), ctx >= CLASSES
        self.keys, self.up = np.unique(self.dish * CLASSES + contexts.parents(ctx), return_inverse=True)
        self.owner, self.cls = self.keys // CLASSES, self.keys % CLASSES

    def above(self, t2: np.ndarray) -> np.ndarray:
        """Customers of the (dish, class) pairs: tables of the single words' restaurants, and the class's own tokens."""
        return np.bincount(self.up, weights=np.where(self.single, t2, self.count), minlength=len(self.keys)).astype(np.int64)

    def probabilities(self, t2: np.ndarray, t1: np.ndarray, t0: np.ndarray, totals: Totals) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Predictive probabilities of each dish in the root, in its classes, in its restaurants."""
        root = np.full(self.n, len(totals.tables) - 1)
        new, every = totals.of(root, 0)
        p0 = (np.bincount(self.owner, weights=t1, minlength=self.n) - DISCOUNT[0] * t0 + new * totals.unknown) / every
        new, every = totals.of(self.cls, 1)
        p1 = (self.above(t2) - DISCOUNT[1] * t1 + new * p0[self.owner]) / every
        new, every = totals.of(self.ctx, 2)
        p2 = np.where(self.single, (self.count - DISCOUNT[2] * t2 + new * p1[self.up]) / every, p1[self.up])
        return p0, p1, p2

    def first(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One table for every dish in every restaurant."""
        return np.ones(len(self.ctx), np.int64), np.ones(len(self.keys), np.int64), np.ones(self.n, np.int64)

    def sweep(self, t2: np.ndarray, t1: np.ndarray, t0: np.ndarray, totals: Totals, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p0, p1, _ = self.probabilities(t2, t1, t0, totals)
        t2 = t2.copy()
        at = np.flatnonzero(self.single)
        t2[at] = seat(self.count[at], totals.of(self.ctx[at], 2)[0] * p1[self.up[at]], DISCOUNT[2], rng)
        t1 = seat(self.above(t2), totals.of(self.cls, 1)[0] * p0[self.owner], DISCOUNT[1], rng)
        c0 = np.bincount(self.owner, weights=t1, minlength=self.n).astype(np.int64)
        root = np.full(self.n, len(totals.tables) - 1)
        return t2, t1, seat(c0, totals.of(root, 0)[0] * totals.unknown, DISCOUNT[0], rng)

    def tally(self, t2: np.ndarray, t1: np.ndarray, t0: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(customers, tables) of all restaurants, the root last."""
        at = self.single
        customers = np.bincount(self.ctx[at], weights=self.count[at], minlength=size + 1) + np.bincount(self.cls, weights=self.above(t2), minlength=size + 1)
        tables = np.bincount(self.ctx[at], weights=t2[at], minlength=size + 1) + np.bincount(self.cls, weights=t1, minlength=size + 1)
        customers[size], tables[size] = t1.sum(), t0.sum()
        return customers.astype(np.int64), tables.astype(np.int64)


# ---- jobs ---------------------------------------------------------------------------------
def _written(df: DataFrame, name: str, rows: int = 0) -> DataFrame:
    """The rows written to the shared folder (at most so many in a file) and read again; arrays of small numbers take little room there."""
    at = f"{shared_folder(df.sparkSession)}/pitman-yor-{uuid.uuid4().hex}-{name}"
    df.write.option("maxRecordsPerFile", rows).parquet(at)
    return df.sparkSession.read.parquet(at)


def _lists(flat: np.ndarray, many: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(many)].astype(np.int32)), pa.array(flat, kind))


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def _held(batches: Iterator[pa.RecordBatch], place: int, most: int = 1 << 19) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of rows with their texts, of bounded bytes."""
    for batch in batches:
        column = batch.column(place)
        for start, n in slices([0 if x is None else x for x in pa.compute.binary_length(column).to_pylist()], most):
            yield batch.slice(start, n), texts(column.slice(start, n))


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, cls, n) of the training texts, and one row without a word for the number of all tokens, learned or not."""

    def run(batches):
        held, waiting, every = [], 0, 0

        def send():
            word, cls, n = (np.concatenate(x) for x in zip(*held, strict=True))
            word, n, cls = distinct_sums(word, n, cls)
            return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(cls, pa.int32()), pa.array(n, pa.int64())], ["word", "cls", "n"])

        for part, data in _held(batches, 0):
            found = tokens(data)
            every += len(found.word)
            own = part.column(1).to_numpy(zero_copy_only=False).astype(bool)[found.text]
            word, n, cls = distinct_sums(found.word[own], None, found.cls[own])
            held.append((word, cls, n))
            waiting += len(word)
            if waiting > HELD_TOKENS:
                yield send()
                held, waiting = [], 0
        if held:
            yield send()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([0], pa.int32()), pa.array([every], pa.int64())], ["word", "cls", "n"])

    counted = docs.select(quoted(text_col), "train").mapInArrow(run, "word bigint, cls int, n bigint")
    return counted.groupBy("word", "cls").agg(F.sum("n").alias("n"))


def _sent_pairs(docs: DataFrame, text_col: str, contexts, buckets: int) -> DataFrame:
    """Per bucket and slice: words, number of pairs of each, contexts and counts of the training tokens."""

    def run(batches):
        own = contexts.value
        held, waiting = [], 0

        def send():
            word, ctx, n = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((ctx, word))
            word, ctx, n = word[order], ctx[order], n[order]
            first = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (ctx[1:] != ctx[:-1])])
            return _by_bucket(word[first], buckets, [(ctx[first], pa.int16()), (np.add.reduceat(n, first), pa.int32())], ["ctx", "n"])

        for part, data in _held(batches, 0):
            found = tokens(data)
            mine = part.column(1).to_numpy(zero_copy_only=False).astype(bool)[found.text]
            word, ctx = found.word[mine], own.of(found.before[mine], found.before_cls[mine])
            held.append((word, ctx, np.ones(len(word), np.int64)))
            waiting += len(word)
            if waiting > HELD_TOKENS:
                yield send()
                held, waiting = [], 0
        if waiting:
            yield send()

    return docs.select(quoted(text_col), "train").mapInArrow(run, "bucket int, word array<bigint>, many array<int>, ctx array<smallint>, n array<int>")


def _by_bucket(word: np.ndarray, buckets: int, columns: list[tuple[np.ndarray, pa.DataType]], names: list[str]) -> pa.RecordBatch:
    """One row per bucket of entries that are sorted by word: distinct words, entries of each, and the entries' columns."""
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    many = np.diff(np.r_[first, len(word)])
    bucket = bucket_of(word[first], buckets)
    order = np.argsort(bucket, kind="stable")
    entry = np.repeat(first[order], many[order]) + np.arange(len(word)) - np.repeat(np.cumsum(many[order]) - many[order], many[order])
    shown, words_in = np.unique(bucket[order], return_counts=True)
    entries_in = np.add.reduceat(many[order], np.r_[0, np.cumsum(words_in)[:-1]])
    return pa.RecordBatch.from_arrays([pa.array(shown, pa.int32()), _lists(word[first][order].view(np.int64), words_in, pa.int64()), _lists(many[order], words_in, pa.int32()),
                                       *[_lists(c[entry], entries_in, kind) for c, kind in columns]], ["bucket", "word", "many", *names])


#: A bucket: its words, pairs of each, their restaurants and customers; tables of the pairs, of the (word, class) pairs above them, of the
#: words; customers and tables of all restaurants as far as this bucket goes.
STATE = "bucket int, word array<bigint>, many array<int>, ctx array<smallint>, n array<bigint>, t2 array<bigint>, t1 array<bigint>, t0 array<bigint>, customers array<bigint>, tables array<bigint>"
_SEATS = ["t2", "t1", "t0", "customers", "tables"]
_SUMS = ["own", "n_tokens", "n_known", "base_score", "score"]


def _merged(sent: DataFrame, contexts) -> DataFrame:
    """One row per bucket with all its pairs, one table for each to begin with; slices are merged as they stream in."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, waiting = contexts.value, [], 0

        def merge():
            word, ctx, n = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((ctx, word))
            word, ctx, n = word[order], ctx[order], n[order]
            first = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (ctx[1:] != ctx[:-1])])
            return word[first], ctx[first], np.add.reduceat(n, first)

        for batch in batches:
            word = np.repeat(_flat(batch.column("word")).view(np.uint64), _flat(batch.column("many")))
            held.append((word, _flat(batch.column("ctx")).astype(np.int64), _flat(batch.column("n")).astype(np.int64)))
            waiting += len(word)
            if waiting > max(HELD_TOKENS, 2 * len(held[0][0])):
                held = [merge()]
                waiting = 0
        word, ctx, n = merge()
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        many = np.diff(np.r_[first, len(word)])
        dishes = Dishes(many, ctx, n, own)
        row = [word[first].view(np.int64), many, ctx, n, *_seated(dishes, dishes.first(), own)]
        kinds = [pa.int64(), pa.int32(), pa.int16(), *[pa.int64()] * 6]
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), *[_lists(x, np.array([len(x)]), k) for x, k in zip(row, kinds, strict=True)]],
                                         ["bucket", "word", "many", "ctx", "n", *_SEATS])

    return sent.groupBy("bucket").applyInArrow(run, STATE)


def _seated(dishes: Dishes, seats: tuple[np.ndarray, ...], contexts: Contexts) -> list[np.ndarray]:
    """Tables of a bucket and what they add to the totals."""
    return [*seats, *dishes.tally(*seats, contexts.size)]


def _dishes(batch: pa.RecordBatch, row: int, contexts: Contexts) -> tuple[Dishes, list[np.ndarray]]:
    one = {name: batch.column(name).slice(row, 1) for name in ("many", "ctx", "n", "t2", "t1", "t0")}
    many, ctx, n, t2, t1, t0 = (_flat(c).astype(np.int64) for c in one.values())
    return Dishes(many, ctx, n, contexts), [t2, t1, t0]


def _totals(state: DataFrame, contexts, v: int) -> Totals:
    """Totals of all restaurants: each task adds up the rows it holds, so no more than one row per restaurant and task is shuffled."""
    size = contexts.value.size + 1

    def run(batches):
        total = np.zeros((2, size), np.int64)
        for batch in batches:
            for i in (0, 1):
                total[i] += _flat(batch.column(i)).reshape(-1, size).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total[0]), pa.array(total[1])], ["ctx", "c", "t"])

    rows = state.select("customers", "tables").mapInArrow(run, "ctx bigint, c bigint, t bigint").groupBy("ctx").agg(F.sum("c").alias("c"), F.sum("t").alias("t")).collect()
    totals = np.zeros((2, size))
    for r in rows:
        totals[:, r["ctx"]] = r["c"], r["t"]
    return Totals(totals[0], totals[1], 1 / (v + 1))


def _swept(state: DataFrame, contexts, totals: Totals, seed: int) -> DataFrame:
    sent = state.sparkSession.sparkContext.broadcast(totals)

    def run(batches):
        own = contexts.value
        for batch in batches:
            for row in range(batch.num_rows):
                dishes, seats = _dishes(batch, row, own)
                new = dishes.sweep(*seats, sent.value, np.random.default_rng([seed, batch.column(0)[row].as_py()]))
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(row, 1) for i in range(5)], *[_lists(x, np.array([len(x)]), pa.int64()) for x in _seated(dishes, new, own)]], batch.schema.names)

    return state.mapInArrow(run, STATE)


@dataclass
class Model:
    """What scoring needs: restaurants, number of training tokens and words, totals of every kept seating, and the seatings themselves,
    one row per bucket and kept seating."""

    contexts: object
    train_tokens: int
    train_words: int
    buckets: int
    totals: list[Totals]
    seatings: DataFrame | None


def fit(docs: DataFrame, train: Column, text_col: str = "text", burn: int = 2, samples: int = 2, seed: int = 7) -> Model:
    """Learn from the rows for which `train` holds."""
    sc = small_batches(docs).sparkSession.sparkContext
    marked = docs.select(quoted(text_col), F.coalesce(train, F.lit(False)).alias("train"))
    counts = _written(word_counts(marked, text_col), "words")
    n = counts.agg(F.sum(F.when(F.col("word").isNotNull(), F.col("n"))).alias("n"), F.count("word").alias("v"), F.sum(F.when(F.col("word").isNull(), F.col("n"))).alias("every")).first()
    train_tokens, v, every = n["n"] or 0, n["v"], n["every"] or 0
    own = counts.where(F.col("word").isNotNull() & (F.col("n") * CONTEXTS >= train_tokens)).select("word", "cls").collect()  # at most CONTEXTS
    contexts = sc.broadcast(Contexts(np.array([r["word"] for r in own], np.int64).view(np.uint64), np.array([r["cls"] for r in own], np.int64)))
    buckets = max(1, -(-every // BUCKET_TOKENS))
    model = Model(contexts, train_tokens, v, buckets, [], None)
    if not train_tokens:
        return model
    state = _written(_merged(_sent_pairs(marked, text_col, contexts, buckets), contexts), "seats", 4)
    kept = []
    for sweep in range(burn + samples):
        state = _written(_swept(state, contexts, _totals(state, contexts, v), seed * 1000 + sweep), f"sweep-{sweep}", 4)
        if sweep >= burn:
            kept.append(state.drop("customers", "tables").withColumn("sample", F.lit(sweep - burn)))
            model.totals.append(_totals(state, contexts, v))
    model.seatings = kept[0]
    for k in kept[1:]:
        model.seatings = model.seatings.unionByName(k)
    return model


class Predictor:
    """Mean probability over the kept seatings, and the plain count, of (word, context) entries of one bucket."""

    def __init__(self, contexts: Contexts, totals: list[Totals], unknown: float):
        self.contexts, self.totals, self.unknown = contexts, totals, unknown
        self.words, self.counts, self.samples = np.empty(0, np.uint64), np.empty(0, np.int64), []

    def add(self, batch: pa.RecordBatch, row: int) -> None:
        dishes, seats = _dishes(batch, row, self.contexts)
        self.words = _flat(batch.column("word").slice(row, 1)).view(np.uint64)
        self.counts = np.bincount(dishes.dish, weights=dishes.count, minlength=dishes.n).astype(np.int64)
        self.pairs = dishes.dish * self.contexts.size + dishes.ctx
        self.keys, self.share = dishes.keys, dishes.count
        totals = self.totals[batch.column("sample")[row].as_py()]
        self.samples.append((totals, *dishes.probabilities(*seats, totals)))

    def __call__(self, word: np.ndarray, ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.words):
            return self._unseen(ctx), np.zeros(len(word), np.int64)
        at = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
        known = self.words[at] == word
        cls = self.contexts.parents(ctx)
        pair, key = at * self.contexts.size + ctx, at * CLASSES + cls
        at2, at1 = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1), np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        has2, has1 = known & (self.pairs[at2] == pair), known & (self.keys[at1] == key)
        mean = np.zeros(len(word))
        for totals, p0, p1, p2 in self.samples:
            p = np.where(known, p0[at], self._root(totals))
            new, every = totals.of(cls, 1)
            p = np.where(has1, p1[at1], new * p / every)
            new, every = totals.of(ctx, 2)
            mean += np.where(has2, p2[at2], np.where(ctx >= CLASSES, new * p / every, p))
        return mean / len(self.samples), np.where(known, self.counts[at], 0)

    def _root(self, totals: Totals) -> float:
        root = len(totals.tables) - 1
        new, every = totals.of(np.array([root]), 0)
        return float(new[0] * self.unknown / every[0])

    def _unseen(self, ctx: np.ndarray) -> np.ndarray:
        mean = np.zeros(len(ctx))
        for totals in self.totals:
            new, every = totals.of(self.contexts.parents(ctx), 1)
            p = self._root(totals) * new / every
            new, every = totals.of(ctx, 2)
            mean += np.where(ctx >= CLASSES, new * p / every, p)
        return mean / len(self.totals) if self.totals else np.full(len(ctx), self.unknown)


def _frequent(model: Model) -> DataFrame:
    """(word, ctx, p, n): probability and plain word count of the pairs with at least 1 of FREQUENT training tokens."""
    sent = model.seatings.sparkSession.sparkContext.broadcast((model.totals, model.train_tokens, 1 / (model.train_words + 1)))

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, n, unknown = sent.value
        judge = Predictor(model_contexts.value, totals, unknown)
        for batch in batches:
            for row in range(batch.num_rows):
                judge.add(batch, row)
        at = np.flatnonzero(judge.share * FREQUENT >= n)
        word, ctx = judge.words[judge.pairs[at] // judge.contexts.size], judge.pairs[at] % judge.contexts.size
        p, count = judge(word, ctx)
        yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(ctx, pa.int32()), pa.array(p), pa.array(count, pa.int64())], ["word", "ctx", "p", "n"])

    model_contexts = model.contexts
    return model.seatings.groupBy("bucket").applyInArrow(run, "word bigint, ctx int, p double, n bigint")


def score(docs: DataFrame, model: Model, carry: list[str], text_col: str = "text") -> DataFrame:
    """Columns `carry`, n_tokens, n_known, base_score and score (log10) of every row."""
    added = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    carry = [c for c in carry if c.lower() not in added]
    spark = small_batches(docs).sparkSession
    frequent = _frequent(model).collect() if model.seatings is not None else []  # at most FREQUENT pairs
    order = np.argsort(np.array([r["word"] for r in frequent], np.int64).view(np.uint64) * np.uint64(CONTEXTS + CLASSES) + np.array([r["ctx"] for r in frequent], np.uint64)) if frequent else []
    table = [np.array([frequent[i][c] for i in order], kind) for c, kind in (("word", np.int64), ("ctx", np.int64), ("p", np.float64), ("n", np.int64))]
    n, v = model.train_tokens, model.train_words
    sent = spark.sparkContext.broadcast((table[0].view(np.uint64) * np.uint64(CONTEXTS + CLASSES) + table[1].astype(np.uint64), *table, model.totals))
    contexts, buckets = model.contexts, model.buckets
    empty = {"word": pa.list_(pa.int64()), "many": pa.list_(pa.int32()), "ctx": pa.list_(pa.int16()), "doc": pa.list_(pa.int32())}

    def log_base(count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.1) / (n + 0.1 * (v + 1)))

    def ask(batches):
        key, word_of, ctx_of, p_of, n_of, _ = sent.value
        task, lot = TaskContext.get().partitionId() << 32, 0
        for part, data in _held(batches, 1, 1 << 21):
            found, lot = tokens(data), lot + 1
            ctx = contexts.value.of(found.before, found.before_cls)
            score, base, known = np.zeros(part.num_rows), np.zeros(part.num_rows), np.zeros(part.num_rows, np.int64)
            far = np.ones(len(ctx), bool)
            if len(key):
                mine = found.word * np.uint64(CONTEXTS + CLASSES) + ctx.astype(np.uint64)
                at = np.minimum(np.searchsorted(key, mine), len(key) - 1)
                near = (key[at] == mine) & (word_of[at].view(np.uint64) == found.word) & (ctx_of[at] == ctx)
                far, at = ~near, at[near]
                score += np.bincount(found.text[near], weights=np.log10(p_of[at]), minlength=part.num_rows)
                base += np.bincount(found.text[near], weights=log_base(n_of[at]), minlength=part.num_rows)
                known += np.bincount(found.text[near], minlength=part.num_rows)
            size = np.bincount(found.text, minlength=part.num_rows)
            whole = np.array([part.num_rows])
            own = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([lot % buckets], pa.int32()), pa.array([task + lot]), own, *[_lists(x, whole, t) for x, t in ((size, pa.int64()), (known, pa.int64()), (base, pa.float64()), (score, pa.float64()))],
                                              *[pa.nulls(1, t) for t in empty.values()]], names)
            order = np.flatnonzero(far)
            order = order[np.argsort(found.word[order], kind="stable")]
            if len(order):
                rows = _by_bucket(found.word[order], buckets, [(ctx[order], pa.int16()), (found.text[order], pa.int32())], ["ctx", "doc"])
                k = rows.num_rows
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.full(k, task + lot)), pa.nulls(k, own.type), *[pa.nulls(k, pa.list_(t)) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())], *rows.columns[1:]], names)

    names = ["bucket", "lot", *_SUMS, *empty]
    own = F.struct(*[quoted(c) for c in carry]).alias("own")
    shape = docs.select(own).schema["own"].dataType
    kind = shape.simpleString()
    sums = f"lot bigint, own array<{kind}>, n_tokens array<bigint>, n_known array<bigint>, base_score array<double>, score array<double>"
    asked = docs.select(own, quoted(text_col)).mapInArrow(ask, f"bucket int, {sums}, word array<bigint>, many array<int>, ctx array<smallint>, doc array<int>")
    if model.seatings is not None:  # seatings come first in their bucket
        here = model.seatings.select("bucket", "sample", "word", "many", "ctx", "n", "t2", "t1", "t0")
        asked = asked.withColumn("sample", F.lit(None).cast("int")).withColumns({c: F.lit(None).cast("array<bigint>") for c in ("n", "t2", "t1", "t0")})
        asked = asked.unionByName(here, allowMissingColumns=True)
    else:
        asked = asked.withColumn("sample", F.lit(None).cast("int"))
    asked = asked.repartition("bucket").sortWithinPartitions("bucket", F.col("sample").asc_nulls_last())

    def answer(batches):
        """Slices of texts with their own rows go on; of all others a task sends one row of sums per slice."""
        totals, unknown = sent.value[5], 1 / (v + 1)
        judge, of, found, held, kinds = None, None, {}, 0, None

        def send():
            for lot, (score, base, known) in found.items():
                whole = np.array([len(score)])
                yield pa.RecordBatch.from_arrays([pa.array([lot]), pa.nulls(1, kinds[0]), pa.nulls(1, kinds[1]), _lists(known.astype(np.int64), whole, pa.int64()), _lists(base, whole, pa.float64()), _lists(score, whole, pa.float64())], ["lot", *_SUMS])

        for batch in batches:
            kinds = [batch.schema.field(c).type for c in ("own", "n_tokens")]
            bucket, sample, lot = (batch.column(c).to_pylist() for c in ("bucket", "sample", "lot"))
            own = batch.column("own").is_valid().to_pylist()
            for i in range(batch.num_rows):
                if bucket[i] != of:
                    judge, of = Predictor(contexts.value, totals, unknown), bucket[i]
                if sample[i] is not None:
                    judge.add(batch, i)
                elif own[i]:
                    yield pa.RecordBatch.from_arrays([batch.column(c).slice(i, 1) for c in ("lot", *_SUMS)], ["lot", *_SUMS])
                else:
                    word = np.repeat(_flat(batch.column("word").slice(i, 1)).view(np.uint64), _flat(batch.column("many").slice(i, 1)))
                    ctx, doc = _flat(batch.column("ctx").slice(i, 1)).astype(np.int64), _flat(batch.column("doc").slice(i, 1))
                    p, count = judge(word, ctx)
                    new = np.stack([np.bincount(doc, weights=x) for x in (np.log10(p), log_base(count), count > 0)])
                    old = found.get(lot[i], np.empty((3, 0)))
                    width = max(new.shape[1], old.shape[1])
                    found[lot[i]] = np.pad(new, ((0, 0), (0, width - new.shape[1]))) + np.pad(old, ((0, 0), (0, width - old.shape[1])))
                    held += width - old.shape[1]
                    if held > HELD_SUMS:
                        yield from send()
                        found, held = {}, 0
        yield from send()

    def add_up(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of one slice of texts, its sums from all tasks added."""
        own, size, total = None, None, None
        for batch in batches:
            mine = batch.column("own").is_valid().to_pylist()
            for i in range(batch.num_rows):
                if mine[i]:
                    own, size = batch.column("own").slice(i, 1).flatten(), batch.column("n_tokens").slice(i, 1).flatten()
                new = np.stack([_flat(batch.column(c).slice(i, 1)).astype(np.float64) for c in _SUMS[2:]])
                width = max(new.shape[1], 0 if total is None else total.shape[1])
                total = np.pad(new, ((0, 0), (0, width - new.shape[1]))) + (0 if total is None else np.pad(total, ((0, 0), (0, width - total.shape[1]))))
        known, base, score = total
        yield pa.RecordBatch.from_arrays([*own.flatten(), size, pa.array(known.astype(np.int64)), pa.array(np.full(len(size), n)), pa.array(base), pa.array(score)], [*carry, *added])

    result = StructType([*shape.fields, *StructType.fromDDL("n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double").fields])
    return asked.mapInArrow(answer, sums).groupBy("lot").applyInArrow(add_up, result)
