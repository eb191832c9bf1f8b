"""Benchmark decontamination: items found in texts up to a share of edited words.

Words are the symbols.  The CGK random walk embeds an item, and every window of a text that has an item's size, into a longer string: at
each step it writes the symbol it stands on and a random bit, drawn from step and symbol, says whether it moves on.  Windows within a
small edit distance of an item come out within a small Hamming distance.  Each of `walks` walks has `tables` bit-sampling tables of
`sampled` steps; a window that agrees with an item of its size in all steps of one table is a candidate.  A candidate is verified by
the exact edit distance between the item and the best passage there, which must be at most `edits` of the item's words.

Windows are all places of all texts; those that cannot hold an item are left out before the walk, without loss: an item with e edits
keeps a run of at least (m - e) / (e + 1) of its m words, so a window without any such run (three words at most) of an item is no match.

The items are broadcast in blocks of bounded size, each of which goes over all texts; texts are never shuffled, and the matches of
a text are found where it lies.

Cases: null or empty texts and items without words match nothing; repeated rows and repeated items are reported each by itself; items
too short for an edit must stand word by word; further columns are left aside by `matches` and kept by `without_leaks`; an empty table gives an
empty result.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from graftline.llm.rows import quoted, small_batches, text_slices
from graftline.llm.words import mix, powers, words

#: Share of an item's words that may be edited; walks, tables of each, steps sampled by each; runs of words; words of a block of items.
EDITS, WALKS, TABLES, SAMPLED, RUN, BLOCK_WORDS = 0.2, 5, 8, 3, 3, 2_000_000


class Items:
    """A block of items: their words, the runs that a match must share, and the sampled tables."""

    def __init__(self, listed: list[bytes], edits: float = EDITS, walks: int = WALKS, tables: int = TABLES, sampled: int = SAMPLED):
        self.walks, self.tables, self.sampled = walks, tables, sampled
        w = words(listed)
        self.words = [w.hashes[w.first[i]:w.first[i + 1]] for i in range(len(listed))]
        self.size = np.diff(w.first)
        self.edits = np.floor(self.size * edits + 1e-9).astype(np.int64)
        run = np.minimum(RUN, np.maximum(1, -(-(self.size - self.edits) // (self.edits + 1))))
        self.runs: dict[int, tuple[np.ndarray, ...]] = {}
        for k in np.unique(run[self.size > 0]).tolist():
            h, at = w.window(k)
            own = run[w.text[at]] == k
            h, at = h[own], at[own]
            order = np.argsort(h, kind="stable")
            marks = np.zeros(1 << 22, bool)
            marks[h >> np.uint64(42)] = True
            self.runs[k] = h[order], w.text[at][order], (at - w.first[w.text[at]])[order], marks
        self.steps = {int(m): self.sampled_steps(int(m)) for m in np.unique(self.size)}
        with_words = np.flatnonzero(self.size > 0)
        keys = self.keys(w.hashes, w.first[with_words], self.size[with_words], w.first[with_words + 1])
        self.sorted = []
        for t in range(walks * tables):
            order = np.argsort(keys[t], kind="stable")
            self.sorted.append((keys[t][order], with_words[order]))

    def length(self, m: int) -> int:
        """Steps of the walk over m words, which moves on half a word a step."""
        return math.ceil(1.7 * m) + 2

    def sampled_steps(self, m: int) -> np.ndarray:
        """The steps each table samples (table, sample), drawn for the size."""
        return np.random.default_rng([m, 17]).integers(0, self.length(m), (self.walks * self.tables, self.sampled))

    def keys(self, hashes: np.ndarray, start: np.ndarray, size: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Keys (table, window) of the windows at `start` of these sizes, cut off at `limit`."""
        end = np.minimum(start + size, limit)
        steps = np.array([self.length(int(m)) for m in size]) if len(size) else size
        chosen = np.stack([self.steps[int(m)] for m in size], -1) if len(size) else np.empty((self.walks * self.tables, self.sampled, 0), np.int64)
        out = np.empty((self.walks * self.tables, len(start)), np.uint64)
        padded = np.append(hashes, np.uint64(0))
        for walk in range(self.walks):
            at = start.copy()
            written = np.zeros((int(steps.max(initial=0)), len(start)), np.uint64)
            for j in range(len(written)):
                inside = at < end
                symbol = np.where(inside, padded[np.minimum(at, len(hashes))], np.uint64(0))
                written[j] = symbol
                seed = np.uint64((walk * 1_000_003 + j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
                move = (mix(symbol ^ seed) >> np.uint64(40)) & np.uint64(1)
                at = at + (inside & (move == 1))
            which = np.arange(len(start))
            for table in range(walk * self.tables, (walk + 1) * self.tables):
                key = np.full(len(start), table, np.uint64) + size.astype(np.uint64) * np.uint64(1 << 20)
                for i, c in enumerate(powers(0xD6E8FEB86659FD93, self.sampled + 1)[1:]):
                    key += mix(written[chosen[table, i], which] + np.uint64(i + 1)) * c
                out[table] = mix(key)
        return out

    def possible(self, hashes: np.ndarray, text: np.ndarray, window) -> tuple[np.ndarray, np.ndarray]:
        """(start, size) of the windows that share a run with an item near its place there; starts may lie up to the edits before the text."""
        starts, sizes = [], []
        for k, (run, item, place, marks) in self.runs.items():
            h, at = window(k)
            marked = marks[h >> np.uint64(42)]
            h, at = h[marked], at[marked]
            low = np.searchsorted(run, h)
            hit = (low < len(run)) & (run[np.minimum(low, len(run) - 1)] == h)
            h, at, low = h[hit], at[hit], low[hit]
            n = np.searchsorted(run, h, "right") - low
            at = np.repeat(at, n)
            r = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            e = self.edits[item[r]]
            wide = 2 * e + 1
            shift = np.arange(wide.sum()) - np.repeat(np.cumsum(wide) - wide, wide) - np.repeat(e, wide)
            starts.append(np.repeat(at - place[r], wide) + shift)
            sizes.append(np.repeat(self.size[item[r]], wide))
            # a start belongs to the text of the run
            starts[-1] = np.where((starts[-1] >= 0) & (starts[-1] < len(text)) & (text[np.clip(starts[-1], 0, max(len(text) - 1, 0))] == np.repeat(text[at], wide)), starts[-1], -1) if len(text) else starts[-1]
        start, size = np.concatenate(starts or [np.empty(0, np.int64)]), np.concatenate(sizes or [np.empty(0, np.int64)])
        real = start >= 0
        both = np.unique(np.stack([start[real], size[real]]), axis=1) if real.any() else np.empty((2, 0), np.int64)
        return both[0], both[1]

    def candidates(self, hashes: np.ndarray, start: np.ndarray, size: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, item) pairs that agree in a table."""
        found = []
        for keys, (have, item) in zip(self.keys(hashes, start, size, limit), self.sorted, strict=True):
            low = np.searchsorted(have, keys)
            n = np.searchsorted(have, keys, "right") - low
            who = np.repeat(np.arange(len(keys)), n)
            r = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            found.append(np.stack([start[who], item[r]]))
        both = np.unique(np.concatenate(found, axis=1), axis=1)
        return both[0], both[1]


def best_passage(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """(distance, begin, end): the part of the passage with the smallest edit distance to the item, of several the shortest leftmost."""
    n = len(passage)
    unit = 2 * n + 2
    place = np.arange(n + 1)
    tilt = place * unit
    state = n - place  # cost * unit + n - begin: the smallest cost, then the latest begin, in one number
    for i, symbol in enumerate(item):
        step = state + unit
        step[1:] = np.minimum(step[1:], state[:-1] + unit * (passage != symbol))
        step[0] = (i + 1) * unit + n
        state = np.minimum.accumulate(step - tilt) + tilt
    cost, begin = state // unit, n - state % unit
    end = int(np.lexsort((place, place - begin, cost))[0])
    return int(cost[end]), int(begin[end]), end


def find(items: Items, data: list[bytes]) -> list[tuple[int, int, int, int, int]]:
    """(text, item, begin, end, distance) of verified passages, places in words; overlapping passages of an item count once, the best."""
    w = words(data)
    if not len(w.hashes):
        return []
    start, size = items.possible(w.hashes, w.text, w.window)
    if not len(start):
        return []
    start, item = items.candidates(w.hashes, start, size, w.first[w.text[start] + 1])
    out = []
    order = np.lexsort((start, w.text[start], item))
    seen: tuple[int, int, int] | None = None
    for p, i in zip(start[order].tolist(), item[order].tolist(), strict=True):
        text, e, m = int(w.text[p]), int(items.edits[i]), int(items.size[i])
        if seen and seen[:2] == (text, i) and p < seen[2]:
            continue  # a start inside the passage just searched
        low, high = max(int(w.first[text]), p - e), min(int(w.first[text + 1]), p + m + 3 * e + 1)
        passage = w.hashes[low:high]
        # an item's words that the passage lacks cost an edit each
        if int((~np.isin(items.words[i], passage)).sum()) > e:
            seen = (text, i, p + 1)
            continue
        distance, begin, end = best_passage(items.words[i], passage)
        if distance <= e:
            out.append((text, i, low + begin - int(w.first[text]), low + end - int(w.first[text]), distance))
            seen = (text, i, low + end)
        else:
            seen = (text, i, p + max(e, 1))
    return out


def _blocks(items: DataFrame, id_col: str, text_col: str, block_words: int):
    """Blocks of items (id, text), each of a bounded number of words."""
    slim = items.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"))
    total = slim.agg(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), r"[^0-9A-Za-z\u0080-￿]+")))).first()[0] or 0
    n = -(-2 * total // block_words) if total > block_words else 1
    for b in range(n):
        part = slim if n == 1 else slim.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == b)
        yield [(r["id"], (r["text"] or "").encode()) for r in part.collect()]


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
            edits: float = EDITS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per passage: id, item id, first_word, end_word (places in the text's words), distance (edited words), item_words."""
    sc = docs.sparkSession.sparkContext
    slim = small_batches(docs).select(quoted(id_col).alias(id_col), quoted(text_col))
    item_type = items.schema[item_id_col].dataType
    schema = StructType([slim.schema[0], StructField(item_id_col, item_type), *[StructField(c, IntegerType()) for c in ("first_word", "end_word", "distance", "item_words")]])
    result = docs.sparkSession.createDataFrame([], schema)
    for block in _blocks(items, item_id_col, item_text_col, block_words):
        sent = sc.broadcast([[t for _, t in block], [i for i, _ in block]])

        def run(batches, sent=sent):
            held = Items(sent.value[0], edits)
            ids = sent.value[1]
            for batch in batches:
                for start, _, data in text_slices(batch.column(1)):
                    if found := find(held, data):
                        text, item, *rest = zip(*found, strict=True)
                        size = [int(held.size[i]) for i in item]
                        yield pa.RecordBatch.from_pydict({id_col: batch.column(0).take(pa.array([start + t for t in text])), item_id_col: pa.array([ids[i] for i in item]),
                                                          **{c: pa.array(v, pa.int32()) for c, v in zip(("first_word", "end_word", "distance", "item_words"), [*rest, size], strict=True)}})

        result = result.unionByName(slim.mapInArrow(run, schema))
    return result


def without_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_text_col: str = "text", edits: float = EDITS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of `docs` whose text holds no item; decided where the rows lie, without a join."""
    sc = docs.sparkSession.sparkContext
    kept, place = small_batches(docs), docs.columns.index(text_col)
    for block in _blocks(items.withColumn("__n", F.lit(0)), "__n", item_text_col, block_words):
        sent = sc.broadcast([t for _, t in block])

        def run(batches, sent=sent):
            held = Items(sent.value, edits)
            for batch in batches:
                for start, n, data in text_slices(batch.column(place)):
                    leaks = {f[0] for f in find(held, data)}
                    yield batch.slice(start, n).filter(pa.array([i not in leaks for i in range(n)], pa.bool_()))

        kept = kept.select(*[quoted(c) for c in kept.columns]).mapInArrow(run, kept.schema)
    return kept
