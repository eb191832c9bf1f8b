"""Toxicity by the nearest labelled examples.

Terms are runs of 4 to 6 bytes of the lower-cased text (other than letters and digits count as blanks), those that toxic examples hold
more often than others by a chi-square of at least `least_chi2` and at least `least_lean` times as often, all of them (what nearly as many
clean examples hold says nothing about a text, and would make up nearly all postings).  Texts and examples are TF-IDF vectors over these
terms, document frequencies being counted over all documents.  Each text meets its `k` nearest examples by exact cosine.

The index is inverted and cut into blocks of BLOCK examples, like ones together.  For each term and block that holds it, it has the
postings (example, weight) and the largest weight.  The weights of a text's terms times those maxima bound its cosine with all examples
of a block; a text visits its blocks from the highest bound down and stops where a bound lies below its k-th cosine, so most postings
are never read and no neighbour is lost.  The texts of a slice visit their blocks together, one round for each place in that order.

Neighbours vote with their cosine squared, times the rows of their class that an example stands for, against
a prior of fixed weight; the share of toxic votes is the score, the neighbours are the evidence.  A text without any term gets the
smoothed share of toxic rows among the examples without any.

The examples are a bounded sample: the first `examples` labelled ids of each class by hash, each with the first of its texts by hash, as
far as their texts go into EXAMPLE_BYTES.  Terms, vectors and the index
are bounded by it and broadcast; documents are scanned where they lie and never shuffled.

Cases: null and empty texts have no term; without labels every score is 0; with one class only, all texts get its smoothed share;
repeated rows are scored each by itself; of contradicting labels of an id the larger holds; null labels and ids are no examples; other
columns stay, those with the name of an added column are replaced; an empty table gives an empty result.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from graftline.llm.rows import add_from_text, one_text, quoted, small_batches, text_slices
from graftline.plans.lineage import cut

#: Labelled rows of each class used as examples, and the most bytes of their texts; chi-square and lean towards toxic examples a term needs;
#: neighbours; weight of the prior; examples of a block.
EXAMPLES, EXAMPLE_BYTES, LEAST_CHI2, LEAST_LEAN, NEIGHBOURS, PRIOR, BLOCK = 4_000, 1 << 26, 25.0, 1.5, 15, 0.5, 64
#: Cosines are whole millionths; with the example's number they make one key, so that ties go to the smaller number.
_MICRO, _NUMBER_BITS = 1_000_000, 24
LENGTHS = (4, 5, 6)
_BITS = 22
_SHIFT = np.uint64(64 - _BITS)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_PLAIN = np.full(256, 32, np.uint8)
for _b in (*range(48, 58), *range(97, 123), *range(128, 256)):
    _PLAIN[_b] = _b
for _b in range(65, 91):
    _PLAIN[_b] = _b + 32


def grams(data: list[bytes]):
    """For each length: (keys of all runs inside a text, number of each run's text); a key holds the bytes themselves."""
    low = _PLAIN[np.frombuffer(b"".join([b" " + t + b" " for t in data]), np.uint8)].astype(np.uint64)
    size = np.array([len(t) + 2 for t in data], np.int64)
    text = np.repeat(np.arange(len(data), dtype=np.int32), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(low))
    key, have = np.zeros(len(low), np.uint64), 0
    for n in LENGTHS:
        for j in range(have, n):
            key[:max(len(low) - j, 0)] |= low[j:] << np.uint64(8 * j)
        have = n
        yield n, key | np.uint64(n << 56), left >= n, text


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often each occurs."""
    x = np.sort(x)
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.empty(0, np.int64)
    return x[first], np.diff(np.append(first, len(x)))


class Terms:
    """The chosen runs, and where they occur in texts."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(keys.astype(np.uint64))
        self.marks = np.zeros(1 << _BITS, bool)
        self.marks[(self.keys * _ODD) >> _SHIFT] = True

    def counts(self, data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, number of times), by text."""
        found = []
        width = max(len(self.keys), 1)
        if len(self.keys):
            for _, key, inside, text in grams(data):
                at = np.flatnonzero(self.marks[(key * _ODD) >> _SHIFT] & inside)
                place = np.minimum(np.searchsorted(self.keys, key[at]), len(self.keys) - 1)
                real = self.keys[place] == key[at]
                found.append(text[at][real].astype(np.int64) * width + place[real])
        both, n = distinct(np.concatenate(found) if found else np.empty(0, np.int64))
        return both // width, both % width, n


def _count_buckets(sample: DataFrame) -> DataFrame:
    """(bucket, toxic, clean): examples of each class that hold a run of the bucket; each task sends its non-empty buckets."""

    def run(batches):
        count = np.zeros((2, 1 << _BITS), np.int32)
        for batch in batches:
            label = batch.column(1).to_numpy()
            for start, n, data in text_slices(batch.column(0)):
                own = label[start:start + n]
                parts = [(text[inside].astype(np.uint64) << np.uint64(_BITS)) | ((key[inside] * _ODD) >> _SHIFT) for _, key, inside, text in grams(data)]
                both, _ = distinct(np.concatenate(parts))
                for c in (0, 1):
                    mine = both[own[(both >> np.uint64(_BITS)).astype(np.int64)] == c]
                    bucket, many = distinct((mine & np.uint64((1 << _BITS) - 1)).astype(np.int64))
                    count[c][bucket] += many.astype(np.int32)
        at = np.flatnonzero(count[0] | count[1])
        for lot in range(0, len(at), 100_000):
            b = at[lot:lot + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(count[1][b].astype(np.int64)), pa.array(count[0][b].astype(np.int64))], ["bucket", "toxic", "clean"])

    return sample.select("text", "label").mapInArrow(run, "bucket long, toxic long, clean long")


def _count_keys(sample: DataFrame, buckets: np.ndarray) -> DataFrame:
    """(key, toxic, clean) of the runs in the given buckets."""
    marks = np.zeros(1 << _BITS, bool)
    marks[buckets] = True
    sent = sample.sparkSession.sparkContext.broadcast(np.packbits(marks))

    def run(batches):
        marks = np.unpackbits(sent.value).astype(bool)
        for batch in batches:
            label = batch.column(1).to_numpy()
            for start, n, data in text_slices(batch.column(0)):
                keys, labels = [], []
                for _, key, inside, text in grams(data):
                    at = np.flatnonzero(marks[(key * _ODD) >> _SHIFT] & inside)
                    k, t = key[at], text[at]
                    order = np.lexsort((k, t))
                    k, t = k[order], t[order]
                    new = np.r_[True, (k[1:] != k[:-1]) | (t[1:] != t[:-1])] if len(k) else np.empty(0, bool)
                    keys.append(k[new])
                    labels.append(label[start:start + n][t[new]])
                k, y = np.concatenate(keys), np.concatenate(labels)
                every, many = distinct(k)
                toxic = np.bincount(np.searchsorted(every, k), weights=y, minlength=len(every)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(every.view(np.int64)), pa.array(toxic), pa.array(many - toxic)], ["key", "toxic", "clean"])

    return sample.select("text", "label").mapInArrow(run, "key long, toxic long, clean long").groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _chi2(n_toxic: int, n_clean: int) -> Column:
    """Chi-square of holding a term against being toxic, negative where clean examples hold it more."""
    a, b = F.col("toxic").cast("double"), F.col("clean").cast("double")
    c, d = n_toxic - a, n_clean - b
    value = (n_toxic + n_clean) * F.pow(a * d - b * c, 2) / F.greatest((a + b) * (c + d) * n_toxic * n_clean, F.lit(1e-9))
    return F.when(a * d > b * c, value).otherwise(-value)


class Index:
    """Block-max inverted index over the examples' unit vectors."""

    def __init__(self, width: int, rows: list[tuple[int, int, float, np.ndarray, np.ndarray]], idf: np.ndarray, k: int = NEIGHBOURS, prior: float = PRIOR):
        """rows: (id, label, rows it stands for, terms, counts); `idf` by term."""
        self.k, self.prior, self.idf = k, prior, idf
        weight = [r[2] for r in rows]
        toxic = sum(w for r, w in zip(rows, weight, strict=True) if r[1])
        self.share = toxic / sum(weight) if rows else 0.0
        empty = [r for r in rows if not len(r[3])]
        self.without = (sum(r[2] for r in empty if r[1]) + self.share) / (sum(r[2] for r in empty) + 1.0) if rows else 0.0
        vectors = {i: self.unit(r[3], r[4]) for i, r in enumerate(rows) if len(r[3])}
        # examples whose heaviest terms are the same lie together
        order = sorted(vectors, key=lambda i: (rows[i][3][np.argsort(-vectors[i], kind="stable")[:4]].tolist(), rows[i][0]))
        full = [rows[i] for i in order]
        self.size, self.blocks = len(full), -(-len(full) // BLOCK)
        self.ids, self.labels, self.weights = np.array([r[0] for r in full], np.int64), np.array([r[1] for r in full], np.int64), np.array([r[2] for r in full], np.float64)
        term = np.concatenate([r[3] for r in full]) if full else np.empty(0, np.int64)
        who = np.repeat(np.arange(self.size, dtype=np.int32), [len(r[3]) for r in full])
        by_term = np.argsort(term, kind="stable")
        term, self.who = term[by_term].astype(np.int64), who[by_term]
        self.weight = (np.concatenate([vectors[i] for i in order]) if full else np.empty(0))[by_term].astype(np.float32)
        # segments: the postings of one term in one block
        key = term * max(self.blocks, 1) + self.who // BLOCK
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
        self.segment, self.start = key[first], np.r_[first, len(key)].astype(np.int64)
        self.most = np.maximum.reduceat(self.weight, first) if len(first) else np.empty(0, np.float32)
        self.of_term = np.searchsorted(self.segment, np.arange(width + 1) * max(self.blocks, 1))

    def unit(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        w = (1 + np.log(counts)) * self.idf[terms]
        return w / np.sqrt((w * w).sum())

    def bounds(self, text: np.ndarray, term: np.ndarray, q: np.ndarray, n: int) -> np.ndarray:
        """(text, block): the most any example of the block can reach."""
        many = self.of_term[term + 1] - self.of_term[term]
        at = _runs(self.of_term[term], many)
        return np.bincount(np.repeat(text, many) * self.blocks + self.segment[at] % self.blocks, weights=np.repeat(q, many) * self.most[at], minlength=n * self.blocks).reshape(n, self.blocks)

    def nearest_of(self, text: np.ndarray, term: np.ndarray, count: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, k): numbers of the nearest examples with a term in common (-1 where there are no more) and their cosines; entries are sorted by text."""
        best = np.full((n, self.k), -1, np.int64)
        if len(text) and self.size:
            q = (1 + np.log(count)) * self.idf[term]
            q = q / np.sqrt(np.bincount(text, weights=q * q, minlength=n))[text]
            cuts = np.searchsorted(text, np.arange(n + 1))
            bound = self.bounds(text, term, q, n)
            turn = np.argsort(-bound, axis=1, kind="stable")
            live = np.unique(text)
            for place in range(self.blocks):
                block = turn[live, place]
                reach = bound[live, block]
                on = (reach > 0) & (reach + 2 / _MICRO >= (best[live].min(axis=1) >> _NUMBER_BITS) / _MICRO)
                live, block = live[on], block[on]
                if not len(live):
                    break
                best[live] = self._merged(best[live], self._keys(cuts, live, block, term, q))
        best = -np.sort(-best, axis=1)
        return np.where(best >= 0, (1 << _NUMBER_BITS) - 1 - (best & ((1 << _NUMBER_BITS) - 1)), -1), np.maximum(best >> _NUMBER_BITS, 0) / _MICRO

    def _keys(self, cuts: np.ndarray, live: np.ndarray, block: np.ndarray, term: np.ndarray, q: np.ndarray) -> np.ndarray:
        """(pair, example of the block): cosine and number as one key, -1 where the cosine is 0."""
        many = cuts[live + 1] - cuts[live]
        entry, pair = _runs(cuts[live], many), np.repeat(np.arange(len(live)), many)
        wanted = term[entry] * self.blocks + block[pair]
        at = np.minimum(np.searchsorted(self.segment, wanted), len(self.segment) - 1)
        met = self.segment[at] == wanted
        at, entry, pair = at[met], entry[met], pair[met]
        size = self.start[at + 1] - self.start[at]
        post = _runs(self.start[at], size)
        place = np.repeat(pair * BLOCK - block[pair] * BLOCK, size) + self.who[post]
        cosine = np.rint(np.bincount(place, weights=self.weight[post] * np.repeat(q[entry], size), minlength=len(live) * BLOCK) * _MICRO).astype(np.int64).reshape(-1, BLOCK)
        number = block[:, None] * BLOCK + np.arange(BLOCK)
        return np.where(cosine > 0, (cosine << _NUMBER_BITS) + (1 << _NUMBER_BITS) - 1 - number, -1)

    def _merged(self, held: np.ndarray, new: np.ndarray) -> np.ndarray:
        return np.partition(np.concatenate([held, new], axis=1), BLOCK, axis=1)[:, BLOCK:]

    def nearest(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(example, cosine) of the k nearest of one text, nearest first, ties by example."""
        who, cosine = self.nearest_of(np.zeros(len(terms), np.int64), terms, counts, 1)
        return who[0][who[0] >= 0], cosine[0][who[0] >= 0]

    def score_of(self, text: np.ndarray, term: np.ndarray, count: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores, and the nearest examples with their cosines."""
        who, cosine = self.nearest_of(text, term, count, n)
        if not self.size:
            return np.full(n, self.without), who, cosine
        vote = cosine**2 * np.where(who >= 0, self.weights[who], 0)
        score = ((vote * self.labels[who]).sum(axis=1) + self.prior * self.share) / (vote.sum(axis=1) + self.prior)
        return np.where(who[:, 0] >= 0, score, self.without), who, cosine


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start .. start + size - 1 of each run, one after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def examples(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int, train: Column, most_bytes: int = EXAMPLE_BYTES) -> tuple[DataFrame, dict[int, float]]:
    """(id, label, text) of the sample, one row for each id, written to the shared folder, and for each class the labelled rows an example stands for."""
    rows = labels.filter(quoted(label_col).isNotNull() & quoted(id_col).isNotNull() & train).groupBy(quoted(id_col).alias("id")).agg(F.max(quoted(label_col)).cast("int").alias("label"))
    total = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    first = [rows.filter(F.col("label") == c).orderBy(F.xxhash64("id"), "id").limit(most) for c in (0, 1)]
    chosen = F.broadcast(first[0].unionByName(first[1]))  # at most twice `most` ids
    sample = cut(one_text(docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text")).join(chosen, "id")))
    size = F.coalesce(F.sum(F.octet_length("text")).over(Window.partitionBy("label").orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sized = sample.select("id", "label", (size < most_bytes).alias("fits"))  # at most twice `most` rows
    n = {r["label"]: (r["n"], r["kept"]) for r in sized.groupBy("label").agg(F.count("*").alias("n"), F.count_if("fits").alias("kept")).collect()}
    kept = sample.join(F.broadcast(sized.where("fits").select("id")), "id", "left_semi")
    return kept, {c: max(every / min(every, most), 1.0) * (n[c][0] / n[c][1] if c in n else 1.0) for c, every in total.items()}


def _numbers(df: DataFrame) -> np.ndarray:
    """One column of whole numbers on the driver; at most as many as the sample's bytes hold."""
    return df.toArrow().column(0).to_numpy().astype(np.int64)


def build_index(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train: Column | None = None,
                most: int = EXAMPLES, least_chi2: float = LEAST_CHI2, least_lean: float = LEAST_LEAN) -> tuple[np.ndarray, Index]:
    """The chosen terms and the index of the examples."""
    sc = small_batches(docs).sparkSession.sparkContext
    sample, stands = examples(docs, labels, id_col, text_col, label_col, most, F.lit(True) if train is None else train)
    n = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    keys = np.empty(0, np.uint64)
    if n_toxic and n_clean:
        counted = _count_buckets(sample).groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        buckets = _numbers(counted.filter(_chi2(n_toxic, n_clean) >= least_chi2).select("bucket"))
        if len(buckets):
            leans = F.col("toxic") * n_clean >= F.col("clean") * F.lit(least_lean * n_toxic)
            chosen = _count_keys(sample, buckets).filter((_chi2(n_toxic, n_clean) >= least_chi2) & leans)
            keys = np.sort(_numbers(chosen.select("key")).view(np.uint64))
    sent = sc.broadcast(keys)

    def frequencies(batches):
        own = Terms(sent.value)
        n, total = np.zeros(len(own.keys) + 1, np.int64), 0
        for batch in batches:
            for _, _, data in text_slices(batch.column(0)):
                _, term, _ = own.counts(data)
                n[:-1] += np.bincount(term, minlength=len(own.keys))
            total += batch.num_rows
        n[-1] = total
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n)], ["term", "n"])

    def vectors(batches):
        own = Terms(sent.value)
        for batch in batches:
            for start, many, data in text_slices(batch.column(0)):
                text, term, count = own.counts(data)
                cuts = np.r_[0, np.cumsum(np.bincount(text, minlength=many))].astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(start, many), batch.column(2).slice(start, many), pa.ListArray.from_arrays(pa.array(cuts), pa.array(term)),
                                                  pa.ListArray.from_arrays(pa.array(cuts), pa.array(count.astype(np.int64)))], ["id", "label", "terms", "counts"])

    df = {r["term"]: r["n"] for r in docs.select(quoted(text_col)).mapInArrow(frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()} if len(keys) else {}
    held = sample.select("text", "id", "label").mapInArrow(vectors, StructType([sample.schema["id"], sample.schema["label"], StructField("terms", ArrayType(LongType())), StructField("counts", ArrayType(LongType()))])).toArrow().combine_chunks()
    total = df.get(len(keys), 0)
    idf = np.log((1 + total) / (1 + np.array([df.get(i, 0) for i in range(len(keys))], np.float64))) + 1 if len(keys) else np.empty(0)
    ids, label = held.column("id").to_pylist(), held.column("label").to_pylist()
    size = pc.list_value_length(held.column("terms")).to_numpy()
    ends = np.cumsum(size)
    term, count = (pa.concat_arrays([c.flatten() for c in held.column(name).chunks]).to_numpy() if held.num_rows else np.empty(0, np.int64) for name in ("terms", "counts"))
    return keys, Index(len(keys), [(ids[i], label[i], stands[label[i]], term[e - s:e], count[e - s:e].astype(np.float64)) for i, (s, e) in enumerate(zip(size.tolist(), ends.tolist(), strict=True))], idf)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train: Column | None = None, keep_text: bool = True, most: int = EXAMPLES) -> DataFrame:
    """Add score, predicted (1 if the score is at least 0.5) and evidence: up to three nearest examples (id, label, cosine).

    `labels` has the ids and labels; `train` says which of its rows may be learned from.  Ids must be whole numbers."""
    keys, index = build_index(docs, labels, id_col, text_col, label_col, train, most)
    sent = docs.sparkSession.sparkContext.broadcast((keys, index))
    evidence = ArrayType(StructType([StructField("example", LongType()), StructField("label", IntegerType()), StructField("cosine", DoubleType())]))

    def make():
        keys, index = sent.value
        own = Terms(keys)

        def work(data: list[bytes]) -> list[pa.Array]:
            text, term, count = own.counts(data)
            scores, who, cosine = index.score_of(text, term, count.astype(np.float64), len(data))
            shown = who[:, :3] >= 0
            near = who[:, :3][shown]
            proof = pa.StructArray.from_arrays([pa.array(index.ids[near]), pa.array(index.labels[near], pa.int32()), pa.array(cosine[:, :3][shown])], ["example", "label", "cosine"])
            return [pa.array(scores, pa.float64()), pa.array(scores >= 0.5).cast(pa.int32()), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(shown.sum(axis=1))].astype(np.int32)), proof)]

        return work

    return add_from_text(docs, text_col, [("score", DoubleType()), ("predicted", IntegerType()), ("evidence", evidence)], make, keep_text)
