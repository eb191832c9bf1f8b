"""Near-duplicate texts by ProbMinHash, banding and exact verification.

A text's elements are its distinct runs of five words (a text of fewer words is one element), weighted 1 + log(times it repeats them).  Every
element sends arrivals of a Poisson process, whose rate is its weight, to random registers; a register keeps the element that arrives
first, so two texts agree in a register with the probability Jaccard of their weighted elements.  The process of an
element is drawn from its hash and stops at the time by which all registers of the text are filled.  Registers are cut into bands;
texts that share a band meet.

Two texts are linked if the probability Jaccard of their weighted elements is at least `threshold`, or the plain Jaccard of the sets;
both are worked out exactly for every pair that meets.  They differ only where a text repeats an element, so such a text sends the bands
of a second set of registers with all weights one, and any other text has both at once.

Texts with equal words are one node from the start.  In each bucket the node with most company leads and is compared with the others
(stars, not pairs); a second star runs among those the first did not join; then what still lies in different components is compared
pair by pair, left out only where the triangle inequality of the Jaccard distance (by the distances to the leader), the sizes or the
share of elements that a text has alone rule a link out for both similarities (one minus either is a distance).  Classes are the connected components of the links.

With 32 bands of 6 registers a pair at 0.8 is missed with probability 6e-5, at 0.85 with 4e-7, in either similarity.

Hot groups: copies collapse by a combined aggregation, buckets are joined by ordinary joins whose skewed partitions adaptive execution
splits, labels spread by minimum and pointer jumping.  Everything read again is written to the shared checkpoint folder.

Cases: texts without words (null, empty, punctuation) are in no class but their own; repeated rows and ids are copies like others;
class_id is the smallest id of the class (null if it has only null ids); further columns are left aside by `classes` and kept by
`keep_one`; an empty table gives an empty result.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

from graftline.llm.rows import quoted, small_batches, text_slices, texts
from graftline.llm.words import Words, mix, powers, words
from graftline.plans.lineage import cut

SHINGLE, THRESHOLD, BANDS, ROWS = 5, 0.8, 32, 6
ROWS_OF_A_PART = 200_000
_KEEP = np.uint64(20)  # bits of an element's hash left out where the text's number stands beside it
_TICKS = float(1 << 32)


def elements(w: Words, n_texts: int, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, count) of the distinct elements of each text, by text."""
    size = np.diff(w.first)
    h, at = w.window(shingle)
    text, hashes = [w.text[at]], [h]
    for k in range(1, shingle):  # short texts: the run of all their words
        if (size == k).any():
            h, at = w.window(k)
            whole = size[w.text[at]] == k
            text.append(w.text[at][whole])
            hashes.append(h[whole])
    if n_texts >= 1 << 20:
        raise ValueError("too many texts in one slice")
    key = np.sort((np.concatenate(text).astype(np.uint64) << np.uint64(44)) | (np.concatenate(hashes) >> _KEEP))
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    count = np.diff(np.r_[first, len(key)])
    key = key[first]
    return (key >> np.uint64(44)).astype(np.int64), key & np.uint64((1 << 44) - 1), count


def _arrivals(h: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Waiting time (in whole ticks, so that sums are exact) and random bits of the nth arrival of elements."""
    r = mix(h * np.uint64(0x9E3779B97F4A7C15) + nth.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    return (-np.log(((r >> np.uint64(16)).astype(np.float64) + 1.0) * 2.0**-48) * _TICKS).astype(np.int64), (r & np.uint64(0xFFFF)).astype(np.int64)


def prob_minhash(text: np.ndarray, h: np.ndarray, weight: np.ndarray, n_texts: int, registers: int) -> np.ndarray:
    """Register contents (hash of the element that arrived first) of each text; texts without elements keep zeros."""
    if not 2 <= registers <= 1 << 13:
        raise ValueError("between 2 and 8192 registers")
    signature = np.zeros(n_texts * registers, np.uint64)
    total = np.bincount(text, weights=weight, minlength=n_texts)
    limit = registers * (np.log(registers) + 3.0) / np.maximum(total, 1e-300)
    open_ = total > 0
    while open_.any():
        mine = open_[text]
        t, e, w = text[mine], h[mine], weight[mine]
        ticks, bits = _arrivals(e, np.zeros(len(e)))
        early = ticks / _TICKS / w <= limit[t]
        t, e, w, ticks = t[early], e[early], w[early], ticks[early]
        keys, times, owners = [t * registers + (bits[early] * registers >> 16)], [ticks / _TICKS / w], [e]
        nth = np.ones(len(e), np.int64)
        while len(e):  # further arrivals, as many at once as the time left lets expect
            left = np.maximum(limit[t] - ticks / _TICKS / w, 0) * w
            many = np.minimum(np.ceil(left + 2 * np.sqrt(left) + 1), 1 << 16).astype(np.int64)
            ends = np.cumsum(many)
            who = np.repeat(np.arange(len(e)), many)
            step, bits = _arrivals(e[who], nth[who] + np.arange(ends[-1]) - (ends - many)[who])
            run = np.cumsum(step)
            run += (ticks - np.r_[0, run[ends[:-1] - 1]])[who] if len(ends) > 1 else ticks[who]
            time = run / _TICKS / w[who]
            inside = time <= limit[t[who]]
            keys.append((t[who] * registers + (bits * registers >> 16))[inside])
            times.append(time[inside])
            owners.append(e[who][inside])
            more = time[ends - 1] <= limit[t]
            ticks, nth = run[ends - 1][more], (nth + many)[more]
            t, e, w = t[more], e[more], w[more]
        key, time, owner = np.concatenate(keys), np.concatenate(times), np.concatenate(owners)
        best = np.full(n_texts * registers, np.inf)
        np.minimum.at(best, key, time)
        filled = np.isfinite(best).reshape(n_texts, registers).all(1) & open_
        won = (time == best[key]) & filled[key // registers]
        signature[key[won]] = owner[won]
        open_ &= ~filled
        limit = np.where(open_, limit * 1.7, limit)
    return signature.reshape(n_texts, registers)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of each text."""
    parts = signature.reshape(len(signature), bands, rows)
    key = np.zeros(parts.shape[:2], np.uint64)
    for i, c in enumerate(powers(0xC2B2AE3D27D4EB4F, rows + 1)[1:]):
        key += mix(parts[:, :, i] + np.uint64(i)) * c
    return mix(key + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def digests(w: Words, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each text's words in order."""
    place = np.arange(len(w.hashes)) - w.first[w.text]
    out = []
    for base, salt in ((0xA24BAED4963EE407, 1), (0x9FB21C651E98DF25, 2)):
        upto = np.r_[np.uint64(0), np.cumsum(mix(w.hashes + np.uint64(salt)) * powers(base, int(place.max(initial=0)) + 1)[place], dtype=np.uint64)]
        out.append(mix(upto[w.first[1:]] - upto[w.first[:-1]] + np.diff(w.first).astype(np.uint64)).view(np.int64))
    return out[0][:n_texts], out[1][:n_texts]


def signatures(df: DataFrame, id_col: str, text_col: str, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, text_key, d1, d2, size, repeats, bands) of each row; all but the first two null where a text has no words.

    The keys of a band are the same for weighted and plain registers; a text that repeats an element has those of both."""
    slim = small_batches(df).select(quoted(id_col).alias("id"), F.xxhash64(quoted(text_col)).alias("text_key"), quoted(text_col))
    schema = StructType([slim.schema["id"], slim.schema["text_key"], StructField("d1", LongType()), StructField("d2", LongType()), StructField("size", IntegerType()), StructField("repeats", BooleanType()), StructField("bands", ArrayType(LongType()))])

    def run(batches):
        for batch in batches:
            for start, n, data in text_slices(batch.column(2)):
                w = words(data)
                text, h, count = elements(w, n)
                size = np.bincount(text, minlength=n)
                none = size == 0
                repeats = np.bincount(text, weights=count > 1, minlength=n) > 0
                keys = np.zeros((n, 2 * bands), np.uint64)
                keys[:, :bands] = keys[:, bands:] = band_keys(prob_minhash(text, h, 1 + np.log(count), n, bands * rows), bands, rows)
                if repeats.any():
                    mine = repeats[text]
                    few = np.cumsum(repeats) - 1
                    keys[repeats, bands:] = band_keys(prob_minhash(few[text[mine]], h[mine], np.ones(mine.sum()), int(repeats.sum()), bands * rows), bands, rows)
                d1, d2 = digests(w, n)
                sent = np.c_[np.ones((n, bands), bool), keys[:, bands:] != keys[:, :bands]]
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sent.sum(axis=1))].astype(np.int32)), pa.array(keys[sent].view(np.int64)), mask=pa.array(none))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, n), batch.column(1).slice(start, n), pa.array(d1, mask=none), pa.array(d2, mask=none), pa.array(size.astype(np.int32), mask=none),
                                                  pa.array(repeats, mask=none), lists], ["id", "text_key", "d1", "d2", "size", "repeats", "bands"])

    return slim.mapInArrow(run, schema)


def weighted_elements(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted full hashes of a text's elements, and their weights."""
    w = words([text])
    n = len(w.hashes)
    if not n:
        return np.empty(0, np.uint64), np.empty(0)
    h, count = np.unique(w.window(min(SHINGLE, n))[0], return_counts=True)
    return h, 1 + np.log(count)


def element_set(text: bytes) -> np.ndarray:
    """Sorted full hashes of a text's elements."""
    return weighted_elements(text)[0]


def similarities(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
    """(Jaccard of the sets, probability Jaccard of the weighted elements), both exact.

    The latter sums, over shared elements i, 1 / sum_j max(x_j / x_i, y_j / y_i); with the shared elements in order of x / y the inner
    sums are running sums."""
    (p, x), (q, y) = one, other
    _, at, bt = np.intersect1d(p, q, assume_unique=True, return_indices=True)
    union = len(p) + len(q) - len(at)
    if not len(at):
        return 0.0, 0.0
    plain = len(at) / union
    xs, ys = x[at], y[bt]
    if (x == 1).all() and (y == 1).all():
        return plain, plain
    ratio = xs / ys
    order = np.argsort(ratio, kind="stable")
    xs, ys, ratio = xs[order], ys[order], ratio[order]
    larger = np.cumsum(xs[::-1])[::-1]           # x of shared elements from this one on
    smaller = np.cumsum(ys) - ys                 # y of those before
    return plain, float((xs / (x.sum() - xs.sum() + larger + ratio * (y.sum() - ys.sum() + smaller))).sum())


def _verified(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """(a, b, jaccard, weighted) of the pairs (nodes a, b), from the texts of the nodes: both similarities."""
    a = held.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    b = held.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b")
    node = both.schema["a"].dataType
    schema = StructType([StructField("a", node), StructField("b", node), StructField("jaccard", DoubleType()), StructField("weighted", DoubleType())])

    def run(batches):
        known: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}

        def of(text: bytes) -> tuple[np.ndarray, np.ndarray]:
            got = known.get(text)
            if got is None:
                if len(known) >= 64:
                    known.clear()
                got = known[text] = weighted_elements(text)
            return got

        for batch in batches:
            for start, n, first in text_slices(batch.column(2)):
                part = batch.slice(start, n)
                both = [similarities(of(x), of(y)) for x, y in zip(first, texts(part.column(3)), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array([s[i] for s in both], pa.float64()) for i in (0, 1)]], ["a", "b", "jaccard", "weighted"])

    return both.mapInArrow(run, schema)


def _own_elements(held: DataFrame) -> DataFrame:
    """(node, own, own_share): the number of a text's elements that no other text of the table has, and their share of its weight, where there are any."""
    schema = StructType([StructField("element", LongType()), held.schema["node"], StructField("share", DoubleType())])

    def run(batches):
        for batch in batches:
            place = batch.schema.get_field_index("node")
            for start, n, data in text_slices(batch.column(batch.schema.get_field_index("text")), 1 << 18):
                sets = [weighted_elements(t) for t in data]
                who = np.repeat(np.arange(start, start + n), [len(h) for h, _ in sets])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([h for h, _ in sets]).view(np.int64)), batch.column(place).take(pa.array(who)), pa.array(np.concatenate([w / max(w.sum(), 1.0) for _, w in sets]))], ["element", "node", "share"])

    each = held.mapInArrow(run, schema)
    alone = each.groupBy("element").agg(F.count("*").alias("n"), F.min("node").alias("node"), F.min("share").alias("share")).filter("n = 1")
    return alone.groupBy("node").agg(F.count("*").alias("own"), F.sum("share").alias("own_share"))


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label): the smallest node each node is linked to, directly or not; by neighbours' minimum and pointer jumping."""
    # nodes are few beside the texts: no more partitions than they need, as each round writes them
    parts = nodes.count() // ROWS_OF_A_PART + 1
    both = cut(links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other"))).coalesce(4 * parts))
    state = cut(nodes.select("node", F.col("node").alias("label")).coalesce(parts))
    while True:
        told = both.join(state.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("heard"))
        lower = state.join(told, "node", "left").select("node", F.col("label").alias("was"), F.least("label", "heard").alias("label"))
        jump = state.select(F.col("node").alias("label"), F.col("label").alias("further"))
        after = cut(lower.join(jump, "label", "left").select("node", "was", F.least("label", "further").alias("label")).coalesce(parts))
        moved = after.filter("label <> was").limit(1).count()
        state = after.select("node", "label")
        if not moved:
            return state


def node_labels(rows: DataFrame, docs: DataFrame, id_col: str, text_col: str, threshold: float = THRESHOLD) -> DataFrame:
    """(node, label) of the nodes that share a bucket; `rows` are the written signatures."""
    node = F.struct("d1", "d2").alias("node")
    reps = rows.filter("d1 is not null").groupBy("d1", "d2").agg(F.first("size").alias("size"), F.first("bands").alias("bands"))
    members = reps.select(F.explode("bands").alias("key"), "d1", "d2")
    shared = members.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    crowded = cut(members.join(shared, "key").select("key", "n", node))
    company = crowded.groupBy("node").agg(F.sum("n").alias("company"))
    sizes = rows.filter("d1 is not null").groupBy("d1", "d2").agg(F.min(F.struct("id", "text_key")).alias("one"), F.min("size").alias("size"), F.min("repeats").alias("repeats")).select(node, "one", "size", "repeats")
    known = cut(company.join(sizes, "node"))
    # one text of each node that has company, met by id and text, as an id may be null or on many rows
    wanted = known.select(F.col("one.id").alias("w_id"), F.col("one.text_key").alias("w_key"), "node")
    slim = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"), F.xxhash64(quoted(text_col)).alias("text_key"))
    schema = StructType([known.schema["node"], StructField("text", slim.schema["text"].dataType)])

    def matching(batches):
        for batch in batches:
            asked = batch.column(0).flatten()
            for start, n, data in text_slices(batch.column(1)):
                d1, d2 = digests(words(data), n)
                same = (asked[0].slice(start, n).to_numpy() == d1) & (asked[1].slice(start, n).to_numpy() == d2)
                yield batch.slice(start, n).filter(pa.array(same)).select([0, 1])

    held = cut(slim.join(wanted, slim["id"].eqNullSafe(F.col("w_id")) & (slim["text_key"] == F.col("w_key"))).select("node", "text").mapInArrow(matching, schema).dropDuplicates(["node"]))
    facts = known.select("node", "company", "size", "repeats")
    with_facts = cut(crowded.join(facts, "node"))
    lead = F.max(F.struct("company", "node", "size", "repeats"))
    linked = (F.col("jaccard") >= threshold) | (F.col("weighted") >= threshold)
    links, tested = None, None
    labels = None
    for _ in range(2):
        asking = with_facts
        if labels is not None:  # the second star is among those the first did not join to its leader
            first = with_facts.groupBy("key").agg(lead.alias("l")).select("key", F.col("l.node").alias("leader"))
            asking = (with_facts.join(labels, "node").join(first, "key").join(labels.select(F.col("node").alias("leader"), F.col("label").alias("leaders")), "leader")
                      .filter("label <> leaders").select("key", "node", "company", "size", "repeats"))
        leaders = asking.groupBy("key").agg(lead.alias("l")).select("key", F.col("l.node").alias("a"), F.col("l.size").alias("size_a"), F.col("l.repeats").alias("repeats_a"))
        stars = asking.join(leaders, "key").filter("node <> a").filter((F.least("size", "size_a") >= threshold * F.greatest("size", "size_a")) | F.col("repeats") | F.col("repeats_a")).select("a", F.col("node").alias("b")).distinct()
        found = cut(_verified(stars, held))
        tested = found if tested is None else tested.unionByName(found)
        fresh = found.filter(linked)
        links = fresh if links is None else links.unionByName(fresh)
        labels = components(facts.select("node"), links)
    # what is left: pairs of one bucket in different components, the leader's own pairs being done
    first = with_facts.groupBy("key").agg(lead.alias("l")).select("key", F.col("l.node").alias("leader"))
    near = cut(with_facts.join(labels, "node").join(first, "key").filter("node <> leader")
               .join(cut(tested).select(F.col("a").alias("leader"), F.col("b").alias("node"), "jaccard", "weighted"), ["leader", "node"], "left")
               .select("key", "node", "label", "size", "repeats", *[F.coalesce(c, F.lit(-1.0)).alias(c) for c in ("jaccard", "weighted")]))
    split = near.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("key")
    mixed = cut(near.join(split, "key"))
    # elements that no other of these texts has cannot be shared: they bound both similarities of their text
    mixed = cut(mixed.join(_own_elements(held.join(mixed.select("node").distinct(), "node")), "node", "left").withColumns({"common": F.col("size") - F.coalesce("own", F.lit(0)), "shared": 1 - F.coalesce("own_share", F.lit(0.0))}))
    bands = rows.select(node, "bands").join(mixed.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
    mixed = cut(mixed.join(bands, "node"))
    columns = ("node", "label", "size", "repeats", "jaccard", "weighted", "common", "shared", "bands")
    x, y = (mixed.select("key", *[F.col(c).alias(f"{c}_{side}") for c in columns]) for side in "xy")
    shared = F.least("common_x", "common_y")

    def apart(c: str) -> Column:
        return (F.col(f"{c}_x") >= 0) & (F.col(f"{c}_y") >= 0) & (F.abs(F.col(f"{c}_x") - F.col(f"{c}_y")) > 1 - threshold + 1e-9)

    plain = (F.least("size_x", "size_y") >= threshold * F.greatest("size_x", "size_y")) & (shared >= threshold * (F.col("size_x") + F.col("size_y") - shared) - 1e-9) & ~apart("jaccard")
    # no coupling of the weights agrees more often than the weights that both can share
    weighted = (F.col("repeats_x") | F.col("repeats_y")) & (F.least("shared_x", "shared_y") >= threshold - 1e-9) & ~apart("weighted")
    possible = (F.col("node_x") < F.col("node_y")) & (F.col("label_x") != F.col("label_y")) & (plain | weighted)
    # a pair is looked at in the first band it shares
    met = F.element_at(F.array_intersect("bands_x", "bands_y"), 1) == x["key"]
    pairs = x.join(y, (x["key"] == y["key"]) & possible & met).select(F.col("node_x").alias("a"), F.col("node_y").alias("b")).distinct()
    rest = cut(_verified(pairs, held)).filter(linked)
    return components(facts.select("node"), links.unionByName(rest))


def _classed(docs: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """(id, text_key, class) of each row, written to the shared folder; the class is null for texts without words."""
    rows = cut(signatures(docs, id_col, text_col))
    labels = node_labels(rows, docs, id_col, text_col, threshold)
    node = F.when(F.col("d1").isNotNull(), F.struct("d1", "d2"))
    return cut(rows.select("id", "text_key", node.alias("node")).join(labels, "node", "left").select("id", "text_key", F.coalesce("label", "node").alias("class")))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: id, class_id (smallest id of its class), class_size (rows of the class)."""
    named = _classed(docs, id_col, text_col, threshold)
    whole = named.filter("class is not null").groupBy("class").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size"))
    alone = named.filter("class is null").select(F.col("id").alias(id_col), F.col("id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return named.filter("class is not null").join(whole, "class").select(F.col("id").alias(id_col), "class_id", "class_size").unionByName(alone)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` without all but one of each class: the smallest id stays, a null id only if there is no other; texts without
    words all stay.  Of several rows with that id and the same text one stays."""
    named = _classed(docs, id_col, text_col, threshold).filter("class is not null")
    counted = named.groupBy("class", "id", "text_key").agg(F.count("*").alias("n"))
    first = counted.groupBy("class").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "text_key")).alias("first"))
    marked = cut(counted.join(first, "class").select("id", "text_key", "n", (F.col("id").eqNullSafe(F.col("first.id")) & (F.col("text_key") == F.col("first.text_key"))).alias("stays")))
    keyed = docs.select(*[quoted(c) for c in docs.columns], F.xxhash64(quoted(text_col)).alias("__key"))

    same = quoted(id_col).eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__text"))
    gone = marked.filter(~F.col("stays")).select(F.col("id").alias("__id"), F.col("text_key").alias("__text"))
    kept = keyed.join(gone, same, "left_anti")
    again = marked.filter(F.col("stays") & (F.col("n") > 1)).select(F.col("id").alias("__id"), F.col("text_key").alias("__text"))
    if again.limit(1).count():
        once = kept.join(again, same, "left_semi").dropDuplicates([id_col, "__key"])
        kept = kept.join(again, same, "left_anti").unionByName(once)
    return kept.drop("__key")
