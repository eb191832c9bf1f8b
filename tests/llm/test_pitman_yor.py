"""The Pitman-Yor model against direct computation."""
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graftline.llm import pitman_yor as py

ROWS = [(0, "The cat sat. The cat ran", "x"), (1, None, "x"), (2, "", None), (3, " \t\n ", "y"), (4, "the CAT sat on the mat " * 400, "y"), (5, "Öl und öl, ÖL", "z"), (5, "Öl und öl, ÖL", "z"), (None, "a dog the cat", "z"),
        (11, "nul\x00 in a word", "z"), (12, "new words only", "z")]


def split(text):
    low = (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))
    return re.findall(rb"[^\x20\x09-\x0D]+", low) + [None]


def learn(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 != 0


@pytest.fixture(scope="module")
def scored(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, score string").repartition(3)
    model = py.fit(docs, F.crc32(F.col("doc_id").cast("string")) % 10 != 0, burn=1, samples=2)
    return model, py.score(docs, model, ["doc_id"]).collect()


def test_base(scored):
    count = Counter(w for i, t, _ in ROWS if learn(i) for w in split(t))
    n, v = sum(count.values()), len(count)
    want = sorted((i is None, i or 0, len(split(t)), sum(count[w] > 0 for w in split(t)), round(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in split(t)), 6)) for i, t, _ in ROWS)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in scored[1])
    assert got == want and {r["train_tokens"] for r in scored[1]} == {n}
    assert all(-1e6 < r["score"] < 0 for r in scored[1])


def test_probabilities_sum_to_one(scored):
    """Over the training words and the unknown one, in seen and unseen restaurants; scores are the sums of their logarithms."""
    model, got = scored
    contexts = model.contexts.value
    judge = py.Predictor(contexts, model.totals, 1 / (model.train_words + 1))
    rows = model.seatings.toArrow().to_batches()
    assert model.buckets == 1
    for batch in rows:
        for i in range(batch.num_rows):
            judge.add(batch, i)
    assert len(judge.words) == model.train_words and len(judge.samples) == 2
    for ctx in [0, 1, 77, *range(py.CLASSES, contexts.size)]:
        p, _ = judge(np.r_[judge.words, np.uint64(12345)], np.full(len(judge.words) + 1, ctx))
        assert abs(p.sum() - 1) < 1e-9
    found = py.tokens([(t or "").encode() for _, t, _ in ROWS])
    p, _ = judge(found.word, contexts.of(found.before, found.before_cls))
    want = np.bincount(found.text, weights=np.log10(p))
    assert np.allclose(sorted(want), sorted(r["score"] for r in got))


def test_all_pairs_may_be_frequent_or_none(spark, scored, monkeypatch):
    want = sorted(r["score"] for r in scored[1])
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, score string").repartition(2)
    monkeypatch.setattr(py, "FREQUENT", 1)
    assert np.allclose(sorted(r["score"] for r in py.score(docs, scored[0], ["doc_id"]).collect()), want)


def test_many_buckets(spark, monkeypatch):
    """Buckets change the draws, not the base; every token still meets its word."""
    monkeypatch.setattr(py, "BUCKET_TOKENS", 100)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, score string").repartition(3)
    model = py.fit(docs, F.col("doc_id").isNotNull(), burn=0, samples=1)
    assert model.buckets > 20
    got = py.score(docs, model, ["doc_id"]).collect()
    assert all(r["n_known"] == r["n_tokens"] for r in got if r["doc_id"] is not None) and len(got) == len(ROWS)


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame(ROWS[:3], "doc_id long, text string, score string")
    got = py.score(docs, py.fit(docs, F.lit(None).cast("boolean")), ["doc_id", "score"])
    assert {(r["n_known"], r["train_tokens"]) for r in got.collect()} == {(0, 0)}
    none = py.score(docs.limit(0), py.fit(docs.limit(0), F.lit(True)), ["doc_id"])
    assert none.collect() == []


def test_seating_is_drawn_from_the_conditional():
    """Tables of 5 customers against all partitions, and the jumping seater (with its weights) against the exact numbers."""
    d, a, rng = 0.6, 0.9, np.random.default_rng(3)
    table = py.stirling(d, 30)
    exact = np.exp(table[5, 1:6] + np.log(a) * np.arange(1, 6))
    got = np.bincount(py.seat(np.full(200_000, 5), np.full(200_000, a), d, rng), minlength=6)[1:] / 200_000
    assert np.allclose(got, exact / exact.sum(), atol=0.005)
    t, weight = py._parties(np.full(200_000, 30), np.full(200_000, a), d, rng)
    got = np.bincount(t, weights=np.exp(weight - weight.max()), minlength=31)[1:]
    exact = np.exp(table[30, 1:] + np.log(a) * np.arange(1, 31))
    assert np.allclose(got / got.sum(), exact / exact.sum(), atol=0.005)
    t, weight = py._parties(np.full(100_000, 30), np.full(100_000, a), d, rng, large=8)  # blocks
    blocks = np.bincount(t, weights=np.exp(weight - weight.max()), minlength=31)[1:]
    assert np.allclose(blocks / blocks.sum(), exact / exact.sum(), atol=0.02)
    assert np.allclose(py.lgamma(np.array([0.1, 1.0, 7.5, 1e6])), [math.lgamma(x) for x in (0.1, 1.0, 7.5, 1e6)])
    assert py.seat(np.array([0, 1]), np.array([1.0, 1.0]), d, rng).tolist() == [0, 1]


def test_held_out_text_is_likelier_than_by_the_base(spark):
    from __spark_entry__ import queries

    rows = queries()["op11_pitman_yor"](spark, "/root/testdata/sf0.001").where("held_out").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows) + 0.2 * sum(r["n_tokens"] for r in rows)


@pytest.mark.parametrize("a", [0.02, 3.0, 400.0])
def test_blocks_seat_like_single_customers(a):
    """Mean and spread of the tables of 3,000 customers, and the effective weights, with and without blocks."""
    d, rng = 0.75, np.random.default_rng(8)
    c = np.full(3_000, 3_000)
    one, w1 = py._parties(c, np.full(len(c), a), d, rng, large=3_000)
    many, w2 = py._parties(c, np.full(len(c), a), d, rng)
    assert abs(one.mean() - many.mean()) < 0.02 * one.mean() + 4 * one.std() / 50
    assert 0.85 < (one.std() + 0.05) / (many.std() + 0.05) < 1.18
    assert abs(w1.mean() - w2.mean()) < 0.1 + 5 * w1.std() / 50
