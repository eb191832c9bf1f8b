"""Hard negatives against all pairs, and the intervals against true scores."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from graftline.llm import hard_negatives as hn

SCHEMA = "id long, label int, vector array<double>, rank string"


def brute(rows, every, most=5):
    ok = [(i, y, [math.floor(256 * x) for x in v]) for i, y, v, *_ in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    d = max((len(v) for _, _, v in ok), default=0)
    ok = [(i, y, v + [0] * (d - len(v))) for i, y, v in ok]
    anchors = {}
    for i, y, v in ok:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (y, v)), (y, v))
    out = []
    for i, (y, v) in anchors.items():
        best = {True: {}, False: {}}
        for j, z, w in ok:
            if j != i:
                best[y == z].setdefault(j, []).append(sum(p * q for p, q in zip(v, w)))
        good = sorted((-max(s), j) for j, s in best[True].items())[:most]
        for s, j in good:
            fit = sorted((-max(t for t in ts if 80 * -s <= 100 * t <= 100 * -s), k) for k, ts in best[False].items() if any(80 * -s <= 100 * t <= 100 * -s for t in ts))[:most]
            out += [(i, j, n + 1, k, -s, -t) for n, (t, k) in enumerate(fit)]
    return sorted(out)


def table(n, d, seed, labels=4):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(5, d))
    x = rng.normal(size=(n, d)) * 0.7 + centre[rng.integers(0, 5, n)]
    return [(i, int(y), v.tolist(), "x") for i, (y, v) in enumerate(zip(rng.integers(0, labels, n), x, strict=True))]


def mined(spark, rows, every, parts=3):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return sorted(tuple(r) for r in hn.mine(df, F.col("id") % every == 0).collect())


@pytest.mark.parametrize(("n", "d", "every"), [(600, 64, 20), (300, 7, 11), (150, 100, 10)])
def test_against_all_pairs(spark, n, d, every):
    rows = table(n, d, n)
    got = mined(spark, rows, every)
    assert got == brute(rows, every) and len(got) > n // 10


def test_odd_rows(spark):
    rows = table(200, 8, 1)
    rows += [(0, 1, rows[50][2], "x"), rows[3], rows[3], (None, 1, rows[4][2], "x"), (300, None, rows[4][2], "x"), (310, 1, None, "x"), (320, 1, [1.0, None], "x"), (330, 2, [float("nan")] * 8, "x"), (340, 2, [float("inf")] * 8, "x"),
             (350, 2, [], "x"), (360, 3, [0.0] * 8, "x"), (370, 3, [1.0] * 3, "x"), (380, 1, rows[7][2], "x"), (390, 2, rows[7][2], "x"), (-10, 1, rows[9][2], "x")]
    assert mined(spark, rows, 10) == brute(rows, 10)


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(hn, "BLOCK", 8)
    rows = table(240, 16, 5, labels=2)
    assert mined(spark, rows, 6) == brute(rows, 6)


def test_one_label_holds_nearly_all_and_copies(spark):
    rows = [(i, 0 if i % 9 else 1, [1.0, float(i % 3)], "x") for i in range(400)]
    assert mined(spark, rows, 50) == brute(rows, 50)


def test_empty(spark):
    assert mined(spark, [], 10) == []
    assert mined(spark, [(1, 1, [1.0], "x")], 10) == []
    assert mined(spark, [(10, 1, [1.0], "x")], 10) == []


def test_intervals_hold_and_rule_out():
    """At every stage the true score lies inside; on spread vectors few pairs reach the exact scoring."""
    rng = np.random.default_rng(2)
    rows, asked = rng.integers(-90, 90, (2_000, 64)), rng.integers(-90, 90, (16, 64))
    codes, align, left = hn.encode(rows)
    anchors, true = hn.Anchors(asked), asked @ rows.T
    seen = []

    def wanted(who, row, low, high):
        exact = true[who, row]
        assert ((low <= exact) & (exact <= high)).all()
        seen.append(len(who))
        return high >= np.sort(true, axis=1)[who, -5]

    who, row = hn.survivors(anchors, np.arange(16), codes, align, left, wanted)
    best = np.argsort(-true, axis=1)[:, :5]
    assert all(set(best[a]) <= set(row[who == a]) for a in range(16))
    assert len(who) < 0.1 * true.size
    assert (left[:, -1] < 0.3 * np.linalg.norm(rows, axis=1)).all()
    huge = np.full((2, 2_048), hn.FAR)
    assert hn.score(huge, huge).tolist() == [2_048 * hn.FAR**2] * 2
