"""The conversation trie against a plain one built turn by turn."""
import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from graftline.llm.prefix_trie import KEY, end_digests, prefix_trie


def brute(turns, donors):
    """Rows of the contract, from plain lists."""
    own = defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    plain = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 6 if donors else 0 for c in plain}
    full = {c: plain.get(c - int(abs(c) % 100 * (1 if c >= 0 else -1)), [])[:h[c]] + x[h[c]:] for c, x in plain.items()}
    members = defaultdict(list)
    for c, x in full.items():
        for d in range(len(x) + 1):
            members[tuple(x[:d])].append(c)
    children = defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    out = []
    for k, cs in members.items():
        below, leaves, saved = [k], 0, 0
        while below:
            x = below.pop()
            saved += (len(members[x]) - 1) * (len(x[-1][1]) if x else 0)
            leaves += not children[x]
            below += children[x]
        ids = ",".join(map(str, sorted(c for c in cs if len(full[c]) == len(k))))
        out.append((min(cs), len(k), min(members[k[:-1]]) if k else None, len(cs), len(children[k]), leaves, saved, hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df, donors):
    trie = prefix_trie(df, donor=lambda c: c - c % 100, taken=lambda c: F.crc32(c.cast("string")) % 6, most=5) if donors else prefix_trie(df)
    rows = trie.nodes.join(end_digests(trie.ends), KEY, "left").collect()
    none = hashlib.sha256(b"").hexdigest()
    return sorted(((r["conv_id"], r["depth"], r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"] or none) for r in rows), key=str)


def conversations():
    random.seed(4)
    rows = []
    for c in [*range(-120, 340), 1000, 1007]:
        if c % 100 == 0 and c in (0, 200):
            continue  # donors that are absent
        n = random.choice([0, 1, 1, 2, 3, 5, 8, 9]) or 1
        rows += [(c, t, random.choice(["user", None, "tool"]) if t % 2 else "user", random.choice(["hi", "", None, "so", "Grüße"]), "x") for t in range(n)]
    rows += [(300, 0, "user", "hi", "x")] * 3 + [(300, None, "z", "null first", "x"), (None, 1, "user", "no conversation", "x"), (5, 3, "b", "tie", "x"), (5, 3, "a", "tie", "x"), (77, 9, "user", "long " * 50_000, "x")]
    rows += [(c, t, "user", "copy", "x") for c in range(400, 500) for t in range(4)]  # many copies
    rows += [(501, t, "user", "ab"[t % 2], "x") for t in range(3_000)] + [(502, t, "user", "ab"[t % 2], "x") for t in range(2_999)]  # long ones
    return rows


@pytest.mark.parametrize("donors", [False, True])
def test_nodes(spark, donors):
    rows = conversations()
    short = [r for r in rows if r[0] not in (501, 502)]
    df = spark.createDataFrame(rows if donors else short, "conv_id long, turn long, role string, text string, depth string").repartition(6)
    want = brute([r[:4] for r in (rows if donors else short)], donors) if not donors else None
    if donors:  # the plain trie of the long ones is quadratic
        want = brute([r[:4] for r in short], True)
        got = found(df.where("conv_id NOT IN (501, 502) OR conv_id IS NULL"), True)
        assert got == want
        deep = found(df.where("conv_id IN (501, 502)"), False)
        assert len(deep) == 3_001 and sum(r[5] for r in deep if r[1] == 0) == 1 and [r[6] for r in deep if r[1] == 0] == [2_999]
    else:
        assert found(df, False) == want


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert found(none, True) == []
    assert len(found(spark.createDataFrame([(3, 0, "user", "only")], none.schema), False)) == 2


def test_stretches(spark, monkeypatch):
    """A long list of ends is hashed over many stretches and partitions."""
    from graftline.llm import prefix_trie as pt

    monkeypatch.setattr(pt, "STRETCH", 40)
    ends = spark.range(-500, 3_000).select(F.col("id").alias("conv_id"), F.lit(1).cast("long").alias("depth"), (F.col("id") % 2).alias("a"), F.lit(5).cast("long").alias("b"))
    got = {r["a"]: r["ends_sha256"] for r in pt.end_digests(ends).collect()}
    assert got == {a: hashlib.sha256(",".join(str(i) for i in range(-500, 3_000) if (i % 2 if i >= 0 else -(-i % 2)) == a).encode()).hexdigest() for a in (-1, 0, 1)}


def test_turns_lead_to_nodes(spark):
    df = spark.createDataFrame([(1, 0, "u", "a"), (1, 1, "u", "bcd"), (2, 0, "u", "a")], "conv_id long, turn long, role string, text string")
    trie = prefix_trie(df)
    assert trie.turns.join(trie.nodes.select(*KEY, "n_convs"), KEY).select("conv_id", "depth", "chars", "n_convs").orderBy("conv_id", "depth").collect() == [(1, 1, 1, 2), (1, 2, 3, 1), (2, 1, 1, 2)]
    assert sorted(map(tuple, trie.ends.select("conv_id", "depth").collect())) == [(1, 2), (2, 1)]
