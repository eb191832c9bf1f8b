"""Near copies, benchmark passages, chats and the pipeline against brute force."""
import json
import random

import numpy as np

from graftline.llm import chat_format, decontaminate, near_dedup

SF = "/root/testdata/sf0.001"


def probability_jaccard(p, x, q, y):
    """By its definition; equal weights on both sides make it the Jaccard of the sets."""
    a, b = dict(zip(p.tolist(), x.tolist())), dict(zip(q.tolist(), y.tolist()))
    both = a.keys() & b.keys()
    if max([*a.values(), *b.values()]) == 1:
        return len(both) / len(a.keys() | b.keys())
    every = np.array([(a.get(k, 0.0), b.get(k, 0.0)) for k in a.keys() | b.keys()])
    return sum(1 / np.maximum(every[:, 0] / a[i], every[:, 1] / b[i]).sum() for i in both)


def brute_classes(rows):
    """Smallest id of each connected component of pairs with an exact Jaccard, or probability Jaccard, of 0.8 or more."""
    held = [near_dedup.weighted_elements((t or "").encode()) for _, t in rows]
    sets = [(i, set(h.tolist())) for (i, _), (h, _) in zip(rows, held)]
    up = list(range(len(sets)))

    def top(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, (_, x) in enumerate(sets):
        for b in range(a):
            y = sets[b][1]
            if x & y and max(probability_jaccard(*held[a], *held[b]), len(x & y) / len(x | y)) >= 0.8:
                up[max(top(a), top(b))] = min(top(a), top(b))
    groups = {}
    for a, (i, _) in enumerate(sets):
        groups.setdefault(top(a), []).append(i)
    out = []
    for ids in groups.values():
        known = [i for i in ids if i is not None]
        out += [(i, min(known, default=None), len(ids)) for i in ids]
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def near_rows():
    random.seed(6)
    words = ["".join(random.choices("abcdefg", k=random.randint(2, 7))) for _ in range(300)]
    rows = []
    for g in range(25):
        base = random.choices(words, k=random.randint(3, 120))
        for c in range(random.randint(1, 9)):
            t = list(base)
            for _ in range(random.randint(0, 4) if c else 0):
                t[random.randrange(len(t))] = random.choice(words)
            rows.append((100 * g + c, " ".join(t)))
    rows += [(9000, None), (9001, ""), (9002, "?!"), (9003, "one two"), (9004, "One,  two!"), (None, rows[0][1]), rows[0], rows[1], (9005, "long text " * 20_000), (9006, "long text " * 19_000), (None, "alone here")]
    return rows


def test_near_classes(spark):
    rows = near_rows()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, class_id string")
    got = near_dedup.classes(df)
    assert order([tuple(r) for r in got.collect()]) == order(brute_classes(rows))
    assert near_dedup.classes(df.limit(0)).count() == 0
    kept = near_dedup.keep_one(df).collect()
    want = brute_classes(rows)
    assert kept and sorted(kept[0].asDict()) == ["class_id", "doc_id", "text"]
    ids = [r["doc_id"] for r in kept]
    assert sorted(i for i in ids if i is not None) == sorted({c for _, c, _ in want if c is not None}) and ids.count(None) == 1


def test_near_classes_of_unequal_repeats(spark):
    """Texts with equal elements are linked however often each repeats its lines."""
    random.seed(8)
    rows = []
    for g in range(10):
        lines = [" ".join("".join(random.choices("abcdefgh", k=7)) for _ in range(12)) for _ in range(20)]
        rows += [(10 * g + c, " ".join(lines + [x for x in lines[:2] for _ in range(n)])) for c, n in enumerate((1, 50))]
    want = brute_classes(rows)
    assert all(n == 2 for *_, n in want)
    assert order([tuple(r) for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()]) == order(want)


def test_near_classes_of_one_id(spark, monkeypatch):
    """Rows of one id (or none) are met by their text: no more texts are read than there are rows."""
    random.seed(9)
    rows = []
    for g in range(60):
        t = ["".join(random.choices("abcdefgh", k=6)) for _ in range(80)]
        rows += [(None if g % 2 else 7, " ".join(t)), (None if g % 2 else 7, " ".join([*t, "more"]))]
    seen = spark.sparkContext.accumulator(0)
    plain = near_dedup.digests

    def counted(w, n):
        seen.add(n)
        return plain(w, n)

    monkeypatch.setattr(near_dedup, "digests", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    written = df.sparkSession.createDataFrame(near_dedup.signatures(df, "doc_id", "text").collect(), near_dedup.signatures(df, "doc_id", "text").schema)
    before = seen.value
    assert near_dedup.node_labels(written, df, "doc_id", "text").select("label").distinct().count() == 60
    assert seen.value - before <= len(rows)


def test_near_classes_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert order([tuple(r) for r in near_dedup.classes(docs).collect()]) == order(brute_classes(rows))


def test_similarities_are_exact():
    rng = np.random.default_rng(3)
    for _ in range(40):
        sides = []
        for _ in "xy":
            h = np.sort(rng.choice(60, rng.integers(1, 50), replace=False)).astype(np.uint64)
            sides.append((h, 1 + np.log(rng.integers(1, 9, len(h)) if rng.random() < 0.8 else np.ones(len(h)))))
        plain, weighted = near_dedup.similarities(*sides)
        shared, union = (len(f(sides[0][0], sides[1][0])) for f in (np.intersect1d, np.union1d))
        assert abs(plain - shared / union) < 1e-12 and abs(weighted - probability_jaccard(*sides[0], *sides[1])) < 1e-9


def test_weighted_links(spark):
    """Texts whose repeated lines are alike and whose single ones are not: linked by weight alone."""
    random.seed(12)
    line = lambda n: " ".join("".join(random.choices("abcdefgh", k=7)) for _ in range(n))
    rows = []
    for g in range(8):
        common = [line(14) for _ in range(6)]
        rows += [(10 * g + c, "\n".join([x for x in common for _ in range(40)] + [line(30) for _ in range(1)])) for c in range(3)]
    a, b = (near_dedup.weighted_elements(t.encode()) for _, t in rows[:2])
    plain, weighted = near_dedup.similarities(a, b)
    assert plain < 0.8 <= weighted
    want = brute_classes(rows)
    assert all(n == 3 for *_, n in want)
    assert order([tuple(r) for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()]) == order(want)


def test_prob_minhash_estimates():
    """Equal registers estimate the probability Jaccard of weighted sets."""
    rng = np.random.default_rng(7)
    h = rng.integers(0, 1 << 44, 60, dtype=np.uint64)
    w = rng.integers(1, 20, (2, 60)).astype(float)
    sign = near_dedup.prob_minhash(np.repeat([0, 1], 60), np.r_[h, h], np.r_[w[0], w[1]], 2, 4096)
    want = sum(1 / sum(max(w[0][j] / w[0][i], w[1][j] / w[1][i]) for j in range(60)) for i in range(60))
    assert abs((sign[0] == sign[1]).mean() - want) < 0.03


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_best_passage():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (rng.integers(0, 4, rng.integers(lo, hi)).astype(np.uint64) for lo, hi in ((1, 7), (0, 12)))
        want = min(distance(list(a), list(b[i:j])) for i in range(len(b) + 1) for j in range(i, len(b) + 1))
        d, i, j = decontaminate.best_passage(a, b)
        assert d == want == distance(list(a), list(b[i:j]))


def test_decontamination(spark):
    random.seed(8)
    words = ["".join(random.choices("abcdefghij", k=random.randint(3, 8))) for _ in range(2000)]
    items = [(i, " ".join(random.choices(words, k=random.choice([3, 6, 12, 25, 60])))) for i in range(60)] + [(90, None), (91, "")]
    docs, want = [], set()
    for n, (i, t) in enumerate(items[:60]):
        own = t.split()
        for _ in range(len(own) // 5):
            k = random.randrange(len(own))
            own[k:k + random.choice([0, 1, 1])] = random.choice([[], [random.choice(words)]])
        if distance(t.split(), own) <= len(t.split()) // 5:
            want.add((n, i))
        docs.append((n, " ".join(random.choices(words, k=80) + own + random.choices(words, k=80)), "q"))
    docs += [(200 + n, " ".join(random.choices(words, k=200)), "q") for n in range(40)] + [(300, None, "q"), (301, "", "q"), docs[0], (302, " ".join(random.choices(words, k=50_000) + items[3][1].upper().split()), "q")]
    want.add((302, 3))
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.matches(df, bench).collect()
    found = {(r["doc_id"], r["item_id"]) for r in got}
    assert len(want & found) >= 0.97 * len(want) and found <= want
    assert sum(r["doc_id"] == 0 for r in got) == 2 * ((0, 0) in want)
    texts = {d: (t or "").split() for d, t, _ in docs}
    for r in got:
        passage = [w.lower() for w in texts[r["doc_id"]][r["first_word"]:r["end_word"]]]
        assert distance(dict(items)[r["item_id"]].split(), passage) == r["distance"] <= r["item_words"] // 5
    blocks = decontaminate.matches(df, bench, block_words=200).collect()
    assert sorted(map(tuple, blocks)) == sorted(map(tuple, got))
    kept = decontaminate.without_leaks(df, bench)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, _, _ in docs if d not in {f for f, _ in found})
    assert decontaminate.matches(df.limit(0), bench).count() == 0 and decontaminate.matches(df, bench.limit(0)).count() == 0


def call(id, name="search", arguments=None, after=None):
    return {"id": id, "name": name, "arguments": {"query": "q", "limit": 3} if arguments is None else arguments, **({"after": after} if after else {})}


def test_chats(spark):
    calls = lambda *c: json.dumps({"tool_calls": list(c)})
    result = lambda id, content: json.dumps({"tool_call_id": id, "content": content})
    rows = [
        (1, 0, "user", 'say "hi"\n{é}'), (1, 1, "assistant", calls(call("a"), call("b", arguments={"limit": 99, "zzz": {"y": 1, "x": [1.50, None]}}, after="c"))), (1, 2, "tool", result("a", "ok")), (1, 3, "tool", result("a", "again")),
        (1, 4, "tool", result("lost", None)), (1, 5, "assistant", calls(call("c", "fly", after="a"), call("a", "lookup", {"key": 5, "exact": True}))), (1, 6, "tool", result("b", "x")),
        (2, 0, "assistant", calls(call("p", after="q"), call("q", after="p"), call("r", after="q"), call("s", arguments=[1]))), (2, 1, "assistant", "{broken"), (2, 2, "tool", "{}"),
        (None, None, None, None), (None, 1, "user", ""), (3, 0, "assistant", calls(call("a"))), (3, 1, "tool", result("a", "long " * 30_000)),
    ]
    df = spark.createDataFrame([(*r, "n") for r in rows], "conv_id long, turn long, role string, text string, level string")
    got = chat_format.format_chats(df).collect()
    assert all(r["json"] == json.dumps(json.loads(r["json"]), sort_keys=True, separators=(",", ":"), ensure_ascii=False) for r in got if "1.5" not in r["json"])
    by = {(r["conv_id"], r["turn"], r["kind"], r["call_id"], r["name"]): r for r in got}
    assert by[1, 1, "call", "a", "search"]["status"] == "linked" and by[1, 1, "call", "a", "search"]["errors"] == ""
    b = by[1, 1, "call", "b", "search"]
    assert (b["level"], b["seq_turn"], b["status"], b["errors"]) == (2, 5, "linked", "limit:maximum,query:missing,zzz:unknown") and '"zzz":{"x":[1.5,null],"y":1}' in b["json"]
    assert by[1, 2, "result", "a", None]["status"] == "linked" and by[1, 3, "result", "a", None]["status"] == "repeated" and by[1, 4, "result", "lost", None]["status"] == "orphan"
    c = by[1, 5, "call", "c", "fly"]
    assert (c["level"], c["errors"], c["status"]) == (1, "unknown_tool", "no_result")
    assert by[1, 5, "call", "a", "lookup"]["status"] == "repeated_id" and by[1, 5, "call", "a", "lookup"]["errors"] == "key:type"
    assert {by[2, 0, "call", x, "search"]["status"] for x in "pqr"} == {"cyclic"} and by[2, 0, "call", "s", "search"]["errors"] == "arguments:not_an_object"
    assert by[2, 1, "message", None, None]["json"] == '{"content":"{broken","role":"assistant"}' and by[2, 2, "message", None, None]["status"] == "plain"
    assert by[None, None, "message", None, None]["json"] == '{"content":null,"role":null}'
    place = {(r["conv_id"], r["call_id"]): (r["seq_turn"], r["level"]) for r in got if r["kind"] == "call" and r["status"] in ("linked", "no_result")}
    assert place[1, "a"] < place[1, "c"] < place[1, "b"]
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_chats_lose_nothing(spark):
    """Calls without an identifier, what stands beside calls, and further fields stay in the result."""
    both = {"role": "assistant", "content": "Let me \"look\".", "refusal": None, "tool_calls": [{**call("a"), "type": "function", "z": {"y": [1], "b": None}}, {**call(None, "lookup", {"key": "k"}), "index": 3}]}
    rows = [(1, 0, "assistant", json.dumps(both)), (1, 1, "tool", json.dumps({"tool_call_id": "a", "is_error": True, "content": "ok", "aa": "é"})), (1, 2, "system", json.dumps({"tool_calls": [call("b")]})),
            (1, 3, "assistant", json.dumps({"content": None, "tool_calls": [call("c")]})), (1, 4, "assistant", json.dumps({"content": "x", "tool_calls": [call(None)]}))]
    got = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert all(r["json"] == json.dumps(json.loads(r["json"]), sort_keys=True, separators=(",", ":"), ensure_ascii=False) for r in got)
    have = {(r["turn"], r["kind"], r["name"]): (r["call_id"], r["status"], r["errors"], json.loads(r["json"])) for r in got}
    assert len(have) == len(got) == 8
    assert have[0, "message", None] == (None, "beside_calls", "", {"role": "assistant", "content": 'Let me "look".', "refusal": None})
    assert have[0, "call", "search"] == ("a", "linked", "", {"after": None, **both["tool_calls"][0]})
    assert have[0, "call", "lookup"] == (None, "missing_id", "", {"after": None, **both["tool_calls"][1]})
    assert have[1, "result", None] == ("a", "linked", "", {"tool_call_id": "a", "role": "tool", "is_error": True, "content": "ok", "aa": "é"})
    assert have[2, "message", None] == (None, "beside_calls", "", {"role": "system", "content": None}) and have[2, "call", "search"][1] == "no_result"
    assert have[3, "call", "search"][1] == "no_result" and have[4, "message", None] == (None, "plain", "", {"role": "assistant", "content": rows[4][3]})


def test_long_chain(spark):
    n = 300
    rows = [(7, i, "assistant", json.dumps({"tool_calls": [call(f"c{i}", after=f"c{i - 1}")]})) for i in range(n)]
    got = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r["turn"], r["level"]) for r in got) == [(i, i) for i in range(n)]


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = p.run(spark, SF).collect()
    kept = {r["doc_id"] for r in rows}
    assert 0 < len(kept) == len(rows) < docs.count() and {"text", "ids", "decoded"} <= set(rows[0].asDict())
    few = docs.limit(0)
    for name, stage in p.STAGES:
        out = stage(spark, few, SF)
        assert out.count() == 0, name
        assert name == "encode" or out.columns == docs.columns
    odd = spark.createDataFrame([(None, None, None, None, None), (5, "", "en", "s", 0), (5, "", "en", "s", 0), (6, "same words in this one text", "en", "s", 1), (6, "same words in this one text", "en", "s", 1)], docs.schema)
    n = [stage(spark, odd, SF).count() for _, stage in p.STAGES]
    assert n == [5, 5, 4, 5, 5]
